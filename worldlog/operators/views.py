"""Read models: references, custody, rules, admission of signed actions, and the ordered choice among candidates."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldlog.functions import scalar

# What a response status means, and how Cyrillic letters are written in Latin ones.
STATUS_CLASS = {401: "ACCESS_RESTRICTED", 402: "ACCESS_RESTRICTED", 403: "ACCESS_RESTRICTED", 407: "ACCESS_RESTRICTED", 451: "ACCESS_RESTRICTED"}
CYRILLIC = ("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")
CYRILLIC_LONG = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ё": "yo", "ъ": "", "ь": ""}
AUTHORITY = ("OBSERVED", "DERIVED", "INFERRED", "ASSUMED")


def first_code(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds; null if none does. Unknown conditions do not hold."""
    return reduce(lambda col, r: col.when(F.coalesce(r[0], F.lit(False)), r[1]), rules[1:], F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1]))


def response_class(status: Column, error: Column, results: Column) -> Column:
    restricted = status.isin(*STATUS_CLASS)
    return F.when(restricted, "ACCESS_RESTRICTED").when((status >= 400) | error.isNotNull(), "FAILED").when(results > 0, "OK").otherwise("EMPTY")


def damaged(rows: DataFrame, content: str, digest: str) -> DataFrame:
    """Rows whose content is not what their digest says; null content is damage too."""
    return rows.filter(~F.coalesce(F.sha2(F.col(content), 256) == F.col(digest), F.lit(False)))


def addressed(rows: DataFrame, content: str, key: str) -> DataFrame:
    """digest, shelf, first, n: one row for each content, however often it was put; the sink is partitioned by shelf."""
    keyed = rows.select(F.sha2(F.col(content), 256).alias("digest"), key)
    return keyed.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).withColumn("shelf", F.substring("digest", 1, 2))


def path_value(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; UNKNOWN where there is none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), f"$.{path}", "string"), F.lit("UNKNOWN"))


def resolved(refs: DataFrame, records: DataFrame) -> DataFrame:
    """refs (ref: ``kind:id`` or ``*:id``, perhaps with ``@vN``) with the version they name, the last if they name none.

    records: kind, id, version. Unresolved references stay, with nulls.
    """
    pin = F.nullif(F.regexp_extract("ref", r"@v(\d+)$", 1), F.lit("")).cast("long")
    bare = F.regexp_replace("ref", r"@v\d+$", "")
    asked = refs.select("ref", F.split_part(bare, F.lit(":"), F.lit(1)).alias("_kind"), F.regexp_replace(bare, "^[^:]*:", "").alias("id"), pin.alias("_pin"))
    fits = ((F.col("_kind") == "*") | (F.col("_kind") == F.col("kind"))) & (F.col("_pin").isNull() | (F.col("_pin") == F.col("version")))
    met = asked.join(records.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & fits, "left")
    return met.groupBy("ref").agg(F.max_by(F.struct("kind", "version"), F.struct("version", "kind")).alias("_r")).select("ref", "_r.kind", "_r.version")


def cited_ids(rows: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, token of id-shaped words in free text that no visible record has."""
    found = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\b([a-z]+-\d+)\b"), F.lit(1)))).alias("token"))
    return found.join(known.select(F.col("id").alias("token")), "token", "left_anti").select(key, "token")


def weakest_authority(rows: DataFrame, key: str) -> DataFrame:
    """key, authority: the least certain of each group, by the order of ``AUTHORITY``."""
    rank = F.array_position(F.array(*map(F.lit, AUTHORITY)), F.col("authority"))
    return rows.groupBy(key).agg(F.max_by("authority", rank).alias("authority"))


@cache
def _marks() -> tuple[str, str]:
    """Latin letters that decompose to a letter and marks, the letters without them, and the marks (which go)."""
    bare = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])}
    found = {c: b for c, b in bare.items() if b != c}
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


def folded(text: Column) -> Column:
    """Latin letters without their marks, by canonical decomposition."""
    return F.replace(F.translate(text, *_marks()), F.lit("ß"), F.lit("ss"))


def cyrillic_to_latin(text: Column) -> Column:
    lower = reduce(lambda col, x: F.replace(col, F.lit(x[0]), F.lit(x[1])), CYRILLIC_LONG.items(), F.lower(text))
    return F.translate(lower, *CYRILLIC)


def key_status(uses: DataFrame, keys: DataFrame) -> DataFrame:
    """use_id, status of the key of each use (use_id, key_id, at): its last one by status_time at that time, then by seq."""
    states = keys.withColumnRenamed("key_id", "_key")
    ruled = uses.join(states, (uses.key_id == states["_key"]) & (states.status_time <= uses["at"]))
    return ruled.groupBy("use_id").agg(F.max_by("status", F.struct("status_time", "seq")).alias("status"))


def admission(actions: DataFrame, sessions: DataFrame, keys: DataFrame, expected: dict[str, object], now: int, skew: int = 300) -> DataFrame:
    """action_id and ``code``, the first refusal in a fixed order: session, actor, mission, target, nonce, version, clock,
    signature, key; null if admitted.

    actions: action_id, session_id, actor, mission_id, target, nonce, version, at, digest, said_digest; sessions:
    session_id, actor, key_id; keys: key_id, status_time, seq, status. ``expected``: the mission_id, target and version
    that hold. A nonce is good once, for its first use; a key counts as what it was when the action was signed.
    """
    known = sessions.select("session_id", F.col("actor").alias("_actor"), F.col("key_id").alias("_key"))
    first = actions.filter("nonce IS NOT NULL").groupBy("nonce").agg(F.min("action_id").alias("_first"))
    met = actions.join(known, "session_id", "left").join(first, "nonce", "left")
    status = key_status(met.select(F.col("action_id").alias("use_id"), F.col("_key").alias("key_id"), "at"), keys)
    held = keys.select(F.col("key_id").alias("_held")).distinct()
    met = met.join(held, F.col("_key") == F.col("_held"), "left").join(status.withColumnRenamed("use_id", "action_id"), "action_id", "left")
    differs = lambda c, value: ~F.coalesce(F.col(c) == value, F.lit(False))
    code = first_code(
        (F.col("_key").isNull(), "EXPIRED_SESSION"),
        (differs("actor", F.col("_actor")), "WRONG_ACTOR"),
        (differs("mission_id", F.lit(expected["mission_id"])), "WRONG_MISSION"),
        (differs("target", F.lit(expected["target"])), "WRONG_TARGET"),
        (differs("_first", F.col("action_id")), "REPLAYED_NONCE"),
        (differs("version", F.lit(expected["version"])), "STALE_VERSION"),
        (~F.coalesce(F.abs(F.col("at") - now) <= skew, F.lit(False)), "CLOCK_SKEW"),
        (F.col("_held").isNull() | differs("said_digest", F.col("digest")), "INVALID_SIGNATURE"),
        (differs("status", F.lit("VALID")), "KEY_NOT_VALID"),
    )
    return met.select("action_id", code.alias("code"))


def route_exposure(routes: DataFrame, findings: DataFrame) -> DataFrame:
    """route, n: distinct disruptions that expose each route, none counted twice; routes without any stay."""
    last = findings.groupBy("route", "disruption").agg(F.max_by("condition", "rank").alias("condition"))
    counts = last.groupBy("route").agg(F.count("*").alias("n"))
    return routes.join(counts, "route", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


#: What the fingerprint of an edge binds, in order.
EDGE_FIELDS = ("from_kind", "from_id", "to_kind", "to_id", "edge_kind", "effect_order", "authority", "basis_ids", "assumption_ids", "note")


def edge_chain(edges: Column) -> Column:
    """A fingerprint of a path (array of structs of ``EDGE_FIELDS``): those of its edges in order."""

    def one(edge: Column) -> Column:
        parts = [edge[f] for f in EDGE_FIELDS]
        parts[7], parts[8], parts[9] = F.array_join(parts[7], ","), F.array_join(parts[8], ","), F.substring(parts[9], 1, 300)
        return scalar.digest_id("edgefp", *parts)

    return F.array_join(F.transform(edges, one), ">")


TOKEN = r"\b[a-z]+-[0-9a-f]+(?:@v\d+)?\b"
#: Ids are also known by their first so many characters, where those are one id's alone.
SHORT_FORMS = (24, 18, 16)


def redacted(rows: DataFrame, key: str, text: str, hidden: DataFrame) -> DataFrame:
    """key and text with every hidden id, its ``@vN`` and its unique short forms replaced by REDACTED.

    Only the id-shaped tokens of texts meet the hidden ids, in a join, since these may be as many as the texts; each text
    is then put together from its parts. ``key`` is unique.
    """
    ids = hidden.select("id").distinct()
    short = [ids.filter(F.length("id") > n).groupBy(F.substring("id", 1, n).alias("id")).agg(F.count("*").alias("n")).filter("n = 1").select("id") for n in SHORT_FORMS]
    known = reduce(DataFrame.union, short, ids).distinct()
    cut = rows.select(key, F.split(text, TOKEN).alias("_parts"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("_tokens"))
    asked = cut.select(key, F.posexplode("_tokens").alias("_at", "_token")).withColumn("id", F.regexp_replace("_token", r"@v\d+$", ""))
    met = asked.join(known, "id", "left_semi").groupBy(key).agg(F.collect_set("_at").alias("_hide"))
    token = lambda i: F.when(F.array_contains("_hide", i), "REDACTED").otherwise(F.coalesce(F.get("_tokens", i), F.lit("")))
    whole = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, token(i))), "")
    return cut.join(met, key, "left").select(key, whole.alias(text))


TRANSFORMS = {
    "copy": lambda c: c,
    "upper": F.upper,
    "number": lambda c: c.try_cast("double").cast("string"),
    "day": lambda c: F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd"),
}


def mapped(rows: DataFrame, key: str, mapping: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """key, the mapped fields, and ``warnings``: sources without a value, and values that a transform lost.

    ``mapping``: (target, source, transform, default); fields that it does not name are dropped.
    """
    out, warnings = [], []
    for target, source, transform, default in mapping:
        value = TRANSFORMS[transform](F.col(source))
        out.append(F.coalesce(value, F.lit(default)).alias(target))
        warnings.append(F.when(F.col(source).isNull(), F.lit(f"{source} missing")).when(value.isNull(), F.lit(f"{source} lost by {transform}")))
    return rows.select(key, *out, F.array_join(F.array_compact(F.array(*warnings)), "; ").alias("warnings"))
