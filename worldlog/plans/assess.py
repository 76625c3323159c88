"""Queries of assessments, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog.operators import assess
from worldlog.roles import table

CLAIM_STATES = ("CURRENT", "CURRENT", "STALE", "RETRACTED")
KEY_STATES = ("VALID", "REVOKED", "VALID")


def _pick(values: tuple[str, ...], n: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def q15_refreshed_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hypotheses on the parts of their lines, returned ones against, makers as families."""
    against = F.when(F.col("l_returnflag") == "R", "CONTRADICTING").otherwise("SUPPORTING")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hypothesis_id"), F.col("l_partkey").alias("claim_id"), against.alias("stance"))
    p = F.col("p_partkey")
    claims = table(spark, sf_dir, "part").select(p.alias("claim_id"), _pick(CLAIM_STATES, p % 4).alias("state"), F.when(p % 5 > 0, F.col("p_brand")).alias("family"))
    return assess.refreshed_hypotheses(links, claims)


def q17_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses: addresses, identifiers, successors and aliases found on them."""
    p, host = F.col("page_id"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    found = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.alias("value"))
        for kind, name, value in (("IDENTIFIER", "URL", F.col("url")), ("IDENTIFIER", "LEI", F.concat(F.lit("L"), p % 7)), ("ATTRIBUTE", "successor_lei", F.concat(F.lit("L"), p % 5)), ("ATTRIBUTE", "alias:en", F.when(p % 3 == 0, host).otherwise("other")), ("ATTRIBUTE", "note", F.lit("x")))
    ])
    results = table(spark, sf_dir, "pages").select(p.alias("response_id"), host.alias("subject"), F.concat(F.lit("L"), p % 10).alias("native_id"), F.explode(found).alias("f")).select("response_id", "subject", "native_id", "f.*")
    return assess.pivots(results)


def q21_degraded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paths to their customers' objectives, resting on parts as claims and suppliers as assumptions."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rests = F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")))
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("ACTIVE")
    paths = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_orderkey").alias("path_id"), F.col("o_custkey").alias("objective_id"), status.alias("status"), rests.alias("basis_id"))
    p = F.col("p_partkey")
    claims = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), p).alias("claim_id"), F.when(p % 20 == 0, "STALE").otherwise("CURRENT").alias("state"))
    invalid = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("assumption_id"))
    return assess.degraded_paths(paths, claims, invalid)


def q29_replay_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signed actions of their users' keys, whose states their purchases and signups tell."""
    e, u = F.col("event_id"), F.col("user_id")
    events = table(spark, sf_dir, "events")
    actions = events.select(e.alias("action_id"), F.col("props").alias("payload"), F.when(e % 9 == 0, "x").otherwise(F.sha2("props", 256)).alias("payload_digest"), u.alias("key_id"), e.alias("time"), (e % 7 > 0).alias("signed"))
    states = events.filter("event_type IN ('signup', 'purchase')").select(u.alias("key_id"), e.alias("at"), _pick(KEY_STATES, e % 3).alias("status"))
    return assess.replay_verdicts(actions, events.filter("user_id % 8 > 0").select(u.alias("key_id")), states)


def p04_definition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as schema definitions, sound and not."""
    p = F.col("p_partkey")
    body = F.format_string(
        '{"schema_id":"s%d","version":"1","media_type":"m"%s,"payload_kind":"%s","fields":{"a":{"type":"%s"},"b":{"type":"integer"%s}}}', p, F.when(p % 2 == 0, ',"extra":1').otherwise(""),
        F.when(p % 3 == 0, "blob").otherwise("rows"), F.when(p % 5 == 0, "text").otherwise("string"), F.when(p % 7 == 0, ',"format":"time","hint":1').otherwise(',"format":"sha256"'),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(p % 11 == 0, "{").when(p % 13 == 0, '{"fields":{}}').otherwise(body).alias("body"))
    return rows.select("p_partkey", F.array_join(assess.definition_problems("body"), "; ").alias("problems"))


def s05_foreign_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as foreign JSON: lone halves of a pair, whole pairs, escaped backslashes, torn texts."""
    e = F.col("event_id")
    said = _pick(("\\ud83d", "\\ud83d\\ude00", "\\\\ud83d", "a\\udc00b", "plain"), e % 5)
    body = F.concat(F.lit('{"n":'), e.cast("string"), F.lit(',"t":"'), said, F.when(e % 6 == 0, '"').otherwise('"}'))
    found = table(spark, sf_dir, "events").select("event_id", body.alias("body")).select("event_id", assess.foreign_json("body").alias("f"))
    return found.select("event_id", "f.*")


_LINKS = """SELECT DISTINCT l_orderkey AS h, l_partkey AS c, l_returnflag = 'R' AS against, CASE p_partkey % 4 WHEN 2 THEN 'STALE' WHEN 3 THEN 'RETRACTED' ELSE CASE WHEN p_partkey IS NOT NULL THEN 'CURRENT' END END AS state,
    CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS family FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"""
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_PATHS = """SELECT o_orderkey AS path, o_custkey AS objective, CASE WHEN p_partkey % 20 = 0 THEN 'EVIDENCE_DEGRADED' END AS weak, CASE WHEN s_acctbal < 0 THEN 'ASSUMPTION_INVALIDATED' END AS bad
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus <> 'F'"""

SQL = {
    "q15_refreshed_hypotheses": f"""WITH l AS ({_LINKS}), n AS (SELECT h, count(DISTINCT family) FILTER (WHERE NOT against AND state = 'CURRENT') AS independent, count(DISTINCT c) FILTER (WHERE NOT against AND state = 'CURRENT') AS n_active,
          count(DISTINCT c) FILTER (WHERE NOT against AND state IN ('STALE', 'RETRACTED')) AS n_degraded, count(DISTINCT c) FILTER (WHERE against AND state = 'CURRENT') AS n_contradicting FROM l GROUP BY 1)
        SELECT h AS hypothesis_id, CASE WHEN n_contradicting > 0 AND n_active > 0 THEN 'DISPUTED' WHEN n_contradicting >= 2 THEN 'REJECTED' WHEN n_contradicting = 1 THEN 'DISPUTED' WHEN independent >= 2 THEN 'SUPPORTED' WHEN independent = 1 THEN 'WEAKLY_SUPPORTED' ELSE 'UNRESOLVED' END AS status,
          independent, n_active, n_degraded, n_contradicting FROM n""",
    "q17_pivots": f"""WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages), e AS (SELECT page_id, host AS a, 'URL:' || url AS b, 'IDENTIFIER_OF' AS t FROM p UNION SELECT page_id, host, 'LEI:L' || page_id % 7, 'IDENTIFIER_OF' FROM p UNION SELECT page_id, 'LEI:L' || page_id % 7, 'gleif', 'LEADS_TO_SOURCE_FAMILY' FROM p
          UNION SELECT page_id, host, lower(host), 'OPERATES_DOMAIN' FROM p UNION SELECT page_id, 'LEI:L' || page_id % 10, 'LEI:L' || page_id % 5, 'SUCCESSOR_OF' FROM p UNION SELECT page_id, host, CASE WHEN page_id % 3 = 0 THEN host ELSE 'other' END, 'ALIAS_OF' FROM p)
        SELECT page_id AS response_id, a AS from_ref, b AS to_ref, t AS pivot_type FROM e WHERE a <> b AND b <> ''""",
    "q21_degraded_paths": f"""WITH h AS ({_PATHS}), r AS (SELECT path, objective, unnest([weak, bad]) AS reason FROM h) SELECT 'impact_path' AS kind, path AS id, min(reason) AS reason FROM r WHERE reason IS NOT NULL GROUP BY path UNION ALL SELECT 'mission_objective', objective, min(reason) FROM r WHERE reason IS NOT NULL GROUP BY objective""",
    "q29_replay_verdicts": """WITH s AS (SELECT user_id AS u, event_id AS pos, ['VALID', 'REVOKED', 'VALID'][event_id % 3 + 1] AS st FROM events WHERE event_type IN ('signup', 'purchase'))
        SELECT event_id AS action_id, CASE WHEN event_id % 9 = 0 THEN 'DIGEST_MISMATCH' WHEN user_id % 8 = 0 THEN 'KEY_UNKNOWN' WHEN event_id % 7 = 0 THEN 'SIGNATURE_INVALID' WHEN st IS DISTINCT FROM 'VALID' THEN 'KEY_NOT_VALID_AT_TIME' ELSE 'GENUINE' END AS verdict
        FROM events LEFT JOIN (SELECT e.event_id AS id, arg_max(st, pos) AS st FROM events e JOIN s ON u = e.user_id AND pos <= e.event_id GROUP BY 1) ON id = event_id""",
    "p04_definition_problems": """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'INVALID' WHEN p_partkey % 13 = 0 THEN 'missing media_type; missing payload_kind; missing schema_id; missing version' ELSE concat_ws('; ', CASE WHEN p_partkey % 2 = 0 THEN 'unknown extra' END, CASE WHEN p_partkey % 3 = 0 THEN 'payload_kind' END,
        CASE WHEN p_partkey % 5 = 0 THEN 'type of a' END, CASE WHEN p_partkey % 7 = 0 THEN 'keys of b' END, CASE WHEN p_partkey % 7 = 0 THEN 'format of b' END) END AS problems FROM part""",
    "s05_foreign_json": r"""SELECT event_id, CASE WHEN event_id % 6 > 0 THEN '{"n":' || event_id || ',"t":"' || ['\ufffd', '\ud83d\ude00', '\\ud83d', 'a\ufffdb', 'plain'][event_id % 5 + 1] || '"}' END AS value, event_id % 5 IN (0, 3) AS repaired, CASE WHEN event_id % 6 = 0 THEN 'INVALID' END AS problem FROM events""",
}

QUERIES = {f.__name__: f for f in (q15_refreshed_hypotheses, q17_pivots, q21_degraded_paths, q29_replay_verdicts, p04_definition_problems, s05_foreign_json)}
