"""Queries over texts, feeds, reports and streams, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worldlog import roles
from worldlog.functions import scalar
from worldlog.roles import duck, table
from worldlog.sources import feeds
from worldlog.streaming import live

from .state import text

TERMS = ("the", "and")


def f11_url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalar.url_key(F.col("url")).alias("url_key"))


def f14_normalize_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return said.select("conv_id", "turn", scalar.normal_statement(F.col("text")).alias("statement"))


def f17_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections and retractions, over conversations with a cue put into some."""
    rows = table(spark, sf_dir, "conversations").withColumn(
        "text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" Correction: see below"))).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" zurückgezogen."))).otherwise(F.col("text"))
    )
    return rows.select("conv_id", "turn", F.col("text").rlike(scalar.CORRECTION_CUES).alias("corrects"), F.col("text").rlike(scalar.RETRACTION_CUES).alias("retracts"))


def f19_labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines of documents that begin with a labelled source and language."""
    head = F.concat(F.lit("Source of Text: "), "source", F.lit(".\nLink: http://x.org\n  Language (code):  "), "lang", F.lit(" \n"), "text")
    return feeds.labelled_lines(table(spark, sf_dir, "documents").select("doc_id", head.alias("text")), "doc_id", "text")


def f20_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"b":['), F.col("user_id").cast("string"), F.lit(',{"c":null}],"a":'), "props", F.lit("}")).alias("body"))
    return feeds.json_fields(rows, "event_id", "body")


def f27_probability_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that state a probability, and whether it is the forecast's own within half a point."""
    rows = roles.forecasts(spark, sf_dir).withColumn("said", F.concat(F.lit("We hold it at "), F.round(F.col("probability") * 100 + F.col("forecast_id") % 3 - 1).cast("int").cast("string"), F.lit("% by then.")))
    stated = scalar.probabilities_in(F.col("said"))
    return rows.select("forecast_id", F.exists(stated, lambda p: F.abs(p - F.col("probability")) <= 0.005).alias("agrees"))


def s04_strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event bodies, some torn, with repeated keys, out of range, too deep or with half a pair: the problem of each."""
    k = F.col("event_id") % 9
    deep = lambda n, within: F.concat(F.lit('{"a":'), F.repeat(F.lit("["), F.lit(n)), within, F.repeat(F.lit("]"), F.lit(n)), F.lit("}"))
    number = F.col("user_id").cast("string")
    body = (
        F.when(k == 0, F.col("props")).when(k == 1, F.expr("left(props, length(props) - 1)")).when(k == 2, F.lit('{"a":1,"a":2}')).when(k == 3, F.lit('{"a":1e999}')).when(k == 4, deep(256, number)).when(k == 5, deep(255, number))
        .when(k == 6, deep(256, F.lit(""))).when(k == 7, F.concat(F.lit('{"a":"x\\ud83d '), number, F.lit('"}'))).otherwise("[1]")
    )
    return table(spark, sf_dir, "events").select("event_id", feeds.strict_json(body).alias("problem"))


def s11_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = feeds.html_blocks(table(spark, sf_dir, "pages"))
    return blocks.select("page_id", F.size("blocks").cast("long").alias("n_blocks"), F.col("blocks")[0]["text"].alias("first"))


def s12_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    heads = pages.select(F.col("page_id").alias("id"), F.col("html").alias("head")).union(events.select("event_id", "props"))
    return heads.groupBy(feeds.detected_format(F.lit(None).cast("string"), F.col("head")).alias("format")).agg(F.count("*").alias("n"))


def p01_field_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of the log as text, tested against a feed's schema; counts of each kind of error."""
    from worldlog.operators import log

    rows = roles.log(spark, sf_dir).select(
        "seq", F.when(F.col("k") % 7 > 0, F.col("subject").cast("string")).alias("asset"), F.when(F.col("k") % 5 == 0, "n/a").otherwise(F.col("k").cast("string")).alias("count"),
        F.when(F.col("seq") % 2 == 0, "2024-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00").alias("at"), F.col("source_id").alias("kind"),
    )
    errors = log.field_errors([("asset", "string", True), ("count", "integer", True), ("at", "iso-datetime", True), ("kind", "string", False)], {"kind": ("click", "view", "purchase")})
    return rows.select(F.explode(errors).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def t01_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which one field holds all terms; the total is counted before the limit of 50."""
    has = lambda c: F.expr(" AND ".join(f"contains(lower({c}), '{t}')" for t in TERMS))
    found = (
        table(spark, sf_dir, "documents").filter(has("text")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
        .union(table(spark, sf_dir, "benchmark").filter(has("text")).select(F.lit("benchmark"), "item_id"))
        .union(table(spark, sf_dir, "pages").filter(has("url")).select(F.lit("page"), "page_id"))
    )
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("kind", "id").limit(50).join(F.broadcast(total))


def q26_report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of reports (conversation turns) and what is wrong with their basis, by code."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 3, "JUDGED").otherwise("SUPPORTED").alias("status"),
        F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, F.array().cast("array<long>")).otherwise(F.array((F.col("conv_id") * 7 + F.col("turn")) % 1100, F.col("conv_id") % 900)).alias("refs"),
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref"), "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.lit(True).alias("known"))
    empty = turns.filter("status = 'SUPPORTED' AND size(refs) = 0").select(F.lit("NO_EVIDENCE_BASIS").alias("code"), "conv_id", "turn")
    cited = turns.select("conv_id", "turn", "status", F.explode("refs").alias("ref")).join(docs, "ref", "left").join(labels, "ref", "left")
    code = F.when(F.col("known").isNull(), "UNRESOLVABLE_BASIS").when(F.expr("status = 'SUPPORTED' AND toxic = 1"), "STALE_BASIS").when(F.expr("status = 'SUPPORTED' AND quality = 0"), "CONTESTED_AS_SETTLED")
    found = cited.select(code.alias("code"), "conv_id", "turn").filter("code IS NOT NULL").distinct()
    return empty.union(found)


def q24_analogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose sets of order priorities and statuses are likest the first one's, by matches, then id."""
    sets = table(spark, sf_dir, "orders").select("o_custkey", F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("f")).distinct()
    mine = sets.filter("o_custkey = 1").select("f")
    return sets.filter("o_custkey <> 1").join(mine, "f").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(25)


def r01_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream: each source's watermark as state, late rows flagged and kept."""
    raw = live.stream_of(spark, f"{sf_dir}/events.parque*", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    k = F.get_json_object("props", "$.k").cast("long")
    late = F.when(k % 11 == 0, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    rows = raw.select((F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("source_id"), (F.col("ts") - late).alias("source_time"))
    return live.run_to_end(live.flag_late(rows), "late").select("seq", "source_id", text("watermark"), "late")


def r08_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators armed on different days: matches recorded and observed after the arming."""
    armed = [(1, "click", "2024-01-10", 90.0), (2, "view", "2024-01-20", 50.0), (3, "", "2024-01-25", 99.0), (4, "nothing", "2024-01-01", 0.0)]
    indicators = spark.createDataFrame(armed, "indicator_id long, attribute string, day string, least double")
    indicators = indicators.select("indicator_id", "attribute", F.col("day").cast("timestamp_ntz").alias("armed"), "least")
    observations = roles.log(spark, sf_dir).withColumnRenamed("source_id", "attribute")
    return live.fired(indicators, observations)


def r15_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.tumbling(roles.log(spark, sf_dir), "6 hours")
    return rows.select("source_id", text("start"), "n", F.round("total", 4).alias("total"))


def r15_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.sessions(roles.log(spark, sf_dir), "3 hours").select("subject", text("start"), "n")


_HAS = " AND ".join(f"contains(lower({{0}}), '{t}')" for t in TERMS)

SQL = {
    "f11_url_key": r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') ||
        CASE WHEN p = '' THEN '/' ELSE p END AS url_key FROM (SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages)""",
    "f14_normalize_statement": r"""SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' .,;:!?"''«»“”') AS statement FROM conversations""",
    "f17_cues": "SELECT conv_id, turn, turn % 3 = 0 OR regexp_matches(text, '(?i)\\b(correction|corrected|erratum)\\b') AS corrects, turn % 3 = 1 OR regexp_matches(text, '(?i)\\b(retraction|retracted|withdrawn)\\b') AS retracts FROM conversations",
    "f19_labelled_lines": r"""WITH t AS (SELECT doc_id, string_split('Source of Text: ' || source || '.' || chr(10) || 'Link: http://x.org' || chr(10) || '  Language (code):  ' || lang || ' ' || chr(10) || text, chr(10))[:200] AS all_lines FROM documents),
        l AS (SELECT doc_id, unnest(all_lines) AS said, generate_subscripts(all_lines, 1) AS line FROM t),
        p AS (SELECT *, coalesce(sum(length(said) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM l),
        m AS (SELECT doc_id, base, said, regexp_extract(said, '^\s*([A-Za-zÀ-ÿ][\p{L}\p{N}_ /()-]{2,48}):\s+(.{2,160}?)\s*\.?\s*$', 1) AS label, regexp_extract(said, '^\s*([A-Za-zÀ-ÿ][\p{L}\p{N}_ /()-]{2,48}):\s+(.{2,160}?)\s*\.?\s*$', 2) AS value FROM p)
        SELECT doc_id, trim(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '_') AS attribute, value, CAST(base + length(regexp_extract(said, '^\s*[^:]*:\s+')) AS BIGINT) AS start, CAST(base + length(regexp_extract(said, '^\s*[^:]*:\s+')) + length(value) AS BIGINT) AS "end"
        FROM m WHERE label <> '' AND NOT regexp_matches(value, '^(//|http)')""",
    "f20_json_fields": """SELECT event_id, '$.a.k' AS path, props->>'$.k' AS value FROM events UNION ALL SELECT event_id, '$.b[0]', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, '$.b[1].c', '' FROM events""",
    "f27_probability_literals": duck("SELECT forecast_id, abs(CAST(round(probability * 100 + forecast_id % 3 - 1) AS INT) / 100.0::DOUBLE - probability) <= 0.005 AS agrees FROM forecasts", "forecasts"),
    "s04_strict_json": "SELECT event_id, [NULL, 'INVALID', 'INVALID', 'NOT_FINITE', 'TOO_DEEP', NULL, NULL, 'LONE_SURROGATE', 'NOT_AN_OBJECT'][event_id % 9 + 1] AS problem FROM events",
    "s12_detect_format": "SELECT 'HTML' AS format, count(*) AS n FROM pages UNION ALL SELECT 'JSON', count(*) FROM events",
    "p01_field_errors": duck(
        """SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN k % 7 = 0 THEN 'missing asset' END, CASE WHEN k % 5 = 0 THEN 'count is no integer' END, CASE WHEN seq % 2 = 1 THEN 'at is no iso-datetime' END,
        CASE WHEN source_id NOT IN ('click', 'view', 'purchase') THEN 'kind is not listed' END]) AS reason FROM log) WHERE reason IS NOT NULL GROUP BY 1""", "log"),
    "t01_search": f"""WITH f AS (SELECT 'document' AS kind, doc_id AS id FROM documents WHERE {_HAS.format('text')} UNION ALL SELECT 'benchmark', item_id FROM benchmark WHERE {_HAS.format('text')}
        UNION ALL SELECT 'page', page_id FROM pages WHERE {_HAS.format('url')}) SELECT kind, id, (SELECT count(*) FROM f) AS total FROM f ORDER BY kind, id LIMIT 50""",
    "q26_report_findings": """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'JUDGED' ELSE 'SUPPORTED' END AS status, CASE WHEN (conv_id + turn) % 6 = 0 THEN [] ELSE [(conv_id * 7 + turn) % 1100, conv_id % 900] END AS refs FROM conversations),
        c AS (SELECT conv_id, turn, status, unnest(refs) AS ref FROM t)
        SELECT 'NO_EVIDENCE_BASIS' AS code, conv_id, turn FROM t WHERE status = 'SUPPORTED' AND len(refs) = 0 UNION ALL
        SELECT DISTINCT * FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'UNRESOLVABLE_BASIS' WHEN status = 'SUPPORTED' AND toxic = 1 THEN 'STALE_BASIS' WHEN status = 'SUPPORTED' AND quality = 0 THEN 'CONTESTED_AS_SETTLED' END AS code, conv_id, turn
          FROM c LEFT JOIN documents d ON d.doc_id = ref LEFT JOIN labels l ON l.doc_id = ref) WHERE code IS NOT NULL""",
    "q24_analogues": """WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority || '/' || o_orderstatus AS f FROM orders) SELECT o_custkey, count(*) AS n FROM s WHERE o_custkey <> 1 AND f IN (SELECT f FROM s WHERE o_custkey = 1)
        GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25""",
    "r01_stream_late": duck("SELECT seq, source_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS watermark, coalesce(source_time < w, false) AS late FROM (SELECT *, max(source_time) OVER (PARTITION BY source_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM log)", "log"),
    "r08_indicators": duck(
        """, i AS (SELECT * FROM (VALUES (1::BIGINT, 'click', TIMESTAMP '2024-01-10', 90.0), (2, 'view', TIMESTAMP '2024-01-20', 50.0), (3, '', TIMESTAMP '2024-01-25', 99.0), (4, 'nothing', TIMESTAMP '2024-01-01', 0.0)) v(indicator_id, attribute, armed, least))
        SELECT indicator_id, count(*) AS n, min(seq) AS first_seq FROM i JOIN log ON (attribute = '' OR attribute = source_id) AND recorded_time > armed AND source_time > armed AND value >= least GROUP BY 1""", "log"),
    "r15_tumbling": duck("SELECT source_id, strftime(time_bucket(INTERVAL 6 HOURS, source_time, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM log GROUP BY 1, 2", "log"),
    "r15_sessions": duck(
        """, g AS (SELECT subject, source_time, coalesce(source_time - lag(source_time) OVER (PARTITION BY subject ORDER BY source_time) >= INTERVAL 3 HOURS, true)::INT AS new FROM log),
        s AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY source_time) AS run FROM g) SELECT subject, strftime(min(source_time), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY subject, run""", "log"),
}

QUERIES = {
    f.__name__: f
    for f in (
        f11_url_key, f14_normalize_statement, f17_cues, f19_labelled_lines, f20_json_fields, f27_probability_literals, s04_strict_json,
        s11_html_blocks, s12_detect_format, p01_field_errors, t01_search, q26_report_findings, q24_analogues, r01_stream_late,
        r08_indicators, r15_tumbling, r15_sessions,
    )
}
