"""Queries over feeds and their ingest, and the SQL they are held against. Feeds are written as files from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog import roles
from worldlog.functions import scalar
from worldlog.operators import ingest, log, schemas
from worldlog.operators.graph import dealt, saved, shared_folder
from worldlog.roles import duck, table
from worldlog.sources import feeds
from worldlog.streaming import live

from .state import CUT


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def s01_log_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as lines, some empty, some with a carriage return, some torn: lines by what is wrong with them."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 10
    line = F.when(k == 3, "").when(k == 5, F.concat("props", F.lit("\r"))).when(k == 7, F.expr("left(props, length(props) - 2)")).otherwise(F.col("props"))
    path = _folder(spark, "framing")
    e.select(line.alias("value")).write.text(path)
    return feeds.log_lines(spark, path).groupBy(F.coalesce("problem", F.lit("NONE")).alias("problem")).agg(F.count("*").alias("n"))


def s02_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows between two reads, some of its lines torn: the second read takes up where the first ended, and what
    cannot be read is kept with the reason."""
    line = F.to_json(F.struct("seq", "source_id"))
    rows = roles.log(spark, sf_dir).select(F.when(F.col("seq") % 13 == 5, F.expr("left(source_id, 2)")).otherwise(line).alias("value"), "seq")
    path, out, state = (_folder(spark, x) for x in ("segments", "tail", "state"))
    for read, part in enumerate(("seq <= 4000", "seq > 4000"), 1):
        rows.filter(part).select("value").write.mode("append").text(path)
        live.catch_up(spark, path, "seq long, source_id string", out, state, read)
    found = spark.read.schema("seq long, source_id string, problem string, line string, read int").parquet(out)
    return found.select("seq", "source_id", "problem", "line", "read")


def s06_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as one document each: keys in order, no white space; what is no object is named."""
    body = F.when(F.col("event_id") % 4 == 0, "[1]").otherwise(F.concat(F.lit('{ "z": '), F.col("user_id"), F.lit(', "a": {"y":1,"b":[ 2 ]} }')))
    rows = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return feeds.json_documents(rows, "event_id", "body")


def s07_csv_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV with lines too short, too long, and prices that are no numbers."""
    k = F.col("o_orderkey") % 10
    price = F.when(k == 4, "n/a").when(k == 6, "").otherwise("2.5")
    line = F.when(k == 0, F.concat_ws(",", "o_orderkey", price)).when(k == 1, F.concat_ws(",", "o_orderkey", price, F.lit("yes"), F.lit("more"))).otherwise(F.concat_ws(",", "o_orderkey", price, F.when(k > 5, "Yes").otherwise("no")))
    path = _folder(spark, "csv")
    table(spark, sf_dir, "orders").select(line.alias("key,price,flag")).write.option("header", True).option("sep", "\u0001").csv(path)
    return feeds.csv_feed(spark, path, {"key": "integer", "price": "number", "flag": "boolean"})


def s08_geojson_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, points off the globe, closed and open rings as features of collections."""
    k, x = F.col("vec_id") % 5, F.round(F.col("embedding")[0] * 50, 3).cast("string")
    ring = lambda last: F.concat(F.lit("[[["), x, F.lit(",1],[2,3],[4,5],["), last, F.lit("]]]"))
    shape = (
        F.when(k == 0, F.concat(F.lit('{"type":"Point","coordinates":[200,'), x, F.lit("]}")))
        .when(k == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), ring(F.concat(x, F.lit(",1"))), F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"type":"Polygon","coordinates":'), ring(F.lit("9,9")), F.lit("}")))
        .when(k == 3, F.concat(F.lit('{"type":"LineString","coordinates":[['), x, F.lit(",1],[2,95]]}")))
        .otherwise(F.concat(F.lit('{"type":"Point","coordinates":['), x, F.lit(",1]}")))
    )
    body = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'), shape, F.lit(',"properties":{"n":1}}]}'))
    found = feeds.geojson_features(table(spark, sf_dir, "embeddings").select("vec_id", body.alias("body")), "vec_id", "body")
    return found.select("vec_id", "kind", F.coalesce("problem", F.lit("NONE")).alias("problem"))


def s09_evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence bundles, some without a part: what each wants, and the id of what it asserts."""
    k = F.col("doc_id") % 6
    part = lambda n, body: F.when(k == n, "{}").otherwise(body)
    bundle = F.concat(
        F.lit('{"source_object":'), part(1, F.concat(F.lit('{"source_object_id":"'), "source", F.when(k == 2, F.lit('"}')).otherwise(F.concat(F.lit('","content_sha256":"'), F.sha2("text", 256), F.lit('"}'))))),
        F.lit(',"document":'), part(3, F.concat(F.lit('{"document_id":"d'), "doc_id", F.lit('"}'))),
        F.lit(',"assertion":'), part(4, F.concat(F.lit('{"assertion_id":"a'), "doc_id", F.lit('"}'))), F.lit("}"),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 5, "{torn").otherwise(bundle).alias("body"))
    return feeds.evidence_bundles(rows, "doc_id", "body")


def s13_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS and Atom items of pages, with times in both manners; feeds with a DTD are refused."""
    k, url = F.col("page_id") % 4, F.replace("url", F.lit("&"), F.lit("&amp;"))
    rss = F.concat(F.lit("<rss><channel><item><guid>g"), "page_id", F.lit("</guid><title>T</title><link>"), url, F.lit("</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate></item><item><title>no id</title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed><entry><id>e'), "page_id", F.lit('</id><title>A</title><link href="'), url, F.lit('"/><updated>2024-03-01T00:00:00Z</updated></entry></feed>'))
    body = F.when(k == 0, atom).when(k == 1, F.concat(F.lit("<!DOCTYPE rss>"), rss)).otherwise(rss)
    found = feeds.feed_items(table(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id", "body")
    stamp = F.coalesce(scalar.mail_time(F.col("published")), scalar.instant(F.col("published")))
    return found.select("page_id", "native_id", "title", "url", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("published"), "problem")


def s20_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch with repeats and with keys that the store has already adds to it, and under which numbers."""
    rows = roles.log(spark, sf_dir).select("seq", "subject", "k")
    store = rows.filter("seq <= 3000").select("seq", "subject", "k")
    batch = rows.filter("seq > 2000").select(F.col("seq").alias("at"), "subject", "k")
    return ingest.appended(store, batch, ["subject", "k"], "at").select("seq", "at", "subject", "k")


def s25_torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by source, three of them torn: what is kept of each and what is lost."""
    torn = F.col("seq").isin(700, 1_500, 2_500, 2_600)
    rows = roles.log(spark, sf_dir).select(F.col("source_id").alias("file"), F.col("seq").alias("no"), F.when(torn, "{").otherwise("{}").alias("line"), F.when(torn, "TORN_OR_INVALID").alias("problem"))
    return ingest.committed_prefix(rows)[1].select("file", "n_kept", "n_lost")


def _field(name: str, kind: str = "string", required: bool = False, form: str | None = None, enum: list[str] | None = None) -> tuple:
    return name, kind, required, form, enum


_SCHEMAS = [
    ("orders", "1", "rows", [_field("id", required=True), _field("amount", "number", True), _field("to"), _field("kind", enum=["a", "b"]), _field("seen", form="iso-datetime")], ["0"], True),
    ("orders", "2", "rows", [_field("id", required=True)], [], False),
    ("places", "1", "geojson", [_field("id", required=True), _field("to")], [], True),
    ("notes", "1", "document", [_field("id", required=True), _field("said", required=True), _field("n", "integer"), _field("sum", form="sha256")], [], True),
]


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payloads of three feeds: other and unknown versions, fields that are missing, nested, null, mistyped or
    undeclared, shapes and geometries that are wrong, torn texts, units without an id."""
    key, k = F.col("o_orderkey"), F.col("o_orderkey") % 20
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    cust = F.when(k == 9, "").otherwise(F.col("o_custkey").cast("string"))
    row = say('{"id":"', cust, '","amount":', F.col("o_totalprice"), ',"to":"', F.col("o_orderpriority"), '"}')
    short = say('{"id":"', cust, '"}')
    place = lambda lon, rest: say('{"geometry":{"type":"Point","coordinates":[', lon, ',2]},"properties":', rest, "}")
    body = (
        F.when(k == 0, say('{"rows":[', row, ",", row, "]}")).when(k == 1, say('{"schema_version":"2","rows":[', short, "]}")).when(k == 2, say('{"schema_version":"0","rows":[', row, "]}"))
        .when(k == 3, say('{"schema_version":"7","rows":[', row, "]}")).when(k == 4, say('{"rows":[', row, ",", short, "]}")).when(k == 5, say('{"row":', row, "}"))
        .when(k == 6, say('{"type":"FeatureCollection","features":[', place("1", say('{"id":"', cust, '","to":"sea"}')), "]}"))
        .when(k == 7, say('{"type":"Other"}')).when(k == 8, say('{"id":"', cust, '","said":"x"}')).when(k == 9, say('{"rows":[', row, "]}")).when(k == 10, say('{"id":"', cust, '"')).when(k == 11, say('{"id":"', cust, '","to":"sky"}'))
        .when(k == 12, say('{"note":{"id":"', cust, '","said":"y"}}')).when(k == 13, say('{"id":null,"said":"x","n":1.5}')).when(k == 14, say('{"id":', key, ',"said":["x"],"n":', key, ',"sum":"ab"}'))
        .when(k == 15, say('{"rows":[{"id":"a","amount":"12"},7,{"id":"b","amount":1,"kind":"odd","seen":"2024-01-01T00:00:00"},{"id":"c","amount":2,"kind":"b","seen":"2024-01-01T00:00:00Z","more":true}]}'))
        .when(k == 16, say('{"type":"FeatureCollection","features":[', place("200", F.lit('{"id":"p"}')), ",[],", place("3", F.lit("null")), "]}"))
        .when(k == 17, "[1]").when(k == 18, say('{"id":"', cust, '","said":"z","n":true,"sum":"', F.sha2(key.cast("string"), 256), '","schema_version":""}')).otherwise(F.lit(None))
    )
    feed = F.when(k.isin(6, 7, 16), "places").when(k.isin(8, 10, 11, 12, 13, 14, 17, 18), "notes").otherwise("orders")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    orders = dealt(orders, orders.count(), each=20_000)  # work of a row is heavy, and a file may have few splits
    return orders.select(key.alias("payload_id"), feed.alias("schema_id"), body.alias("body"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.payload_status(_payloads(spark, sf_dir), spark.createDataFrame(_SCHEMAS, schemas.SCHEMA))


def p02_payload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("payload_id", "effective", "status", F.array_join("reasons", "; ").alias("reasons"), F.array_join("warnings", "; ").alias("warnings"))


def r04_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quarantine holds: payloads by feed, verdict and first reason."""
    bad = _judged(spark, sf_dir).filter("status <> 'VALID'")
    return bad.groupBy("schema_id", "status", F.get("reasons", F.lit(0)).alias("reason")).agg(F.count("*").alias("n"))


def p05_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.units(_judged(spark, sf_dir).filter("status = 'VALID'")).select("payload_id", "pos", "unit")


def _made(spark: SparkSession, sf_dir: str, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = roles.objects(spark, sf_dir).filter("object_id % 10 = 0").select(F.concat(F.lit("obj-"), "object_id").alias("object_id"), "version")
    rows = ingest.units(judged.filter("status = 'VALID'"))
    return ingest.versioned(rows, F.try_variant_get(F.parse_json("unit"), "$.id", "string"), "obj-", known)


def q04_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed to objects: each valid payload's units as versions of objects, with the transformation that made them."""
    made, _ = _made(spark, sf_dir, _judged(spark, sf_dir))
    return made.select("object_id", "version", "payload_id", "pos", "transformation_id")


def q04_ingest_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _made(spark, sf_dir, _judged(spark, sf_dir))
    target = F.concat(F.lit("place-"), F.try_variant_get(F.parse_json("unit"), "$.to", "string"))
    return ingest.relationships(made, "REPORTS_ON", target).select("relationship_id", "source_object_id", "target_object_id", "evidence_ref", "version")


def q04_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's receipt: payloads by verdict, units made and skipped."""
    judged = saved(_judged(spark, sf_dir), "judged")
    made, skipped = _made(spark, sf_dir, judged)
    verdicts = judged.groupBy(F.col("status").alias("measure")).agg(F.count("*").alias("n"))
    count = lambda df, name: df.agg(F.lit(name).alias("measure"), F.count("*").alias("n"))
    return ingest.any_of(verdicts, count(made, "units made"), count(skipped, "units skipped"))


def r03_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two batches, the second delivered twice: every row once, repeats of keys marked."""
    rows, seen = roles.log(spark, sf_dir).select("seq", "subject", "k"), _folder(spark, "seen") + "/rows"
    apply = live.ingest_batch(seen, ["subject", "k"])
    for batch_id, part in ((0, "seq <= 5000"), (1, "seq > 5000"), (1, "seq > 5000")):
        apply(rows.filter(part), batch_id)
    return spark.read.parquet(seen).select("seq", "duplicate")


def r12_bounded_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects by failures in a row, and whether the bound of five ends their retries."""
    attempts = roles.log(spark, sf_dir).select("subject", "seq", (F.col("value") >= 90).alias("ok"))
    return log.failure_streaks(attempts, "subject").select("subject", "streak", (F.col("streak") >= 5).alias("stopped"))


def q35_version_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes to customers' records at the version they saw."""
    current = roles.objects(spark, sf_dir).groupBy(F.col("object_id").alias("target_id")).agg(F.max("version").alias("version"))
    rows = roles.log(spark, sf_dir).select(F.col("seq").alias("command_id"), (F.col("subject") * 2).alias("target_id"), (F.col("k") % 30).alias("expected"))
    return ingest.version_commands(rows, current)


def x6_transitions_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of orders, delivered again: each is recorded once, and not at all if it was before."""
    orders = table(spark, sf_dir, "orders").select(F.lit("customer").alias("subject_kind"), F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderstatus").alias("transition_type"), F.col("o_orderpriority").alias("caused_by"), "o_orderkey")
    earlier = ingest.once(orders.filter(f"o_orderkey <= {CUT}"), spark.createDataFrame([], "transition_id string"))
    return ingest.once(orders, earlier).select("transition_id", "subject_id", "transition_type", "caused_by")


_P = r""", p AS (SELECT o_orderkey AS payload_id, o_orderkey % 20 AS k, CASE WHEN k IN (6, 7, 16) THEN 'places' WHEN k IN (8, 10, 11, 12, 13, 14, 17, 18) THEN 'notes' ELSE 'orders' END AS schema_id,
    CASE WHEN k = 9 THEN '' ELSE o_custkey::VARCHAR END AS cust, o_totalprice, o_orderpriority, '{"id":"' || cust || '","amount":' || o_totalprice || ',"to":"' || o_orderpriority || '"}' AS r FROM orders),
  b AS (SELECT *, CASE k WHEN 0 THEN '{"rows":[' || r || ',' || r || ']}' WHEN 1 THEN '{"schema_version":"2","rows":[{"id":"' || cust || '"}]}' WHEN 2 THEN '{"schema_version":"0","rows":[' || r || ']}' WHEN 3 THEN '{"schema_version":"7","rows":[' || r || ']}'
    WHEN 4 THEN '{"rows":[' || r || ',{"id":"' || cust || '"}]}' WHEN 5 THEN '{"row":' || r || '}' WHEN 6 THEN '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"id":"' || cust || '","to":"sea"}}]}'
    WHEN 7 THEN '{"type":"Other"}' WHEN 8 THEN '{"id":"' || cust || '","said":"x"}' WHEN 9 THEN '{"rows":[' || r || ']}' WHEN 10 THEN '{"id":"' || cust || '"' WHEN 11 THEN '{"id":"' || cust || '","to":"sky"}' WHEN 12 THEN '{"note":{"id":"' || cust || '","said":"y"}}'
    WHEN 13 THEN '{"id":null,"said":"x","n":1.5}' WHEN 14 THEN '{"id":' || payload_id || ',"said":["x"],"n":' || payload_id || ',"sum":"ab"}'
    WHEN 15 THEN '{"rows":[{"id":"a","amount":"12"},7,{"id":"b","amount":1,"kind":"odd","seen":"2024-01-01T00:00:00"},{"id":"c","amount":2,"kind":"b","seen":"2024-01-01T00:00:00Z","more":true}]}'
    WHEN 16 THEN '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[200,2]},"properties":{"id":"p"}},[],{"geometry":{"type":"Point","coordinates":[3,2]},"properties":null}]}'
    WHEN 17 THEN '[1]' WHEN 18 THEN '{"id":"' || cust || '","said":"z","n":true,"sum":"' || sha256(payload_id::VARCHAR) || '","schema_version":""}' END AS body FROM p),
  s(schema_id, version, kind, compatible) AS (VALUES ('orders', '1', 'rows', '0'), ('orders', '2', 'rows', ''), ('places', '1', 'geojson', ''), ('notes', '1', 'document', '')),
  f(schema_id, version, no, name, type, required, form, enum) AS (VALUES ('orders', '1', 1, 'id', 'string', true, '', NULL), ('orders', '1', 2, 'amount', 'number', true, '', NULL), ('orders', '1', 3, 'to', 'string', false, '', NULL), ('orders', '1', 4, 'kind', 'string', false, '', ['a', 'b']),
    ('orders', '1', 5, 'seen', 'string', false, 'iso-datetime', NULL), ('orders', '2', 1, 'id', 'string', true, '', NULL), ('places', '1', 1, 'id', 'string', true, '', NULL), ('places', '1', 2, 'to', 'string', false, '', NULL),
    ('notes', '1', 1, 'id', 'string', true, '', NULL), ('notes', '1', 2, 'said', 'string', true, '', NULL), ('notes', '1', 3, 'n', 'integer', false, '', NULL), ('notes', '1', 4, 'sum', 'string', false, 'sha256', NULL)),
  v AS (SELECT b.*, CASE WHEN json_valid(body) THEN body::JSON END AS doc, coalesce(nullif(doc->>'$.schema_version', ''), '1') AS declared FROM b),
  w AS (SELECT v.*, coalesce(x.version, c.version) AS version, coalesce(x.kind, c.kind) AS kind, coalesce(x.version, c.version, declared) AS effective FROM v
    LEFT JOIN s x ON x.schema_id = v.schema_id AND x.version = declared LEFT JOIN s c ON c.schema_id = v.schema_id AND c.version = '1' AND c.compatible = declared AND x.version IS NULL),
  h AS (SELECT *, CASE WHEN kind IS NULL THEN 'schema version not registered' WHEN doc IS NULL THEN 'payload is no JSON' WHEN kind = 'rows' AND json_type(doc, '$.rows') IS DISTINCT FROM 'ARRAY' THEN 'payload must contain rows'
    WHEN kind = 'geojson' AND (doc->>'$.type') IS DISTINCT FROM 'FeatureCollection' THEN 'payload must be a GeoJSON FeatureCollection' WHEN kind = 'document' AND json_type(doc) <> 'OBJECT' THEN 'payload must be an object' END AS shape FROM w),
  lists AS (SELECT payload_id, schema_id, version, kind, CASE kind WHEN 'rows' THEN json_extract(doc, '$.rows[*]') WHEN 'geojson' THEN json_extract(doc, '$.features[*]') ELSE [doc] END AS l FROM h WHERE shape IS NULL),
  parts AS (SELECT payload_id, schema_id, version, kind, unnest(l) AS part, generate_subscripts(l, 1) - 1 AS i FROM lists),
  d AS (SELECT *, CASE WHEN kind = 'geojson' AND json_type(part) = 'OBJECT' THEN CASE WHEN coalesce(json_type(part, '$.properties'), 'NULL') = 'NULL' THEN '{}'::JSON ELSE json_extract(part, '$.properties') END ELSE part END AS own,
    CASE kind WHEN 'rows' THEN 'row ' || i || ': ' WHEN 'geojson' THEN 'feature ' || i || ': ' ELSE '' END AS place FROM parts),
  t AS (SELECT *, json_type(own, '$.' || name) AS found, own->>('$.' || name) AS x FROM d JOIN f USING (schema_id, version) WHERE json_type(part) = 'OBJECT'),
  ok AS (SELECT *, CASE type WHEN 'string' THEN found = 'VARCHAR' WHEN 'number' THEN found IN ('BIGINT', 'UBIGINT', 'DOUBLE') ELSE found IN ('BIGINT', 'UBIGINT') END AS fits FROM t),
  e AS (SELECT payload_id, i, 0 AS no, place || CASE kind WHEN 'geojson' THEN 'feature is not an object' ELSE 'payload is not an object' END AS said FROM d WHERE json_type(part) <> 'OBJECT'
    UNION ALL SELECT payload_id, i, 0, place || 'invalid geometry' FROM d WHERE kind = 'geojson' AND json_type(part) = 'OBJECT' AND NOT CAST(part->>'$.geometry.coordinates[0]' AS DOUBLE) BETWEEN -180 AND 180
    UNION ALL SELECT payload_id, i, no, place || name || ': required field missing' FROM ok WHERE required AND coalesce(found, 'NULL') = 'NULL'
    UNION ALL SELECT payload_id, i, no, place || name || CASE WHEN NOT fits THEN ': expected ' || type WHEN form = 'iso-datetime' THEN ': not a timezone-aware ISO datetime' WHEN form = 'sha256' THEN ': not a sha256' ELSE ': ''' || x || ''' not in enum' END
      FROM ok WHERE found <> 'NULL' AND (NOT fits OR form = 'iso-datetime' AND NOT regexp_matches(x, '(Z|[+-]\d\d:?\d\d)$') OR form = 'sha256' AND length(x) <> 64 OR enum IS NOT NULL AND NOT list_contains(enum, x))),
  keyed AS (SELECT payload_id, schema_id, version, i, place, unnest(json_keys(own)) AS key FROM d WHERE json_type(part) = 'OBJECT' AND json_type(own) = 'OBJECT'),
  g AS (SELECT payload_id, i, place || 'undeclared field present: ' || key AS said, key FROM keyed n WHERE key <> 'schema_version' AND NOT EXISTS (SELECT 1 FROM f WHERE f.schema_id = n.schema_id AND f.version = n.version AND f.name = n.key)),
  j AS (SELECT h.payload_id, k, schema_id, cust, o_totalprice, o_orderpriority, effective, CASE WHEN kind IS NULL THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN shape IS NOT NULL OR ee.reasons IS NOT NULL THEN 'INVALID' ELSE 'VALID' END AS status,
    coalesce(shape, ee.reasons, '') AS reasons, coalesce(gg.warnings, '') AS warnings, coalesce(shape, ee.one, '') AS one FROM h LEFT JOIN (SELECT payload_id, string_agg(said, '; ' ORDER BY i, no) AS reasons, arg_min(said, i * 100 + no) AS one FROM e GROUP BY 1) ee USING (payload_id)
    LEFT JOIN (SELECT payload_id, string_agg(said, '; ' ORDER BY i, key) AS warnings FROM g GROUP BY 1) gg USING (payload_id)),
  u AS (SELECT payload_id, CAST(unnest(CASE WHEN k = 0 THEN [0, 1] ELSE [0] END) AS INT) AS pos, k, cust, o_orderpriority FROM j WHERE status = 'VALID'),
  m AS (SELECT *, 'obj-' || cust AS object_id FROM u WHERE cust <> ''),
  o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 10 = 0 GROUP BY 1),
  made AS (SELECT *, coalesce(n, 0) + row_number() OVER (PARTITION BY object_id ORDER BY payload_id, pos) AS version, 'tf-' || left(sha256(payload_id || '|' || cust), 24) AS transformation_id FROM m LEFT JOIN o ON o_custkey::VARCHAR = cust) """
_P = "WITH" + _P[1:]

SQL = {
    "s01_log_framing": "SELECT CASE event_id % 10 WHEN 3 THEN 'EMPTY_LINE' WHEN 5 THEN 'CARRIAGE_RETURN' WHEN 7 THEN 'TORN_OR_INVALID' ELSE 'NONE' END AS problem, count(*) AS n FROM events GROUP BY 1",
    "s02_tail": duck(
        """SELECT CASE WHEN seq % 13 <> 5 THEN seq END AS seq, CASE WHEN seq % 13 <> 5 THEN source_id END AS source_id, CASE WHEN seq % 13 = 5 THEN 'INVALID_JSON' END AS problem,
        CASE WHEN seq % 13 = 5 THEN left(source_id, 2) END AS line, CAST(CASE WHEN seq <= 4000 THEN 1 ELSE 2 END AS INT) AS read FROM log""", "log"),
    "s06_json_documents": """SELECT event_id, CASE WHEN event_id % 4 > 0 THEN '{"a":{"b":[2],"y":1},"z":' || user_id || '}' END AS document, CASE WHEN event_id % 4 = 0 THEN 'NOT_AN_OBJECT' END AS problem FROM events""",
    "s07_csv_feed": """SELECT CASE WHEN k > 1 THEN o_orderkey END AS key, CASE WHEN k NOT IN (0, 1, 4, 6) THEN 2.5::DOUBLE END AS price, CASE WHEN k > 1 THEN k > 5 END AS flag,
        CASE WHEN k <= 1 THEN 'WIDTH' WHEN k = 4 THEN 'price' ELSE '' END AS problem FROM (SELECT o_orderkey, o_orderkey % 10 AS k FROM orders)""",
    "s08_geojson_feed": "SELECT vec_id, ['Point', 'Polygon', 'Polygon', 'LineString', 'Point'][vec_id % 5 + 1] AS kind, ['OUT_OF_BOUNDS', 'NONE', 'RING_NOT_CLOSED', 'OUT_OF_BOUNDS', 'NONE'][vec_id % 5 + 1] AS problem FROM embeddings",
    "s09_evidence_bundles": """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'a' || doc_id END AS assertion_id, ['NONE', 'source_object', 'source_object', 'document', 'assertion', 'INVALID'][doc_id % 6 + 1] AS problem FROM documents""",
    "s13_feed_items": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'e' WHEN page_id % 4 > 1 THEN 'g' END || page_id AS native_id, CASE page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN NULL ELSE 'T' END AS title, CASE WHEN page_id % 4 <> 1 THEN url END AS url,
        CASE page_id % 4 WHEN 0 THEN '2024-03-01 00:00:00' WHEN 1 THEN NULL ELSE '2024-01-02 02:04:05' END AS published, CASE WHEN page_id % 4 = 1 THEN 'DTD_REFUSED' END AS problem FROM pages
        UNION ALL SELECT page_id, NULL, 'no id', NULL, NULL, 'NO_NATIVE_ID' FROM pages WHERE page_id % 4 > 1""",
    "s20_append": duck(
        """, b AS (SELECT min(seq) AS "at", subject, k FROM log WHERE seq > 2000 GROUP BY subject, k), n AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.seq <= 3000 AND l.subject = b.subject AND l.k = b.k))
        SELECT least(3000, (SELECT max(seq) FROM log)) + row_number() OVER (ORDER BY "at") AS seq, "at", subject, k FROM n""", "log"),
    "s25_torn_tail": duck(
        """, t AS (SELECT source_id, min(seq) AS torn FROM log WHERE seq IN (700, 1500, 2500, 2600) GROUP BY 1)
        SELECT source_id AS file, count(*) FILTER (WHERE torn IS NULL OR seq < torn) AS n_kept, count(*) FILTER (WHERE seq >= torn) AS n_lost FROM log LEFT JOIN t USING (source_id) GROUP BY 1""", "log"),
    "p02_payload_status": f"{_P} SELECT payload_id, effective, status, reasons, warnings FROM j",
    "r04_quarantine": f"{_P} SELECT schema_id, status, one AS reason, count(*) AS n FROM j WHERE status <> 'VALID' GROUP BY ALL",
    "p05_units": f"""{_P} SELECT payload_id, pos, CASE k WHEN 1 THEN '{{"id":"' || cust || '"}}' WHEN 6 THEN '{{"id":"' || cust || '","to":"sea","__geometry":{{"type":"Point","coordinates":[1,2]}}}}' WHEN 8 THEN '{{"id":"' || cust || '","said":"x"}}'
        ELSE '{{"id":"' || cust || '","amount":' || (SELECT o_totalprice FROM orders WHERE o_orderkey = payload_id) || ',"to":"' || o_orderpriority || '"}}' END AS unit FROM u""",
    "q04_ingest": f"{_P} SELECT object_id, version, payload_id, pos, transformation_id FROM made",
    "q04_ingest_relationships": f"""{_P}, r AS (SELECT object_id, 'place-' || CASE WHEN k = 6 THEN 'sea' ELSE o_orderpriority END AS t, payload_id, pos FROM made WHERE k NOT IN (1, 8))
        SELECT 'rel-' || left(sha256('REPORTS_ON|' || object_id || '|' || t), 24) AS relationship_id, object_id AS source_object_id, t AS target_object_id, payload_id AS evidence_ref, row_number() OVER (PARTITION BY object_id, t ORDER BY payload_id, pos) AS version FROM r""",
    "q04_ingest_counts": f"{_P} SELECT status AS measure, count(*) AS n FROM j GROUP BY 1 UNION ALL SELECT 'units made', count(*) FROM made UNION ALL SELECT 'units skipped', count(*) FROM u WHERE cust = ''",
    "r03_exactly_once": duck("SELECT seq, seq > min(seq) OVER (PARTITION BY subject, k) AS duplicate FROM log", "log"),
    "r12_bounded_retry": duck("SELECT subject, streak, streak >= 5 AS stopped FROM (SELECT subject, count(*) FILTER (WHERE value < 90 AND seq > last) AS streak FROM log JOIN (SELECT subject, coalesce(max(seq) FILTER (WHERE value >= 90), -1) AS last FROM log GROUP BY 1) USING (subject) GROUP BY 1)", "log"),
    "q35_version_commands": duck(
        """, c AS (SELECT object_id, max(version) AS now FROM objects GROUP BY 1), m AS (SELECT seq AS command_id, subject * 2 AS t, k % 30 AS expected, now FROM log LEFT JOIN c ON object_id = subject * 2),
        v AS (SELECT command_id, now, CASE WHEN now IS NULL THEN 'NOT_FOUND' WHEN expected = now AND command_id = min(command_id) FILTER (WHERE expected = now) OVER (PARTITION BY t) THEN 'APPLIED' ELSE 'CONFLICT' END AS verdict FROM m)
        SELECT command_id, verdict, CASE WHEN verdict = 'APPLIED' THEN now + 1 END AS version FROM v""", "log", "objects"),
    "x6_transitions_once": f"""SELECT DISTINCT 'antrans-' || left(sha256('customer|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority), 24) AS transition_id, o_custkey::VARCHAR AS subject_id, o_orderstatus AS transition_type, o_orderpriority AS caused_by
        FROM orders WHERE (o_custkey, o_orderstatus, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderstatus, o_orderpriority) FROM orders WHERE o_orderkey <= {CUT})""",
}

QUERIES = {
    f.__name__: f
    for f in (
        s01_log_framing, s02_tail, s06_json_documents, s07_csv_feed, s08_geojson_feed, s09_evidence_bundles, s13_feed_items, s20_append, s25_torn_tail,
        p02_payload_status, r04_quarantine, p05_units, q04_ingest, q04_ingest_relationships, q04_ingest_counts, r03_exactly_once, r12_bounded_retry,
        q35_version_commands, x6_transitions_once,
    )
}
