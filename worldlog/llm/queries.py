"""The queries of the language-model operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, filter_audit, fingerprint, html, licenses, manifest, minhash, packing, pii, substring, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(_table(spark, sf_dir, "documents")).drop("kept_text")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.corpus_counts(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"), mask=False)
    counts = [
        F.expr(f"cast(size(filter(pii_spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
        for kind in pii.BASE_KINDS
    ]
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.digest(base), 256).alias("base_sha256"),
        pii.digest(F.col("pii_spans")).alias("spans"),
        F.aggregate("pii_spans", F.lit(0.0), lambda most, s: F.greatest(most, s["score"])).alias("top_score"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.audited(_table(spark, sf_dir, "documents"), {"n_chars": F.when(tampered, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP1_SQL = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM said),
each AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM sets LEFT JOIN least ON x = doc_id
"""

OP4_SQL = r"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
chain AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS n FROM rows WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
texts AS MATERIALIZED (SELECT doc_id, t, n, left(t, length(t) - length(t) // 2) || left(n, length(t) // 2) AS e FROM chain),
every AS (SELECT DISTINCT unnest([t, e]) AS x FROM texts),
marked AS (SELECT x, regexp_replace(array_to_string(list_transform(regexp_extract_all(x, '(?:[ \t\x0B\f\r]*[^ \t\n\x0B\f\r]+[ \t\x0B\f\r]*){1,4}\n?|[ \t\x0B\f\r]*\n|[ \t\x0B\f\r]+'),
  lambda l: left(md5(l), 12) || CASE WHEN ends_with(l, chr(10)) THEN ';' ELSE ',' END), ''), '([01]);', '\1|', 'g') AS m FROM every),
prints AS MATERIALIZED (SELECT x, sha256(array_to_string(list_transform(string_split(m, '|'), lambda s: md5(array_to_string(list_transform(string_split(s, ';'), lambda p: md5(p)), ''))), '')) || ':' || m AS f,
  list_distinct(list_filter(regexp_split_to_array(m, '[,;|]'), lambda l: l <> '')) AS leaves, list_filter(regexp_split_to_array(m, '[;|]'), lambda l: l <> '') AS lines FROM marked)
SELECT doc_id, CAST(length(texts.t) AS BIGINT) AS n_chars, sha256(texts.e) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  2.0::DOUBLE * (len(list_intersect(a.leaves, b.leaves)) + CAST(texts.t = texts.e AS INT)) / (len(a.leaves) + len(b.leaves) + 2) AS near_edited,
  2.0::DOUBLE * (len(list_intersect(a.leaves, c.leaves)) + CAST(texts.t = texts.n AS INT)) / (len(a.leaves) + len(c.leaves) + 2) AS near_next,
  array_to_string(list_filter(list_transform(a.lines, lambda p, i: CASE WHEN list_contains(b.lines, p) THEN -1 ELSE i - 1 END), lambda i: i >= 0), ',') AS edited_paragraphs
FROM texts JOIN prints a ON a.x = texts.t JOIN prints b ON b.x = texts.e JOIN prints c ON c.x = texts.n
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS o, max(doc_id) AS x FROM n GROUP BY h HAVING o < x),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM n JOIN m USING (h) WHERE o < doc_id),
hit AS (SELECT doc_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM gone)),
cut AS (SELECT hit.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY hit.p) FILTER (WHERE gone.p IS NULL), '') AS kept FROM hit LEFT JOIN gone ON gone.doc_id = hit.doc_id AND gone.p = hit.p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, array_to_string(w, ' '))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""

OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS d FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(d, ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::BIGINT), 4294967295::BIGINT) AS c FROM bits WHERE doc_id IS NOT NULL),
said AS (SELECT d.doc_id, lang, coalesce(octet_length(encode(CAST(d.doc_id AS VARCHAR))) || ':' || d.doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
  n_chars, n_chars + CASE WHEN c % 7 = 0 THEN 1 ELSE 0 END AS m, coalesce(octet_length(encode(text)) || ':' || text, '-') AS z FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, c FROM crc) k ON d.doc_id = k.doc_id),
hashed AS (SELECT doc_id, lang, sha256(a || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf, sha256(a || coalesce(length(CAST(coalesce(m, n_chars) AS VARCHAR)) || ':' || coalesce(m, n_chars), '-') || z) AS seen FROM said),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
low AS (SELECT lang AS tree, 0 AS lvl, p, leaf AS h, n FROM leaves UNION ALL
  SELECT tree, lvl + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), any_value(n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, lvl, p // 2),
roots AS MATERIALIZED (SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS q, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, q, subroot AS h, n FROM roots UNION ALL
  SELECT lvl + 1, q // 2, sha256(string_agg(h, '' ORDER BY q)), any_value(n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, q // 2),
lows AS MATERIALIZED (SELECT * FROM low), highs AS MATERIALIZED (SELECT * FROM high),
steps AS (SELECT lang, p, unnest(range(0, height)) AS lvl FROM leaves JOIN roots ON lang IS NOT DISTINCT FROM tree),
beside AS (SELECT s.lang, s.p, s.lvl, coalesce(CASE WHEN (s.p >> s.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || h, 'N') AS x FROM steps s LEFT JOIN lows u ON s.lang IS NOT DISTINCT FROM u.tree AND u.lvl = s.lvl AND u.p = xor(s.p >> s.lvl, 1)),
inner_ AS (SELECT lang, p, list(x ORDER BY lvl) AS xs FROM beside GROUP BY lang, p),
top AS (SELECT tree, list(coalesce(CASE WHEN (s.q >> s.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || h, 'N') ORDER BY s.lvl) AS ys FROM
  (SELECT tree, q, unnest(range(0, (SELECT max(lvl) FROM highs))) AS lvl FROM roots) s LEFT JOIN highs u ON u.lvl = s.lvl AND u.q = xor(s.q >> s.lvl, 1) GROUP BY tree),
whole AS (SELECT doc_id, leaf, seen, subroot, (SELECT h FROM highs WHERE n = 1) AS root, list_concat(coalesce(xs, []), coalesce(ys, [])) AS path
  FROM leaves l JOIN roots r ON l.lang IS NOT DISTINCT FROM r.tree LEFT JOIN inner_ i ON i.lang IS NOT DISTINCT FROM l.lang AND i.p = l.p LEFT JOIN top t ON t.tree IS NOT DISTINCT FROM l.lang),
folded AS (SELECT *, list_reduce(path, lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END), seen) AS f FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, f AS folded_root, f = root AS verified FROM folded
"""

OP13_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
said AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(split.doc_id > least, false) AS INT) AS m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM split LEFT JOIN said ON split.doc_id = said.doc_id),
counts AS MATERIALIZED (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, m),
orders AS (SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
steps AS (SELECT o, s AS step, 1 << CAST(ascii(o[s]) - 65 AS INT) AS f, list_sum([1 << CAST(ascii(o[i]) - 65 AS INT) FOR i IN range(1, s)]) AS e FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders WHERE length(o) = 5)),
found AS (SELECT part, o AS filter_order, step, f,
  sum(n) FILTER (WHERE m & CAST(coalesce(e, 0) AS INT) = 0 AND m & f = 0) AS kept, sum(n) FILTER (WHERE m & CAST(coalesce(e, 0) AS INT) = 0 AND m & f > 0) AS removed,
  sum(n) FILTER (WHERE m & CAST(coalesce(e, 0) AS INT) > 0 AND m & f > 0) AS redundant, sum(n) FILTER (WHERE m = f) AS unique_fails,
  sum(good) FILTER (WHERE m & CAST(coalesce(e, 0) AS INT) = 0 AND m & f > 0) AS good_lost, sum(toxic) FILTER (WHERE m & CAST(coalesce(e, 0) AS INT) = 0 AND m & f > 0) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM found
"""

QUERIES = {f.__name__: f for f in (op1_minhash, op2_toxicity, op3_packing, op4_fingerprint, op5_licenses, op6_substring, op7_html, op8_decontam, op9_token_counts, op10_pii, op11_bpe, op12_manifest, op13_filter_audit)}
ORACLE_SQL = {"op1_minhash": OP1_SQL, "op4_fingerprint": OP4_SQL, "op6_substring": OP6_SQL, "op12_manifest": OP12_SQL, "op13_filter_audit": OP13_SQL}
