"""Queries over names, merged identities, themes, narratives and analogues, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worldlog.functions import scalar
from worldlog.operators import graph, names, world
from worldlog.roles import table

from .state import CUT

_CYRILLIC = "Жанна Щукина,Юрий Ёлкин,Їжак ЦЕХ,объезд Эхо,Љубав Ћук"
_GREEK = "Θεός ΨΥΧΗ,Ξένος,φίλος Χ"
_LATIN = "Zhanna Shchukina,Yuri Khan,xenia Wolf,chto SHA,Ça va Ñandú"


def f15_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under names in three scripts, with an alias and a label: the variants to search by."""
    k = F.col("c_custkey")
    pool = F.split(F.lit(f"{_CYRILLIC},{_GREEK},{_LATIN}"), ",")
    said = F.concat(F.get(pool, (k % 13).cast("int")), F.lit("  "), F.substring("c_name", 1, 1), k)
    alias = F.array(F.concat(F.lit("A "), "c_name"), F.upper(said))
    label = F.array(F.struct(F.lit("el").alias("language"), F.concat(F.lit("Ω"), k).alias("label")))
    customers = table(spark, sf_dir, "customer")
    customers = graph.dealt(customers, customers.count(), each=20_000)  # work of a row is heavy, and a file may have few splits
    rows = customers.select("c_custkey", F.when(k % 17 > 0, said).alias("name"), alias.alias("aliases"), label.alias("labels"))
    return names.name_variants(rows, "c_custkey", "name", "aliases", "labels", ["ru", "en"])


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are one entity where their texts are one, and where source, language and length are: stars on the least one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.concat_ws("/", "source", "lang", "n_chars").alias("shape"))
    star = lambda key: docs.join(docs.groupBy(key).agg(F.min("doc_id").alias("dst")), key).select(F.col("doc_id").alias("src"), "dst")
    return star("digest").union(star("shape"))


def q05_merged_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity links in two loads: what the second makes of the clusters of the first, and which of them are no more."""
    links = graph.saved(_links(spark, sf_dir), "links")
    first = graph.components(links.filter("(src + dst) % 3 > 0"))
    now, merged = graph.joined_components(first, links.filter("(src + dst) % 3 = 0"))
    return now.join(merged.withColumnRenamed("component", "_c").hint("merge"), now.node == merged.was, "left").select("node", "component", F.col("_c").isNotNull().alias("merged"))


def q18_theme_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as members of themes, by customer in one snapshot and by supplier of their first line in the next."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    before = orders.filter(f"o_orderkey <= {CUT}").select(F.concat(F.lit("t"), F.col("o_custkey") % 97).alias("theme_id"), F.col("o_orderkey").alias("member"))
    after = lines.groupBy(F.col("l_orderkey").alias("member")).agg(F.min("l_suppkey").alias("s"), F.max("l_partkey").alias("p"))
    after = after.select(F.concat(F.lit("u"), F.when(F.col("p") % 4 == 0, F.col("s") % 5).otherwise(F.col("member") % 211)).alias("theme_id"), "member")
    return world.theme_lineage(before, after)


def q19_propagation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifestations of what they state, each with the one before it of the same statement."""
    rows = table(spark, sf_dir, "documents").select(scalar.normal_statement(F.coalesce("text", F.lit(""))).alias("_s"), "doc_id", F.col("source").alias("family"), F.floor(F.col("doc_id") / 7).alias("at"))
    return world.propagation_forest(rows.withColumnRenamed("_s", "statement"))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes: suppliers as actors, what happened to the lines in their order as events."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.concat("l_returnflag", "l_linestatus", F.when(F.col("l_quantity") > 25, "+").otherwise("-"))
    by_line = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("actor"), F.min(kind).alias("event"))
    rows = by_line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "event", "actor"))).alias("x"))  # an order's lines, seven at most
    return rows.select("id", F.col("x.actor").alias("actors"), F.col("x.event").alias("events"))


def q24_ordered_analogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are like the first order of each of the 25 least customers in actors, kinds of event and their sequence."""
    firsts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("id")).orderBy("o_custkey").limit(25)
    episodes = _episodes(spark, sf_dir)
    return world.ordered_analogues(episodes.join(firsts.select("id"), "id", "left_semi"), episodes)


def _table_sql(table_: dict[str, str]) -> str:
    return "map([" + ", ".join(f"'{k}'" for k in table_) + "], [" + ", ".join(f"'{v}'" for v in table_.values()) + "])"


def _letters_sql(text: str, table_: dict[str, str]) -> str:
    m = f"{_table_sql(table_)}[lower(c)]"
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: coalesce(CASE WHEN c <> lower(c) THEN upper(left({m}, 1)) || {m}[2:] ELSE {m} END, c)), '')"


def _long_sql(text: str) -> str:
    for a, b in names.LATIN_LONG:
        text = f"replace(replace({text}, '{a}', '{b}'), '{a.capitalize()}', '{b.upper()}')"
    return text


_SCRIPT = """(SELECT CASE WHEN greatest(l, c, g, o) = l THEN 'Latn' WHEN greatest(c, g, o) = c THEN 'Cyrl' WHEN greatest(g, o) = g THEN 'Grek' ELSE 'other' END FROM
    (SELECT len(regexp_extract_all({0}, '\\p{{Latin}}')) AS l, len(regexp_extract_all({0}, '\\p{{Cyrillic}}')) AS c, len(regexp_extract_all({0}, '\\p{{Greek}}')) AS g, 0 AS o))"""

SQL = {
    "f15_name_variants": f"""WITH p AS (SELECT c_custkey, c_name, string_split('{_CYRILLIC},{_GREEK},{_LATIN}', ',')[c_custkey % 13 + 1] || '  ' || left(c_name, 1) || c_custkey AS n FROM customer WHERE c_custkey % 17 > 0),
        q AS (SELECT *, {_SCRIPT.format('n')} AS s, strip_accents(replace(n, 'Ё', 'Е')) AS f0 FROM p),
        r AS (SELECT *, translate(f0, 'ёйїЇЙ', 'еиіІИ') AS f FROM q),
        v AS (SELECT c_custkey, 1 AS i, 'EXACT_NAME' AS family, n AS value, 'ru' AS language, s AS script FROM r UNION ALL SELECT c_custkey, 2, 'QUOTED_PHRASE', '"' || n || '"', 'ru', s FROM r
          UNION ALL SELECT c_custkey, 3, 'ALIAS', 'A ' || c_name, '', 'Latn' FROM r UNION ALL SELECT c_custkey, 4, 'ALIAS', upper(n), '', {_SCRIPT.format('upper(n)')} FROM r
          UNION ALL SELECT c_custkey, 5, 'TRANSLITERATION', f, '', 'Latn' FROM r WHERE f <> n
          UNION ALL SELECT c_custkey, 6, 'TRANSLITERATION', CASE s WHEN 'Cyrl' THEN {_letters_sql('n', names.CYRILLIC_TO_LATIN)} WHEN 'Grek' THEN {_letters_sql('n', names.GREEK_TO_LATIN)} ELSE {_letters_sql(_long_sql('f'), names.LATIN_TO_CYRILLIC)} END, '', CASE s WHEN 'Latn' THEN 'Cyrl' ELSE 'Latn' END FROM r
          UNION ALL SELECT c_custkey, 7, 'LOCAL_LANGUAGE', 'Ω' || c_custkey, 'el', 'Grek' FROM r),
        t AS (SELECT c_custkey, i, family, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS value, language, script FROM v)
        SELECT c_custkey, family, value, language, script FROM t QUALIFY i = min(i) OVER (PARTITION BY c_custkey, replace(replace(lower(value), 'ς', 'σ'), 'ß', 'ss'))""",
    "q05_merged_identities": """WITH RECURSIVE d AS (SELECT doc_id, md5(text) AS g, concat_ws('/', source, lang, n_chars) AS s FROM documents),
        l AS MATERIALIZED (SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY g) AS dst FROM d UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY s) FROM d),
        u AS MATERIALIZED (SELECT src AS a, dst AS b, (src + dst) % 3 > 0 AS early FROM l UNION SELECT dst, src, (src + dst) % 3 > 0 FROM l),
        r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a), e AS (SELECT a, b FROM u WHERE early UNION SELECT e.a, u.b FROM e JOIN u ON e.b = u.a AND u.early),
        now AS (SELECT a AS node, min(b) AS component FROM r GROUP BY 1), was AS (SELECT a AS node, min(b) AS old FROM e GROUP BY 1)
        SELECT now.node, component, coalesce(old, now.node) = now.node AND component <> now.node AS merged FROM now LEFT JOIN was ON was.node = now.node""",
    "q18_theme_lineage": f"""WITH b AS (SELECT 't' || o_custkey % 97 AS old, o_orderkey AS m FROM orders WHERE o_orderkey <= {CUT}),
        a AS (SELECT 'u' || CASE WHEN max(l_partkey) % 4 = 0 THEN min(l_suppkey) % 5 ELSE l_orderkey % 211 END AS new, l_orderkey AS m FROM lineitem GROUP BY l_orderkey),
        s AS (SELECT old, new, count(*) AS shared FROM (SELECT DISTINCT old, m FROM b) JOIN a USING (m) GROUP BY 1, 2),
        h AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY shared DESC, new) = 1 AS heir FROM s),
        c AS (SELECT *, CASE WHEN heir THEN row_number() OVER (PARTITION BY new, heir ORDER BY shared DESC, old) END AS place FROM h)
        SELECT old, new, shared, CASE WHEN NOT heir THEN 'SPLIT_INTO' WHEN place = 1 THEN 'CONTINUED' ELSE 'MERGED_INTO' END AS kind FROM c
        UNION ALL SELECT DISTINCT old, NULL, 0, 'ENDED' FROM b WHERE old NOT IN (SELECT old FROM s) UNION ALL SELECT DISTINCT NULL, new, 0, 'BORN' FROM a WHERE new NOT IN (SELECT new FROM s)""",
    "q19_propagation_forest": r"""WITH n AS (SELECT doc_id, source, doc_id // 7 AS t, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'), ' .,;:!?"''«»“”') AS s FROM documents),
        p AS (SELECT *, lag(doc_id) OVER w AS parent, lag(source) OVER w AS ps, lag(t) OVER w AS pt FROM n WINDOW w AS (PARTITION BY s ORDER BY t, doc_id))
        SELECT doc_id, parent, CASE WHEN parent IS NULL THEN 'ORIGIN' WHEN ps = source THEN 'SAME_ORIGIN_FAMILY' WHEN len(string_split(s, ' ')) >= 6 AND pt < t THEN 'LIKELY_DERIVATIVE' ELSE 'UNRESOLVED' END AS relation FROM p""",
    "q24_ordered_analogues": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS actor, min(l_returnflag || l_linestatus || CASE WHEN l_quantity > 25 THEN '+' ELSE '-' END) AS event FROM lineitem GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT l_orderkey AS id, list(actor) AS actors, list(event ORDER BY l_linenumber) AS events FROM l GROUP BY 1),
        f AS (SELECT o_custkey, min(o_orderkey) AS id FROM orders GROUP BY 1 ORDER BY 1 LIMIT 25),
        p AS (SELECT a.id AS situation, b.id AS episode, list_has_any(a.actors, b.actors) AS who, list_intersect(a.events, b.events) AS k, a.events AS x, b.events AS y FROM e a JOIN f ON f.id = a.id, e b WHERE list_has_any(a.events, b.events)),
        m AS (SELECT situation, episode, who, len(list_distinct(k)) >= 2 AND list_filter(x, lambda t: list_contains(k, t)) = list_filter(y, lambda t: list_contains(k, t)) AS same FROM p)
        SELECT situation, episode, CASE WHEN who THEN 'ACTOR_CONFIGURATION,' ELSE '' END || 'EVENT_TYPE' || CASE WHEN same THEN ',TEMPORAL_SEQUENCE' ELSE '' END AS matched, 1 + CAST(who AS BIGINT) + CAST(same AS BIGINT) AS n_matched FROM m WHERE who OR same""",
}

QUERIES = {f.__name__: f for f in (f15_name_variants, q05_merged_identities, q18_theme_lineage, q19_propagation_forest, q24_ordered_analogues)}
