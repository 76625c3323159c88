"""Feeds as DataFrames: JSON documents, CSV rows, GeoJSON features, RSS and Atom items, HTML blocks, log segments.

Every reader keeps what it cannot read, with the reason, in place of raising: one bad payload stops no load.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements whose text is not shown, and those that begin a block.
HIDDEN = frozenset(("script", "style", "noscript", "template"))
LABELLED = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "blockquote", "pre", "title"))
BREAKING = frozenset(("div", "section", "article", "tr", "table", "ul", "ol", "header", "footer", "main", "body"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, problem of a folder of log segments: empty lines and carriage returns are named, not dropped."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    problem = F.when(F.contains("line", F.lit("\r")), "CARRIAGE_RETURN").when(F.trim("line") == "", "EMPTY_LINE").when(F.try_parse_json("line").isNull(), "TORN_OR_INVALID")
    return lines.withColumn("problem", problem)


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The readable entries of a log's segments as rows of ``schema``."""
    good = log_lines(spark, path).filter("problem IS NULL")
    return good.select("file", F.from_json("line", schema).alias("e")).select("file", "e.*")


def without_lone_surrogates(text: Column) -> Column:
    """JSON text in which escapes of either half of a pair, alone, are the escape of U+FFFD; escaped backslashes are no escapes."""
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    even = r"(?<!\\)((?:\\\\)*)"
    # pairs are set aside as they are, then what is left of either half is alone
    return F.regexp_replace(F.regexp_replace(text, f"{even}{high}(?!{low})", r"$1\\ufffd"), rf"(?<!\\u[dD][89abAB][0-9a-fA-F]{{2}})(?<!\\)((?:\\\\)*){low}", r"$1\\ufffd")


#: How many containers may stand around a value, as everywhere in the log.
MOST_DEPTH = 256


def _deepest(text: Column) -> Column:
    """How many containers stand around the value that most stand around; only texts with many brackets are looked through."""
    plain = F.regexp_replace(F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "v"), r"[^\[\]{}v:,\s]++", "v")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now, most = acc["now"], F.greatest(acc["most"], acc["now"])
        moved = F.when(c.isin("[", "{"), now + 1).when(c.isin("]", "}"), now - 1).otherwise(now)
        return F.struct(moved.alias("now"), F.when(c.isin("[", "{", "v"), most).otherwise(acc["most"]).alias("most"))

    return F.when(F.regexp_count(text, F.lit(r"[\[{]")) > MOST_DEPTH, F.aggregate(F.split(plain, ""), start, step)["most"]).otherwise(0)


def strict_json(text: Column) -> Column:
    """The problem of a text that must be one JSON object: INVALID (torn, repeated keys, NaN), TOO_DEEP (a value within more than
    ``MOST_DEPTH`` containers), LONE_SURROGATE (no text can hold it), NOT_FINITE (a number beyond all), NOT_AN_OBJECT."""
    value = F.try_parse_json(text)
    # 1e999 parses, but no reader could tell it from infinity
    huge = text.rlike(r"[:\[,]\s*-?\d+(\.\d+)?[eE]\+?(30[9]|3[1-9]\d|[4-9]\d\d|\d{4,})")
    return (
        F.when(value.isNull(), "INVALID").when(_deepest(text) > MOST_DEPTH, "TOO_DEEP").when(without_lone_surrogates(text) != text, "LONE_SURROGATE").when(huge, "NOT_FINITE")
        .when(~F.schema_of_variant(value).startswith("OBJECT"), "NOT_AN_OBJECT")
    )


def _depth(text: str) -> int:
    """How deep a JSON text nests, by its brackets outside of strings."""
    depth = most = 0
    for mark in _BRACKETS.findall(text):
        if mark in "[{":
            depth += 1
            most = max(most, depth)
        elif mark in "]}":
            depth -= 1
    return most


_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def _leaves(text: str) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(path, value, problem) of a text's leaves, or one row with the problem."""
    try:
        if _depth(text) > MOST_DEPTH:
            yield None, None, "TOO_DEEP"
            return
        stack = [("$", json.loads(text, parse_int=str, parse_float=str, object_pairs_hook=_once))]
    except ValueError:
        yield None, None, "INVALID"
        return
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack += [(f"{path}.{k}", node[k]) for k in sorted(node, reverse=True)]
        elif isinstance(node, list):
            stack += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(node)))]
        else:
            yield path, "" if node is None else str(node).lower() if isinstance(node, bool) else node, None


def json_leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value, problem: every leaf of a JSON column, ``$.a[0].b`` paths, keys in their order; a text that is not read
    has one row with its problem, INVALID (torn, repeated keys) or TOO_DEEP (beyond ``MOST_DEPTH``).

    Numbers keep their spelling, null is an empty value, empty objects and arrays have no leaf, null texts no row. A text
    is walked once, in one pass over the rows.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *leaf) for i, x in enumerate(batch.column(1)) if x.is_valid for leaf in _leaves(x.as_py())]
            at, *columns = ([r[i] for r in found] for i in range(4))
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.string()) for c in columns)], names=[key, "path", "value", "problem"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(column).cast("string")).mapInArrow(walk, f"{key} {kind}, path string, value string, problem string")


def json_fields(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, value of every leaf of a JSON column; ``json_leaves`` names the texts that have none since they are not read."""
    return json_leaves(rows, key, column).filter("problem IS NULL").drop("problem")


def json_named(rows: DataFrame, key: str, column: str, names: list[str]) -> DataFrame:
    """key, leaves (name, over, value): of each JSON text that is read the leaves that stand under one of ``names``, in one row;
    ``over`` is the path of the object that holds them. Empty values and texts without such leaves have none."""
    asked = frozenset(names)
    leaf = pa.struct([("name", pa.string()), ("over", pa.string()), ("value", pa.string())])

    def of(text: str) -> list[dict]:
        found = []
        for path, value, problem in _leaves(text):
            if problem or not value:
                continue
            over, _, name = _INDICES.sub("", path).rpartition(".")
            if name in asked:
                found.append({"name": name, "over": over, "value": value})
        return found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(x.as_py()) if x.is_valid else [] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(leaf))], names=[key, "leaves"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(column).cast("string")).mapInArrow(walk, f"{key} {kind}, leaves array<struct<name:string,over:string,value:string>>")


_INDICES = re.compile(r"(\[\d+\])+$")


def json_documents(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, document (keys in order, no white space) of bodies that must be one object each, and the problem of the others."""
    problem = strict_json(F.col(column))
    return rows.select(key, F.when(problem.isNull(), F.to_json(F.try_parse_json(column))).alias("document"), problem.alias("problem"))


def evidence_bundles(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, assertion_id, problem (NONE, INVALID, or the part that is wanting) of evidence bundles."""
    schema = "source_object struct<source_object_id:string,content_sha256:string>, document struct<document_id:string>, assertion struct<assertion_id:string>"
    read = rows.select(key, strict_json(F.col(column)).alias("_p"), F.from_json(column, schema).alias("b"))
    has = lambda *names: F.coalesce(F.greatest(*[F.length(f"b.{n}") for n in names], F.lit(0)) > 0, F.lit(False)) if len(names) == 1 else has(names[0]) & has(*names[1:])
    problem = (
        F.when(F.col("_p").isNotNull(), "INVALID")
        .when(~has("source_object.source_object_id", "source_object.content_sha256"), "source_object")
        .when(~has("document.document_id"), "document")
        .when(~has("assertion.assertion_id"), "assertion")
        .otherwise("NONE")
    )
    return read.select(key, F.when(problem == "NONE", F.col("b.assertion.assertion_id")).alias("assertion_id"), problem.alias("problem"))


def csv_feed(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """The fields of CSV files, typed, with ``problem``: WIDTH of lines unlike the header, else the fields that are not of
    their type, else nothing. A header unlike ``fields`` is an error of the feed, which Spark raises."""
    names = ", ".join(f"`{n}` string" for n in fields)
    raw = spark.read.option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", "_line").schema(f"{names}, _line string").csv(path)
    kinds = {"number": "double", "integer": "long"}
    good, cast, bad = F.col("_line").isNull(), [], []
    for name, kind in fields.items():
        value = F.when(good, F.nullif(F.col(name), F.lit("")))
        typed = F.when(value.isNotNull(), F.lower(F.trim(value)).isin("true", "1", "yes")) if kind == "boolean" else value.try_cast(kinds.get(kind, "string"))
        cast.append(typed.alias(name))
        bad.append(F.when(value.isNotNull() & typed.isNull(), F.lit(name)))
    return raw.select(*cast, F.when(~good, "WIDTH").otherwise(F.concat_ws(",", *bad)).alias("problem"))


# Fixed values: ``Label: value.`` on one line (addresses are no values), and how many lines of a text the rule reads.
LABELLED_LINE = r"^\s*([A-Za-zÀ-ÿ][\w /()-]{2,48}):\s+(.{2,160}?)\s*\.?\s*$"
LINES_READ = 200


def labelled_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, attribute, value, start, end (code points of the value in the text) of the ``Label: value.`` lines of texts.

    The label in lower case, other characters as one underscore, is the attribute. The rule reads the first
    ``LINES_READ`` lines of a text: labels stand at its head. Where each line begins is summed up along the text once, and
    lines of another form go before they become rows.
    """
    none = F.array().cast("array<struct<line:string,base:int>>")
    begun = F.struct(F.lit(0).alias("at"), none.alias("lines"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.when(x.rlike(f"(?U){LABELLED_LINE}"), F.array_append(acc["lines"], F.struct(x.alias("line"), acc["at"].alias("base")))).otherwise(acc["lines"]).alias("lines"))
    heads = F.slice(F.split(text, "\n", LINES_READ + 1), 1, LINES_READ)
    lines = rows.select(key, F.inline(F.aggregate(heads, begun, step)["lines"])).withColumnsRenamed({"line": "_line", "base": "_base"})
    part = lambda i: F.regexp_extract("_line", f"(?U){LABELLED_LINE}", i)
    found = lines.select(key, part(1).alias("_label"), part(2).alias("_raw"), "_line", "_base")
    found = found.filter(~F.col("_raw").rlike("^(//|http)")).withColumn("value", F.trim("_raw"))
    place = F.length(F.regexp_extract("_line", r"(?U)^(\s*[A-Za-zÀ-ÿ][\w /()-]{2,48}:\s+)", 1))
    attribute = F.regexp_replace(F.regexp_replace(F.lower(F.trim("_label")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    start = F.col("_base") + place
    return found.select(key, attribute.alias("attribute"), "value", start.cast("long").alias("start"), (start + F.length("value")).cast("long").alias("end"))


def csv_rows(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of CSV files with a header, typed where the cast holds; ``bad_fields`` names what stayed text."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    kinds = {"number": "double", "integer": "long"}
    cast, bad = {}, []
    for name, kind in fields.items():
        value = F.nullif(F.col(name), F.lit(""))
        if kind == "boolean":  # anything else than these is false, never an error
            cast[name] = F.when(value.isNotNull(), F.lower(F.trim(value)).isin("true", "1", "yes"))
        else:
            cast[name] = value.try_cast(kinds.get(kind, "string"))
            bad.append(F.when(value.isNotNull() & cast[name].isNull(), F.lit(name)))
    return raw.select(*[c for c in raw.columns if c not in fields], *[c.alias(n) for n, c in cast.items()], F.array_compact(F.array(*bad) if bad else F.array().cast("array<string>")).alias("bad_fields"))


def geojson_features(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, kind, lon, lat, properties (JSON), problem of each feature of a FeatureCollection."""
    schema = "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:string>>"
    read = rows.select(key, F.from_json(column, schema).alias("g"))
    each = read.select(key, F.when(F.col("g.type").eqNullSafe("FeatureCollection"), F.lit(None)).otherwise("NOT_A_COLLECTION").alias("_p"), F.posexplode_outer("g.features").alias("pos", "f"))
    point = F.from_json("f.geometry.coordinates", "array<double>")
    lon, lat = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    kind, text = F.col("f.geometry.type"), "f.geometry.coordinates"
    rings = F.when(kind == "Polygon", F.from_json(text, "array<array<array<double>>>"))
    places = F.when(kind == "Point", F.array(point)).when(kind == "LineString", F.from_json(text, "array<array<double>>")).when(kind == "Polygon", F.flatten(rings))
    on_globe = lambda p: F.coalesce(F.get(p, F.lit(0)).between(-180, 180) & F.get(p, F.lit(1)).between(-90, 90), F.lit(False))
    closed = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1))
    bounds = F.when(~F.forall(places, on_globe), "OUT_OF_BOUNDS").when(~F.forall(rings, closed), "RING_NOT_CLOSED")
    return each.select(key, "pos", F.col("f.geometry.type").alias("kind"), lon.alias("lon"), lat.alias("lat"), F.col("f.properties").alias("properties"), F.coalesce("_p", bounds).alias("problem"))


def feed_items(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, native_id, title, url, published, problem of RSS items and Atom entries.

    Documents with a DTD are refused before they are parsed: one row, DTD_REFUSED. Items without an id are kept with
    NO_NATIVE_ID; a document without any item, null ones too, has one row, NO_ITEMS.
    """
    body = F.col(column)
    dtd = F.coalesce(body.rlike("(?i)<!DOCTYPE|<!ENTITY"), F.lit(False))
    rss = "channel struct<item:array<struct<guid:string,link:string,title:string,pubDate:string,description:string>>>"
    atom = "entry array<struct<id:string,title:string,updated:string,published:string,link:struct<_href:string>>>"
    text = lambda c: F.nullif(c, F.lit(""))
    shape = lambda native, title, url, published: F.struct(native.alias("native_id"), title.alias("title"), url.alias("url"), published.alias("published"))
    items = F.transform(F.from_xml(body, rss)["channel"]["item"], lambda i: shape(F.coalesce(text(i["guid"]), text(i["link"])), i["title"], i["link"], i["pubDate"]))
    entries = F.transform(F.from_xml(body, atom)["entry"], lambda e: shape(F.coalesce(text(e["id"]), text(e["link"]["_href"])), e["title"], e["link"]["_href"], F.coalesce(e["updated"], e["published"])))
    found = F.when(dtd, F.lit(None)).when(body.rlike(r"<feed[\s>]"), entries).otherwise(items)
    read = rows.select(key, dtd.alias("_dtd"), F.explode_outer(found).alias("i"))
    problem = F.when(F.col("_dtd"), "DTD_REFUSED").when(F.col("i").isNull(), "NO_ITEMS").when(F.col("i.native_id").isNull(), "NO_NATIVE_ID")
    return read.select(key, "i.*", problem.alias("problem"))


def detected_format(media_type: Column, head: Column) -> Column:
    """JSON, FEED, XML, HTML, PDF or TEXT by media type and the first characters."""
    media, start = F.lower(F.coalesce(media_type, F.lit(""))), F.ltrim(F.substring(F.coalesce(head, F.lit("")), 1, 2000))
    return (
        F.when(F.contains(media, F.lit("json")) | start.rlike(r"^[{\[]"), "JSON")
        .when(media.rlike("rss|atom") | (start.rlike(r"^<\?xml|^<(rss|feed)") & start.rlike(r"<(rss|feed)[\s>]")), "FEED")
        .when(start.rlike(r"(?i)^<!doctype html|<html[\s>]"), "HTML")
        .when(start.startswith("<?xml"), "XML")
        .when(start.startswith("%PDF-"), "PDF")
        .otherwise("TEXT")
    )


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.label, self.hidden, self.text = "body", 0, []

    def end_block(self, label: str) -> None:
        said = " ".join("".join(self.text).split())
        if said:
            self.found.append((self.label, said))
        self.text, self.label = [], label

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in LABELLED or tag in BREAKING:
            self.end_block(tag if tag in LABELLED else "body")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in LABELLED:
            self.end_block("body")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, blocks (label, text) of the visible text of ``html``: the standard library's parser, a batch at a time."""

    @F.pandas_udf("array<struct<label:string,text:string>>")
    def blocks(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in pages:
            out = []
            for html in some:
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                parser.end_block("body")
                out.append([{"label": a, "text": b} for a, b in parser.found])
            yield pd.Series(out)

    return pages.select("page_id", blocks("html").alias("blocks"))
