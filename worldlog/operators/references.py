"""References between records, taken from the schemas of their tables: one bridge for all families, and closures over it.

A field says by its metadata what it names (``Ref``, ``DynamicRef``, ``RefPairs``, ...). ``bridge`` reads the schema of any
table, walks structs, arrays and maps, and makes one expression of it, so that a family it was never told of has its
references too. Free JSON texts (``Blob``) are searched for the same names at any depth.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from worldlog.sources import feeds

ANY = "*"


def Ref(kind: str = ANY) -> dict:
    """A text, or an array of texts, that are ids of records of a kind."""
    return {"ref": kind}


def DynamicRef(kind_field: str) -> dict:
    """An id whose kind stands in a field beside it."""
    return {"kind_from": kind_field}


def RefPairs() -> dict:
    """An array of (kind, id) structs, or of bare ids of any kind."""
    return {"pairs": True}


def RefInPairs(kind: str, position: int) -> dict:
    """An array of structs, or of arrays, of which the one at ``position`` is an id of a kind."""
    return {"ref": kind, "slot": position}


def OwnId() -> dict:
    return {"own_id": True}


def Label() -> dict:
    """Shaped like an id, but names no record."""
    return {"label": True}


def Blob() -> dict:
    """A JSON text without a schema of its own."""
    return {"blob": True}


def annotated(df: DataFrame, **meanings: dict) -> DataFrame:
    """``df`` with the metadata of top-level columns; nested fields carry theirs in the types they are made with."""
    return df.select(*(F.col(c).alias(c, metadata=meanings[c]) if c in meanings else F.col(c) for c in df.columns))


_FOUND = "array<struct<field:string,kind:string,ref:string>>"


def _kind(value: Column, aliases: dict[str, str]) -> Column:
    """A kind by its own name: lower case, other names for it replaced."""
    said = F.lower(value)
    return reduce(lambda otherwise, x: F.when(said == x[0], x[1]).otherwise(otherwise), aliases.items(), said)


def _named(field: str, kind: Column, refs: Column) -> Column:
    """(field, kind, ref) of an array of ids; empty and null ones name nothing."""
    good = F.filter(refs, lambda r: r.isNotNull() & (r != "") & kind.isNotNull())
    return F.transform(good, lambda r: F.struct(F.lit(field).alias("field"), kind.alias("kind"), r.alias("ref")))


def _parts(kind: DataType, value: Column) -> Column:
    return F.array(value) if isinstance(kind, StringType) else value


def _in(field: StructField, value: Column, owner: Callable[[str], Column], path: str, aliases: dict[str, str]) -> list[Column]:
    """Expressions of what one field names, and the fields within it."""
    meta, kind, at = field.metadata or {}, field.dataType, f"{path}{field.name}"
    if meta.get("own_id") or meta.get("label") or meta.get("blob"):
        return []
    if "slot" in meta:
        element = kind.elementType
        pick = lambda p: p[element.fields[meta["slot"]].name] if isinstance(element, StructType) else F.get(p, F.lit(meta["slot"]))
        return [_named(at, F.lit(meta["ref"]), F.transform(value, pick))]
    if meta.get("pairs"):
        if isinstance(kind.elementType, StringType):
            return [_named(at, F.lit(ANY), value)]
        names = [f.name for f in kind.elementType.fields[:2]]
        good = F.filter(value, lambda p: (p[names[1]] != "") & p[names[0]].isNotNull())
        return [F.transform(good, lambda p: F.struct(F.lit(at).alias("field"), _kind(p[names[0]], aliases).alias("kind"), p[names[1]].alias("ref")))]
    if "kind_from" in meta:
        return [_named(at, _kind(owner(meta["kind_from"]), aliases), _parts(kind, value))]
    if "ref" in meta:
        return [_named(at, F.lit(meta["ref"]), _parts(kind, value))]
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in _in(f, value[f.name], lambda n: value[n], f"{at}.", aliases)]
    if isinstance(kind, MapType):
        kind, value = ArrayType(kind.valueType), F.map_values(value)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType, MapType)):
        inside = StructField(field.name, kind.elementType)
        if not _in(inside, F.lit(None), lambda n: F.lit(None), path, aliases):
            return []
        return [F.flatten(F.transform(value, lambda e: _all(_in(inside, e, lambda n: F.lit(None), path, aliases))))]
    return []


def _all(found: list[Column]) -> Column:
    none = F.array().cast(_FOUND)
    return F.concat(*(F.coalesce(x, none) for x in found)) if found else none


def own_id(df: DataFrame) -> str:
    return next(f.name for f in df.schema.fields if (f.metadata or {}).get("own_id"))


def _fields_of(schema: StructType):
    """All annotated fields of a schema, at any depth."""
    for f in schema.fields:
        yield f
        inner = f.dataType
        while isinstance(inner, (ArrayType, MapType)):
            inner = inner.elementType if isinstance(inner, ArrayType) else inner.valueType
        if isinstance(inner, StructType):
            yield from _fields_of(inner)


def policy(families: dict[str, DataFrame]) -> tuple[dict[str, str], set[tuple[str, str]]]:
    """What names mean in free JSON: name to kind, and (kind field, id field) pairs. A name of two meanings means any kind."""
    kinds: dict[str, str] = {}
    pairs: set[tuple[str, str]] = set()

    def learn(name: str, kind: str) -> None:
        kinds[name] = kind if kinds.get(name, kind) == kind else ANY

    for family, df in families.items():
        for f in _fields_of(df.schema):
            meta = f.metadata or {}
            if "kind_from" in meta:
                pairs.add((meta["kind_from"], f.name))
            elif "ref" in meta and "slot" not in meta:
                learn(f.name, meta["ref"])
            elif meta.get("own_id"):
                learn(f.name, family)
    return kinds, pairs


def _in_blobs(family: str, df: DataFrame, kinds: dict[str, str], pairs: set[tuple[str, str]], aliases: dict[str, str]) -> list[DataFrame]:
    out, key = [], own_id(df)
    for f in df.schema.fields:
        if not (f.metadata or {}).get("blob"):
            continue
        asked = sorted({*kinds, *(n for pair in pairs for n in pair)})
        leaves = feeds.json_named(df.select(F.col(key).alias("src"), F.col(f.name).alias("_blob")), "src", "_blob", asked)
        meaning = lambda name: reduce(lambda otherwise, x: F.when(name == x[0], x[1]).otherwise(otherwise), kinds.items(), F.lit(None).cast("string"))
        one = lambda kind, leaf: F.struct(F.lit(f.name).alias("field"), kind.alias("kind"), leaf["value"].alias("ref"))
        plain = F.filter(F.transform("leaves", lambda x: one(meaning(x["name"]), x)), lambda r: r["kind"].isNotNull())
        # a kind beside an id, in the same object
        beside = lambda x, n: F.filter("leaves", lambda y: (y["name"] == n) & (y["over"] == x["over"]))
        told = lambda k, i: F.flatten(F.transform(F.filter("leaves", lambda x: x["name"] == i), lambda x: F.transform(beside(x, k), lambda y: one(_kind(y["value"], aliases), x))))
        out.append(leaves.select(F.lit(family).alias("src_kind"), "src", F.inline(F.array_distinct(F.concat(plain, *(told(*pair) for pair in sorted(pairs)))))))
    return out


def named(families: dict[str, DataFrame], aliases: dict[str, str] | None = None) -> DataFrame:
    """src_kind, src, field, kind, ref of every reference that a record of any family makes, without a shuffle: rows of one id may repeat some.

    ``families``: kind to table, whose schemas carry the metadata. A table without references adds none; null and empty
    ids name nothing; a DynamicRef without a kind neither. ``aliases``: other names of kinds.
    """
    aliases = aliases or {}
    kinds, pairs = policy(families)
    found = []
    for family, df in families.items():
        parts = [x for f in df.schema.fields for x in _in(f, F.col(f.name), F.col, "", aliases)]
        if parts:
            found.append(df.select(F.lit(family).alias("src_kind"), F.col(own_id(df)).alias("src"), F.inline(F.array_distinct(_all(parts)))))
        found += _in_blobs(family, df, kinds, pairs, aliases)
    return reduce(DataFrame.union, found)


def bridge(families: dict[str, DataFrame], aliases: dict[str, str] | None = None) -> DataFrame:
    """What ``named`` gives, each reference once."""
    return named(families, aliases).distinct()


def records_of(families: dict[str, DataFrame], *columns: str) -> DataFrame:
    """kind, ref and further columns of every record."""
    each = [df.select(F.lit(k).alias("kind"), F.col(own_id(df)).alias("ref"), *columns) for k, df in families.items()]
    return reduce(DataFrame.union, each).distinct()


def resolved(found: DataFrame, records: DataFrame) -> DataFrame:
    """The bridge's rows that name a record (kind, ref), with its kind in ``kind``: a reference of any kind takes all of that id."""
    known = records.select(F.col("kind").alias("_kind"), "ref").distinct()
    met = found.join(known, "ref").filter((F.col("kind") == ANY) | (F.col("kind") == F.col("_kind")))
    return met.select("src_kind", "src", "field", F.col("_kind").alias("kind"), "ref")


def directions(found: DataFrame, backward: set[tuple[str, str]]) -> DataFrame:
    """Edges (src, dst) of the bridge; those from a kind to another that ``backward`` (from, to) names are walked back too. They may repeat."""
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    which = reduce(lambda a, b: a | b, ((F.col("src_kind") == a) & (F.col("kind") == b) for a, b in sorted(backward)), F.lit(False))
    # one pass: what is walked back is not looked up again
    return found.select(F.inline(F.when(which, F.array(way("src", "ref"), way("ref", "src"))).otherwise(F.array(way("src", "ref")))))


def both_directions(found: DataFrame, backward: set[tuple[str, str]]) -> DataFrame:
    """What ``directions`` gives, each edge once."""
    return directions(found, backward).distinct()
