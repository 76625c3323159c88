"""Payloads against registered schemas: top-level fields, their types, formats and values, by kind of payload and by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldlog.functions import scalar

#: One declared field. ``enum`` is null where any value will do.
FIELD = "struct<name:string,type:string,required:boolean,format:string,enum:array<string>>"
SCHEMA = f"schema_id string, version string, kind string, fields array<{FIELD}>, compatible array<string>, fallback boolean"
# A fixed value: the one key that no schema declares and any payload may have.
VERSION_KEY = "schema_version"


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _of_type(kind: Column, wanted: Column) -> Column:
    """Whether a JSON value of some kind (``schema_of_variant``) is of a declared type; 1.0 is a number and no integer, true is neither."""
    # whole numbers that no long holds are decimals without a fraction; shorter such decimals were written with one
    whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    number = (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")
    return (
        F.when(wanted == "string", kind == "STRING").when(wanted == "number", number).when(wanted == "integer", whole)
        .when(wanted == "boolean", kind == "BOOLEAN").when(wanted == "object", kind.startswith("OBJECT")).when(wanted == "array", kind.startswith("ARRAY"))
        .otherwise(F.lit(False))
    )


def sound_geometry(value: Column) -> Column:
    """Whether a GeoJSON value (variant) is a Point, a LineString of two places or more, or a Polygon of one closed ring, on the globe."""
    kind = F.try_variant_get(value, "$.type", "string")
    get = lambda depth: F.try_variant_get(value, "$.coordinates", "array<" * depth + "double" + ">" * depth)
    place = lambda p: F.size(p).isin(2, 3) & F.get(p, F.lit(0)).between(-180, 180) & F.get(p, F.lit(1)).between(-90, 90)
    places = lambda ps, least: (F.size(ps) >= least) & F.forall(ps, lambda p: F.coalesce(place(p), F.lit(False)))
    closed = lambda rings: _with(F.get(rings, F.lit(0)), lambda r: (F.size(rings) == 1) & places(r, 4) & (F.get(r, F.lit(0)) == F.element_at(r, -1)))
    sound = F.when(kind == "Point", _with(get(1), place)).when(kind == "LineString", _with(get(2), lambda ps: places(ps, 2))).when(kind == "Polygon", _with(get(3), closed))
    return F.coalesce(sound, F.lit(False))


def _problem(field: Column, value: Column, kind: Column) -> Column:
    """What is wrong with one declared field's value (null: the payload has no such field); null if nothing is."""
    name, absent = field["name"], kind.isNull() | (kind == "VOID")
    text = F.try_variant_get(value, "$", "string")
    told = lambda say: F.concat(name, F.lit(say))
    form = (
        F.when((field["format"] == "iso-datetime") & scalar.instant(text).isNull(), told(": not a timezone-aware ISO datetime"))
        .when((field["format"] == "sha256") & ~F.coalesce(F.length(text) == 64, F.lit(False)), told(": not a sha256"))
        .when((field["format"] == "geojson-geometry") & ~sound_geometry(value), told(": invalid geometry"))
    )
    listed = F.when(field["enum"].isNotNull() & ~F.coalesce(F.array_contains(field["enum"], text), F.lit(False)), F.concat(name, F.lit(": '"), text, F.lit("' not in enum")))
    wrong = F.when(~_of_type(kind, field["type"]), F.concat(name, F.lit(": expected "), field["type"])).otherwise(F.nullif(F.concat_ws("; ", form, listed), F.lit("")))
    return F.when(absent, F.when(field["required"], told(": required field missing"))).otherwise(wrong)


def document_report(fields: Column, document: Column) -> Column:
    """(errors, warnings) of one document (variant): errors field by field in the schema's order, a warning for each key, by
    name, that the schema does not declare. Only the top level counts."""
    none = F.array().cast("array<string>")

    def told(keys: Column) -> Column:
        valued = F.transform(fields, lambda f: _with(F.try_element_at(keys, f["name"]), lambda v: F.struct(f.alias("f"), v.alias("v"), F.schema_of_variant(v).alias("k"))))
        others = F.array_except(F.map_keys(keys), F.concat(F.transform(fields, lambda f: f["name"]), F.array(F.lit(VERSION_KEY))))
        return F.struct(
            F.when(keys.isNull(), F.array(F.lit("payload is not an object"))).otherwise(F.array_compact(F.transform(valued, lambda x: _problem(x["f"], x["v"], x["k"])))).alias("errors"),
            F.coalesce(F.transform(F.array_sort(others), lambda k: F.concat(F.lit("undeclared field present: "), k)), none).alias("warnings"),
        )

    return _with(F.try_variant_get(document, "$", "map<string,variant>"), told)


def _feature_report(fields: Column, feature: Column) -> Column:
    """As ``document_report`` of a feature's properties, which null stands for none of, after the errors of its geometry."""
    none = F.array().cast("array<string>")
    empty = F.parse_json(F.lit("{}"))
    own = _with(F.coalesce(F.try_variant_get(feature, "$.properties", "variant"), empty), lambda p: F.when(F.is_variant_null(p), empty).otherwise(p))
    placed = F.when(sound_geometry(F.try_variant_get(feature, "$.geometry", "variant")), none).otherwise(F.array(F.lit("invalid geometry")))
    found = _with(document_report(fields, own), lambda r: F.struct(F.concat(placed, r["errors"]).alias("errors"), r["warnings"].alias("warnings")))
    other = F.struct(F.array(F.lit("feature is not an object")).alias("errors"), none.alias("warnings"))
    return F.when(F.schema_of_variant(feature).startswith("OBJECT"), found).otherwise(other)


def payload_status(payloads: DataFrame, schemas: DataFrame) -> DataFrame:
    """``payloads`` (payload_id, schema_id, body: JSON) with effective (version), kind, status, reasons and warnings.

    ``schemas`` are of ``SCHEMA``: kind is document, rows or geojson, ``compatible`` the versions that this one also reads,
    ``fallback`` true for the version that the feed names. A payload may declare a ``schema_version``: that one counts if
    it is registered, else the feed's if it is compatible, else the payload is UNSUPPORTED_SCHEMA_VERSION. A payload
    is INVALID with any error. The body is parsed once; null, torn and repeated-key bodies are no JSON. Schemas are a stated
    set and broadcast: feeds are few, and payloads dealt by feed would come to as few tasks. A payload of an unknown feed is
    unsupported too.
    """
    read = payloads.withColumn("_v", F.try_parse_json("body"))
    declared = F.nullif(F.try_variant_get("_v", f"$.{VERSION_KEY}", "string"), F.lit(""))
    feed = schemas.filter("fallback").select("schema_id", *[F.col(c).alias(f"_f_{c}") for c in ("version", "kind", "fields", "compatible")])
    exact = schemas.select("schema_id", F.col("version").alias("_declared"), *[F.col(c).alias(f"_x_{c}") for c in ("kind", "fields")])
    met = read.join(F.broadcast(feed), "schema_id", "left").withColumn("_declared", F.coalesce(declared, "_f_version")).join(F.broadcast(exact), ["schema_id", "_declared"], "left")
    fits = F.col("_x_kind").isNotNull()
    falls = ~fits & F.coalesce(F.array_contains("_f_compatible", F.col("_declared")), F.lit(False))
    pick = lambda c: F.when(fits, F.col(f"_x_{c}")).when(falls, F.col(f"_f_{c}"))
    named = met.withColumns({"_kind": pick("kind"), "_fields": pick("fields"), "effective": F.when(falls, F.col("_f_version")).otherwise(F.col("_declared"))})
    kind, none = F.col("_kind"), F.array().cast("array<string>")
    # the parts that are tested, each by itself: rows, features, or the whole
    parts = F.when(kind == "rows", F.try_variant_get("_v", "$.rows", "array<variant>")).when(kind == "geojson", F.coalesce(F.try_variant_get("_v", "$.features", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array("_v"))
    shape = (
        F.when(kind.isNull(), "schema version not registered")
        .when(F.col("_v").isNull(), "payload is no JSON")
        .when((kind == "rows") & F.col("_parts").isNull(), "payload must contain rows")
        .when((kind == "geojson") & ~F.coalesce(F.try_variant_get("_v", "$.type", "string") == "FeatureCollection", F.lit(False)), "payload must be a GeoJSON FeatureCollection")
        .when((kind == "document") & ~F.schema_of_variant("_v").startswith("OBJECT"), "payload must be an object")
    )
    shaped = named.withColumn("_parts", parts).withColumn("_shape", shape)
    report = F.when(F.col("_shape").isNull(), F.transform("_parts", lambda p: F.when(kind == "geojson", _feature_report(F.col("_fields"), p)).otherwise(document_report(F.col("_fields"), p))))
    at = lambda i: F.when(kind == "rows", F.concat(F.lit("row "), i.cast("string"), F.lit(": "))).when(kind == "geojson", F.concat(F.lit("feature "), i.cast("string"), F.lit(": "))).otherwise("")
    each = lambda which: F.flatten(F.transform("_report", lambda r, i: F.transform(r[which], lambda s: F.concat(at(i), s))))
    judged = shaped.withColumn("_report", report).withColumns(
        {"_reasons": F.when(F.col("_shape").isNotNull(), F.array("_shape")).otherwise(each("errors")), "_warnings": F.coalesce(each("warnings"), none)}
    )
    status = F.when(kind.isNull(), "UNSUPPORTED_SCHEMA_VERSION").when(F.size("_reasons") > 0, "INVALID").otherwise("VALID")
    # one row of one verdict: what is asked of it later is asked of the verdict, and does not work out the report again
    verdict = F.struct(status.alias("status"), F.col("_reasons").alias("reasons"), F.col("_warnings").alias("warnings"))
    return judged.select(*payloads.columns, "effective", kind.alias("kind"), F.inline(F.array(verdict)))
