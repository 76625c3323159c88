"""Observations from the field paths of three kinds of structured record: registries, entity graphs, filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldlog.functions import scalar

# What a registry's fields and a graph's properties are called in observations.
REGISTRY_FIELDS = {
    "attributes.entity.legalName.name": "legal_name",
    "attributes.entity.jurisdiction": "jurisdiction",
    "attributes.entity.status": "entity_status",
    "attributes.registration.status": "registration_status",
    "attributes.entity.legalAddress.city": "legal_address_city",
    "attributes.entity.legalAddress.country": "legal_address_country",
}
GRAPH_IDENTIFIERS = {"P1278": "LEI", "P5531": "SEC_CIK", "P1320": "OPENCORPORATES", "P946": "ISIN", "P249": "TICKER", "P6782": "ROR", "P2427": "GRID"}
RESULT = ("type", "subject", "attribute", "value", "object_ref", "path")


def _named(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def _records(fields: DataFrame, prefix: str) -> DataFrame:
    """Fields within a record: its path as ``record``, and the ``rest`` of theirs."""
    cut = fields.filter("value <> ''").withColumn("record", F.regexp_extract("path", prefix, 1)).filter("record <> ''")
    return cut.withColumn("rest", F.expr("substring(path, length(record) + 2)"))


def _at(rest: str) -> Column:
    return F.max(F.when(F.col("rest") == rest, F.col("value")))


def _observed(*parts: tuple[Column, Column, Column, Column]) -> Column:
    """The first of (when, type, attribute, object_ref) that holds, as a struct; null if none does."""
    made = lambda p: F.struct(p[1].alias("type"), p[2].alias("attribute"), p[3].alias("object_ref"))
    return F.coalesce(*[F.when(p[0], made(p)) for p in parts])


def registry(fields: DataFrame, key: str) -> DataFrame:
    """Observations of registry records ``$.data`` or ``$.data[i]``; records without an identifier say nothing.

    fields: ``key``, path, value. Result: key, type, subject, attribute, value, object_ref, path, and source_time, the day
    of the last update.
    """
    rows = _records(fields, r"^(\$\.data(?:\[\d+\])?)\.")
    heads = rows.groupBy(key, "record").agg(F.coalesce(_at("attributes.lei"), _at("id")).alias("lei"), scalar.source_day(_at("attributes.registration.lastUpdateDate")).alias("source_time"))
    rest, none = F.col("rest"), F.lit("")
    attribute = _named(REGISTRY_FIELDS, rest)
    said = _observed(
        (rest == "attributes.entity.legalName.name", F.lit("ENTITY_NAME"), F.lit("legal_name"), none),
        (attribute.isNotNull(), F.lit("ENTITY_ATTRIBUTE"), attribute, none),
        (rest == "attributes.registration.initialRegistrationDate", F.lit("EVENT"), F.lit("lei_registered"), none),
        (rest.rlike(r"^attributes\.entity\.otherNames\[\d+\]\.name$"), F.lit("ENTITY_NAME"), F.lit("other_name"), none),
        (rest == "attributes.entity.successorEntity.lei", F.lit("RELATION"), F.lit("SUCCESSOR_OF"), F.concat(F.lit("LEI:"), "value")),
    )
    met = rows.join(heads.filter("lei IS NOT NULL"), [key, "record"])
    told = met.withColumn("o", said).filter("o IS NOT NULL").select(key, "o.type", F.concat(F.lit("LEI:"), "lei").alias("subject"), "o.attribute", "value", "o.object_ref", "path", "source_time")
    own = heads.filter("lei IS NOT NULL").select(
        key, F.lit("ENTITY_IDENTIFIER").alias("type"), F.concat(F.lit("LEI:"), "lei").alias("subject"), F.lit("LEI").alias("attribute"), F.col("lei").alias("value"),
        F.lit("").alias("object_ref"), F.concat("record", F.lit(".attributes.lei")).alias("path"), "source_time",
    )
    return told.unionByName(own)


def entity_graph(fields: DataFrame, key: str) -> DataFrame:
    """Observations of entities ``$.entities.Qn``: labels, aliases, identifiers and sites; source_time is not known."""
    rows = _records(fields, r"^(\$\.entities\.Q\d+)\.")
    rest, none = F.col("rest"), F.lit("")
    prop = F.regexp_extract("rest", r"^claims\.(P\d+)\[\d+\]\.mainsnak\.datavalue\.value$", 1)
    said = _observed(
        (rest.rlike(r"^labels\.[\w-]+\.value$"), F.lit("ENTITY_NAME"), F.lit("label"), none),
        (rest.rlike(r"^aliases\.[\w-]+\[\d+\]\.value$"), F.lit("ENTITY_NAME"), F.lit("alias"), none),
        (_named(GRAPH_IDENTIFIERS, prop).isNotNull(), F.lit("ENTITY_IDENTIFIER"), _named(GRAPH_IDENTIFIERS, prop), none),
        (prop == "P856", F.lit("RELATION"), F.lit("OPERATES"), F.concat(F.lit("URL:"), "value")),
    )
    entity = F.regexp_extract("record", r"(Q\d+)$", 1)
    subject, time = F.concat(F.lit("WIKIDATA_QID:"), entity).alias("subject"), F.lit(None).cast("string").alias("source_time")
    told = rows.withColumn("o", said).filter("o IS NOT NULL").select(key, "o.type", subject, "o.attribute", "value", "o.object_ref", "path", time)
    own = rows.select(key, "record").distinct().select(
        key, F.lit("ENTITY_IDENTIFIER").alias("type"), subject, F.lit("WIKIDATA_QID").alias("attribute"), entity.alias("value"), F.lit("").alias("object_ref"),
        F.concat("record", F.lit(".id")).alias("path"), time,
    )
    return told.unionByName(own)


def filings(fields: DataFrame, key: str) -> DataFrame:
    """Observations of search hits ``$.hits.hits[i]`` that name a filing and a filer: identifier, name, publication."""
    hits = _records(fields, r"^(\$\.hits\.hits\[\d+\])\.").groupBy(key, "record").agg(
        _at("_source.adsh").alias("adsh"), _at("_source.ciks[0]").alias("cik"), _at("_source.file_date").alias("day"), F.coalesce(_at("_source.file_type"), _at("_source.root_forms[0]"), F.lit("FILING")).alias("form"),
        _at("_id").alias("id"), _at("_source.display_names[0]").alias("display"),
    )
    number = F.regexp_replace("cik", "^0+", "")
    ref = F.concat(F.lit("SEC_ACCESSION:"), "adsh", F.lit("#"), F.coalesce("id", "adsh"))
    name = F.trim(F.regexp_replace(F.trim(F.regexp_replace("display", r"\(CIK.*$", "")), r"\s*\([A-Z0-9.]+\s*[0-9]*\)\s*$", ""))
    day = scalar.source_day(F.col("day"))
    row = lambda type_, attribute, value, ref_, at, time: F.struct(
        F.lit(type_).alias("type"), F.lit(attribute).alias("attribute"), value.alias("value"), ref_.alias("object_ref"), F.concat("record", F.lit(f"._source.{at}")).alias("path"), time.alias("source_time")
    )
    unknown = F.lit(None).cast("string")
    told = F.array(
        row("ENTITY_IDENTIFIER", "SEC_CIK", F.col("cik"), F.lit(""), "ciks[0]", unknown), row("ENTITY_NAME", "display_name", F.coalesce(name, F.lit("")), F.lit(""), "display_names[0]", unknown),
        row("EVENT", "filing_published", F.col("form"), ref, "adsh", day),
    )
    each = hits.filter("adsh IS NOT NULL AND cik IS NOT NULL").select(key, F.concat(F.lit("SEC_CIK:"), F.when(number != "", number).otherwise(F.col("cik"))).alias("subject"), F.explode(told).alias("o"))
    return each.select(key, "o.type", "subject", "o.attribute", "o.value", "o.object_ref", "o.path", "o.source_time").filter("value <> ''")


def observations(fields: DataFrame, key: str) -> DataFrame:
    """All observations of ``fields`` (key, path, value of JSON leaves), whichever of the three kinds its records are."""
    return registry(fields, key).unionByName(entity_graph(fields, key)).unionByName(filings(fields, key))
