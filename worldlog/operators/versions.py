"""Versions: what is current, what stood at a time, and what changed between one version and the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worldlog.functions.scalar import hours_between

DEFAULT_STALE_HOURS = 24.0
WEAK_VALUES = ("UNKNOWN", "CONFLICTING_REPORTS", "DEPENDENT_GROUP", "UNREVIEWED")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in ``order``.

    ``max_by`` with partial aggregation: one row for each key and task is shuffled, and no group is sorted.
    """
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def current_by_validity(versions: DataFrame) -> DataFrame:
    """Objects: the latest validity, ties by version: late reports of older states displace nothing."""
    return latest(versions, ["object_id"], ["valid_from", "version"])


def current_by_log(versions: DataFrame) -> DataFrame:
    """Relationships and association: the last row of the log."""
    return latest(versions, ["object_id"], ["seq"])


def current_by_version(versions: DataFrame) -> DataFrame:
    """Claims and analysis: the highest version, later rows of the log win ties."""
    return latest(versions, ["object_id"], ["version", "seq"])


def current_by_valid_point(versions: DataFrame) -> DataFrame:
    """Objects of feeds: the latest of valid_from, else source_time, else recorded_time; ties by version, then the one recorded first."""
    kind = versions.schema["recorded_time"].dataType
    age = F.lit("1970-01-01").cast(kind) - F.col("recorded_time")
    told = versions.withColumns({"_point": F.coalesce("valid_from", "source_time", "recorded_time"), "_age": age, "_place": -F.col("seq")})
    return latest(told, ["object_id"], ["_point", "version", "_age", "_place"]).drop("_point", "_age", "_place")


def current_by_stated_version(versions: DataFrame) -> DataFrame:
    """Records of reports: the highest version, a missing one counts as the first; later rows of the log win ties."""
    return latest(versions.withColumn("_version", F.coalesce("version", F.lit(1))), ["object_id"], ["_version", "seq"]).drop("_version")


def last_appended(rows: DataFrame, *keys: str) -> DataFrame:
    """Catalogue and run records: the last row of the log for each kind and id, whatever its version says."""
    return latest(rows, list(keys), ["seq"])


def known_by(versions: DataFrame, seq: int) -> DataFrame:
    """As of a transaction: the rows that were in the log."""
    return versions.filter(F.col("seq") <= seq)


def valid_at(versions: DataFrame, at: str) -> DataFrame:
    """As of a valid time: the current one of the versions whose validity has begun."""
    return current_by_validity(versions.filter(F.col("valid_from") <= F.lit(at).cast("timestamp_ntz")))


def opening(versions: DataFrame) -> DataFrame:
    """The first version of each object."""
    return versions.groupBy("object_id").agg(F.min_by(F.struct(*versions.columns), "version").alias("_row")).select("_row.*")


def freshness(basis: Column, snapshot: str, stale_hours: Column | None = None) -> Column:
    """(state, age_hours) of a row at the snapshot; without a basis UNKNOWN and null."""
    age = hours_between(basis, F.lit(snapshot).cast("timestamp_ntz"))
    limit = F.coalesce(stale_hours, F.lit(DEFAULT_STALE_HOURS)) if stale_hours is not None else F.lit(DEFAULT_STALE_HOURS)
    state = F.when(basis.isNull(), "UNKNOWN").when(age > limit, "STALE").otherwise("FRESH")
    return F.struct(state.alias("state"), age.alias("age_hours"))


def weak_dimensions(quality: Column, freshness_state: Column) -> Column:
    """Names of weak or unknown dimensions in order, freshness last; unknown never counts as zero."""
    weak = lambda v: v.isin(*WEAK_VALUES) | F.coalesce(v.try_cast("double") < 0.5, F.lit(False))
    names = F.array_sort(F.map_keys(F.map_filter(quality, lambda _, v: weak(v))))
    return F.when(freshness_state == "STALE", F.array_append(names, F.lit("freshness"))).otherwise(names)


def breaks_in_sequence(versions: DataFrame, key: str = "object_id", number: str = "version") -> DataFrame:
    """Rows whose number is not one more than that before, in log order (the first must be 1)."""
    line = Window.partitionBy(key).orderBy("seq")
    before = F.coalesce(F.lag(number).over(line), F.lit(0))
    return versions.withColumn("expected", before + 1).filter(F.col(number) != F.col("expected"))


def changes(versions: DataFrame, columns: list[str]) -> DataFrame:
    """object_id, version, attribute, before, after: what each version changed; first versions change nothing."""
    line = Window.partitionBy("object_id").orderBy("version")
    told = versions.select("object_id", "version", *[F.col(c).cast("string").alias(c) for c in columns])
    pairs = told.select("object_id", "version", *columns, *[F.lag(c).over(line).alias(f"_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"_{c}").alias("before"), F.col(c).alias("after")) for c in columns])
    return pairs.filter("version > 1").select("object_id", "version", F.inline(each)).filter("NOT before <=> after")


def standing_since(versions: DataFrame, value: str) -> DataFrame:
    """object_id, value, since (validity) and n of the last run of equal values: when the answer that stands came in."""
    line = Window.partitionBy("object_id").orderBy("version")
    marked = versions.withColumn("_new", (~F.lag(value).over(line).eqNullSafe(F.col(value))).cast("int"))
    # runs of a key are numbered from its first: its last run is that of the greatest number
    numbered = marked.withColumn("_run", F.sum("_new").over(line))
    return (
        numbered.groupBy("object_id", "_run")
        .agg(F.first(value).alias("value"), F.min_by("valid_from", "version").alias("since"), F.count("*").alias("n"))
        .groupBy("object_id")
        .agg(F.max_by(F.struct("value", "since", "n"), "_run").alias("_last"))
        .select("object_id", "_last.*")
    )


def illegal_transitions(versions: DataFrame, allowed: DataFrame) -> DataFrame:
    """object_id, version, from_status, to_status of steps that ``allowed`` (from_status, to_status) does not list."""
    line = Window.partitionBy("object_id").orderBy("version")
    steps = versions.select("object_id", "version", F.lag("status").over(line).alias("from_status"), F.col("status").alias("to_status"))
    return steps.filter("from_status IS NOT NULL AND from_status <> to_status").join(
        F.broadcast(allowed), ["from_status", "to_status"], "left_anti"
    ).select("object_id", "version", "from_status", "to_status")  # a flow table has a few rows


def moves(versions: DataFrame, value: str, after: str) -> DataFrame:
    """object_id, n_moves, n_late: how often a number moved, and how often after a time."""
    line = Window.partitionBy("object_id").orderBy("version")
    moved = F.abs(F.col(value) - F.lag(value).over(line)) > 1e-9
    late = F.col("valid_from") > F.lit(after).cast("timestamp_ntz")
    return versions.select("object_id", moved.alias("_m"), late.alias("_l")).groupBy("object_id").agg(
        F.count_if("_m").alias("n_moves"), F.count_if(F.col("_m") & F.col("_l")).alias("n_late")
    )
