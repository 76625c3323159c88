"""Access: who may see a marked row, and the marking of what is derived from several."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ROLES = ("OBSERVER", "ANALYST", "SUPERVISOR")
SEAL = "SEALED_UNJOINABLE_MARKINGS"
#: A compartment that no reader can hold: what carries it is denied to all.
SEALED_COMPARTMENT = "worldlog:unjoinable-seal"


@dataclass(frozen=True)
class Context:
    """A reader: organisation, compartments held, releasability groups and the highest role."""

    organisation: str
    compartments: tuple[str, ...] = ()
    releasability: tuple[str, ...] = ()
    role: str = "OBSERVER"

    def __post_init__(self) -> None:
        if SEALED_COMPARTMENT in self.compartments:
            raise ValueError("no reader can hold the compartment of sealed rows")


def rank(role: Column) -> Column:
    """0, 1, ... of a known role; null of others."""
    place = F.array_position(F.array(*map(F.lit, ROLES)), role)
    return F.when(place > 0, place - 1)


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def can_view(context: Context) -> Column:
    """True where the row's marking columns admit the reader; a missing or unknown part denies."""
    held = F.size(F.array_except("compartments", _texts(context.compartments))) == 0
    listed = F.arrays_overlap("releasability", _texts(context.releasability))
    owned = (F.col("owning_authority") != "") & (F.col("owning_authority") == context.organisation)
    released = F.when(F.size("releasability") > 0, listed).otherwise(owned)
    return F.coalesce((rank(F.col("min_role")) <= ROLES.index(context.role)) & held & released, F.lit(False))


def visible(rows: DataFrame, context: Context) -> DataFrame:
    return rows.filter(can_view(context))


def joined_markings(rows: DataFrame, *keys: str) -> DataFrame:
    """The marking that a row derived from each group must carry, and whether it had to be sealed.

    Compartments unite, releasability intersects (a marking without any makes it empty), the highest role counts, the
    owner is the first one's by ``ord``. A join that would lock what was released, or that spans owners, is sealed: it
    also carries a compartment that nobody holds, and says so in ``caveats``. Caveats of the rows (``caveats``, an array, if
    there is such a column) are all carried, each once, in the order in which they come first.
    One grouping with map-side partials: the intersection is that of values that all of the group's rows have.
    """
    n_rows = rows.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("compartments")))).alias("compartments"),
        F.collect_set("releasability").alias("_lists"),
        F.max(rank(F.col("min_role"))).alias("_rank"),
        F.min_by("owning_authority", "ord").alias("owning_authority"),
        F.count_distinct("owning_authority").alias("_owners"),
    )
    common = F.expr("aggregate(slice(_lists, 2, size(_lists)), _lists[0], (a, b) -> array_intersect(a, b))")
    shared = F.array_sort(common)
    unsafe = (F.size("_shared") == 0) & ((F.col("_owners") > 1) | F.exists("_lists", lambda x: F.size(x) > 0))
    if "caveats" in rows.columns:  # distinct ones meet, not rows
        each = rows.select(*keys, "ord", F.posexplode("caveats").alias("_at", "_caveat")).groupBy(*keys, "_caveat").agg(F.min(F.struct("ord", "_at")).alias("_place"))
        told = each.groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_caveat"))), lambda x: x["_caveat"]).alias("_caveats"))
        n_rows = n_rows.join(told, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys)), "left")
    else:
        n_rows = n_rows.withColumn("_caveats", F.array().cast("array<string>"))
    caveats = F.coalesce("_caveats", F.array().cast("array<string>"))
    return n_rows.withColumn("_shared", shared).withColumn("sealed", unsafe).select(
        *keys,
        "owning_authority",
        F.when(F.col("sealed"), F.array_sort(F.array_append("compartments", F.lit(SEALED_COMPARTMENT)))).otherwise(F.col("compartments")).alias("compartments"),
        F.when(F.col("sealed"), F.array().cast("array<string>")).otherwise(F.col("_shared")).alias("releasability"),
        F.when(F.col("sealed"), ROLES[-1]).otherwise(F.get(F.array(*map(F.lit, ROLES)), F.col("_rank").cast("int"))).alias("min_role"),
        "sealed",
        F.array_join(F.when(F.col("sealed"), F.array_append(F.array_remove(caveats, SEAL), F.lit(SEAL))).otherwise(caveats), "; ").alias("caveats"),
    )
