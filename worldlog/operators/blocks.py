"""What stands before each row in an order, for groups of any size: ranges in many tasks, their ends stitched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worldlog.operators.graph import saved


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the struct of ``columns`` of the row before it among those of equal ``keys``, by ``order``; null for the first.

    Rows are dealt to tasks by ranges of keys and order, so that one key may span many; each task looks back within its own
    rows, and the first row of a key in a task takes the last one of the tasks before. ``order`` tells rows of a key apart;
    equal ones stand in any order. Null keys are one key.
    """
    by = [*keys, *order]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = saved(sorted_, "ranges").withColumn("_task", F.shiftright("_at", 33))  # a place is given once
    own = Window.partitionBy("_task", *keys).orderBy("_at")
    here = placed.withColumn("_own", F.lag(F.struct(*columns)).over(own))
    # one row for each key and task, and of these only where a key goes on in another task
    ends = placed.groupBy(*keys, "_task").agg(F.max_by(F.struct(*columns), "_at").alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_task")
    carried = ends.withColumn("_carried", F.lag("_last").over(over)).filter("_carried IS NOT NULL").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_task").alias("_t"), "_carried")
    same = F.col("_task") == F.col("_t")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return here.join(carried, same, "left").withColumn(name, F.coalesce("_own", "_carried")).select(*rows.columns, name)


def placed(rows: DataFrame, order: list[str], name: str = "place", first: int = 1) -> DataFrame:
    """``rows`` with ``name``: their place in the order of all, from ``first`` on, without a gap; equal rows in any order.

    Rows are dealt to tasks by ranges and numbered there; of the tasks only their counts meet, one row each.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = saved(sorted_, "places").withColumn("_task", F.shiftright("_at", 33))
    counts = ranged.groupBy("_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_task", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(counts), "_task").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + first).select(*rows.columns, name)
