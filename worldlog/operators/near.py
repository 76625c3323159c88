"""Points near geometries: met in blocks of bounded size, told pair by pair or only counted."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldlog.functions import scalar
from worldlog.operators import evidence
from worldlog.operators.graph import saved

DEGREE = scalar.EARTH_RADIUS_M * math.pi / 180
#: Points, and shapes, of one cell that meet at a time at most; pairs that a task looks at, where blocks are as many; pairs of a step.
POINTS, SHAPES, TASK_PAIRS, STEP = 8_192, 32_768, 100_000_000, 1 << 17


def along(targets: DataFrame, metres: float) -> DataFrame:
    """id, lon, lat, reach: points of each geometry no farther apart than half of ``metres``, and how far one has to look from them."""
    lines = targets.filter("line IS NOT NULL").select("object_id", F.posexplode(F.expr("transform(sequence(0, size(line) - 2), i -> struct(line[i] AS a, line[i + 1] AS b))")).alias("_at", "s"))
    ax, ay, bx, by = (F.col("s")[end][i] for end in "ab" for i in (0, 1))
    n = F.greatest(F.lit(1), F.ceil(scalar.haversine_m(ax, ay, bx, by) / (metres / 2))).cast("int")
    cut = lines.select("object_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), n.alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    share = F.col("i") / F.col("n")
    on_lines = cut.select(F.col("object_id").alias("id"), (F.col("ax") + (F.col("bx") - F.col("ax")) * share).alias("lon"), (F.col("ay") + (F.col("by") - F.col("ay")) * share).alias("lat"), F.lit(1.5 * metres).alias("reach"))
    return on_lines.union(targets.filter("line IS NULL AND lon IS NOT NULL").select("object_id", "lon", "lat", F.lit(metres)))


def _unit(lon: np.ndarray, lat: np.ndarray) -> list[np.ndarray]:
    lon, lat = np.radians(lon), np.radians(lat)
    return [np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]


class _Points:
    """The points of one block."""

    def __init__(self, ids: pa.Array, lon: np.ndarray, lat: np.ndarray):
        self.ids, self.lon, self.lat = ids, lon, lat
        self.unit, self.kx = _unit(lon, lat), DEGREE * np.cos(np.radians(lat))

    def near_points(self, lon: np.ndarray, lat: np.ndarray, metres: float) -> np.ndarray:
        """Targets by points: whether the great circle between them is ``metres`` long at most."""
        most = (2 * math.sin(min(metres / (2 * scalar.EARTH_RADIUS_M), math.pi / 2))) ** 2
        chord = reduce(np.add, (np.square(b[:, None] - a) for a, b in zip(self.unit, _unit(lon, lat), strict=True)))
        near = chord <= most
        i, j = np.nonzero(np.abs(chord - most) <= 1e-8 * most)  # there the angles themselves decide
        if len(i):
            half = lambda d: np.square(np.sin(np.radians(d) / 2))
            h = half(lat[i] - self.lat[j]) + np.cos(np.radians(self.lat[j])) * np.cos(np.radians(lat[i])) * half(lon[i] - self.lon[j])
            near[i, j] = 2 * scalar.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0))) <= metres
        return near

    def near_segments(self, a: np.ndarray, b: np.ndarray, metres: float) -> np.ndarray:
        """Segments by points: whether a segment comes within ``metres`` on the point's flat map, as in ``scalar.point_to_line_m``."""
        ax, ay = (a[0][:, None] - self.lon) * self.kx, (a[1][:, None] - self.lat) * DEGREE
        dx, dy = (b[0][:, None] - self.lon) * self.kx - ax, (b[1][:, None] - self.lat) * DEGREE - ay
        length = dx * dx + dy * dy
        t = np.divide(-(ax * dx + ay * dy), length, out=np.zeros_like(length), where=length != 0)
        np.clip(t, 0.0, 1.0, out=t)
        return np.sqrt(np.square(ax + t * dx) + np.square(ay + t * dy)) <= metres


def _steps(sizes: np.ndarray, points: int) -> Iterator[tuple[int, int]]:
    """Ranges of targets of so many segments each, so that a step has ``STEP`` pairs, or one target."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + max(1, STEP // points), side="right")))
        yield first, last
        first = last


def _near(points: _Points, targets: pa.RecordBatch, metres: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids of targets, and for each whether each point is near it."""
    lines = targets.column("line")
    is_line = np.asarray(lines.is_valid())
    places = targets.filter(pa.array(~is_line))
    lon, lat = (places.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
    for i, j in _steps(np.ones(len(lon), int), len(points.ids)):
        yield places.column("target_id")[i:j], points.near_points(lon[i:j], lat[i:j], metres)
    lines, ids = lines.filter(pa.array(is_line)), targets.column("target_id").filter(pa.array(is_line))
    sizes = np.asarray(pc.list_value_length(lines)).astype(int)
    corners = lines.flatten()
    x, y = (pc.list_element(corners, k).to_numpy(zero_copy_only=False) for k in (0, 1))
    begins = np.cumsum(sizes) - sizes
    for i, j in _steps(sizes - 1, len(points.ids)):
        a = np.concatenate([np.arange(b, b + n - 1) for b, n in zip(begins[i:j], sizes[i:j], strict=True)])
        near = points.near_segments((x[a], y[a]), (x[a + 1], y[a + 1]), metres)
        yield ids[i:j], np.logical_or.reduceat(near, np.cumsum(sizes[i:j] - 1) - (sizes[i:j] - 1), axis=0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Points, pa.RecordBatch]]:
    """A block's points with some of its targets; rows come block by block, points first."""
    at, held, points = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("_row", "_cell", "_p", "_t", "_shape")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            block, part = tuple(keys[:4, i]), batch.slice(i, j - i)
            if block != at:
                at, held, points = block, [], None
            if not keys[4, i]:
                held.append(part)
            elif held or points:
                if points is None:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    points, held = _Points(whole.column("id").combine_chunks(), *(whole.column(c).to_numpy() for c in ("lon", "lat"))), []
                yield points, part


def _paired(metres: float) -> Callable:
    def meet(batches):
        for points, targets in _blocks(batches):
            for ids, near in _near(points, targets, metres):
                i, j = np.nonzero(near)
                if len(i):
                    yield pa.RecordBatch.from_arrays([points.ids.take(pa.array(j)), ids.take(pa.array(i))], names=["id", "target_id"])

    return meet


def _counted(metres: float, by: str) -> Callable:
    def meet(batches):
        for points, targets in _blocks(batches):
            if by == "target_id":
                for ids, near in _near(points, targets, metres):
                    n = near.sum(axis=1)
                    yield pa.RecordBatch.from_arrays([ids.filter(pa.array(n > 0)), pa.array(n[n > 0].astype("int64"))], names=[by, "n"])
            else:
                n = sum(near.sum(axis=0) for _, near in _near(points, targets, metres))
                yield pa.RecordBatch.from_arrays([points.ids.filter(pa.array(n > 0)), pa.array(n[n > 0].astype("int64"))], names=[by, "n"])

    return meet


def _met(points: DataFrame, targets: DataFrame, metres: float, meet: Callable, schema: str) -> DataFrame:
    """``meet`` over blocks: of a cell of the globe so many points and so many of the targets that reach it, each once."""
    cell = ["_row", "_cell"]
    standing = points.select("id", "lon", "lat", *evidence.own_cell(F.col("lon"), F.col("lat"), metres)).filter("_row IS NOT NULL AND _cell IS NOT NULL")
    reached = evidence.reached_cells(along(targets, metres), metres).distinct()
    seen = lambda df, p, t: df.select(*cell, F.lit(p).alias("_points"), F.lit(t).alias("_shapes"))
    counts = saved(seen(standing, 1, 0).union(seen(reached, 0, 1)).groupBy(*cell).agg(F.sum("_points").alias("_points"), F.sum("_shapes").alias("_shapes")).filter("_points > 0 AND _shapes > 0"), "cells")
    work = counts.agg(F.sum(F.col("_points").cast("double") * F.col("_shapes"))).first()[0] or 0
    # cells of more than a block: at most one for each POINTS or SHAPES rows
    full = F.broadcast(counts.filter((F.col("_points") > POINTS) | (F.col("_shapes") > SHAPES)).select(*cell, F.ceil(F.col("_points") / POINTS).alias("_ps"), F.ceil(F.col("_shapes") / SHAPES).alias("_ts")))
    cut = lambda df: df.join(full, cell, "left").fillna(1, ["_ps", "_ts"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    of_points = cut(standing).select(*cell, F.pmod(F.xxhash64("id", "lon", "lat"), "_ps").alias("_p"), every("_ts").alias("_t"), F.lit(0).alias("_shape"), "id", none(targets, "object_id").alias("target_id"), "lon", "lat", none(targets, "line").alias("line"))
    shape = targets.select(F.col("object_id").alias("_id"), "lon", "lat", "line")
    placed = cut(reached).join(shape.hint("merge"), F.col("id") == F.col("_id"))
    of_shapes = placed.select(*cell, every("_ps").alias("_p"), F.pmod(F.xxhash64("_id"), "_ts").alias("_t"), F.lit(1).alias("_shape"), none(points, "id").alias("id"), F.col("_id").alias("target_id"), "lon", "lat", "line")
    block = [*cell, "_p", "_t"]
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / TASK_PAIRS))
    return of_points.union(of_shapes).repartition(tasks, *block).sortWithinPartitions(*block, "_shape").mapInArrow(meet, schema)


def _parts(points: DataFrame, targets: DataFrame) -> tuple[list, list]:
    """(points, targets) that meet once, and those of which an id has several rows."""
    often = lambda df, key: df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    some, more = often(points, "id"), often(targets, "object_id")
    if some.isEmpty() and more.isEmpty():
        return [(points, targets)], []
    once, single = points.join(some, "id", "left_anti"), targets.join(more, "object_id", "left_anti")
    return [(once, single)], [(points.join(some, "id", "left_semi"), targets), (once, targets.join(more, "object_id", "left_semi"))]


def _types(points: DataFrame, targets: DataFrame) -> dict[str, str]:
    return {"id": points.schema["id"].dataType.simpleString(), "target_id": targets.schema["object_id"].dataType.simpleString()}


def pairs(points: DataFrame, targets: DataFrame, metres: float) -> DataFrame:
    """id, target_id of points (id, lon, lat) within ``metres`` of targets (object_id, lon, lat, or line: array of places).

    A pair of ids is told once and pairs are not shuffled, but for those of ids with several rows. Nothing holds more than a
    block's points and a step of pairs; work and rows grow with the pairs that there are.
    """
    points, targets = points.select("id", "lon", "lat"), targets.select("object_id", "lon", "lat", "line")
    schema = ", ".join(f"{c} {t}" for c, t in _types(points, targets).items())
    once, several = ([_met(*part, metres, _paired(metres), schema) for part in parts] for parts in _parts(points, targets))
    return once[0].union(reduce(DataFrame.union, several).distinct()) if several else once[0]


def counts(points: DataFrame, targets: DataFrame, metres: float, by: str = "id") -> DataFrame:
    """``by`` (id or target_id), n: with how many it stands in ``pairs``; none is no row. Pairs are told to nobody, but for those of ids with several rows."""
    points, targets = points.select("id", "lon", "lat"), targets.select("object_id", "lon", "lat", "line")
    types = _types(points, targets)
    parts, again = _parts(points, targets)
    found = [_met(*part, metres, _counted(metres, by), f"{by} {types[by]}, n long") for part in parts]
    if again:
        schema = ", ".join(f"{c} {t}" for c, t in types.items())
        found.append(reduce(DataFrame.union, (_met(*part, metres, _paired(metres), schema) for part in again)).distinct().select(by, F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.union, found).groupBy(by).agg(F.sum("n").alias("n"))
