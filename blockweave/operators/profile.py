"""Matching pairs of trips by the drivers who use their cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Grid, assign, assign_all

#: Trips of a task that finds profiles for many configurations; entries of the cells' top drivers that every worker may hold.
TRIPS, HELD = 2048, 4_000_000


def cell_drivers(points: DataFrame, grid: Grid) -> DataFrame:
    """(cell_x, cell_y, driver_id, n): points of each driver in each cell."""
    return assign(points, grid).groupBy("cell_x", "cell_y", "driver_id").agg(F.count("*").alias("n"))


def cell_trip_counts(points: DataFrame, grid: Grid) -> DataFrame:
    return assign(points, grid).groupBy("cell_x", "cell_y", "traj_id").agg(F.count("*").alias("n"))


# Operators below work on several configurations at once if ``by`` names the columns that tell them apart; ``k`` may be a column.

def top_drivers(hist: DataFrame, k: int | str = 10, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` drivers with most points in each cell, ties by driver."""
    w = W.partitionBy(*by, "cell_x", "cell_y").orderBy(F.desc("n"), "driver_id")
    return hist.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= _k(k))


def _k(k: int | str) -> Column:
    return F.col(k) if isinstance(k, str) else F.lit(k)


def trip_profile(points: DataFrame, tops: DataFrame, grid: Grid, k: int = 10) -> DataFrame:
    """(traj_id, driver_id, total, rank): for every point of a trip its cell's top drivers with their counts, summed,
    and the ``k`` largest. Points are counted by cell before the join."""
    return profiles(trip_cells(assign(points, grid)), tops, k)


def trip_cells(assigned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return assigned.groupBy(*by, "traj_id", "cell_x", "cell_y").agg(F.count("*").alias("times"))


def profiles(cells: DataFrame, tops: DataFrame, k: int | str = 10, by: Sequence[str] = ()) -> DataFrame:
    """``trip_profile`` from points counted by cell; of ``by``, the cells have the columns that tell grids apart."""
    on = [*[c for c in by if c in cells.columns], "cell_x", "cell_y"]
    t = cells.join(tops.select(*by, "cell_x", "cell_y", "driver_id", "n"), on)
    t = t.groupBy(*by, "traj_id", "driver_id").agg(F.sum(F.col("times") * F.col("n")).alias("total"))
    w = W.partitionBy(*by, "traj_id").orderBy(F.desc("total"), "driver_id")
    return t.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= _k(k))


def profiles_of_all(hist: DataFrame, points: DataFrame, ids: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """(traj_id, own): of each trip of ``ids`` (a table of distinct traj_id) its profile for each (cells a side, k), the drivers
    by rank, from ``hist`` (cells, cell_x, cell_y, driver_id, n). Points are dealt by trip before they meet the grids, and the
    cells' top drivers, as many as the grids have room for, go to the trips, so what is shuffled does not follow the
    configurations."""
    most = {n: max(k for m, k in configs if m == n) for n, _ in configs}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("cells"))
    top = F.transform(F.sort_array(F.collect_list(F.struct("rank", "driver_id", "n"))), lambda x: F.struct(x["driver_id"].alias("driver_id"), x["n"].alias("n")))
    tops = top_drivers(hist, max(most.values()), ["cells"]).filter(F.col("rank") <= limit).groupBy("cells", "cell_x", "cell_y").agg(top.alias("top"))
    if sum((n + 1) ** 2 * k for n, k in most.items()) <= HELD:
        tops = F.broadcast(tops)
    parts = max(1, -(-ids.count() // TRIPS))
    dealt = points.select("traj_id", "lon", "lat").repartition(parts, "traj_id").join(ids, "traj_id", "left_semi")
    cells = trip_cells(assign_all(dealt, [Grid(n) for n in most]), ["cells"]).join(tops, ["cells", "cell_x", "cell_y"])
    items = cells.groupBy("traj_id").agg(F.collect_list(F.struct("cells", "times", "top")).alias("items"))
    return items.mapInArrow(_profiled(configs), "traj_id long, own array<array<long>>")


def _profiled(configs: list[tuple[int, int]]):
    def run(batches):
        for b in batches:
            items = b["items"].flatten()
            tops = pc.struct_field(items, "top")
            size = np.asarray(pc.list_value_length(tops))
            row = np.repeat(np.repeat(np.arange(len(b)), np.asarray(pc.list_value_length(b["items"]))), size)
            cells, times = (np.repeat(np.asarray(pc.struct_field(items, c)), size) for c in ("cells", "times"))
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            driver, n = (np.asarray(pc.struct_field(tops.flatten(), c)) for c in ("driver_id", "n"))
            count, found = np.zeros((len(b), len(configs)), np.int64), []
            for c, (side, k) in enumerate(configs):
                m = np.flatnonzero((cells == side) & (place < k))
                m = m[np.lexsort((driver[m], row[m]))]
                r, d, total = row[m], driver[m], times[m] * n[m]
                first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (d[1:] != d[:-1])][: len(m)])
                total = np.add.reduceat(total, first) if len(m) else total
                r, d = r[first], d[first]
                o = np.lexsort((d, -total, r))
                r, d = r[o], d[o]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                r, d, rank = r[rank < k], d[rank < k], rank[rank < k]
                count[:, c] = np.bincount(r, minlength=len(b))
                found.append((r, np.full(len(r), c), rank, d))
            r, c, rank, d = (np.concatenate(x) for x in zip(*found, strict=True))
            inner = pa.ListArray.from_arrays(pa.array(np.r_[0, count.ravel().cumsum()], pa.int32()), pa.array(d[np.lexsort((rank, c, r))], pa.int64()))
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * len(configs), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([b["traj_id"], own], ["traj_id", "own"])

    return run


def judged_of_all(pairs: DataFrame, profiles: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """(cells, k, m, judged): each pair by the profiles (traj_id, own) of each configuration."""
    left, right = (profiles.select(F.col("traj_id").alias(i), F.col("own").alias(f"_{i}")) for i in ("lid", "rid"))
    both = pairs.select("lid", "rid", "m").join(left, "lid", "left").join(right, "rid", "left")
    shared = lambda i: F.coalesce(F.when(F.col("_lid").isNotNull() & F.col("_rid").isNotNull(), F.size(F.array_intersect(F.col("_lid")[i], F.col("_rid")[i]))), F.lit(0))
    each = [F.struct(F.lit(n).alias("cells"), F.lit(k).cast("long").alias("k"), (shared(i) > least_shared(k)).alias("judged")) for i, (n, k) in enumerate(configs)]
    return both.select("m", F.explode(F.array(*each)).alias("_c")).select("_c.*", "m")


def least_shared(k: int) -> float:
    """How many drivers two trips are to share more than, to be judged one driver's."""
    return k / 2 if k < 20 else math.sqrt(k) / 1.3


def judge(pairs: DataFrame, profiles: DataFrame, k: int | str = 10, by: Sequence[str] = ()) -> DataFrame:
    """The pairs (by..., lid, rid, ...) with shared (drivers in both profiles), rank_score and judged."""
    own = profiles.select(*by, "traj_id", "driver_id", "rank")
    size = own.groupBy(*by, "traj_id").agg(F.max("rank").alias("size"))
    own = own.join(size, [*by, "traj_id"])
    left = own.select(*by, F.col("traj_id").alias("lid"), "driver_id", (F.col("size") - F.col("rank") + 1).alias("a"))
    right = own.select(*by, F.col("traj_id").alias("rid"), "driver_id", (F.col("size") - F.col("rank") + 1).alias("b"))
    ids = pairs.select(*by, "lid", "rid").distinct()
    both = ids.join(left, [*by, "lid"]).join(right, [*by, "rid", "driver_id"]).groupBy(*by, "lid", "rid").agg(F.count("*").alias("shared"), F.sum(F.col("a") * F.col("b")).alias("rank_score"))
    out = pairs.join(both, [*by, "lid", "rid"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("shared", "rank_score")})
    least = F.when(F.col(k) < 20, F.col(k) / 2).otherwise(F.sqrt(F.col(k)) / 1.3) if isinstance(k, str) else F.lit(least_shared(k))
    return out.withColumn("judged", F.col("shared") > least)


def pair_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("lid").alias("traj_id")).union(pairs.select(F.col("rid").alias("traj_id"))).distinct()


def scored(judged: DataFrame, truth: str = "m", by: Sequence[str] = ()) -> DataFrame:
    """One row for each of ``by``: precision, recall and F1 of both classes and the counts of positives; 0 where nothing is to divide."""
    hit = lambda a, b: F.sum(((F.col(truth) == F.lit(a)) & (F.col("judged") == F.lit(b))).cast("long"))
    r = judged.groupBy(*by).agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"), hit(False, False).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return r.select(
        *by, ratio(tp, tp + fp).alias("precision_1"), ratio(tp, tp + fn).alias("recall_1"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_1"),
        ratio(tn, tn + fn).alias("precision_0"), ratio(tn, tn + fp).alias("recall_0"), ratio(2 * tn, 2 * tn + fp + fn).alias("f1_0"),
        (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tp") + F.col("fp")).alias("judged_positives"),
    )


def geo_range(points: DataFrame, lon_above: float = 101.0, lon_below: float = 105.0, lat_above: float = 1.1, lat_below: float = 1.5) -> DataFrame:
    """One row with the range of trips whose own extremes pass the guards against outliers."""
    e = points.groupBy("traj_id").agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"))
    return e.agg(
        F.min(F.when(F.col("a") > lon_above, F.col("a"))).alias("lon_min"),
        F.max(F.when(F.col("b") < lon_below, F.col("b"))).alias("lon_max"),
        F.min(F.when(F.col("c") > lat_above, F.col("c"))).alias("lat_min"),
        F.max(F.when(F.col("d") < lat_below, F.col("d"))).alias("lat_max"),
    )
