"""Spatial-grid blocking: cells, their statistics and scores, the diversified top cells, and their trips as blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import shared_table


@dataclass(frozen=True)
class Grid:
    """``n`` by ``n`` cells over a range in degrees. The default range is a fixed value: an island city."""

    n: int
    lon_min: float = 103.5997
    lon_max: float = 104.0907
    lat_min: float = 1.2077
    lat_max: float = 1.4809

    @property
    def gap_x(self) -> float:
        return (self.lon_max - self.lon_min) / self.n

    @property
    def gap_y(self) -> float:
        return (self.lat_max - self.lat_min) / self.n

    def x(self, lon: Column) -> Column:
        return F.floor((lon - self.lon_min) / self.gap_x).cast("long")

    def y(self, lat: Column) -> Column:
        return F.floor((lat - self.lat_min) / self.gap_y).cast("long")

    def inside(self, lon: Column, lat: Column) -> Column:
        return lon.between(self.lon_min, self.lon_max) & lat.between(self.lat_min, self.lat_max)


def assign(points: DataFrame, grid: Grid) -> DataFrame:
    """The points with cell_x and cell_y; a point at the range's maximum has index ``n``."""
    return points.withColumns({"cell_x": grid.x(F.col("lon")), "cell_y": grid.y(F.col("lat"))})


def truncated_cell(points: DataFrame, grid: Grid) -> DataFrame:
    """Cells by truncation towards zero, which differs from ``assign`` below the range's minimum."""
    return points.withColumns({"cell_x": ((F.col("lon") - grid.lon_min) / grid.gap_x).cast("long"), "cell_y": ((F.col("lat") - grid.lat_min) / grid.gap_y).cast("long")})


def trips_in_range(points: DataFrame, grid: Grid) -> DataFrame:
    """Ids of trips none of whose points lies outside the range."""
    ends = points.groupBy("traj_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("lo", F.min), ("hi", F.max))])
    return ends.filter(grid.inside(F.col("lo_lon"), F.col("lo_lat")) & grid.inside(F.col("hi_lon"), F.col("hi_lat"))).select("traj_id")


def in_range(points: DataFrame, grid: Grid) -> DataFrame:
    return points.join(trips_in_range(points, grid), "traj_id", "left_semi")


def restricted(points: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Only the trips named in ``ids`` (traj_id), or all."""
    return points if ids is None else points.join(ids.select("traj_id").distinct(), "traj_id", "left_semi")


def cell_trips(points: DataFrame, grid: Grid) -> DataFrame:
    """(cell_x, cell_y, traj_id, driver_id, n): points of a trip in a cell; the base of every statistic below."""
    return assign(points, grid).groupBy("cell_x", "cell_y", "traj_id", "driver_id").agg(F.count("*").alias("n"))


def assign_all(points: DataFrame, grids: list[Grid]) -> DataFrame:
    """The points with their cell in each grid, a row a grid, ``cells`` the grid's size: one scan of the points for all."""
    each = F.array(*[F.struct(F.lit(g.n).alias("cells"), g.x(F.col("lon")).alias("cell_x"), g.y(F.col("lat")).alias("cell_y")) for g in grids])
    return points.withColumn("_cell", F.explode(each)).select(*points.columns, "_cell.*")


# Operators below work on several grids at once if ``by`` names the columns that tell them apart.

def cell_stats(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """freq and n_traj of each cell. ``trips`` has a row a trip and cell, so trips are counted without a distinct."""
    return trips.groupBy(*by, "cell_x", "cell_y").agg(F.sum("n").alias("freq"), F.count("*").alias("n_traj"))


def driver_freq(trips: DataFrame) -> DataFrame:
    return trips.groupBy("driver_id", "cell_x", "cell_y").agg(F.sum("n").alias("freq"))


def stop_freq(stops: DataFrame, grid: Grid) -> DataFrame:
    """Stop points (lat, lon) in each cell, not checked against the range."""
    return assign(stops, grid).groupBy("cell_x", "cell_y").agg(F.count("*").alias("stop_freq"))


def dwell(points: DataFrame) -> DataFrame:
    """Seconds until the next point of the trip; the last point repeats the one before, a lone point has 0."""
    w = W.partitionBy("traj_id").orderBy("p")
    return points.withColumn("dwell", F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w), F.lit(0)).cast("long"))


def cell_dwell(points: DataFrame, grid: Grid) -> DataFrame:
    return assign(dwell(points), grid).groupBy("cell_x", "cell_y").agg(F.sum("dwell").alias("dwell"))


def scores(stats: DataFrame, stops: DataFrame, alpha: float = 1.0, weight: str = "freq", by: Sequence[str] = ()) -> DataFrame:
    """freq * sqrt(1 + stop_freq) / (n_traj ** alpha + 1) of each cell."""
    s = stats.join(stops, [*by, "cell_x", "cell_y"], "left").withColumn("stop_freq", F.coalesce("stop_freq", F.lit(0)).cast("long"))
    return s.withColumn("score", F.col(weight) * F.sqrt(1 + F.col("stop_freq")) / (F.pow(F.col("n_traj").cast("double"), F.lit(alpha)) + 1))


def ranked(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells with their rank by score, ties by (x, y). There are at most ``n`` by ``n`` cells."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "cell_x", "cell_y")).cast("long"))


def candidates(ranks: DataFrame, n_entities: int, least: int = 4) -> DataFrame:
    """Cells that neither too few trips nor more than a quarter of all entities cross."""
    return ranks.filter((F.col("n_traj") <= n_entities / 4) & (F.col("n_traj") >= least))


def conflicts(cells: DataFrame, trips: DataFrame, share: float = 0.7, by: Sequence[str] = ()) -> DataFrame:
    """(chosen, candidate) ranks: pairs of cells where choosing the first makes the second a neighbour. A neighbour is
    the next cell along one axis, or one more than ``share`` of whose trips the chosen cell has too (not symmetric)."""
    c = cells.select(*by, "cell_x", "cell_y", "rank", "n_traj")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("d")
    moved = c.select(*by, F.col("rank").alias("chosen"), "cell_x", "cell_y", steps).select(*by, "chosen", (F.col("cell_x") + F.col("d.dx")).alias("cell_x"), (F.col("cell_y") + F.col("d.dy")).alias("cell_y"))
    beside = moved.join(c, [*by, "cell_x", "cell_y"]).select(*by, "chosen", F.col("rank").alias("candidate"))
    t = trips.join(c, [*by, "cell_x", "cell_y"]).select(*by, "traj_id", "rank", "n_traj")
    both = t.select(*by, "traj_id", F.col("rank").alias("chosen")).join(t.select(*by, "traj_id", F.col("rank").alias("candidate"), "n_traj"), [*by, "traj_id"]).filter("chosen != candidate")
    over = both.groupBy(*by, "chosen", "candidate", "n_traj").agg(F.count("*").alias("shared")).filter(F.col("shared") > share * F.col("n_traj")).select(*by, "chosen", "candidate")
    return beside.union(over).filter("chosen < candidate").distinct()


#: Cells of the first stretch of ranks that is decided, for each cell wanted.
STRETCH = 8


def top_cells(cells: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], k: int | str = 20, p_accept: float = 0.1, seed: int = 10086, by: Sequence[str] = ()) -> DataFrame:
    """(by..., rank, cell_x, cell_y, place): the first ``k`` cells that a scan by rank accepts: no neighbour of one accepted before, or by a chance of ``p_accept``.

    The scan is done in parallel: a cell is accepted as soon as all cells that could forbid it are refused, and refused as
    soon as one of them is accepted. Each round decides at least the first open cell, and all whose forbidders are decided.
    Ranks are taken in stretches, each twice as long as what was decided before, until ``k`` are accepted, as later ranks
    change nothing. ``k`` may name a column, the same for all cells of ``by``; ``edges`` may be a function of the cells looked
    at, so that conflicts of later ranks are not found either. Chance is a digest of the cell and ``seed``, so that it is the same on every run.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cell_x").cast("string"), F.col("cell_y").cast("string")).cast("binary"))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)
    at = F.col("rank") / (STRETCH * (F.col(k) if isinstance(k, str) else F.lit(k)))  # in first stretches
    every = shared_table(cells.select(*by, "rank", "cell_x", "cell_y", (F.col(k) if isinstance(k, str) else F.lit(k)).alias("_k"), at.alias("_at"), (u < p_accept).alias("lucky")), "ranked-cells")
    found_edges = None if callable(edges) else shared_table(edges.select(*by, "chosen", "candidate"), "conflicts")
    last = every.agg(F.max("_at").alias("r")).first()["r"] or 0

    def decide(state: DataFrame, edges: DataFrame) -> DataFrame:
        met = edges.join(state.select(*by, F.col("rank").alias("chosen"), "ok"), [*by, "chosen"]).groupBy(*by, F.col("candidate").alias("rank"))
        met = met.agg(F.max(F.coalesce("ok", F.lit(False))).alias("forbidden"), F.max(F.col("ok").isNull()).alias("waits"))
        told = F.when(F.col("forbidden"), False).when(F.coalesce("waits", F.lit(False)), F.lit(None)).otherwise(True)
        return state.join(met, [*by, "rank"], "left").select(*by, "rank", "cell_x", "cell_y", "_k", "lucky", F.coalesce("ok", told).alias("ok"))

    decided, until = every.limit(0).withColumn("ok", F.lit(True)).drop("_at"), 0
    while until < last:
        start, until = until, min(last, max(1, 2 * until))
        stretch = every.filter((F.col("_at") > start) & (F.col("_at") <= until)).drop("_at")
        met = found_edges or shared_table(edges(cells.filter(at <= until)).select(*by, "chosen", "candidate"), "conflicts")
        state = decided.unionByName(stretch.withColumn("ok", F.when(F.col("lucky"), True)))
        open_ = 1
        while open_:  # two rounds a table
            state = shared_table(decide(decide(state, met), met), "decided")
            open_ = state.filter("ok is null").limit(1).count()
        decided = state
        found = state.groupBy(*by).agg(F.count_if("ok").alias("n"), F.max("rank").alias("r"), F.max("_k").alias("k"))
        ends = every.groupBy(*by).agg(F.max("rank").alias("end"))
        short = found.join(ends, list(by)) if by else found.crossJoin(ends)  # one row each
        if not short.filter((F.col("n") < F.col("k")) & (F.col("r") < F.col("end"))).limit(1).count():
            break
    place = F.row_number().over(W.partitionBy(*by).orderBy("rank"))
    return decided.filter("ok").withColumn("place", place).filter(F.col("place") <= F.col("_k")).select(*by, "rank", "cell_x", "cell_y", "place")


def cell_blocks(chosen: DataFrame, trips: DataFrame, more_than: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(by..., block_id, id): the trips of each chosen cell that more than ``more_than`` trips cross."""
    on = [*by, "cell_x", "cell_y"]
    m = trips.join(F.broadcast(chosen.select(*on).distinct()), on).select(*by, F.concat_ws("_", "cell_x", "cell_y").alias("block_id"), F.col("traj_id").alias("id"))
    big = m.groupBy(*by, "block_id").agg(F.count("*").alias("size")).filter(F.col("size") > more_than)
    return m.join(big, [*by, "block_id"], "left_semi")


def rank_report(ranks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every ranked cell with its counts and whether it was chosen."""
    mark = chosen.select("rank", F.lit(True).alias("chosen"))
    return ranks.join(mark, "rank", "left").select(F.concat_ws("_", "cell_x", "cell_y").alias("cell"), (F.col("rank") - 1).alias("rank"), "n_traj", "freq", "stop_freq", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def select_blocks(points: DataFrame, stops: DataFrame, grid: Grid, k: int, n_entities: int, alpha: float = 1.0, p_accept: float = 0.1, seed: int = 10086) -> DataFrame:
    """Blocks of a whole run: range filter, scores, top cells and their trips."""
    trips = shared_table(cell_trips(in_range(points, grid), grid), "cell-trips")
    ranks = ranked(scores(cell_stats(trips), stop_freq(stops, grid), alpha))
    cells = shared_table(candidates(ranks, n_entities), "cells")
    return cell_blocks(top_cells(cells, conflicts(cells, trips), k, p_accept, seed), trips)


def select_blocks_of_all(points: DataFrame, stops: DataFrame, grids: list[Grid], ks: dict[int, list[int]], n_entities: int, alpha: float = 1.0, p_accept: float = 0.1, seed: int = 10086) -> DataFrame:
    """(cells, k, block_id, id): ``select_blocks`` for grids of several sizes over one range, each with the numbers of cells in
    ``ks``. The first cells of a larger number are those of a smaller one, so each grid is scanned once."""
    by = ["cells"]
    trips = shared_table(assign_all(in_range(points, grids[0]), grids).groupBy(*by, "cell_x", "cell_y", "traj_id", "driver_id").agg(F.count("*").alias("n")), "cell-trips")
    stopped = assign_all(stops, grids).groupBy(*by, "cell_x", "cell_y").agg(F.count("*").alias("stop_freq"))
    ranks = ranked(scores(cell_stats(trips, by), stopped, alpha, by=by), by)
    most = F.element_at(F.create_map(*[F.lit(x) for n, each in ks.items() for x in (n, max(each))]), F.col("cells"))
    found = shared_table(candidates(ranks, n_entities).withColumn("most", most), "cells")
    top = top_cells(found, lambda looked_at: conflicts(looked_at, trips, by=by), "most", p_accept, seed, by)
    wanted = points.sparkSession.createDataFrame([(n, k) for n, each in ks.items() for k in each], "cells int, k long")  # the caller's list
    chosen = shared_table(top.join(F.broadcast(wanted), "cells").filter("place <= k"), "chosen")
    # A trip and cell is met once for each k that chose the cell.
    blocks = trips.join(chosen.select("cells", "k", "cell_x", "cell_y"), ["cells", "cell_x", "cell_y"]).select("cells", "k", F.concat_ws("_", "cell_x", "cell_y").alias("block_id"), F.col("traj_id").alias("id"))
    big = blocks.groupBy("cells", "k", "block_id").agg(F.count("*").alias("size")).filter("size > 2")
    return blocks.join(big, ["cells", "k", "block_id"], "left_semi")
