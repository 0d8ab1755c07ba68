"""Runs over many configurations as one plan, the configuration a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dbscan, grid, knn, lsh, measures, profile
from .tables import shared_table


def lsh_sweep(vectors: DataFrame, entities: DataFrame, planes: DataFrame, kind: str = "pstable") -> DataFrame:
    """A row of redundant measures for each configuration of the planes."""
    return measures.evaluate_configs(entities, lsh.blocks(vectors, planes, kind))


def neighbour_comparison(vectors: DataFrame, entities: DataFrame, planes: DataFrame, k: int = 10, probes: int = 20) -> DataFrame:
    """Exact and multi-probe neighbours, one row of measures each."""
    exact = measures.evaluate(entities, knn.exact_blocks(vectors, k)).withColumn("method", F.lit("exact"))
    probed = measures.evaluate(entities, knn.multiprobe_blocks(lsh.centred(vectors), planes, k, probes)).withColumn("method", F.lit("multiprobe"))
    return exact.union(probed)


def dbscan_sweep(vectors: DataFrame, entities: DataFrame, eps: list[float], min_samples: list[int]) -> DataFrame:
    """Measures of each (eps, min_samples), the labels of all of them from one sweep."""
    labelled = dbscan.sweep(vectors, eps, min_samples)
    name = F.element_at(F.create_map(*[F.lit(x) for e in eps for x in (float(e), f"{e:g}")]), F.col("eps"))
    return measures.evaluate_configs(entities, labelled.select(F.concat_ws("/", name, F.col("m").cast("string")).alias("config_id"), F.col("cluster").alias("block_id"), "id"))


def grid_sweep(points: DataFrame, stops: DataFrame, entities: DataFrame, configs: list[tuple[int, int]], p_accept: float = 0.0) -> DataFrame:
    """Distinct measures of each (cells a side, k), all grids from one scan of the points."""
    ks: dict[int, list[int]] = {}
    for cells, k in configs:
        ks.setdefault(cells, []).append(k)
    blocks = grid.select_blocks_of_all(points, stops, [grid.Grid(n) for n in ks], ks, entities.count(), p_accept=p_accept)
    config = F.struct(F.col("cells").cast("long").alias("cells"), "k")
    found = measures.evaluate_configs(entities, blocks.select(config.alias("config"), "block_id", "id"), "config", distinct=True).select("config.*", *measures.RESULT)
    every = points.sparkSession.createDataFrame(configs, "cells long, k long")  # the caller's list
    return every.join(found, ["cells", "k"], "left").select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in measures.RESULT], "cells", "k")


def pair_sweep(train: DataFrame, points: DataFrame, pairs: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """Precision, recall and F1 of each (cells a side, k): one scan of the trips for all grids, the configuration a column."""
    grids, by = [grid.Grid(n) for n in dict.fromkeys(n for n, _ in configs)], ["cells", "k"]
    hist = grid.assign_all(grid.in_range(train, grids[0]), grids).groupBy("cells", "cell_x", "cell_y", "driver_id").agg(F.count("*").alias("n"))
    found = shared_table(profile.profiles_of_all(hist, points, shared_table(profile.pair_ids(pairs), "asked-trips"), configs), "profiles")
    return profile.scored(profile.judged_of_all(pairs, found, configs), by=by).withColumn("cells", F.col("cells").cast("long"))
