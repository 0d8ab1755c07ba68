"""Exact quantiles of groups of any size.

Values are sorted by ranges of (group, value), and a value's rank counts on from the ranges before its own, so that a group
of all rows is no task's alone; only the two values around each wanted place are kept. ``percentile``, which holds a
group's distinct values in one buffer, suits groups that are small, such as a trip's points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import shared_table


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """(keys..., n, q, value): for each group and each of ``points`` the value at place q * (n - 1) of its sorted values,
    interpolated between the neighbours. Null values do not count; a group of none has no row."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    order = [*keys, "_v"]
    at = F.monotonically_increasing_id()  # the range's number times 2 ** 33, and the place in it
    ranges = shared_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_range": F.shiftright(at, 33), "_place": at.bitwiseAND((1 << 33) - 1)}), "value-ranges")
    # A group's rows stand together in a range, so their number and first place tell the rank.
    parts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_size"), F.min("_place").alias("_first"))
    w = W.partitionBy(*keys).orderBy("_range")
    parts = parts.withColumns({"_before": F.sum("_size").over(w) - F.col("_size"), "n": F.sum("_size").over(W.partitionBy(*keys))})
    wanted = parts.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in points]))).withColumn("_at", F.col("q") * (F.col("n") - 1))
    # The ranges that hold a wanted place or the one after it, and where in them it stands.
    for_ends = F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank")
    wanted = wanted.select(*keys, "_range", "_first", "_size", "_before", "n", "q", "_at", for_ends)
    wanted = wanted.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))).withColumn("_place", F.col("_first") + F.col("_rank") - F.col("_before"))
    wanted = wanted.select(F.col("_range").alias("_r"), F.col("_place").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", "q", "_at", "_rank")
    found = ranges.select("_range", "_place", "_v").join(wanted, (F.col("_range") == F.col("_r")) & (F.col("_place") == F.col("_p")))
    share = 1 - F.abs(F.col("_at") - F.col("_rank"))
    return found.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n", "q").agg(F.sum(F.col("_v") * share).alias("value"))
