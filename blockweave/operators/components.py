"""Connected components and their numbers, for many graphs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import shared_table


def components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., node, root): the least node that each node of ``nodes`` (by..., node) reaches over ``edges`` (by..., u, v), in
    either direction. Each round takes the least of the neighbours' roots and then jumps to its root; what a round makes is
    a table, so a lost executor costs no more than a round."""
    by = list(by)
    both = shared_table(edges.select(*by, "u", "v").union(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))).filter("u != v").distinct(), "edges")
    root = shared_table(nodes.select(*by, "node", F.col("node").alias("root")), "roots")
    changed = 1
    while changed:
        low = both.join(root.select(*by, F.col("node").alias("v"), F.col("root").alias("d")), [*by, "v"]).groupBy(*by, F.col("u").alias("node")).agg(F.min("d").alias("d"))
        step = root.join(low, [*by, "node"], "left").select(*by, "node", F.col("root").alias("was"), F.least("root", "d").alias("d"))
        jump = step.join(root.select(*by, F.col("node").alias("d"), F.col("root").alias("e")), [*by, "d"]).select(*by, "node", "was", F.least("d", "e").alias("root"))
        done = shared_table(jump, "roots")
        changed = done.filter("was != root").limit(1).count()
        root = done.select(*by, "node", "root")
    return root


def numbered(roots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., root, number): the place of each distinct root in their order, counted by ranges so that no task sees all of them."""
    by = list(by)
    parts = shared_table(roots.select(*by, "root").distinct().repartitionByRange(*by, "root").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*by, "range").agg(F.count("*").alias("n"))  # a row a range and graph
    before = sizes.select(*by, "range", (F.sum("n").over(W.partitionBy(*by).orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy(*by, "range").orderBy("root")) - 1
    return parts.withColumn("place", place).join(before, [*by, "range"]).select(*by, "root", (F.col("before") + F.col("place")).cast("long").alias("number"))
