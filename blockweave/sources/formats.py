"""Readers and writers of the text and array formats of the inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their number in the file, from 0.

    Spark numbers lines within a partition only. Each partition's lines of a file are counted (one small row each), and a
    running sum gives the partition's first number; files are split in order of their offset.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), "value")
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", "first", before.alias("before"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("m") - F.col("first")).alias("line"), "value")


def parse_vectors(lines: DataFrame) -> DataFrame:
    """(id, label, features) of lines (line, value): a label and numbers, by spaces or commas."""
    parts = F.filter(F.split(F.translate("value", " ", ","), ","), lambda x: x != "")
    return lines.filter(F.length(F.trim("value")) > 0).select(F.col("line").alias("id"), F.element_at(parts, 1).cast("double").cast("int").alias("label"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.cast("float")).alias("features"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(numbered_lines(spark, path))


def read_pairs(spark: SparkSession, path: str, columns: tuple[str, str] = ("ltable_id", "rtable_id")) -> DataFrame:
    """(lid, rid) of a CSV file with a header; only these columns are read."""
    return spark.read.csv(path, header=True).select(F.col(columns[0]).cast("long").alias("lid"), F.col(columns[1]).cast("long").alias("rid"))


def write_pairs(pairs: DataFrame, path: str, columns: tuple[str, str] = ("ltable_id", "rtable_id")) -> None:
    """Write (lid, rid) as CSV files with a header and an id column."""
    named = pairs.select(F.monotonically_increasing_id().alias("id"), F.col("lid").alias(columns[0]), F.col("rid").alias(columns[1]))
    named.write.mode("overwrite").csv(path, header=True)


def expand_trips(trips: DataFrame, step: int = 15) -> DataFrame:
    """Points of trips (traj_id, driver_id, polyline of [lon, lat]) with timestamps, or with a start and one point
    each ``step`` seconds."""
    each = trips.select("*", F.posexplode("polyline").alias("p", "xy"))
    t = F.get("timestamps", F.col("p")) if "timestamps" in trips.columns else F.col("timestamp") + step * F.col("p")
    return each.select("traj_id", "driver_id", "p", t.cast("long").alias("t"), F.get("xy", F.lit(0)).alias("lon"), F.get("xy", F.lit(1)).alias("lat"))


def pack_trips(points: DataFrame) -> DataFrame:
    """The inverse of ``expand_trips``: polyline and timestamps of each trip."""
    s = points.groupBy("traj_id", "driver_id").agg(F.sort_array(F.collect_list(F.struct("p", "t", "lon", "lat"))).alias("s"))
    return s.select("traj_id", "driver_id", F.transform("s", lambda x: F.array(x["lon"], x["lat"])).alias("polyline"), F.transform("s", lambda x: x["t"]).alias("timestamps"))


def stop_points(trips: DataFrame) -> DataFrame:
    """(traj_id, lon, lat) of s_point arrays, which are [lat, lon]."""
    return trips.select("traj_id", F.explode("s_point").alias("s")).select("traj_id", F.get("s", F.lit(1)).alias("lon"), F.get("s", F.lit(0)).alias("lat"))


def export_rows(vectors: DataFrame) -> DataFrame:
    """(line, value): rows of the clustering tool's input: id from 1, then (f + 1) * 5000 cut towards zero, by tabs."""
    numbers = F.transform("features", lambda x: ((x.cast("double") + 1) * 5000).cast("int").cast("string"))
    return vectors.select((F.col("id") + 1).alias("line"), F.concat_ws("\t", (F.col("id") + 1).cast("string"), F.array_join(numbers, "\t")).alias("value"))


def export(vectors: DataFrame, path: str) -> None:
    """Write the tool's input: a line with the counts of rows and dimensions, then the rows, in order of id."""
    head = vectors.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).select(F.lit(0).cast("long").alias("line"), F.concat_ws("\t", "n", "d").alias("value"))
    head.union(export_rows(vectors)).repartitionByRange("line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


def clusters(lines: DataFrame) -> DataFrame:
    """(file, block_id, id) of the tool's result (file, line, value): line 0 and odd lines are skipped, in the others
    the tokens of digits only are ids from 1."""
    even = lines.filter((F.col("line") > 0) & (F.col("line") % 2 == 0))
    return even.select("file", F.col("line").alias("block_id"), F.explode(F.split("value", " ")).alias("w")).filter(F.col("w").rlike("^[0-9]+$")).select("file", "block_id", (F.col("w").cast("long") - 1).alias("id"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Result files of a folder, told apart by ``file``."""
    return clusters(numbered_lines(spark, path))
