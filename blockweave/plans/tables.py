"""Tables, the shared folder, and fixtures that several plans read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` as the session has it.

    A session on one machine (a local master, as in tests) that names none gets a temporary folder; a cluster that
    names none is refused, since its executors could not read each other's tables.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="blockweave-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(made)
        folder = sc.getCheckpointDir()
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; what is written there is removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def shared_table(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and a lost executor does not lose it. Results may read
    it as long as the application lives; with its end the table is removed."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory points (traj_id, driver_id, p, t, lon, lat) made from events by integer arithmetic: a trip is five
    days of a user, a step is a hash of the event's number, errors jump by 0.06 degrees."""
    e = read(spark, sf_dir, "events")
    b = F.floor((F.dayofmonth("ts") - 1) / 5).cast("long")
    n = F.col("event_id")
    e = e.select("event_id", "user_id", "ts", b.alias("b"), ((n * 7919) % 6001 - 3000).alias("dx"), ((n * 104729) % 6001 - 3000).alias("dy"), F.when((F.col("event_type") == "error") & (n % 5 == 0), 60000).otherwise(0).alias("spike"))
    w = W.partitionBy("user_id", "b").orderBy("ts", "event_id")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    u = F.col("user_id")
    s = e.select("user_id", "b", (F.row_number().over(w) - 1).alias("p"), F.sum("dx").over(run).alias("x"), F.sum("dy").over(run).alias("y"), "spike")
    traj = u * 10 + F.col("b")
    return s.select(
        traj.alias("traj_id"),
        u.alias("driver_id"),
        "p",
        (F.lit(1700000000) + traj * 3600 + 15 * F.col("p")).alias("t"),
        ((F.lit(103700000) + ((u * 37) % 100) * 2500 + F.col("x") + F.col("spike")) / 1e6).alias("lon"),
        ((F.lit(1250000) + ((u * 61) % 100) * 1800 + F.col("y")) / 1e6).alias("lat"),
    )
