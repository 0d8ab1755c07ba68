"""Views of trips: time, stays, origins and destinations, hours, samples and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import METHODS
from .grid import Grid, assign
from .kinematics import trip


def trips(points: DataFrame) -> DataFrame:
    """A row a trip: driver, first time, ends and number of points."""
    return points.groupBy("traj_id", "driver_id").agg(
        F.min("t").alias("t0"), F.count("*").alias("n"), *[f(c, "p").alias(f"{n}_{c}") for n, f in (("start", F.min_by), ("end", F.max_by)) for c in ("lon", "lat")]
    )


def timed(points: DataFrame, tz: str = "Europe/Lisbon") -> DataFrame:
    """The trips with time, date and hour of their first point in ``tz``, whatever the session's zone."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, t0)")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    return trips(points).withColumn("time", local).withColumns({"date": F.to_date("time"), "hour": F.hour("time")})


def per_date(timed_trips: DataFrame) -> DataFrame:
    return timed_trips.groupBy("date").agg(F.count("*").alias("n"))


def on_date(timed_trips: DataFrame, year: int, month: int, day: int) -> DataFrame:
    return timed_trips.filter(F.col("date") == F.make_date(F.lit(year), F.lit(month), F.lit(day)))


def in_hours(timed_trips: DataFrame, first: int, last: int) -> DataFrame:
    """Trips that start in hours ``first`` to ``last``, both included."""
    return timed_trips.filter(F.col("hour").between(first, last))


def of_driver(points: DataFrame, driver_id: int) -> DataFrame:
    return points.filter(F.col("driver_id") == driver_id)


def sample(df: DataFrame, most: int, seed: int = 1, key: str = "traj_id") -> DataFrame:
    """``most`` rows without replacement, the same for the same seed: those with the least digest of ``key`` and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(most)


def od_pairs(points: DataFrame, grid: Grid) -> DataFrame:
    """The trips with sd: start and end cell."""
    t = trips(points)
    cells = [grid.x(F.col("start_lon")), grid.y(F.col("start_lat")), grid.x(F.col("end_lon")), grid.y(F.col("end_lat"))]
    return t.withColumn("sd", F.concat_ws("_", *[c.cast("string") for c in cells]))


def od_counts(od: DataFrame) -> DataFrame:
    return od.groupBy("sd").agg(F.count("*").alias("n"))


def od_driver_counts(od: DataFrame) -> DataFrame:
    return od.groupBy("sd", "driver_id").agg(F.count("*").alias("n"))


def two_drivers(od: DataFrame, sd: str, a: int, b: int, most_a: int, most_b: int) -> DataFrame:
    """Up to so many trips of each of two drivers on one origin and destination."""
    here = od.filter(F.col("sd") == sd)
    return sample(here.filter(F.col("driver_id") == a), most_a).union(sample(here.filter(F.col("driver_id") == b), most_b))


def stays(points: DataFrame, mins: float, method: str = "haversine") -> DataFrame:
    """Of each trip the gaps of more than ``mins`` minutes: their number, hours and mean distance (0 without gaps)."""
    w = trip()
    g = points.withColumns({"gap": F.lead("t").over(w) - F.col("t"), "_d": METHODS[method](F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w))})
    long = F.col("gap") > mins * 60
    return g.groupBy("traj_id").agg(
        F.sum(F.coalesce(long, F.lit(False)).cast("long")).alias("stays"),
        (F.coalesce(F.sum(F.when(long, F.col("gap"))), F.lit(0)) / 3600.0).alias("hours"),
        F.coalesce(F.avg(F.when(long, F.col("_d"))), F.lit(0.0)).alias("mean_distance"),
    )


def speed_info(kin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traj_id, speed, t) of all points, and of turning points."""
    s = kin.select("traj_id", "p", "speed", "t")
    return s, kin.filter("is_turning").select("traj_id", "p", "speed", "t")


def speed_rows(kin: DataFrame) -> DataFrame:
    """Both of ``speed_info`` in one pass: a row of a turning point twice, ``turning`` telling which it is of."""
    both = F.when(F.col("is_turning"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return kin.select("traj_id", "p", "speed", "t", F.explode(both).alias("turning"))


def cell_hours(kin: DataFrame, grid: Grid) -> DataFrame:
    """Mean and population variance of speed and turning speed for each cell and each of 24 hours (of UTC); null for none."""
    k = assign(kin, grid).withColumn("hour", F.floor(F.pmod("t", F.lit(86400)) / 3600).cast("int"))
    turning = F.when(F.col("is_turning"), F.col("speed"))
    stats = k.groupBy("cell_x", "cell_y", "hour").agg(F.avg("speed").alias("speed_mean"), F.var_pop("speed").alias("speed_var"), F.avg(turning).alias("turn_mean"), F.var_pop(turning).alias("turn_var"))
    spine = stats.select("cell_x", "cell_y").distinct().select("cell_x", "cell_y", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return spine.join(stats, ["cell_x", "cell_y", "hour"], "left")


def start_centroid(points: DataFrame) -> DataFrame:
    return trips(points).agg(F.avg("start_lon").alias("lon"), F.avg("start_lat").alias("lat"))


def geojson(points: DataFrame) -> DataFrame:
    """A line feature a trip, as text: what a map draws."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("p", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"]))
    g = points.groupBy("traj_id", "driver_id").agg(line.alias("line"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates")).alias("geometry"), F.struct("traj_id", "driver_id").alias("properties"))
    return g.select("traj_id", F.to_json(feature).alias("feature"))


def latest(points: DataFrame) -> DataFrame:
    return points.withColumn("_r", F.row_number().over(W.partitionBy("traj_id").orderBy(F.desc("p")))).filter("_r = 1").drop("_r")
