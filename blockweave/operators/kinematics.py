"""Kinematics of trips: distances, speeds, noise, accelerations, headings, driving states, and vectors of them.

Two variants. ``vt`` removes abnormal points first and takes headings from what survives; ``da`` takes headings and
turns from all points and removes abnormal points after. In both a surviving point keeps the distance and the time
to its original predecessor.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import METHODS
from ..functions.vectors import normalised

#: 140 km/h in m/s, the least move that has a heading, and the least normal points and share.
TOP_SPEED, LEAST_MOVE, LEAST_POINTS, LEAST_SHARE = 38.9, 0.1, 5, 0.5
STATES = 6


def trip():
    return W.partitionBy("traj_id").orderBy("p")


def segments(points: DataFrame, method: str = "haversine") -> DataFrame:
    """The points with dist and dt from the one before (null for the first), speed (0 for the first) and normal."""
    w = trip()
    m = points.withColumns({"_lon": F.lag("lon").over(w), "_lat": F.lag("lat").over(w), "dt": F.col("t") - F.lag("t").over(w), "_first": F.row_number().over(w) == 1})
    m = m.withColumn("dist", METHODS[method](F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat")))
    speed = F.when(F.col("_first"), F.lit(0.0)).otherwise(F.try_divide(F.col("dist"), F.col("dt")))
    return m.withColumn("speed", speed).withColumn("normal", F.coalesce(F.col("speed") < TOP_SPEED, F.lit(False))).drop("_lon", "_lat", "_first")


def noise(seg: DataFrame) -> DataFrame:
    """(traj_id, too_much_noise) of every trip."""
    n = F.sum(F.col("normal").cast("long"))
    return seg.groupBy("traj_id").agg(((n < LEAST_POINTS) | (n / F.count("*") < LEAST_SHARE)).alias("too_much_noise"))


def without_noise(seg: DataFrame) -> DataFrame:
    """The points of trips without much noise, as ``noise`` tells; counted over the trips as they lie, with no second pass."""
    w = W.partitionBy("traj_id")
    n, every = F.sum(F.col("normal").cast("long")).over(w), F.count("*").over(w)
    m = seg.withColumns({"_n": n, "_every": every})
    return m.filter((F.col("_n") >= LEAST_POINTS) & (F.col("_n") / F.col("_every") >= LEAST_SHARE)).drop("_n", "_every")


def normal_points(seg: DataFrame) -> DataFrame:
    return seg.filter("normal").drop("normal")


def accelerations(kept: DataFrame) -> DataFrame:
    """accel: the change of speed since the surviving point before, over the point's own dt; 0 for the first."""
    w = trip()
    return kept.withColumn("accel", F.coalesce(F.try_divide(F.col("speed") - F.lag("speed").over(w), F.col("dt")), F.lit(0.0)))


def headings(points: DataFrame, variant: str = "vt") -> DataFrame:
    """angle: of the move to the next point, that of the point before where the move is too small, 0 at the start; the
    last point repeats the one before."""
    w = trip()
    dx, dy = F.lead("lon").over(w) - F.col("lon"), F.lead("lat").over(w) - F.col("lat")
    m = points.withColumns({"_dx": dx, "_dy": dy, "_move": F.lead("dist").over(w), "_last": F.lead("p").over(w).isNull()})
    theta = F.atan(F.col("_dy") / F.when(F.col("_dx") == 0, F.lit(1e-8)).otherwise(F.col("_dx")))
    if variant == "da":
        theta = F.when(F.col("_dy") < 0, math.pi + theta).otherwise(theta)
    m = m.withColumn("_theta", F.when(F.col("_move") >= LEAST_MOVE, theta))
    m = m.withColumn("angle", F.coalesce(F.last("_theta", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    return m.drop("_dx", "_dy", "_move", "_theta", "_last")


def turns(points: DataFrame, variant: str = "vt", threshold: float = 0.3) -> DataFrame:
    """angle_diff and is_turning. ``vt``: the signed change, beyond ``threshold``; ``da``: the lesser of the change and
    of 2 pi less both angles (as the model has it), beyond pi / 6."""
    before = F.lag("angle").over(trip())
    if variant == "vt":
        diff, limit = F.col("angle") - before, threshold
    else:
        diff, limit = F.least(F.abs(F.col("angle") - before), F.abs(2 * math.pi - F.col("angle") - before)), math.pi / 6
    m = points.withColumn("angle_diff", F.coalesce(diff, F.lit(0.0)))
    return m.withColumn("is_turning", F.abs("angle_diff") > limit)


def kinematics(points: DataFrame, variant: str = "vt", threshold: float = 0.3, method: str = "haversine") -> DataFrame:
    """Surviving points with every series. ``vt`` leaves trips with too much noise out."""
    seg = segments(points, method)
    if variant == "vt":
        return turns(headings(accelerations(normal_points(without_noise(seg))), "vt"), "vt", threshold)
    return accelerations(normal_points(turns(headings(seg, "da"), "da")))


def states(kin: DataFrame, threshold: float = 0.1) -> DataFrame:
    """state: 0-1 speeding up, 2-3 steady, 4-5 slowing down, the odd one of each while turning."""
    drive = F.when(F.col("accel") > threshold, 0).when(F.col("accel") < -threshold, 2).otherwise(1)
    return kin.withColumn("state", (2 * drive + F.col("is_turning").cast("int")).cast("int"))


def state_vectors(st: DataFrame) -> DataFrame:
    """(traj_id, seq_vec of 6): normalised counts of the states."""
    counts = F.array(*[F.sum((F.col("state") == i).cast("double")) for i in range(STATES)])
    return st.groupBy("traj_id").agg(counts.alias("c")).select("traj_id", normalised(F.col("c")).alias("seq_vec"))


def transitions(st: DataFrame) -> DataFrame:
    """(traj_id, src, tgt, n): how often a state follows another, itself included."""
    e = st.withColumn("tgt", F.lead("state").over(trip())).filter("tgt is not null")
    return e.groupBy("traj_id", F.col("state").alias("src"), "tgt").agg(F.count("*").alias("n"))


def graph_vectors(st: DataFrame) -> DataFrame:
    """(traj_id, graph_vec of 36) for every trip; zeros for trips of one point."""
    e = st.withColumn("_e", F.col("state") * STATES + F.lead("state").over(trip()))
    counts = F.array(*[F.coalesce(F.sum((F.col("_e") == i).cast("double")), F.lit(0.0)) for i in range(STATES * STATES)])
    return e.groupBy("traj_id").agg(counts.alias("c")).select("traj_id", normalised(F.col("c")).alias("graph_vec"))
