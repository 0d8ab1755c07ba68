"""The queries of the engine's operators: (spark, sf_dir) -> DataFrame, floats rounded to six places."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dbscan, features, grid, index, kinematics, knn, lsh, measures, profile, quantiles, trips
from .plans import sweeps
from .plans.tables import entities, points, shared_folder, shared_table, vectors
from .sources import formats

DIM = 64
EPS, MIN_SAMPLES, K = 1.15, 5, 5
HYPERPLANE = [lsh.Config(0, 2, 4, 30.0)]
PSTABLE = [lsh.Config(0, 2, 4, 1.0)]
SWEEP = [lsh.Config(i, tables, functions, w) for i, (tables, functions, w) in enumerate((t, h, w) for w in (1.0, 2.0) for t in (1, 2) for h in (2, 4))]
# The configurations of the density sweep.
SWEEP_EPS, SWEEP_LEAST = [1.0, 10.0, 100.0, 1000.0, 10000.0], [5, 10, 15, 20, 25, 30, 35, 40, 45]
# The configurations (cells a side, cells chosen) of the grid sweep.
GRID_SWEEP = [(n, k) for sizes, ks in (((100, 104), (150, 160)), ((100, 110), (125, 130)), ((200, 204), (500, 600)), ((150, 156), (180, 240))) for n in sizes for k in ks]
# The configurations (cells a side, drivers kept) of the pair sweep.
PAIR_SWEEP = [(n, k) for sizes, ks in (((100, 110, 120), (15, 18, 21)), ((14, 21, 28), (4, 5, 6))) for n in sizes for k in ks]
PROBE = [lsh.Config(0, 4, 7, 30.0)]
GRID, FINE, CELLS, TOP = grid.Grid(16), grid.Grid(40), 20, 5
SMALL = grid.Grid(16, 103.72, 103.90, 1.2077, 1.4809)

QUERIES: dict = {}


def query(f):
    """Register a query; doubles in its result are rounded to six places."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    QUERIES[f.__name__] = run
    return run


def _blocks(s, d, configs, kind):
    return lsh.blocks(vectors(s, d), lsh.planes(s, DIM, configs), kind).select("block_id", "id")


def _rounded(c, n=6):
    return F.transform(c, lambda x: F.round(x, n))


def stops(pts: DataFrame) -> DataFrame:
    """Stop points of the fixture: every fourth point of a trip."""
    return pts.filter("p % 4 = 0").select("traj_id", "lon", "lat")


def trip_entities(pts: DataFrame) -> DataFrame:
    return pts.select(F.col("traj_id").alias("id"), F.col("driver_id").alias("label")).distinct()


def pairs(pts: DataFrame) -> DataFrame:
    """Candidate pairs of the last three five-day trips: of one driver, or of neighbouring drivers in one period."""
    t = pts.select("traj_id", "driver_id").distinct().filter("traj_id % 10 >= 3")
    t = t.withColumn("b", F.col("traj_id") % 10)
    left = t.select(F.col("traj_id").alias("lid"), F.col("driver_id").alias("ld"), F.col("b").alias("lb"))
    right = t.select(F.col("traj_id").alias("rid"), F.col("driver_id").alias("rd"), F.col("b").alias("rb"))
    same = left.join(right, F.col("ld") == F.col("rd")).filter("lid < rid")
    near = left.join(right, (F.col("ld") + 1 == F.col("rd")) & (F.col("lb") == F.col("rb"))).filter("lid < rid")
    return same.union(near).select("lid", "rid", (F.col("ld") == F.col("rd")).alias("m"))


# Measures

@query
def label_freq(s, d):
    return measures.label_frequency(entities(s, d))


@query
def db_pairs(s, d):
    return measures.duplicate_pairs(entities(s, d), _blocks(s, d, HYPERPLANE, "hyperplane"))


@query
def eval_redundant(s, d):
    return measures.evaluate(entities(s, d), _blocks(s, d, HYPERPLANE, "hyperplane"))


@query
def eval_distinct(s, d):
    return measures.evaluate(entities(s, d), _blocks(s, d, HYPERPLANE, "hyperplane"), distinct=True)


@query
def lsh_hyperplane_eval(s, d):
    return measures.evaluate_variants(entities(s, d), _blocks(s, d, HYPERPLANE, "hyperplane"))


# Vector blocking

@query
def lsh_pstable_blocks(s, d):
    return _blocks(s, d, PSTABLE, "pstable")


@query
def lsh_hyperplane_blocks(s, d):
    return _blocks(s, d, HYPERPLANE, "hyperplane")


@query
def lsh_simhash_blocks(s, d):
    return _blocks(s, d, HYPERPLANE, "simhash")


@query
def lsh_index_lookup(s, d):
    """The vectors of even ids are added first, the others later; all are looked up as of either."""
    kept = index.BucketIndex(s)
    b = _blocks(s, d, HYPERPLANE, "hyperplane")
    first, second = kept.add(b.filter("id % 2 = 0")), kept.add(b.filter("id % 2 = 1"))
    return kept.lookup(b, first).withColumn("version", F.lit(first)).union(kept.lookup(b, second).withColumn("version", F.lit(second)))


@query
def lsh_sweep(s, d):
    return sweeps.lsh_sweep(vectors(s, d), entities(s, d), lsh.planes(s, DIM, SWEEP), "pstable")


@query
def vec_center(s, d):
    return lsh.centred(vectors(s, d)).select("id", F.posexplode("features").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))


@query
def knn_blocks(s, d):
    return knn.exact_blocks(vectors(s, d), K)


@query
def mplsh_blocks(s, d):
    return knn.multiprobe_blocks(lsh.centred(vectors(s, d)), lsh.planes(s, DIM, PROBE), K, 20)


@query
def knn_mplsh_eval(s, d):
    return sweeps.neighbour_comparison(vectors(s, d), entities(s, d), lsh.planes(s, DIM, PROBE), K, 20)


# Density blocking

@query
def dbscan_labels(s, d):
    return dbscan.labels(vectors(s, d), EPS, MIN_SAMPLES)


@query
def dbscan_blocks(s, d):
    return dbscan.blocks(dbscan.labels(vectors(s, d), EPS, MIN_SAMPLES))


@query
def dbscan_sizes(s, d):
    return dbscan.sizes(dbscan.labels(vectors(s, d), EPS, MIN_SAMPLES))


@query
def dbscan_sweep(s, d):
    return sweeps.dbscan_sweep(vectors(s, d), entities(s, d), [1.1, 1.15], [5, 10])


@query
def dbscan_sweep_all(s, d):
    return sweeps.dbscan_sweep(vectors(s, d), entities(s, d), SWEEP_EPS, SWEEP_LEAST)


@query
def dbscan_export(s, d):
    return formats.export_rows(vectors(s, d))


@query
def external_clusters(s, d):
    """A result of the clustering tool, made from the vectors' labels, read and scored."""
    e = entities(s, d)
    of = e.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: (i + 1).cast("string")), " ").alias("ids"))
    lines = of.select(F.lit("r").alias("file"), (2 * F.col("label") + 2).alias("line"), F.concat(F.lit("-1 "), "ids", F.lit(" 2.5")).alias("value"))
    odd = of.select(F.lit("r").alias("file"), (2 * F.col("label") + 1).alias("line"), F.lit("7 8 9").alias("value"))
    return measures.evaluate(e, formats.clusters(lines.union(odd)).select("block_id", "id"))


@query
def cluster_files(s, d):
    """Two result files of the clustering tool in one folder, the even and the odd labels, read and scored each."""
    e = entities(s, d)
    of = e.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: (i + 1).cast("string")), " ").alias("ids"))
    place, part = 2 * F.floor(F.col("label") / 2).cast("long"), (F.col("label") % 2).alias("result")
    lines = of.select(part, (place + 2).alias("line"), F.concat(F.lit("-1 "), "ids", F.lit(" 2.5")).alias("value")).union(of.select(part, (place + 1).alias("line"), F.lit("7 8 9")))
    lines = lines.union(of.select(part, F.lit(0).cast("long"), F.lit("header")).distinct())
    folder = shared_folder(s, "results")
    lines.repartition("result").sortWithinPartitions("result", "line").select("result", "value").write.partitionBy("result").text(folder)
    found = formats.read_clusters(s, folder).select(F.regexp_extract("file", "result=([0-9]+)", 1).cast("int").alias("config_id"), "block_id", "id")
    return measures.evaluate_configs(e, found)


@query
def pair_csv(s, d):
    """Pairs written as CSV and read back."""
    folder = shared_folder(s, "pairs")
    formats.write_pairs(pairs(points(s, d)), folder)
    return formats.read_pairs(s, folder)


@query
def vectors_text(s, d):
    """The vectors as text lines and back."""
    text = vectors(s, d).join(entities(s, d), "id").select(F.col("id").alias("line"), F.concat_ws(" ", F.col("label").cast("string"), F.array_join(F.transform("features", lambda x: x.cast("string")), ",")).alias("value"))
    return formats.parse_vectors(text).select("id", "label", F.posexplode("features").alias("dim", "x")).select("id", "label", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


# Grid blocking

@query
def grid_assign(s, d):
    return grid.assign(points(s, d), GRID).select("traj_id", "p", "cell_x", "cell_y")


@query
def engrid_trunc(s, d):
    return grid.truncated_cell(points(s, d), grid.Grid(16, 103.72, 103.90, 1.25, 1.45)).select("traj_id", "p", "cell_x", "cell_y")


@query
def trip_range_filter(s, d):
    return grid.trips_in_range(points(s, d), SMALL)


@query
def cell_stats(s, d):
    return grid.cell_stats(grid.cell_trips(points(s, d), GRID))


@query
def driver_cell_freq(s, d):
    return grid.driver_freq(grid.cell_trips(points(s, d), GRID))


@query
def stop_cell_freq(s, d):
    return grid.stop_freq(stops(points(s, d)), GRID)


@query
def cell_dwell(s, d):
    return grid.cell_dwell(points(s, d), GRID)


def _ranks(s, d):
    p = points(s, d)
    trips_of = shared_table(grid.cell_trips(grid.in_range(p, GRID), GRID), "cell-trips")
    return p, trips_of, grid.ranked(grid.scores(grid.cell_stats(trips_of), grid.stop_freq(stops(p), GRID)))


def _cells(s, d):
    p, trips_of, ranks = _ranks(s, d)
    return trips_of, ranks, shared_table(grid.candidates(ranks, p.select("traj_id").distinct().count()), "cells")


@query
def cell_scores(s, d):
    return _ranks(s, d)[2]


@query
def cell_candidates(s, d):
    return _cells(s, d)[2].select("cell_x", "cell_y", "rank", "n_traj")


@query
def cell_conflicts(s, d):
    t, _, c = _cells(s, d)
    return grid.conflicts(c, t)


def _top(s, d, p_accept=0.0):
    t, ranks, c = _cells(s, d)
    return t, ranks, grid.top_cells(c, grid.conflicts(c, t), CELLS, p_accept).drop("place")


@query
def grid_topk(s, d):
    return _top(s, d)[2]


@query
def grid_topk_chance(s, d):
    return _top(s, d, 0.1)[2]


@query
def grid_blocks(s, d):
    t, _, top = _top(s, d)
    return grid.cell_blocks(top, t)


@query
def grid_eval(s, d):
    t, _, top = _top(s, d)
    return measures.evaluate(trip_entities(points(s, d)), grid.cell_blocks(top, t), distinct=True)


@query
def grid_sweep(s, d):
    p = shared_table(points(s, d), "points")  # read several times
    return sweeps.grid_sweep(p, stops(p), trip_entities(p), [(16, 10), (16, 20), (40, 20)])


@query
def grid_sweep_all(s, d):
    p = shared_table(points(s, d), "points")  # read several times
    return sweeps.grid_sweep(p, stops(p), trip_entities(p), GRID_SWEEP)


@query
def cell_rank_report(s, d):
    _, ranks, top = _top(s, d)
    return grid.rank_report(ranks, top)


# Profile matching

def _train(s, d):
    p = points(s, d)
    return p, grid.in_range(p.filter("traj_id % 10 < 3"), GRID)


@query
def cell_driver_hist(s, d):
    return profile.cell_drivers(_train(s, d)[1], GRID)


@query
def cell_trip_hist(s, d):
    return profile.cell_trip_counts(_train(s, d)[1], GRID)


@query
def cell_topk_drivers(s, d):
    return profile.top_drivers(profile.cell_drivers(_train(s, d)[1], GRID), TOP)


def _profiles(s, d, g=GRID, k=TOP):
    p = points(s, d)
    train = grid.in_range(p.filter("traj_id % 10 < 3"), g)
    return p, profile.trip_profile(p, profile.top_drivers(profile.cell_drivers(train, g), k), g, k)


@query
def trip_topk_drivers(s, d):
    return _profiles(s, d)[1]


def _judged(s, d):
    p, prof = _profiles(s, d)
    return profile.judge(pairs(p), prof, TOP)


@query
def pair_judge(s, d):
    return _judged(s, d).select("lid", "rid", "m", "shared", "judged")


@query
def pair_rank_score(s, d):
    return _judged(s, d).select("lid", "rid", "rank_score")


@query
def pair_ids_union(s, d):
    return profile.pair_ids(pairs(points(s, d)))


@query
def pair_prf(s, d):
    return profile.scored(_judged(s, d))


@query
def pair_sweep(s, d):
    p = points(s, d)
    return sweeps.pair_sweep(p.filter("traj_id % 10 < 3"), p, pairs(p), [(14, 4), (16, 5), (28, 5), (28, 4)])


@query
def pair_sweep_all(s, d):
    p = points(s, d)
    return sweeps.pair_sweep(p.filter("traj_id % 10 < 3"), p, pairs(p), PAIR_SWEEP)


@query
def geo_range(s, d):
    return profile.geo_range(points(s, d), 103.7, 104.0, 1.25, 1.43)


# Kinematics

@query
def seg_distance(s, d):
    return kinematics.segments(points(s, d)).select("traj_id", "p", "dist", "dt")


@query
def seg_speed(s, d):
    return kinematics.segments(points(s, d)).select("traj_id", "p", "speed", "normal")


@query
def seg_distance_ellipsoid(s, d):
    # The formula's rounding errors reach some nanometres, so millimetres are told.
    return kinematics.segments(points(s, d), "vincenty").select("traj_id", "p", F.round("dist", 3).alias("dist"))


@query
def noise_flag(s, d):
    return kinematics.noise(kinematics.segments(points(s, d)))


@query
def noise_filtered_points(s, d):
    return kinematics.normal_points(kinematics.segments(points(s, d))).select("traj_id", "p", "dist", "dt", "speed")


@query
def accelerations(s, d):
    return kinematics.accelerations(kinematics.normal_points(kinematics.segments(points(s, d)))).select("traj_id", "p", "accel")


@query
def headings_vt(s, d):
    return kinematics.headings(kinematics.normal_points(kinematics.segments(points(s, d))), "vt").select("traj_id", "p", "angle")


@query
def headings_da(s, d):
    return kinematics.headings(kinematics.segments(points(s, d)), "da").select("traj_id", "p", "angle")


@query
def delta_theta(s, d):
    return kinematics.turns(kinematics.headings(kinematics.segments(points(s, d)), "da"), "da").select("traj_id", "p", F.col("angle_diff").alias("delta_theta"))


@query
def is_turning(s, d):
    return kinematics.kinematics(points(s, d), "vt").select("traj_id", "p", "angle_diff", "is_turning")


@query
def state_seq(s, d):
    return kinematics.states(kinematics.kinematics(points(s, d), "vt")).select("traj_id", "p", "state")


@query
def state_seq_da(s, d):
    return kinematics.states(kinematics.kinematics(points(s, d), "da")).select("traj_id", "p", "state")


def _st(s, d):
    return kinematics.states(kinematics.kinematics(points(s, d), "da"))


@query
def seq_vector(s, d):
    return kinematics.state_vectors(_st(s, d)).select("traj_id", *[F.col("seq_vec")[i].alias(f"s{i}") for i in range(6)])


@query
def transition_edges(s, d):
    return kinematics.transitions(_st(s, d))


@query
def graph_vector(s, d):
    return kinematics.graph_vectors(_st(s, d)).select("traj_id", F.posexplode("graph_vec").alias("edge", "v")).select("traj_id", F.col("edge").cast("long").alias("edge"), "v")


# Features

@query
def base_stat_speed(s, d):
    seg = kinematics.normal_points(kinematics.segments(points(s, d)))
    return seg.groupBy("traj_id").agg(*features.base_stat(seg, ["traj_id"], "speed", "speed"))


@query
def speed_quantiles(s, d):
    """Quantiles of the speeds of all points as one group, and of each driver's."""
    seg = kinematics.segments(points(s, d)).filter("speed is not null")
    every = quantiles.quantiles(seg, [], "speed", (0.0, 0.1, 0.5, 0.9, 1.0)).withColumn("driver_id", F.lit(-1).cast("long"))
    return every.unionByName(quantiles.quantiles(seg, ["driver_id"], "speed", (0.1, 0.5, 0.9)))


@query
def traj_features(s, d):
    return features.labelled(features.trip_features(points(s, d)), points(s, d))


@query
def graph_features(s, d):
    return features.graph_features(points(s, d)).select("traj_id", "too_much_noise", F.posexplode("vec").alias("k", "v")).withColumn("k", F.col("k").cast("long"))


@query
def driver_statistics(s, d):
    return features.driver_statistics(points(s, d))


@query
def driver_svm(s, d):
    p = points(s, d)
    f = features.labelled(features.graph_features(p, "da"), p)
    folder = shared_folder(s, "features")
    features.write_features(f, folder)
    return features.driver_classifier(features.read_features(s, folder))


@query
def feature_sink(s, d):
    """Feature rows of drivers written and read back."""
    p = points(s, d)
    folder = shared_folder(s, "features")
    features.write_features(features.labelled(features.graph_features(p), p), folder)
    return features.read_features(s, folder).select("traj_id", "label", F.posexplode("vec").alias("k", "v")).withColumn("k", F.col("k").cast("long"))


# Trips

@query
def speed_info(s, d):
    return trips.speed_rows(kinematics.kinematics(points(s, d)))


@query
def cell_hour_speed(s, d):
    return trips.cell_hours(kinematics.kinematics(points(s, d)), GRID)


@query
def stay_times(s, d):
    return trips.stays(kinematics.normal_points(kinematics.segments(points(s, d))), 0.4)


@query
def time_enrich(s, d):
    return trips.timed(points(s, d)).select("traj_id", "driver_id", "t0", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("date").cast("string").alias("date"), F.col("hour").cast("long").alias("hour"), "start_lon", "start_lat")


@query
def trips_per_date(s, d):
    return trips.per_date(trips.timed(points(s, d))).select(F.col("date").cast("string").alias("date"), "n")


@query
def trips_on_date(s, d):
    return trips.on_date(trips.timed(points(s, d)), 2023, 11, 16).select("traj_id", "driver_id", "t0")


@query
def trips_in_hours(s, d):
    return trips.in_hours(trips.timed(points(s, d)), 7, 9).select("traj_id", "driver_id", "t0")


@query
def trips_of_driver(s, d):
    return trips.of_driver(points(s, d), 7)


@query
def sample_trips(s, d):
    return trips.sample(trips.trips(points(s, d)), 10).select("traj_id", "driver_id")


@query
def od_counts(s, d):
    return trips.od_counts(trips.od_pairs(points(s, d), GRID))


@query
def od_driver_counts(s, d):
    return trips.od_driver_counts(trips.od_pairs(points(s, d), GRID))


@query
def od_two_drivers(s, d):
    """Trips of the first and the last driver of the most frequent origin and destination."""
    od = shared_table(trips.od_pairs(points(s, d), GRID), "od")
    top = od.groupBy("sd").agg(F.count("*").alias("n"), F.min("driver_id").alias("a"), F.max("driver_id").alias("b")).orderBy(F.desc("n"), "sd").first()
    return trips.two_drivers(od, top["sd"], top["a"], top["b"], 2, 3).select("sd", "driver_id", "traj_id")


@query
def start_centroid(s, d):
    return trips.start_centroid(points(s, d))


@query
def trip_geojson(s, d):
    return trips.geojson(points(s, d))


@query
def expanded_trips(s, d):
    """Trips packed into arrays with a start time only, and expanded again."""
    packed = formats.pack_trips(points(s, d))
    regular = packed.select("traj_id", "driver_id", "polyline", F.get("timestamps", F.lit(0)).alias("timestamp"))
    return formats.expand_trips(regular)
