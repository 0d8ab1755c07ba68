"""Grids, profiles, kinematics and formats on small frames and against the fixture's known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.functions.geo import EARTH_M, vincenty_m
from blockweave.operators import features, grid, kinematics, profile, trips
from blockweave.plans.tables import points
from blockweave.sources import formats
from blockweave.streaming import stays

SF = "/root/testdata/sf0.01"


def track(spark, *rows):
    return spark.createDataFrame([(a, b, p, t, float(x), float(y)) for a, b, p, t, x, y in rows], "traj_id long, driver_id long, p int, t long, lon double, lat double")


def test_fixture(spark):
    p = points(spark, SF)
    r = p.agg(F.count("*"), F.countDistinct("traj_id"), F.countDistinct("driver_id"), F.round(F.min("lon"), 6), F.round(F.max("lat"), 6)).first()
    assert tuple(r) == (10000, 900, 150, 103.688698, 1.43615)
    seg = kinematics.segments(p).cache()
    assert kinematics.noise(seg).filter("too_much_noise").count() == 24
    assert seg.filter("normal").count() == 9284
    assert grid.cell_stats(grid.cell_trips(p, grid.Grid(100))).agg(F.count("*"), F.max("n_traj")).first()[:] == (2022, 13)
    assert grid.trips_in_range(p, grid.Grid(16, 103.72, 103.90)).count() == 550


def test_cells_at_the_edges(spark):
    g = grid.Grid(10, 0.0, 10.0, 0.0, 10.0)
    p = track(spark, (1, 1, 0, 0, 10.0, 0.0), (2, 1, 0, 0, -0.5, 3.0))
    assert [tuple(r) for r in grid.assign(p, g).orderBy("traj_id").select("cell_x", "cell_y").collect()] == [(10, 0), (-1, 3)]
    assert [tuple(r) for r in grid.truncated_cell(p, g).orderBy("traj_id").select("cell_x", "cell_y").collect()] == [(10, 0), (0, 3)]
    assert [r[0] for r in grid.trips_in_range(p, g).collect()] == [1]
    assert [r["dwell"] for r in grid.dwell(track(spark, (1, 1, 0, 5, 0, 0), (1, 1, 1, 9, 0, 0), (2, 1, 0, 5, 0, 0))).orderBy("traj_id", "p").collect()] == [4, 4, 0]


def test_top_cells_are_not_neighbours(spark):
    cells = spark.createDataFrame([(r, r, 0, 4) for r in range(1, 6)], "rank long, cell_x long, cell_y long, n_traj long")
    t = spark.createDataFrame([(r, 0, 100 * r + i, 1, 1) for r in range(1, 6) for i in range(4)], "cell_x long, cell_y long, traj_id long, driver_id long, n long")
    e = grid.conflicts(cells, t)
    assert sorted(map(tuple, e.collect())) == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert sorted(r["rank"] for r in grid.top_cells(cells, e, 5, 0.0).collect()) == [1, 3, 5]
    assert grid.top_cells(cells, e, 2, 0.0).count() == 2
    assert grid.top_cells(cells, e, 5, 1.0).count() == 5


def test_shared_trips_are_not_symmetric(spark):
    cells = spark.createDataFrame([(1, 0, 0, 10), (2, 5, 5, 4)], "rank long, cell_x long, cell_y long, n_traj long")
    t = spark.createDataFrame([(0, 0, i, 1, 1) for i in range(10)] + [(5, 5, i, 1, 1) for i in (0, 1, 2, 90)], "cell_x long, cell_y long, traj_id long, driver_id long, n long")
    assert sorted(map(tuple, grid.conflicts(cells, t).collect())) == [(1, 2)]


def test_judge_and_zero_division(spark):
    prof = spark.createDataFrame([(1, 7, 9, 1), (1, 8, 5, 2), (2, 8, 9, 1), (2, 7, 3, 2)], "traj_id long, driver_id long, total long, rank long")
    pairs = spark.createDataFrame([(1, 2, True), (1, 3, False)], "lid long, rid long, m boolean")
    r = profile.judge(pairs, prof, 2).orderBy("rid").collect()
    assert [(x["shared"], x["rank_score"], x["judged"]) for x in r] == [(2, 4, True), (0, 0, False)]
    s = profile.scored(profile.judge(pairs.filter("not m"), prof, 2)).first()
    assert s["f1_1"] == 0 and s["f1_0"] == 1
    assert profile.least_shared(20) == pytest.approx(math.sqrt(20) / 1.3)


def test_standing_still_and_jumping(spark):
    rows = [(1, 1, 0, 0, 103.8, 1.3), (1, 1, 1, 0, 103.8001, 1.3), (1, 1, 2, 15, 103.9, 1.3), (1, 1, 3, 30, 103.8001, 1.3003), (1, 1, 4, 45, 103.8001, 1.3003), (2, 1, 0, 0, 103.8, 1.3)]
    seg = kinematics.segments(track(spark, *rows))
    assert [r["normal"] for r in seg.orderBy("traj_id", "p").collect()] == [True, False, False, False, True, True]
    acc = kinematics.accelerations(kinematics.normal_points(seg)).orderBy("traj_id", "p").collect()
    assert [r["accel"] for r in acc] == [0.0, 0.0, 0.0] and acc[1]["dt"] == 15


def test_headings(spark):
    rows = [(1, 1, 0, 0, 0.0, 0.0), (1, 1, 1, 15, 0.001, 0.001), (1, 1, 2, 30, 0.001, 0.001), (1, 1, 3, 45, 0.001, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    seg = kinematics.segments(track(spark, *rows))
    angle = lambda v: [round(r["angle"], 4) for r in kinematics.headings(seg, v).orderBy("traj_id", "p").collect()]
    q, h = round(math.pi / 4, 4), round(math.atan(-0.001 / 1e-8), 4)
    assert angle("vt") == [q, q, h, h, 0.0]
    assert angle("da") == [q, q, round(math.pi + math.atan(-0.001 / 1e-8), 4)] + [round(math.pi + math.atan(-0.001 / 1e-8), 4), 0.0]


def test_vectors_of_states(spark):
    st = spark.createDataFrame([(1, p, s) for p, s in enumerate([2, 2, 0, 5])] + [(2, 0, 3)], "traj_id long, p int, state int")
    seq = {r["traj_id"]: r["seq_vec"] for r in kinematics.state_vectors(st).collect()}
    assert seq[1] == [0.5, 0, 1, 0, 0, 0.5] and seq[2] == [0, 0, 0, 1, 0, 0]
    g = {r["traj_id"]: r["graph_vec"] for r in kinematics.graph_vectors(st).collect()}
    assert [i for i, v in enumerate(g[1]) if v] == [5, 12, 14] and not any(g[2])
    both = points(spark, SF)
    s = kinematics.states(kinematics.kinematics(both, "da")).cache()
    edges = kinematics.transitions(s).groupBy("traj_id").agg(F.sum("n").alias("e"))
    assert s.groupBy("traj_id").agg(F.count("*").alias("n")).join(edges, "traj_id", "left").filter("coalesce(e, 0) != n - 1").count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)] + [(None,)], "v double")
    got = df.agg(*features.base_stat(df, [], "v", "v"), *features.base_stat(df, [], "v", "none", "v > 99")).first()
    x = np.array([1, 2, 3, 10.0])
    assert list(got)[:5] == pytest.approx([x.mean(), x.var(), *np.percentile(x, [10, 50, 90])]) and list(got)[5:] == [0.0] * 5


def test_ellipsoid_distance():
    assert vincenty_m([0.0], [0.0], [1.0], [0.0])[0] == pytest.approx(111319.4908, abs=1e-3)
    assert vincenty_m([0.0], [0.0], [0.0], [1.0])[0] == pytest.approx(110574.3886, abs=1e-3)
    assert vincenty_m([103.8], [1.3], [103.8], [1.3])[0] == 0
    assert EARTH_M == 6371008.8


def test_stays_and_hours(spark):
    p = track(spark, (1, 1, 0, 0, 0, 0), (1, 1, 1, 700, 0.01, 0), (1, 1, 2, 710, 0.01, 0), (2, 1, 0, 0, 0, 0))
    r = trips.stays(p, 10).orderBy("traj_id").collect()
    assert (r[0]["stays"], round(r[0]["hours"], 4), round(r[0]["mean_distance"])) == (1, 0.1944, 1112) and tuple(r[1])[1:] == (0, 0.0, 0.0)
    summer = trips.timed(track(spark, (1, 1, 0, 1_688_169_600, 0, 0))).first()
    assert summer["hour"] == 1 and str(summer["date"]) == "2023-07-01"
    assert trips.in_hours(trips.timed(p), 1, 1).count() == 2 and trips.on_date(trips.timed(p), 1970, 1, 1).count() == 2
    od = trips.od_pairs(p, grid.Grid(10, 0, 1, 0, 1))
    assert trips.two_drivers(od, "0_0_0_0", 1, 2, 1, 1).count() == 1


def test_text_formats(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 0.5,-1 2\n1 1 2 3\n")
    v = formats.read_vectors(spark, str(tmp_path / "v.txt")).orderBy("id").collect()
    assert [(r["id"], r["label"], list(r["features"])) for r in v] == [(0, 3, [0.5, -1.0, 2.0]), (1, 1, [1.0, 2.0, 3.0])]
    formats.export(spark.createDataFrame([(i, [-1.2, 0.5]) for i in range(40)], "id long, features array<float>"), str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part*")) for x in f.read_text().splitlines()]
    assert lines[0] == "40\t2" and lines[1] == "1\t-1000\t7500" and len(lines) == 41
    (tmp_path / "r").mkdir()
    for k in (1, 2):
        (tmp_path / "r" / f"{k}.txt").write_text("head\n1 2\n" + "1 3 -1 2.5 x\n9\n" * k)
    c = formats.read_clusters(spark, str(tmp_path / "r"))
    assert sorted((r["file"][-5], r["block_id"], r["id"]) for r in c.collect()) == [("1", 2, 0), ("1", 2, 2), ("2", 2, 0), ("2", 2, 2), ("2", 4, 0), ("2", 4, 2)]
    (tmp_path / "p.csv").write_text("id,ltable_id,rtable_id\n0,5,6\n")
    assert tuple(formats.read_pairs(spark, str(tmp_path / "p.csv")).first()) == (5, 6)


def test_lines_are_numbered_across_partitions(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = formats.numbered_lines(spark, str(tmp_path / "big.txt"))
        assert df.rdd.getNumPartitions() >= 1 and df.filter("line != cast(value as long)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stop_points_and_restriction(spark):
    t = spark.createDataFrame([(1, [[1.3, 103.8], [1.4, 103.9]])], "traj_id long, s_point array<array<double>>")
    assert [(r["lon"], r["lat"]) for r in formats.stop_points(t).collect()] == [(103.8, 1.3), (103.9, 1.4)]
    p = points(spark, "/root/testdata/sf0.001")
    ids = p.select("traj_id").distinct().limit(3)
    assert grid.restricted(p, ids).select("traj_id").distinct().count() == 3 and grid.restricted(p, None) is p


def test_streamed_sessions(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 30)] + [(2, "2024-01-01 09:00:00")]
    spark.createDataFrame(rows, "driver_id long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("driver_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = stays.sessions(s).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("select * from sessions where driver_id = 1").collect()) == [1, 2]


def test_a_curved_kernel_tells_rings_apart(spark):
    import numpy as np

    from blockweave.operators import features

    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, r = rng.uniform(0, 2 * np.pi), (1.0, 3.0)[i % 2] + rng.normal() * 0.1
        rows.append((i, i % 2, [float(r * np.cos(a)), float(r * np.sin(a))]))
    df = spark.createDataFrame(rows, features.FEATURE_SCHEMA)
    got = features.driver_classifier(df).first()
    assert 60 < got["n"] < 180 and got["accuracy"] > 0.95
    assert features.driver_classifier(df, kernel="linear").first()["accuracy"] < 0.8
    assert features.driver_classifier(df.limit(0)).first()["n"] == 0


@pytest.mark.parametrize(("k", "chance"), [(5, 0.0), (40, 0.0), (40, 0.3), (1000, 0.1)])
def test_top_cells_equal_a_scan(spark, monkeypatch, k, chance):
    import hashlib
    import random

    monkeypatch.setattr(grid, "STRETCH", 2)
    rng = random.Random(k)
    n = 300
    edges = sorted({(a, a + rng.randint(1, 40)) for a in range(1, n) for _ in range(3)} | {(a, a + 1) for a in range(1, 60)})
    cells = spark.createDataFrame([(r, r * 7 % 31, r) for r in range(1, n + 1)], "rank long, cell_x long, cell_y long")
    lucky = lambda r: int(hashlib.md5(f"10086:{r * 7 % 31}:{r}".encode()).hexdigest()[:8], 16) / 2**32 < chance
    chosen = []
    for r in range(1, n + 1):
        if len(chosen) < k and (lucky(r) or not any((c, r) in set(edges) for c in chosen)):
            chosen.append(r)
    got = grid.top_cells(cells, spark.createDataFrame(edges, "chosen long, candidate long"), k, chance)
    assert sorted(r["rank"] for r in got.collect()) == chosen
    assert grid.top_cells(cells.limit(0), spark.createDataFrame(edges, "chosen long, candidate long"), k, chance).count() == 0


def _by_newton(x, y, ridge):
    """Weights of the squared hinge loss by Newton's steps over active sets, halved until the loss falls."""
    import numpy as np

    w = np.zeros(x.shape[1])
    loss = lambda v: ridge / 2 * v @ v + (np.maximum(1 - y * (x @ v), 0) ** 2).sum() / 2
    for _ in range(100):
        a = y * (x @ w) < 1
        to = np.linalg.solve(x[a].T @ x[a] + ridge * np.eye(len(w)), x[a].T @ y[a])
        t = 1.0
        while loss(w + t * (to - w)) > loss(w) and t > 1e-9:
            t /= 2
        if np.abs(to - w).max() < 1e-12 or t <= 1e-9:
            break
        w = w + t * (to - w)
    return w


@pytest.mark.parametrize(("block", "part"), [(256, 4096), (2, 50)])
def test_margins_equal_a_plain_solver(spark, monkeypatch, block, part):
    import numpy as np

    from blockweave.operators import margin

    monkeypatch.setattr(margin, "BLOCK", block)
    monkeypatch.setattr(margin, "PART", part)
    rng = np.random.default_rng(4)
    of = rng.integers(0, 5, 240)
    x = np.hstack([rng.normal(size=(5, 6))[of] * 1.5 + rng.normal(size=(240, 6)), np.ones((240, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r], f"c{c}") for i, (r, c) in enumerate(zip(x, of, strict=True))], "id long, x array<double>, name string")
    model = margin.weights(df, 0.5).cache()
    got = {r["name"]: np.array(r["w"]) for r in model.collect()}
    want = {f"c{c}": _by_newton(x, np.where(of == c, 1.0, -1.0), 0.5) for c in range(5)}
    assert got.keys() == want.keys() and all(np.abs(got[c] - want[c]).max() < 1e-4 for c in want)
    names = sorted(want)
    best = [names[k] for k in np.argmax(x @ np.array([want[c] for c in names]).T, axis=1)]
    told = {r["id"]: r["name"] for r in margin.predicted(df, model).collect()}
    assert [told[i] for i in range(240)] == best


def test_margins_start_near_their_minimum(spark, monkeypatch):
    import numpy as np

    from blockweave.operators import margin

    written = []
    table = margin.shared_table
    monkeypatch.setattr(margin, "shared_table", lambda df, name: written.append(name) or table(df, name))
    monkeypatch.setattr(margin, "SAMPLE", 150, raising=False)
    rng = np.random.default_rng(9)
    of = rng.integers(0, 12, 300)
    x = np.hstack([rng.normal(size=(12, 8))[of] + rng.normal(size=(300, 8)), np.ones((300, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r], f"c{c}") for i, (r, c) in enumerate(zip(x, of, strict=True))], "id long, x array<double>, name string").cache()
    got = {r["name"]: np.array(r["w"]) for r in margin.weights(df).collect()}
    assert all(np.abs(got[f"c{c}"] - _by_newton(x, np.where(of == c, 1.0, -1.0), 1.0)).max() < 1e-6 for c in range(12))
    monkeypatch.setattr(margin, "SAMPLE", 300, raising=False)
    written.clear()
    margin.weights(df)
    assert len(written) <= 3  # a start from all rows needs no more than the rounds that tell it done


def test_margins_send_no_sums(spark, monkeypatch):
    import numpy as np

    from blockweave.operators import margin

    plans = []
    table = margin.shared_table
    monkeypatch.setattr(margin, "shared_table", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or table(df, name))
    monkeypatch.setattr(margin, "BLOCK", 2)
    monkeypatch.setattr(margin, "SAMPLE", 20)
    rng = np.random.default_rng(3)
    of = rng.integers(0, 12, 200)
    x = rng.normal(size=(12, 3))[of] + rng.normal(size=(200, 3))
    lift = lambda m: np.hstack([m, m**2, np.ones((len(m), 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r], f"c{c}") for i, (r, c) in enumerate(zip(x, of, strict=True))], "id long, x array<double>, name string").cache()
    # Where there are blocks for all cores, the matrices of classes stay in their tasks.
    model = margin.weights(df, lift=lift).cache()
    assert len(plans) > 1 and not any("sums" in p for p in plans)
    # Rows are sent as they are and mapped where they are used.
    got = {r["name"]: np.array(r["w"]) for r in model.collect()}
    want = {f"c{c}": _by_newton(lift(x), np.where(of == c, 1.0, -1.0), 1.0) for c in range(12)}
    assert got.keys() == want.keys() and all(np.abs(got[c] - want[c]).max() < 1e-6 for c in want)
    names = sorted(want)
    best = [names[k] for k in np.argmax(lift(x) @ np.array([want[c] for c in names]).T, axis=1)]
    told = {r["id"]: r["name"] for r in margin.predicted(df, model, lift).collect()}
    assert [told[i] for i in range(200)] == best


def test_driver_svm_golden_value(spark):
    from blockweave import queries

    r = queries.QUERIES["driver_svm"](spark, "/root/testdata/sf0.001").first()
    assert r["n"] > 10 and 0 <= r["accuracy"] <= 1


def test_quantiles_over_ranges(spark):
    from blockweave.operators.quantiles import quantiles

    rng = np.random.default_rng(6)
    rows = [(int(g), None if rng.random() < 0.1 else float(v)) for g, v in zip(rng.integers(0, 4, 3000) ** 2 % 5, np.round(rng.normal(size=3000), 1), strict=True)] + [(7, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(6)
    points = (0.0, 0.1, 0.33, 0.5, 0.9, 1.0)
    for keys in ([], ["g"]):
        got = {(r["g"] if keys else 0, r["q"]): (r["n"], r["value"]) for r in quantiles(df, keys, "v", points).collect()}
        groups = {}
        for g, v in rows:
            if v is not None:
                groups.setdefault(g if keys else 0, []).append(v)
        assert got.keys() == {(g, q) for g in groups for q in points}
        assert all(got[g, q][0] == len(x) and abs(got[g, q][1] - np.quantile(x, q)) < 1e-9 for g, x in groups.items() for q in points)
    assert quantiles(df.limit(0), ["g"], "v", points).count() == 0


def test_speeds_come_from_one_pass(spark):
    from blockweave import queries

    df = queries.QUERIES["speed_info"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Join" not in plan and "Union" not in plan


def test_profiles_of_all_are_those_of_each(spark, tmp_path):
    from blockweave import queries
    from blockweave.operators import profile
    from blockweave.plans import sweeps
    from blockweave.plans.tables import points

    p = points(spark, "/root/testdata/sf0.001")
    train, pairs, configs = p.filter("traj_id % 10 < 3"), queries.pairs(p), [(14, 4), (14, 2), (28, 5)]
    got = {(r["cells"], r["k"]): r for r in sweeps.pair_sweep(train, p, pairs, configs).collect()}
    assert got.keys() == set(configs)
    for n, k in configs:
        g = grid.Grid(n)
        prof = profile.trip_profile(p, profile.top_drivers(profile.cell_drivers(grid.in_range(train, g), g), k), g, k)
        assert profile.scored(profile.judge(pairs, prof, k)).first().asDict() == {c: v for c, v in got[n, k].asDict().items() if c not in ("cells", "k")}
    # One row a trip meets the pairs, whatever the number of configurations.
    ids = profile.pair_ids(pairs)
    hist = grid.assign_all(train, [grid.Grid(n) for n in (14, 28)]).groupBy("cells", "cell_x", "cell_y", "driver_id").count().withColumnRenamed("count", "n")
    found = profile.profiles_of_all(hist, p, ids, configs)
    assert found.count() <= ids.count() and all(len(r["own"]) == 3 for r in found.collect())


def test_conflicts_are_found_for_the_ranks_looked_at(spark, monkeypatch):
    monkeypatch.setattr(grid, "STRETCH", 2)
    n = 400
    cells = spark.createDataFrame([(b, r, r, 0, 3 * b) for b in (1, 2) for r in range(1, n + 1)], "b int, rank long, cell_x long, cell_y long, most int")
    every = spark.createDataFrame([(b, r, r + 1) for b in (1, 2) for r in range(1, n)], "b int, chosen long, candidate long")
    seen = []

    def edges(looked_at):
        seen.append({r["b"]: r["n"] for r in looked_at.groupBy("b").count().withColumnRenamed("count", "n").collect()})
        return every

    got = grid.top_cells(cells, edges, "most", 0.0, by=["b"]).collect()
    assert sorted((r["b"], r["rank"]) for r in got) == [(1, 1), (1, 3), (1, 5)] + [(2, r) for r in range(1, 12, 2)]
    assert seen == [{1: 6, 2: 12}]
