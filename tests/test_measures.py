"""Measures, hashing, neighbours and clusters: small frames, golden values and properties."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from blockweave import queries
from blockweave.operators import cells, dbscan, knn, lsh, measures
from blockweave.plans.tables import entities, vectors

SF = "/root/testdata/sf0.01"


def frames(spark, labels, blocks):
    e = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "id long, label long")
    b = spark.createDataFrame([(k, i) for k, ids in enumerate(blocks) for i in ids], "block_id long, id long")
    return e, b


def brute(labels, blocks, distinct):
    if not blocks:
        return (0.0,) * 5
    pairs = {(i, j) for b in map(set, blocks) for i in b for j in b if i < j}
    b = float(len(pairs)) if distinct else float(sum(len(set(x)) * (len(set(x)) - 1) // 2 for x in blocks))
    db = float(sum(labels[i] == labels[j] for i, j in pairs))
    n = len(labels)
    de = sum(labels.count(v) * (labels.count(v) - 1) / 2 for v in set(labels))
    return (db / de if de else 0.0, db / b if b else 0.0, 1 - b / (n * (n - 1) / 2) if n > 1 else 0.0, db, b)


CASES = [
    ([1, 1, 2, 2], [[0, 1], [1, 0, 2], [3]]),
    ([1, 2, 3], [[0, 1, 2]]),
    ([1, 1], []),
    ([5], [[0]]),
    ([1, 1, 1], [[0], [1], [2]]),
    ([1, 1, 2], [[0, 0, 1], [1, 1]]),
]


@pytest.mark.parametrize("labels,blocks", CASES)
@pytest.mark.parametrize("distinct", [False, True])
def test_small_collections(spark, labels, blocks, distinct):
    got = measures.evaluate(*frames(spark, labels, blocks), distinct).first()
    assert tuple(got) == pytest.approx(brute(labels, blocks, distinct))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.data())
def test_measures_hold_their_bounds(spark, labels, data):
    blocks = data.draw(st.lists(st.lists(st.integers(0, len(labels) - 1), min_size=1, max_size=5), max_size=4))
    red, dis = (measures.evaluate(*frames(spark, labels, blocks), d).first() for d in (False, True))
    assert tuple(red) == pytest.approx(brute(labels, blocks, False)) and tuple(dis) == pytest.approx(brute(labels, blocks, True))
    assert dis["b"] <= red["b"] and 0 <= dis["rr"] <= 1 and 0 <= red["pc"] <= 1


GOLDEN = [
    ("hyperplane", lsh.Config(0, 2, 4, 30.0), 32, 1613, 16717, 16064),
    ("hyperplane", lsh.Config(0, 4, 8, 30.0), 817, 214, 2438, 2416),
    ("pstable", lsh.Config(0, 2, 4, 1.0), 432, 183, 1749, 1741),
    ("pstable", lsh.Config(0, 4, 8, 30.0), 9, 12344, 386265, 124750),
]


@pytest.mark.parametrize("kind,config,n,db,red,dis", GOLDEN)
def test_hashing_golden_values(spark, kind, config, n, db, red, dis):
    b = lsh.blocks(vectors(spark, SF), lsh.planes(spark, 64, [config]), kind).select("block_id", "id").cache()
    e = entities(spark, SF)
    assert b.select("block_id").distinct().count() == n
    r, d = measures.evaluate(e, b).first(), measures.evaluate(e, b, True).first()
    assert (r["db"], r["b"], d["db"], d["b"]) == (db, red, db, dis)


def test_sign_signatures_part_as_hyperplanes_do(spark):
    v, p = vectors(spark, SF), lsh.planes(spark, 64, queries.HYPERPLANE)
    sets = [{frozenset(r["ids"]) for r in lsh.blocks(v, p, k).groupBy("block_id").agg({"id": "collect_set"}).toDF("b", "ids").collect()} for k in ("hyperplane", "simhash")]
    assert sets[0] == sets[1]


@pytest.mark.parametrize("k,db,red,dis", [(5, 390, 5000, 4045), (10, 1754, 22500, 17806)])
def test_neighbours_golden_values(spark, k, db, red, dis):
    b = knn.exact_blocks(vectors(spark, SF), k).cache()
    e = entities(spark, SF)
    assert measures.evaluate(e, b).first()["b"] == red and measures.evaluate(e, b, True).first()[3:] == (db, dis)


def test_fewer_rows_than_neighbours(spark):
    v = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 2.0])], "id long, features array<float>")
    assert sorted(map(tuple, knn.exact_blocks(v, 5).collect())) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_multiprobe_recall(spark):
    v = vectors(spark, SF)
    exact = {tuple(r) for r in knn.exact_blocks(v, 5).collect()}
    probed = {tuple(r) for r in knn.multiprobe_blocks(lsh.centred(v), lsh.planes(spark, 64, [lsh.Config(0, 8, 5)]), 5, 40).collect()}
    assert len(exact & probed) / len(exact) > 0.7


def test_clusters_golden_values(spark):
    lab = dbscan.labels(vectors(spark, SF), 1.15, 5).cache()
    sizes = [r["n"] for r in dbscan.sizes(lab).orderBy("cluster").collect()]
    assert sizes == [360, 21, 5, 41, 4, 14, 4, 8, 5, 4, 6, 3, 7, 5, 5, 5, 3]
    assert dbscan.blocks(lab, "drop").filter("block_id < 0").count() == 0
    r = measures.evaluate(entities(spark, SF), dbscan.blocks(lab)).first()
    assert (r["db"], r["b"]) == (6472, 65879)


def test_clusters_do_not_depend_on_order(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=2)]) for i in range(60)]
    a, b = (dict(map(tuple, dbscan.labels(spark.createDataFrame(r, "id long, features array<float>"), 0.5, 4).collect())) for r in (rows, rows[::-1]))
    assert a == b and max(a.values()) >= 0


@pytest.mark.parametrize(("most", "tile"), [(1, 512), (3, 512), (8, 512), (0, 7), (2, 5)])
def test_distinct_pairs_are_counted_without_pairs(spark, monkeypatch, most, tile):
    import itertools
    import random

    monkeypatch.setattr(measures, "TILE", tile)
    monkeypatch.setattr(measures, "MOST_GROUPS", most)
    rng = random.Random(most)
    rows = list({(c, rng.randrange(9), i) for c in range(2) for i in range(40) for _ in range(rng.randrange(1, 8))})
    df = spark.createDataFrame(rows, "config_id int, block_id int, id int")
    got = {r["config_id"]: r["n"] for r in measures.pair_counts(df, ["block_id"], ["config_id"]).collect()}
    for c in range(2):
        of = {}
        for k, b, i in rows:
            if k == c:
                of.setdefault(b, []).append(i)
        assert got[c] == len({p for x in of.values() for p in itertools.combinations(sorted(x), 2)})
    assert measures.pair_counts(df.filter("config_id = 0"), ["block_id"], []).first()["n"] == got[0]


def test_distinct_measures_of_many_tables(spark):
    """Ten tables and neighbours' blocks, against the pairs themselves."""
    import itertools

    v, e = vectors(spark, "/root/testdata/sf0.001"), entities(spark, "/root/testdata/sf0.001")
    label = {r["id"]: r["label"] for r in e.collect()}
    for blocks in (lsh.blocks(v, lsh.planes(spark, 64, [lsh.Config(0, 10, 3, 30.0)]), "hyperplane"), knn.exact_blocks(v, 10)):
        blocks = blocks.select("block_id", "id").cache()
        of = {}
        for r in blocks.collect():
            of.setdefault(r["block_id"], set()).add(r["id"])
        pairs = {p for x in of.values() for p in itertools.combinations(sorted(x), 2)}
        got = measures.evaluate(e, blocks, True).first()
        assert (got["b"], got["db"]) == (len(pairs), sum(label[i] == label[j] for i, j in pairs))


def test_index_in_steps_equals_one_step(spark):
    from blockweave.operators.index import BucketIndex

    b = lsh.blocks(vectors(spark, "/root/testdata/sf0.001"), lsh.planes(spark, 64, queries.HYPERPLANE), "hyperplane").select("block_id", "id").cache()
    one, steps = BucketIndex(spark, 5), BucketIndex(spark, 3)
    assert steps.lookup(b).count() == 0
    one.add(b)
    for i in range(3):
        assert steps.add(b.filter(f"id % 3 = {i}")) == i + 1
    asked = b.filter("id % 7 = 0")
    pairs = lambda df: {tuple(r) for r in df.collect()}
    whole = pairs(one.lookup(asked))
    assert pairs(steps.lookup(asked)) == whole and (0, 0) in whole
    assert pairs(steps.lookup(asked, 2)) == {(i, j) for i, j in whole if j % 3 < 2}
    plan = steps.met(asked)._jdf.queryExecution().executedPlan().toString()
    index_side = plan[plan.rindex("+- Sort [block_id") :]  # the join's last child
    assert "bucket_index" in index_side and "Exchange" not in index_side, plan
    for x in (one, steps):
        x.drop()


def _clustered(seed, n=180, dim=5, same=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim)) * 20
    return np.concatenate([centres[rng.integers(8, size=n)] + rng.normal(size=(n, dim)), np.tile(centres[0], (same, 1))])


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)


def _clusters(x, eps, least):
    """Labels by a walk over all pairs."""
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= eps * eps
    core, label, n = near.sum(axis=1) >= least, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            front, label[i] = [i], n
            while front:
                reached = np.flatnonzero(near[front.pop()] & core & (label < 0))
                label[reached] = n
                front += reached.tolist()
            n += 1
    return [int(label[i]) if core[i] else min(label[near[i] & core].tolist(), default=-1) for i in range(len(x))]


@pytest.mark.parametrize("block", [24, 64, 4096])
def test_cells_that_are_apart_do_not_meet(spark, block):
    x = _clustered(block)
    v = _frame(spark, x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {i: np.lexsort((np.arange(len(x)), d[i]))[:4].tolist() for i in range(len(x))}
    found = knn.search(v, 4, block).collect()
    assert {r["id"]: [q["j"] for q in r["near"]] for r in found} == want
    placed, parts = cells.celled(v, block)
    if block < 4096:
        if block == 24:
            assert sum(r["visits"] for r in found) / len(x) < 0.5 * int(parts.parts.sum())
        sent = []
        count = lambda a, b: sent.append(1) or pa.table({"n": [len(a) * len(b)]})
        out = cells.meet(placed, placed, parts, cells.within(1.5), count, "n long", block=block)
        assert out.agg({"n": "sum"}).first()[0] < 0.6 * len(x) ** 2


def test_parts_follow_the_metric(spark):
    x = np.concatenate([_clustered(7, 400, 3, 0), np.random.default_rng(1).normal(size=(900, 3))])
    placed, parts = cells.celled(_frame(spark, x), 40)
    rows = placed.collect()
    assert sorted(r["id"] for r in rows) == list(range(len(x))) and max(r["cell"] for r in rows) < len(parts)
    sizes = {}
    for r in rows:
        sizes[r["cell"], r["part"]] = sizes.get((r["cell"], r["part"]), 0) + 1
        assert np.linalg.norm(x[r["id"]] - parts.pivots[r["cell"]]) <= parts.radius[r["cell"]] * (1 + 1e-9)
    assert max(sizes.values()) < 160 and len(sizes) > 15


@pytest.mark.parametrize(("dim", "eps", "least", "block"), [(2, 0.6, 4, 4096), (3, 1.2, 5, 64), (5, 2.5, 5, 40), (2, 0.6, 70, 30)])
def test_micro_cells_give_the_same_clusters(spark, dim, eps, least, block):
    x = _clustered(dim + block, 220, dim)
    got = dict(map(tuple, dbscan.labels(_frame(spark, x), eps, least, block).collect()))
    assert [got[i] for i in range(len(x))] == _clusters(x, eps, least)


@pytest.mark.parametrize(("block", "tree_block"), [(4096, 1024), (60, 50)])
def test_trees_give_the_clusters_of_every_density(spark, block, tree_block):
    x = _clustered(block, 150, 3, 30)
    eps, least = [0.5, 1.5, 100.0], [3, 6, 50]
    got = {(r["eps"], r["m"], r["id"]): r["cluster"] for r in dbscan.sweep(_frame(spark, x), eps, least, block, tree_block).collect()}
    for e in eps:
        for m in least:
            assert [got[e, m, i] for i in range(len(x))] == _clusters(x, e, m)


def test_spanning_forest_is_least(spark):
    rng = np.random.default_rng(2)
    rows = list({(m, int(u), int(v)): (m, int(u), int(v), float(w)) for m in (1, 2) for u, v, w in zip(rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 9, 300), strict=True) if u < v}.values())
    found = dbscan.spanning_forest(spark.createDataFrame(rows, "m int, u long, v long, w double")).collect()
    for m in (1, 2):
        up, total, n = list(range(60)), 0.0, 0

        def top(k):
            while up[k] != k:
                k = up[k]
            return k

        for _, u, v, w in sorted((r for r in rows if r[0] == m), key=lambda r: r[3]):
            if top(u) != top(v):
                up[top(u)], total, n = top(v), total + w, n + 1
        mine = [r["w"] for r in found if r["m"] == m]
        assert (len(mine), sum(mine)) == (n, total)
    assert dbscan.spanning_forest(spark.createDataFrame([], "m int, u long, v long, w double")).count() == 0


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, features array<double>")
    assert knn.exact_blocks(none, 3).count() == 0
    assert dbscan.labels(none, 1.0, 3).count() == 0
    assert dbscan.sweep(none, [1.0], [3]).count() == 0


@pytest.mark.parametrize(("far", "scale"), [(0, 1), (1e4, 1), (0, 1e-20), (0, 1e20)])
def test_products_tell_what_differences_tell(far, scale):
    rng = np.random.default_rng(5)
    x, y = (rng.integers(0, 3, (n, 6)) * scale + far for n in (70, 90))
    d = np.concatenate([d for _, d in cells.squares(x, y)])
    for reach in (0.0, 4.0 * scale**2, 1e6 * scale**2):
        assert (cells.counts_within(x, y, reach, 500) == (d <= reach).sum(axis=1)).all()
        assert {p for r, c, _ in cells.close(x, y, reach, None, 500) for p in zip(r.tolist(), c.tolist(), strict=True)} == set(zip(*(k.tolist() for k in np.nonzero(d <= reach)), strict=True))
    near = knn._best(x, np.arange(90), y, 4).to_pylist()
    assert [[p["j"] for p in r] for r in near] == [np.lexsort((np.arange(90), row))[:4].tolist() for row in d]


def test_vectors_without_clusters_make_few_parts(spark):
    x = np.random.default_rng(6).normal(size=(600, 24))
    placed, parts = cells.celled(_frame(spark, x), 40)
    assert len(parts) == 1 and parts.parts.tolist() == [15] and placed.select("part").distinct().count() == 15
    got = dict(map(tuple, dbscan.labels(_frame(spark, x), 5.0, 3, 40).collect()))
    assert [got[i] for i in range(len(x))] == _clusters(x, 5.0, 3)


@pytest.mark.parametrize(("hub", "near"), [(60, 40), (5, 8)])
def test_cores_of_the_largest_component_do_not_meet_all(spark, monkeypatch, hub, near):
    for name, value in (("HUB", hub), ("NEAR", near), ("WIDE", 40)):
        monkeypatch.setattr(dbscan, name, value, raising=False)
    rng = np.random.default_rng(16)
    x = rng.normal(size=(600, 24))
    x[590:] = 40 + rng.normal(size=(10, 24))  # a component of its own
    looking, table = {}, dbscan.shared_table

    def written(df, name):
        out = table(df, name)
        looking.setdefault(name, []).append(out.count() if name == "loose" else None)
        return out

    monkeypatch.setattr(dbscan, "shared_table", written)
    eps, least = [4.0, 5.0, 6.0], [3, 6, 30]
    got = {(r["eps"], r["m"], r["id"]): r["cluster"] for r in dbscan.sweep(_frame(spark, x), eps, least, 40).collect()}
    for e in eps:
        for m in least:
            assert [got[e, m, i] for i in range(len(x))] == _clusters(x, e, m), (e, m)
    looking.clear()
    got = dict(map(tuple, dbscan.labels(_frame(spark, x), 6.5, 3, 40).collect()))
    assert [got[i] for i in range(len(x))] == _clusters(x, 6.5, 3)
    assert looking["loose"][0] < 60


def test_probes_in_tiles(spark):
    v = lsh.centred(vectors(spark, SF))
    planes = lsh.planes(spark, 64, queries.PROBE)
    found = [{tuple(r) for r in knn.multiprobe_blocks(v, planes, 5, 20, tile).collect()} for tile in (9, 1 << 14)]
    assert found[0] == found[1] and len(found[0]) == 2500


def test_pairs_are_found_once_without_a_shuffle(spark):
    from blockweave.operators.index import BucketIndex

    rng = np.random.default_rng(8)
    rows = list({(f"b{b}", int(i)) for b in range(9) for i in rng.integers(0, 30, 12)})
    b = spark.createDataFrame(rows, "block_id string, id long")
    held = {i: {k for k, j in rows if j == i} for i in range(30)}
    e = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, label long")
    got = [tuple(r) for r in measures.duplicate_pairs(e, b).collect()]
    assert sorted(got) == [(i, j) for i in range(30) for j in range(i + 1, 30) if i % 3 == j % 3 and held[i] & held[j]]
    kept = BucketIndex(spark, 3)
    for k in range(3):  # an id is added in several steps, some rows twice
        kept.add(b.filter(f"substring(block_id, 2) % 3 = {k} or block_id = 'b4'"))
    found = kept.lookup(b)
    assert sorted(tuple(r) for r in found.collect()) == [(i, j) for i in range(30) for j in range(30) if held[i] & held[j]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
    kept.drop()


def test_found_ids_repeat_at_short_distance(spark, monkeypatch):
    from blockweave.operators import index

    monkeypatch.setattr(index, "TILE", 10, raising=False)
    b = spark.createDataFrame([("b", i) for i in range(200)], "block_id string, id long")
    kept = index.BucketIndex(spark, 3)
    kept.add(b.filter("id < 150"))
    kept.add(b.filter("id >= 150"))
    got = [tuple(r) for r in kept.lookup(b).collect()]
    assert sorted(got) == [(i, j) for i in range(200) for j in range(200)]
    assert max(len({j for _, j in got[k : k + 1000]}) for k in range(0, len(got), 1000)) <= 60
    assert sorted(tuple(r) for r in kept.lookup(b, 1).collect()) == [(i, j) for i in range(200) for j in range(150)]
    kept.drop()
