"""Density clustering by a graph of micro-cells, for many densities at once.

Clusters are numbered by the smallest id of their core points; a border point takes the smallest cluster number among
its core neighbours, so the labels do not depend on the order of rows. Noise is -1.

Pairs of neighbours are never rows. Within a part of the metric partition, vectors are covered by micro-cells of half of eps
as radius: all of a micro-cell are neighbours, so one of enough members needs no counting, and the cores of a micro-cell
are one node. Workers count for the others, and join the micro-cells of two parts in memory: most are told near or far by
their centres, a few are compared, and what leaves a worker is one edge a node, and the nodes near each border point,
of which it has fewer than ``min_samples``. Numbers of neighbours are counted up to the largest ``min_samples``, so one count
serves all of them.

Vectors whose cells have no distance between them lie in parts that all would meet all. There a vector stops looking when it
has neighbours enough, and two cores already known to be of one component need not meet: each looks at first at some
others of its part and at the first vectors of all, and only what is then outside of the largest component (of each
density), and what is no core, looks at every part. A pair that could join two components has an end outside of it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import shared_table
from .cells import BLOCK, SLACK, WIDE, away, celled, close, column, counts_within, meet, vectors_of, within
from .components import components, numbered

#: Vectors that each core looks at first: of all, and about so many of its part.
HUB, NEAR = 4096, 8192
EDGES = "m int, id long, u long, v long"


def covered(x: np.ndarray, radius: float, at_once: int = 256) -> np.ndarray:
    """The row that is the centre of each row's micro-cell: rows not yet covered become centres in turn."""
    centre, rest = np.full(len(x), -1), np.arange(len(x))
    while len(rest):
        some, pairs = rest[:at_once], list(close(x[rest[:at_once]], x[rest], radius * radius))
        r, c = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        ends = np.searchsorted(r, np.arange(len(some) + 1))
        for k, i in enumerate(some):
            if centre[i] < 0:
                near = rest[c[ends[k] : ends[k + 1]]]
                centre[near[centre[near] < 0]] = i
                centre[i] = i
        rest = rest[centre[rest] < 0]
    return centre


def _micro(eps: float, least: int):
    """Adds to the rows of a part their micro-cell, named by its centre's id, and their number of neighbours in the part, or
    ``least`` where there are as many."""

    def run(t: pa.Table) -> pa.Table:
        ids, x = column(t, "id"), vectors_of(t)
        centre = covered(x, eps / 2 / SLACK)
        _, at, n = np.unique(centre, return_inverse=True, return_counts=True)
        counts = np.minimum(n[at], least)
        few = np.flatnonzero(counts < least)
        counts[few] = np.minimum(counts_within(x[few], x, eps * eps), least)
        return t.append_column("micro", pa.array(ids[centre])).append_column("near", pa.array(counts.astype(np.int64)))

    return run


def _counted(eps: float):
    def run(t: pa.Table, others: pa.Table) -> pa.Table:
        return pa.table({"id": t["id"], "more": pa.array(counts_within(vectors_of(t), vectors_of(others), eps * eps))})

    return run


class Micros:
    """The micro-cells of some cores: their names, members, means and radii."""

    def __init__(self, names: np.ndarray, x: np.ndarray):
        self.order = np.argsort(names, kind="stable")
        self.x = x[self.order]
        self.names, self.starts, self.sizes = np.unique(names[self.order], return_index=True, return_counts=True)
        self.means = np.add.reduceat(self.x, self.starts, axis=0) / self.sizes[:, None] if len(names) else x
        lone = self.sizes == 1
        self.means[lone] = self.x[self.starts[lone]]
        self.radii = np.maximum.reduceat(away(self.x, np.repeat(self.means, self.sizes, axis=0)), self.starts) if len(names) else np.zeros(0)

    def members(self, k: int) -> np.ndarray:
        return self.x[self.starts[k] : self.starts[k] + self.sizes[k]]


def joined(a: Micros, b: Micros, eps: float) -> list[tuple[int, int]]:
    """(name, name of its component's root) of the micro-cells that are joined by members within ``eps`` of each other."""
    sure, shell = np.zeros((len(a.names), len(b.names)), bool), []
    reach = a.radii + (b.radii.max() if len(b.radii) else 0)
    for r, c, d2 in close(a.means, b.means, ((eps + reach) * SLACK) ** 2):
        d, both = np.sqrt(d2), a.radii[r] + b.radii[c]
        lone = (a.sizes[r] == 1) & (b.sizes[c] == 1)
        at = np.where(lone, d2 <= eps * eps, (d + both) * SLACK <= eps)
        sure[r[at], c[at]] = True
        at = ~at & ~lone & (d - both <= eps * SLACK)
        shell += zip(d[at].tolist(), r[at].tolist(), c[at].tolist(), strict=True)
    # Components of what is sure: each row and column is visited once.
    rows, cols = np.full(len(a.names), -1), np.full(len(b.names), -1)
    some = sure.any(axis=1)
    rows[~some] = np.arange(n := int((~some).sum()))
    for s in np.flatnonzero(some):
        if rows[s] < 0:
            front, rows[s] = np.array([s]), n
            while len(front):
                reached = np.flatnonzero(sure[front].any(axis=0) & (cols < 0))
                cols[reached] = n
                front = np.flatnonzero(sure[:, reached].any(axis=1) & (rows < 0)) if len(reached) else reached
                rows[front] = n
            n += 1
    alone = cols < 0
    cols[alone] = np.arange(n, n + int(alone.sum()))
    up = list(range(n + int(alone.sum())))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    _, i, j = np.intersect1d(a.names, b.names, assume_unique=True, return_indices=True)  # a micro-cell on both sides is one
    for k, at in zip(rows[i].tolist(), cols[j].tolist(), strict=True):
        up[top(k)] = top(at)
    for _, i, j in sorted(shell):  # the nearest first, and only where they join two components
        u, v = top(int(rows[i])), top(int(cols[j]))
        if u != v and any(len(r) for r, _, _ in close(a.members(i), b.members(j), eps * eps)):
            up[u] = v
    root, out = {}, {}
    for names, of in ((a.names, rows), (b.names, cols)):
        for name, k in zip(names.tolist(), of.tolist(), strict=True):
            out[name] = root.setdefault(top(k), name)
    return [(name, r) for name, r in out.items() if name != r]


def _edges(eps: float, least: list[int], borders: bool = True):
    """Rows (m, id, u, v): for each of ``least`` an edge between micro-cells without an id, or a micro-cell ``v`` near the border
    point ``id``. A core is joined where ``loose`` has the bit of its density."""

    def run(t: pa.Table, others: pa.Table) -> pa.Table:
        x, y, n, k = vectors_of(t), vectors_of(others), column(t, "n"), column(others, "n")
        u, v, ids = column(t, "micro"), column(others, "micro"), column(t, "id")
        out, last, loose = [], None, column(t, "loose")
        for j, m in enumerate(least if len(y) else []):
            a, b = (n >= m) & (loose >> j & 1 == 1), k >= m
            if last is None or (a != last[0]).any() or (b != last[1]).any():
                last = (a, b, np.array(joined(Micros(u[a], x[a]), Micros(v[b], y[b]), eps), np.int64).reshape(-1, 2)) if a.any() and b.any() else (a, b, np.zeros((0, 2), np.int64))
            out.append((m, None, last[2][:, 0], last[2][:, 1]))
        border = np.flatnonzero(n < least[-1]) if borders else n[:0]
        for r, c, _ in close(x[border], y, eps * eps):
            r = border[r]
            for m in least:
                at = (n[r] < m) & (k[c] >= m)
                found = np.unique(np.stack([ids[r[at]], v[c[at]]], axis=1), axis=0)
                out.append((m, found[:, 0], None, found[:, 1]))
        join = lambda c: pa.concat_arrays([pa.array([], pa.int64()), *[pa.nulls(len(o[3]), pa.int64()) if o[c] is None else pa.array(o[c], pa.int64()) for o in out]])
        return pa.table({"m": pa.array(np.concatenate([[], *[np.full(len(o[3]), o[0]) for o in out]]).astype(np.int32)), "id": join(1), "u": join(2), "v": join(3)})

    return run


def _looked(left: DataFrame, n: int, right: DataFrame, parts: int, offsets: range, fn, schema: str) -> DataFrame:
    """``fn(rows, others)`` for the ``n`` rows of ``left`` with those of ``right`` in the parts that are ``offsets`` after their own, in groups
    of about a part's rows or fewer."""
    groups = max(1, -(-n * len(offsets) // (parts * WIDE)))
    of = left.withColumn("to", F.explode(F.sequence(F.lit(offsets[0]), F.lit(offsets[-1])))).withColumn("to", F.pmod(F.col("part") + F.col("to"), F.lit(parts)))
    of = of.withColumn("grp", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(groups)).cast("int"))
    there = right.withColumnRenamed("part", "to").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return of.groupBy("to", "grp").cogroup(there.groupBy("to", "grp")).applyInArrow(lambda x, y: fn(x, y), schema)


def _counted_in_turn(told: DataFrame, near: DataFrame, parts: int, eps: float, most: int) -> DataFrame:
    """``told`` with ``n``, the neighbours in all parts up to ``most``: who has fewer looks at one more part, at four more, and so on."""
    told, at, wide = told.withColumnRenamed("near", "n"), 1, 1
    few = told.filter(F.col("n") < most).select("id", "features", "part", "n")
    found = []
    while at < parts and (n := few.count()):
        offsets = range(at, min(parts, at + wide))
        more = _looked(few, n, near.select("features", "part"), parts, offsets, _counted(eps), "id long, more long").groupBy("id").agg(F.sum("more").alias("more"))
        few = shared_table(few.join(more, "id", "left").select("id", "features", "part", F.least(F.col("n") + F.coalesce("more", F.lit(0)), F.lit(most)).alias("n")), "few")
        found.append(few.filter(F.col("n") >= most).select("id", F.col("n").alias("now")))
        few, at, wide = few.filter(F.col("n") < most), at + wide, 4 * wide
    if found:
        now = reduce(DataFrame.union, [*found, few.select("id", "n")])
        told = told.join(now, "id", "left").withColumn("n", F.coalesce("now", "n")).drop("now")
    return shared_table(told.select("id", "features", "cell", "part", "micro", "n"), "cores")


def _first_edges(told: DataFrame, n: int, parts: int, eps: float, least: list[int]) -> DataFrame:
    """Some of the edges between cores: of each with about NEAR of its part, and with HUB of all."""
    subs, find = max(1, -(-n // (parts * NEAR))), _edges(eps, least, borders=False)
    cores = told.filter(F.col("n") >= least[0]).select("id", "features", "micro", "n", "part", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(subs)).cast("int").alias("sub"))
    hub = cores.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n)) < HUB).select("features", "micro", "n")
    hub = hub.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))))

    def run(t: pa.Table, hub: pa.Table) -> pa.Table:
        t = t.append_column("loose", pa.array(np.full(len(t), -1)))
        return find(t, pa.concat_tables([t.select(["features", "micro", "n"]), hub.select(["features", "micro", "n"])]))

    return cores.groupBy("part", "sub").cogroup(hub.groupBy("part", "sub")).applyInArrow(run, EDGES)


def _loose(told: DataFrame, root: DataFrame, least: list[int]) -> DataFrame:
    """``told`` with ``loose``, the bits of the densities at which a row is a core outside of the largest component of ``root`` (m, node, root)."""
    largest = root.groupBy("m", "root").agg(F.count("*").alias("k")).groupBy("m").agg(F.max_by("root", F.struct("k", "root")).alias("root"))
    bit = lambda j: F.lit(1 << j)
    held = root.join(F.broadcast(largest), ["m", "root"]).groupBy(F.col("node").alias("micro")).agg(sum((F.max(F.when(F.col("m") == m, bit(j)).otherwise(0)) for j, m in enumerate(least)), F.lit(0)).alias("held"))
    core = sum((F.when(F.col("n") >= m, bit(j)).otherwise(0) for j, m in enumerate(least)), F.lit(0))
    return told.join(held, "micro", "left").withColumn("loose", core.bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0)))).cast("long")).drop("held")


def sweep(vectors: DataFrame, eps: list[float], min_samples: list[int], block: int = BLOCK, tree_block: int | None = None) -> DataFrame:
    """(eps, m, id, cluster) for every vector at every eps and min_samples. Rows that leave a worker grow with the vectors and
    the parts that each may reach. The vectors are placed once; each eps has its micro-cells, counts and edges, for all
    min_samples at once, and the components of all are found together. ``tree_block`` has no effect."""
    least = sorted(set(min_samples))
    near, cells = celled(vectors, block)
    near = shared_table(near, "placed")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in near.schema.fields)
    dealt = len(cells) == 1 and not cells.single  # all parts meet all
    parts, by, every = int(cells.parts.sum()), ["eps", "m"], sorted({float(e) for e in eps})
    points, links, cores_of = [], [], {}
    for e in every:
        told = shared_table(near.groupBy("cell", "part").applyInArrow(_micro(e, least[-1]), f"{kind}, micro long, near long"), "micro-cells")
        n = F.col("near")
        if dealt:
            told = _counted_in_turn(told, near, parts, e, least[-1])
        elif not cells.single:
            few = told.filter(n < least[-1]).select("id", "features", "cell", "part")
            more = meet(few, near.select("features", "cell", "part"), cells, within(e), _counted(e), "id long, more long", own=False, block=block)
            told = told.join(more.groupBy("id").agg(F.sum("more").alias("more")), "id", "left")
            n = F.least(n + F.coalesce("more", F.lit(0)), F.lit(least[-1]))
            told = shared_table(told.select("id", "features", "cell", "part", "micro", n.alias("n")), "cores")
        else:
            told = told.withColumnRenamed("near", "n")
        cores_of[e] = told
        points.append(told.select(F.lit(e).alias("eps"), "id", "micro", "n"))
    of = reduce(DataFrame.union, points).withColumn("m", F.explode(F.array(*[F.lit(m) for m in least]))).withColumn("core", F.col("n") >= F.col("m"))
    cores = shared_table(of.filter("core").groupBy(*by, "micro").agg(F.min("id").alias("least")), "nodes")
    nodes = cores.select(*by, F.col("micro").alias("node"))
    if dealt:
        size = near.count()
        links = [shared_table(_first_edges(cores_of[e], size, parts, e, least), "first-edges").withColumn("eps", F.lit(e)) for e in every]
        begun = components(nodes, reduce(DataFrame.union, links).select(*by, "u", "v").distinct(), by)
    for e in every:
        told = cores_of[e]
        right = told.filter(F.col("n") >= least[0]).select("features", "cell", "part", "micro", "n")
        if dealt:
            left = _loose(told, begun.filter(F.col("eps") == e), least).filter((F.col("loose") != 0) | (F.col("n") < least[-1]))
            left = shared_table(left.select("id", "features", "part", "micro", "n", "loose"), "loose")
            found = _looked(left, left.count(), right.drop("cell"), parts, range(parts), _edges(e, least), EDGES)
        else:
            found = meet(told.withColumn("loose", F.lit(-1).cast("long")), right, cells, within(e), _edges(e, least), EDGES, block=block)
        links.append(shared_table(found, "micro-edges").withColumn("eps", F.lit(e)))
    found = reduce(DataFrame.union, links).distinct()
    root = components(nodes, found.filter("id is null").select(*by, "u", "v"), by)
    # A component is named by its smallest core id.
    named = root.join(cores.withColumnRenamed("micro", "node"), [*by, "node"])
    named = named.join(named.groupBy(*by, "root").agg(F.min("least").alias("c")), [*by, "root"]).select(*by, "node", F.col("c").alias("root"))
    told = shared_table(named.join(numbered(named, by), [*by, "root"]).select(*by, F.col("node").alias("micro"), F.col("number").alias("cluster")), "clusters")
    border = found.filter("id is not null").join(told.withColumnRenamed("micro", "v"), [*by, "v"]).groupBy(*by, "id").agg(F.min("cluster").alias("border"))
    out = of.select(*by, "id", F.when(F.col("core"), F.col("micro")).alias("micro")).join(told, [*by, "micro"], "left").join(border, [*by, "id"], "left")
    return out.select(*by, "id", F.coalesce("cluster", "border", F.lit(-1)).cast("long").alias("cluster"))


def labels(vectors: DataFrame, eps: float, min_samples: int, block: int = BLOCK) -> DataFrame:
    """(id, cluster) for every vector."""
    return sweep(vectors, [eps], [min_samples], block).select("id", "cluster")


def spanning_forest(edges: DataFrame, by: str = "m") -> DataFrame:
    """The edges (by, u, v, w) of a least spanning forest, by rounds in which every component takes its least edge; equal
    weights go by the edges' ends, so the least edges make no cycle."""
    live = shared_table(edges.select(by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").distinct().select("*", F.col("u").alias("a"), F.col("v").alias("b")), "live")
    taken = []
    while live.limit(1).count():
        ends = [live.select(by, F.col(c).alias("c"), F.struct("w", "u", "v", F.col(o).alias("other")).alias("e")) for c, o in (("a", "b"), ("b", "a"))]
        least = shared_table(ends[0].union(ends[1]).groupBy(by, "c").agg(F.min("e").alias("e")).select(by, "c", "e.*"), "least")
        taken.append(least.select(by, "u", "v", "w").distinct())
        nodes = least.select(by, "c").union(least.select(by, "other")).distinct().withColumnRenamed("c", "node")
        root = components(nodes, least.select(by, F.col("c").alias("u"), F.col("other").alias("v")), [by])
        of = lambda c: root.select(by, F.col("node").alias(c), F.col("root").alias(f"{c}2"))  # noqa: B023, E731
        live = live.join(of("a"), [by, "a"]).join(of("b"), [by, "b"]).filter("a2 != b2")
        live = shared_table(live.select(by, "u", "v", "w", F.col("a2").alias("a"), F.col("b2").alias("b")), "live")
    return reduce(DataFrame.union, taken) if taken else live.select(by, "u", "v", "w")


def blocks(labelled: DataFrame, noise: str = "block") -> DataFrame:
    """(block_id, id): a block a cluster. Noise is a block of its own, or dropped with ``noise='drop'``."""
    kept = labelled if noise == "block" else labelled.filter("cluster >= 0")
    return kept.select(F.col("cluster").alias("block_id"), "id")


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"))
