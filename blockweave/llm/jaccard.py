"""Near duplicates by n-gram Jaccard similarity: a join with adaptive multi-match prefixes.

A document is its set of word shingles, in one order for all: rare first, by a sketch of all documents' counts. Two
sets that are similar enough share at least L tokens among their first (size - needed overlap + L), for any L. Each
document chooses its L: a longer prefix costs more rows, but a partner must share that many tokens, so the estimated
lists of its prefix tokens decide. Copies of one set are one node from the start. Tokens of one document only are
dropped by two Bloom filters (see sightings). Pairs are not made within a token's group as such: first every member is
compared with the group's most connected one, and what is linked by then is one component; then only pairs of
different components that pass the size, place and multi-match tests, and whose counts of tokens by bin allow the
overlap, are compared, on the whole texts.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, pieces_for, release, text_bytes, written
from .graph import components
from .shingles import set_digest, shingle_sets
from .sightings import SENT, repeats, sender

#: The sketch: counters of 32 bits, in segments that are summed apart. Its size is fixed (4 MB).
SKETCH, SEGMENTS = 1 << 20, 16
#: The longest multi-match, and the cost of a comparison against that of a list entry.
MOST_MATCHES, COMPARE_COST = 8, 40.0
#: Bytes of text for a shard of the filters, and pairs that are compared at once.
SHARD_BYTES, CELL_PAIRS = 32 << 20, 1000
#: Members of a token in a block, pairs looked at at once, and bins of a set's signature.
BLOCK_DOCS, PAIRS_AT_ONCE, BINS = 128, 500_000, 256
#: Requests for texts that are sent to every worker (about 16 MB); beyond, the texts are shuffled.
SENT_ROWS = 200_000
#: Bytes of texts in a cell.
CELL_BYTES = 16 << 20
_AT = (1 << 28) - 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def sketch(rows: DataFrame, k: int, nbytes: int) -> np.ndarray:
    """How many documents have a shingle in each of SKETCH buckets, over all rows."""
    salts = max(1, math.isqrt(pieces_for(nbytes, 16 << 20)))
    width = SKETCH // SEGMENTS

    def count(batches):
        total = np.zeros(SKETCH, np.uint32)
        for batch in sliced(batches):
            for s in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), k):
                np.add.at(total, _bucket(s), 1)
        salt = TaskContext.get().partitionId() % salts
        yield _segments([(i, salt, total[i * width : (i + 1) * width].tobytes()) for i in range(SEGMENTS)])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(c, np.uint32)
        yield _segments([(i, 0, c.tobytes()) for i, c in total.items()])

    out = rows.mapInArrow(count, "segment int, salt int, counts binary").repartition(SEGMENTS * salts, "segment", "salt").mapInArrow(add, "segment int, salt int, counts binary")
    if salts > 1:
        out = out.repartition(SEGMENTS, "segment").mapInArrow(add, "segment int, salt int, counts binary")
    total = np.zeros(SKETCH, np.uint32)
    for r in out.collect():  # SEGMENTS rows
        total[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    return total


def _segments(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "salt", "counts"])


def sliced(batches, rows: int = 512):
    """The batches in parts of few rows, so that few texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        release()


def needed(n, num: int, den: int):
    """The least overlap of a set of ``n`` with any set at least as similar as num/den: ceil(n * num / den)."""
    return -(-num * n // den)


def prefix(s: np.ndarray, counts: np.ndarray, num: int, den: int, common: float) -> tuple[np.ndarray, int]:
    """The tokens of the prefix in the common order, and how many of them a partner must share.

    The expected list of a token is its bucket's count beyond what the sketch's noise explains. For each L the cost is
    the lists of the prefix, and the comparisons: of partners that share L of its tokens there are at most lists / L.
    """
    c = counts[_bucket(s)]
    order = np.lexsort((s, c))
    base = len(s) - needed(len(s), num, den)
    most = min(MOST_MATCHES, len(s) - base)
    lists = np.cumsum(np.maximum(0.0, c[order[: base + most]] - common))
    best, least = 1, None
    for m in range(1, most + 1):
        cost = lists[base + m - 1] * (1 + COMPARE_COST / m) + 2 * m
        if least is None or cost < least:
            best, least = m, cost
    return s[order[: base + best]], best


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row for each row of ``df``: its id, n_shingles and component_id, the smallest id reachable by links, its own
    included.

    Two documents link when their sets of ``k``-word shingles have intersection / union >= num / den. Words are
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text of fewer words is one shingle. Null, empty and blank texts have
    an empty set and link with nothing; neither do rows without an id, whose component_id is null. Rows that repeat an
    id are one node. Very long texts are read whole, in parts; tied tokens go by their hash. Ids are integers. An empty
    table gives none; other columns are not read.
    """
    sc = df.sparkSession.sparkContext
    rows = df.select(id_column(df, id_col).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    nbytes = text_bytes(rows)
    total = sketch(rows, k, nbytes)
    common = float(np.median(total) + 3 * math.sqrt(np.median(total) + 1))
    sent = sc.broadcast(pickle.dumps(total))

    def sets(batches):
        counts = pickle.loads(sent.value).astype(np.int64)
        for batch in sliced(batches):
            out = []
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), k), strict=True):
                if doc is not None and len(s):
                    tokens, matches = prefix(s, counts, num, den, common)
                    out.append((doc, len(s), *set_digest(s), matches, tokens.tobytes(), signature(s).tobytes()))
                else:
                    out.append((doc, len(s), 0, 0, 0, b"", b""))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc", "n", "hi", "lo", "matches", "tokens", "sig"])

    w = written(rows.mapInArrow(sets, "doc long, n long, hi long, lo long, matches int, tokens binary, sig binary"), "shingle-prefixes")
    some = w.filter("doc is not null and n > 0")
    first = some.groupBy("hi", "lo").agg(F.min("doc").alias("node"))
    nodes = some.join(first, ["hi", "lo"])
    only = nodes.filter("doc = node").dropDuplicates(["doc", "hi", "lo"]).select("doc", "n", "matches", "tokens")
    shards = pieces_for(nbytes, SHARD_BYTES)
    found = written(repeats(only.mapInArrow(sender(_entries, shards), SENT)), "shingle-tokens")
    # rest holds the size of the set, the multi-match (4 bits) and the place in the prefix (28 bits: a text has at most
    # 2**31 bytes, so 2**30 words, of which a prefix at these similarities takes less than a quarter).
    p = found.select("fp", "doc", F.col("rest").bitwiseAND(_AT).alias("at"), F.shiftright("rest", 28).bitwiseAND(0xF).alias("m"), F.shiftright("rest", 32).alias("n"))

    degree = p.groupBy("doc").agg(F.count("*").alias("degree"))
    ranked = p.join(degree, "doc")
    hubs = ranked.groupBy("fp").agg(F.max(F.struct("degree", (-F.col("doc")).alias("d"), "n", "at", "m")).alias("h"), F.count("*").alias("size")).filter("size > 1")
    hubs = hubs.select("fp", (-F.col("h.d")).alias("hub"), *[F.col(f"h.{f}").alias(f"h{f}") for f in ("n", "at", "m")])
    # A pair that shares this token too late in either prefix is left to the tokens that it shares early.
    late = _ceil((F.col("n") + F.col("hn")) * num, num + den) - F.least("m", "hm")
    near = p.join(hubs, "fp").filter((F.col("doc") != F.col("hub")) & (den * F.least("n", "hn") >= num * F.greatest("n", "hn")) & (F.col("at") < F.col("n") - late) & (F.col("hat") < F.col("hn") - late))
    pairs = written(near.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct(), "shingle-pairs")
    sizes = written(rows.filter("doc is not null").groupBy("doc").agg(F.sum(F.octet_length("text")).alias("bytes")), "shingle-sizes")
    links = linked(rows, pairs, sizes, k, num, den)
    # Rows that repeat an id tie the nodes of their sets together.
    ties = nodes.filter("doc != node").select(F.col("doc").alias("a"), F.col("node").alias("b"))
    start = written(links.union(ties), "shingle-links")
    grouped = components(start)

    c = p.join(grouped.withColumnRenamed("node", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component")
    of_token = c.groupBy("fp", "c").count().groupBy("fp").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.sum("count").alias("size"), F.count("*").alias("kinds")).filter("kinds > 1")
    c = written(c.join(of_token, "fp"), "shingle-groups")
    # In a small group the pairs are few. The shorter set of a pair need only show a shorter prefix.
    few = c.filter(F.col("size") <= BLOCK_DOCS)
    x = few.filter(F.col("at") < F.col("n") - _ceil(F.col("n") * 2 * num, num + den) + F.col("m")).select("fp", *[F.col(f).alias(f"x_{f}") for f in ("doc", "at", "m", "n", "c")])
    y = few.select("fp", *[F.col(f).alias(f"y_{f}") for f in ("doc", "at", "m", "n", "c")])
    overlap, least = _ceil((F.col("x_n") + F.col("y_n")) * num, num + den), F.least("x_m", "y_m")
    passes = (
        ((F.col("y_n") > F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_doc") > F.col("x_doc"))))
        & (F.col("x_c") != F.col("y_c"))
        & (den * F.col("x_n") >= num * F.col("y_n"))
        & (F.col("x_at") < F.col("x_n") - overlap + least)
        & (F.col("y_at") < F.col("y_n") - overlap + least)
    )
    plain = x.join(y, (x["fp"] == y["fp"]) & passes).select(F.least("x_doc", "y_doc").alias("x_doc"), F.greatest("x_doc", "y_doc").alias("y_doc"), least.cast("int").alias("least"))
    # In a large one the members lie in blocks of bounded size, those of its largest component apart, for two of these
    # need no look; and pairs whose counts of tokens by bin do not allow the overlap are never made.
    many = c.filter(F.col("size") > BLOCK_DOCS).join(_signatures(some), ["doc", "n"])
    block = F.pmod(F.xxhash64("doc"), F.floor(F.col("size") / BLOCK_DOCS) + 1)
    held = many.groupBy("fp", (F.col("c") == F.col("main")).alias("main"), block.alias("block")).agg(F.collect_list(F.struct("doc", "at", "m", "n", "c", "sig")).alias("rows"))
    held = written(held, "shingle-blocks")
    x = held.filter("not main").select("fp", F.col("block").alias("xb"), F.col("rows").alias("xs"))
    y = held.select("fp", "main", F.col("block").alias("yb"), F.col("rows").alias("ys"))
    met = x.join(y, "fp").filter("main or xb <= yb").select((~F.col("main") & (F.col("xb") == F.col("yb"))).alias("same"), "xs", "ys")
    shared = met.mapInArrow(lambda batches: _met(batches, num, den), "x_doc long, y_doc long, least int")
    pairs2 = shared.union(plain).groupBy("x_doc", "y_doc").agg(F.count("*").alias("shared"), F.min("least").alias("least")).filter("shared >= least")
    pairs2 = pairs2.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b"))
    pairs2 = written(pairs2.join(pairs, ["a", "b"], "left_anti"), "shingle-pairs")
    more = linked(rows, pairs2, sizes, k, num, den)
    final = written(components(start.union(written(more, "shingle-links"))), "shingle-components")

    by_set = nodes.select("doc", "node").distinct().join(final, "node", "left")
    named = by_set.groupBy("doc").agg(F.min(F.coalesce("component", "node")).alias("c"))
    return w.join(named, "doc", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("c", "doc")).otherwise(F.col("doc")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **similar) -> DataFrame:
    """``df`` with one document of each component: that with the smallest id. Rows without an id all stay; rows that
    repeat an id stay or go together."""
    found = jaccard_components(df, id_col, text_col, **similar)
    gone = written(found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct(), "shingle-copies")
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")


def _ceil(a, b: int):
    return F.floor((a + (b - 1)) / b)


def signature(s: np.ndarray) -> np.ndarray:
    """How many tokens of a set fall into each of BINS bins; 255 stands for that many or more."""
    return np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def _signatures(sets: DataFrame) -> DataFrame:
    """(doc, n, sig) for the sets of each id by size. Sets of one id and size with different signatures get the one that
    allows any overlap."""
    one = F.when(F.min("sig") == F.max("sig"), F.max("sig")).otherwise(F.lit(b"\xff" * BINS))
    return sets.groupBy("doc", "n").agg(one.alias("sig"))


def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No smaller than the overlap of the sets of each pair of signatures: the sum of the lesser counts."""
    low = np.minimum(x, y).astype(np.int64)
    return np.where(low == 255, 1 << 40, low).sum(axis=1)


def _met(batches, num: int, den: int):
    """Pairs (shorter, longer, tokens to share) of two blocks of one token's members that may be similar enough."""
    for batch in batches:
        same = np.array(batch.column(0).to_pylist(), bool)
        sides = []
        for k in (1, 2):
            lists = batch.column(k)
            rows = lists.flatten()
            sizes = np.diff(np.asarray(lists.offsets))
            cols = {f: np.asarray(rows.field(f)) for f in ("doc", "at", "m", "n", "c")}
            sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint8).reshape(-1, BINS)
            sides.append((sizes, np.cumsum(sizes) - sizes, cols, sig))
        (xs, xo, xc, xg), (ys, yo, yc, yg) = sides
        counts = xs * ys
        total = np.cumsum(counts)
        i = 0
        while i < len(counts):  # as many rows as make about PAIRS_AT_ONCE pairs
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
            row = np.repeat(np.arange(i, j), counts[i:j])
            k = np.arange(len(row)) - np.repeat(np.cumsum(counts[i:j]) - counts[i:j], counts[i:j])
            a, b = xo[row] + k // ys[row], yo[row] + k % ys[row]
            keep = (xc["c"][a] != yc["c"][b]) & (~same[row] | (xc["doc"][a] < yc["doc"][b]))
            a, b = a[keep], b[keep]
            nx, ny = xc["n"][a], yc["n"][b]
            least = np.minimum(xc["m"][a], yc["m"][b])
            overlap = -(-num * (nx + ny) // (num + den))
            keep = (den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)) & (xc["at"][a] < nx - overlap + least) & (yc["at"][b] < ny - overlap + least)
            a, b, overlap, least = a[keep], b[keep], overlap[keep], least[keep]
            good = [np.flatnonzero(bound(xg[a[q : q + 16384]], yg[b[q : q + 16384]]) >= overlap[q : q + 16384]) + q for q in range(0, len(a), 16384)]
            good = np.concatenate(good) if good else np.zeros(0, np.int64)
            da, db = xc["doc"][a[good]], yc["doc"][b[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(da, db), pa.int64()), pa.array(np.maximum(da, db), pa.int64()), pa.array(least[good].astype(np.int32))], ["x_doc", "y_doc", "least"])
            i = j


def _entries(batch: pa.RecordBatch):
    docs, n, m, blobs = (c.to_pylist() for c in batch.columns)
    lengths = np.fromiter((len(b) // 8 for b in blobs), np.int64, len(blobs))
    fps = np.frombuffer(b"".join(blobs), np.uint64).copy()
    at = np.arange(len(fps)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rest = (np.repeat(np.array(n, np.int64), lengths) << 32) | (np.repeat(np.array(m, np.int64), lengths) << 28) | at
    return fps, rest.view(np.uint64), np.repeat(np.array(docs, np.int64), lengths)


def linked(rows: DataFrame, pairs: DataFrame, sizes: DataFrame, k: int, num: int, den: int, sent_rows: int = SENT_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """The pairs (a, b) of a written table whose whole texts are similar enough. ``sizes``: the bytes of each doc's texts.

    Pairs are dealt to cells by a hash of either side, so that a text goes to a cell once for all its pairs there. The
    number of cells follows the number of pairs and the bytes of the texts that they name. A cell's texts become sets one
    after the other in bounded memory.
    """
    n = pairs.count()
    nbytes = pairs.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").count().join(sizes, "doc").agg(F.sum(F.col("count") * F.col("bytes"))).first()[0] or 0
    # A cell holds no more than both texts of each of its pairs.
    side = math.isqrt(max(n // CELL_PAIRS, nbytes // cell_bytes)) + 1
    cell = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side))
    dealt = pairs.withColumn("cell", cell)
    wanted = written(dealt.select("cell", F.explode(F.array("a", "b")).alias("want")).distinct(), "shingle-cells")
    # Up to a checked number of rows the request goes to the texts; beyond, the texts go to the request.
    wanted_by = F.broadcast(wanted) if wanted.count() <= sent_rows else wanted.hint("shuffle_hash")
    texts = rows.join(wanted_by, F.col("doc") == F.col("want")).select("cell", "doc", "text")

    def verify(t: pa.Table, ps: pa.Table) -> pa.Table:
        have: dict[int, list] = {}
        for doc, s in zip(t["doc"].to_pylist(), shingle_sets(t["text"].cast(pa.binary()).to_pylist(), k), strict=True):
            have.setdefault(doc, []).append(s)
        out = [(a, b) for a, b in zip(ps["a"].to_pylist(), ps["b"].to_pylist(), strict=True) if any(similar(x, y, num, den) for x in have.get(a, ()) for y in have.get(b, ()))]
        del have
        release()
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return texts.groupBy("cell").cogroup(dealt.groupBy("cell")).applyInArrow(verify, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have intersection / union >= num / den; two empty ones have not."""
    if den * min(len(x), len(y)) < num * max(len(x), len(y)) or not len(x):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)
