"""Source divergence audit: how the words of a source differ from its language's, and from every other source's.

One aggregate counts terms by (language, source), with counters in the workers so that a hot source is one row a term and
task. The term search gives each group's terms to buckets by count: a bucket's largest count and the least probability
that the language gives any of its terms bound what a term of it can differ, buckets are evaluated best bound first, and
the search ends once the next bound is strictly below the k-th value. Pairs are computed from postings, the sources of a
term: tiles of at most TILE by TILE sources and one shard of the terms add up in memory, and give one row a pair.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces_for, written

#: Probabilities are whole numbers of this unit; every count is raised by SMOOTH.
UNIT, SMOOTH = 1_000_000_000, 5
#: Distinct terms that a worker's counters hold, bytes of a text that are split at once, postings of a shard, sources of a tile's side.
HELD, SLICE, SHARD, TILE = 300_000, 4 << 20, 50_000, 64
#: Shards of the postings that one search for a group's terms takes together.
SEARCHED = 8
#: A-Z become a-z; bytes 0x00-0x40, 0x5B-0x60 and 0x7B-0x7F part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "lang string, source string, part string, item string, value long, rank int"


def terms_of(raw: bytes):
    """Lists of the terms of a text, a list for each SLICE of it or a little more; no term is parted."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw) and _FOLD[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_FOLD).split()
        at = end


def _counted(batches):
    """(lang, source, term, n, docs) of a task's documents, added up as far as HELD terms."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            made = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), made, pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        counts.clear()

    for batch in batches:
        for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            mine: set[bytes] = set()
            for terms in terms_of(raw):
                n.update(terms)
                mine.update(terms)
            docs.update(mine)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from rows()
    yield from rows()


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)) without rounding: long division, three digits at a time, so
    that totals up to 9e15 do not overflow. 0 where there are no terms."""
    below = F.greatest(total + SMOOTH * terms, F.lit(1))
    rest, out = count + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + F.call_function("div", rest, below), F.pmod(rest, below)
    return F.when(terms > 0, 1 + out).otherwise(0)


def best_terms(p: np.ndarray, q: np.ndarray, count: np.ndarray, terms: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The places of the ``k`` terms with the largest p - q above 0, ties by term, and how many terms were evaluated.

    p never falls as the count rises, so the p of a bucket's largest count less the least q of its terms bounds the bucket.
    """
    bucket = np.frexp(count.astype(np.float64))[1]  # a bucket a power of two
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, int)
    high, low = (np.maximum.reduceat(p[order], starts), np.minimum.reduceat(q[order], starts)) if len(order) else (p, q)
    ends = np.r_[starts[1:], len(order)]
    best, seen = np.zeros(0, int), 0
    for b in np.argsort(low - high, kind="stable"):
        bound = high[b] - low[b]
        if bound <= 0 or len(best) == k and bound < p[best[-1]] - q[best[-1]]:
            break
        at = order[starts[b] : ends[b]]
        seen += len(at)
        best = np.r_[best, at[p[at] > q[at]]]
        best = best[np.lexsort((terms[best], q[best] - p[best]))][:k]
    return best, seen


def _searched(k: int):
    def run(t: pa.Table) -> pa.Table:
        p, q, count = (np.asarray(t[c].combine_chunks()) for c in ("p", "q", "n"))
        terms = np.array([x.encode() for x in t["term"].to_pylist()], object)
        at = pa.array(best_terms(p, q, count, terms, k)[0])
        found = t.take(at)
        return pa.table({"lang": found["lang"], "source": found["source"], "item": found["term"], "value": pa.array((p - q)[np.asarray(at)], pa.int64())})

    return run


def _tile(t: pa.Table) -> pa.Table:
    """Sums of |p - p'| for the pairs of a tile over the terms of its postings. Rows without a term tell a source's p of absent terms."""
    left, g, p = (np.asarray(t[c].combine_chunks()) for c in ("left", "g", "p"))
    code = t["term"].combine_chunks().dictionary_encode()
    base = np.asarray(code.is_null())
    term = np.asarray(code.indices.fill_null(0)).astype(np.int64)
    a, b = np.unique(g[left & base]), np.unique(g[~left & base])
    same = t["a"][0].as_py() == t["b"][0].as_py()
    if same:
        b = a
    place, names = np.zeros(len(g), np.int64), ((a, left), (b, np.ones_like(left) if same else ~left))
    total, n, step = np.zeros((len(a), len(b)), np.int64), len(code.dictionary), 256
    sides = []
    for ids, mine in names:
        low = np.zeros(len(ids), np.int64)
        low[np.searchsorted(ids, g[mine & base])] = p[mine & base]
        at = np.flatnonzero(mine & ~base)
        at = at[np.argsort(term[at], kind="stable")]
        place[at] = np.searchsorted(ids, g[at])
        sides.append((low, at, term[at], place[at], p[at]))
    for i in range(0, n, step):
        blocks = []
        for low, _, of, row, value in sides:
            lo, hi = np.searchsorted(of, [i, i + step])
            m = np.repeat(low[:, None], min(step, n - i), axis=1)
            m[row[lo:hi], of[lo:hi] - i] = value[lo:hi]
            blocks.append(m)
        for r, row in enumerate(blocks[0]):
            total[r] += np.abs(blocks[1] - row).sum(axis=1)
    x, y = np.meshgrid(a, b, indexing="ij")
    keep = (x < y).ravel()
    return pa.table({"lang": pa.array([t["lang"][0].as_py()] * int(keep.sum()), pa.string()), "x": pa.array(x.ravel()[keep], pa.int32()), "y": pa.array(y.ravel()[keep], pa.int32()), "f": pa.array(total.ravel()[keep], pa.int64()), "terms": pa.array([n] * int(keep.sum()), pa.int64())})


def divergence(df: DataFrame, min_docs: int = 30, k: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every occurring pair of language and source.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps the terms that at least
    ``min_docs`` of its rows hold. A group, and a language, gives each kept term
    p = 1 + floor(UNIT * (n + 5) / (N + 5 * V)). Part ``pair`` has each other source of the language with the sum of
    |p - p'| over all kept terms; part ``term`` the ``k`` terms that occur in the group with the largest p above the language's.
    Ranks count from 1, larger values first, ties by the item's UTF-8 bytes.

    Null and empty language, source and text are ''. Texts are counted in slices, whatever their length; rows that repeat
    count each; other columns are not read. A group without kept terms has pairs but no terms; a language without
    kept terms has pairs of value 0. An empty table gives none.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counted = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-terms")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    postings = written(counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-postings")

    # A kept term occurs in some source of its language, so languages add up from postings.
    sources = docs.select("lang", "source").distinct().join(postings.groupBy("lang", "source").agg(F.sum("n").alias("held")), ["lang", "source"], "left")
    langs = postings.groupBy("lang").agg(F.count_distinct("term").alias("kinds"), F.sum("n").alias("mass"))
    groups = sources.join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("held", "kinds", "mass")])
    groups = groups.withColumns({"g": F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1, "base": share(F.lit(0), F.col("held"), F.col("kinds"))})
    groups = written(groups, "divergence-groups")

    shards = pieces_for(postings.count(), shard)
    told = postings.join(groups, ["lang", "source"]).select("lang", "source", "g", "term", "n", share(F.col("n"), F.col("held"), F.col("kinds")).alias("p"), share(F.col("whole"), F.col("mass"), F.col("kinds")).alias("q"))
    told = told.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    terms = told.groupBy("lang", "source", F.pmod("shard", F.lit(pieces_for(shards, SEARCHED))).alias("part")).applyInArrow(_searched(k), "lang string, source string, item string, value long")

    tiles = groups.groupBy("lang").agg(F.floor((F.max("g") + TILE) / TILE).cast("int").alias("tiles"))
    bases = groups.select("lang", "g", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    sent = told.select("lang", "g", "term", "p", "shard").unionByName(bases).join(tiles, "lang").withColumn("own", F.floor(F.col("g") / TILE).cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sent = sent.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "shard", (F.col("own") <= F.col("other")).alias("left"), "g", "term", "p")
    sums = sent.groupBy("lang", "a", "b", "shard").applyInArrow(_tile, "lang string, x int, y int, f long, terms long")
    sums = sums.groupBy("lang", "x", "y").agg(F.sum("f").alias("f"), F.sum("terms").alias("terms"))
    of = lambda g, name: groups.select("lang", F.col("g").alias(g), F.col("source").alias(name), F.col("base").alias(f"{name}_base"), "kinds" if g == "x" else F.lit(0).alias("_"))
    pairs = sums.join(of("x", "source"), ["lang", "x"]).join(of("y", "item"), ["lang", "y"])
    # Terms that neither tile holds differ by what both give to absent terms.
    value = F.col("f") + (F.col("kinds") - F.col("terms")) * F.abs(F.col("source_base") - F.col("item_base"))
    pairs = pairs.withColumn("value", value).select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p"), "value").select("lang", "p.*", "value")

    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = both.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= k))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
