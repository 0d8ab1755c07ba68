"""The divergence audit against plain Python, its search, its tiles and odd input."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from blockweave.llm import divergence as D

from .fixtures import documents, same

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "text", "rank", "n")])


def brute(rows, least, k=50):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        g = (lang or "", source or "")
        groups.add(g)
        counts[g].update(terms)
        docs[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = sorted(s for x, s in groups if x == lang)
        each = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(each[s][t] for s in sources) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, ps = p(whole), {s: p(each[s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(ps[s][t] - q[t], t) for t in kept if each[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r + 1) for r, (v, item) in enumerate(found) if part == "pair" or r < k]
    return out


def made(seed, n=400, sources=7):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3] * (i // 10)}" for i in range(60)] + ["Zürich", "漢字", "É", "é", "😀"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice([None, *[f"s{min(i, 2) if rng.random() < 0.4 else i}" for i in range(sources)]])
        rows.append((lang, source, " 12-3_".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 40)))))
    return rows + [("xx", "alone", "rare words"), ("xx", "other", None), ("yy", "", "")]


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA)
    return [tuple(r) for r in D.divergence(df, **kw).collect()]


@pytest.mark.parametrize(("tile", "shard"), [(64, 500_000), (2, 500_000), (3, 40)])
def test_every_tile_and_shard(spark, monkeypatch, tile, shard):
    monkeypatch.setattr(D, "TILE", tile)
    rows = made(3)
    same(found(spark, rows, min_docs=10, k=9, shard=shard), brute(rows, 10, 9))


def test_ties_and_repeated_rows(spark):
    rows = [("en", f"s{i % 3}", "alpha beta gamma delta") for i in range(60)] + [("en", "s0", "alpha beta")] * 40
    same(found(spark, rows, k=2), brute(rows, 30, 2))


def test_odd_and_empty(spark):
    df = documents(spark)
    same([tuple(r) for r in D.divergence(df, min_docs=1).collect()], brute([tuple(r) for r in df.select("lang", "source", "text").collect()], 1))
    assert D.divergence(documents(spark, [])).count() == 0


def test_long_text_is_counted_in_slices(monkeypatch):
    monkeypatch.setattr(D, "SLICE", 10)
    raw = "Alpha béta-gamma  déltadéltadéltadélta e".encode()
    assert [t for x in D.terms_of(raw) for t in x] == [x.encode() for x in ("alpha", "béta", "gamma", "déltadéltadéltadélta", "e")]


def test_flushed_counters(spark, monkeypatch):
    rows = made(4, 60)
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "cast(coalesce(text, '') as binary) text").toArrow()
    whole = lambda: collections.Counter({tuple(r.values())[:3]: r["n"] for b in D._counted(df.to_batches(max_chunksize=7)) for r in b.to_pylist()})
    once = whole()
    monkeypatch.setattr(D, "HELD", 3)
    added = collections.Counter()
    for b in D._counted(df.to_batches(max_chunksize=7)):
        for r in b.to_pylist():
            added[tuple(r.values())[:3]] += r["n"]
    assert added == once


def test_search_is_exact_and_stops():
    rng = np.random.default_rng(5)
    count = np.minimum(rng.zipf(1.3, 20_000), 10**6).astype(np.int64)
    total = int(count.sum())
    p = 1 + 10**9 * (count + 5) // (total + 5 * len(count))
    q = np.maximum(1, (p * rng.uniform(0.5, 1.5, len(p))).astype(np.int64))
    terms = np.array([f"t{i}".encode() for i in range(len(p))], object)
    best, seen = D.best_terms(p, q, count, terms, 50)
    expected = sorted(np.flatnonzero(p > q), key=lambda i: (q[i] - p[i], terms[i]))[:50]
    assert best.tolist() == expected and seen < len(p) / 4
    assert D.best_terms(p[:0], q[:0], count[:0], terms[:0], 5)[0].tolist() == []


def test_share_of_large_totals(spark):
    rows = [(c, n, v) for n in (0, 7, 10**6, 8 * 10**15) for c in {0, n // 3, n} for v in (0, 1, 50_000)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    for r in df.select("*", D.share(df.c, df.n, df.v).alias("p")).collect():
        assert r["p"] == (1 + 10**9 * (r["c"] + 5) // (r["n"] + 5 * r["v"]) if r["v"] else 0)
