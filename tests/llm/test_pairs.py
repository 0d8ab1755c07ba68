"""The Jaccard join and connected components against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from blockweave.llm import jaccard, sightings
from blockweave.llm.graph import components
from blockweave.llm.shingles import shingle_sets

from .fixtures import ODD, documents, real, same

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [brute_set(t, k) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    seen = set()
    for s in holders.values():
        for i in s:
            for j in s:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if den * both >= num * len(sets[i] | sets[j]):
                        a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                        root[b] = a
    return [(d, len(s), find(d)) for (d, _), s in zip(rows, sets, strict=True)]


def near_copies(n=60, words=120, edits=8, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        out.append((1000 + i * 7 % n, " ".join(w[: words - rng.randrange(6)])))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
@pytest.mark.parametrize("which", ["odd", "copies", "real"])
def test_components(spark, sf_dir, which, k, num, den):
    rows = {"odd": ODD, "copies": near_copies(), "real": real(spark, sf_dir)}[which]
    got = jaccard.jaccard_components(documents(spark, rows), k=k, num=num, den=den)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    same(got.collect(), brute(rows, k, num, den))


def test_a_search_without_the_sent_request(spark, monkeypatch):
    monkeypatch.setattr(jaccard.linked, "__defaults__", (0, 2000))
    monkeypatch.setattr(jaccard, "CELL_PAIRS", 20)
    rows = near_copies(40)
    same(jaccard.jaccard_components(documents(spark, rows), k=3, num=90, den=100).collect(), brute(rows, 3, 90, 100))


def test_nulls_and_empty_table(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (9, "A b  c D"), (4, None), (5, "")]
    got = jaccard.jaccard_components(documents(spark, rows), k=3, num=90, den=100).collect()
    same(got, [(None, 2, None), (None, 2, None), (3, 2, 3), (9, 2, 3), (4, 0, 4), (5, 0, 5)])
    kept = jaccard.one_of_each(documents(spark, rows), k=3, num=90, den=100)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "None", "None"]
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 50, jaccard.SKETCH).astype(np.int64)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = rng.random(len(x)) < 0.93
        y = np.unique(np.r_[x[keep], rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)])
        if not jaccard.similar(x, y, 8, 10):
            continue
        (px, mx), (py, my) = jaccard.prefix(x, counts, 8, 10, 20.0), jaccard.prefix(y, counts, 8, 10, 20.0)
        m = min(mx, my)
        o = -(-8 * (len(x) + len(y)) // 18)
        assert len(set(px[: len(x) - o + m].tolist()) & set(py[: len(y) - o + m].tolist())) >= m


def test_shingles_of_a_block(monkeypatch):
    from blockweave.llm import shingles

    monkeypatch.setattr(shingles, "BLOCK", 50)
    texts = [(t or "").encode() for _, t in ODD]
    assert [len(s) for s in shingle_sets(texts, 3)] == [len(brute_set(t, 3)) for _, t in ODD]


def test_graph(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(7)
    for n in (5, 300, 90_000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.r_[x[: n // 2], rng.integers(0, 2**63, n // 2).astype(np.uint64)])
        assert jaccard.bound(jaccard.signature(x)[None], jaccard.signature(y)[None])[0] >= len(np.intersect1d(x, y))


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 6)
    rows = near_copies(80, 90, 12, 8) + [(5000 + d, t + " and some more") for d, t in near_copies(30, 200, 9, 9)]
    same(jaccard.jaccard_components(documents(spark, rows), k=3, num=90, den=100).collect(), brute(rows, 3, 90, 100))


@pytest.mark.parametrize("block", [6, 128])
def test_ids_with_different_texts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rows = near_copies(80, 90, 12, 8)
    rng = random.Random(4)
    cut = lambda t: " ".join(t.split()[: rng.randrange(45, 90)])
    rows += [(d, cut(t)) for d, t in rows[::2]] + [(d, " ".join(f"u{d}x{rng.randrange(300)}" for _ in t.split())) for d, t in rows[1::2]]
    same(jaccard.jaccard_components(documents(spark, rows), k=3, num=90, den=100).collect(), brute(rows, 3, 90, 100))


def test_signatures_of_an_id_with_two_sets(spark):
    a, b = (jaccard.signature(np.arange(s, s + 40, dtype=np.uint64)).tobytes() for s in (0, 100))
    rows = [(7, 40, a), (7, 40, b), (7, 41, a), (9, 40, b), (9, 40, b)]
    got = {(r["doc"], r["n"]): bytes(r["sig"]) for r in jaccard._signatures(spark.createDataFrame(rows, "doc long, n long, sig binary")).collect()}
    assert got == {(7, 40): b"\xff" * jaccard.BINS, (7, 41): a, (9, 40): b}
    assert jaccard.bound(*(np.frombuffer(got[k], np.uint8)[None] for k in ((7, 40), (9, 40))))[0] >= 40


def test_sets_of_an_id_keep_their_places():
    fps, rest, docs = np.array([5, 5], np.uint64), np.array([1, 2], np.uint64), np.array([7, 7], np.int64)
    sent = [r for part in ((fps, rest, docs), (fps[:1], rest[:1] + np.uint64(2), docs[:1] + 2)) for r in sightings.packed(*part, 1)]
    told = sightings._told(pa.table({k: pa.array([r[i] for r in sent]) for i, k in enumerate(("shard", "kind", "fps", "rest", "docs"))}))
    assert sorted(zip(told["doc"].to_pylist(), told["rest"].to_pylist(), strict=True)) == [(7, 1), (7, 2), (9, 3)]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_words_are_hashed_in_parts(monkeypatch, block):
    from blockweave.llm import shingles

    texts = [b"one two  three", None, b"", b"  a", "é漢 Two x".encode() * 20, b"y" * 300, b"one"]
    want = [s.tolist() for s in shingles.shingle_sets(texts, 2)]
    h, at = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "BLOCK", block)
    part, where = shingles.word_hashes(texts)
    assert part.tolist() == h.tolist() and where.tolist() == at.tolist() and h[0] == h[-1] and len(set(h[:3].tolist())) == 3
    assert [s.tolist() for s in shingles.shingle_sets(texts, 2)] == want


def test_a_long_text_takes_little_memory():
    import subprocess
    import sys

    code = "import resource, sys; from blockweave.llm.shingles import shingle_sets; t = b' '.join(b'w%d' % (i % 90001) for i in range(3_000_000)); a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; n = sum(len(s) for s in shingle_sets([t], 3)); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) * 1024 / len(t))"
    assert float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 16
