"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from blockweave.llm.resample import ranked, resample

from .fixtures import ODD, documents, same


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), w + [" ".join(x) for x in zip(w, w[1:])]


def brute(rows, target, percent=25, least=20, seed=7, buckets=10_000):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(place(f) for _, t in rows for f in features(t)[1])
    t = collections.Counter(place(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out, able = [], []
    for i, (d, text) in enumerate(rows):
        n, f = features(text)
        weight = sum(gain(place(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, len(f), weight, score))
        if n >= least:
            able.append((-score, d is None, d, i))
    rank = {i: r + 1 for r, (*_, i) in enumerate(sorted(able)[: percent * len(able) // 100])}
    return [(*x, rank.get(i)) for i, x in enumerate(out)]


def target_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def found(df, target, **kw):
    return [tuple(r) for r in resample(df, target, **kw).select("doc_id", "n_features", "weight", "score", "rank").collect()]


def made(n=300):
    rng = random.Random(2)
    words = ["alpha", "Beta", "γάμμα", "d3lta", "ÉPSILON", "漢字", "zeta", "eta", "theta"]
    return [(i * 3 - 200, " ".join(rng.choices(words[i % 4 :], k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("percent", "least", "buckets"), [(25, 20, 10_000), (100, 1, 50), (0, 20, 7)])
def test_equals_brute_force(spark, percent, least, buckets):
    rows, target = made(), ["alpha beta γάμμα", None, "", "theta theta"]
    same(found(documents(spark, rows).repartition(5), target_of(spark, target), percent=percent, min_words=least, buckets=buckets), brute(rows, target, percent, least, 7, buckets))


def test_odd_rows_and_empty_tables(spark):
    rows = [*[r for r in ODD if r[0] != 14], (None, "one two three " * 10)]
    same(found(documents(spark, rows), target_of(spark, ["word word"])), brute(rows, ["word word"]))
    same(found(documents(spark, rows), target_of(spark, [])), brute(rows, []))
    assert found(documents(spark, []), target_of(spark, ["a"])) == []


def test_repeated_rows_are_ranked_each(spark):
    rows = [(5, "a b c " * 10)] * 8 + [(6, "a b c " * 10)]
    got = found(documents(spark, rows), target_of(spark, ["a b"]), percent=100)
    assert sorted(r[4] for r in got) == list(range(1, 10)) and {r[:4] for r in got} == {r[:4] for r in brute(rows, ["a b"])}


def test_ranks_go_on_over_ranges(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 30)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, score long").repartition(7)
    got = {r["id"]: r["rank"] for r in ranked(df, [df.score.desc(), df.id.asc()]).collect()}
    assert [i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))] == sorted(got, key=got.get)
    assert sorted(got.values()) == list(range(1, 5001))
