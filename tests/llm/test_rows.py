"""Line dedup, decontamination, packing and quality rules against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import packing, queries, sightings
from blockweave.llm.decontaminate import mark_contaminated
from blockweave.llm.line_dedup import dedup_lines
from blockweave.llm.quality_rules import js_distance, quality_rules

from .fixtures import LINE, ODD, documents, real, same

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, least=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = collections.defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held[k].append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), ())) >= least and d < max(held[key(x)]))]
        out.append((d, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


@pytest.mark.parametrize("sent", [1 << 20, 0])
@pytest.mark.parametrize("which", ["odd", "real"])
def test_line_dedup(spark, sf_dir, which, sent):
    rows = ODD if which == "odd" else real(spark, sf_dir)
    got = dedup_lines(documents(spark, rows), sent_bytes=sent)
    assert "kept" in got.columns
    same(got.select("doc_id", "text", "n_lines", "n_dropped").collect(), brute_lines(rows))


def test_line_dedup_of_a_text_of_many_lines(spark):
    long = "\n".join(f"{LINE} number {i % 20_000}" for i in range(60_000))
    rows = [(i, long) for i in range(6)]
    for sent in (1 << 20, 0):
        got = dedup_lines(documents(spark, rows, extra=False), sent_bytes=sent).select("doc_id", "n_lines", "n_dropped").collect()
        same(got, [(i, 60_000, 60_000 if i < 5 else 0) for i in range(6)])


def test_line_dedup_nulls_and_empty_table(spark):
    rows = [(None, LINE)] * 6 + [(1, LINE)]
    got = dedup_lines(documents(spark, rows)).select("doc_id", "text", "n_dropped").collect()
    same(got, [(d, t, 0) for d, t in rows])
    assert dedup_lines(documents(spark, [])).count() == 0
    below = [(-i, LINE) for i in range(1, 8)]
    same(dedup_lines(documents(spark, below)).select("doc_id", "n_dropped").collect(), [(d, int(d < -1)) for d, _ in below])


@pytest.mark.parametrize("flush", [1, 400_000])
def test_line_dedup_counts_ids(spark, monkeypatch, flush):
    rows = [(7, LINE)] * 4 + [(9, LINE)] + [(i, LINE + " again") for i in (1, 1, 2, 3, 4, 5)]
    monkeypatch.setattr(sightings, "FLUSH", flush)
    docs = documents(spark, rows)
    for df in (docs.coalesce(1), docs.repartition(5)):
        got = dedup_lines(df).select("doc_id", "n_dropped").collect()
        same(got, [(d, int(d < 5)) for d, _ in rows])


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    fps = np.r_[rng.integers(0, 2**63, 5000), np.repeat(rng.integers(0, 2**63, 300), 4), np.full(900, 7)].astype(np.uint64)
    docs = np.arange(len(fps), dtype=np.int64)
    mix = rng.permutation(len(fps))
    sent = [r for part in np.array_split(mix, 7) for r in sightings.packed(fps[part], np.zeros(0, np.uint64), docs[part], 3)]
    import pyarrow as pa

    found = collections.Counter()
    for s in range(3):
        rows = [r for r in sent if r[0] == s]
        if rows:
            t = pa.table({k: pa.array([r[i] for r in rows]) for i, k in enumerate(("shard", "kind", "fps", "rest", "docs"))})
            told = sightings._told(t)
            found.update(zip(told["fp"].to_pylist(), told["doc"].to_pylist()))
    n = collections.Counter(fps.tolist())
    want = {(int(np.uint64(f).view(np.int64)), int(d)) for f, d in zip(fps, docs) if n[int(f)] > 1}
    assert want <= set(found) and max(found.values()) == 1 and len(found) < len(want) + 400


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "two WORDS"), (3, None), (4, "..."), (20, "c d e f g h i j k l m n"), (5, "straße"), (6, "word word word word word word word word word word word")]


def brute_hits(rows, items, m=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - m + 1) if w else 0):
            windows[tuple(w[k : k + m])].add(i)
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("blocks", [1 << 24, 20])
@pytest.mark.parametrize("which", ["odd", "real"])
def test_decontamination(spark, sf_dir, which, blocks):
    rows = ODD if which == "odd" else real(spark, sf_dir, 120)
    items = ITEMS if which == "odd" else [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    if which == "real" and blocks == 20:
        blocks = 4000
    b = spark.createDataFrame(items, "item_id long, text string")
    got = mark_contaminated(documents(spark, rows), b, block_bytes=blocks).select("doc_id", "n_words", "n_hit", "item_ids").collect()
    same(got, brute_hits(rows, items))


def test_blocks_of_test_texts_are_joined_by_shuffle_too(spark):
    rows = [*ODD, (30, "c d e f g h i j k l two words c d e f g h i j k l")] * 2
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = mark_contaminated(documents(spark, rows), b, block_bytes=60, sent_bytes=0).select("doc_id", "n_words", "n_hit", "item_ids").collect()
    same(got, brute_hits(rows, ITEMS))


def test_tables_are_small_and_search_random_words():
    import pickle

    from blockweave.llm.decontaminate import matched, tables, words

    rng = random.Random(3)
    for _ in range(150):
        some = [f"w{i}" for i in range(rng.choice([2, 3, 8, 30]))]
        items = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(0, 25)))) for i in range(rng.randrange(1, 8))]
        rows = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(0, 80))) + " " + rng.choice(items)[1]) for i in range(6)]
        found = tables([(i, t.encode()) for i, t in items])
        out = []
        for d, t in rows:
            w = words(t.encode())
            spans, which = matched(found, w)
            out.append((d, len(w), sum(b - a for a, b in spans), sorted(which)))
        assert out == brute_hits(rows, items)
    zipf = np.random.default_rng(0).zipf(1.3, 250_000) % 20_000
    big = [(i, " ".join(f"w{x}" for x in zipf[a : a + 500].tolist()).encode()) for i, a in enumerate(range(0, len(zipf), 500))]
    found = tables(big)
    assert len(pickle.dumps(found)) < 12 * sum(len(t) for _, t in big)
    assert {i for i, t in big[:20] if i in matched(found, words(t))[1]} == set(range(20))


def test_decontamination_without_rows(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in mark_contaminated(documents(spark), b).collect()} == {0}
    assert mark_contaminated(documents(spark, []), b).count() == 0


LONG_TEXTS = [
    (1, "a" + " " * 2_000_000 + "b"),
    (2, "\n" * 1_000_000),
    (3, "x" * 2_000_000),
    (4, "one" + " \n" * 60_000 + "<|endoftext|>" + "\t" * 150_000 + "two\u3000" + " " * 100_000 + "\n!"),
    (5, "<|endoftext|><|endoftext|> <|endoftext |>" + "漢" * 30_000),
]


@pytest.mark.parametrize("which", ["odd", "real", "long"])
def test_packing_is_a_round_trip(spark, sf_dir, which):
    from tokenizers import Tokenizer

    rows = {"odd": [r for r in ODD if r[0] != 14], "real": real(spark, sf_dir), "long": LONG_TEXTS}[which]
    t = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack(documents(spark, rows), queries.tokenizer_path()).collect()
    by = collections.defaultdict(list)
    seqs = collections.defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by) == len(rows)
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by[d], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist() == ids
        assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all


def test_special_tokens_are_ids():
    assert packing.encoder(queries.tokenizer_path())("a <|endoftext|> b") == [64, 220, 50256, 275]


def test_bins_hold_whole_pieces_of_their_class():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 3000, 3000)
    p = packing.Packer(2048, 0)
    for d, n in enumerate(sizes.tolist()):
        p.add(d, np.arange(n, dtype="<u4"))
    done = {s for *_, s, _ in p.rows}
    p.finish()
    by = collections.defaultdict(list)
    for doc, start, ids, total, seq, _ in p.rows:
        assert ids[0] == start and total == sizes[doc]
        by[seq].append((doc, len(ids), total))
    cut = 0
    for s, pieces in by.items():
        used = sum(n for _, n, _ in pieces)
        assert used == 2048 if s in done else used & (used - 1) == 0
        if s in done and pieces[0][1] < 2048:
            k = 2048 // pieces[0][1]
            assert {2048 // n for _, n, _ in pieces[:k]} == {k} and all(n == t % 2048 for _, n, t in pieces[:k])
            cut += len(pieces) - k
    assert sum(len(x) for x in by.values()) < (sizes // 2048).sum() + len(sizes) + 2 * len(by)


def test_ids_are_integers(spark):
    df = documents(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    with pytest.raises(TypeError, match="integers"):
        packing.pack(df, queries.tokenizer_path())


def test_packing_empty_table(spark):
    assert packing.pack(documents(spark, []), queries.tokenizer_path()).count() == 0


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = collections.defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    rep = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


@pytest.mark.parametrize("which", ["odd", "real"])
def test_base_rules(spark, sf_dir, which):
    rows = ODD if which == "odd" else real(spark, sf_dir)
    got = quality_rules(documents(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(got, [(d, *brute_rules(t)) for d, t in rows])


def test_rules_keep_good_and_reject_junk(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 3000")
    got = quality_rules(docs).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    r = got.filter("n_words >= 40 and not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, r))
    assert share[1] > 0.995 and share[0] < 0.1


@pytest.mark.parametrize("failed", [True, False])
def test_clean_documents_survive_a_junk_group(spark, failed):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 3000").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    of = quality_rules(docs).join(labels, "doc_id").filter("lang = 'en' and quality = 0 and n_words >= 100")
    junk = of.filter(F.col("base_failed") == failed).orderBy("doc_id").first()
    copies = spark.range(1500).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit(junk["text"]).alias("text"), F.lit("en").alias("lang"))
    got = quality_rules(docs.union(copies))
    clean = got.join(labels, "doc_id").filter("quality = 1 and n_words >= 40 and not base_failed")
    assert clean.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.995
    assert got.filter("doc_id >= 1000000 and kept").count() == 0


@pytest.mark.parametrize("sent", [2_000_000, 1])
def test_distinct_texts(spark, monkeypatch, sent):
    from blockweave.llm import quality_rules as Q

    monkeypatch.setattr(Q, "SENT_HASHES", sent)
    rows = [(t, lang) for t in (None, "", "a", "b", "c") for lang in ("en", "und")] * 2 + [("d", "en"), ("e", "en"), ("a", "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    same([tuple(r) for r in Q._distinct(df).collect()], set(rows))


def test_the_query_and_a_junk_group(spark, tmp_path):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 3000")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    junk = docs.join(labels, "doc_id").filter("lang = 'en' and quality = 0 and length(text) > 600").orderBy("doc_id").first()
    docs.union(spark.range(1500).select(*[F.lit(junk[c]).alias(c) if c != "doc_id" else (F.col("id") + 1_000_000).alias(c) for c in docs.columns])).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_quality_rules(spark, str(tmp_path))
    clean = got.join(labels, "doc_id").filter("quality = 1 and n_words >= 40 and not base_failed")
    assert clean.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.995


def test_a_language_of_failed_texts_only(spark):
    rows = [(1, "word " * 300), (2, None), (3, "one two")]
    got = quality_rules(documents(spark, rows)).select("doc_id", "base_failed", "class_distance", "word_distance", "kept").collect()
    same(got, [(d, True, 0.0, 0.0, False) for d, _ in rows])


def test_rules_empty_table(spark):
    assert quality_rules(documents(spark, [])).count() == 0


def test_js_distance(spark):
    r = spark.range(1).select(js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), js_distance(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("near")).first()
    assert (r["far"], r["near"]) == (1.0, 0.0)


def test_queries_have_their_columns(spark, sf_dir):
    assert queries.op2_line_dedup(spark, sf_dir).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    r = queries.op3_decontaminate(spark, sf_dir).filter("n_hit = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() and not r["contaminated"]
    random.seed(0)
