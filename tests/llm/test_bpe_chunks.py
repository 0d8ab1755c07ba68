"""Chunked encoding equals the tokenizer's own on whole texts, and decoding its own."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockweave.llm import bpe_chunks as B
from blockweave.llm import queries

from .fixtures import ODD, documents, real, same

PATH = queries.word_tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)
ALPHABET = ["a", "B", "é", "é", "́", " ", "\n", "\x0b", "\x0c", "\x1c", "\x85", " ", "　", "'s", "'", "İ", "ẞ", "漢", "1", "٣", "<|endoftext|>", "<|ENDOFTEXT|>", "😀", "_", "-", "‍", "K", "\xa0", "\t"]


def brute(rows):
    ids = [PLAIN.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    return [(d, len(x), x, PLAIN.decode(x, skip_special_tokens=False)) for (d, _), x in zip(rows, ids, strict=True)]


def both(df):
    return [tuple(r) for r in B.decode(B.encode(df, PATH), PATH).select("doc_id", "n_tokens", "ids", "decoded").collect()]


def shared_rows():
    """Texts that share passages at any place, with cuts inside words and runs without white space."""
    rng = random.Random(9)
    words = lambda n: "".join("".join(rng.choices(ALPHABET[:5] + ["th", "ing", "Q"], k=rng.randint(1, 9))) + rng.choice([" ", "\n", "  ", " "]) for _ in range(n))
    passages = [words(1500) for _ in range(3)] + ["x9é" * 4000, "漢字" * 3000]
    rows = [(i, words(rng.randint(0, 300)) + "".join(rng.choices(passages, k=rng.randint(0, 3))) + words(rng.randint(0, 300))) for i in range(40)]
    return [*rows, *rows[:5], (None, passages[0]), (None, passages[0]), (99, None)]


@pytest.mark.parametrize("which", ["odd", "real", "shared"])
def test_equals_the_tokenizer(spark, sf_dir, which):
    rows = {"odd": lambda: ODD, "real": lambda: real(spark, sf_dir), "shared": shared_rows}[which]()
    same(both(documents(spark, rows).repartition(3)), brute(rows))


def test_small_chunks(spark, monkeypatch):
    rows = shared_rows()[:12]
    data = [(t or "").encode() for _, t in rows]
    for least, wanted, most in ((32, 64, 128), (32, 1024, 40), (4096, 2, 1 << 20)):
        for name, value in (("LEAST", least), ("WANTED", wanted), ("MOST", most)):
            monkeypatch.setattr(B, name, value)
        raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]).astype(np.int32)
        every = np.full(16, -1, np.int64).view(np.uint64)  # a filter that holds all
        encoder = B.Encoder(PATH)
        for row, mine in B._shared(raw, offsets, every):
            at, parts = int(offsets[row]), []
            for a, b, _ in [*mine, (int(offsets[row + 1]),) * 3]:
                parts += encoder.ids([raw[at:a].tobytes(), raw[a:b].tobytes()])
                at = b
            assert np.frombuffer(b"".join(parts), encoder.kind).tolist() == PLAIN.encode(rows[row][1] or "", add_special_tokens=False).ids


def test_chunks_are_shared(spark):
    rng = np.random.default_rng(2)
    passage, ends = rng.integers(97, 123, 50_000, np.uint8), [rng.integers(97, 123, n, np.uint8) for n in (10, 3333, 777)]
    found = []
    for e in ends:
        data = np.concatenate([e, passage, e])
        found.append({d for _, c in B._chunked(data, np.array([0, len(data)], np.int32)) for _, _, d in c})
    assert len(found[0] & found[1] & found[2]) > 0.8 * len(found[0])


def test_cuts_do_not_depend_on_blocks(monkeypatch):
    data = np.random.default_rng(3).integers(0, 256, 100_000, np.uint8)
    whole = B.candidates(data)
    for block in (33, 1000, 99_999):
        monkeypatch.setattr(B, "BLOCK", block)
        assert B.candidates(data).tolist() == whole.tolist()
    assert 50 < len(whole) < 150
    assert sum(b - a for a, b in B.chunks(0, 100_000, whole.tolist())) == 100_000


def test_random_pieces_and_forgetting(monkeypatch):
    rng, encoder = random.Random(4), B.Encoder(PATH)
    monkeypatch.setattr(B, "REMEMBERED", 50)
    monkeypatch.setattr(B, "SPLIT", 300)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(3000)] + ["y" * 70 + " z"] * 3
    for text, ids in zip(texts, encoder.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == PLAIN.encode(text, add_special_tokens=False).ids, text


def test_filter_holds_all(spark):
    digests = [bytes(np.random.default_rng(i).integers(0, 256, 16, np.uint8)) for i in range(500)]
    pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2).tolist()
    words = B.filter_of(spark.createDataFrame([tuple(p) for p in pairs[:250]], "hi long, lo long"))
    told = B.held(words, digests)
    assert all(told[:250]) and sum(told[250:]) < 25


def test_empty_table_and_refused_tokenizer(spark):
    assert both(documents(spark, [])) == []
    with pytest.raises(ValueError, match="white space"):
        B.encode(documents(spark), queries.tokenizer_path())
    with pytest.raises(TypeError):
        B.encode(documents(spark).withColumn("doc_id", F.col("text")), PATH)


def test_decode_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (3, [518, 49407], "c")], "doc_id long, ids array<int>, decoded string")
    same([tuple(r) for r in B.decode(df, PATH).select("doc_id", "decoded").collect()], [(1, None), (2, ""), (3, PLAIN.decode([518, 49407], skip_special_tokens=False))])
