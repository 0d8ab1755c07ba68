"""Repeated passages and the merged transforms against plain Python."""

import random

import numpy as np
import pytest

from blockweave.llm import bwt, suffix_dedup

from .fixtures import ODD, documents, real, same


def brute(rows, n=50):
    least = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, r in raws:
        if d is not None:
            for i in range(len(r) - n + 1):
                w = r[i : i + n]
                if d < least.get(w, 1 << 62):
                    least[w] = d
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1 if d is not None else 0):
            if least[r[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, kept))
    return out


def passages(seed=1, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randrange(5, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng.randrange(0, 40)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        if rng.random() < 0.3:
            s = rng.choice(shared)
            parts.append(s[: rng.randrange(len(s))] + s)
        rows.append((i * 3 % n, "".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200 + i, rows[i][1][3:] + "x") for i in range(5)] + [(300, "ab" * 300), (301, "ab" * 400), (302, "ba" * 24), (303, "b" + "ab" * 24 + "a")]
    return rows


@pytest.mark.parametrize("which", ["passages", "odd", "real"])
def test_removal(spark, sf_dir, which):
    rows = {"passages": passages(), "odd": [(d, t and t[:9000]) for d, t in ODD], "real": [(d, t[:2500]) for d, t in real(spark, sf_dir)]}[which]
    got = suffix_dedup.remove_repeats(documents(spark, rows))
    assert "fp" in got.columns
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect(), brute(rows))


def test_shuffled_spans_small_parts_and_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 6000)
    monkeypatch.setattr(suffix_dedup, "MERGED", 500)
    rows = passages(4)
    same(suffix_dedup.remove_repeats(documents(spark, rows), sent_bytes=0).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect(), brute(rows))
    monkeypatch.setattr(suffix_dedup, "_PART", 64)
    raw = np.frombuffer(passages(5)[0][1].encode() * 3, np.uint8)
    first, last, at, _ = suffix_dedup.anchors(raw, 50)
    assert first[0] == 0 and last[-1] == len(raw) - 50 and (first[1:] == last[:-1] + 1).all() and ((at >= first) & (at + 16 <= last + 50)).all()


@pytest.mark.parametrize("hottest", [5, 10**9])
def test_hot_anchors_are_split(spark, monkeypatch, hottest):
    """One anchor in all documents, with distinct contexts, some of which repeat."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "HOTTEST", hottest)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 30)))
    rows = [(i, f"{word()} {word()} {'-' * 16} the same sixteen {word()} {word()}") for i in range(60)]
    rows += [(100 + i, word() + rows[i][1][5:]) for i in range(10)] + [(200 + i, "-" * rng.randrange(40, 200) + word()) for i in range(10)] + [(300 + i, rows[0][1] + word()) for i in range(6)]
    same(suffix_dedup.remove_repeats(documents(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect(), brute(rows))


def test_a_hot_anchor_spreads_over_keys():
    rng = random.Random(2)
    raws = [("".join(rng.choice("abcdefgh") for _ in range(40)) + "=" * 16 + "".join(rng.choice("abcdefgh") for _ in range(40))).encode() for _ in range(500)]
    for way, most in ((1, 60), (2, 3)):
        seen = {}
        for raw in raws:
            for a, b, k in suffix_dedup._split(raw, 6, 40, 7, way, 50):
                assert 6 <= a <= b <= 40
                seen[k] = seen.get(k, 0) + 1
        assert max(seen.values()) <= most


def test_nulls_and_empty_table(spark):
    t = "a passage that is certainly longer than fifty bytes, is it not?"
    rows = [(None, t), (None, t), (5, t), (5, t), (6, t), (7, None), (8, "")]
    got = suffix_dedup.remove_repeats(documents(spark, rows)).select("doc_id", "n_removed").collect()
    same(got, [(d, len(t) if d == 6 else 0) for d, _ in rows])
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [30, 200, 1 << 18])
def test_merged_transforms(shard):
    rng = random.Random(shard)
    strings = [bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randrange(12, 60))) for _ in range(60)]
    values = np.array([rng.randrange(1000) for _ in strings])
    got = bwt.least_holder(strings, values, 10, shard)
    for s, g in zip(strings, got, strict=True):
        assert g.tolist() == [min(v for o, v in zip(strings, values.tolist(), strict=True) if s[i : i + 10] in o) for i in range(len(s) - 9)]


def test_interleave_orders_rotations():
    parts = [[b"banana", b"bandana"], [b"anna", b"nab"], [b"ban"]]
    t = [bwt.Strings(p) for p in parts]
    built = [bwt.transform(x) for x in t]
    z, prefix = bwt.merge([b for b, _ in built], 4)
    ranks = [iter(o.tolist()) for _, o in built]
    seen = []
    for s in z.tolist():
        i = next(ranks[s])
        x = t[s]
        seen.append(bytes(x.symbols[x.starts[x.owner[i]] + (x.place[i] + q) % x.lengths[x.owner[i]]] for q in range(4)))
    assert seen == sorted(seen)
    common = [next((k for k in range(4) if a[k] != b[k]), 4) // 2 * 2 for a, b in zip(seen[1:], seen[:-1])]
    assert prefix.tolist() == [0, *common]
    assert bwt.intervals(prefix, 2).tolist() == [0, *[i + 1 for i, c in enumerate(common) if c < 2]]


def test_what_shares_a_passage_is_kept():
    rng = random.Random(11)
    for _ in range(200):
        anchor = bytes(rng.randrange(97, 123) for _ in range(16))
        strings, offs = [], []
        for _ in range(4):
            left, right = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 35))) for _ in range(2))
            if len(left + right) >= 34:
                strings.append(left + anchor + right)
                offs.append(len(left))
        strings += [s[1:] for s in strings if len(s) > 50]
        offs += [o - 1 for s, o in zip(strings, offs, strict=False) if len(s) > 50][: len(strings) - len(offs)]
        keep = [i for i, (s, o) in enumerate(zip(strings, offs, strict=True)) if o >= 0 and len(s) >= 50]
        strings, offs = [strings[i] for i in keep], [offs[i] for i in keep]
        windows = [{s[k : k + 50] for k in range(len(s) - 49) if k <= o and k + 50 >= o + 16} for s, o in zip(strings, offs, strict=True)]
        must = {i for i, w in enumerate(windows) if any(w & x for j, x in enumerate(windows) if j != i)}
        assert must <= set(suffix_dedup._may_share(strings, offs, 50))
