"""Repeated passages by merged Burrows-Wheeler transforms.

A passage of ``min_bytes`` holds one anchor: the 16 bytes of it with the least hash. Equal passages have equal anchors
at equal places, so all that can be equal meets in the group of one anchor. Anchors in one document only are dropped
by two Bloom filters (see sightings). For the others each document sends contexts: the bytes of all passages whose
anchor stands there, once for every batch however many documents share them. In a bucket of anchors the distinct
contexts that may share a passage are the strings of shard transforms, which are merged to ``min_bytes`` symbols (see
bwt); each interval of that common prefix is one repeated passage, and the least document that holds it goes back to
the contexts' documents.

Two short cuts come before: whole copies of a text go by their digest, and where one batch holds a context very many
times, all but its least document lose it at once, so that a passage of a third of all documents stays one entry a
batch. Anchors of very many documents are split further, by a second one or by the passage, so no group holds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bwt
from .common import boxed, id_column, pieces_for, release, text_bytes, without, written
from .shingles import _BYTE, _POWERS, mix
from .sightings import SENT, numbers, planes, repeats, sender

ANCHOR = 16
#: Bytes of text for a shard of the filters and for a bucket of contexts.
SHARD_BYTES, BUCKET_BYTES = 32 << 20, 4 << 20
#: Symbols of the strings that are merged at once.
MERGED = 1 << 19
#: Bytes of text whose contexts are found at once in a task.
BATCH_BYTES = 8 << 20
#: Places of one context in a batch that go to its bucket; beyond, only its least document's do.
MANY = 256
#: Sightings of an anchor from which its passages are told apart by a second anchor, and from which each by itself.
HOT, HOTTEST = 50_000, 5_000_000
#: Bytes of spans that are sent to every worker; beyond, texts and spans are shuffled by document.
SENT_BYTES = 48 << 20
OWN = ("n_bytes", "n_removed", "n_spans", "kept", "removed")
_PLACES = np.uint64((1 << 24) - 1)
#: Texts are read in parts of this many places, which overlap by a passage.
_PART = 1 << 22


def _grams(r: np.ndarray) -> np.ndarray:
    """A hash of each ANCHOR bytes of ``r``."""
    n = len(r) - ANCHOR + 1
    _POWERS.to(len(r) + 1)
    s = np.cumsum(_BYTE[r] * _POWERS.up[: len(r)])
    g = s[ANCHOR - 1 :].copy()
    g[1:] -= s[: n - 1]
    return mix(g * _POWERS.down[:n])


def _least(m: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` numbers."""
    span = 1
    while span * 2 <= window:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (window - span)], m[window - span :]) if span < window else m


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, place, fingerprint): runs of passages (by their starts) and the place of the anchor they share."""
    parts = []
    for a in range(0, max(1, len(raw) - length + 1), _PART):
        r = raw[a : a + _PART + length - 1]
        if len(r) < length:
            continue
        h = _grams(r)
        m = _least((h & ~_PLACES) | np.arange(len(h), dtype=np.uint64), length - ANCHOR + 1)
        at = (m & _PLACES).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        parts.append((first + a, last + a, at[first] + a, h[at[first]] >> np.uint64(16)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _sent(batch: pa.RecordBatch, length: int):
    fps, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        if doc is not None and raw and len(raw) >= length:
            fps.append(np.unique(anchors(np.frombuffer(raw, np.uint8), length)[3]))
            docs.append(np.full(len(fps[-1]), doc, np.int64))
    return np.concatenate(fps), np.zeros(0, np.uint64), np.concatenate(docs)


def _split(raw: bytes, first: int, last: int, fp: int, way: int, length: int):
    """(first, last, key): the runs of passages of a hot anchor that share a second anchor (way 1: the least hash of
    those unlike the first), or each passage by itself (way 2)."""
    if way == 1:
        h = _grams(np.frombuffer(raw, np.uint8, last - first + length, first))
        key = _least(np.where(h >> np.uint64(16) == np.uint64(fp), ~np.uint64(0), h), length - ANCHOR + 1)
    else:
        key = np.fromiter((xxhash.xxh3_64_intdigest(raw[i : i + length]) for i in range(first, last + 1)), np.uint64, last - first + 1)
    key = mix(key ^ mix(np.full(len(key), fp, np.uint64)))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return zip((at + first).tolist(), (np.r_[at[1:], len(key)] + first - 1).tolist(), key[at].tolist(), strict=True)


#: Columns of what goes to a bucket: of each context its key, its anchor's place, length, bytes and number of places, and
#: of each place its document, row and start; or (kind 1) whole spans that go, by their lengths, documents, rows and starts.
_ASKED = ("fps", "anchors", "lengths", "contexts", "counts", "docs", "keys", "starts")


def _small(batches):
    """The batches in parts of about BATCH_BYTES of text."""
    for batch in batches:
        total = np.cumsum(pa.compute.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _contexts(length: int, buckets: int):
    """Of a batch (key, doc, text, anchors and how each is split): its distinct contexts by bucket, with their places."""

    def run(batches):
        for batch in _small(batches):
            docs, raws = batch.column(1).to_numpy(), batch.column(2).cast(pa.binary()).to_pylist()
            runs = [anchors(np.frombuffer(raw, np.uint8), length) for raw in raws]
            sizes = np.fromiter((len(r[0]) for r in runs), np.int64, len(runs))
            of = np.repeat(np.arange(len(runs)), sizes)
            first, last, at, fps = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 4
            lists = batch.column(3)
            flat = lists.flatten()
            mine = np.repeat(np.arange(len(runs)), np.diff(np.asarray(lists.offsets)))
            # Fingerprints are told apart by document: both are mixed into one number.
            salt = np.uint64(0x9E3779B97F4A7C15)
            told = np.asarray(flat.field("fp")).view(np.uint64) ^ (mine.astype(np.uint64) * salt)
            order = np.argsort(told)
            told, ways = told[order], np.asarray(flat.field("way"))[order]
            own = fps.astype(np.uint64) ^ (of.astype(np.uint64) * salt)
            where = np.minimum(np.searchsorted(told, own), max(0, len(told) - 1))
            keep = told[where] == own if len(told) else np.zeros(len(own), bool)
            way = ways[where[keep]] if len(told) else np.zeros(0, np.int32)
            of, first, last, at, fps = of[keep], first[keep], last[keep], at[keep], fps[keep].astype(np.uint64)
            if way.any():
                more = [(d, a, b, p, k) for d, x, y, p, f, w in zip(*[v[way > 0].tolist() for v in (of, first, last, at, fps, way)], strict=True) for a, b, k in _split(raws[d], x, y, f, w, length)]
                cols = list(zip(*more, strict=True))
                of, first, last, at = (np.r_[v[way == 0], np.array(c, np.int64)] for v, c in zip((of, first, last, at), cols, strict=False))
                fps = np.r_[fps[way == 0], np.array(cols[4], np.uint64)]
            end = last + length
            index: dict[bytes, int] = {}
            own = [index.setdefault(raws[d][x:y], len(index)) for d, x, y in zip(of.tolist(), first.tolist(), end.tolist(), strict=True)]
            yield _dealt(list(index), np.array(own, np.int64), docs[of], batch.column(0).to_numpy()[of], first, end, at - first, fps, buckets)
            del raws, runs, index, own
            release()

    return run


def _dealt(strings: list[bytes], own, docs, keys, first, end, offs, fps, buckets: int) -> pa.RecordBatch:
    """The batch's rows: ``own`` is the context of each place, the other arrays its document, row, ends, anchor and key."""
    order = np.lexsort((docs, own))
    own, docs, keys, first, end, offs, fps = (x[order] for x in (own, docs, keys, first, end, offs, fps))
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    # Another document of the batch with a context has all of it from the least one: of many places these go at once.
    stay = (docs == docs[starts][own]) | (np.bincount(own, minlength=len(starts))[own] <= MANY) if len(own) else np.zeros(0, bool)
    to = ((fps[starts] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
    by = np.argsort(to, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    places = np.argsort(rank[own[stay]], kind="stable")
    p_docs, p_keys, p_starts = docs[stay][places], keys[stay][places], first[stay][places]
    counts = np.bincount(own[stay], minlength=len(starts))[by]
    cuts = np.r_[0, np.flatnonzero(to[by][1:] != to[by][:-1]) + 1, len(by)] if len(by) else np.zeros(1, np.int64)
    place_cuts = np.r_[0, np.cumsum(counts)][cuts]
    rows = []
    for a, b, x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), place_cuts[:-1].tolist(), place_cuts[1:].tolist(), strict=True):
        u = by[a:b]
        s = starts[u]
        contexts = b"".join([strings[i] for i in u.tolist()])
        numbers_ = (fps[s], offs[s].astype(np.int32), (end[s] - first[s]).astype(np.int32)), (counts[a:b].astype(np.int32), p_docs[x:y], p_keys[x:y], p_starts[x:y])
        rows.append((int(to[u[0]]), 0, *map(planes, numbers_[0]), contexts, *map(planes, numbers_[1])))
    gone = np.flatnonzero(~stay)
    for i in range(0, len(gone), 50_000):
        g = gone[i : i + 50_000]
        rows.append((int(keys[g[0]]) % buckets, 1, b"", b"", planes((end[g] - first[g]).astype(np.int32)), b"", b"", planes(docs[g]), planes(keys[g]), planes(first[g])))
    cols = list(zip(*rows, strict=True)) or [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], ["bucket", "kind", *_ASKED])


def _may_share(strings: list[bytes], offs: list[int], length: int, step: int = 5) -> list[int]:
    """The strings that may have a passage with another: a passage with its anchor ``l`` bytes in holds the string's
    ``length - step + 1`` bytes that start at a multiple of ``step`` before its anchor, whichever is next below ``l``."""
    n = length - step + 1
    keys: list[list[bytes]] = []
    seen: dict[bytes, int] = {}
    for c, o in zip(strings, offs, strict=True):
        mine = [k for x in range(0, length - ANCHOR + 1, step) if x <= o and len(k := c[o - x : o - x + n]) == n]
        keys.append(mine)
        for k in set(mine):
            seen[k] = seen.get(k, 0) + 1
    return [i for i, mine in enumerate(keys) if any(seen[k] > 1 for k in mine)]


def _parts(some: list[int], fp: np.ndarray, size: np.ndarray):
    """Strings of whole anchors, about MERGED symbols at once: anchors have nothing to do with each other."""
    part, total, last = [], 0, None
    for i in sorted(some, key=lambda x: fp[x]):
        if total >= MERGED and fp[i] != last:
            yield part
            part, total = [], 0
        part.append(i)
        total += size[i] + 1
        last = fp[i]
    if part:
        yield part


def _solve(length: int):
    """A bucket's contexts to the spans (doc, key, s, e) of bytes that go."""

    def run(t: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        own, counts, docs, keys, starts, fps, offs, done = [], [], [], [], [], [], [], []
        for kind, *blobs in zip(*[t[k].to_pylist() for k in ("kind", *_ASKED)], strict=True):
            arrays = [numbers(x, d) for x, d in zip(blobs, (np.uint64, np.int32, np.int32, np.uint8, np.int32, np.int64, np.int64, np.int64), strict=True)]
            if kind:
                done.append(np.stack([arrays[5], arrays[6], arrays[7], arrays[7] + arrays[2]]))
                continue
            ends = np.cumsum(arrays[2]).tolist()
            raw = blobs[3]
            mine = [index.setdefault(raw[a:b], len(index)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            own.append(np.array(mine, np.int64))
            for into, k in ((fps, 0), (offs, 1), (counts, 4), (docs, 5), (keys, 6), (starts, 7)):
                into.append(arrays[k])
        if own:
            own, counts, docs, keys, starts, fps, offs = (np.concatenate(x) for x in (own, counts, docs, keys, starts, fps, offs))
            strings = list(index)
            at = np.repeat(own, counts)
            far = np.iinfo(np.int64).max
            low, high = np.full(len(strings), far), np.full(len(strings), -far)
            np.minimum.at(low, at, docs)
            np.maximum.at(high, at, docs)
            fp, off = np.zeros(len(strings), np.uint64), np.zeros(len(strings), np.int64)
            fp[own], off[own] = fps, offs
            # A context of one document that shares no passage with another has nothing to lose.
            some = np.union1d(_may_share(strings, off.tolist(), length), np.flatnonzero(high > low)).astype(np.int64)
            size = np.fromiter(map(len, strings), np.int64, len(strings))
            solved: dict[int, np.ndarray] = {}
            for part in _parts(some.tolist(), fp, size):
                solved |= zip(part, bwt.least_holder([strings[i] for i in part], low[part], length), strict=True)
            least, most = np.full(len(strings), far), np.full(len(strings), far)
            if len(some):
                every = np.concatenate([solved[i] for i in some.tolist()])
                first = np.r_[0, np.cumsum(size[some] - length + 1)[:-1]]
                least[some], most[some] = np.minimum.reduceat(every, first), np.maximum.reduceat(every, first)
            whole = docs > most[at]
            done.append(np.stack([docs[whole], keys[whole], starts[whole], starts[whole] + size[at[whole]]]))
            spans = []
            for k in np.flatnonzero((docs > least[at]) & ~whole).tolist():
                hit = np.flatnonzero(solved[at[k]] < docs[k])
                for run_ in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if hit[-1] - hit[0] >= len(hit) else (hit,):
                    spans.append((docs[k], keys[k], starts[k] + run_[0], starts[k] + run_[-1] + length))
            done.append(np.array(spans, np.int64).reshape(-1, 4).T)
        d, k, s, e = np.concatenate(done, axis=1) if done else np.zeros((4, 0), np.int64)
        release()
        return pa.table({"doc": pa.array(d), "key": pa.array(k), "s": pa.array(s), "e": pa.array(e)})

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans, kept (the remaining bytes) and removed (the spans, as (s, e) of bytes).

    A byte goes if a string of ``min_bytes`` bytes of UTF-8 that covers it also starts in a row with a smaller id.
    Null and empty texts have no bytes. Rows without an id neither lose bytes nor count; rows that repeat an id do not
    take from each other; of the rows of a tied least id each keeps what it holds. Very long texts are read in parts
    that overlap, and judged whole. Ids are integers. An empty table gives none; other columns stay, except those of
    these names. Whole copies of a text are found by its digest first: of them only the least id takes part in the search.
    """
    if min_bytes % 2 or min_bytes < 2 * ANCHOR:
        raise ValueError(f"min_bytes is to be even and at least {2 * ANCHOR}")
    sc_rows = boxed(df, *OWN).select("_row", F.col("_row")[id_col].cast("long").alias("doc"), F.col("_row")[text_col].alias("text"))
    id_column(df, id_col)
    # A row is known by its id and a hash of its text, 128 bits in all.
    rows = sc_rows.select(F.xxhash64("text").alias("key"), "doc", "text").filter("doc is not null and length(text) > 0")
    nbytes = text_bytes(rows)
    digest = rows.select("doc", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("d"), "key").filter(F.col("n") >= min_bytes)
    first = digest.groupBy("d").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    copies = written(digest.join(first, "d").filter("doc > low").select("doc", "key", F.lit(0).cast("long").alias("s"), F.col("n").cast("long").alias("e")), "repeat-copies")
    small = copies.count() * 32 <= sent_bytes
    only = rows.join(F.broadcast(copies) if small else copies.hint("shuffle_hash"), ["doc", "key"], "left_anti")
    shards = pieces_for(nbytes, SHARD_BYTES)
    sent = only.select("doc", "text").mapInArrow(sender(lambda b: _sent(b, min_bytes), shards), SENT)
    found = written(repeats(sent).select("fp", "doc"), "repeat-anchors")
    hot = written(found.groupBy("fp").count().filter(F.col("count") > HOT).select("fp", F.when(F.col("count") > HOTTEST, 2).otherwise(1).alias("way")), "repeat-hot")
    n_hot = hot.count()
    if n_hot:
        found = found.join(F.broadcast(hot) if n_hot * 12 <= sent_bytes else hot.hint("shuffle_hash"), "fp", "left")
    way = F.coalesce("way", F.lit(0)) if n_hot else F.lit(0)
    lists = found.groupBy("doc").agg(F.collect_list(F.struct("fp", way.alias("way"))).alias("fps")).withColumnRenamed("doc", "of")
    texts = only.join(lists.hint("shuffle_hash"), F.col("doc") == F.col("of")).select("key", "doc", "text", "fps")
    buckets = pieces_for(nbytes, BUCKET_BYTES)
    asked = texts.mapInArrow(_contexts(min_bytes, buckets), "bucket int, kind int, " + ", ".join(f"{c} binary" for c in _ASKED))
    spans = asked.groupBy("bucket").applyInArrow(_solve(min_bytes), "doc long, key long, s long, e long").union(copies)
    # Spans of a row that touch are joined: a row's are in order of their start, and a gap to all before starts a new one.
    w = W.partitionBy("doc", "key").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("doc", "key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    spans = written(spans.select(F.col("doc").alias("_doc"), F.col("key").alias("_of"), "spans"), "repeat-spans")
    size = spans.agg(F.sum(F.size("spans") * 16 + 24)).first()[0] or 0
    given = F.broadcast(spans) if size <= sent_bytes else spans.hint("shuffle_hash")
    columns = without(df, *OWN).columns
    joined = sc_rows.withColumn("_key", F.xxhash64("text")).join(given, (F.col("doc") == F.col("_doc")) & (F.col("_key") == F.col("_of")), "left")
    span = "array<struct<s:bigint,e:bigint>>"
    joined = joined.select("_row", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), "spans")
    row = joined.schema["_row"]
    own = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType()), ("removed", T._parse_datatype_string(span))]
    out = joined.mapInArrow(_cut, T.StructType([row, *[T.StructField(n, t) for n, t in own]]))
    return out.select(*[F.col("_row")[c].alias(c) for c in columns], *[n for n, _ in own])


def _cut(batches):
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        s_all, e_all = np.asarray(flat.field("s")), np.asarray(flat.field("e"))
        sizes = [0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()]
        at, out = 0, []
        for raw, n in zip(batch.column(1).to_pylist(), sizes, strict=True):
            if not n:
                out.append((len(raw), 0, 0, raw, []))
                continue
            s, e = s_all[at : at + n], np.maximum.accumulate(e_all[at : at + n])
            at += n
            new = np.r_[True, s[1:] > e[:-1]]
            starts, ends = s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, n - 1]]
            kept, last = [], 0
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.append(raw[last:a])
                last = b
            kept.append(raw[last:])
            out.append((len(raw), int((ends - starts).sum()), len(starts), b"".join(kept), [{"s": a, "e": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["_row", "n_bytes", "n_removed", "n_spans", "kept", "removed"])
