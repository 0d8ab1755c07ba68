"""Which fingerprints stand in two documents or more: two Bloom filters a shard, once seen and twice seen.

Every task packs the fingerprints of its documents and deals them to shards by fingerprint; a fingerprint that a task
itself meets in two documents needs no filter, so the task sends one marker for it and passes its own sightings on.
So a fingerprint in a third of all documents costs its shard one entry a task. A shard reads its entries twice: first
it fills the two filters, then it returns the sightings that the twice-seen filter holds. The filters never miss a
repeat; the few false ones (about 1 %) go to whatever exact step follows. The number of shards follows the input, so
a shard and its filters keep one size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release

#: Entries of a task that are packed at once, and entries of local repeats in one row.
FLUSH, CHUNK = 400_000, 32_768
#: Bits (held as bytes, for speed) of a filter for each entry, and bits set for each fingerprint.
BITS, HASHES = 10, 4
#: Stands for documents that a task has passed on itself.
MARK = np.int64(np.iinfo(np.int64).min)
SENT = "shard int, kind int, fps binary, rest binary, docs binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step, so that weak fingerprints are spread evenly."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def planes(a: np.ndarray) -> bytes:
    """The bytes of numbers by place: first all lowest bytes, and so on, which compress where high bytes are alike."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def numbers(blob: bytes, kind) -> np.ndarray:
    """The inverse of ``planes``."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _places(fps: np.ndarray, size: int) -> np.ndarray:
    a = mixed(fps)
    b = mixed(a) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(HASHES)])


def packed(fps: np.ndarray, rest: np.ndarray, docs: np.ndarray, shards: int) -> Iterator[tuple]:
    """Rows of SENT for one flush. ``rest`` is 8 more bytes of each fingerprint, or empty; sightings in one document stay
    apart where it differs."""
    order = np.argsort(fps, kind="stable")
    fps, docs, rest = fps[order], docs[order], rest[order] if len(rest) else rest
    starts = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
    counts = np.diff(np.r_[starts, len(fps)])
    lows, highs = np.minimum.reduceat(docs, starts), np.maximum.reduceat(docs, starts)
    differ = lows != highs
    if len(rest):
        differ |= np.minimum.reduceat(rest, starts) != np.maximum.reduceat(rest, starts)
    twice = (counts > 1) & differ
    own = np.repeat(twice, counts)
    at = np.flatnonzero(own)
    for i in range(0, len(at), CHUNK):  # any shard may carry these, so they go to one by their first document
        k = at[i : i + CHUNK]
        yield int(mixed(docs[k[:1]].view(np.uint64))[0] % np.uint64(shards)), 1, planes(fps[k]), planes(rest[k]) if len(rest) else b"", planes(docs[k])
    f, d = fps[starts], np.where(twice, MARK, docs[starts])
    r = rest[starts] if len(rest) else rest
    to = (mixed(f) >> np.uint64(33)) % np.uint64(shards)
    by = np.argsort(to, kind="stable")
    ends = np.flatnonzero(np.r_[to[by][1:] != to[by][:-1], True]) + 1 if len(by) else []
    i = 0
    for e in ends:
        k = by[i:e]
        yield int(to[k[0]]), 0, planes(f[k]), planes(r[k]) if len(r) else b"", planes(d[k])
        i = e


def sender(of_batch: Callable[[pa.RecordBatch], tuple], shards: int):
    """A function for mapInArrow. ``of_batch`` gives (fingerprints, rest, documents) of a batch, as arrays."""

    def run(batches):
        def out(parts):
            fps, rest, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = list(packed(fps, rest, docs, shards)) if len(fps) else []
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], ["shard", "kind", "fps", "rest", "docs"])

        parts, n = [], 0
        for batch in batches:
            parts.append(of_batch(batch))
            n += len(parts[-1][0])
            if n >= FLUSH:
                yield from out(parts)
                parts, n = [], 0
                release()
        if parts:
            yield from out(parts)
        parts = None
        release()

    return run


def _told(t: pa.Table) -> pa.Table:
    """The sightings of one shard that may be repeats: fingerprint, rest and document."""
    rows = [
        (kind, numbers(f, np.uint64), numbers(r, np.uint64), numbers(d, np.int64))
        for kind, f, r, d in zip(t["kind"].to_pylist(), t["fps"].to_pylist(), t["rest"].to_pylist(), t["docs"].to_pylist(), strict=True)
    ]
    size = max(1024, BITS * sum(len(f) for kind, f, _, _ in rows if kind == 0))
    once, twice = np.zeros(size, bool), np.zeros(size, bool)
    for kind, f, _, d in rows:
        if kind == 0:
            at = _places(f, size)
            again = once[at].all(axis=0) | (d == MARK)
            twice[at[:, again]] = True
            once[at] = True
    found = []
    for kind, f, r, d in rows:
        keep = np.ones(len(f), bool) if kind else twice[_places(f, size)].all(axis=0) & (d != MARK)
        found.append((f[keep], r[keep] if len(r) else np.zeros(int(keep.sum()), np.uint64), d[keep]))
    f, r, d = (np.concatenate(x) for x in zip(*found, strict=True))
    del rows, found, once, twice
    release()
    return pa.table({"fp": pa.array(f.view(np.int64)), "rest": pa.array(r.view(np.int64)), "doc": pa.array(d)})


def repeats(sent: DataFrame) -> DataFrame:
    """(fp, rest, doc) for every sighting of a fingerprint that another document has too, and a few others."""
    return sent.groupBy("shard").applyInArrow(_told, "fp long, rest long, doc long")
