"""Line deduplication: lines that many documents share stay only in the document with the largest id.

Two Bloom filters a shard (once seen, twice seen) find lines that may repeat. Only these are shuffled for exact
confirmation, by the first 128 bits of their SHA-256; the documents that hold a key are counted and the largest id
is chosen by an aggregate with partial sums, so a line in a third of all documents is one row a task. Texts are not
shuffled as long as the repeated keys, whose number is measured, fit in SENT_BYTES; beyond, each document is joined with
the keys that it loses.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, boxed, id_column, pieces_for, text_bytes, without, written
from .sightings import SENT, repeats, sender

#: Bytes of text for each shard of the filters.
SHARD_BYTES = 64 << 20
#: Bytes of repeated keys (24 each) that are sent to every worker.
SENT_BYTES = 24 << 20
OWN = ("n_lines", "n_dropped")
_WHITE = SPACES.encode()


def _key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the digest of a line's key, if the key is long enough."""
    if len(line) < min_chars:
        return None
    key = line.strip(_WHITE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.sha256(key).digest()[:16]


def _keys(batch: pa.RecordBatch, min_chars: int):
    digests, docs = [], []
    for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        if doc is not None and raw and len(raw) >= min_chars:
            mine = {_key(line, min_chars) for line in raw.split(b"\n")} - {None}
            digests += mine
            docs += [doc] * len(mine)
    pairs = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy(), np.array(docs, np.int64)


def _cut(columns: int, text_at: int, names: list[str], min_chars: int, gone):
    """The rows' texts without the lines that go. ``gone(batch, keys, rows)`` tells it for keys of rows by number."""

    def run(batches):
        for batch in batches:
            raws = [raw or b"" for raw in batch.column(text_at).cast(pa.binary()).to_pylist()]
            lines = [raw.split(b"\n") if len(raw) >= min_chars else None for raw in raws]
            found = [(k, r, i) for r, ls in enumerate(lines) if ls for i, line in enumerate(ls) if (k := _key(line, min_chars))]
            told = gone(batch, [k for k, _, _ in found], np.array([r for _, r, _ in found], np.int64)) if found else ()
            drops: dict[int, set] = {}
            for (_, r, i), g in zip(found, told, strict=True):
                if g:
                    drops.setdefault(r, set()).add(i)
            texts = [b"\n".join([x for i, x in enumerate(lines[r]) if i not in drops[r]]) if r in drops else raw for r, raw in enumerate(raws)]
            out = [batch.column(i) for i in range(columns)]
            out[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
            counts = [pa.array([raw.count(b"\n") + 1 for raw in raws], pa.int64()), pa.array([len(drops.get(r, ())) for r in range(len(raws))], pa.int64())]
            yield pa.RecordBatch.from_arrays([*out, *counts], names=names)

    return run


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``df`` with its repeated lines taken out of ``text_col``, and n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends, A-Z lower-cased. A key of at least ``min_chars`` code
    points that at least ``min_docs`` ids hold loses all its lines except in the row with the largest id.

    Null and empty texts are one empty line and become empty. Rows without an id neither count nor lose lines. Rows
    that repeat an id count once, and all rows with the largest id keep the line. Ids are integers above the least
    long. Very long texts and lines are read whole; a text with many repeated lines costs by its lines. An empty table
    gives an empty table; other columns stay, except those named n_lines and n_dropped.
    """
    base = without(df, *OWN)
    rows = base.select(id_column(base, id_col), F.col(f"`{text_col}`"))
    shards = pieces_for(text_bytes(rows, text_col), SHARD_BYTES)
    sent = rows.mapInArrow(sender(lambda b: _keys(b, min_chars), shards), SENT)
    suspects = written(repeats(sent), "line-repeats")
    # Rows that repeat an id count once, however they fell into tasks.
    held = suspects.distinct().groupBy("fp", "rest").agg(F.count("*").alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= min_docs)
    held = written(held.select("fp", "rest", "last"), "line-held")
    columns, schema = base.columns, [f if f.name != text_col else T.StructField(f.name, T.StringType()) for f in base.schema.fields]
    out = T.StructType([*schema, *[T.StructField(n, T.LongType()) for n in OWN]])
    id_at, text_at = columns.index(id_col), columns.index(text_col)
    if held.count() * 24 <= sent_bytes:
        t = held.toArrow()
        every = np.stack([np.asarray(t["fp"]), np.asarray(t["rest"])], axis=1).astype(">i8").view("S16").reshape(-1)
        order = np.argsort(every)
        known = df.sparkSession.sparkContext.broadcast((every[order], np.asarray(t["last"])[order]))

        def gone(batch, keys, of):
            every, last = known.value
            if not len(every):
                return np.zeros(len(keys), bool)
            ids = batch.column(id_at).cast(pa.int64())
            some = np.asarray(ids.is_valid()) if ids.null_count else np.ones(len(ids), bool)
            docs = np.asarray(ids.fill_null(0))
            mine = np.array(keys, "S16")
            at = np.minimum(np.searchsorted(every, mine), len(every) - 1)
            return (every[at] == mine) & some[of] & (docs[of] < last[at])

        return base.mapInArrow(_cut(len(columns), text_at, [*columns, *OWN], min_chars, gone), out)

    digest = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("fp", "rest")]))
    drops = suspects.join(held, ["fp", "rest"]).filter(F.col("doc") < F.col("last")).groupBy("doc").agg(F.collect_set(digest).alias("_drops"))
    joined = boxed(base).withColumn("_key", F.col("_row")[id_col].cast("long")).join(drops.hint("shuffle_hash"), F.col("_key") == F.col("doc"), "left")
    n = len(columns)

    def own(batch, keys, of):
        lists = [set(x or ()) for x in batch.column(n).to_pylist()]
        return [k in lists[r] for k, r in zip(keys, of.tolist(), strict=True)]

    return joined.select(*[F.col("_row")[c].alias(f"c{i}") for i, c in enumerate(columns)], "_drops").mapInArrow(_cut(n, text_at, [*columns, *OWN], min_chars, own), out)

