"""Benchmark decontamination: Wu-Manber search for word windows of test items.

A text is a list of words. For patterns of one length a hashed table tells, for the last two words of the place where
a pattern would end, how far the search may move on: up to a whole pattern less a word where no pattern has that pair.
Where it says stop, the hash of the pair is the bucket of patterns that may end so, a hash of the whole place picks
inside the bucket, and what it picks is compared byte by byte. Tables are arrays of a known size, about nine bytes for
each byte of test text; longer test sets are searched in blocks, one after the other, so that one block's tables are
all that a worker holds.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, id_column, pieces_for, release, without, written

#: Bytes of test texts whose tables are sent to the workers at once; more texts make more blocks.
BLOCK_BYTES = 8 << 20
#: Bytes of found occurrences that are sent to every worker; beyond, they are joined by a shuffle.
SENT_BYTES = 16 << 20
OWN = ("n_words", "n_hit", "item_ids")
#: A-Z to a-z, digits and everything beyond ASCII as they are, all else to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = 0x9E3779B1


def words(raw: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text in UTF-8, A-Z lower-cased."""
    return raw.translate(_TABLE).split() if raw else []


def _whole(words: bytes) -> int:
    return xxhash.xxh3_64_intdigest(words) & 0xFFFFFFFF


def _pair(a: bytes, b: bytes) -> int:
    return (crc32(a) * _MIX + crc32(b)) & 0xFFFFFFFF


class WuManber:
    """Search tables for patterns of ``length`` words. Patterns are places in the items' words, laid end to end."""

    def __init__(self, texts: list[tuple[int, bytes | None]], length: int, window: int):
        self.length, self.block = length, min(2, length)
        none = np.zeros(0, np.int64)
        starts, ends, owners, keys, pairs, moves = [none], [none], [none], [none.astype(np.uint64)], [none.astype(np.uint64)], [none]
        blob, at = [], 0
        for item, raw in texts:
            w = words(raw)
            if min(window, len(w)) != length:
                continue
            here = b" ".join(w)
            place = np.r_[0, np.cumsum(np.fromiter((len(x) + 1 for x in w), np.int64, len(w)))]
            crc = np.fromiter(map(crc32, w), np.uint64, len(w))
            pair = (crc[:-1] * np.uint64(_MIX) + crc[1:]) & np.uint64(0xFFFFFFFF) if self.block == 2 else crc
            n = len(w) - length + 1
            a, b = place[:n], place[length : length + n] - 1
            whole = np.fromiter((_whole(here[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, n)
            keys.append((pair[length - self.block :] << np.uint64(32)) | whole)
            # A pair ends a window, but for an item's first ones, which stand before the first window's end.
            pairs.append(pair)
            moves.append(np.maximum(0, length - self.block - np.arange(len(pair))))
            starts.append(a + at)
            ends.append(b + at)
            owners.append(np.full(n, item, np.int64))
            blob.append(here)
            at += len(here) + 1
        self.blob = b" ".join(blob)
        start, end, owner, key, pair, move = (np.concatenate(x) for x in (starts, ends, owners, keys, pairs, moves))
        size = 1 << max(10, int(len(pair) * 2 - 1).bit_length())
        self.mask = size - 1
        shift = np.full(size, length - self.block + 1, np.uint8)
        np.minimum.at(shift, (pair & np.uint64(self.mask)).astype(np.int64), move.astype(np.uint8))
        self.shift = shift.tobytes()
        # Equal windows are one pattern with the items that hold it; two of one key and different words stay two.
        order = np.lexsort((owner, key))
        key, start, end, owner = key[order], start[order], end[order], owner[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        for i in np.flatnonzero(~new).tolist():
            new[i] = self.blob[start[i] : end[i]] != self.blob[start[i - 1] : end[i - 1]]
        first = np.flatnonzero(new)
        self.keys, self.starts, self.ends, self.items = key[first], start[first].astype(np.int32), end[first].astype(np.int32), owner
        self.cuts = np.r_[first, len(owner)].astype(np.int32)

    def search(self, text: list[bytes]):
        """(start, items) of every occurrence, by start; items may repeat."""
        n, m, shift, mask, keys = len(text), self.length, self.shift, self.mask, self.keys
        two, at = self.block == 2, self.length
        while at <= n:
            last = _pair(text[at - 2], text[at - 1]) if two else crc32(text[at - 1])
            move = shift[last & mask]
            if move:
                at += move
                continue
            here = b" ".join(text[at - m : at])
            key = np.uint64(last << 32 | _whole(here))
            i = int(keys.searchsorted(key))
            while i < len(keys) and keys[i] == key:
                if self.blob[self.starts[i] : self.ends[i]] == here:
                    yield at - m, self.items[self.cuts[i] : self.cuts[i + 1]].tolist()
                i += 1
            at += 1


def tables(items: list[tuple[int, bytes | None]], window: int = 10) -> list[WuManber]:
    """Tables for each length among the windows of the items: ``window`` words, or all words of a shorter item."""
    lengths = {min(window, len(words(raw))) for _, raw in items} - {0}
    return [WuManber(items, m, window) for m in sorted(lengths)]


def matched(searches: list[WuManber], text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Spans of words inside occurrences, merged and sorted, and the items that occur."""
    spans, found = [], set()
    for s in searches:
        for start, items in s.search(text):
            if spans and spans[-1][0] <= start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], start + s.length))
            else:
                spans.append((start, start + s.length))
            found.update(items)
    return merged(spans), found


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_FOUND = "digest binary, n_words long, n_hit long, items array<long>, starts array<long>, ends array<long>"


def mark_contaminated(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """``df`` with n_words, n_hit (words inside an occurrence of a window) and item_ids (sorted items that occur).

    Test texts up to ``block_bytes`` go to the workers at once. A longer set is cut into such blocks, each a pass over
    the texts that writes what it found by text; the last pass joins these. So test sets of any size are searched whole
    in bounded memory, but for one item longer than a block, which is a block of its own.

    Null and empty texts have no words; items without words or without an id have no windows; repeated items and windows
    count once, and there are no ties. Very long texts are searched whole. Rows are judged one by one, so repeated rows
    get the same result. An empty table gives none; item ids are integers. Other columns stay, except those of these
    three names.
    """
    items = benchmark.select(id_column(benchmark, item_col).alias("i"), F.col(f"`{item_text_col}`").alias("t")).filter("i is not null and length(t) > 0")
    blocks = pieces_for(items.select(F.sum(F.octet_length("t"))).first()[0] or 0, block_bytes)
    base = without(df, *OWN)
    spark = df.sparkSession
    if blocks == 1:
        sent = _sent(spark, items, window)
        schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.LongType()))])
        columns = base.columns
        at = columns.index(text_col)

        def run(batches):
            for batch in batches:
                rows = [_judge(sent.value, raw) for raw in batch.column(at).cast(pa.binary()).to_pylist()]
                own = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], *own], names=[*columns, "n_words", "n_hit", "item_ids"])

        return base.mapInArrow(run, schema)

    texts = base.select(F.col(f"`{text_col}`"))
    found = None
    for b in range(blocks):
        sent = _sent(spark, items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b), window)
        part = written(texts.mapInArrow(_finder(sent), _FOUND), "test-occurrences")
        sent.destroy()  # the next block takes its place
        found = part if found is None else found.union(part)
    # A text's occurrences of all blocks: its spans, sorted, are joined where they touch.
    every = found.groupBy("digest").agg(F.max("n_words").alias("_n"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"), F.flatten(F.collect_set(F.arrays_zip("starts", "ends"))).alias("_spans"))
    covered = F.aggregate(
        F.sort_array("_spans"),
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["to"], x["ends"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(acc["to"], x["starts"]))).alias("n")),
        lambda acc: acc["n"],
    )
    every = written(every.select("digest", "_items", covered.alias("_hit")), "test-texts")
    size = every.agg(F.sum(F.size("_items") * 8 + 64)).first()[0] or 0
    text = F.col("_row")[text_col]
    key = F.when(text.isNotNull(), F.unhex(F.sha2(text, 256)))
    joined = boxed(base).withColumn("_key", key).join(F.broadcast(every) if size <= sent_bytes else every.hint("shuffle_hash"), F.col("_key") == F.col("digest"), "left")
    counted = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")
    return joined.select(
        *[F.col("_row")[c].alias(c) for c in base.columns],
        counted.alias("n_words"),
        F.coalesce("_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"),
    )


def _sent(spark, items: DataFrame, window: int):
    """The block's tables, sent to the workers. A worker keeps them between its tasks."""
    return spark.sparkContext.broadcast(tables([(r["i"], r["t"].encode()) for r in items.toLocalIterator()], window))


def _judge(searches: list[WuManber], raw: bytes | None) -> tuple[int, int, set, list]:
    text = words(raw)
    spans, found = matched(searches, text)
    return len(text), sum(b - a for a, b in spans), found, spans


def _finder(sent):
    """Of each text that holds a window: its digest, words, hit words, items and spans."""

    def run(batches):
        import hashlib

        for batch in batches:
            rows = []
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                n, hit, found, spans = _judge(sent.value, raw)
                if found:
                    rows.append((hashlib.sha256(raw).digest(), n, hit, sorted(found), [a for a, _ in spans], [b for _, b in spans]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), longs, longs, longs), strict=True)], ["digest", "n_words", "n_hit", "items", "starts", "ends"])
        release()

    return run
