"""Byte-pair encoding with reuse of chunks that documents share, and decoding.

A rolling hash over the bytes cuts texts where their content says so, hence a passage that many documents share falls
into the same chunks in all of them. Chunks that are seen more than once travel once for each task, are encoded once,
and meet the documents again as ids; all others are encoded where they stand. A cut may part a word, so what a chunk says
of its ends cannot be trusted: each join is encoded again, in a window that grows from the cut to the nearest
white space on both sides, or through whole chunks without any. White space parts tokens, so outside of the window the
encodings agree exactly with that of the whole text, and inside it the window's is taken.

A Bloom filter tells the repeated chunks, its size that of their measured number and at most MOST_BITS. What it takes
for repeated by mistake is encoded once like the others, with the same result.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_column, release, written

#: Bytes that the rolling hash looks at (a power of two), bytes of a chunk: at least, wanted beyond these, at most.
WINDOW, LEAST, WANTED, MOST = 32, 256, 1024, 8192
#: Bytes that are hashed, and that are split into pieces, at once; pieces that a worker remembers, and the longest of them.
BLOCK, SPLIT, REMEMBERED, LONGEST = 1 << 18, 1 << 20, 250_000, 64
#: Bits of the filter for each repeated chunk, and in all; bits set for a chunk.
BITS, MOST_BITS, HASHES = 12, 1 << 27, 4
#: Bytes of text that are worked on at once, and ids of a batch of results.
PORTION, BATCH_IDS = 4 << 20, 1 << 20
#: ASCII white space.
WHITE = b" \t\n\r\x0b\x0c"
_WHITE = re.compile(rb"[\t-\r ]")
PARTS = "row long, id long, pos int, parts int, ids binary, ref binary"
_FACTOR = 0x9E3779B1


@lru_cache(4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def check_white_space(path: str) -> None:
    """Refuse a tokenizer for which white space does not part a text into pieces that are encoded on their own."""
    ids = lambda x: tokenizer(path).encode(x, add_special_tokens=False).ids
    for c in WHITE.decode():
        if ids(f"{c}ab{c}{c}cd'{c}ś{c}") != ids("ab") + ids("cd'") + ids("ś"):
            raise ValueError(f"{path}: chunks need a tokenizer that drops white space")


class Encoder:
    """Ids of texts as bytes; pieces between white space are encoded by the tokenizer and remembered."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.kind = id_type(path)
        self.known: dict[bytes, bytes] = {}

    def ids(self, raws: list[bytes]) -> list[bytes]:
        out, some, size = [], [], 0
        for raw in raws:
            some.append(raw)
            size += len(raw)
            if size >= SPLIT:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    def _some(self, raws: list[bytes]) -> list[bytes]:
        pieces = [raw.split() for raw in raws]
        new = set().union(*pieces) - self.known.keys()
        told = self._told(list(new)) if new else {}
        if len(self.known) > REMEMBERED:
            told.update((p, self.known[p]) for p in set().union(*pieces) - new)
            self.known = {}
        long = {p: told.pop(p) for p in new if len(p) > LONGEST}
        self.known.update(told)
        get = self.known.__getitem__
        if long:
            return [b"".join([long[p] if p in long else get(p) for p in x]) for x in pieces]
        return [b"".join(map(get, x)) for x in pieces]

    def _told(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        e = self.tokenizer.encode([p.decode("utf-8", "replace") for p in pieces], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, self.kind)
        ends = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(pieces))) * ids.itemsize
        whole, at = ids.tobytes(), 0
        out = {}
        for p, end in zip(pieces, ends.tolist(), strict=True):
            out[p] = whole[at:end]
            at = end
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """A worker's encoder; what it has learnt serves the worker's next tasks too."""
    return Encoder(path)


@lru_cache(4)
def id_type(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def candidates(data: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last WINDOW bytes allows a cut, about one in WANTED."""
    found = []
    for at in range(0, len(data), BLOCK):
        from_ = max(0, at - WINDOW + 1)
        h = data[from_ : at + BLOCK].astype(np.uint32) + np.uint32(1)
        h *= np.uint32(_FACTOR)
        h ^= h >> np.uint32(15)
        power, step = np.uint32(0x85EBCA6B), 1
        while step < WINDOW:  # each round, the sums of twice as many bytes
            more = h.copy()
            more[step:] += h[:-step] * power
            with np.errstate(over="ignore"):
                power = power * power
            h, step = more, 2 * step
        h ^= h >> np.uint32(16)
        hits = np.flatnonzero((h * np.uint32(_FACTOR)) >> np.uint32(32 - WANTED.bit_length() + 1) == 0) + from_
        found.append(hits[hits >= at])
    return np.concatenate(found) + 1 if found else np.zeros(0, np.int64)


def chunks(start: int, end: int, cuts: list[int]) -> list[tuple[int, int]]:
    """The chunks of the text in bytes ``start`` to ``end``; ``cuts`` are the candidates there."""
    out, at = [], start
    for c in [*cuts, end]:
        while c - at > MOST:
            out.append((at, at + MOST))
            at += MOST
        if c - at >= LEAST and c < end:
            out.append((at, c))
            at = c
    if at < end:
        out.append((at, end))
    return out


def inner(chunk: bytes) -> tuple[int, int]:
    """The part of a chunk between its first and last white space, both included: its encoding depends on nothing outside."""
    m = _WHITE.search(chunk)
    return (m.start(), 1 + max(chunk.rfind(c) for c in WHITE)) if m else (0, 0)


def _texts(batches):
    """(ids, bytes of all texts, their offsets) of PORTIONs of batches (id, text as bytes), without a copy of the texts."""
    for batch in batches:
        raw = batch.column(1).cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset) if len(raw) else np.zeros(1, np.int32)
        data, at = np.frombuffer(raw.buffers()[2] or b"", np.uint8), 0
        while at < len(raw):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PORTION)) - 1)
            yield batch.column(0).slice(at, end - at), data[: offsets[end]], offsets[at : end + 1]
            at = end
        release()


def _chunked(data: np.ndarray, offsets: np.ndarray):
    """(row, [(start, end, digest)]) for each text."""
    base = int(offsets[0])
    cuts = candidates(data[base:]) + base
    marks = np.searchsorted(cuts, offsets, side="right")
    view, cuts = memoryview(data), cuts.tolist()
    for row in range(len(offsets) - 1):
        start, end = int(offsets[row]), int(offsets[row + 1])
        yield row, [(a, b, blake2b(view[a:b], digest_size=16).digest()) for a, b in chunks(start, end, cuts[marks[row] : marks[row + 1]])]


def _digests(batches):
    """(hi, lo) of each chunk."""
    for _, data, offsets in _texts(batches):
        found = np.frombuffer(b"".join([d for _, c in _chunked(data, offsets) for _, _, d in c]), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["hi", "lo"])
    release()


def filter_of(repeated: DataFrame) -> np.ndarray:
    """The Bloom filter of (hi, lo), as words of 64 bits. Spark makes the words; the driver gets MOST_BITS at most."""
    size = max(1 << 10, min(MOST_BITS, 1 << (BITS * repeated.count()).bit_length()))
    a, b = F.pmod("hi", F.lit(size)), F.pmod("lo", F.lit(size)).bitwiseOR(F.lit(1))
    at = repeated.select(F.explode(F.array(*[F.pmod(a + k * b, F.lit(size)) for k in range(HASHES)])).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    t = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[np.asarray(t["word"])] = np.asarray(t["bits"])
    return words.view(np.uint64)


def held(words: np.ndarray, digests: list[bytes]) -> list[bool]:
    """Whether the filter holds each digest."""
    if not digests:
        return []
    x, size = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2), len(words) * 64
    a, b = x[:, 0] % size, x[:, 1] % size | 1
    out = np.ones(len(x), bool)
    for k in range(HASHES):
        at = (a + k * b) % size
        out &= words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0
    return out.tolist()


def _shared(data: np.ndarray, offsets: np.ndarray, words: np.ndarray):
    """(row, [(start, end, digest)]) with a text's chunks that the filter holds and that have an inside."""
    every = list(_chunked(data, offsets))
    told = iter(held(words, [d for _, c in every for _, _, d in c]))
    for row, mine in every:
        some = [c for c, t in zip(mine, [next(told) for _ in mine], strict=True) if t]
        yield row, [(a + x, a + y, d) for a, b, d in some for x, y in [inner(data[a:b].tobytes())] if y - x > 2]


def _insides(filter_):
    """(ref, text) of the insides of shared chunks, once a task."""

    def run(batches):
        seen: set[bytes] = set()
        for _, data, offsets in _texts(batches):
            new = {d: data[a:b].tobytes() for _, mine in _shared(data, offsets, filter_.value) for a, b, d in mine if d not in seen}
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["ref", "text"])
            seen = seen | new.keys() if len(seen) < REMEMBERED else set(new)
        release()

    return run


def _encoded(path: str):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder(path).ids(batch.column(1).to_pylist()), pa.binary())], ["ref", "whole"])
        release()

    return run


def _parted(path: str, filter_):
    """Rows of PARTS: a text as ids that are certain and references to shared chunks, in turn."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for ids, data, offsets in _texts(batches):
            rows, raws = [], []
            for r, mine in _shared(data, offsets, filter_.value):
                at, end, before = int(offsets[r]), int(offsets[r + 1]), len(rows)
                for a, b, d in [*mine, (end, end, None)]:
                    if a > at or end == at == b and len(rows) == before:  # the join before a shared chunk and what stands there unshared
                        rows.append((row + r, r, len(rows) - before, None))
                        raws.append(data[at:a].tobytes())
                    if d:
                        rows.append((row + r, r, len(rows) - before, d))
                    at = b
            row += len(ids)
            found, numbers = iter(encoder(path).ids(raws)), np.array([x[0] for x in rows], np.int64)
            texts = [None if d else next(found) for *_, d in rows]
            of, pos = ([x[k] for x in rows] for k in (1, 2))
            counts = np.bincount(np.array(of, np.int64), minlength=len(ids))[of] if rows else np.zeros(0, np.int64)
            columns = [pa.array(numbers), ids.take(pa.array(of, pa.int32())), pa.array(pos, pa.int32()), pa.array(counts.astype(np.int32)), pa.array(texts, pa.binary()), pa.array([d for *_, d in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "pos", "parts", "ids", "ref"])
        release()

    return run


def _assembled(kind: str, name: str):
    """(id, n_tokens, ids) from rows (row, id, ids) that stand in order; a text may go over several batches."""

    def rows(done):
        if done:
            each = [np.frombuffer(b"".join(x), kind).astype(np.int32) for _, x in done]
            ends = np.cumsum([0, *map(len, each)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each)))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.int64()), pa.array(np.diff(ends), pa.int64()), lists], [name, "n_tokens", "ids"])

    def run(batches):
        done, size, last = [], 0, None
        for batch in batches:
            for row, doc, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != last:
                    if size >= BATCH_IDS * 4:
                        yield from rows(done)
                        done, size = [], 0
                    done.append((doc, []))
                    last = row
                done[-1][1].append(x)
                size += len(x)
        yield from rows(done)
        release()

    return run


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every row: the ids that the tokenizer of the file gives the whole text without special tokens
    added; strings of special tokens in a text are those tokens, as the tokenizer has it.

    Null and empty texts have no ids. Each row is a text of its own, if its id is null or repeats, too. Texts are cut and
    read whole whatever their length; one without white space is encoded in one piece. An empty table gives none. Other
    columns are not read. A tokenizer that keeps white space in its tokens is refused.
    """
    check_white_space(tokenizer_path)
    sc, kind = df.sparkSession.sparkContext, id_type(tokenizer_path)
    docs = df.select(id_column(df, id_col).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))
    repeated = docs.mapInArrow(_digests, "hi long, lo long").groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1").select("hi", "lo")
    known = sc.broadcast(filter_of(written(repeated, "bpe-repeated")))
    whole = docs.mapInArrow(_insides(known), "ref binary, text binary").dropDuplicates(["ref"]).mapInArrow(_encoded(tokenizer_path), "ref binary, whole binary")
    parts = written(docs.mapInArrow(_parted(tokenizer_path, known), PARTS), "bpe-parts")
    alone = (F.col("parts") == 1) & F.col("ref").isNull()
    found = F.coalesce("whole", F.raise_error(F.lit("a shared chunk has no ids")).cast("binary"))
    refs = parts.filter(F.col("ref").isNotNull()).join(whole, "ref", "left").select("row", "id", "pos", found.alias("ids"))
    mixed = parts.filter(F.col("ref").isNull() & ~alone).select("row", "id", "pos", "ids").unionByName(refs)
    ordered = mixed.repartition("row").sortWithinPartitions("row", "pos").select("row", "id", "ids")
    out = f"`{id_col}` long, n_tokens long, ids array<int>"
    return parts.filter(alone).select("row", "id", "ids").mapInArrow(_assembled(kind, id_col), out).unionByName(ordered.mapInArrow(_assembled(kind, id_col), out))


@lru_cache(1)
def _strings(path: str) -> pa.Array:
    """The string of each id up to the largest."""
    t = tokenizer(path)
    return pa.array([t.id_to_token(i) for i in range(1 + max(t.get_vocab(with_added_tokens=True).values()))], pa.string())


def _decoded(path: str, lists: pa.ListArray) -> pa.Array:
    """The tokenizer's texts of lists of ids. Without a decoder these are the tokens' strings with a space between."""
    if tokenizer(path).decoder is None and not lists.null_count:
        first = lists.offsets[0].as_py()
        ids = lists.values.slice(first, lists.offsets[-1].as_py() - first)
        return pa.compute.binary_join(pa.ListArray.from_arrays(pa.compute.subtract(lists.offsets, first), _strings(path).take(ids)), " ")
    read = tokenizer(path).decode
    return pa.array([None if x is None else read(x, skip_special_tokens=False) for x in lists.to_pylist()], pa.string())


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``df`` with the tokenizer's text of each row's ids, special tokens included; null ids have none, empty ones an empty
    text. A column ``name`` is replaced, others stay."""
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])
    names, at = [*base.columns, name], base.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            ends = pa.compute.list_value_length(batch.column(at)).fill_null(0).to_numpy().cumsum()
            start = 0
            while start < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH_IDS, side="right")) - start)
                some = batch.slice(start, n)
                yield pa.RecordBatch.from_arrays([*some.columns, _decoded(tokenizer_path, some.column(at))], names)
                start += n
            release()

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, T.StringType())]))
