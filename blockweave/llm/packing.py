"""Harmonic packing of token sequences.

A document's tokens are cut into whole sequences first. What is left goes whole to the class k = capacity // length,
and a bin of class k takes exactly k such pieces, so every worker fills the bins of each class on its own, without a
look at any other. A full bin still has some room, less than one more piece of its class: a document's rest is cut to
fill it up, and the next bins, until it is used up; then the next document's rest takes its turn. So sequences have no
padding, and a piece is cut only where it closes one. What a worker's open bins hold at the end is laid end to end
into sequences, the last of them cut at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_END = 1
#: Runs of white space from this length are encoded as one piece each, without the pattern that splits a text: its
#: search goes back over a run, and runs of millions overflow its stack.
LONG_RUN = 100_000
# Fixed value: the characters of Unicode's property White_Space.
_WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def encoder(path: str):
    """A function from a text to its ids: those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    A byte-level .json file with a .tiktoken file of the same vocabulary beside it is read from that one, which gives
    the same ids in a quarter of the time and without a record of every token. Strings of special tokens are split off
    first and get their ids, as the tokenizer does.
    """
    from tokenizers import Tokenizer

    ranks = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(ranks):
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            return _by_ranks(ranks, {t["content"]: t["id"] for t in added})
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def _by_ranks(path: str, special: dict[str, int]):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    marks = re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")") if special else None
    runs = re.compile(_WHITE + "{%d,}" % LONG_RUN)

    def plain(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return bpe.encode_ordinary(text)
        out, at = [], 0
        for m in runs.finditer(text):
            # The last character of a run goes with what follows, if anything does.
            end = m.end() - (m.end() < len(text))
            out += bpe.encode_ordinary(text[at : m.start()]) + bpe._encode_single_piece(text[m.start() : end])
            at = end
        return out + bpe.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        parts = marks.split(text) if marks else [text]
        if len(parts) == 1:
            return plain(text)
        return [i for k, p in enumerate(parts) for i in ((special[p],) if k % 2 else plain(p))]

    return encode


class Packer:
    """The bins of one worker. ``rows`` holds finished pieces as (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list] = {}
        #: Pieces of the one full bin whose room nothing fills yet, and the rest that is being cut.
        self.short: list = []
        self.filler: tuple | None = None
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def _fill(self, pieces: list) -> None:
        """Close a full bin, its room filled from the rest that is being cut; without enough of it the bin waits."""
        room = self.capacity - sum(len(p[2]) for p in pieces)
        if room and self.filler:
            doc, start, ids, total = self.filler
            pieces = [*pieces, (doc, start, ids[:room], total)]
            self.filler = (doc, start + room, ids[room:], total) if len(ids) > room else None
            room = max(0, room - len(ids))
        if room:
            self.short = pieces
        else:
            self._close(pieces)

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            self._close([(doc, at, ids[at : at + self.capacity], len(ids))])
        if whole == len(ids):
            return
        rest = (doc, whole, ids[whole:], len(ids))
        if self.short:
            self.filler, pieces, self.short = rest, self.short, []
            self._fill(pieces)
            return
        k = self.capacity // len(rest[2])
        bin_ = self.open.setdefault(k, [])
        bin_.append(rest)
        if len(bin_) == k:
            self._fill(self.open.pop(k))

    def finish(self) -> None:
        left = [*self.short, *([self.filler] if self.filler else []), *[p for k in sorted(self.open) for p in self.open[k]]]
        self.open, self.short, self.filler = {}, [], None
        total, here = sum(len(p[2]) for p in left), []
        room = target = self._target(total)
        for doc, start, ids, n in left:
            at = 0
            while at < len(ids):
                take = min(room, len(ids) - at)
                here.append((doc, start + at, ids[at : at + take], n))
                at, room = at + take, room - take
                if not room:
                    self._close(here)
                    total -= target
                    here, room = [], self._target(total)
                    target = room

    def _target(self, total: int) -> int:
        return self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1) if total else 0


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32,
    doc_tokens, sequence_id and offset.

    ``capacity`` is a power of two. Every document ends with id 1; a null or empty text is that id alone. Ids of
    documents are integers, may be null or repeat: each row is a document of its own. Very long texts are encoded
    whole, runs of one character too. A special token's string in a text is that token, as the tokenizer has it. An
    empty table gives none. Other columns are not read, and there are no ties. Sequence ids are the worker's number
    and a count; a task that runs again gives the same rows for the same rows in.
    """

    def run(batches):
        encode = encoder(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc, np.array([*encode(text or ""), _END], "<u4"))
                if len(packer.rows) >= 10_000:
                    yield _rows(packer)
        packer.finish()
        yield _rows(packer)

    return df.select(id_column(df, id_col), F.col(f"`{text_col}`")).mapInArrow(run, PIECES)


def _rows(p: Packer) -> pa.RecordBatch:
    rows, p.rows = p.rows, []
    raw = [r[2].tobytes() for r in rows]
    longs = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays(
        [longs([r[0] for r in rows]), longs([r[1] for r in rows]), longs([len(r[2]) for r in rows]), pa.array(raw, pa.binary()), longs([zlib.crc32(b) for b in raw]), longs([r[3] for r in rows]), longs([r[4] for r in rows]), longs([r[5] for r in rows])],
        names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )
