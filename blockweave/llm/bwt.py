"""Burrows-Wheeler transforms of shards of strings, and their merge by iterative interleave refinement.

Every string is closed by a symbol of its own kind (0, below all bytes) and read as a circle. A shard's rotations are
sorted once, to a depth beyond what is asked. Shards are then merged without another sort of rotations: the interleave
says from which shard each place of the merged transform comes; one step of refinement sorts the places, stably, by
the pairs of symbols that the transforms hold there, and so makes the interleave right to two more symbols. The order
by few symbols and that by more have the same boundaries between what differs in the few, so the step at which a place
first is a boundary gives the common prefix of its neighbours, and the intervals between places of a common prefix
below a length are the strings of that length that repeat.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a shard of strings that is sorted at once.
SHARD_SYMBOLS = 1 << 17
#: Depth to which a shard is sorted; merges may ask for less.
SORTED = 64


class Strings:
    """Strings of bytes (below 255, as those of UTF-8) laid end to end, each with its closing symbol."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        raw = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
        self.symbols = raw + np.uint8(1)  # 255, the end, wraps to 0
        self.owner = np.repeat(np.arange(len(strings)), self.lengths)
        self._first, self._size = self.starts[self.owner], self.lengths[self.owner]
        self._end = self._first + self._size
        self._least = int(self.lengths.min()) if len(strings) else 0

    @property
    def place(self) -> np.ndarray:
        return np.arange(len(self.symbols)) - self._first

    def turned(self, by: int) -> np.ndarray:
        """Index of the symbol ``by`` further on in each one's circle."""
        at = np.arange(by, by + len(self.symbols))
        if abs(by) > self._least:
            return self._first + (at - self._first) % self._size
        if by < 0:
            return np.where(at < self._first, at + self._size, at)
        return np.where(at >= self._end, at - self._size, at)


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    s = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]]).astype(np.uint64)
    return out


def transform(t: Strings) -> tuple[np.ndarray, np.ndarray]:
    """The shard's transform and the order of its rotations (as indices of their first symbols), to SORTED symbols."""
    key = np.zeros(len(t.symbols), np.uint64)
    for q in range(8):
        key = (key << np.uint64(8)) | t.symbols[t.turned(q)].astype(np.uint64)
    rank, depth = _ranks(key), 8
    while depth < SORTED:
        rank = _ranks((rank << np.uint64(32)) | rank[t.turned(depth)])
        depth *= 2
    order = np.argsort(rank, kind="stable")
    pair = (t.symbols[t.turned(-2)].astype(np.uint16) << np.uint16(8)) | t.symbols[t.turned(-1)]
    return pair[order], order


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the transforms right to ``depth`` symbols (an even number), and the common prefix of each place
    with the one before, as the greatest even number of symbols that does not exceed it, and ``depth`` at most (the
    first place has none: 0). A transform holds the two symbols before each rotation, so a step of refinement makes the
    interleave right to two more."""
    few = len(transforms) <= 8
    z = np.repeat(np.arange(len(transforms), dtype=np.uint8 if few else np.uint16), [len(x) for x in transforms])
    held = np.concatenate(transforms)
    symbols = np.empty_like(held)
    block = np.zeros(len(z), np.int32)
    prefix = np.zeros(len(z), np.uint16)
    for _ in range(depth // 2):
        if few:
            for i, x in enumerate(transforms):
                symbols[z == i] = x
        else:
            symbols[np.argsort(z, kind="stable")] = held
        p = np.argsort(symbols, kind="stable")
        s, block, z = symbols[p], block[p], z[p]
        edge = np.empty(len(z), bool)
        edge[:1] = False
        np.not_equal(s[1:], s[:-1], out=edge[1:])
        edge[1:] |= block[1:] != block[:-1]
        block = np.cumsum(edge, dtype=np.int32)
        prefix += ~edge  # a boundary stays one
    prefix *= 2
    prefix[:1] = 0
    return z, prefix


def intervals(prefix: np.ndarray, length: int) -> np.ndarray:
    """Where the runs of places that share ``length`` symbols begin."""
    return np.flatnonzero(np.r_[True, prefix[1:] < length])


def least_holder(strings: list[bytes], values: np.ndarray, depth: int, shard_symbols: int = SHARD_SYMBOLS) -> list[np.ndarray]:
    """For each string and each place where ``depth`` bytes of it start: the least value of the strings that hold these bytes."""
    if not strings:
        return []
    sizes = np.cumsum([len(s) + 1 for s in strings])
    cut = np.searchsorted(sizes, np.arange(1, int(sizes[-1]) // shard_symbols + 1) * shard_symbols)
    bounds = sorted({0, *cut.tolist(), len(strings)})
    shards = [Strings(strings[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    built = [transform(t) for t in shards]
    z, prefix = merge([x for x, _ in built], depth)
    by_shard = np.argsort(z, kind="stable")
    origin = np.empty(len(z), np.int64)
    offset = np.cumsum([0] + [len(t.symbols) for t in shards])
    origin[by_shard] = np.concatenate([o + offset[i] for i, (_, o) in enumerate(built)])
    owner = np.concatenate([t.owner + a for t, a in zip(shards, bounds, strict=False)])
    starts = intervals(prefix, depth)
    least = np.minimum.reduceat(values[owner[origin]], starts)
    out = np.empty(len(z), values.dtype)
    out[origin] = np.repeat(least, np.diff(np.r_[starts, len(z)]))
    ends = np.cumsum([len(s) + 1 for s in strings])
    return [out[e - len(s) - 1 : e - depth] for s, e in zip(strings, ends.tolist(), strict=True)]
