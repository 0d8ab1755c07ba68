"""Word shingles of texts as 64-bit hashes, computed for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

# Tables of odd and random 64-bit numbers, the same in every worker.
_RNG = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_PLACE = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the step and its inverse, kept between calls."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_STEP, n), _powers(_BACK, n)


_POWERS = _Powers()


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) of all texts, and where each text's words begin."""
    raw = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    bounds = np.r_[0, np.cumsum(lengths)]
    solid = ~_WHITE[raw]
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    return _hashes(raw, starts, ends), np.searchsorted(starts, bounds)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places. Sums run over the bytes in parts of BLOCK, so that a long text or word costs
    little more than its length."""
    before, upto, back = (np.zeros(len(starts), np.uint64) for _ in range(3))
    carry = np.zeros(1, np.uint64)
    for s in range(0, len(raw) if len(starts) else 0, BLOCK):
        e = min(s + BLOCK, len(raw))
        _POWERS.to(e - s)
        sums = np.cumsum(_BYTE[_LOWER[raw[s:e]]] * _POWERS.up[: e - s])
        ahead, behind = (np.array([pow(int(x), s, 1 << 64)], np.uint64) for x in (_STEP, _BACK))
        for into, at in ((before, starts - 1), (upto, ends - 1)):
            i, j = np.searchsorted(at, (s, e))
            into[i:j] = carry + ahead * sums[at[i:j] - s]
        i, j = np.searchsorted(starts, (s, e))
        back[i:j] = behind * _POWERS.down[starts[i:j] - s]
        carry = carry + ahead * sums[-1:]
    return mix((upto - before) * back)


def shingle_sets(texts: list[bytes | None], k: int):
    """For each text the sorted distinct hashes of its ``k``-word shingles; all words of a shorter text are one; none without words."""
    for i, j in _blocks(texts):
        h, at = word_hashes(texts[i:j])
        n = len(h) - k + 1
        whole = np.zeros(max(n, 0), np.uint64)
        for p in range(k if n > 0 else 0):
            whole += h[p : p + n] * _PLACE[p]
        whole = mix(whole)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(whole[a : b - k + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s
            elif b > a:
                yield mix(np.array([int((h[a:b] * _PLACE[: b - a]).sum()) ^ (b - a)], np.uint64) + _PLACE[k])
            else:
                yield h[:0]


def _blocks(texts):
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= BLOCK:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
