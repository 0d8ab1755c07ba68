"""Language-model scoring by a subword lattice.

The pieces are those of an existing vocabulary; their scores are shares of the pieces that its tokenizer makes of all
training words. A word's probability is the sum over all its segmentations, found by a forward recursion in log space;
a text's is the product over its words and its end. The word counts of the corpus are split twice: documents lie in
buckets of bounded bytes, each with a dictionary of its distinct words, and the words of all dictionaries lie in shards
by hash. A shard sums the counts of a word and walks its lattice once, however many buckets hold it, and answers each
bucket in the order of its question. So nothing the size of the corpus's vocabulary is ever in one place.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, pieces_for, text_bytes, written

#: Bytes of text in a bucket, and buckets for each shard of words.
BUCKET_BYTES, BUCKETS_A_SHARD = 16 << 20, 2
#: Fixed value: the mark that starts a word in the vocabulary.
START = "▁"
LN10 = math.log(10)


class Vocabulary:
    """The pieces of a sentencepiece file, with scores once they are known."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.size = n
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        whole = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.ids = {pieces[i]: i for i in whole}
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))

    def counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece stands in the words' usual segmentation, ``times`` each word."""
        total = np.zeros(self.size, np.int64)
        for k in range(0, len(words), 50_000):
            ids = self.model.encode(words[k : k + 50_000], num_threads=1)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
            total += np.bincount(flat, np.repeat(times[k : k + 50_000], lengths), self.size).astype(np.int64)
        return total

    def weigh(self, counts: np.ndarray, ends: int, added: float = 0.5) -> float:
        """Set the pieces' natural log scores, smoothed by ``added``; returns that of a text's end."""
        used = [*self.ids.values(), *self.bytes]
        total = counts[used].sum() + ends + added * (len(used) + 1)
        self.logs = {p: math.log((int(counts[i]) + added) / total) for p, i in self.ids.items()}
        self.byte_logs = [math.log((int(counts[i]) + added) / total) for i in self.bytes]
        return math.log((ends + added) / total)

    def _one(self, char: str) -> float:
        """Log score of one character: as a piece, or spelt in bytes, so that every word has a segmentation."""
        spelt = sum(self.byte_logs[b] for b in char.encode("utf-8", "replace"))
        piece = self.logs.get(char)
        return spelt if piece is None else float(np.logaddexp(spelt, piece))

    def log_probability(self, word: str) -> float:
        """Natural log of the sum of the probabilities of all segmentations of ``word``, which starts with START."""
        get, exp, log, longest = self.logs.get, math.exp, math.log, self.longest
        alpha = [0.0]
        for end in range(1, len(word) + 1):
            terms = [alpha[end - 1] + self._one(word[end - 1])]
            for start in range(max(0, end - longest), end - 1):
                s = get(word[start:end])
                if s is not None:
                    terms.append(alpha[start] + s)
            most = max(terms)
            alpha.append(most + log(sum([exp(t - most) for t in terms])))
        return alpha[-1]

    def log_probabilities(self, words: list[str], most_chars: int = 24, at_once: int = 20_000) -> np.ndarray:
        """``log_probability`` of each word; words of one length walk their lattices side by side."""
        out = np.zeros(len(words))
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) if len(w) <= most_chars else 0, []).append(k)
        one = {c: self._one(c) for c in {c for k, at in by.items() if k for i in at for c in words[i]}}
        for length, places in by.items():
            if not length:
                for k in places:
                    out[k] = self.log_probability(words[k])
                continue
            spans = [(i, j) for j in range(2, length + 1) for i in range(max(0, j - self.longest), j - 1)]
            for k in range(0, len(places), at_once):
                at = places[k : k + at_once]
                get = self.logs.get
                rows = np.array([[get(w[i:j], -np.inf) for i, j in spans] for w in (words[p] for p in at)]).reshape(len(at), len(spans))
                singles = np.array([[one[c] for c in words[p]] for p in at])
                alpha, column = np.zeros((len(at), length + 1)), 0
                for j in range(1, length + 1):
                    n = max(0, j - 1 - max(0, j - self.longest))
                    terms = np.concatenate([alpha[:, j - 1 - n : j - 1] + rows[:, column : column + n], (alpha[:, j - 1] + singles[:, j - 1])[:, None]], axis=1)
                    column += n
                    most = terms.max(axis=1)
                    alpha[:, j] = most + np.log(np.exp(terms - most[:, None]).sum(axis=1))
                out[at] = alpha[:, length]
        return out


def held_out(doc) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def tokens(raw: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    return raw.lower().split() if raw else []


def _distinct(t: pa.Table) -> tuple[dict[bytes, int], list]:
    """The bucket's distinct words with their place, and of each document its id and words' places."""
    place: dict[bytes, int] = {}
    docs = []
    for doc, raw in zip(t["doc"].to_pylist(), t["text"].cast(pa.binary()).to_pylist(), strict=True):
        w = tokens(raw)
        docs.append((doc, np.fromiter((place.setdefault(x, len(place)) for x in w), np.int64, len(w))))
    return place, docs


def _by_shard(words: list[bytes], shards: int):
    """Places of the words by shard, each in the order of the words: both sides of the exchange go by this."""
    to = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) % np.uint64(shards)
    order = np.lexsort((np.array(words, object), to)) if len(words) else np.zeros(0, np.int64)
    ends = np.searchsorted(to[order], np.arange(shards), side="right") if len(words) else np.zeros(shards, np.int64)
    return [(s, order[(ends[s - 1] if s else 0) : ends[s]]) for s in range(shards)]


def _ask(shards: int):
    def run(t: pa.Table) -> pa.Table:
        place, docs = _distinct(t)
        words = list(place)
        times = np.zeros(len(words), np.int64)
        for doc, w in docs:
            if not held_out(doc):
                np.add.at(times, w, 1)
        rows = [(s, t["bucket"][0].as_py(), b" ".join([words[i] for i in at]), times[at].tobytes()) for s, at in _by_shard(words, shards) if len(at)]
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("shard", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("times", pa.binary())))})

    return run


def _sum(asked: pa.Table) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for words, times in zip(asked["words"].to_pylist(), asked["times"].to_pylist(), strict=True):
        for w, c in zip(words.split(b" "), np.frombuffer(times, np.int64).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    return total


def _pieces(vocabulary_path: str):
    """One row of statistics a shard and piece: piece -1 has the tokens, -2 the distinct tokens."""

    def run(asked: pa.Table) -> pa.Table:
        total = {w: c for w, c in _sum(asked).items() if c}
        v = Vocabulary(vocabulary_path)
        times = np.fromiter(total.values(), np.int64, len(total))
        counts = v.counts([w.decode("utf-8", "replace") for w in total], times)
        some = np.flatnonzero(counts)
        return pa.table({"piece": pa.array(np.r_[some, -1, -2].astype(np.int32)), "n": pa.array(np.r_[counts[some], times.sum(), len(total)].astype(np.int64))})

    return run


def _answer(vocabulary_path: str, counts, ends: int):
    def run(asked: pa.Table) -> pa.Table:
        total = _sum(asked)
        v = Vocabulary(vocabulary_path)
        v.weigh(counts.value, ends)
        logs = dict(zip(total, v.log_probabilities([START + w.decode("utf-8", "replace") for w in total]).tolist(), strict=True))
        times, scores = [], []
        for words in asked["words"].to_pylist():
            ws = words.split(b" ")
            times.append(np.fromiter((total[w] for w in ws), np.int64, len(ws)).tobytes())
            scores.append(np.fromiter((logs[w] for w in ws), np.float64, len(ws)).tobytes())
        return pa.table({"shard": asked["shard"], "bucket": asked["bucket"], "times": pa.array(times, pa.binary()), "scores": pa.array(scores, pa.binary())})

    return run


def _score(shards: int, n: int, distinct: int, ends: int, end_log: float):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        place, docs = _distinct(t)
        words = list(place)
        c, logs = np.zeros(len(words), np.int64), np.zeros(len(words))
        told = {s: (a, b) for s, a, b in zip(answers["shard"].to_pylist(), answers["times"].to_pylist(), answers["scores"].to_pylist(), strict=True)}
        for s, at in _by_shard(words, shards):
            if len(at):
                c[at], logs[at] = np.frombuffer(told[s][0], np.int64), np.frombuffer(told[s][1], np.float64)
        under = n + 0.1 * (distinct + 1)
        base = np.log10((c + 0.1) / under)
        end = math.log10((ends + 0.1) / under)
        rows = [(d, held_out(d), len(w) + 1, int((c[w] > 0).sum()) + (ends > 0), n, float(base[w].sum()) + end, (float(logs[w].sum()) + end_log) / LN10) for d, w in docs]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lattice_scores(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    Documents whose crc32(id as text) mod 10 is not 0 are learnt from. Tokens are words and one end a document. Null and
    empty texts are an end alone. A null id is learnt from and not held out; repeated rows count each. An empty table
    gives none. Ids are integers. Other columns are not read, and there are no ties. Very long texts are read whole;
    words are cut at white space only and may be of any length.
    """
    sc = df.sparkSession.sparkContext
    rows = df.select(id_column(df, id_col).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    buckets = pieces_for(text_bytes(rows), bucket_bytes)
    shards = pieces_for(buckets, BUCKETS_A_SHARD)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc", "text"), F.lit(buckets)).cast("int"))
    asked = written(rows.groupBy("bucket").applyInArrow(_ask(shards), "shard int, bucket int, words binary, times binary"), "lattice-words")
    by = {r["piece"]: r["n"] for r in asked.groupBy("shard").applyInArrow(_pieces(vocabulary_path), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    out = F.pmod(F.crc32(F.col("doc").cast("string").cast("binary")), F.lit(10)) == 0
    ends = rows.filter(~F.coalesce(out, F.lit(False))).count()
    v = Vocabulary(vocabulary_path)
    counts = np.zeros(v.size, np.int64)
    for piece, n in by.items():
        if piece >= 0:
            counts[piece] = n
    sent = sc.broadcast(counts)
    answers = asked.groupBy("shard").applyInArrow(_answer(vocabulary_path, sent, ends), "shard int, bucket int, times binary, scores binary")
    score = _score(shards, by.get(-1, 0) + ends, by.get(-2, 0) + (ends > 0), ends, v.weigh(counts, ends))
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
