"""A quality classifier with hierarchical empirical Bayes over sites.

A logistic model of text features gives every document a probability (its own evidence). Hosts and the paths within
them get posteriors: the mean evidence of their documents, drawn towards the level above as strongly as the spread
between groups, against that within them, says. A site with few documents stays near its parent, the global mean in
the end. The document's log odds are then moved by those of its path against the global mean.

Toxicity is told by words: those of the labelled documents whose share among toxic ones is many times that among the
others make a bounded list, and a document that holds several of them is toxic. It does not move quality or kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_column, written
from .quality_rules import CLASSES, _measured

FEATURES = ("log_words", "mean_length", *[f"share_{k}" for k in CLASSES[1:]], "distinct_share", "repeated_lines", "few_words")


def toxic_words(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str, max_labels: int, least_share: float = 0.01, least_odds: float = 3.5, most: int = 256) -> list[str]:
    """At most ``most`` words that tell toxic texts, from at most ``max_labels`` labelled documents, each distinct text
    once: in at least five toxic texts and ``least_share`` of them, with log odds of ``least_odds`` against the others."""
    if toxic_col not in labels.columns:
        return []
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{toxic_col}`").cast("int").alias("y")).filter("y in (0, 1)").dropna()
    known = known.orderBy(F.xxhash64("doc"), "doc").limit(max_labels)
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "doc").select("text", "y").distinct()
    texts = written(texts.select("y", F.array_distinct(_letters(F.col("text"))).alias("w")), "quality-toxic")
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(n) < 2:
        return []
    counts = texts.select("y", F.explode("w").alias("w")).groupBy("w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    found = counts.filter((F.col("t") >= max(5, least_share * n[1])) & (odds >= least_odds)).orderBy(F.desc("t"), "w").limit(most)
    return sorted(r["w"] for r in found.collect())


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}++"), F.lit(0))


def features(df: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, toxic: list[str] = ()) -> DataFrame:
    """doc, host, path, n_words, the number of distinct words of ``toxic``, and the features of each row, all of bounded
    size."""
    m = _measured(df, text_col, None)
    n = F.size("_words")
    some = F.greatest(n, F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    values = [
        F.log1p(n.cast("double")),
        F.least(F.col("word_chars") / some, F.lit(30.0)),
        *[F.sqrt(F.col("_classes")[i] / chars) for i in range(1, len(CLASSES))],
        F.size(F.array_distinct("_words")) / F.pow(some.cast("double"), F.lit(0.85)),
        F.least(F.col("n_dup_lines") / F.greatest(F.lit(1.0), F.sqrt(some.cast("double"))), F.lit(3.0)),
        F.greatest(F.lit(0.0), (F.lit(10.0) - n) / 10),
    ]
    name = lambda c: F.coalesce(F.col("_row")[c].cast("string"), F.lit(""))
    return m.select(F.col("_row")[id_col].cast("long").alias("doc"), name(host_col).alias("host"), name(path_col).alias("path"), n.cast("long").alias("n_words"), _listed(F.col("_row")[text_col], toxic).alias("n_toxic"), F.array(*[v.cast("double") for v in values]).alias("x"))


def _listed(text: Column, words: list[str]) -> Column:
    """How many distinct words of the list the text holds."""
    if not words:
        return F.lit(0).cast("long")
    letters = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]++", -1)
    return F.size(F.array_intersect(letters, F.array(*[F.lit(w) for w in words]))).cast("long")


class Logistic:
    """Logistic regression on standard scores and their squares, by Newton's method with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30):
        self.mean, self.scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        self.w = np.zeros(2 * len(FEATURES) + 1)
        if len(set(y.tolist())) < 2:
            return
        z = self._expand(x)
        fine = np.eye(z.shape[1]) * ridge
        fine[-1, -1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + fine, z.T @ (p - y) + fine @ self.w)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def _expand(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([s, s * s, np.ones((len(x), 1))])

    def logit(self, x: Column) -> Column:
        total = F.lit(float(self.w[-1]))
        k = len(FEATURES)
        for i in range(k):
            s = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (x[i] - F.lit(float(self.mean[i]))) / F.lit(float(self.scale[i]))))
            total = total + s * F.lit(float(self.w[i])) + s * s * F.lit(float(self.w[k + i]))
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))


def strength(groups: int, n: float, n2: float, between: float, within: float) -> float:
    """How many documents the parent's mean is worth: the variance within groups over that between their true means,
    by the analysis of variance for groups of unequal size. n2: sum of squared sizes."""
    if groups < 2 or n <= groups:
        return 1e6
    msb, msw = between / (groups - 1), max(within, 0.0) / (n - groups)
    n0 = (n - n2 / n) / (groups - 1)
    spread = (msb - msw) / n0 if n0 > 0 else 0.0
    return float(min(1e6, max(1.0, msw / spread))) if spread > 0 else 1e6


def _spread(groups: DataFrame, parent: str) -> float:
    """The strength for ``groups`` (n, s, ss: size, sum and sum of squares of evidence; ``parent``: the mean above)."""
    mean = F.col("s") / F.col("n")
    r = groups.agg(
        F.count("*").alias("groups"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * (mean - F.col(parent)) * (mean - F.col(parent))).alias("between"),
        F.sum(F.col("ss") - F.col("n") * mean * mean).alias("within"),
    ).first()
    return strength(r["groups"], r["n"] or 0.0, r["n2"] or 0.0, r["between"] or 0.0, r["within"] or 0.0)


def quality_model(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    max_labels: int = 20_000,
    threshold: float = 0.5,
    toxic_col: str = "toxic",
    min_toxic_words: int = 2,
) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_words, evidence, host_posterior, path_posterior, quality, kept, and
    n_toxic_words and toxic (at least ``min_toxic_words`` distinct words of the list; without such labels none).

    documents has no URL, so by default its source stands for the host and its lang for the path: path_posterior is
    then that of a language within a source.

    The classifier is fitted to at most ``max_labels`` labelled documents, those with the least hash of their id; all
    else (scores, means, strengths, posteriors) covers every row. Without labels of both kinds the evidence is 0.5 and
    everything is kept. Null hosts and paths are groups of their own; null and empty texts have no words. Labels with
    a null id or value are left out; rows and labels that repeat count each. Very long texts are measured whole. Ids are
    integers; labels tied at ``max_labels`` go by id. An empty table gives none; other columns are not read.
    """
    id_column(df, id_col)
    words = toxic_words(df, labels, id_col, text_col, toxic_col, max_labels)
    x = written(features(df, id_col, text_col, host_col, path_col, words), "quality-features")
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{label_col}`").cast("double").alias("y")).dropna()
    sample = x.join(known, "doc").orderBy(F.xxhash64("doc"), "doc").limit(max_labels).select("x", "y").collect()
    model = Logistic(np.array([r["x"] for r in sample], float).reshape(len(sample), len(FEATURES)), np.array([r["y"] for r in sample], float))
    logit = model.logit(F.col("x"))
    scored = x.select("doc", "host", "path", "n_words", "n_toxic", logit.alias("z"), (1 / (1 + F.exp(-logit))).alias("p"))

    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")), "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(1 - 1e-6, max(1e-6, (total["s"] or 0.0) / max(1, total["n"] or 0)))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).withColumn("above", F.lit(mean))
    k_host = _spread(hosts, "above")
    hosts = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior"))
    paths = paths.join(hosts, "host")
    k_path = _spread(paths, "host_posterior")
    paths = paths.select("host", "path", "host_posterior", ((F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)).alias("path_posterior"))
    odds = lambda c: F.log(c / (1 - c))
    moved = F.col("z") + odds(F.least(F.greatest(F.col("path_posterior"), F.lit(1e-6)), F.lit(1 - 1e-6))) - math.log(mean / (1 - mean))
    out = scored.join(paths, ["host", "path"]).withColumn("quality", 1 / (1 + F.exp(-moved)))
    return out.select(F.col("doc").alias("doc_id"), "n_words", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("kept"), F.col("n_toxic").alias("n_toxic_words"), (F.col("n_toxic") >= min_toxic_words).alias("toxic"))
