"""Importance resampling towards a target: documents whose hashed word features look like the target's are drawn.

Everything is DataFrame work: the n-gram arrays of a text are exploded and put to buckets by crc32, buckets are counted by
one aggregate with partial counts, and their gains are a table of ``buckets`` rows that is sent to every worker. A
document's gains are added up where it was exploded. The draw sorts by ranges of the score; a document's rank is its
place in its range and the number of documents in the ranges before it, so no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, id_column, written

#: What parts words: runs of ASCII characters that are neither digits nor letters.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK, -1), lambda w: w != "")


def _grams(words: Column) -> Column:
    """(w, v): each word with its successor, null for the last."""
    return F.arrays_zip(words.alias("w"), F.slice(words, 2, F.size(words)).alias("v"))


def _buckets(buckets: int) -> list[Column]:
    """The buckets of the features that begin at a word ``g``: the word, and the word with its successor (null for the last)."""
    at = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(buckets)).cast("int")
    return [at(F.col("g.w")), at(F.concat(F.col("g.w"), F.lit(" "), F.col("g.v")))]


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """(bucket, n) of all features of all texts."""
    grams = texts.select(F.explode(_grams(_words(F.col(f"`{text_col}`")))).alias("g"))
    return grams.select(F.explode(F.array(*_buckets(buckets))).alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for all ``buckets``: 1000 times the log of target's over documents' smoothed share, rounded down."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    t = every.join(bucket_counts(docs, text_col, buckets).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_counts(target, text_col, buckets).withColumnRenamed("n", "t"), "bucket", "left")
    t = written(t.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")]), "bucket-counts")
    whole = t.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return t.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row of totals


def luck(id_: Column, seed: int) -> Column:
    """1000 times a standard Gumbel number that the id and the seed tell, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in the order, from 1. Ranges are sorted each, and a place counts on from the ranges before."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition's number times 2 ** 33, and the place in it
    parts = written(sorted_.withColumns({"_part": F.shiftright(at, 33), "_place": at.bitwiseAND((1 << 33) - 1)}), "resample-ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("before"))  # a row a range
    return parts.join(F.broadcast(before), "_part").withColumn(name, (F.col("before") + F.col("_place") + 1).cast("long")).drop("_part", "_place", "before")


def weights(rows: DataFrame, gained: DataFrame, buckets: int) -> DataFrame:
    """(id, n_words, n_features, weight) of ``rows`` (id, text): the floored mean of the gains of a text's features."""
    words = rows.select(F.monotonically_increasing_id().alias("row"), "id", _words(F.col("text")).alias("words"))
    n = F.size("words").cast("long")
    grams = words.select("row", "id", n.alias("n_words"), F.explode_outer(_grams(F.col("words"))).alias("g"))
    felt = grams.select("row", "id", "n_words", F.explode(F.array(*_buckets(buckets))).alias("bucket")).join(F.broadcast(gained), "bucket", "left")
    total = felt.groupBy("row", "id", "n_words").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    features = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    total = total.withColumn("n_features", features)
    mean = F.call_function("div", F.col("total") - F.pmod("total", F.greatest("n_features", F.lit(1))), F.greatest("n_features", F.lit(1)))
    return total.select("id", "n_words", "n_features", mean.alias("weight"))


def resample(df: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``df``; rank is null for what is not drawn.

    Words are runs of digits 0-9, ASCII letters and characters beyond ASCII, A-Z lower-cased; features are the words and
    the pairs of neighbouring words, repeats counted, in buckets by crc32. ``weight`` is the floored mean of their buckets'
    gains, 0 without features; ``score`` adds Gumbel noise of the id, so that the highest scores are a draw without
    replacement by weight. Of the N rows with at least ``min_words`` words the floor(percent * N / 100) highest are drawn,
    ranked from 1.

    Ties go to the smaller id, null ids last; rows that repeat an id with one score are ranked in any order. Null and
    empty texts have no features. A text is read whole, whatever its length, and costs memory by its words. An empty table
    gives an empty table; an empty target leaves the gains to the documents' own counts. Other columns are not read.
    """
    rows = df.select(id_column(df, id_col).alias("id"), F.col(f"`{text_col}`").alias("text"))
    gained = written(gains(rows, target.select(F.col(f"`{target_col}`").alias("text")), "text", buckets), "bucket-gains")
    scored = written(weights(rows, gained, buckets).withColumn("score", F.col("weight") + luck(F.col("id"), seed)), "resample-scores")
    able = F.col("n_words") >= min_words
    drawn = percent * scored.filter(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("id")]
    place = ranked(scored.filter(able), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    both = place.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return both.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
