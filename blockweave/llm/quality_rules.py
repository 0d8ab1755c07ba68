"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules look at a text alone: too few words, or too many words in repeated five-word windows. The method
compares two histograms of each text with references of its language: shares of character classes, and shares of
the language's most common words. The references are learnt from all documents that pass the base rules, each
distinct text once, so that copies do not set the norm. The distance is Jensen-Shannon's (the square root of the
divergence to base 2, so between 0 and 1). Texts too short for a histogram to mean anything pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE_CLASS, SPACES, boxed, let, without, words_of, written

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Hashes of repeated texts that are sent to every worker, 9 bytes each; beyond, all texts are shuffled.
SENT_HASHES = 2_000_000
#: Class names of characters; what is in none of the first five is "other".
CLASSES = ("lower", "upper", "digit", "symbol", "mark", "other")
_CLASS = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": r"[#*$%&|<>]+", "mark": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"}
OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def repeated_words(words: Column) -> Column:
    """Words covered by five-word windows that stand in the text twice or more, the first included.

    Windows are compared by a 64-bit hash of their word hashes. They are sorted with their places, so that equal
    ones are neighbours, and the places found are merged: n log n for any text.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(
        hashes,
        lambda h: F.transform(
            F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(WINDOW)]),
        ),
    )

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ranked,
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
                        lambda x: x["i"],
                    )
                ),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            ),
        )

    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(some)


def language_of(c: Column) -> Column:
    """A language code of two or three letters, else ``und``: at most 18,279 values, which bounds the references."""
    low = F.lower(c)
    return F.when(low.rlike("^[a-z]{2,3}$"), low).otherwise(F.lit("und"))


def _measured(df: DataFrame, text_col: str, lang_col: str | None) -> DataFrame:
    """``df`` in a struct beside its words, counts and language."""
    row = boxed(df, *OWN)
    text = F.coalesce(F.col("_row")[text_col], F.lit(""))
    lines = let(
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0),
        lambda a: F.size(a) - F.size(F.array_distinct(a)),
    )
    # Each step takes one class of characters out, so that the later steps see short strings.
    m = row.select(
        "_row",
        words_of(text).alias("_words"),
        lines.cast("long").alias("n_dup_lines"),
        F.regexp_replace(text, SPACE_CLASS + "+", "").alias("_left"),
        (language_of(F.col("_row")[lang_col]) if lang_col else F.lit("und")).alias("_lang"),
    )
    kept = ["_row", "_words", "n_dup_lines", "_lang"]
    m = m.select(*kept, F.length("_left").cast("long").alias("word_chars"), "_left")
    done = ["word_chars"]
    for k in CLASSES[:-1]:
        m = m.select(*kept, *done, F.length("_left").alias("_n"), F.regexp_replace("_left", _CLASS[k], "").alias("_left"))
        m = m.select(*kept, *done, (F.col("_n") - F.length("_left")).cast("long").alias(f"_{k}"), "_left")
        done.append(f"_{k}")
    return m.select(
        *kept,
        "word_chars",
        F.col("_symbol").alias("n_symbols"),
        F.array(*[F.col(f"_{k}") for k in CLASSES[:-1]], F.length("_left").cast("long")).alias("_classes"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The base rules: fewer than ten words, or more than a fifth of them in repeated windows."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _distinct(texts: DataFrame) -> DataFrame:
    """The distinct rows of (text, lang). A text whose hash stands alone is passed on where it is; only the others are
    shuffled, if the hashes that stand more than once, whose number is measured, can be sent to every worker."""
    hashed = texts.withColumn("h", F.xxhash64("text", "lang"))
    again = written(hashed.groupBy("h").count().filter("count > 1").select("h", F.lit(True).alias("again")), "repeated-texts")
    if again.count() > SENT_HASHES:
        return texts.distinct()
    marked = hashed.join(F.broadcast(again), "h", "left")
    # Copies meet in partial sums of their task, so a text in a third of all rows is one row a task.
    return marked.filter("again is null").select("text", "lang").unionByName(marked.filter("again").select("text", "lang").distinct())


def _norm(df: DataFrame, text_col: str, lang_col: str | None) -> DataFrame:
    """_lang, _words and _classes of each distinct text of a language; _words is null where it fails the base rules. It is
    no filter, which would be pushed below the search for distinct texts and split every text once more."""
    lang = language_of(F.col(f"`{lang_col}`")) if lang_col else F.lit("und")
    m = _measured(_distinct(df.select(F.col(f"`{text_col}`").alias("text"), lang.alias("lang"))), "text", "lang")
    return m.select("_lang", F.when(~base_failed(F.size("_words"), repeated_words(F.col("_words"))), F.col("_words")).alias("_words"), "_classes")


def references(df: DataFrame, text_col: str = "text", lang_col: str | None = "lang", top_words: int = 32) -> DataFrame:
    """One row a language: shares of the character classes and its most common words with their shares.

    Each distinct text of a language that passes the base rules counts once; a language without one has no row. Words are
    lower-cased as Spark does, at most 24 characters long and without commas; equal counts go by the word. The table has at
    most 18,279 rows of at most 32 short words, so it may be broadcast at any input size.
    """
    each = _norm(df, text_col, lang_col).select("_lang", "_classes", F.posexplode_outer("_words").alias("at", "w"))
    # One aggregate for both: the first word of a text brings its characters.
    sums = [F.sum(F.when(F.col("at") == 0, F.col("_classes")[i])).alias(f"c{i}") for i in range(len(CLASSES))]
    words = written(each.groupBy("_lang", "w").agg(F.count("*").alias("count"), *sums), "language-words").filter("w is not null")
    classes = words.groupBy("_lang").agg(F.sum("count").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(CLASSES))])
    words = words.filter((F.length("w") <= 24) & ~F.contains("w", F.lit(","))).groupBy("_lang", F.lower("w").alias("w")).agg(F.sum("count").alias("c"))
    # Two ranked steps, each cut to ``top_words`` before its shuffle: no task sees all words of a language.
    words = words.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(64)))
    for keys in (["_lang", "salt"], ["_lang"]):
        words = words.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("c"), "w"))).filter(F.col("r") <= top_words)
    tops = words.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "w"))).alias("t"))
    total = sum((F.col(f"c{i}") for i in range(1, len(CLASSES))), F.col("c0"))
    return classes.join(tops, "_lang", "left").select(
        "_lang",
        F.array(*[F.col(f"c{i}") / F.greatest(total, F.lit(1)) for i in range(len(CLASSES))]).alias("_ref_classes"),
        F.coalesce(F.transform("t", lambda x: x["w"]), F.array().cast("array<string>")).alias("_ref_words"),
        F.coalesce(F.transform("t", lambda x: -x["c"] / F.greatest(F.col("n"), F.lit(1))), F.array().cast("array<double>")).alias("_ref_shares"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of the same length, each summing to 1."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def quality_rules(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    min_chars: int = 200,
    min_words: int = 40,
    max_class_distance: float = 0.3,
    max_word_distance: float = 0.42,
    refs: DataFrame | None = None,
) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, the two distances and kept.

    A null or empty text has no words, fails the base and is not kept; its distances are 0. Texts below ``min_chars``
    characters of words have no class distance and those below ``min_words`` words no word distance (both 0): the
    guards keep short clean texts. So have all texts of a language without a reference. A null or odd language counts as ``und``. Rows are judged one by one, so repeated
    rows get the same verdict; very long texts are judged whole, and words of tied counts go by the word. An empty table
    gives none. Columns of these names in ``df`` are replaced.
    """
    refs = references(df, text_col, lang_col) if refs is None else refs
    m = _measured(df, text_col, lang_col).join(F.broadcast(refs), "_lang", "left")
    solid = F.greatest(F.col("word_chars"), F.lit(1))
    classes = F.transform("_classes", lambda c: c / solid)
    n = F.size("_words")
    # Places of the text's words among the reference's, 0 for none; then how many there are of each place.
    listed = F.array_join("_ref_words", ",")
    places = F.array_remove(let(listed, lambda x: F.transform("_words", lambda w: F.find_in_set(F.lower(w), x))), 0)
    seen = let(places, lambda a: F.transform("_ref_words", lambda r, k: (F.size(a) - F.size(F.array_remove(a, k + 1))) / F.greatest(n, F.lit(1))))
    rest = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))
    m = m.select(
        "*",
        n.cast("long").alias("n_words"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.when(F.col("word_chars") >= min_chars, js_distance(classes, F.col("_ref_classes"))).otherwise(0.0).alias("class_distance"),
        F.when(n >= min_words, let(seen, lambda s: js_distance(rest(s), rest(F.col("_ref_shares"))))).otherwise(0.0).alias("word_distance"),
    )
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    fits = (F.col("class_distance") <= max_class_distance) & (F.col("word_distance") <= max_word_distance)
    return m.select(
        *[F.col("_row")[c].alias(c) for c in without(df, *OWN).columns],
        *OWN[:5],
        failed.alias("base_failed"),
        "class_distance",
        "word_distance",
        (~failed & fits).alias("kept"),
    )
