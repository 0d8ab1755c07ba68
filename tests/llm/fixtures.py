"""Small documents with every odd case, and the check that a result equals a brute-force one."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LINE = "this line is long enough to count as one that repeats"
ODD = [
    (1, "alpha beta gamma\n  " + LINE + "\t\nlast"),
    (2, LINE.upper() + "\n" + LINE),
    (3, LINE + "\nü " + "ö" * 39 + "\nend"),
    (4, "x\n" + LINE + "\n" + LINE + "\ny"),
    (5, LINE),
    (6, LINE + " \n\n"),
    (7, None),
    (8, ""),
    (9, " \t\n"),
    (10, "one two"),
    (11, "one  two"),
    (12, "word " * 3000),
    (13, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 40),
    (14, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (14, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
    (15, "é" * 5000),
    (16, "x" * 120000),
    (17, "<|endoftext|> mail me: a.b@c.example.com or +1 (017) 555-7713, 4539 1488 0343 6467 at 10.2.3.4"),
    (18, "Zürich straße 漢字 テスト 😀 words"),
]


def documents(spark, rows=None, extra=True):
    """ODD, or rows of (doc_id, text), with columns that clash with what operators make."""
    rows = ODD if rows is None else rows
    df = spark.createDataFrame([(i, t, ["en", "de", None, "x-odd"][k % 4], ["src0", None][k % 5 == 4], None) for k, (i, t) in enumerate(rows)], SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("mine") for c in ("kept", "n_words", "fp", "doc", "n_lines", "_words", "shard", "length", "score", "component_id", "spans")})
    return df


def real(spark, sf_dir, n=None):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    return rows[:n]


def same(found, expected):
    """Rows as sorted lists."""
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, expected), key=key)
