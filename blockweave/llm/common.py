"""What the operators of this subpackage share: the shared folder, sizes, ASCII rules and columns of their own."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import shared_dir, shared_table as written  # noqa: F401

#: The white space of every contract, as text and as a regular expression's class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def id_column(df: DataFrame, name: str) -> Column:
    """The column ``name`` as long. Ids are integers: a column of another type is refused, not turned into nulls."""
    kind = df.schema[name].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{name} is to be a column of integers, not {kind.simpleString()}")
    return F.col(f"`{name}`").cast("long")


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: a measured size from which numbers of shards and buckets follow."""
    return df.select(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0


def pieces_for(nbytes: int, each: int, least: int = 1) -> int:
    """How many pieces of ``each`` bytes hold ``nbytes``."""
    return max(least, -(-nbytes // each))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to make; names clash without regard to case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` as one struct column ``_row``, without the columns ``names``: its columns clash with no working column."""
    base = without(df, *names)
    return base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_row"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and empty have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE_CLASS + "+", -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` where ``value`` is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(a: Column, zero: int, op, width: int = 256) -> Column:
    """Running values of ``op`` (max, sum and the like, with ``zero`` as its neutral long) over an array of longs.

    An array grows by a copy, so it is run over in parts of ``width`` and then over the parts' last values: the cost is
    that of the length, not of its square.
    """
    none, start = F.array().cast("array<bigint>"), F.lit(zero).cast("long")

    def over(part: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda c: over(F.slice(v, c * width + 1, width)))
        before = lambda p: F.slice(F.concat(F.array(start), over(F.transform(p, lambda x: F.element_at(x, -1)))), 1, F.size(p))
        return let(parts, lambda p: F.flatten(F.zip_with(p, before(p), lambda x, o: F.transform(x, lambda y: op(y, o)))))

    return let(a, lambda v: F.when(F.size(v) == 0, none).otherwise(whole(v)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
