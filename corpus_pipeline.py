"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination and packing of ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame with the
columns of documents, but for the last, which returns packed pieces. Null and empty texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockweave.llm.common import table, written
from blockweave.llm.decontaminate import mark_contaminated
from blockweave.llm.jaccard import one_of_each
from blockweave.llm.line_dedup import dedup_lines
from blockweave.llm.packing import pack
from blockweave.llm.quality_rules import quality_rules
from blockweave.llm.queries import tokenizer_path


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    """``out`` with the columns of ``docs``; n_chars follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that at least five hold, but in the last of them."""
    return _as(docs, dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return mark_contaminated(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("packing", packed)]
#: The similarity components and the tokenizer have no SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
