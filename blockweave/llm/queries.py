"""The queries opN_<name>: each applies an operator to its whole table and returns the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_chunks import decode, encode
from .common import table
from .decontaminate import mark_contaminated
from .divergence import divergence
from .html_text import main_text
from .jaccard import jaccard_components
from .lattice import lattice_scores
from .line_dedup import dedup_lines
from .packing import pack
from .pii import KINDS, find_pii, written_out
from .quality_model import quality_model
from .quality_rules import quality_rules
from .resample import resample
from .sql import SQL  # noqa: F401
from .suffix_dedup import remove_repeats


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mark_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.sort_array(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = quality_rules(docs)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base_spans", lambda x: x["k"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]  # noqa: B023
    return d.select("doc_id", *counts, F.sha2(written_out(F.col("base_spans")), 256).alias("base_sha256"), written_out(F.col("all_spans")).alias("spans"), F.size("all_spans").cast("long").alias("n_spans"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op12_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode(encode(table(spark, sf_dir, "documents"), word_tokenizer_path()), word_tokenizer_path())
    return d.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_model, op2_line_dedup, op3_decontaminate, op4_jaccard_join, op5_packing, op6_quality_rules, op7_suffix_dedup, op8_pii, op9_html_text, op10_lattice, op11_source_divergence, op12_bpe_chunks, op13_resample, pipeline)}
