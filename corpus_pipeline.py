"""A corpus pipeline of five operators: quality rules, near duplicates, repeated substrings, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but the last
return the columns of documents, with n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common, mixing, neardup, packing, quality, repeats

#: Least length of a repeated string that is cut out: passages of over 50 words have some 270 bytes and more.
REPEATED_BYTES = 250


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain limits and are no outliers of their language and source. Null and empty texts go, repeated rows are
    judged alike, a null language or source is a value of its own, an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that share at least 0.8 of their five-word n-grams: the one with the smallest id (null ids
    last), then text hash. Of repeated rows with equal ids and texts one stays, texts without a word stay, an empty table stays empty."""
    return neardup.keep_one(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of REPEATED_BYTES bytes that start elsewhere too. Null texts stay null, a text of which nothing is left is
    empty, equal texts that are long enough are emptied alike (the stage before leaves one of them), an empty table stays empty."""
    return repeats.remove(docs, REPEATED_BYTES).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null source is a source of its own, sources without words take nothing, repeated rows are
    drawn alike, an empty table stays empty."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place. A null or empty text is its end token, repeated rows are packed once each, an
    empty table gives no pieces."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_substrings),
    ("source_mixing", source_mix),
    ("best_fit_packing", packed),
]

#: Best-fit packing, word pieces and robust estimates are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. Between stages, rows are written below the checkpoint folder of the session."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
