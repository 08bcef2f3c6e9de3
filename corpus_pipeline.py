"""From raw documents to token records: quality, near copies, benchmark leaks, mixing, records.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.llm import decontaminate, mixing, quality_rules, records, simhash
from netweir.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.judge(docs).where("__verdict.kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts (five-word shingles, 0.8)."""
    return simhash.one_of_each_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies."""
    return mixing.mixed_rows(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The record files' index: doc_id, start, n_tokens, ids_crc32, file, offset, length."""
    import public_tokenizers
    path, index = shared_folder(spark, "records"), shared_folder(spark, "record-index")
    records.write_records(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return records.write_index(spark, path, index).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "file", "offset", "length")


STAGES = [("quality rules", quality), ("near copies", near_copies), ("benchmark leaks", benchmark_leaks),
          ("source mix", source_mix), ("token records", token_records)]

#: covariance estimates, components and tokens are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
