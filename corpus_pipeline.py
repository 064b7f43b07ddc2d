"""The corpus pipeline: rules, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir). All but the last return rows with the columns of documents; the last returns one row per
packed piece. Texts that the rules' posterior rejects, or that repeat themselves, go (short ones are judged like others); of each near-duplicate group the
document with the smallest doc_id stays (texts are linked by SimHash as in op1, and where they share 0.8 of their 5-word shingles, which 4 of 64 bits don't cover); documents that hold a benchmark window go; personal data is replaced by its kind; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import decontamination, jaccard, packing, pii, quality_rules, simhash
from driftloom.llm.common import cut, row_key, shared_folder, spread, table, without
from driftloom.llm.tokens import default_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(spread(docs.select(row_key().alias("key"), "text")), keep_text=False, min_words=0)
    return without(docs, cut(judged.where(~F.col("kept")).select("key").distinct()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = spread(docs)
    return simhash.keep_one(docs, also=cut(jaccard.near_duplicates(docs).select("key", "root")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(row_key().alias("key"), "text")
    found = decontamination.hits(keyed, table(spark, sf_dir, "benchmark"))
    return without(docs, cut(found.where(F.size("spans") > 0).select("key").distinct()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(spread(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(spread(docs), default_tokenizer()))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark_passages), ("personal_data", personal_data), ("packing", pack)]
#: The stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
