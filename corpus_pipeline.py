"""Documents to packed training sequences: five stages, each written as Parquet and read again.

1. toxicity: documents that the classifier rejects go.
2. line_dedup: lines that an earlier document holds go.
3. jaccard_join: of documents that link (0.8 on shingles of five words; `op10` alone asks for 0.9 on three), the one with
   the least id stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: the pieces of the documents in sequences of at most 4096 tokens.

All stages but the last return the columns of documents. A stage sees all rows that the one before
kept. A null text counts as empty in every stage and is written as an empty text by the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemend.llm import decontaminate, jaccard, lines, packing, queries, toxicity
from linemend.session import work_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir, docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, shingle=5, threshold=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The classifier and the packing can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
