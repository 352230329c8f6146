"""A training-data pipeline over ``documents``: quality rules, near duplicates, decontamination, personal data, packing."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import common, op2_pii, op3_quality, op5_ngram_join, op6_decontaminate, op7_packing
from folioscope.llm.queries import tokenizer_path

__all__ = ["STAGES", "ORACLE_SQL", "run"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    return op3_quality.judge(whole).filter("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id (a null one last), then text's hash.

    Texts without words are near nothing; of their equal rows, as of all, one stays.
    """
    found = op5_ngram_join.grouped(docs)
    keep = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    keep = keep.select(F.col("first.doc_id").alias("_kept"), F.col("first.row").alias("_row")).distinct()
    row = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string").cast("binary"))
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["_kept"]) & (row == keep["_row"]), "left_semi").dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = op6_decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_bad"), F.col("row").alias("_row")).distinct()
    text = F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string").cast("binary"))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (text == bad["_row"]), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return op2_pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 4096 tokens."""
    return op7_packing.pack(op7_packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: SQL can't tokenize, so the pipeline has no statement; tests compare its stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read by the next stage."""
    docs = common.table(spark, sf_dir, "documents")
    folder = os.path.join(common.shared_folder(spark, "pipeline"), uuid.uuid4().hex)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
