"""Corpus pipeline over ``documents``: what each stage decides takes effect for the next.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each group of documents with five-word shingle sets of
   similarity 0.8 or more, the one with the smallest id stays (rows with null ids stay).
3. repeats: passages of 200 bytes or more that repeat anywhere are cut out of the
   texts (with the rest of a character that a cut would split); rows stay.
4. secrets: what the secret scan finds is replaced by ``[secret]``; rows stay.
5. packing: length bucket, batch and slot of each document.

All stages but the last return the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelspark.llm import packing, quality, secrets, set_join, suffix_dedup
from funnelspark.llm.workspace import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("kept").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = set_join.similar_documents(docs)
    stay = classes.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(stay, "doc_id", "left_semi")
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source", "lang"))
    named = named.withColumn("_copy", copy).filter("_copy = 1")
    return named.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, keep=("lang", "source"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The quality model and the suffix stage are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and reread."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
