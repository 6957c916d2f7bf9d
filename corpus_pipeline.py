"""Corpus pipeline: toxicity filter, exact dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame with
the columns of ``documents``; the last returns packed pieces. SQL cannot express the stages (trained trees,
similarity, tokens), so there is no ORACLE_SQL; tests compare a small run with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.decontaminate import decontaminate
from tapewright.llm.exact_dedup import exact_dedup
from tapewright.llm.near_dup import near_duplicates
from tapewright.llm.packing import pack_documents
from tapewright.llm.scratch import Scratch
from tapewright.llm.toxicity import fit

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below 0.5. Each row goes along with its score, so that ids play no part."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), id_col="row")
    return scored.where(~F.coalesce(F.col("score") >= 0.5, F.lit(False))).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are linked, the one with the least id stays; rows without an id come last. Rows are told apart by a key of their own."""
    keyed = Scratch(spark, "near-copies").save(docs.withColumn("row_key_", F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed, id_col="row_key_", shingle=5, percent=80).join(keyed.select("row_key_", "doc_id"), "row_key_")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key_"))["row_key_"]
    linked = found.groupBy("component_id").agg(least.alias("kept_key"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = found.join(linked, "component_id").where("row_key_ <> kept_key").select("row_key_")
    return keyed.join(gone, "row_key_", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
