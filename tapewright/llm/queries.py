"""Queries of the training-data operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import oracles
from tapewright.llm.chat import conversation_digests
from tapewright.llm.decontaminate import find_contamination
from tapewright.llm.exact_dedup import exact_groups
from tapewright.llm.html_text import extract_text
from tapewright.llm.licenses import license_scan
from tapewright.llm.near_dup import near_duplicates
from tapewright.llm.packing import pack_documents
from tapewright.llm.repeats import covered_bytes, remove_repeats
from tapewright.llm.repair import repair_conversations
from tapewright.llm.resample import resample
from tapewright.llm.toxicity import fit as fit_toxicity
from tapewright.llm.toxicity import fold
from tapewright.llm.url_rules import judge_urls
from tapewright.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=85)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_read(spark, sf_dir, "documents"), keep="max")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = fit_toxicity(docs, _read(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(said).alias("text"))
    return conversation_digests(given.unionByName(probe))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op6_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), share=0.5)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


#: Passages of over 50 words have, as a rule, at least so many bytes in the corpus' languages; many have fewer than 400.
PASSAGE = 256


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_read(spark, sf_dir, "documents"), length=400, passage=PASSAGE)
    removed = covered_bytes(F.col("spans"))
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256",
        # Beyond the contract: repeats that are too short to be removed.
        F.col("passage_bytes").alias("n_passage_bytes"), (F.col("passage_bytes") > 0).alias("holds_passage"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end_word"] - s["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_read(spark, sf_dir, "embeddings"), components=8)


def _damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that a repair is to find; dropped ones are kept as not present."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    times = F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), (hit != 0).alias("present"), times.alias("times"))
    return rows.withColumn("times", F.explode("times"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_damaged(_read(spark, sf_dir, "conversations")), present_col="present")


#: Host, path and verdict of the rules of ``op13_url_rules``.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def queries() -> dict[str, Query]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_chat_format": op4_chat_format,
        "op5_packing": op5_packing,
        "op6_resample": op6_resample,
        "op7_html_text": op7_html_text,
        "op8_license_scan": op8_license_scan,
        "op9_repeats": op9_repeats,
        "op10_decontamination": op10_decontamination,
        "op11_whitening": op11_whitening,
        "op12_repair": op12_repair,
        "op13_url_rules": op13_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": oracles.OP1,
        "op2_exact_dedup": oracles.OP2,
        "op4_chat_format": oracles.OP4,
        "op8_license_scan": oracles.OP8,
        "op10_decontamination": oracles.OP10,
        "op13_url_rules": oracles.OP13,
    }
