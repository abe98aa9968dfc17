"""One registered query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    clustering,
    decontamination,
    exact_dedup,
    fingerprints,
    language_id,
    lexical_search,
    lm_scoring,
    near_dedup,
    packing,
    phrase_dedup,
    quality,
    suffix_dedup,
    warc,
)
from tallyline.llm.statements import STATEMENTS

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, data_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    return lm_scoring.scores(table(spark, data_dir, "documents"), held_out)


def op2_decontamination(spark: SparkSession, data_dir: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, data_dir, "documents"), table(spark, data_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_near_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, data_dir, "documents"))


def op4_language_id(spark: SparkSession, data_dir: str) -> DataFrame:
    docs = table(spark, data_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    models = language_id.trained(docs.where(~held_out))
    found = language_id.identified(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_packing(spark: SparkSession, data_dir: str) -> DataFrame:
    return packing.pack(table(spark, data_dir, "documents"))


def op6_fingerprints(spark: SparkSession, data_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(spark, data_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    cleaned = suffix_dedup.deduplicate(table(spark, data_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_quality(spark: SparkSession, data_dir: str) -> DataFrame:
    labels = table(spark, data_dir, "labels")
    trusted = labels.select("doc_id", (F.expr("quality = 1 and coalesce(toxic, 0) = 0")).alias("trusted"))
    return quality.classified(table(spark, data_dir, "documents"), trusted)


def op9_warc(spark: SparkSession, data_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, data_dir, "pages"))

    def page(urn: str) -> Column:
        digits = F.regexp_extract(urn, "^<urn:page:(-?[0-9]+):", 1)
        return F.when(digits != "", digits.cast("long"))

    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"),
    )


def op10_phrase_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    cleaned = phrase_dedup.deduplicate(table(spark, data_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_clustering(spark: SparkSession, data_dir: str) -> DataFrame:
    found = clustering.clustered(table(spark, data_dir, "embeddings"))
    return found.withColumn("centroid_sha256", clustering.centroid_digest()).drop("centroid")


def op12_lexical_search(spark: SparkSession, data_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, data_dir, "documents"), table(spark, data_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    found = exact_dedup.marked(table(spark, data_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def registered() -> dict[str, Query]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_decontamination": op2_decontamination,
        "op3_near_dedup": op3_near_dedup,
        "op4_language_id": op4_language_id,
        "op5_packing": op5_packing,
        "op6_fingerprints": op6_fingerprints,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_quality": op8_quality,
        "op9_warc": op9_warc,
        "op10_phrase_dedup": op10_phrase_dedup,
        "op11_clustering": op11_clustering,
        "op12_lexical_search": op12_lexical_search,
        "op13_exact_dedup": op13_exact_dedup,
    }


def statements() -> dict[str, str]:
    return dict(STATEMENTS)
