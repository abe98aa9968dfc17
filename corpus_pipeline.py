"""A training-data pipeline of five stages over ``documents``.

Every stage gets what the stage before it kept, written as Parquet and read again, and all but the
last return the columns of ``documents``. The operators take any further columns along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontamination, language_id, near_dedup, packing, suffix_dedup
from tallyline.sources.scratch import stored, stored_alone

# Keys of that many rows are broadcast; of more, texts are shuffled to them.
BROADCAST_KEYS = 1 << 22


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labelled ones; ``lang`` stays as it was given."""
    models = language_id.trained(docs)
    rows = docs.select("text", F.struct("*").alias("row"))
    return language_id.scored(rows, models).where("not made.rejected").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, rows without an id last. Rows are
    told apart by a key made here, so copies under one id or without an id go too, and rows of one id
    with different texts are decided each on its own."""
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "keyed")
    order = F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id", "key")

    def first_rows() -> DataFrame:
        found = near_dedup.near_copies(keyed.select(F.col("key").alias("doc_id"), "row.text"))
        found = found.select(F.col("doc_id").alias("key"), "component_id")
        rows = found.join(keyed.select("key", order.alias("order")), "key")
        return rows.groupBy("component_id").agg(F.min("order").alias("first")).select("first.key")

    # What the search leaves is gone before the texts are looked at again.
    kept = stored_alone(spark, first_rows, "kept-rows")
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_KEYS else kept
    return keyed.join(kept, "key", "left_semi").select("row.*")


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur twice; ``n_chars`` follows a changed text.
    Parts of a character that are left over go too; a null text stays null."""
    # What the search leaves is gone before the texts are looked at again. They pass through Python once: a
    # second function would take a second worker for every task, and executors keep their workers.
    spans = stored_alone(spark, lambda: suffix_dedup.repeated_spans(docs.select("doc_id", "text")), "repeated-spans")
    cleaned = suffix_dedup.cut_texts(docs.select("doc_id", "text", F.struct("*").alias("row")), spans)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("cut")).otherwise(F.col("row.text"))
    made = {"text": text}
    if "n_chars" in docs.columns:
        size = F.when(cut, F.char_length(text)).otherwise(F.col("row.n_chars"))
        made["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark. Every row is decided on its own text,
    whatever its id: a row without an id goes too, and a clean row stays if another of its id goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "keyed")

    def hit_rows() -> DataFrame:
        found = decontamination.contamination(keyed.select(F.col("key").alias("doc_id"), "row.text"), benchmark)
        return found.where("n_hit > 0").select(F.col("doc_id").alias("key"))

    gone = stored_alone(spark, hit_rows, "contaminated")
    return keyed.join(gone, "key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", identify),
    ("near-duplicate removal", drop_near_copies),
    ("repeated-string removal", drop_repeated_strings),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

# Trained models and tokenizers have no SQL; the tests run the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage-{number}")
    return docs
