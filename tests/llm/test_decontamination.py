from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.llm.decontamination import contamination
from tallyline.llm.queries import op2_decontamination
from tests.conftest import SAMPLE
from tests.llm import brute
from tests.llm.fixtures import PASSAGE, documents, empty, pairs, rows_of

ITEMS = [
    (1, "shared3 shared4"), (2, "ONE"), (3, None), (4, "..."), (5, PASSAGE), (6, "two  words"), (7, "words"),
    (8, " ".join(PASSAGE.split()[5:15])), (9, " ".join(PASSAGE.split()[10:19])), (9, "Two words"), (None, "three one"),
    (10, "word word word word word word word word word word word"), (11, "not there at all"), (12, "日本語の文章です"),
]


def test_against_brute_force(spark):
    docs = documents(spark, extra=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("row", F.lit(1))
    items = items.unionByName(spark.read.parquet(f"{SAMPLE}/benchmark.parquet").withColumn("row", F.lit(2)))
    found = contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("s"),
        (F.col("n_hit") > 0).alias("c"),
    )
    wanted = brute.contamination(pairs(docs), pairs(items, "item_id", "text"))
    assert rows_of(found, *found.columns) == sorted(wanted)
    hit = {row[0] for row in wanted if row[-1]}
    assert {1003, 1004, 1009, 1011, 1012, 1014} <= hit and not {1000, 1001, 1008, 1018} & hit


def test_query(spark):
    found = op2_decontamination(spark, SAMPLE)
    docs, items = (spark.read.parquet(f"{SAMPLE}/{t}.parquet") for t in ("documents", "benchmark"))
    assert rows_of(found, *found.columns) == sorted(brute.contamination(pairs(docs), pairs(items, "item_id", "text")))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty(spark), none).collect() == []
    assert all(r.n_hit == 0 and not r["items"] for r in contamination(documents(spark), none).collect())
