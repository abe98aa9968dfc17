from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import phrase_dedup, suffix_dedup
from tests.llm import brute
from tests.llm.fixtures import documents, empty, pairs, rows_of


@pytest.fixture(scope="module")
def docs(spark):
    pick = random.Random(3)
    # One passage with a different text before and after it in every document.
    passage = " ".join(f"p{k}" for k in range(45))
    many = [
        (7000 + k, " ".join([*(f"a{pick.randrange(10**6)}" for _ in range(40)), passage, f"z{k}"])) for k in range(60)
    ]
    return documents(spark, extra=True).unionByName(
        spark.createDataFrame(many, "doc_id long, text string"), allowMissingColumns=True
    )


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD_BYTES, 6000])
def test_strings_against_brute_force(docs, shard):
    """A small shard makes anchors crowded, so that their windows are counted."""
    found = suffix_dedup.deduplicate(docs, shard_bytes=shard)
    assert found.columns == [*(c for c in docs.columns if c != "kept"), "kept", "n_bytes", "n_removed", "n_spans"]
    found = found.withColumn("sha", F.sha2("kept", 256))
    wanted = sorted(brute.suffix_dedup(pairs(docs)))
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == wanted
    assert sum(row[2] > 0 for row in wanted) > 60


@pytest.mark.parametrize("shard", [phrase_dedup.SHARD_WORDS, 500])
def test_phrases_against_brute_force(docs, shard):
    found = phrase_dedup.deduplicate(docs, shard_words=shard).withColumn("sha", F.sha2("kept", 256))
    wanted = sorted(brute.phrase_dedup(pairs(docs)))
    assert rows_of(found, "doc_id", "n_words", "n_removed", "sha") == wanted
    assert sum(row[2] > 0 for row in wanted) > 60


def test_repeated_rows_and_missing_ids(spark):
    text = "".join(chr(97 + (k * k) % 23) for k in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text[:250]), (2, "short")], "doc_id long, text string")
    assert rows_of(suffix_dedup.deduplicate(docs), "doc_id", "n_removed") == [(None, 250), (1, 300), (1, 300), (2, 0)]
    assert suffix_dedup.deduplicate(empty(spark)).collect() == []
    assert phrase_dedup.deduplicate(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_common_prefixes_by_interval_expansion(seed):
    random = np.random.default_rng(seed)
    text = random.integers(97, 99 + seed, 300).astype(np.uint8)
    text[100:160] = text[20:80]
    text[-1] = 0xFF
    order = suffix_dedup.suffix_order(text, 30)
    around = np.concatenate([text, text])
    keys = [around[i : i + 30].tobytes() for i in order]
    assert keys == sorted(keys)
    common = suffix_dedup.bounded_prefixes(text, order, 20)
    for i in range(1, len(order)):
        same = next((k for k in range(20) if keys[i][k] != keys[i - 1][k]), -1)
        assert common[i] == same


def test_incomplete_characters_are_left_out(spark):
    kept = spark.createDataFrame([("é".encode()[1:] + b"ab" + "é".encode()[:1],)], "kept binary")
    assert kept.select(suffix_dedup.valid_text("kept")).first()[0] == "ab"
