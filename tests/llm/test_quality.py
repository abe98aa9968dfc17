from __future__ import annotations

import numpy as np

from tallyline.llm import quality
from tallyline.llm.queries import op8_quality
from tallyline.llm.subwords import default_paths
from tests.llm.fixtures import documents, empty

OUT = ["doc_id", "lang", "n_tokens", "perplexity", "threshold", "keep"]


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, trusted boolean")


def test_query_tells_trusted_text_from_junk(spark):
    data = "/root/testdata/sf0.01"
    found = op8_quality(spark, data)
    assert found.columns == OUT
    rows = found.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1 and not r.toxic]
    junk = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(junk) < 0.3


def test_odd_texts(spark):
    docs = documents(spark, extra=True)
    trusted = labels(spark, [(k, True) for k in range(100)] + [(k, False) for k in range(50)] + [(None, True)])
    rows = {r.doc_id: r for r in quality.classified(docs, trusted, documents=40).collect()}
    assert len(rows) == docs.count()
    for doc in (1000, 1001):
        assert (rows[doc].n_tokens, rows[doc].perplexity, rows[doc].keep) == (0, None, False)
    assert all(r.perplexity > 0 for doc, r in rows.items() if doc not in (1000, 1001))
    assert not rows[1013].keep or not rows[1014].keep
    assert rows[1004].perplexity == rows[1005].perplexity


def test_without_labels_or_documents(spark):
    rows = quality.classified(documents(spark), labels(spark)).collect()
    assert all(r.perplexity is None and r.threshold is None and r.keep == (r.n_tokens > 0) for r in rows)
    assert quality.classified(empty(spark), labels(spark, [(1, True)])).collect() == []


def test_the_model_is_a_distribution(spark):
    docs = documents(spark).where("doc_id < 30")
    counts = quality.counted(docs, default_paths())
    model = quality.Model(quality.smoothed(counts).toArrow())
    for context in ((50257, 50257), (50257, 464), (464, 262), (40000, 262), (40000, 40001)):
        units = np.array([[*context, unit] for unit in range(quality.VOCABULARY)], np.uint64)
        bits = model.bits(units.ravel(), np.arange(2, units.size, 3))
        assert abs(np.exp2(-bits).sum() - 1) < 1e-3


def test_all_trusted_text_is_counted_or_sets_thresholds(spark, monkeypatch):
    docs = documents(spark)
    learnt = []
    counted = quality.counted
    monkeypatch.setattr(quality, "counted", lambda rows, paths: learnt.append(rows.count()) or counted(rows, paths))
    quality.classified(docs, labels(spark, [(k, True) for k in range(100)]))
    assert 70 <= learnt[0] <= 90


def test_joined_n_grams_cost_what_those_at_hand_cost(spark, monkeypatch):
    docs = documents(spark)
    trusted = labels(spark, [(k, True) for k in range(60)])
    at_hand = sorted(quality.classified(docs, trusted).select(*OUT).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(quality, "FREQUENT", {3: 50, 2: 50})
    full = np.full(1 << (quality.BITMAP_LOG - 6), np.iinfo(np.uint64).max)
    for made in (quality.bitmap, lambda rare: full):
        monkeypatch.setattr(quality, "bitmap", made)
        joined = quality.classified(docs, trusted).select(*OUT).collect()
        assert sorted(joined, key=lambda r: r.doc_id) == at_hand
