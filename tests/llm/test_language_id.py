from __future__ import annotations

from collections import Counter
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import language_id
from tallyline.llm.queries import op4_language_id
from tests.conftest import SAMPLE
from tests.llm.fixtures import documents, empty


def test_held_out_accuracy_and_rejection(spark):
    found = op4_language_id(spark, SAMPLE).join(spark.read.parquet(f"{SAMPLE}/documents.parquet"), "doc_id")
    rows = [r for r in found.collect()]
    assert len(rows) == 200
    held = [r for r in rows if r.held_out]
    assert 20 < len(held) and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 2


def test_odd_texts(spark):
    models = language_id.trained(spark.read.parquet(f"{SAMPLE}/documents.parquet"))
    docs = documents(spark, extra=True)
    found = language_id.identified(docs, models)
    assert found.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score", "n_letters", "bits", "rejected"]
    rows = {r.doc_id: r for r in found.collect()}
    for doc in (1000, 1001, 1002, 1006):
        assert (rows[doc].lang_pred, rows[doc].score, rows[doc].rejected) == ("und", 0.0, True)
    assert rows[1014].rejected and rows[1013].rejected and rows[1018].rejected
    assert rows[1004].lang_pred in models.languages and np.isfinite(rows[1018].bits)


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    models = language_id.trained(spark.read.parquet(f"{SAMPLE}/documents.parquet"))
    text = spark.read.parquet(f"{SAMPLE}/documents.parquet").agg(F.max_by("text", F.length("text"))).first()[0]
    points = language_id.normalised(text.encode())
    whole = models.costs(points)
    monkeypatch.setattr(language_id, "_PIECE", 97)
    assert np.allclose(models.costs(points), whole)


def test_models_are_distributions(spark):
    """The chances of all characters after any context add up to one, the unseen one included."""
    models = language_id.trained(spark.read.parquet(f"{SAMPLE}/documents.parquet"))
    letters = [p for p in range(32, 1000) if models._find(1, language_id.gram_hashes(np.array([p], np.uint32), 1))[1][0]]
    for context in ("the", "xq", "de ", "zzz"):
        start = np.array([ord(c) for c in context], np.uint32)
        total = np.zeros(len(models.languages))
        for p in letters:
            both = np.append(start, np.uint32(p))
            total += np.exp2(-models._costs(both, len(start)))
        unseen = np.exp2(-models._costs(np.append(start, np.uint32(0x4E00)), len(start)))
        assert np.allclose(total + unseen, 1, atol=1e-3)


def test_no_training_data(spark):
    assert language_id.trained(empty(spark)) is None
    rows = language_id.identified(documents(spark).limit(3), None).collect()
    assert len(rows) == 3 and all(r.lang_pred == "und" and r.rejected for r in rows)
    assert language_id.identified(empty(spark), None).collect() == []


@pytest.mark.parametrize("per_language", [1, 2, 3])
def test_every_labelled_language_is_learnt(spark, per_language):
    words = {"aa": "kato minu velo", "bb": "drust gweld hroth", "cc": "shiza omolu ipeka"}
    rows = [(k, f"{text} {text}", lang) for lang, text in words.items() for k in range(per_language)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.trained(labelled)
    assert models.languages == ["aa", "bb", "cc"]
    found = language_id.identified(labelled, models).collect()
    assert all(r.lang_pred == r.lang and not r.rejected for r in found)


def plain_bits(texts: list[str], text: str, order: int, alphabet: int) -> float:
    """Interpolated Kneser-Ney by its definition, with counts in dictionaries."""
    counts = [Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1)) for n in range(1, order + 1)]
    tables = []
    for n in range(1, order + 1):
        values = counts[n - 1]
        if n < order:
            before = Counter(gram[1:] for gram in counts[n])
            values = {gram: before.get(gram, 1) for gram in values}
        ones, twos = (sum(v == k for v in values.values()) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        sums, kinds = Counter(), Counter()
        for gram, v in values.items():
            sums[gram[:-1]] += v
            kinds[gram[:-1]] += 1
        tables.append((values, discount, sums, kinds))

    def chance(gram: str) -> float:
        if not gram:
            return 1 / alphabet
        values, discount, sums, kinds = tables[len(gram) - 1]
        context = gram[:-1]
        if context not in sums:
            return chance(gram[1:])
        own = max(values.get(gram, 0) - discount, 0) / sums[context]
        return own + discount * kinds[context] / sums[context] * chance(gram[1:])

    return sum(-log2(chance(text[max(0, i - order + 1) : i + 1])) for i in range(1, len(text)))


def test_costs_are_those_of_kneser_ney_by_its_definition(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").where("lang is not null and length(text) < 1500")
    chosen = docs.orderBy("doc_id").limit(24)
    models = language_id.trained(chosen)
    letters = lambda t: "".join(map(chr, language_id.normalised(t.encode())))
    rows = [(r.lang, letters(r.text)) for r in chosen.collect()]
    alphabet = len({c for _, t in rows for c in t}) + 1
    others = [letters(r.text)[:300] for r in docs.orderBy(F.desc("doc_id")).limit(4).collect()] + [letters("Zyxé 日本 qqq"), letters("a")]
    for text in others:
        got = models.costs(np.array([ord(c) for c in text], np.uint32))
        wanted = [plain_bits([t for l, t in rows if l == lang], text, language_id.ORDER, alphabet) for lang in models.languages]
        assert np.allclose(got, wanted, rtol=1e-4)


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    rows = [(None, "mira tolo pane", "aa"), (1, "mira tolo pane", "aa"), (2, "grund wolt stark", "bb"), (3, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op4_language_id(spark, str(tmp_path)).collect()
    assert len(found) == 4 and all(r.held_out is not None for r in found)


def test_texts_are_predicted_once_whatever_is_asked_of_the_result(spark):
    """A filter on the prediction does not make a second one, in a second worker of the task."""
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    found = language_id.scored(docs, language_id.trained(docs)).select("lang", "made.*").where("lang = lang_pred")
    assert found.select("lang", "bits")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1
    assert found.count() > 0
