from __future__ import annotations

from collections import Counter
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm import lexical_search
from tallyline.llm.lexical_search import Block, ranked
from tallyline.llm.queries import op12_lexical_search
from tallyline.llm.statements import STATEMENTS
from tests.compare import difference, duck
from tests.conftest import SAMPLE
from tests.llm import brute
from tests.llm.fixtures import documents, empty, pairs


def plain(docs, items, top=20):
    """docs, items: (id, text); returns (item id, rank, doc id, score), ordered."""
    counted = [(d, Counter(brute.ALNUM.findall((t or "").translate(brute.LOWER)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = Counter(brute.ALNUM.findall((text or "").translate(brute.LOWER)))
        scores = []
        for doc, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(
                r * floor(1000 * log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, r in asked.items() if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, k, s[2], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [
    (1, "shared3 shared4"), (2, "ONE one two"), (3, None), (4, "..."), (5, " ".join(f"shared{k}" for k in range(60))),
    (6, "two  words words"), (6, "Two words"), (None, "three one"), (7, "not-there at all"), (8, "日本語の文章です"), (9, "word " * 50),
]


def test_against_plain_version(spark):
    docs = documents(spark, extra=True)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = plain(pairs(docs), ITEMS)
    assert rows_of(ranked(docs, items)) == wanted
    assert rows_of(ranked(docs, items, group_terms=20)) == wanted


def test_ties_and_repeated_rows_and_missing_ids(spark):
    rows = [(i, "same words here") for i in range(60, 0, -1)] + [(None, "same words here"), (3, "same words here"), (4, "more same words")]
    rows += [(100 + i, "filler of other kinds") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "same words"), (2, "more"), (3, "here same here")]
    found = ranked(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found) == plain(rows, items)


def test_small_blocks_close_early_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 3000)
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet").repartition(3)
    items = spark.read.parquet(f"{SAMPLE}/benchmark.parquet")
    assert rows_of(ranked(docs, items, top=3)) == plain(pairs(docs), pairs(items, "item_id", "text"), 3)


@given(
    st.lists(st.lists(st.integers(0, 6), max_size=12), min_size=1, max_size=30),
    st.lists(st.integers(0, 6), min_size=1, max_size=9), st.integers(1, 4), st.integers(-1, 3_000_000),
)
@settings(max_examples=200, deadline=None)
def test_block_scores_of_the_best_are_exact(texts, item, top, bar):
    counts = [Counter(t) for t in texts]
    terms = sorted({t for c in counts for t in c})
    places = [[d for d, c in enumerate(counts) if t in c] for t in terms]
    row = {
        "sizes": np.array([len(t) for t in texts]), "terms": np.array(terms, np.int32), "counts": np.array([len(p) for p in places], np.int64),
        "places": np.array([d for p in places for d in p], np.int32),
        "times": np.array([counts[d][t] for t, p in zip(terms, places) for d in p], np.int32),
    }
    n_docs, n_terms = sum(bool(t) for t in texts), sum(map(len, texts))
    weights = {t: w for t, w in zip(range(7), (0, 1, 900, 30, 2500, 700, 3))}
    asked = Counter(item)
    order = sorted(asked, key=lambda t: sum(t in c for c in counts))
    got = Block(row, n_docs, n_terms).scores(order, [asked[t] * weights[t] for t in order], top, bar)
    exact = []
    for c in counts:
        m = 75 + 25 * sum(c.values()) * n_docs // max(1, n_terms)
        exact.append(sum(asked[t] * weights[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c))
    least = sorted(exact, reverse=True)[top - 1] if len(exact) >= top else 0
    for mine, true in zip(got.tolist(), exact):
        assert mine <= true
        if true >= max(least, bar):
            assert mine == true


def test_query_against_sql(spark):
    assert difference(op12_lexical_search(spark, SAMPLE), duck(SAMPLE), STATEMENTS["op12_lexical_search"]) is None


@pytest.mark.parametrize("none", ["docs", "items"])
def test_empty_tables(spark, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = ranked(empty(spark) if none == "docs" else documents(spark), items.limit(0) if none == "items" else items)
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
