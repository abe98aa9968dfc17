from __future__ import annotations

import random

import pytest

from tallyline.llm.components import components
from tallyline.llm.near_dedup import linked, near_copies, shingle_sets
from tests.llm import brute
from tests.llm.fixtures import documents, empty, pairs, rows_of

OUT = ("doc_id", "n_shingles", "component_id", "kept")


def variants():
    """A base text and edits of growing strength, so that links chain and miss the base."""
    pick = random.Random(5)
    base = [f"w{pick.randrange(500)}" for _ in range(120)]
    out = []
    for k in range(120):
        words = list(base)
        for _ in range(k // 12):
            words[pick.randrange(len(words))] = f"e{pick.randrange(500)}"
        out.append((5000 + (k * 37) % 120, " ".join(words)))
    return out


def test_against_brute_force(spark):
    docs = documents(spark, extra=True)
    more = spark.createDataFrame(variants(), "doc_id long, text string")
    docs = docs.select("doc_id", "text", "node", "kept").unionByName(more, allowMissingColumns=True)
    wanted = sorted(brute.near_dedup(pairs(docs)))
    assert rows_of(near_copies(docs), *OUT) == wanted
    assert len({row[2] for row in wanted if row[0] >= 5000}) > 3
    # Blocks of a few nodes: the same links.
    assert rows_of(near_copies(more, block=4), *OUT) == sorted(brute.near_dedup(pairs(more)))


def test_rows_without_id_and_repeated_rows(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (7, text), (9, None)], "doc_id long, text string")
    assert rows_of(near_copies(docs), *OUT) == [
        (None, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (7, 3, 3, False), (9, 0, 9, True)
    ]
    assert near_copies(empty(spark)).collect() == []
    # One id with two texts, each of which has a copy: whichever stands for it, it is one document.
    rows = [(1, "other words " + text), (5, text), (5, "a b c d e f g h i j k l"), (8, text), (9, "a b c d e f g h i j k l")]
    found = near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({r.component_id for r in found.where("doc_id = 5").collect()}) == 1
    assert rows_of(found, *OUT) == rows_of(near_copies(spark.createDataFrame(rows[::-1], "doc_id long, text string")), *OUT)


@pytest.mark.parametrize("seed", range(3))
def test_no_link_of_an_id_with_several_texts_is_lost(spark, seed):
    """Whichever digest is the smaller: each text of an id links, and joins what its other texts link."""
    pick = random.Random(seed)
    one, two, three = (" ".join(f"w{pick.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    rows = [(5, one), (5, two), (8, two), (9, two + " more"), (4, one + " end"), (7, three), (6, three), (7, one + " tail")]
    rows += [(20 + k, f"{k} {pick.random()} lone text") for k in range(5)] + [(20, "lone text twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for r in near_copies(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.component_id)
    assert found == {d: {4} for d in (4, 5, 6, 7, 8, 9)} | {20 + k: {20 + k} for k in range(5)}


def test_threshold_counts_a_tie():
    one, two = shingle_sets([b"a b c d e f g h", b"a b c d e f g h i"], 5)
    assert linked(one, two, 80) and not linked(one, two, 81)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {n: n for e in edges for n in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked_nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert {n: found.get(n, n) for n in linked_nodes} == {n: root[n] for n in linked_nodes}
