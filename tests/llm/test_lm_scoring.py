from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import attention, lm_scoring
from tests.llm import brute
from tests.llm.fixtures import documents, empty, pairs

OUT = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def held(doc):
    return zlib.crc32(str(doc).encode()) % 7 == 2


def left_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 50])
def test_base_against_brute_force(spark, frequent):
    """With few frequent words most are joined."""
    docs = documents(spark, extra=True)
    rows = sorted(tuple(r) for r in lm_scoring.scores(docs, left_out(), documents=50, steps=20, frequent=frequent).select(*OUT, "score").collect())
    wanted = sorted(brute.base_scores(pairs(docs), held))
    assert [r[:5] for r in rows] == [w[:5] for w in wanted]
    assert np.allclose([r[5] for r in rows], [w[5] for w in wanted])
    assert all(np.isfinite(r[6]) and r[6] < 0 for r in rows)


def test_no_documents_and_nothing_to_learn(spark):
    assert lm_scoring.scores(empty(spark), left_out(), steps=1).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = lm_scoring.scores(docs, F.lit(True), steps=1).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert np.isfinite([r.score for r in rows]).all()


@pytest.fixture(scope="module")
def weights():
    random = np.random.default_rng(0)
    counts = np.zeros(lm_scoring.IDS)
    counts[:1500] = random.integers(1, 50, 1500)
    classes = attention.Classes(counts)
    start = attention.initial(classes.counts)
    return classes, {name: w + random.normal(0, 0.05, w.shape).astype(np.float32) for name, w in start.items()}


def test_gradients(weights):
    classes, w = weights
    w = {name: value.astype(np.float64) for name, value in w.items()}
    random = np.random.default_rng(1)
    stream = random.integers(0, attention.CLASSES, (3, attention.WINDOW + 1))
    inputs, targets = stream[:, :-1], np.where(stream[:, 1:] == attention.BEGIN, -1, stream[:, 1:])
    _, sparse = attention.gradients(w, inputs, targets)
    g = {name: np.zeros_like(value) for name, value in w.items()}
    for name, (rows, slope) in sparse.items():
        g[name][rows] = slope
    for name in w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        step = 1e-4
        sides = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += sign * step
            sides.append(attention.gradients(moved, inputs, targets)[0])
        assert (sides[0] - sides[1]) / (2 * step) == pytest.approx(g[name][at], rel=2e-2, abs=1e-6)


def test_scorer_agrees_with_training_and_adds_up_to_one(weights):
    classes, w = weights
    random = np.random.default_rng(2)
    text = np.append(attention.BEGIN, random.integers(0, attention.RARE + 1, attention.WINDOW))
    scorer = attention.Scorer(w)
    chances = scorer.log_chances(np.concatenate([text, [attention.BEGIN], text[:6]]), np.array([0, len(text), len(text) + 7]))
    loss, _ = attention.gradients(w, text[None, :-1], text[None, 1:])
    assert -chances[: attention.WINDOW].mean() == pytest.approx(loss, rel=1e-3)
    # What follows does not matter, nor which documents come before.
    again = scorer.log_chances(np.append(attention.BEGIN, text[:6]), np.array([0, 7]))
    assert np.allclose(chances[attention.WINDOW :], again, atol=1e-5)
    total = 0.0
    for last in range(attention.RARE + 1):
        total += np.exp(scorer.log_chances(np.array([*text[:5], last]), np.array([0, 6]))[-1])
    assert total == pytest.approx(1, abs=1e-3)
    rare = classes.of == attention.RARE
    assert np.exp(classes.log_share[rare]).sum() == pytest.approx(1, abs=1e-6)


def test_long_documents_use_every_block_once(weights):
    _, w = weights
    random = np.random.default_rng(3)
    sizes = [1, 2, 16, 17, 18, 33, 100]
    parts = [np.append(attention.BEGIN, random.integers(0, attention.RARE, n)) for n in sizes]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    scorer = attention.Scorer(w)
    together = scorer.log_chances(np.concatenate(parts), bounds)
    alone = [scorer.log_chances(p, np.array([0, len(p)])) for p in parts]
    assert np.allclose(together, np.concatenate(alone), atol=1e-4)


def test_training_lowers_the_loss():
    random = np.random.default_rng(4)
    stream = np.tile(random.integers(0, 200, 40), 200)
    counts = np.bincount(stream, minlength=attention.CLASSES) + 1.0
    start = attention.initial(counts)
    made = attention.train(start, stream, 150, 1e-2, seed=1)
    inputs, targets = stream[None, : attention.WINDOW], stream[None, 1 : attention.WINDOW + 1]
    assert attention.gradients(made, inputs, targets)[0] < 0.5 * attention.gradients(start, inputs, targets)[0]


def test_every_id_of_the_corpus_is_a_class_of_its_own():
    counts = np.zeros(lm_scoring.IDS)
    counts[::10] = np.arange(1, len(counts[::10]) + 1)
    classes = attention.Classes(counts)
    occurring = classes.of[counts > 0]
    assert len(np.unique(occurring)) == len(occurring) and not (occurring == attention.RARE).any()
    assert (classes.log_share[counts > 0] == 0).all() and (classes.of[counts == 0] == attention.RARE).all()
    # All ids of the tokenizer have room.
    assert len(np.unique(attention.Classes(np.ones(lm_scoring.IDS)).of)) == lm_scoring.IDS


def test_infrequent_ids_are_learnt_from_and_predicted_by_context():
    """Ids beyond the frequent ones, of equal counts, in a fixed order: each tells the next."""
    counts = np.zeros(lm_scoring.IDS)
    counts[:1600] = np.where(np.arange(1600) < 1500, 1000, 10)
    classes = attention.Classes(counts)
    stream = np.tile(classes.of[1500:1600], 60)
    start = attention.initial(classes.counts)
    made = attention.train(start, stream, 200, 1e-2, seed=1)
    text, bounds = stream[:101], np.array([0, 101])
    before, after = (attention.Scorer(w).log_chances(text, bounds).mean() for w in (start, made))
    assert after > -1 and before < -4


def test_every_training_document_is_learnt_from(spark):
    """However few documents a task takes, each document is in one round."""
    pick = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(pick.choice(vocabulary, 60))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    paths = lm_scoring.default_paths()
    coded = lm_scoring.encoded(docs, left_out(), paths, 50 / 340)
    assert coded.count() == 400 and coded.where("held_out").select("round").distinct().collect() == [(-1,)]
    by_id = np.zeros(lm_scoring.IDS)
    for row in lm_scoring.counted(coded.where("round >= 0")).where("kind = 1").collect():
        by_id[row.key] += row.n
    classes = attention.Classes(by_id)
    seen = []
    whole = lm_scoring.learnt

    def spied(part, *rest):
        seen.append([bytes(r.ids) for r in part.select("ids").collect()])
        return whole(part, *rest)

    lm_scoring.learnt = spied
    try:
        made = lm_scoring.trained(coded, classes, 340, 50, 5)
    finally:
        lm_scoring.learnt = whole
    assert len(seen) == 1 + lm_scoring.ROUNDS and all(seen)
    encode = lm_scoring.encoder(*paths).encode
    wanted = [encode([text.encode()])[0].astype(np.uint16).tobytes() for doc, text in rows if not held(doc)]
    assert sorted(ids for part in seen for ids in part) == sorted(wanted)
    start = attention.initial(classes.counts)
    assert all(np.isfinite(w).all() for w in made.values())
    used = np.unique(np.append(classes.of[by_id > 0], attention.BEGIN))
    used = used[used != classes.of[lm_scoring.END]]  # the end precedes nothing
    assert (made["embed"][used] != start["embed"][used]).any(axis=1).all()


def test_steps_grow_with_the_tokens_and_moves_are_averaged_by_use(spark):
    counts = np.zeros(lm_scoring.IDS)
    counts[:2000] = 5
    start = attention.initial(attention.Classes(counts).counts)
    one, two = attention.Adam(start), attention.Adam(start)
    inputs, targets = attention.windows(np.append(attention.BEGIN, np.arange(1, 200)))
    assert np.array_equal(np.sort(targets[targets >= 0]), np.arange(1, 200))
    one.over(inputs, targets, lambda step: 0.01, np.random.default_rng(0), 2)
    other = attention.windows(np.append(attention.BEGIN, np.arange(1000, 1100)))
    two.over(*other, lambda step: 0.01, np.random.default_rng(0), 2)
    assert (one.steps, two.steps) == (4, 2)
    both = attention.moved(start, one.moves(start) + two.moves(start))
    # Rows that one task used are not thinned by the other; shared ones are a mean.
    assert np.allclose(both["embed"][1:190], one.w["embed"][1:190], atol=1e-6)
    assert np.allclose(both["embed"][1000:1090], two.w["embed"][1000:1090], atol=1e-6)
    assert np.allclose(both["query"], (4 * one.w["query"] + 2 * two.w["query"]) / 6, atol=1e-6)


def test_steps_are_numbers_of_16_bits():
    """Such are put in order by their digits, as are classes as inputs."""
    target = np.arange(attention.CLASSES)
    step = attention._steps_of(target)
    assert step.dtype == np.uint16 and attention.CLASSES <= 1 << 16
    first, common = attention.HEAD + attention.GROUPS, attention.COMMON
    assert np.array_equal(np.minimum(step, first), attention.top_of(target))
    assert np.array_equal(step[common:], first + (target[common:] - common) // attention.TAILS)


def test_places_go_through_the_layers_in_parts(weights, monkeypatch):
    """No layer sees more than ``_PLACES`` places at once; their number changes no derivative and no score."""
    _, w = weights
    random = np.random.default_rng(6)
    stream = random.integers(0, attention.RARE, 40 * attention.WINDOW)
    stream[:: attention.WINDOW + 5] = attention.BEGIN
    inputs, targets = attention.windows(stream)
    bounds = np.array([0, 1, 18, 700, len(stream)])
    forward, ends, sizes = attention._forward, attention.Scorer._ends, []

    def spied_forward(w, fading, inputs):
        sizes.append(inputs.size)
        return forward(w, fading, inputs)

    def spied_ends(self, inputs, alone):
        sizes.append(len(alone) * attention.STRIDE)
        return ends(self, inputs, alone)

    monkeypatch.setattr(attention, "_forward", spied_forward)
    monkeypatch.setattr(attention.Scorer, "_ends", spied_ends)
    found = []
    for places in (attention.WINDOW, 512, 1 << 20):
        monkeypatch.setattr(attention, "_PLACES", places)
        sizes.clear()
        found.append((*attention.gradients(w, inputs, targets), attention.Scorer(w).log_chances(stream, bounds)))
        assert max(sizes) <= places and sum(sizes) >= 2 * len(stream) - attention.WINDOW
    loss, slopes, chances = found[-1]
    for other, others, again in found[:-1]:
        assert other == pytest.approx(loss, rel=1e-5)
        assert np.allclose(again, chances, atol=1e-5)
        for name, (rows, slope) in slopes.items():
            assert rows is others[name][0] or np.array_equal(rows, others[name][0])
            assert np.allclose(others[name][1], slope, rtol=1e-3, atol=1e-6 + 1e-4 * np.abs(slope).max())


def test_batch_without_targets_moves_nothing(weights):
    _, w = weights
    inputs = np.full((2, attention.WINDOW), attention.BEGIN)
    loss, g = attention.gradients(w, inputs, np.full_like(inputs, -1))
    assert loss == 0 and all(not slope.any() for _, slope in g.values())
