from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyline.llm.hashing import NOT_ALNUM, WHITE, Words, chunks, covered, window_minima
from tallyline.llm.memory import text_batches, tidy
from tallyline.llm.subwords import default_paths, encoder
from tests.llm import brute

TEXT = st.text(st.sampled_from("aAbZ09é日 \t\n\x0b\x1c .,'|-"), max_size=40)


@given(st.lists(TEXT, min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_patterns(texts):
    data = [t.encode() for t in texts]
    for separators, pattern in ((WHITE, brute.DARK), (NOT_ALNUM, brute.ALNUM)):
        found = Words(data, separators, lower=True)
        seen: dict[bytes, int] = {}
        for d, text in enumerate(texts):
            wanted = [w.encode() for w in pattern.findall(text.translate(brute.LOWER))]
            span = range(found.bounds[d], found.bounds[d + 1])
            assert [found.data[found.starts[i] : found.ends[i]].tobytes() for i in span] == wanted
            for i, word in zip(span, wanted):
                assert seen.setdefault(word, int(found.hashes[i])) == int(found.hashes[i])
        assert len(set(seen.values())) == len(seen)


def test_equal_runs_of_words_have_equal_hashes_wherever_they_are():
    found = Words([b"a b c x", b"", b"zz a b c", b"a b"], WHITE, lower=False)
    first, hashes = found.grams(3)
    assert first.tolist() == [0, 1, 4, 5]
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 3


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 20))
@settings(deadline=None)
def test_window_minima_take_the_rightmost(values, width):
    array = np.array(values, np.uint64) << np.uint64(30)
    got = window_minima(array, width).tolist()
    wanted = []
    for i in range(len(values) - width + 1):
        window = values[i : i + width]
        wanted.append(i + max(k for k, v in enumerate(window) if v == min(window)))
    assert got == wanted


def test_chunks_and_coverage():
    assert list(chunks([b"aa", b"b", b"cc"], 4)) == [(0, [b"aa", b"b"]), (2, [b"cc"])]
    assert covered(np.array([0, 3]), np.array([2, 5]), 6).tolist() == [True, True, False, True, True, False]


@given(st.lists(st.text(st.sampled_from("ab sdtlvrmeS0 9'\n\t.,é×日 "), max_size=30), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_tokenizer(texts):
    encode = encoder(*default_paths())
    ids, bounds = encode.encode([t.encode() for t in texts])
    wanted = [encode.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == wanted


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b", "x" * 3000, "", "it's 's 'll we'd", "  \n\n x "])
def test_ids_of_odd_texts(text):
    encode = encoder(*default_paths())
    assert encode.encode([text.encode()])[0].tolist() == encode.whole.encode(text, add_special_tokens=False).ids


def test_batches_of_texts_are_small_inside_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), text_batches(spark, 7):
        sizes = spark.range(50, numPartitions=1).mapInArrow(lambda rows: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in rows), "n long")
        assert max(r.n for r in sizes.collect()) == 7
        raise ValueError
    assert spark.conf.get(key) == before


def test_tidy_gives_all_results_and_forgets():
    forgotten = []
    assert list(tidy(iter(range(5)), lambda: forgotten.append(1))) == list(range(5)) and forgotten == [1]
