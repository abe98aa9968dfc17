"""Removal of every word covered by a phrase of ``length`` words that occurs twice anywhere.

Words are runs of other characters than ASCII white space, taken as they are. Candidate fragments
come from :mod:`tallyline.llm.repeats`. In each shard of them the phrases that recur by their hash
are compiled, word by word, into an Aho-Corasick automaton, and the fragments of all documents
dealt to the shard are streamed through it: it finds every occurrence by the words themselves,
and a phrase with two or more of them is confirmed. A document's window lies in one shard only,
so all documents together pass through the automata once, however many automata there are.

Null text has no words. Rows that are equal in id and text count as two places, and both lose
their words. Kept words are joined by one space. An empty table gives an empty result; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tallyline.llm.hashing import WHITE, Words, covered, prefix_sums, run_hashes
from tallyline.llm.repeats import Units, repeated, replaced

LENGTH = 35
GRAM = 8
SHARD_WORDS = 1 << 16


def prepare(texts: list[bytes]) -> Units:
    found = Words(texts, WHITE, lower=False)
    return Units(prefix_sums(found.hashes), found.bounds[:-1], found.bounds[1:])


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """Phrases as their words joined by one space."""
    parts = text.split()
    return [b" ".join(parts[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]


def search(length: int):
    def found(fragments: list[bytes]) -> Iterator[tuple[int, int, int]]:
        import ahocorasick

        numbers: dict[bytes, int] = {}
        texts = [
            tuple(numbers.setdefault(word, len(numbers)) for word in fragment.split())
            for fragment in fragments
        ]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        phrases = recurring(texts, length)
        for number, (text, at) in enumerate(phrases):
            automaton.add_word(texts[text][at : at + length], number)
        if not len(automaton):
            return
        automaton.make_automaton()
        places: list[list[tuple[int, int]]] = [[] for _ in phrases]
        for text, sequence in enumerate(texts):
            for end, number in automaton.iter(sequence):
                places[number].append((text, end - length + 1))
        confirmed = np.array([p for ps in places if len(ps) > 1 for p in ps], np.int64).reshape(-1, 2)
        confirmed = confirmed[np.lexsort((confirmed[:, 1], confirmed[:, 0]))]
        joined = np.diff(confirmed, axis=0)
        new = np.flatnonzero(np.append(True, (joined[:, 0] != 0) | (joined[:, 1] != 1)))[: len(confirmed)]
        last = np.append(new[1:], len(confirmed)) - 1
        for a, b in zip(new.tolist(), last.tolist()):
            yield int(confirmed[a, 0]), int(confirmed[a, 1]), int(confirmed[b, 1])

    return found


def recurring(texts: list[tuple], length: int) -> list[tuple[int, int]]:
    """One place, as text and first word, of each phrase whose hash occurs twice."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    units = np.concatenate([np.array(t, np.uint64) for t in texts]) + np.uint64(1)
    sums = prefix_sums(units * np.uint64(0xD1B54A32D192ED03))
    counts = np.maximum(sizes - (length - 1), 0)
    text = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = start + (ends - sizes)[text]
    _, first, times = np.unique(run_hashes(sums, at, at + length), return_index=True, return_counts=True)
    first = first[times > 1]
    return list(zip(text[first].tolist(), start[first].tolist()))


def deduplicate(docs: DataFrame, length: int = LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_words`` and ``n_removed``; columns that have one of these
    names are replaced."""
    gram = max(1, min(GRAM, length // 4))
    found = repeated(docs, prepare, cut, search(length), length, gram, shard_words)
    return replaced(docs, found, take_out, "kept binary, n_words long, n_removed long")


def take_out(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """The other words joined by one space, the number of words, and of those taken out."""
    parts = text.split()
    if not len(lo):
        return b" ".join(parts), len(parts), 0
    gone = covered(lo, hi, len(parts))
    kept = [word for word, out in zip(parts, gone.tolist()) if not out]
    return b" ".join(kept), len(parts), len(parts) - len(kept)
