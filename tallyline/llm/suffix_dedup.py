"""Removal of every byte covered by a string of ``length`` bytes that occurs twice anywhere.

Candidate fragments come from :mod:`tallyline.llm.repeats`. Each shard of them is joined into one
text, whose Burrows-Wheeler transform is built by sorting suffixes to a bounded depth. Common
prefixes of neighbouring suffixes then come out by increasing value: starting from the interval
of the empty string, all intervals of strings of k bytes are extended backwards by every byte that
occurs before them, and the right border of a new interval is a place whose common prefix is k.
After ``length`` rounds the places left without a value are those with ``length`` bytes or more in
common, which is all that is asked. Intervals whose border has a value already are given up, so
the work of all rounds together is bounded by the borders, not by rounds times text.

Null text counts as empty; texts under ``length`` bytes cannot lose anything unless covered, so
they stay. Rows that are equal in id and text count as two places, and both lose their bytes.
Kept bytes may begin or end inside a character; ``text`` leaves out such incomplete characters.
An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.hashing import byte_sums, covered, spans
from tallyline.llm.repeats import Units, repeated, replaced

LENGTH = 200
GRAM = 48
SHARD_BYTES = 1 << 20
_STOP = 0xFF  # in no UTF-8 text


def prepare(texts: list[bytes]) -> Units:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    return Units(byte_sums(np.frombuffer(b"".join(texts), np.uint8)), ends - sizes, ends)


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in zip(lo.tolist(), hi.tolist())]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of the text in the order of their first ``depth`` bytes (8 at least)."""
    n = len(text)
    around = np.concatenate([text, np.resize(text, 8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | around[k : k + n]
    order, known = np.argsort(key), 8
    while True:
        ordered = key[order]
        step = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        del ordered
        if known >= depth or step.sum() == n - 1:
            return order
        rank = np.empty(n, np.uint32)
        rank[order] = np.cumsum(step, dtype=np.uint32)
        shift = min(known, depth - known)
        np.copyto(key, rank)
        key <<= np.uint64(32)
        key |= np.roll(rank, -shift)
        del order, rank
        order, known = np.argsort(key), known + shift


def bounded_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of every suffix in the order with the one before it, if under ``length``; else
    -1. The first has none (0)."""
    n = len(text)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable")
    back = np.empty(n, np.int32)  # place of the suffix that begins one byte earlier
    back[by_byte] = np.arange(n, dtype=np.int32)
    del before, by_byte
    common = np.full(n + 1, -1, np.int32)
    common[0] = common[n] = 0
    lo, hi = np.zeros(1, np.int64), np.full(1, n - 1)
    for k in range(length):
        sizes = hi - lo + 1
        owner = np.repeat(np.arange(len(lo), dtype=np.int32), sizes)
        extended = back[spans(lo, sizes)]
        if len(extended) * 8 > n:
            owner_at = np.full(n, -1, np.int32)
            owner_at[extended] = owner
            extended = np.flatnonzero(owner_at >= 0)
            owner = owner_at[extended]
        else:
            sort = np.argsort(extended)
            extended, owner = extended[sort], owner[sort]
        # Places of one interval after one byte are neighbours; a new interval or byte begins where
        # the owner or the byte changes.
        byte = text[order[extended]]
        edge = np.flatnonzero((owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])) + 1
        first = np.concatenate([[0], edge])
        last = np.append(edge, len(extended)) - 1
        new_lo, new_hi = extended[first], extended[last]
        new = common[new_hi + 1] < 0
        lo, hi = new_lo[new], new_hi[new]
        common[hi + 1] = k
        if not len(lo):
            break
    return common[:n]


def search(length: int):
    def found(fragments: list[bytes]) -> Iterator[tuple[int, int, int]]:
        text = np.frombuffer(b"\xff".join(fragments) + b"\xff", np.uint8)
        order = suffix_order(text, length)
        same = bounded_prefixes(text, order, length) < 0
        again = np.zeros(len(text), bool)
        again[order[same]] = True
        again[order[np.flatnonzero(same) - 1]] = True
        begin = 0
        for number, fragment in enumerate(fragments):
            windows = again[begin : begin + len(fragment) - length + 1].astype(np.int8)
            steps = np.flatnonzero(np.diff(np.concatenate([[0], windows, [0]])))
            for a, b in zip(steps[0::2].tolist(), steps[1::2].tolist()):
                yield number, a, b - 1
            begin += len(fragment) + 1

    return found


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The spans of bytes to remove from every document that has any."""
    gram = max(1, min(GRAM, length // 4))
    return repeated(docs, prepare, cut, search(length), length, gram, shard_bytes)


def deduplicate(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``; columns that have
    one of these names are replaced."""
    found = repeated_spans(docs, length, shard_bytes)
    return replaced(docs, found, take_out, "kept binary, n_bytes long, n_removed long, n_spans long")


def cut_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``cut`` and ``n_removed``: what is left of texts that lose any of the spans found,
    without characters of which a part was taken out; null for all others."""
    return replaced(docs, found, text_left, "cut string, n_removed long")


def take_out(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int, int]:
    """The text without the spans, its length, and the number of bytes and of runs taken out."""
    if not len(lo):
        return text, len(text), 0, 0
    gone = covered(lo, hi, len(text))
    runs = np.count_nonzero(np.diff(gone, prepend=False, append=False)) // 2
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, len(text), int(gone.sum()), runs


def text_left(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[str | None, int]:
    kept, _, n_removed, _ = take_out(text, lo, hi)
    return (valid(kept) if n_removed else None), n_removed


def valid(kept: bytes) -> str:
    return kept.decode("utf-8", "ignore")


def valid_text(kept: str) -> Column:
    """Bytes as text, without characters of which a part was taken out."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([valid(x) for x in column.to_pylist()], pa.string())

    return decode(kept)
