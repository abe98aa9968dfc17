"""Benchmark decontamination by winnowing.

A window is ``size`` consecutive words of an item; an item with fewer words is one window. Of
every ``size - k + 1`` consecutive k-grams of words the one with the smallest hash is kept as a
fingerprint. Any shared run of ``size`` words has the same k-grams in both texts, so both keep
the same one: no shared window is missed. Short items are found in the same way, with windows of
their own length. Fingerprints of documents and items are joined and every hit is extended word
by word, in the texts, to the longest common run around it.

Before the join a bitmap of fixed size, made of the fingerprints of all items, drops document
fingerprints that no item has. A larger benchmark fills it up, which costs time only.

Null text and a text without words have no words and no hits. Repeated rows and rows with equal
or null ``doc_id`` are documents of their own. Two items with one id count once; an item without
id marks words but is not listed. Empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.hashing import NOT_ALNUM, U64, Words, binary, chunks, mix, window_minima
from tallyline.sources.scratch import stored

WINDOW = 10
GRAM = 4
BITMAP_LOG = 22

_ANCHOR = pa.struct(
    [("print", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("context", pa.binary())]
)
_MARKED = pa.schema(
    [
        ("row", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()),
        ("anchors", pa.list_(_ANCHOR)),
    ]
)
_MARKED_DDL = (
    "row long, key long, n_words long, "
    "anchors array<struct<print: long, place: long, first: long, context: binary>>"
)


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Per document: words, words in an occurrence of a window, spans of those words, and items."""
    spark = docs.sparkSession
    items = stored(
        marked(benchmark.select("item_id", "text"), [*range(1, size + 1)], size, gram, None, True),
        "benchmark-prints",
    )
    sizes = [
        r[0] for r in items.select(F.least("n_words", F.lit(size)).cast("int").alias("n"))
        .where("n > 0").distinct().collect()
    ]
    prints = items.select("row", "key", F.explode("anchors").alias("a"))
    slots = prints.select(F.expr(f"a.print & {(1 << BITMAP_LOG) - 1}").cast("int").alias("slot"))
    bitmap = np.zeros(1 << BITMAP_LOG, np.uint8)
    bitmap[slots.distinct().toArrow().column(0).to_numpy()] = 1
    shared = spark.sparkContext.broadcast(np.packbits(bitmap))

    found = stored(
        marked(docs.select("doc_id", "text"), sorted(sizes), size, gram, shared, False), "document-prints"
    )
    pairs = (
        found.select(F.col("row").alias("doc"), F.explode("anchors").alias("d"))
        .select("doc", F.col("d.print").alias("print"), "d.place", "d.first", "d.context")
        .join(
            prints.select(
                F.col("a.print").alias("print"),
                F.col("key").alias("item_id"),
                F.col("a.place").alias("item_place"),
                F.col("a.context").alias("item_words"),
            ),
            "print",
        )
    )
    hits = pairs.mapInArrow(_extend(size, gram), "doc long, item_id long, lo long, hi long")
    per_doc = hits.groupBy("doc").agg(
        F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("hits"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    return (
        found.select(F.col("row").alias("doc"), F.col("key").alias("doc_id"), "n_words")
        .join(per_doc, "doc", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(_length("hits"), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("hits", F.expr("array()").cast("array<struct<lo: bigint, hi: bigint>>")).alias("hits"),
            F.coalesce("items", F.expr("array()").cast("array<string>")).alias("items"),
        )
    )


def _length(spans: str) -> Column:
    """Words in a union of spans that are ordered by their starts."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda seen, span: F.struct(
            (seen.n + F.greatest(F.lit(0).cast("long"), span.hi - F.greatest(seen.end, span.lo))).alias("n"),
            F.greatest(seen.end, span.hi).alias("end"),
        ),
    ).n


def fingerprints(words: Words, texts: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and values of the fingerprints for windows of ``length`` words."""
    k = min(gram, length)
    first, hashes = words.grams(k)
    text = np.searchsorted(words.bounds, first, side="right") - 1
    kept = window_minima(hashes, length - k + 1)
    # A window of grams counts where it lies in one text.
    kept = kept[text[: len(kept)] == text[length - k :]] if len(kept) else kept
    kept = np.unique(kept)
    return first[kept], mix(hashes[kept] + U64(length))


def marked(rows: DataFrame, lengths: list[int], size: int, gram: int, bitmap, whole: bool) -> DataFrame:
    """Number of words, and fingerprints with the words around them. ``whole``: the context is the
    whole text, and only the windows of the text's own length are taken."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        wanted = None if bitmap is None else np.unpackbits(bitmap.value)
        for batch in batches:
            keys, texts = batch.column(0).cast(pa.int64()).to_pylist(), binary(batch.column(1))
            for first, part in chunks(texts):
                words = Words(part, NOT_ALNUM, lower=True)
                counts = np.diff(words.bounds)
                anchors: list[list] = [[] for _ in part]
                for length in lengths:
                    at, prints = fingerprints(words, len(part), length, gram)
                    if wanted is not None:
                        near = wanted[(prints & U64((1 << BITMAP_LOG) - 1)).astype(np.int64)] > 0
                        at, prints = at[near], prints[near]
                    text = np.searchsorted(words.bounds, at, side="right") - 1
                    if whole:
                        own = np.minimum(counts[text], size) == length
                        at, prints, text = at[own], prints[own], text[own]
                    reach = length - min(gram, length)
                    for a, p, d in zip(at.tolist(), prints.astype(np.int64).tolist(), text.tolist()):
                        begin, end = int(words.bounds[d]), int(words.bounds[d + 1])
                        lo = begin if whole else max(begin, a - reach)
                        hi = end if whole else min(end, a + min(gram, length) + reach)
                        context = b" ".join(
                            words.data[s:e].tobytes()
                            for s, e in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist())
                        )
                        anchors[d].append(
                            {"print": p, "place": a - begin, "first": lo - begin, "context": context}
                        )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(number, number + len(part)), pa.int64()),
                        pa.array(keys[first : first + len(part)], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(anchors, pa.list_(_ANCHOR)),
                    ],
                    schema=_MARKED,
                )
                number += len(part)

    return rows.mapInArrow(mark, _MARKED_DDL)


def _extend(size: int, gram: int):
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "item_id", "lo", "hi")])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out: list[tuple] = []
            columns = (rows[n] for n in ("doc", "item_id", "place", "first", "context", "item_place", "item_words"))
            for doc, item, place, first, context, at, text in zip(*columns):
                span = common_run(context.split(b" "), place - first, text.split(b" "), at, size, gram)
                if span:
                    out.append((doc, item, first + span[0], first + span[1]))
            arrays = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return extend


def common_run(
    mine: list[bytes], a: int, item: list[bytes], b: int, size: int, gram: int
) -> tuple[int, int] | None:
    """The common run around places a and b, in ``mine``, if it holds a whole window."""
    length = min(size, len(item))
    k = min(gram, length)
    if mine[a : a + k] != item[b : b + k]:
        return None
    left = 0
    while left < min(a, b, length - k) and mine[a - left - 1] == item[b - left - 1]:
        left += 1
    right, most = 0, min(len(mine) - a, len(item) - b) - k
    while right < min(most, length - k) and mine[a + k + right] == item[b + k + right]:
        right += 1
    return (a - left, a + k + right) if left + k + right >= length else None
