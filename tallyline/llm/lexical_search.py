"""Ranked lexical search, term at a time with a limited number of accumulators.

Documents are indexed where they lie: a row of the index holds the postings of one block of texts,
for the terms that the items ask for. From all blocks come the number of documents with terms, the
number of terms and, per term, the number of documents that hold it. Each task then scores its
blocks one after the other. An item's terms are taken rarest first; every posting of a term opens
an accumulator for its document or adds to it, until the terms that are left could not lift a
document without one to the k-th best score known so far. From then on no accumulator is opened
and those open are still updated to the end, so their scores are exact. What is known so far is the
k-th best partial score in this block, or the k-th best score of the task's earlier blocks. Bounds
compare strictly: a document that could only tie still gets its accumulator.

A task returns k documents per item at most, which meet in two steps: by item and part of the
documents, then by item. Nothing else is shuffled but counts per term.

The items' terms go to all tasks in groups of at most ``GROUP_TERMS`` (one item at least); each
group has its own index and pass. 64-bit hashes stand for terms.

Null text has no terms, and such a document or item meets nothing. Rows with equal or null ids are
documents, or items, of their own; equal scores are ranked by ascending ``doc_id``, null last.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.hashing import NOT_ALNUM, Words, binary, chunks
from tallyline.sources.scratch import stored

TOP = 20
GROUP_TERMS = 1 << 18
BLOCK_BYTES = 1 << 20
PARTS = 64
_LAST = np.iinfo(np.int64).max

_BLOCK = pa.schema(
    [
        ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
    ]
)
_BLOCK_DDL = (
    "ids array<long>, sizes array<long>, terms array<int>, counts array<long>, places array<int>, times array<int>"
)
_FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, group_terms: int = GROUP_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the best documents (``doc_id``, ``text``) for every item
    (``item_id``, ``text``)."""
    named = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    wanted = stored(named.select("item", "text").mapInArrow(_item_terms, "item long, term long, repeats long"), "item-terms")
    groups = max(1, -(-wanted.count() // group_terms))
    found = []
    for group in range(groups):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group) if groups > 1 else wanted
        found.append(stored(_search(docs.select("doc_id", "text"), own, top), "found"))
    best = reduce(DataFrame.unionByName, found)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    by_part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*order)
    by_item = Window.partitionBy("item").orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(by_part)).where(F.col("rank") <= top).drop("rank")
    best = best.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column(0).to_pylist()
        for first, texts in chunks(binary(batch.column(1))):
            words = Words(texts, NOT_ALNUM, lower=True)
            at, terms, repeats = _counted(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(items[first : first + len(texts)], np.int64)[at]),
                    pa.array(terms.view(np.int64)), pa.array(repeats),
                ],
                names=["item", "term", "repeats"],
            )


def _counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and number of every different word of every text."""
    kinds, number = np.unique(words.hashes, return_inverse=True)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    pairs, times = np.unique(text * max(1, len(kinds)) + number, return_counts=True)
    return pairs // max(1, len(kinds)), kinds[pairs % max(1, len(kinds))], times


def _search(docs: DataFrame, wanted: DataFrame, top: int) -> DataFrame:
    """The best documents of each task for a bounded group of items."""
    spark = docs.sparkSession
    rows = wanted.toArrow().to_pydict()
    vocabulary, numbers = np.unique(np.array(rows["term"], np.int64), return_inverse=True)
    blocks = stored(docs.mapInArrow(_index(spark.sparkContext.broadcast(vocabulary)), _BLOCK_DDL), "postings")

    sizes = blocks.select(F.explode("sizes").alias("n")).where("n > 0")
    n_docs, n_terms = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
    held = {r.terms: r.n for r in held.collect()}
    items = defaultdict(list)
    for item, term, repeats in zip(rows["item"], numbers.tolist(), rows["repeats"]):
        if held.get(term):
            weight = floor(1000 * log((2 * n_docs + 2) / (2 * held[term] + 1)))
            items[item].append((held[term], term, repeats * weight))
    plan = []
    for item, terms in items.items():
        terms.sort()
        plan.append((item, np.array([t for _, t, _ in terms]), np.array([w for _, _, w in terms], np.int64)))
    shared = spark.sparkContext.broadcast((plan, n_docs, n_terms))
    return blocks.mapInArrow(_score(shared, top), "item long, doc_id long, score long")


def _index(vocabulary):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = vocabulary.value.view(np.uint64)
        sort = np.argsort(asked)
        asked = asked[sort]
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), binary(batch.column(1))
            for first, block in chunks(texts, BLOCK_BYTES):
                places, terms, times, sizes = [], [], [], []
                for begin, part in chunks(block):
                    words = Words(part, NOT_ALNUM, lower=True)
                    sizes.append(np.diff(words.bounds))
                    text, kind, count = _counted(words)
                    slot = np.minimum(np.searchsorted(asked, kind), max(0, len(asked) - 1))
                    known = asked[slot] == kind if len(asked) else np.zeros(len(kind), bool)
                    places.append(text[known] + begin)
                    terms.append(sort[slot[known]])
                    times.append(count[known])
                place, term, time = (np.concatenate(x) for x in (places, terms, times))
                by_term = np.argsort(term, kind="stable")
                kinds, counts = np.unique(term, return_counts=True)
                columns = (kinds, counts, place[by_term], time[by_term])
                row = [ids.slice(first, len(block)), pa.array(np.concatenate(sizes))]
                row += [pa.array(c.astype(t.type.value_type.to_pandas_dtype())) for c, t in zip(columns, list(_BLOCK)[2:])]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), _flat(c)) for c in row]
                yield pa.RecordBatch.from_arrays(lists, schema=_BLOCK)

    return index


def _flat(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Block:
    """The postings of one block: the documents of a term and what each adds per unit of weight."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        sizes = row["sizes"]
        spread = 75 + (25 * sizes * n_docs) // max(1, n_terms)
        self.docs = row["places"]
        times = row["times"].astype(np.int64)
        self.adds = (1_000_000_000 * times) // (1000 * times + 12 * spread[self.docs])
        ends = np.cumsum(row["counts"])
        starts = ends - row["counts"]
        self.spans = dict(zip(row["terms"].tolist(), zip(starts.tolist(), ends.tolist())))
        most = np.maximum.reduceat(self.adds, starts) if len(starts) else starts
        self.most = dict(zip(row["terms"].tolist(), most.tolist()))
        self.size = len(sizes)

    def scores(self, terms: list[int], weights: list[int], top: int, bar: int) -> np.ndarray:
        """Exact scores of all documents that can be among the ``top``; others have 0 or less than
        their score. ``bar``: the top-th score known from other blocks, or -1."""
        here = [(t, w) for t, w in zip(terms, weights) if t in self.spans]
        left = np.cumsum([w * self.most[t] for t, w in reversed(here)] or [0])[::-1].tolist()
        totals = np.zeros(self.size, np.int64)
        opened = None  # once no more may be opened: which are
        for j, (term, weight) in enumerate(here):
            if opened is None and left[j] < max(bar, _kth(totals, top, left[j])):
                opened = totals > 0
                if not opened.any():
                    break
            a, b = self.spans[term]
            docs, adds = self.docs[a:b], self.adds[a:b]
            if opened is not None:
                own = opened[docs]
                docs, adds = docs[own], adds[own]
            totals[docs] += weight * adds
        return totals


def _kth(totals: np.ndarray, top: int, bound: int) -> int:
    """The top-th largest of the partial scores if it may be over the bound, else -1."""
    if len(totals) < top or np.count_nonzero(totals > bound) < top:
        return -1
    return int(np.partition(totals, len(totals) - top)[len(totals) - top])


def _best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` positive scores, highest first, then by id, without an id last."""
    near = np.flatnonzero(scores > 0)
    if len(near) > top:
        own = scores[near]
        near = near[own >= np.partition(own, len(own) - top)[len(own) - top]]
    return near[np.lexsort((ids[near], missing[near], -scores[near]))[:top]]


def _score(shared, top: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, n_docs, n_terms = shared.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for number in range(batch.num_rows):
                row = {n: batch.column(n)[number].values for n in _BLOCK.names}
                missing = row["ids"].is_null().to_numpy(zero_copy_only=False)
                ids = row["ids"].fill_null(_LAST).to_numpy(zero_copy_only=False)
                block = Block({n: row[n].to_numpy(zero_copy_only=False) for n in _BLOCK.names[1:]}, n_docs, n_terms)
                for item, terms, weights in plan:
                    known = best.get(item)
                    bar = int(known[2][-1]) if known is not None and len(known[2]) == top else -1
                    totals = block.scores(terms.tolist(), weights.tolist(), top, bar)
                    at = _best(totals, ids, missing, top)
                    if not len(at):
                        continue
                    mine = (ids[at], missing[at], totals[at])
                    if known is not None:
                        mine = tuple(np.concatenate(pair) for pair in zip(known, mine))
                        order = np.lexsort((mine[0], mine[1], -mine[2]))[:top]
                        mine = tuple(x[order] for x in mine)
                    best[item] = mine
        if best:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.fromiter(best, np.int64), [len(x[0]) for x in best.values()])),
                    pa.array(np.concatenate([x[0] for x in best.values()]), mask=np.concatenate([x[1] for x in best.values()])),
                    pa.array(np.concatenate([x[2] for x in best.values()])),
                ],
                schema=_FOUND,
            )

    return score
