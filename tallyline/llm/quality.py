"""Quality by perplexity under a modified Kneser-Ney model of trusted text.

The model is a trigram model of subword ids. Four fifths of the trusted documents, told by a hash of
their id, are counted by Spark; left-extension counts, context sums and lower-order probabilities are
found by joins of the count tables on their n-grams. All single ids and a bounded number of the most
frequent n-grams are dealt to shards by n-gram, each a sorted array, and are broadcast, with a bitmap
of fixed size of the rarer ones. A task prices with these what it can; the n-grams that may be among
the rarer ones are joined with the tables of these, and every text adds up all its costs. Costs are
whole numbers of 2**-16 bits, so sums depend on no order. A larger model broadcasts no more; once
the bitmap fills up, more n-grams are joined.

A document is kept if its perplexity does not exceed the language's threshold, which is a high
quantile over all trusted documents of the language that were not trained on, times a margin; a
few bits are spared to each text, as a handful of tokens says little. A
language without such documents gets the quantile over all languages.

Null text and text without tokens have no perplexity and are not kept. A null language is a language
of its own. Rows with equal ``doc_id`` are scored each on their own; a label counts for all of
them, and a document is trusted if any of its labels says so. Without trusted documents every
document with tokens is kept, with a null perplexity and threshold. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.hashing import U64, binary, chunks, mix, spans
from tallyline.llm.subwords import default_paths, encoder
from tallyline.sources.scratch import stored, stored_alone

ORDER = 3
LEARNT = 0.8  # share of the trusted documents that is learnt from; the thresholds come from the others
QUANTILE = 0.995
MARGIN = 1.25
SPARE_BITS = 8.0  # what a text may cost beyond the threshold, which matters for very short ones
SHARDS_LOG = 6
FREQUENT = {3: 1 << 22, 2: 1 << 20}  # up to so many n-grams of an order are broadcast
BITMAP_LOG = 27  # the size of the bitmap of the others
BROADCAST_IDS = 1 << 22  # ids of that many documents are broadcast; of more, texts are shuffled to them
COUNTED = 1 << 20  # n-grams that a task holds before it passes their counts on
BEGIN, END = 50257, 50256
VOCABULARY = 50258
_BITS = 16
_UNIT = 1 << 16  # a bit of cost
_COUNTS = 1 << 14


def sequences(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids between two begin marks and an end mark, and the place of each text."""
    sizes = np.diff(bounds)
    starts = bounds[:-1] + 3 * np.arange(len(sizes))
    out = np.full(len(ids) + 3 * len(sizes), BEGIN, np.uint64)
    out[spans(starts + 2, sizes)] = ids
    out[starts + 2 + sizes] = END
    return out, np.append(starts, len(out))


def packed(units: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The n-grams that end at the given places, as one number each."""
    out = np.zeros(len(ends), np.uint64)
    for k in reversed(range(n)):
        out = (out << np.uint64(_BITS)) | units[ends - k]
    return out


def counted(sample: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``n, gram, value``: n-grams of the highest order with their counts."""
    schema = pa.schema([("gram", pa.int64()), ("value", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths).encode
        grams, times, fresh = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            different, back = np.unique(np.concatenate([grams, *(g for g, _ in fresh)]), return_inverse=True)
            total = np.bincount(back, np.concatenate([times, *(t for _, t in fresh)]), len(different))
            return different, total.astype(np.int64)

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(times)], schema=schema)

        for batch in batches:
            for _, part in chunks(binary(batch.column(0))):
                units, bounds = sequences(*encode(part))
                ends = spans(bounds[:-1] + 2, np.diff(bounds) - 2)
                fresh.append(np.unique(packed(units, ends, ORDER), return_counts=True))
                if sum(len(g) for g, _ in fresh) >= COUNTED // 2:
                    (grams, times), fresh = merged(), []
                    if len(grams) >= COUNTED:
                        yield passed_on()
                        grams, times = grams[:0], times[:0]
        grams, times = merged()
        yield passed_on()

    rows = sample.select("text").mapInArrow(count, "gram long, value long")
    return rows.groupBy("gram").agg(F.sum("value").alias("value"))


def smoothed(counts: DataFrame) -> DataFrame:
    """``n, gram, chance, weight, value``: interpolated probability of the last id of every n-gram, the
    weight of the shorter model after it as a context, and the count behind it."""
    tables = {ORDER: stored(counts, "grams")}
    del counts  # and with it, in time, the files of its shuffle
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << _BITS * n) - 1)
        tables[n] = stored(
            tables[n + 1].select(suffix.alias("gram")).groupBy("gram").agg(F.count("*").alias("value")), "grams"
        )
    shorter, parts = None, []
    for n in range(1, ORDER + 1):
        table = tables[n].withColumn("context", F.shiftrightunsigned("gram", _BITS))
        steps = discounts(tables[n])
        step = F.when(F.col("value") == 1, steps[0]).when(F.col("value") == 2, steps[1]).otherwise(steps[2])
        contexts = stored(
            table.groupBy("context").agg(
                F.sum("value").alias("total"), (F.sum(step) / F.sum("value")).alias("weight")
            ),
            "contexts",
        )
        own = table.join(contexts, "context").withColumn("own", (F.col("value") - step) / F.col("total"))
        if shorter is None:
            chance = own.withColumn("low", F.lit(1.0 / VOCABULARY))
        else:
            suffix = F.col("gram").bitwiseAND((1 << _BITS * (n - 1)) - 1)
            low = shorter.select(F.col("gram").alias("suffix"), F.col("chance").alias("low"))
            chance = own.withColumn("suffix", suffix).join(low, "suffix")
        shorter = stored(
            chance.select("gram", (F.col("own") + F.col("weight") * F.col("low")).alias("chance"), "value"), "chances"
        )
        # Weights belong to the n-gram that is the context: one order below.
        parts.append((n, shorter, contexts.select(F.col("context").alias("gram"), "weight")))
    out = None
    for k, (n, chances, _) in enumerate(parts):
        rows = chances.withColumn("n", F.lit(n))
        if k + 1 < len(parts):
            # A context that is no n-gram itself (begin marks) has a weight only.
            rows = rows.join(parts[k + 1][2], "gram", "full").withColumn("n", F.lit(n))
        else:
            rows = rows.withColumn("weight", F.lit(None).cast("double"))
        rows = rows.select("n", "gram", "chance", "weight", "value")
        out = rows if out is None else out.unionByName(rows)
    empty = parts[0][2].select(
        F.lit(0).alias("n"), "gram", F.lit(1.0 / VOCABULARY).alias("chance"), "weight", F.lit(None).cast("long").alias("value")
    )
    return out.unionByName(empty)


def discounts(table: DataFrame) -> list[float]:
    """What is taken off counts of one, of two, and of three and more."""
    sizes = dict.fromkeys(range(1, 5), 0)
    sizes |= {r[0]: r[1] for r in table.where("value <= 4").groupBy("value").count().collect()}
    if not all(sizes[k] for k in range(1, 5)):
        return [0.5, 0.75, 0.9]
    y = sizes[1] / (sizes[1] + 2 * sizes[2])
    return [min(max(k - (k + 1) * y * sizes[k + 1] / sizes[k], 0.05), k - 0.05) for k in (1, 2, 3)]


def cost(share: Column) -> Column:
    return F.rint(-F.log2(share) * _UNIT).cast("long")


def frequent_from(table: DataFrame, n: int, limit: int) -> int:
    """The least count, of those up to ``_COUNTS``, that no more than ``limit`` n-grams reach, or one beyond."""
    own = table.where((F.col("n") == n) & F.col("value").isNotNull())
    rows = own.groupBy(F.least("value", F.lit(_COUNTS + 1)).alias("value")).count().collect()
    sizes = {r[0]: r[1] for r in rows}
    least, number = _COUNTS + 1, sizes.get(_COUNTS + 1, 0)
    if number > limit:
        return 1 << 62
    while least > 1 and number + sizes.get(least - 1, 0) <= limit:
        least -= 1
        number += sizes.get(least, 0)
    return least


def slots(n: np.ndarray | int, grams: np.ndarray) -> np.ndarray:
    return mix(grams | (np.asarray(n).astype(np.uint64) << U64(3 * _BITS))) >> U64(64 - BITMAP_LOG)


def bitmap(rare: DataFrame) -> np.ndarray:
    """Words of a bitmap of fixed size in which every n-gram has a slot."""
    schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = slots(batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64))
            word, back = np.unique(slot >> U64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, back, U64(1) << (slot & U64(63)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], schema=schema
            )

    rows = rare.select("n", "gram").mapInArrow(words, "word int, bits long")
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_LOG - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


class Model:
    """Sorted n-grams of each order and shard, with the costs of their last id and of leaving them as a
    context, and a bitmap of the n-grams that are kept elsewhere, if there are any."""

    def __init__(self, rows: pa.Table, rare: np.ndarray | None = None) -> None:
        order, gram = rows.column("n").to_numpy(), rows.column("gram").to_numpy().astype(np.uint64)
        # Below 0: no n-gram, only a context.
        chance = np.rint(np.nan_to_num(-np.log2(rows.column("chance").fill_null(np.nan).to_numpy()) * _UNIT, nan=-1.0))
        weight = np.rint(-np.log2(rows.column("weight").fill_null(1.0).to_numpy()) * _UNIT)
        chance, weight = chance.astype(np.int32), weight.astype(np.int32)
        self.floor = int(chance[order == 0][0] + weight[order == 0][0]) if (order == 0).any() else None
        self.rare = rare
        self.tables = []
        for n in range(1, ORDER + 1):
            own = order == n
            # By shard, then by n-gram: both orders at once, as the shard is in the upper bits.
            key = mix(gram[own])
            at = np.argsort(key)
            key = key[at]
            limits = np.searchsorted(key >> np.uint64(64 - SHARDS_LOG), np.arange((1 << SHARDS_LOG) + 1))
            self.tables.append((key, chance[own][at], weight[own][at], limits))

    def find(self, n: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _, _, limits = self.tables[n - 1]
        if not len(keys):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        wanted = mix(grams)
        shard = (wanted >> np.uint64(64 - SHARDS_LOG)).astype(np.uint8)
        place = np.empty(len(grams), np.int64)
        by_shard = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[by_shard], np.arange((1 << SHARDS_LOG) + 1))
        for k in range(1 << SHARDS_LOG):
            rows = by_shard[edges[k] : edges[k + 1]]
            if len(rows):
                place[rows] = limits[k] + np.searchsorted(keys[limits[k] : limits[k + 1]], wanted[rows])
        place = np.minimum(place, len(keys) - 1)
        return place, keys[place] == wanted

    def elsewhere(self, n: int, grams: np.ndarray) -> np.ndarray:
        """Which n-grams, none of them here, may be kept elsewhere."""
        if self.rare is None:
            return np.zeros(len(grams), bool)
        slot = slots(n, grams)
        return (self.rare[slot >> U64(6)] >> (slot & U64(63)) & U64(1)).astype(bool)

    def chances(self, n: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs of the last ids of the n-grams that are here, and which are."""
        place, hit = self.find(n, grams)
        if hit.any():
            hit &= self.tables[n - 1][1][place] >= 0
        out = np.zeros(len(grams), np.int64)
        out[hit] = self.tables[n - 1][1][place[hit]]
        return out, hit

    def weights(self, n: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs of leaving the n-grams as contexts, nothing for those not here, and which are."""
        place, hit = self.find(n, grams)
        out = np.zeros(len(grams), np.int64)
        out[hit] = self.tables[n - 1][2][place[hit]]
        return out, hit

    def priced(self, units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Costs of the ids at the given places by what is here; of the places whose cost may depend on
        n-grams kept elsewhere, the trigrams, and what leaving the context and the bigram cost by what is
        here."""
        grams = packed(units, ends, 3)
        out, hit = self.chances(3, grams)
        rows = np.flatnonzero(~hit)
        before, bigrams = packed(units, ends[rows] - 1, 2), packed(units, ends[rows], 2)
        left, known = self.weights(2, before)
        low, hit = self.chances(2, bigrams)
        asked = self.elsewhere(3, grams[rows]) | (~known & self.elsewhere(2, before)) | (~hit & self.elsewhere(2, bigrams))
        more = np.flatnonzero(~hit)
        ids, found = self.chances(1, packed(units, ends[rows[more]], 1))
        leaving, _ = self.weights(1, packed(units, ends[rows[more]] - 1, 1))
        low[more] = leaving + np.where(found, ids, self.floor)
        out[rows] = left + low
        return out, rows[asked], grams[rows[asked]], left[asked], low[asked]

    def bits(self, units: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cost of the ids at the given places, if all n-grams are here."""
        return self.priced(units, ends)[0] / _UNIT


_ASKED = pa.struct([("gram", pa.int64()), ("times", pa.int32()), ("left", pa.int32()), ("low", pa.int32())])
_PRICED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()),
     ("cost", pa.int64()), ("asked", pa.list_(_ASKED))]
)
_PRICED_DDL = (
    "row long, doc_id long, lang string, n_tokens long, cost long, "
    "asked array<struct<gram: long, times: int, left: int, low: int>>"
)


def priced(docs: DataFrame, model: Model | None, paths: tuple[str, str]) -> DataFrame:
    """Every document with a number, the cost of what the model prices, and what is to be joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths).encode
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, part in chunks(binary(batch.column(2))):
                ids, bounds = encode(part)
                sizes = np.diff(bounds)
                total = np.zeros(len(part), np.int64)
                # Documents and what they ask for: n-grams in order, each once with its number.
                doc, asked = np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 4
                if shared.value:
                    units, places = sequences(ids, bounds)
                    ends = spans(places[:-1] + 2, sizes + 1)
                    costs, at, grams, left, low = shared.value.priced(units, ends)
                    costs[at] = 0
                    edge = np.concatenate([[0], np.cumsum(sizes + 1)])
                    total = np.diff(np.concatenate([[0], np.cumsum(costs)])[edge])
                    doc = np.searchsorted(edge, at, side="right") - 1
                    order = np.lexsort((grams, doc))
                    doc, grams = doc[order], grams[order]
                    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])][: len(doc)])
                    doc, times = doc[new], np.diff(np.append(new, len(grams)))
                    asked = [grams[new].astype(np.int64), times, left[order][new], low[order][new]]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [pa.array(x, f.type) for x, f in zip(asked, _ASKED)], fields=list(_ASKED)
                    ),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(part))),
                        batch.column(0).slice(first, len(part)),
                        batch.column(1).slice(first, len(part)),
                        pa.array(sizes, pa.int64()),
                        pa.array(total),
                        lists,
                    ],
                    schema=_PRICED,
                )
                row += len(part)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    return rows.mapInArrow(price, _PRICED_DDL)


def joined(asked: DataFrame, rare: DataFrame) -> DataFrame:
    """``row, cost``: what the n-grams cost that were asked for, in parts. A trigram that is not there
    costs leaving its context and its bigram; what of these is not there either costs what was found
    without."""
    trigrams = rare.where("n = 3").select("gram", cost(F.col("chance")).alias("held"))
    bigrams = rare.where("n = 2")
    contexts = bigrams.select(F.col("gram").alias("context"), F.coalesce(cost(F.col("weight")), F.lit(0)).alias("leaving"))
    shorter = bigrams.select(F.col("gram").alias("bigram"), cost(F.col("chance")).alias("shorter"))
    met = stored(asked.join(trigrams, "gram", "left"), "asked-for")
    missed = (
        met.where("held is null")
        .withColumn("context", F.shiftrightunsigned("gram", _BITS))
        .withColumn("bigram", F.col("gram").bitwiseAND((1 << 2 * _BITS) - 1))
        .join(contexts, "context", "left").join(shorter, "bigram", "left")
    )
    fallen = F.coalesce("leaving", "left") + F.coalesce("shorter", "low")
    parts = met.where("held is not null").select("row", (F.col("times") * F.col("held")).alias("cost"))
    return parts.unionByName(missed.select("row", (F.col("times") * fallen).alias("cost")))


def scored(docs: DataFrame, table: DataFrame | None, paths: tuple[str, str]) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity`` of every document by the n-grams of the table, if any."""
    if table is None:
        rows = priced(docs, None, paths)
        return rows.select("doc_id", "lang", "n_tokens", F.lit(None).cast("double").alias("perplexity"))
    least = {n: frequent_from(table, n, limit) for n, limit in FREQUENT.items()}
    n, value = F.col("n"), F.col("value")
    is_rare = F.coalesce(((n == 3) & (value < least[3])) | ((n == 2) & (value < least[2])), F.lit(False))
    rare = table.where(is_rare)
    frequent = table.where(~is_rare).select("n", "gram", "chance", "weight").toArrow()
    rows = stored(priced(docs, Model(frequent, bitmap(rare)), paths), "priced")
    more = joined(rows.select("row", F.inline("asked")), rare).groupBy("row").agg(F.sum("cost").alias("more"))
    total = F.col("cost") + F.coalesce("more", F.lit(0))
    perplexity = F.when(F.col("n_tokens") > 0, F.pow(F.lit(2.0), total / _UNIT / (F.col("n_tokens") + 1)))
    return rows.drop("asked").join(more, "row", "left").select(
        "doc_id", "lang", "n_tokens", perplexity.alias("perplexity")
    )


def classified(
    docs: DataFrame,
    labels: DataFrame,
    documents: int | None = None,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    spare_bits: float = SPARE_BITS,
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity, threshold, keep`` of every document. ``labels``:
    ``doc_id, trusted``; the model learns from the share ``LEARNT`` of the trusted ones, or, if told,
    from about ``documents`` per language."""
    paths = paths or default_paths()
    trusted = labels.where("trusted").select(F.col("doc_id").cast("long")).distinct()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    if documents is None:
        chosen = trusted.where(share < LEARNT)
    else:
        known = docs.where("text is not null").select(
            F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("lang")
        ).join(trusted, "doc_id")
        sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
        chosen = (
            known.join(sizes, "lang")
            .where(share < F.least(F.lit(documents) / F.col("n"), F.lit(0.5)))
            .select("doc_id").distinct()
        )
    chosen = stored(chosen, "trained-on")
    learnt = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text").join(
        F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, "doc_id", "left_semi"
    )
    table = stored_alone(docs.sparkSession, lambda: smoothed(counted(learnt, paths)), "n-grams")
    model = None if table.isEmpty() else table
    found = stored_alone(docs.sparkSession, lambda: scored(docs, model, paths), "perplexities")

    held = found.join(trusted, "doc_id").join(chosen, "doc_id", "left_anti").where("perplexity is not null")
    level = F.percentile_approx("perplexity", quantile, 10_000) * margin
    limits = stored(held.groupBy("lang").agg(level.alias("own")), "thresholds")
    overall = held.agg(level.alias("all")).first()[0]
    allowed = F.col("threshold") * F.pow(F.lit(2.0), F.lit(spare_bits) / (F.col("n_tokens") + 1))
    return (
        found.withColumn("key", F.coalesce("lang", F.lit("")))
        .join(limits.select(F.coalesce("lang", F.lit("")).alias("key"), "own"), "key", "left")
        .withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
        .select(
            "doc_id", "lang", "n_tokens", "perplexity", "threshold",
            ((F.col("n_tokens") > 0) & F.coalesce(F.col("perplexity") <= allowed, F.lit(True))).alias("keep"),
        )
    )
