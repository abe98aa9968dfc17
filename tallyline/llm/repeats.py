"""Where whole windows of a fixed length come back anywhere in a table of documents.

Finding them all at once would mean one index of everything. Instead each window is owned by one
anchor: of the k-grams in it, the one with the smallest hash. Windows with equal content have
equal anchors at equal places, so only windows under one anchor have to be compared:

1. every document gives its anchors, each with the fragment its windows span;
2. anchors that occur once are dropped, and equal fragments under one anchor become one row;
3. an anchor with a single fragment needs no look at the text: all its windows come back;
4. the fragments of other anchors are dealt to shards of a bounded size, where an operator's own
   index says which windows come back;
5. an anchor with too many different fragments for a shard (a passage after whose end every
   document goes on differently) has its windows counted one by one, by two hashes.

Every step is an aggregation with map-side combining or a join the adaptive planner can split.
Documents are known by ``doc_id`` and a hash of id and text, so equal rows share their spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.hashing import U64, binary, chunks, mix, run_hashes, spans, window_minima
from tallyline.llm.memory import give_back, text_batches
from tallyline.sources.scratch import stored

KEYS = ["name", "mark"]
ANCHOR = pa.struct([(n, pa.int64()) for n in ("anchor", "fragment", "lo", "hi")])
_FOUND = pa.schema(
    [("name", pa.int64()), ("mark", pa.int64()), ("size", pa.int64()), ("anchors", pa.list_(ANCHOR))]
)
_FOUND_DDL = (
    "name long, mark long, size long, "
    "anchors array<struct<anchor: long, fragment: long, lo: long, hi: long>>"
)
_SLICE = pa.schema(
    [("anchor", pa.int64()), ("fragment", pa.int64()), ("copies", pa.int64()), ("body", pa.binary())]
)
_SLICE_DDL = "anchor long, fragment long, copies long, body binary"
_WINDOW_DDL = "anchor long, fragment long, copies long, lo long, window long"
_SPAN_DDL = "anchor long, fragment long, lo long, hi long"
# Documents that are asked for are told apart from the others by this many bits of their hash.
_ASKED = 1 << 20

Prepare = Callable[[list[bytes]], "Units"]


class Units:
    """A chunk of texts as one array of units (bytes or words): prefix sums of their values,
    and the units at which each text begins and ends."""

    def __init__(self, sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        self.sums, self.begins, self.ends = sums, begins, ends

    def anchors(self, window: int, gram: int) -> np.ndarray:
        """Arrays: text, anchor, fragment, first and last unit of the fragment in its text."""
        grams = len(self.sums) - gram
        if grams <= 0:
            return np.zeros((5, 0), np.int64)
        at = np.arange(grams)
        hashes = run_hashes(self.sums, at, at + gram)
        chosen = window_minima(hashes, window - gram + 1)
        counts = np.maximum(self.ends - self.begins - (window - 1), 0)
        starts = spans(self.begins, counts)
        if not len(starts):
            return np.zeros((5, 0), np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        own = chosen[starts]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
        last = np.append(new[1:], len(starts)) - 1
        lo, hi, own, text = starts[new], starts[last] + window, own[new], text[new]
        body = run_hashes(self.sums, lo, hi) + (own - lo).astype(np.uint64)
        base = self.begins[text]
        return np.stack([text, hashes[own].astype(np.int64), mix(body).astype(np.int64), lo - base, hi - base])


def keyed(docs: DataFrame) -> DataFrame:
    """What a document is known by; ``row`` and ``text`` are all that is kept of it."""
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("name")
    kept = [c for c in ("row", "text") if c in docs.columns]
    return docs.select(*kept, name, F.xxhash64("doc_id", "text").alias("mark"))


def replaced(docs: DataFrame, found: DataFrame, take_out, columns: str) -> DataFrame:
    """``docs`` with ``columns`` from ``take_out(text, starts, ends)`` of the found spans. Only texts
    and spans pass through Python."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ': ') for c in columns.split(', '))}>")
    def without(texts: pa.Array, lists: pa.Array) -> pa.Array:
        flat = lists.values
        lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        offsets = lists.offsets.to_numpy()
        rows = [
            take_out(text, lo[a:b], hi[a:b])
            for text, a, b in zip(binary(texts), offsets[:-1].tolist(), offsets[1:].tolist())
        ]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        del rows
        give_back()
        return pa.StructArray.from_arrays(arrays, names=names)

    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in names]
    none = F.expr("cast(array() as array<struct<lo: bigint, hi: bigint>>)")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return (
        keyed(rows)
        .select("row", *KEYS)
        .join(found, KEYS, "left")
        .select("row", without("row.text", F.coalesce("spans", none)).alias("made"))
        .select(*others, "made.*")
    )


def anchored(docs: DataFrame, prepare: Prepare, window: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(binary(batch.column(2))):
                units = prepare(part)
                text, *columns = units.anchors(window, gram)
                bounds = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(ANCHOR))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        batch.column(1).slice(first, len(part)),
                        pa.array(units.ends - units.begins, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds), values),
                    ],
                    schema=_FOUND,
                )

    return keyed(docs.select("doc_id", "text")).select(*KEYS, "text").mapInArrow(find, _FOUND_DDL)


def repeated(
    docs: DataFrame,
    prepare: Prepare,
    cut: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]],
    search: Callable[[list[bytes]], Iterator[tuple[int, int, int]]],
    window: int,
    gram: int,
    shard_units: int,
) -> DataFrame:
    """``name, mark, spans``: the spans, in units, of every document that holds repeated windows.

    ``cut`` gives fragments of one text as bytes. ``search`` gets the different fragments of a shard
    and yields runs of repeated windows: number of the fragment, first window, last window.
    """
    with text_batches(docs.sparkSession):
        return _repeated(docs, prepare, cut, search, window, gram, shard_units)


def _repeated(docs: DataFrame, prepare: Prepare, cut, search, window: int, gram: int, shard_units: int) -> DataFrame:
    found = stored(anchored(docs, prepare, window, gram), "anchors")
    places = found.select(*KEYS, F.explode("anchors").alias("a")).select(*KEYS, "a.*")
    often = stored(places.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors-often")
    places = stored(places.join(often, "anchor"), "anchors-repeated")

    fragments = stored(
        places.groupBy("anchor", "fragment").agg(
            F.count("*").alias("copies"), F.min(F.struct(*KEYS, "lo", "hi")).alias("at")
        ),
        "fragments",
    )
    kinds = fragments.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.sum(F.expr("at.hi - at.lo")).alias("units")
    )
    many = stored(kinds.where("kinds > 1"), "anchors-varied")
    whole = fragments.where("copies > 1").select(
        "anchor", "fragment", F.lit(0).cast("long").alias("lo"), F.expr("at.hi - at.lo").alias("hi")
    )
    bodies = stored(_bodies(docs, fragments, many, cut, shard_units), "fragment-texts")

    total = many.where(F.col("units") <= shard_units).agg(F.sum("units")).first()[0] or 0
    shards = max(1, -(-total // shard_units))
    within = (
        bodies.where("not crowded")
        .withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(lambda shard: _search(shard, search, window), _SPAN_DDL)
    )
    counted = _counted(bodies.where("crowded"), prepare, window)
    parts = stored(within.unionByName(counted).unionByName(whole), "repeated-parts")
    return (
        places.withColumnsRenamed({"lo": "from", "hi": "to"})
        .join(parts, ["anchor", "fragment"])
        .select(*KEYS, (F.col("from") + F.col("lo")).alias("lo"), (F.col("from") + F.col("hi")).alias("hi"))
        .groupBy(*KEYS)
        .agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    )


def _bodies(docs: DataFrame, fragments: DataFrame, many: DataFrame, cut, shard_units: int) -> DataFrame:
    """The different fragments of anchors that have several, each cut from one of its documents."""
    wanted = stored(
        fragments.join(many, "anchor")
        .select(
            "at.name", "at.mark",
            F.struct(
                "anchor", "fragment", "copies", "at.lo", "at.hi", (F.col("units") > shard_units).alias("crowded")
            ).alias("part"),
        )
        .groupBy(*KEYS)
        .agg(F.collect_list("part").alias("parts")),
        "wanted",
    )
    asked = wanted.select(F.pmod("mark", F.lit(_ASKED)).alias("slot")).distinct()
    texts = (
        keyed(docs.select("doc_id", "text"))
        .withColumn("slot", F.pmod("mark", F.lit(_ASKED)))
        # At most _ASKED numbers, whatever the number of documents.
        .join(F.broadcast(asked), "slot", "left_semi")
    )
    schema = pa.schema([*_SLICE, ("crowded", pa.bool_())])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = binary(batch.column(0)), batch.column(1).to_pylist()
            for text, parts in zip(texts, lists):
                lo = np.array([p["lo"] for p in parts], np.int64)
                hi = np.array([p["hi"] for p in parts], np.int64)
                columns = [[p[n] for p in parts] for n in ("anchor", "fragment", "copies")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c, pa.int64()) for c in columns),
                        pa.array(cut(text, lo, hi), pa.binary()),
                        pa.array([p["crowded"] for p in parts], pa.bool_()),
                    ],
                    schema=schema,
                )

    return texts.join(wanted, KEYS).select("text", "parts").mapInArrow(slices, f"{_SLICE_DDL}, crowded boolean")


def _search(shard: pa.Table, search, window: int) -> pa.Table:
    anchor, fragment = (shard.column(n).to_numpy() for n in ("anchor", "fragment"))
    # Documents that are equal in id and text were cut twice.
    _, first = np.unique(np.stack([anchor, fragment]), axis=1, return_index=True)
    bodies = shard.column("body").to_pylist()
    copies = shard.column("copies").to_numpy()[first]
    rows = [
        (anchor[first[i]], fragment[first[i]], a, b + window)
        for i, a, b in search([bodies[k] for k in first])
        if copies[i] == 1
    ]
    columns = zip(*rows) if rows else [[]] * 4
    names = ("anchor", "fragment", "lo", "hi")
    give_back()
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def _counted(bodies: DataFrame, prepare: Prepare, window: int) -> DataFrame:
    """Repeated windows of crowded anchors: each window by its anchor and its own hash."""
    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "fragment", "copies", "lo", "window")])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(binary(batch.column(3))):
                units = prepare(part)
                counts = units.ends - units.begins - (window - 1)
                starts = spans(units.begins, counts)
                text = np.repeat(np.arange(len(part)), counts)
                hashes = run_hashes(units.sums, starts, starts + window).astype(np.int64)
                own = [batch.column(k).to_numpy()[first + text] for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (*own, starts - units.begins[text], hashes)], schema=schema
                )

    rows = (
        bodies.dropDuplicates(["anchor", "fragment"])
        .select("anchor", "fragment", "copies", "body")
        .mapInArrow(windows, _WINDOW_DDL)
    )
    rows = stored(rows, "crowded-windows")
    back = rows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "window")
    return (
        rows.where("copies = 1")
        .join(back, ["anchor", "window"])
        .select("anchor", "fragment", "lo", (F.col("lo") + window).alias("hi"))
    )
