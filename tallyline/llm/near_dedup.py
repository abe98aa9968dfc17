"""Groups of documents whose sets of word shingles are near copies, by circulant MinHash.

Two permutations of a universe of 2**20 values make the whole signature: one places a shingle, and
coordinate k is the smallest value of the other permutation, shifted in a circle by k, over the
placed shingles. The values for all k of one shingle lie side by side, so a signature costs one
read of a short row per shingle. 32 bands of 4 coordinates miss a pair at the threshold with a
probability under 0.00001. Every link is confirmed on the full sets.

A set is a node, whatever the number of documents that have it. In each bucket of a band all nodes are held
against the smallest one, which links nearly all of a group of near copies with as many pairs as
members. Only members whose components still differ are then held against each other, in blocks of
a bounded size: by their signatures first, then, those with a possible partner, by their full sets.
Only links are written out. Nodes in one component need no further pairs, and a pair is looked at
in its first common bucket only, so nothing is lost and no group is written out as all its pairs.

A text with fewer words than a shingle is one shingle; null text and a text without words have
none and link with nothing. Rows that share a ``doc_id`` but not the set are one document: each of its
sets is a node with links of its own, and links join the sets of one id. Rows without a ``doc_id``
are not linked: they have no component and are kept. Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.components import components
from tallyline.llm.hashing import U64, WHITE, Words, binary, chunks, mix, run_hashes, prefix_sums, spans
from tallyline.llm.memory import text_batches, tidy
from tallyline.sources.scratch import stored

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
UNIVERSE = 1 << 20
BLOCK = 1024
# Signatures that agree in fewer places than this share of the threshold's expectation are
# no link: for a pair at the threshold that is more than five standard deviations off.
_LEAST_SHARE = 0.72
_ASKED = 1 << 20

_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
     ("signature", pa.binary())]
)
_SIGNED_DDL = "doc_id long, n_shingles long, d1 long, d2 long, signature binary"


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Places of the values, and the rows of the shifted permutation, one per place."""
    random = np.random.default_rng(7)
    place = random.permutation(UNIVERSE).astype(np.int32)
    values = random.permutation(UNIVERSE).astype(np.uint32)
    around = np.concatenate([values, values[: COORDINATES - 1]])
    return place, np.lib.stride_tricks.sliding_window_view(around, COORDINATES)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted different shingle hashes of every text."""
    words = Words(texts, WHITE, lower=True)
    counts = np.diff(words.bounds)
    sums = prefix_sums(words.hashes)
    number = np.where(counts >= size, counts - (size - 1), np.minimum(counts, 1))
    first = spans(words.bounds[:-1], number)
    length = np.repeat(np.minimum(counts, size), number)
    hashes = run_hashes(sums, first, first + length)
    ends = np.cumsum(number).tolist()
    return [np.unique(hashes[a:b]) for a, b in zip([0, *ends], ends)]


def digest(shingles: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    place, rows = permutations()
    at = place[(shingles >> U64(44)).astype(np.int64)]
    lowest = np.full(COORDINATES, UNIVERSE, np.uint32)
    for k in range(0, len(at), 4096):
        np.minimum(lowest, rows[at[k : k + 4096]].min(axis=0), out=lowest)
    return lowest.astype(np.uint16)


def signed(docs: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(binary(batch.column(1))):
                sets = shingle_sets(part, size)
                digests = np.array([digest(s) for s in sets]).reshape(-1, 2)
                signatures = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.array(signatures, pa.binary()),
                    ],
                    schema=_SIGNED,
                )

    return docs.select("doc_id", "text").mapInArrow(lambda rows: tidy(sign(rows)), _SIGNED_DDL)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """A hash per row and band of a matrix of signatures."""
    parts = signatures.astype(np.uint64).reshape(-1, BANDS, ROWS)
    shifts = U64(16) * np.arange(ROWS, dtype=np.uint64)
    packed = np.bitwise_or.reduce(parts << shifts, axis=2)
    return mix(packed + np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def buckets(nodes: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("bucket", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
                hashes = band_hashes(matrix.reshape(-1, COORDINATES)).astype(np.int64)
                owner = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(hashes.ravel())], schema=schema)

    return nodes.select("node", "signature").mapInArrow(rows, "node long, bucket long")


def near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    with text_batches(docs.sparkSession):
        return _near_copies(docs, size, percent, block)


def _near_copies(docs: DataFrame, size: int, percent: int, block: int) -> DataFrame:
    rows = stored(signed(docs, size), "signed")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    least = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    classes = stored(least.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = stored(
        classes.join(named, ["d1", "d2", "doc_id"])
        .dropDuplicates(["node"]).select("node", "doc_id", "d1", "n_shingles", "signature"),
        "nodes",
    )
    members = stored(buckets(nodes), "buckets")
    hubs = stored(
        members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs"
    )
    shared = stored(members.join(hubs, "bucket"), "shared-buckets")
    stars = shared.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = stored(confirmed(docs, nodes, alike(stars, nodes, percent), size, percent), "links-to-hubs")
    first = first.union(sets_of_one_id(named, classes))
    roots = components(first)
    rest = stored(crossing(docs, shared, roots, nodes, size, percent, block), "links-across")
    if not rest.isEmpty():
        roots = components(first.union(rest))
    rooted = stored(
        classes.join(roots, "node", "left").select("d1", "d2", "doc_id", F.coalesce("root", "node").alias("root")),
        "rooted",
    )
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named_as = stored(rooted.join(smallest, "root").select("d1", "d2", "component_id"), "components")
    found = (
        rows.join(named_as, ["d1", "d2"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    )
    return found.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def sets_of_one_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the sets of ids that have several: from each to the smallest node of them."""
    extremes = (f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("d1", "d2"))
    several = stored(
        named.groupBy("doc_id").agg(*extremes).where("min_d1 != max_d1 or min_d2 != max_d2").select("doc_id"), "ids-of-sets"
    )
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    held = named.join(several, "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct()
    held = stored(held.join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node"), "sets-of-ids")
    hubs = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    return held.join(hubs, "doc_id").where("node != b").select(F.col("node").alias("a"), "b").distinct()


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = _LEAST_SHARE * percent / 100 * COORDINATES

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (
                    np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                    for k in (2, 3)
                )
                ok = pa.array((one == two).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], schema=schema)

    def side(name: str) -> DataFrame:
        return nodes.select(
            F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}")
        )

    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
    return sized.select("a", "b", "s_a", "s_b").mapInArrow(close, "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` of the wanted nodes: the sorted hashes of their sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("shingles", pa.binary())])
    wanted = stored(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "d1"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(binary(batch.column(1))):
                found = shingle_sets(part, size)
                names = batch.column(0).slice(first, len(part)).cast(pa.int64())
                firsts = pa.array([int(digest(s)[0]) for s in found], pa.int64())
                bodies = pa.array([s.tobytes() for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([names, firsts, bodies], schema=schema)

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_ASKED)).alias("slot")
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .select("*", slot)
        # At most _ASKED numbers, whatever the number of documents.
        .join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi")
        .join(wanted, "doc_id", "left_semi")
        .select("doc_id", "text")
    )
    # A row of the same id with another set belongs to another node, or to none that is asked for.
    own = texts.mapInArrow(sets, "doc_id long, d1 long, shingles binary").join(wanted, ["doc_id", "d1"])
    return stored(own.dropDuplicates(["node"]).select("node", "shingles"), "sets")


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    pairs = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    known = full_sets(docs, nodes, wanted, size)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(binary(batch.column(2)), binary(batch.column(3)))
            ]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=out)

    one = known.select(F.col("node").alias("a"), F.col("shingles").alias("s_a"))
    two = known.select(F.col("node").alias("b"), F.col("shingles").alias("s_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s_a", "s_b").mapInArrow(check, "a long, b long")


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both) > 0


_CELL = ["bucket", "low", "high"]


def crossing(
    docs: DataFrame, shared: DataFrame, roots: DataFrame, nodes: DataFrame, size: int, percent: int, block: int
) -> DataFrame:
    """Links between nodes of one bucket and different components that were not held against each
    other yet: enough of them to join their components."""
    member = stored(
        shared.where("n > 2 and node != hub")
        .join(roots, "node", "left")
        .join(nodes.drop("doc_id", "d1"), "node")
        .select("bucket", "node", F.coalesce("root", "node").alias("root"), "n_shingles", "signature"),
        "bucket-members",
    )
    mixed = stored(
        member.groupBy("bucket")
        .agg(
            F.min("root").alias("least"), F.max("root").alias("most"),
            F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") / (block * 2048))).cast("int").alias("parts"),
        )
        .where("least != most").select("bucket", "parts"),
        "mixed-buckets",
    )
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda k: F.struct(F.least(k, F.col("mine")).alias("low"), F.greatest(k, F.col("mine")).alias("high")),
    )
    dealt = (
        member.join(mixed, "bucket")
        .withColumn("mine", mine)
        .withColumn("cell", F.explode(cells))
        .select("bucket", "cell.low", "cell.high", "mine", "node", "root", "n_shingles", "signature")
    )
    kind = "bucket long, low int, high int, mine int, node long, root long, n_shingles long, signature binary"
    possible = stored(dealt.groupBy(*_CELL).applyInArrow(_with_partner(percent), kind), "possible")
    known = full_sets(docs, nodes, possible.select("node").distinct(), size)
    return possible.join(known, "node").groupBy(*_CELL).applyInArrow(_links(percent), "a long, b long")


class Cell:
    """The rows of a cell of a bucket, and for each row the partners worth a look."""

    def __init__(self, rows: pa.Table, percent: int) -> None:
        names = ("node", "root", "n_shingles", "mine")
        self.node, self.root, self.count, self.mine = (rows.column(n).to_numpy() for n in names)
        data = b"".join(rows.column("signature").to_pylist())
        self.matrix = np.frombuffer(data, np.uint16).reshape(-1, COORDINATES)
        self.bands = band_hashes(self.matrix).astype(np.int64)
        self.bucket = rows.column("bucket")[0].as_py()
        self.within = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        self.percent, self.least = percent, _LEAST_SHARE * percent / 100 * COORDINATES

    def partners(self, i: int) -> np.ndarray:
        """Nodes before node i, of other components and alike sizes, whose first common bucket with it
        is this one and whose signatures are near enough."""
        other = (self.root != self.root[i]) & (self.node < self.node[i])
        if not self.within:
            other &= self.mine != self.mine[i]
        count = self.count
        other &= np.minimum(count, count[i]) * 100 >= np.maximum(count, count[i]) * self.percent
        at = np.flatnonzero(other)
        at = at[(self.matrix[at] == self.matrix[i]).sum(axis=1) >= self.least]
        first = (self.bands[at] == self.bands[i]).argmax(axis=1)
        return at[self.bands[i][first] == self.bucket]


def _with_partner(percent: int):
    def keep(rows: pa.Table) -> pa.Table:
        cell = Cell(rows, percent)
        found = np.zeros(len(cell.node), bool)
        for i in range(len(cell.node)):
            at = cell.partners(i)
            found[at] = True
            found[i] |= len(at) > 0
        return rows.filter(pa.array(found))

    return keep


def _links(percent: int):
    def join(rows: pa.Table) -> pa.Table:
        cell = Cell(rows, percent)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        parent: dict[int, int] = {}

        def find(root: int) -> int:
            while parent.get(root, root) != root:
                root = parent[root]
            return root

        links = []
        for i in range(len(cell.node)):
            for j in cell.partners(i).tolist():
                one, two = find(int(cell.root[i])), find(int(cell.root[j]))
                if one != two and linked(sets[i], sets[j], percent):
                    parent[max(one, two)] = min(one, two)
                    links.append((int(cell.node[i]), int(cell.node[j])))
        columns = zip(*links) if links else [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return join
