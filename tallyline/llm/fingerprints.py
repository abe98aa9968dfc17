"""Quartile digests of texts, in the manner of locality-sensitive byte-triplet hashes.

In each window of five bytes the triplets that hold its last byte are hashed to buckets. A digest
has a code of the length, in steps of its logarithm, and says of every bucket in which quarter of the
text's own bucket counts it lies, in two bits. The difference of two digests is a sum of
bucket steps (two apart counts more than twice) and of the lengths' difference; likeness is one
minus the difference over its largest value, so it lies between 0 and 1.

Digests tell small edits from other texts; texts of one language share much of their bucket order,
so likeness is high among them too. Null text is an empty text; texts under five bytes have only
zero buckets. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.hashing import chunks, spans

BUCKETS = 256
WINDOW = 5
# Steps between quarters 0..3 and what they add to the difference.
_STEP = np.array([0, 1, 2, 6])
_LENGTH_MOST = 96
_LEAST = -(1 << 63)
_HELD_CHARS = 1 << 20
# A triplet is the last byte of a window with those so many places before it.
_PAIRS = [(a, b) for a in range(1, WINDOW) for b in range(a + 1, WINDOW)]


def bucket_counts(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Triplets per text and bucket, of texts that follow each other in ``data``."""
    counts = np.zeros((len(sizes), BUCKETS), np.int64)
    inner = np.maximum(sizes - (WINDOW - 1), 0)
    begins = np.cumsum(sizes) - sizes
    if not inner.sum():
        return counts
    ends = spans(begins + (WINDOW - 1), inner)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), inner) * BUCKETS
    wide = data.astype(np.uint32)
    flat = counts.ravel()
    for number, (a, b) in enumerate(_PAIRS):
        packed = wide[ends] | (wide[ends - a] << np.uint32(8)) | (wide[ends - b] << np.uint32(16))
        packed = (packed + np.uint32(number << 24)) * np.uint32(0x9E3779B1)
        packed ^= packed >> np.uint32(15)
        bucket = (packed * np.uint32(0x85EBCA6B)) >> np.uint32(24)
        flat += np.bincount(row + bucket, minlength=flat.size)
    return counts


def digests(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of bytes: code of the length, then four buckets' quarters per byte."""
    ordered = np.sort(counts, axis=1)
    limits = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quarter = (counts[:, :, None] > limits[:, None, :]).sum(axis=2).astype(np.uint8)
    packed = quarter.reshape(len(counts), -1, 4)
    packed = packed[:, :, 0] | packed[:, :, 1] << 2 | packed[:, :, 2] << 4 | packed[:, :, 3] << 6
    code = np.minimum(np.log1p(sizes) * 8, 255).astype(np.uint8)
    return np.concatenate([code[:, None], packed], axis=1)


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1; 1 for equal digests."""
    shifts = np.array([0, 2, 4, 6], np.uint8)
    quarter = [(d[:, 1:, None] >> shifts & 3).reshape(len(d), -1).astype(np.int64) for d in (one, two)]
    steps = _STEP[np.abs(quarter[0] - quarter[1])].sum(axis=1)
    length = np.minimum(np.abs(one[:, 0].astype(int) - two[:, 0].astype(int)), _LENGTH_MOST)
    return 1.0 - (steps + length) / (BUCKETS * _STEP[-1] + _LENGTH_MOST)


def of_texts(texts: list[bytes]) -> np.ndarray:
    """Digest rows of the texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    parts = []
    for first, part in chunks(texts):
        data = np.frombuffer(b"".join(part), np.uint8)
        parts.append(bucket_counts(data, sizes[first : first + len(part)]))
    counts = np.concatenate(parts) if parts else np.zeros((0, BUCKETS), np.int64)
    return digests(counts, sizes)


def fingerprint(text: str) -> Column:
    """The digest of a text column, as hexadecimal digits."""

    @F.arrow_udf("string")
    def digest(texts: pa.Array) -> pa.Array:
        rows = of_texts([(x or "").encode() for x in texts.to_pylist()])
        return pa.array([row.tobytes().hex() for row in rows], pa.string())

    return digest(text)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


_OUT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Every document's digest, that of its edited text, and how like it they and the next
    document's are. Next is the next larger id; after the last comes the first.

    Documents are dealt to as many blocks of consecutive ids as there are shuffle partitions, one for
    each, and the first of each block is sent to the block before as well, so one shuffle brings every
    document and its next one together. Rows of one id are ordered by a hash of their texts, then by
    these; rows without an id come before all others. An id that fills several blocks is cut between
    such hashes; only rows of one id and one text are never parted.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id")
    place = F.struct(order, F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).alias("order")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    cuts = docs.select(order).agg(F.percentile_approx("id", shares, 100 * parts)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], _OUT_DDL)
    # The first of each block that has any: no more of them than shuffle partitions.
    below = docs.select(place).withColumn("block", _place(limits_of(cuts)))
    firsts = below.groupBy("block").agg(F.min("order").alias("first")).select("first.*").collect()
    firsts = sorted((r.id, r.tie) for r in firsts)

    rows = docs.select(place, F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("own", _place(firsts) - 1).withColumn("is_first", F.array_contains(_literal(firsts), F.col("order")))
    own = F.struct(F.col("own").alias("block"), F.lit(0).alias("late"))
    before = F.struct(F.pmod(F.col("own") - 1, F.lit(len(firsts))).alias("block"), F.lit(1).alias("late"))
    return (
        rows.withColumn("to", F.explode(F.when(F.col("is_first"), F.array(own, before)).otherwise(F.array(own))))
        .repartitionById(len(firsts), F.col("to.block"))
        .sortWithinPartitions("to.late", "order", "text")
        .select("to.block", "to.late", "doc_id", "text")
        .mapInArrow(_compare, _OUT_DDL)
    )


def limits_of(cuts: list[int]) -> list[tuple[int, int]]:
    """Where blocks begin, as id and hash, from ids at equal shares of the rows: an id that is several of
    them holds as many shares, and is cut at equal steps of the hash."""
    times = Counter(cuts)
    return [(i, _LEAST + k * (1 << 64) // times[i]) for i in sorted(times) for k in range(times[i])]


def _literal(places: list[tuple[int, int]]) -> Column:
    return F.expr(f"array({', '.join(f'struct({i}L AS id, {tie}L AS tie)' for i, tie in places)})")


def _place(limits: list[tuple[int, int]]) -> Column:
    """How many of the ordered limits the row's place in the order has reached: first whole runs of
    limits are passed, then those of one run are."""
    run = max(1, isqrt(len(limits)))
    ends = limits[run - 1 :: run]

    def reached(array: Column) -> Column:
        return F.size(F.filter(array, lambda limit: limit <= F.col("order")))

    passed = (reached(_literal(ends)) if ends else F.lit(0)) * run
    return passed + reached(F.slice(_literal(limits), passed + 1, run))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, those of the following block (late) last; of these the first counts."""
    held: list[tuple[int, str]] = []
    block, closed, size = None, False, 0
    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in range(4))
        for at, late, doc_id, text in zip(*columns):
            if at != block:
                block, closed, held, size = at, False, [], 0
            if closed:
                continue
            held.append((doc_id, text))
            size += len(text)
            closed = bool(late)
            if closed or size >= _HELD_CHARS:
                yield _rows(held)
                held, size = held[-1:], len(text)


def _rows(held: list[tuple[int, str]]) -> pa.RecordBatch:
    """Results of all but the last of consecutive documents."""
    names, texts = zip(*held)
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    bodies = [text.encode() for text in changed]
    plain, altered = of_texts([text.encode() for text in texts]), of_texts(bodies)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names[:-1], pa.int64()),
            pa.array([len(text) for text in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(body).hexdigest() for body in bodies], pa.string()),
            pa.array([row.tobytes().hex() for row in plain[:-1]], pa.string()),
            pa.array([row.tobytes().hex() for row in altered], pa.string()),
            pa.array(likeness(plain[:-1], altered)),
            pa.array(likeness(plain[:-1], plain[1:])),
        ],
        schema=_OUT,
    )
