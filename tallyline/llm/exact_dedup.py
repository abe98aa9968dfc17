"""Exact copies by progressive refinement: by length, then by a hash of the prefix, then in full.

Texts are compared without white space. A first pass notes the length and a hash of the first
characters of every text. Lengths that occur once drop out, then pairs of length and prefix that
occur once; what is left is known by slots, hashes of such pairs, of which there are ``SLOTS`` at
most, so they can be broadcast whatever the size of the input. A second pass takes the full hash of
texts in these slots only. A text that shares a slot by chance is hashed in vain, no more.

Texts are never shuffled, only lengths and hashes are. A group of copies is summed before it is
shuffled; the rows of groups that hold more than one row in ``HOT`` (there are under ``HOT`` such
groups) find their group by a broadcast, all others by a join in which every key is small.

Null text counts as empty, so all null, empty and white texts are copies of each other. Of equal
texts the row with the most characters stays, then that of the smallest id (rows without an id
last); of rows alike in both any one stays, and only one. An empty table gives no rows. Columns of
the input that have names of the result are not mixed up with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.sources.scratch import stored

WHITE = " \t\n\x0b\x0c\r"
PREFIX = 256
SLOTS = 1 << 20
HOT = 10_000


def normalised(text: str = "text") -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def marked(docs: DataFrame, digest_all: bool = False, prefix: int = PREFIX, slots: int = SLOTS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``n_chars`` and
    ``text_sha256``. The hash is null for texts that nothing can equal, unless ``digest_all``."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return _marked(rows, digest_all, prefix, slots).drop("key")


def deduplicate(docs: DataFrame, prefix: int = PREFIX, slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "keyed")
    marks = _marked(keyed.select("key", "row.doc_id", "row.text"), False, prefix, slots)
    return keyed.join(marks.where("kept").select("key"), "key", "left_semi").select("row.*")


def _marked(rows: DataFrame, digest_all: bool, prefix: int, slots: int) -> DataFrame:
    first = F.xxhash64(F.substring("plain", 1, prefix))
    plain = rows.select("*", normalised().alias("plain"))
    outlines = stored(plain.select(F.char_length("plain").alias("length"), first.alias("prefix")), "outlines")
    wanted = F.broadcast(shared_slots(outlines, slots))

    slot = _slot(F.char_length("plain"), first, slots)
    full = F.sha2("plain", 256)
    hashed = stored(
        plain.withColumn("slot", slot).join(wanted, "slot", "left").select(
            "key", "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
            F.coalesce("wanted", F.lit(False)).alias("shared"),
            (full if digest_all else F.when(F.col("wanted"), full)).alias("text_sha256"),
        ),
        "full-hashes",
    )
    order = F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    groups = stored(
        hashed.where("shared").groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        .where("group_size > 1")
        .select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.key").alias("keep_key")),
        "groups",
    )
    return _told(hashed, groups)


def shared_slots(outlines: DataFrame, slots: int) -> DataFrame:
    """Slots of the pairs of length and prefix that more than one text has: ``slots`` rows at most."""
    again = outlines.groupBy("length").count().where("count > 1")
    again = again.select(F.pmod("length", F.lit(slots)).alias("slot")).distinct()
    alive = outlines.withColumn("slot", F.pmod("length", F.lit(slots))).join(F.broadcast(again), "slot", "left_semi")
    pairs = alive.groupBy("length", "prefix").count().where("count > 1")
    found = pairs.select(_slot(F.col("length"), F.col("prefix"), slots).alias("slot")).distinct()
    return stored(found.withColumn("wanted", F.lit(True)), "slots")


def _slot(length: Column, prefix: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(length, prefix), F.lit(slots))


def _told(hashed: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row with its group. Rows that are no copies meet no join at all."""
    large = F.broadcast(groups.where(F.col("group_size") > max(1, hashed.count() // HOT)))
    alone = hashed.where("not shared").select("*", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("key").alias("keep_key"))
    candidates = hashed.where("shared")
    hot = candidates.join(large, "text_sha256").select(alone.columns)
    cold = candidates.join(large, "text_sha256", "left_anti").join(
        groups.withColumn("grouped", F.lit(True)), "text_sha256", "left"
    )
    cold = cold.select(
        *hashed.columns, F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("keep_key", "key").alias("keep_key"),
    )
    return alone.unionByName(hot).unionByName(cold).select(
        "key", "doc_id", "keep_id", "group_size", (F.col("key") == F.col("keep_key")).alias("kept"), "n_chars", "text_sha256"
    )
