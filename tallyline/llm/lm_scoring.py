"""Log probabilities of documents under a causal self-attention model and a word unigram base.

Texts are encoded once and their ids stored beside them. Counts of words and of subword ids cover all
training documents; they are combined in the tasks before they are shuffled. The attention model learns from every training document: first, in a task of
its own, from as many as a task has at least; then from all others in rounds. In a round every task
goes through its documents in steps of a batch, and the moves of the weights are averaged, those of an
id's own weights by how often a task used them. Documents are scored where they are read: their ids go through overlapping windows, every
id is scored once, with the block of ids before its own as context.

For the base, words that make up at least one in ``FREQUENT`` training tokens are looked up in a
sorted array that is sent to every task: there are ``FREQUENT`` such words at most, whatever the
corpus. The rest, none of which is frequent, are joined with the counts by their hashes.

Texts are lower-cased (A-Z). Words are runs of other characters than ASCII white space; every text
ends in an end token. Null text counts as empty. Rows with equal or null ``doc_id`` are scored each
on their own. Without training documents all counts are zero and the model keeps its first
weights. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm import attention
from tallyline.llm.hashing import LOWER, WHITE, Words, binary, chunks, mix, spans
from tallyline.llm.subwords import default_paths, encoder
from tallyline.sources.scratch import scratch_folder, stored

FREQUENT = 500_000
TASK_DOCUMENTS = 6000
STEPS, RATE = 2500, 1e-2
BATCH = 64  # windows in a step of the first task
ROUNDS, ROUND_BATCH = 4, 256
_STREAM = 300  # documents whose windows are made, and dealt to steps, together
_BLOCK, _FAN = 1 << 16, 32  # numbers of a vector in one row, and rows added up at once
IDS = 50257
END = 50256
_WORD, _ID, _TEXT = 0, 1, 2


def lower(texts: list[bytes]) -> list[bytes]:
    return [LOWER[np.frombuffer(text, np.uint8)].tobytes() for text in texts]


def encoded(docs: DataFrame, held_out: Column, paths: tuple[str, str], first: float) -> DataFrame:
    """Every document as ``row, doc_id, held_out, text`` (lower-case), ``ids`` and the ``round`` that learns
    from it: -1 if none does, 0 for a share ``first`` of the others, chosen by a hash of their place in
    the input. Texts are encoded once; a round reads the ids of its own documents only."""
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.binary()),
         ("ids", pa.binary()), ("round", pa.int32())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths).encode
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at, part in chunks(binary(batch.column(2)), 1 << 20):
                part = lower(part)
                rows = np.arange(number, number + len(part))
                number += len(part)
                ids, bounds = encode(part)
                ids = ids.astype(np.uint16)
                bodies = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                out = batch.column(1).slice(at, len(part))
                share = mix(rows.astype(np.uint64) + np.uint64(1)) / 2.0**64
                later = 1 + np.minimum((share - first) / max(1 - first, 1e-9) * ROUNDS, ROUNDS - 1).astype(np.int32)
                learns = np.where(out.to_numpy(zero_copy_only=False).astype(bool), -1, np.where(share < first, 0, later))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows), batch.column(0).slice(at, len(part)), out, pa.array(part, pa.binary()),
                        pa.array(bodies, pa.binary()), pa.array(learns.astype(np.int32)),
                    ],
                    schema=schema,
                )

    ddl = "row long, doc_id long, held_out boolean, text binary, ids binary, round int"
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(encode, ddl)
    path = scratch_folder(docs.sparkSession, "encoded")
    rows.write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema(ddl).parquet(path)


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the documents of an Arrow column, one after the other, and their bounds."""
    bodies = column.to_pylist()
    sizes = np.fromiter((len(body) // 2 for body in bodies), np.int64, len(bodies))
    return np.frombuffer(b"".join(bodies), np.uint16), np.concatenate([[0], np.cumsum(sizes)])


def counted(training: DataFrame) -> DataFrame:
    """``kind, key, n``: counts of word hashes, of subword ids with the end, and of texts."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.zeros(IDS, np.int64)
        texts = 0
        for batch in batches:
            ids += np.bincount(ids_of(batch.column(1))[0], minlength=IDS)
            texts += batch.num_rows
            for _, part in chunks(binary(batch.column(0)), 1 << 20):
                keys, times = np.unique(Words(part, WHITE, lower=False).hashes, return_counts=True)
                yield _counts(schema, _WORD, keys.astype(np.int64), times)
        ids[END] += texts
        yield _counts(schema, _ID, np.flatnonzero(ids), ids[ids > 0])
        yield _counts(schema, _TEXT, np.zeros(1, np.int64), np.array([texts]))

    rows = training.select("text", "ids").mapInArrow(count, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _counts(schema: pa.Schema, kind: int, keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    kinds = np.full(len(keys), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(times.astype(np.int64))], schema=schema)


def sequences(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with a begin mark (IDS) before and the end after, and their bounds."""
    sizes = np.diff(bounds)
    places = np.append(bounds[:-1] + 2 * np.arange(len(sizes)), len(ids) + 2 * len(sizes))
    out = np.full(places[-1], IDS, np.int64)
    out[spans(places[:-1] + 1, sizes)] = ids
    out[places[1:] - 1] = END
    return out, places


def trained(
    rows: DataFrame, classes: attention.Classes, total: int, documents: int, steps: int
) -> dict[str, np.ndarray]:
    """Weights after training on all encoded documents that are not held out, each in its round; they are
    ``total``, of which about ``documents`` are in round 0."""
    weights = attention.initial(classes.counts)
    # The order of rows that were shuffled is not fixed.
    alone = rows.where("round = 0").select("ids", "row").repartition(1).sortWithinPartitions("row")
    weights = learnt(alone, weights, classes, attention.falling(RATE, steps), BATCH, steps, 1)
    if total <= documents:
        return weights
    tasks = -(-total // documents)
    for number in range(ROUNDS):
        rate = attention.falling(0.3 * RATE * (1 - 0.8 * number / ROUNDS), 1 << 30)
        # Tasks have enough documents each, and are no more than that allows.
        among = rows.where(F.col("round") == number + 1).select("ids").coalesce(tasks)
        weights = learnt(among, weights, classes, rate, ROUND_BATCH, 0, tasks)
    return weights


def learnt(rows: DataFrame, weights, classes, rate, batch: int, steps: int, tasks: int) -> dict[str, np.ndarray]:
    """Weights after every task, of which there are ``tasks`` at most, made its steps: at least ``steps``,
    if it has documents, in several passes over few documents."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, classes))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("body", pa.binary())])
    ddl = "part int, block int, body binary"
    few = steps * batch

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, classes = shared.value
        of = np.append(classes.of, attention.BEGIN)
        part = TaskContext.get().partitionId()
        adam, random = attention.Adam(start), np.random.default_rng([1, part])
        held, number = [], 0
        for batch_rows in batches:
            for at in range(0, batch_rows.num_rows, _STREAM):
                ids, _ = sequences(*ids_of(batch_rows.column(0).slice(at, _STREAM)))
                inputs, targets = attention.windows(of[ids])
                adam.over(inputs, targets, rate, random, batch)
                number += len(inputs)
                if number < few:
                    held.append((inputs, targets))
                else:
                    held = []
        while held and adam.steps < steps:
            adam.over(*(np.concatenate(both) for both in zip(*held)), rate, random, batch)
        if adam.steps:
            moves = adam.moves(start)
            for block in range(-(-len(moves) // _BLOCK)):
                body = moves[block * _BLOCK : (block + 1) * _BLOCK].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([body], pa.binary())], schema=schema)

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        bodies = [np.frombuffer(body, np.float32) for body in rows.column("body").to_pylist()]
        total = np.sum(bodies, axis=0, dtype=np.float64).astype(np.float32)
        row = {"part": rows.column("up")[0].as_py(), "block": rows.column("block")[0].as_py(), "body": total.tobytes()}
        return pa.Table.from_pylist([row], schema=schema)

    moves = rows.select("ids").mapInArrow(learn, ddl)
    while tasks > 1:
        up = F.floor(F.col("part") / _FAN).cast("int")
        moves = moves.withColumn("up", up).groupBy("up", "block").applyInArrow(added, ddl)
        tasks = -(-tasks // _FAN)
    bodies = {r.block: r.body for r in moves.select("block", "body").collect()}
    shared.unpersist()
    if not bodies:
        return weights
    moves = np.concatenate([np.frombuffer(bodies[block], np.float32) for block in sorted(bodies)])
    return attention.moved(weights, moves)


_FOUND_DDL = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, "
    "rest array<long>"
)
_FOUND = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
     ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.int64()))]
)


def looked_up(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every hash in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    different, back = np.unique(hashes, return_inverse=True)
    place = np.minimum(np.searchsorted(keys, different), len(keys) - 1)
    return place[back], (keys[place] == different)[back]


def scored(rows: DataFrame, weights, classes, frequent, texts: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((weights, classes, frequent))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, classes, (keys, logs) = shared.value
        scorer, of = attention.Scorer(weights), np.append(classes.of, attention.BEGIN)
        log_share = np.append(classes.log_share, 0.0)
        for batch in batches:
            for first, part in chunks(binary(batch.column(3))):
                words = Words(part, WHITE, lower=False)
                place, hit = looked_up(words.hashes, keys)
                sizes = np.diff(words.bounds)
                doc = np.repeat(np.arange(len(part)), sizes)
                sums = np.bincount(doc[hit], logs[place[hit]], minlength=len(part)) + np.log10(texts + 1)
                known = np.bincount(doc[hit], minlength=len(part)) + int(texts > 0)
                missing = np.flatnonzero(~hit)
                edges = np.searchsorted(doc[missing], np.arange(len(part) + 1)).astype(np.int32)

                ids, places = sequences(*ids_of(batch.column(4).slice(first, len(part))))
                chances = scorer.log_chances(of[ids], places)
                own = np.diff(places) - 1
                targets = np.delete(ids, places[:-1])
                chances = chances.astype(np.float64) + log_share[targets]
                score = np.add.reduceat(chances, np.cumsum(own) - own) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(first, len(part)) for k in range(3)),
                        pa.array(sizes + 1, pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(sums),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(words.hashes[missing].astype(np.int64))),
                    ],
                    schema=_FOUND,
                )

    return rows.select("row", "doc_id", "held_out", "text", "ids").mapInArrow(score, _FOUND_DDL)


def scores(
    docs: DataFrame,
    held_out: Column,
    documents: int = TASK_DOCUMENTS,
    steps: int = STEPS,
    frequent: int = FREQUENT,
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``held_out``: the documents that nothing is learnt from. All others are trained on, about
    ``documents`` at least in a task, the first of which makes ``steps`` steps at least.
    """
    paths = paths or default_paths()
    learnable = docs.where(~held_out).count()
    rows = encoded(docs, held_out, paths, min(1.0, documents / max(learnable, 1)))
    counts = stored(counted(rows.where("round >= 0")), "counts")
    words = counts.where(F.col("kind") == _WORD)
    totals = {r[0]: (r[1] or 0, r[2]) for r in counts.groupBy("kind").agg(F.sum("n"), F.count("*")).collect()}
    texts = totals.get(_TEXT, (0, 0))[0]
    tokens = totals.get(_WORD, (0, 0))[0] + texts
    kinds = totals.get(_WORD, (0, 0))[1] + int(texts > 0)

    # No more than ``frequent`` words can have this many.
    limit = max(1, -(-tokens // frequent))
    often = words.where(F.col("n") >= limit).select("key", F.log10(F.col("n") + 1).alias("log")).toArrow()
    keys = often.column("key").to_numpy().astype(np.uint64)
    at = np.argsort(keys)
    lookup = (keys[at], often.column("log").to_numpy()[at])

    ids = counts.where(F.col("kind") == _ID).select("key", "n").toArrow()
    by_id = np.zeros(IDS)
    by_id[ids.column("key").to_numpy()] = ids.column("n").to_numpy()
    classes = attention.Classes(by_id)
    weights = trained(rows, classes, texts, documents, steps)

    found = stored(scored(rows, weights, classes, lookup, texts), "scored")
    rest = (
        found.select("row", F.explode("rest").alias("key"))
        .join(words.where(F.col("n") < limit).select("key", "n"), "key")
        .groupBy("row")
        .agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    )
    none = float(np.log10(tokens + kinds + 1))
    return found.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * none).alias("base_score"),
        "score",
    )
