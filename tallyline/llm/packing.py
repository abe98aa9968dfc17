"""Cost-balanced packing of documents into sequences of a fixed length.

Every task packs the documents of its input partition, a bounded buffer of ids at a time, so no
text or id is shuffled or stored. Attention over a piece costs ``linear * n + quadratic * n * n``.
Documents give off whole sequences first; what is left of them, longest first, goes to the
sequence of lowest cost that still has room for it. A piece that fits nowhere is cut to fill the
cheapest sequence with any room. The last ids of a task go to sequences whose lengths are powers
of two, so no sequence needs padding.

Null text counts as empty; an empty text is the end id alone. Rows with equal or null ``doc_id``
are packed as documents of their own. Other columns are ignored. No rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyline.llm.hashing import binary, chunks
from tallyline.llm.memory import tidy
from tallyline.llm.subwords import default_paths, encoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW = pa.schema([(name.split()[0], pa.int64()) for name in SCHEMA.split(", ")])
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BUFFER_IDS = 1 << 22


def pack(
    docs: DataFrame,
    length: int = 2048,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    paths: tuple[str, str] | None = None,
    buffer_ids: int = BUFFER_IDS,
) -> DataFrame:
    """One row per piece: its document, place there and in its sequence, and a digest of its ids.

    ``quadratic`` is by default such that a piece of 1,024 ids costs as much for its square as for
    its length. Sequence ids are unique but not consecutive. ``length`` must be a power of two.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    tokenizer, ranks = paths or default_paths()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks).encode
        packer = Packer(length, linear, quadratic, TaskContext.get().partitionId() << 36)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), binary(batch.column(1))
            for first, part in chunks(texts):
                ids, bounds = encode(part)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    packer.add(names[first + i], ids[a:b])
                if packer.held >= buffer_ids:
                    yield packer.rows(last=False)
        yield packer.rows(last=True)

    return docs.select("doc_id", "text").mapInArrow(lambda rows: tidy(packed(rows), encoder.cache_clear), SCHEMA)


class Packer:
    def __init__(self, length: int, linear: float, quadratic: float, first_id: int) -> None:
        self.length, self.linear, self.quadratic = length, linear, quadratic
        self.next_id, self.held = first_id, 0
        self.pieces: list[tuple] = []  # doc_id, ids of the piece, start, ids of the document
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        ids = np.append(ids.astype("<u4"), np.uint32(END_ID))
        whole = len(ids) - len(ids) % self.length
        for start in range(0, whole, self.length):
            self.put(doc_id, ids[start : start + self.length], start, len(ids), self.next_id, 0)
            self.next_id += 1
        if whole < len(ids):
            self.pieces.append((doc_id, ids[whole:], whole, len(ids)))
            self.held += len(ids) - whole

    def put(self, doc_id, ids, start, doc_tokens, sequence, offset) -> None:
        crc = zlib.crc32(ids.tobytes())
        self.out.append((doc_id, start, len(ids), crc, doc_tokens, sequence, offset))

    def rows(self, last: bool) -> pa.RecordBatch:
        self.assign(last)
        columns = zip(*self.out) if self.out else [[]] * len(_ARROW)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

    def assign(self, last: bool) -> None:
        """Fill as many whole sequences as the held ids make; what is left waits for more ids or,
        at the last, makes sequences of the powers of two that add up to it."""
        room = np.full(self.held // self.length, self.length, np.int64)
        if last:
            rest = self.held % self.length
            powers = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
            room = np.concatenate([room, np.array(powers, np.int64)])
        full, cost = room.copy(), np.zeros(len(room))
        left, waiting = int(room.sum()), []
        for doc_id, ids, start, doc_tokens in sorted(self.pieces, key=lambda p: -len(p[1])):
            while len(ids) and left:
                fits = room >= len(ids)
                at = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
                part = ids[: room[at]]
                self.put(doc_id, part, start, doc_tokens, self.next_id + at, int(full[at] - room[at]))
                cost[at] += self.linear * len(part) + self.quadratic * len(part) ** 2
                room[at] -= len(part)
                left -= len(part)
                ids, start = ids[len(part) :], start + len(part)
            if len(ids):
                waiting.append((doc_id, ids, start, doc_tokens))
        self.next_id += len(room)
        self.pieces, self.held = waiting, sum(len(p[1]) for p in waiting)
