from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyline.llm.packing import Packer, pack
from tallyline.llm.subwords import default_paths, encoder
from tests.llm.fixtures import documents, empty, pairs


@pytest.fixture(scope="module")
def packed(spark):
    docs = documents(spark, extra=True)
    return pairs(docs), [r.asDict() for r in pack(docs, length=256, buffer_ids=20_000).collect()]


def test_pieces_make_up_every_document(packed):
    docs, rows = packed
    tokenizer = encoder(*default_paths()).whole
    by_doc = defaultdict(list)
    for row in rows:
        by_doc[row["doc_id"]].append(row)
    assert by_doc.keys() == {doc for doc, _ in docs}
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for row in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = ids[at : at + row["length"]]
            assert (row["start"], row["doc_tokens"]) == (at, len(ids))
            assert row["ids_crc32"] == zlib.crc32(part.tobytes()) and row["length"] == len(part) > 0
            at += row["length"]
        assert at == len(ids)


def test_sequences_have_no_gaps_and_no_padding(packed):
    sequences = defaultdict(list)
    for row in packed[1]:
        sequences[row["sequence_id"]].append(row)
    for rows in sequences.values():
        at = 0
        for row in sorted(rows, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at <= 256 and at & (at - 1) == 0


def test_longest_pieces_go_to_the_cheapest_sequences():
    packer = Packer(16, 1.0, 1.0, 0)
    for doc, size in enumerate([9, 8, 3, 3, 2, 2, 1, 1]):
        packer.add(doc, np.zeros(size, np.uint16))  # and an end id each
    packer.assign(last=True)
    costs = defaultdict(float)
    for _, _, length, _, _, sequence, _ in packer.out:
        costs[sequence] += length + length**2
    full = [cost for sequence, cost in costs.items() if sequence < 2]
    assert abs(full[0] - full[1]) < 40  # descending, cheapest first: 110 and 90 to begin with


def test_no_documents(spark):
    assert pack(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        pack(empty(spark), length=100)
