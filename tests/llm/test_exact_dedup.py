from __future__ import annotations

import re
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyline.llm import exact_dedup
from tallyline.llm.exact_dedup import deduplicate, marked
from tallyline.llm.queries import op13_exact_dedup
from tallyline.llm.statements import STATEMENTS
from tests.compare import difference, duck
from tests.conftest import SAMPLE
from tests.llm.fixtures import documents, empty, pairs, rows_of

ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b  c\n"), (4, "ABC"), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (8, None),
    (9, "x" * 600), (10, "x" * 600), (11, "x" * 599 + "y"), (12, "y" + "x" * 599), (13, "é ü"), (14, "éü"),
    (None, "lone row"), (None, "abc"), (None, "a b c d"), (15, "abcd"), (16, "no\xa0break"), (17, "nobreak"),
    (18, "twin  twin"), (18, "twin  twin"), (19, "twin twin"), (20, "all alone here"), (21, "日本 語"), (22, "日本語 "),
]


def plain(rows):
    """(id, keep id, size, sha) of each row, and how many rows stay per group."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for bare, members in groups.items():
        keep = min(members)[3]
        digest = sha256(bare.encode()).hexdigest()
        out += [(m[3], keep, len(members), digest) for m in members]
    return sorted(out, key=lambda r: [(x is not None, x) for x in r]), len(groups)


COLUMNS = ("doc_id", "keep_id", "group_size", "text_sha256")


@pytest.mark.parametrize("slots", [1, 7, 1 << 20])
def test_against_plain_version(spark, slots):
    docs = spark.createDataFrame(ROWS * 2 + ROWS[:3], "doc_id long, text string").repartition(4)
    found = marked(docs, digest_all=True, prefix=4, slots=slots)
    wanted, kept = plain(ROWS * 2 + ROWS[:3])
    assert rows_of(found, *COLUMNS) == wanted
    stays = found.where("kept").collect()
    assert len(stays) == kept and len({r.text_sha256 for r in stays}) == kept
    assert all(r.doc_id == r.keep_id for r in stays)


def test_hot_and_common_groups_and_hashes_only_where_needed(spark, setting, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    rows = [(i, "hot  copy" if i % 3 == 0 else f"pair {i // 2}" if i < 100 else f"alone {i:9d} {'z' * i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = marked(docs)
    digest = found.where("group_size = 1").select("text_sha256")
    assert rows_of(found, "doc_id", "keep_id", "group_size") == sorted(r[:3] for r in plain(rows)[0])
    assert digest.where("text_sha256 IS NULL").count() > digest.count() // 2
    assert found.where("group_size > 1 and text_sha256 IS NULL").count() == 0


def test_odd_documents_and_clashing_columns(spark):
    docs = documents(spark, extra=True).withColumns({n: F.lit("mine") for n in ("key", "plain", "slot", "keep_id", "group_size")})
    wanted, kept = plain(pairs(docs))
    assert rows_of(marked(docs, digest_all=True), *COLUMNS) == wanted
    left = deduplicate(docs)
    assert left.columns == docs.columns and left.count() == kept
    assert left.where("keep_id = 'mine' and plain = 'mine'").count() == kept
    assert rows_of(left, "doc_id") == sorted({(r[1],) for r in wanted})


def test_query_against_sql(spark):
    assert difference(op13_exact_dedup(spark, SAMPLE), duck(SAMPLE), STATEMENTS["op13_exact_dedup"]) is None


def test_empty_table(spark):
    assert marked(empty(spark)).collect() == [] and deduplicate(empty(spark)).collect() == []
