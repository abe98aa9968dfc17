from __future__ import annotations

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.conftest import SAMPLE
from tests.llm import brute
from tests.llm.fixtures import documents, empty, pairs, rows_of

STAGES = dict(corpus_pipeline.STAGES)
NEAR, STRINGS, CONTAMINATED = (list(STAGES.values())[k] for k in (1, 2, 3))


def test_stages_are_registered_in_order(spark):
    assert len(corpus_pipeline.STAGES) == 5 and contract.queries()["pipeline"] is corpus_pipeline.run
    names = [n for n in contract.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_decide_as_plain_versions(spark):
    docs = documents(spark, extra=True)
    columns = docs.columns
    kept = NEAR(spark, docs, SAMPLE)
    assert kept.columns == columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k in brute.near_dedup(pairs(docs)) if k)

    cut = STRINGS(spark, docs, SAMPLE)
    assert cut.columns == columns and dict(cut.dtypes) == dict(docs.dtypes)
    given = pairs(docs)
    gone = brute.repeated_spans([(t or "").encode() for _, t in given], 200)
    wanted = {}
    for (doc, text), flags in zip(given, gone):
        kept_bytes = bytes(b for b, g in zip((text or "").encode(), flags) if not g)
        wanted[doc] = text if not any(flags) else kept_bytes.decode("utf-8", "ignore")
    rows = {r.doc_id: r for r in cut.collect()}
    assert {doc: r.text for doc, r in rows.items()} == wanted
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows.values() if r.doc_id >= 1000)
    assert all(r["kept"] == "mine-kept" and r["row"] == "mine-row" for r in rows.values())

    clean = CONTAMINATED(spark, docs, SAMPLE)
    items = spark.read.parquet(f"{SAMPLE}/benchmark.parquet")
    hit = {r[0] for r in brute.contamination(given, pairs(items, "item_id", "text")) if r[5]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d for d, _ in given} - hit


def test_languages_are_kept_and_rejected_documents_go(spark):
    docs = documents(spark, extra=True)
    kept = STAGES["language identification"](spark, docs, SAMPLE)
    names = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not names & {1000, 1001, 1002, 1006, 1014}
    natural = {r.doc_id for r in docs.where("doc_id < 1000").collect()}
    assert len(natural - names) <= 2
    assert kept.where("score = 'mine-score'").count() == len(names)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SAMPLE)
    sizes = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, SAMPLE).collect()}
    assert sizes.keys() == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", STAGES)
def test_empty_tables_and_missing_ids(spark, name):
    assert STAGES[name](spark, empty(spark), SAMPLE).collect() == []
    rows = [(None, "same words in both of these rows " * 9, "en"), (4, "same words in both of these rows " * 9, "en"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string"))
    found = STAGES[name](spark, docs, SAMPLE)
    assert len(rows_of(found, found.columns[0])) >= 1


def test_contaminated_rows_go_by_their_own_text(spark):
    item = spark.read.parquet(f"{SAMPLE}/benchmark.parquet").first().text
    rows = [(1, f"before {item} after"), (1, "a clean row of the same id"), (None, item), (None, "a clean row without an id"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("mine"))
    left = CONTAMINATED(spark, docs, SAMPLE)
    assert left.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in left.collect()), key=str) == sorted(rows[1::2] + rows[4:], key=str)


def test_copies_under_one_id_or_without_an_id_leave_one_text(spark):
    text, other = (" ".join(f"{w}{k}" for k in range(60)) for w in ("clean", "other"))
    lone = " ".join(f"lone{k}" for k in range(60))
    rows = [(1, text), (1, text), (None, text), (2, other), (None, other + " end"), (None, lone), (None, lone), (1, lone + " x"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = NEAR(spark, docs, SAMPLE)
    wanted = [(1, lone + " x"), (1, text), (2, other), (3, None)]
    assert sorted((tuple(r) for r in left.collect()), key=str) == sorted(wanted, key=str)
    assert sorted((tuple(r) for r in STRINGS(spark, left, SAMPLE).collect()), key=str) == sorted(wanted, key=str)


def test_what_a_search_leaves_is_removed(spark):
    from tallyline.sources import scratch

    before = len(scratch._made.get(spark.sparkContext.applicationId, []))
    kept = CONTAMINATED(spark, documents(spark), SAMPLE)
    assert len(scratch._made[spark.sparkContext.applicationId]) - before == 2
    assert kept.count() > 0


def test_cut_texts_pass_through_python_once(spark):
    """A task with two Python functions in a row holds two workers."""
    from tallyline.sources import scratch

    before = len(scratch._made.get(spark.sparkContext.applicationId, []))
    cut = STRINGS(spark, documents(spark), SAMPLE)
    assert len(scratch._made[spark.sparkContext.applicationId]) - before == 1
    assert cut._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1
    assert cut.count() > 0
