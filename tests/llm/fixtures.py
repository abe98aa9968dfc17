"""Documents with every odd case: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.conftest import SAMPLE

PASSAGE = " ".join(f"shared{k}" for k in range(60))
ODD = [
    (1000, None), (1001, ""), (1002, "   \t\n"), (1003, "one"), (1004, "Two words"), (1005, "Two words"),
    (1006, "123 456 !!! 789"), (1007, "é" * 450 + " ünïcode " + "é" * 450), (1008, "ab" * 600),
    (1009, "start " + PASSAGE + " end"), (1010, "other\n" + PASSAGE), (1011, PASSAGE.upper()),
    (1012, "word " * 400), (1013, "x" * 5000), (1014, "日本語の文章です " * 30), (1015, "tab\tsep\x0bword\x0cfeed"),
    (1016, "no-break space and   em space"), (1017, "<|endoftext|> it's we'LL 're"),
    (1018, " ".join(f"long{k % 997}" for k in range(12000))),
]


def documents(spark, extra: bool = False):
    """The sample's documents and the odd ones; ``extra``: with columns that operators make, too."""
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").select(
        "doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("odd").alias("source"),
        F.char_length("text").cast("long").alias("n_chars"),
    )
    docs = docs.unionByName(odd).repartition(5)
    if extra:
        names = ("row", "kept", "name", "mark", "spans", "node", "score", "gone", "made", "slot", "text_2")
        docs = docs.withColumns({n: F.lit(f"mine-{n}") for n in names})
    return docs


def pairs(docs, *columns):
    return [tuple(r) for r in docs.select(*(columns or ("doc_id", "text"))).collect()]


def empty(spark):
    return documents(spark).limit(0)


def rows_of(df, *columns):
    """Rows in a fixed order; nulls come first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])
