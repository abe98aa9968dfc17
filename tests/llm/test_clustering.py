from __future__ import annotations

from hashlib import sha256
from math import floor, inf, isfinite, nan

import pytest
from pyspark.sql import functions as F

from tallyline.llm.clustering import MOST, clustered
from tallyline.llm.queries import op11_clustering
from tests.compare import difference, duck
from tests.conftest import SAMPLE
from tallyline.llm.statements import STATEMENTS

DDL = "vec_id long, embedding array<float>"


def plain(rows, k, rounds, size):
    """rows: (id, vector); returns (id, cluster, distance, own sum, sum of all, centroid) per kept vector."""
    kept = [
        (i, [max(-MOST, min(MOST, floor(1024 * x))) for x in v])
        for i, v in rows if v is not None and len(v) == size and all(x is not None and isfinite(x) for x in v)
    ]
    named = sorted((sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    own = [sum(d for _, j, d in out if j == c) for c in range(len(centroids))]
    return sorted(((i, j, d, own[j], sum(own), ",".join(map(str, centroids[j]))) for i, j, d in out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_plain_version_on_odd_vectors(spark):
    rows = [(i, [((i * 37 + k * 11) % 23) / 7 - 1.5 for k in range(4)]) for i in range(60)]
    rows += [(7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [0.5, -0.5, 0.0, 0.0]), (None, [1e30, -1e30, 0.0, 0.0])]
    rows += [(100 + n, [0.25, 0.25, 0.25, 0.25]) for n in range(40)]  # a third are one vector
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None, 1.0, 1.0]), (204, [nan] * 4), (205, [1.0, inf, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, DDL).withColumns({n: F.lit("mine") for n in ("point", "near", "cluster", "distance")})
    exact = [tuple(r) for r in vectors.select("vec_id", "embedding").collect()]
    for k, rounds in ((3, 4), (5, 0), (8, 10)):
        got = clustered(vectors.repartition(5), k, rounds, 4)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
        assert rows_of(got) == plain(exact, k, rounds, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0])], DDL)
    got = {r.vec_id: (r.cluster, r.distance) for r in clustered(few, 8, 3, 2).collect()}
    assert got[1] == got[2] and got[1][1] == got[3][1] == 0 and got[3][0] != got[1][0]
    none = clustered(few.limit(0), 8, 3, 2)
    assert none.collect() == [] and dict(none.dtypes)["distance"] == "bigint" and dict(none.dtypes)["cluster"] == "int"


def test_doubles_are_taken_as_they_are(spark):
    rows = [(i, [i / 10, -i / 3]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(clustered(vectors, 4, 5, 2)) == plain(rows, 4, 5, 2)


@pytest.fixture(scope="module")
def query(spark):
    return op11_clustering(spark, SAMPLE)


def test_query_against_sql(query):
    assert difference(query, duck(SAMPLE), STATEMENTS["op11_clustering"]) is None


def test_query_against_plain_version(spark, query):
    given = [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/embeddings.parquet").select("vec_id", "embedding").collect()]
    wanted = [(*r[:-1], sha256(r[-1].encode()).hexdigest()) for r in plain(given, 8, 10, 64)]
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert rows_of(query.select(*names)) == sorted(wanted, key=str)


def test_no_python_runs_on_the_executors(query):
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
