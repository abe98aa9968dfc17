"""Integer k-means with expressions of the JVM only.

Every component x becomes floor(scale * x). The first centroids are the vectors with the smallest
hashes of their ids. A round compares each vector with the centroids, which are literal arrays:
``zip_with`` and ``aggregate`` give the squared distances and ``array_min`` over structs of distance
and number the nearest one, the smaller number on ties. Column sums per centroid, made before they
are shuffled, give the next centroids: only k rows of sums reach the driver, whatever the input.
All vectors take part in every round, and the sums of a hot vector are added up where it lies.

The integers are stored once and every round reads them again, so a lost executor costs a re-read.
Rounds after one that moved no centroid would move none either and are left out.

Vectors of another size, null vectors and vectors with a null or non-finite component are left out.
Rows with equal ids are vectors of their own; equal hashes are told apart by their components. A
null id is hashed as an empty text. With fewer vectors than k each is a centroid; an empty table
gives no rows. Integers are held within 2**27, so that distances fit 64 bits: components beyond
131,072 at scale 1,024 count as that. A sum of distances that does not fit 64 bits is null.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.sources.scratch import stored

CLUSTERS = 8
ROUNDS = 10
SIZE = 64
SCALE = 1024
MOST = 1 << 27


def clustered(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = "3:"
) -> DataFrame:
    """Per kept vector of (``vec_id``, ``embedding``): ``vec_id``, ``cluster``, ``distance``,
    ``cluster_inertia``, ``inertia`` and the ``centroid`` of its cluster."""
    points = stored(
        vectors.where(usable("embedding", size)).select("vec_id", integers("embedding", scale).alias("point")), "points"
    )
    centroids = first_centroids(points, k, seed)
    for _ in range(rounds):
        moved = next_centroids(points, centroids, size)
        if moved == centroids:
            break
        centroids = moved
    chosen = points.select("vec_id", nearest("point", centroids).alias("near")) if centroids else points.select(
        "vec_id", F.struct(F.lit(0).cast("long").alias("distance"), F.lit(0).alias("cluster")).alias("near")
    )
    chosen = stored(chosen.select("vec_id", "near.cluster", "near.distance"), "clusters")
    sums = chosen.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()
    own = {r.cluster: int(r.inertia) for r in sums}
    return chosen.select(
        "vec_id",
        "cluster",
        "distance",
        _lookup([_fits(own.get(j)) for j in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(_fits(sum(own.values()))).cast("long").alias("inertia"),
        _lookup([",".join(map(str, c)) for c in centroids], "string").alias("centroid"),
    )


def centroid_digest(centroid: str = "centroid") -> Column:
    """Lower-case hex SHA-256 of the components, joined by commas."""
    return F.sha2(F.col(centroid), 256)


def usable(vector: str, size: int) -> Column:
    finite = F.forall(
        vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    )
    return (F.size(vector) == size) & finite


def integers(vector: str, scale: int) -> Column:
    def whole(x: Column) -> Column:
        near = F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")
        return F.greatest(F.least(near, F.lit(MOST).cast("long")), F.lit(-MOST).cast("long"))

    return F.transform(vector, whole)


def first_centroids(points: DataFrame, k: int, seed: str) -> list[list[int]]:
    named = F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = points.select("point", F.sha2(named, 256).alias("hash")).orderBy("hash", "point").limit(k)
    return [list(r.point) for r in sorted(first.collect(), key=lambda r: (r.hash, r.point))]


def nearest(point: str, centroids: list[list[int]]) -> Column:
    """Struct of the squared distance to the nearest centroid and its number."""

    def distance(centroid: list[int]) -> str:
        literal = f"array({', '.join(f'{x}L' for x in centroid)})"
        apart = f"zip_with({point}, {literal}, (x, c) -> (x - c) * (x - c))"
        return f"aggregate({apart}, 0L, (total, part) -> total + part)"

    pairs = (f"struct({distance(c)} AS distance, {j} AS cluster)" for j, c in enumerate(centroids))
    return F.expr(f"array_min(array({', '.join(pairs)}))")


def next_centroids(points: DataFrame, centroids: list[list[int]], size: int) -> list[list[int]]:
    """The floors of the means of each centroid's vectors; a centroid without vectors stays."""
    if not centroids:
        return centroids
    chosen = points.select("point", nearest("point", centroids).alias("near"))
    sums = chosen.groupBy("near.cluster").agg(
        F.count("*").alias("n"), *(F.expr(f"sum(point[{i}]) AS sum_{i}") for i in range(size))
    )
    moved = list(centroids)
    for row in sums.collect():
        moved[row.cluster] = [row[f"sum_{i}"] // row.n for i in range(size)]
    return moved


def _lookup(values: list, kind: str) -> Column:
    """The value of the row's cluster, out of k literals."""
    if not values:
        return F.lit(None).cast(kind)
    return F.array(*(F.lit(v).cast(kind) for v in values))[F.col("cluster")]


def _fits(total: int | None) -> int | None:
    return total if total is not None and total < 1 << 63 else None
