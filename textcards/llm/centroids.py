"""Operator 11: clustering around centroids, in JVM expressions on integers.

Each component x of a vector becomes the integer floor(scale * x), so every
distance, sum and centroid is exact and does not depend on partitions.

1. The first centroids are the ``k`` vectors whose id has the smallest salted
   SHA-256 (equal hashes: the smaller vector).
2. A round is one pass: ``zip_with`` and ``aggregate`` give the squared distance
   to every centroid, which are literal arrays of the plan; ``array_min`` of the
   structs (distance, number) is the choice, so ties take the smaller number;
   a column sum per component, grouped by cluster, is combined inside each task
   before at most ``k`` rows per task are shuffled.
3. The new centroid is floor(sum / count), computed from the ``k`` returned
   rows; an empty cluster keeps its centroid.
4. After the last round one more pass assigns and is stored; the sums of the
   distances come from the stored rows.

Only ``k`` rows of sums ever reach the driver.  No row moves: the number of rows
of a cluster does not matter.

Cases: vectors that are null, have another number of components, or hold a null,
NaN or infinite component are left out.  Repeated rows are all kept.  A null id
is kept and never starts a centroid while others are there (its hash is null and
sorts last).  Fewer vectors than ``k`` give as many centroids as there are; none,
or an empty table, gives an empty result.  Only the id and the vector are read.
A component of 2**27 or more after scaling stops the job: beyond it a squared
distance may not fit a long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textcards.llm import storage

DIM, SCALE, CLUSTERS, ROUNDS, SALT = 64, 64, 16, 3, "1"
MAX_COMPONENT = 1 << 27


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs."""
    def one(x):
        y = F.lit(float(scale)) * x.cast("double")
        return (F.when(F.abs(y) < F.lit(float(MAX_COMPONENT)), F.floor(y))
                .otherwise(F.raise_error(F.lit("a component is out of the range of exact distances")).cast("long")))
    return F.transform(vector, one)


def finite(vector: Column) -> Column:
    """Not null, and every component neither null, NaN nor infinite."""
    x_ok = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN sorts last
    return vector.isNotNull() & F.forall(vector, x_ok)


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM,
                    scale: int = SCALE) -> DataFrame:
    """``(id, v array<long>)`` of the vectors that take part."""
    v = F.col(vector_col)
    kept = table.select(F.col(id_col).alias("id"), v.alias("x")).where((F.size("x") == dim) & finite(F.col("x")))
    return kept.select("id", whole(F.col("x"), scale).alias("v"))


def literal(centroid) -> Column:
    return F.expr(f"array({', '.join(f'{int(c)}L' for c in centroid)})")


def squared_distance(v: Column, centroid) -> Column:
    """(v - c)^2 summed, as v.v - 2 v.c + c.c: a product a component instead of two differences."""
    dot = F.aggregate(F.zip_with(v, literal(centroid), lambda a, c: a * c), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.col("norm2") - 2 * dot + F.lit(sum(int(c) * int(c) for c in centroid)).cast("long")


def assigned(vectors: DataFrame, centroids) -> DataFrame:
    """``vectors (id, v, norm2)`` with ``near``, the struct (distance, cluster) of its nearest centroid."""
    near = F.array_min(F.array(*[F.struct(squared_distance(F.col("v"), c).alias("distance"),
                                          F.lit(k).alias("cluster")) for k, c in enumerate(centroids)]))
    return vectors.withColumn("near", near)


def moved(vectors: DataFrame, centroids) -> list[list[int]]:
    """The centroids after one round."""
    dim = len(centroids[0])
    sums = assigned(vectors, centroids).groupBy(F.col("near.cluster").alias("cluster")).agg(
        F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)])
    out = [list(c) for c in centroids]
    for r in sums.collect():        # at most a row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def first_centroids(vectors: DataFrame, k: int, salt: str = SALT) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.select("v", order.alias("o")).orderBy(F.col("o").asc_nulls_last(), "v")
            .limit(k).collect()]


@dataclass
class Clustering:
    """``rows``: ``id, cluster, distance``, stored; ``centroids`` as integers;
    ``inertia`` by cluster (0 for an empty one)."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> Clustering:
    """Cluster ``vectors (id, v)``."""
    square = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0).cast("long"), lambda s, x: s + x)
    vectors = storage.cut(vectors.select("id", "v", square.alias("norm2")), "vectors")
    centroids = first_centroids(vectors, k, salt)
    if not centroids:
        rows = vectors.select("id", F.lit(0).alias("cluster"), "norm2").withColumnRenamed("norm2", "distance")
        return Clustering(rows, [], [])
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    rows = storage.cut(assigned(vectors, centroids).select("id", "near.cluster", "near.distance"), "assigned")
    inertia = [0] * len(centroids)
    for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect():
        inertia[r["cluster"]] = r["s"]
    storage.drop(vectors)
    return Clustering(rows, centroids, inertia)


def by_cluster(values) -> Column:
    """The value of the row's cluster, from a literal array."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)


def clustered(table: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    found = cluster(integer_vectors(table))
    names = [F.col("id").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"), "distance"]
    of_cluster, texts = found.inertia or [0], [",".join(map(str, c)) for c in found.centroids] or [""]
    return found.rows.select(
        *names, by_cluster(of_cluster).cast("long").alias("cluster_inertia"),
        F.lit(sum(of_cluster)).cast("long").alias("inertia"), F.sha2(by_cluster(texts), 256).alias("centroid_sha256"))
