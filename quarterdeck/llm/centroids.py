"""Centroid clustering of whole-number vectors, by Spark's own expressions.

The centroids are literal arrays in the plan. zip_with and aggregate give a vector's squared distance to each of them, the
least of the structs (distance, number) is its cluster, and one sum for each component moves the centroids. A round sends
one row a cluster to the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.topk import usable, whole_numbers
from quarterdeck.session import pin


@dataclass(frozen=True)
class Centroids:
    """Whole-number centroids, numbered from 0."""

    rows: tuple[tuple[int, ...], ...]

    def nearest(self, vector: Column) -> Column:
        """struct(distance, cluster): the squared distance to the nearest centroid and its number, ties to the smaller one."""
        def to(number: int, centroid: tuple[int, ...]) -> Column:
            literal = F.expr(f"array({', '.join(f'{c}L' for c in centroid)})")
            squares = F.zip_with(vector, literal, lambda x, c: (x - c) * (x - c))
            distance = F.aggregate(squares, F.lit(0).cast("long"), lambda total, square: total + square)
            return F.struct(distance.alias("distance"), F.lit(number).alias("cluster"))

        return F.array_min(F.array(*[to(n, c) for n, c in enumerate(self.rows)]))

    def digest(self, number: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[number])).encode()).hexdigest()


def whole_vectors(df: DataFrame, size: int, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vector: floor(scale * x) of each component, of the vectors with exactly ``size`` components, all finite.

    Other vectors, null ones among them, are left out, and so are further columns. A component too large for
    squared distances in 64 bits fails the job.
    """
    most = math.isqrt(((1 << 63) - 1) // (4 * size))
    fine = usable(F.col(f"`{vector}`")) & (F.size(F.col(f"`{vector}`")) == size)
    checked = lambda x: F.when(F.abs(x) <= most, x).otherwise(F.raise_error(F.lit("a component is too large for whole-number distances")))
    rows = df.where(fine).select(F.col(f"`{key}`").cast("long").alias("id"), whole_numbers(F.col(f"`{vector}`"), scale).alias("vector"))
    return rows.withColumn("vector", F.transform("vector", checked))


def first_centroids(vectors: DataFrame, k: int, prefix: str) -> Centroids:
    """The k vectors with the smallest sha256 of ``prefix`` and the id; rows of one id follow by their components, those without come last."""
    drawn = vectors.orderBy(F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")), 256).asc_nulls_last(), "vector").limit(k)
    return Centroids(tuple(tuple(r["vector"]) for r in drawn.collect()))


def moved(vectors: DataFrame, centroids: Centroids, size: int) -> Centroids:
    """Each centroid becomes the componentwise floor of its vectors' mean; one without vectors stays."""
    parts = vectors.select("vector", centroids.nearest(F.col("vector"))["cluster"].alias("cluster")).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(vector[{i}]) AS s{i}") for i in range(size)])
    rows = list(centroids.rows)
    for r in parts.collect():  # one row a cluster
        rows[r["cluster"]] = tuple(r[f"s{i}"] // r["n"] for i in range(size))
    return Centroids(tuple(rows))


def fit(vectors: DataFrame, size: int, k: int = 8, rounds: int = 10, prefix: str = "3:") -> Centroids:
    """The centroids after ``rounds`` rounds, or after the first that moves none: the others wouldn't either."""
    centroids = first_centroids(vectors, k, prefix)
    for _ in range(rounds if centroids.rows else 0):
        before, centroids = centroids, moved(vectors, centroids, size)
        if centroids == before:
            break
    return centroids


def cluster(df: DataFrame, size: int, k: int = 8, rounds: int = 10, prefix: str = "3:", scale: int = 1024, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    ``whole_vectors`` says which vectors take part. Distances are squared, ties go to the smaller number, the inertias are the
    distances summed over the cluster and over all. With fewer than ``k`` vectors each one starts a cluster.
    Vectors that repeat, with or without an id, are vectors of their own. Without vectors there are no rows.
    """
    vectors = pin(whole_vectors(df, size, scale, key, vector), "vectors")
    centroids = fit(vectors, size, k, rounds, prefix)
    if not centroids.rows:
        return vectors.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *[
            F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    near = pin(vectors.select(F.col("id").alias("vec_id"), centroids.nearest(F.col("vector")).alias("near")).select(
        "vec_id", F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance")), "near")
    # one row a cluster; decimals can't overflow
    sums = {r["cluster"]: int(r["total"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}
    of = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    inside = of([sums.get(n, 0) for n in range(len(centroids.rows))], "long")
    return near.select("vec_id", "cluster", "distance", inside.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"),
                       of([centroids.digest(n) for n in range(len(centroids.rows))], "string").alias("centroid_sha256"))
