"""Joins on keys of which one may hold a large share of all rows.

Spark splits a skewed partition by itself where both inputs of a join come
straight from a shuffle. A side that was aggregated on the same keys, and a chain
of joins on the same keys, keep their partitioning and are not split. There the
heavy keys are found first and spread over several partitions by a salt.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.panel import column

SALT = "_salt"


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*[column(k) for k in keys])


def heavy_keys(df: DataFrame, keys: list[str], share: float = 0.01) -> dict[int, float]:
    """Hash and share of every key that holds at least ``share`` of the rows.

    Two passes over the key columns alone. The first keeps at most 1 / share
    candidates, among them all heavy keys; the second counts those exactly.
    """
    hashes = df.select(_hash(keys).alias("_h"))
    found = hashes.freqItems(["_h"], share).first()[0]
    if not found:
        return {}
    counts = (hashes.groupBy(F.when(F.col("_h").isin(*found), F.col("_h")).alias("_h"))
              .agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(r["n"] for r in counts)
    return {r["_h"]: r["n"] / total for r in counts if r["_h"] is not None and r["n"] >= share * total}


def spread(left: DataFrame, rights: list[DataFrame], keys: list[str],
           heavy: dict[int, float] | None = None) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """Salt the ``heavy`` keys of ``left`` and repeat their rows in each of ``rights``.

    ``heavy`` is what ``heavy_keys`` returns; a caller that knows of heavy keys passes it, and without it
    nothing is read and nothing is changed. Returns the frames and the keys to join them on. Each key is
    spread over as many partitions as its own rows would fill. The salt depends on the row and on its input
    partition, so copies of a row are spread too, and a task that is run again draws the same salts.
    """
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = {h: n for h, s in (heavy or {}).items() if (n := math.ceil(s * partitions)) > 1}
    if not salts:
        return left, rights, keys
    by_hash = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
    count = F.coalesce(F.try_element_at(by_hash, _hash(keys)), F.lit(1))
    draw = F.pmod(F.xxhash64(F.spark_partition_id(), *[column(c) for c in left.columns]), count).cast("int")
    every = F.explode(F.sequence(F.lit(0), count - 1))
    return left.withColumn(SALT, draw), [r.withColumn(SALT, every) for r in rights], [*keys, SALT]


def equal_keys(keys: list[str], renamed: dict[str, str], null_safe: bool = True) -> Column:
    """The condition that ``keys`` equal their renamed counterparts."""
    same = [column(k).eqNullSafe(column(renamed[k])) if null_safe else column(k) == column(renamed[k]) for k in keys]
    return reduce(lambda a, b: a & b, same)
