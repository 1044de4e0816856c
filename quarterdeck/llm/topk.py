"""Exact top-k by inner product, one term at a time.

Candidates and queries are dealt out to blocks of bounded size, and each pair of blocks
is one task's work: a posting list per term holds the candidates with that component,
each query scatters weight x postings into a dense array of scores, and a partition
selection keeps its best. The best of all blocks are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and components of candidates in a block at most, and candidates in one from which on blocks are split among idle tasks.
MOST, COMPONENTS, LEAST = 1 << 16, 1 << 22, 1 << 13
#: Stands for a missing id, which comes after all others.
NO_ID = (1 << 63) - 1
_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    fine = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine, F.lit(False))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the vectors as rows; shorter ones end in zeros."""
    column = table.column("vector").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.zeros((len(sizes), int(sizes.max(initial=0))), column.type.value_type.to_pandas_dtype())
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return table.column("id").to_numpy(), rows


def best_of_block(query_ids, queries, ids, vectors, k: int):
    """(query ids, ids, scores): the k best candidates of the block for each query."""
    order = np.argsort(ids, kind="stable")
    ids, vectors, queries = ids[order], vectors[order], queries.astype(np.int64)
    postings = [(at, vectors[at, term]) for term in range(vectors.shape[1]) for at in [np.flatnonzero(vectors[:, term])]]
    out = []
    for query_id, query in zip(query_ids, queries, strict=True):
        scores = np.zeros(len(ids), np.int64)
        for term in np.flatnonzero(query[:len(postings)]):
            at, weights = postings[term]
            if len(at) == len(ids):
                scores += query[term] * weights
            else:
                scores[at] += query[term] * weights
        own = np.flatnonzero(ids != query_id)
        if len(own) > k:
            least = np.partition(scores[own], len(own) - k)[len(own) - k]
            above, level = own[scores[own] > least], own[scores[own] == least]
            own = np.concatenate([above, level[:k - len(above)]])  # ids ascend, so ties go to the smaller ones
        out.append((np.full(len(own), query_id), ids[own], scores[own]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _cell(k: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _BEST.empty_table()
        columns = best_of_block(*_matrix(left), *_matrix(right), k)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_BEST)

    return best


def _extent(df: DataFrame) -> tuple[int, int, int]:
    """Rows, a bound of their components' sizes, and the longest vector's length."""
    largest = F.greatest(F.array_max("vector"), F.bitwise_not(F.array_min("vector")))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(largest).alias("largest"), F.max(F.size("vector")).alias("size")).first()
    return row["n"], 0 if row["largest"] is None else row["largest"] + 1, max(row["size"] or 0, 0)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, query_block: int = 8192, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to the smaller vec_id.

    Both frames hold (id long, vector array<long>); missing components count as zero. Where sums could exceed 64
    bits it fails. A query's own row is the candidate with its id. Repeated query rows count once; repeated
    candidates are candidates of their own. A missing candidate id comes after all others. A
    query without candidates has no rows.

    A candidate is sent once for every ``query_block`` queries, a query once for every block of candidates; a block
    holds as many as 16 MB take where 32 bits are enough for a component.
    """
    queries = queries.where("id IS NOT NULL").dropDuplicates(["id"])
    candidates = candidates.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "vector")
    (rows, most, size), (asked_rows, asked_most, asked_size) = _extent(candidates), _extent(queries)
    if most * asked_most * min(size, asked_size) >= 1 << 63:
        raise ValueError(f"sums of {min(size, asked_size)} products of components up to {most} and {asked_most} may exceed 64 bits")
    block = block or min(MOST, max(1, COMPONENTS // max(1, size)))
    tasks = candidates.sparkSession.sparkContext.defaultParallelism
    columns, lines = max(1, -(-rows // block), min(tasks, -(-rows // LEAST))), max(1, -(-asked_rows // query_block))
    small = F.col("vector").cast("array<int>" if max(most, asked_most) < 1 << 31 else "array<bigint>").alias("vector")
    spread = candidates.select(
        F.pmod(F.xxhash64("id", "vector"), F.lit(columns)).alias("column"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lines - 1).cast("long"))).alias("line"), "id", small)
    asked = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("column"),
        F.pmod(F.xxhash64("id"), F.lit(lines)).alias("line"), "id", small)
    best = asked.groupBy("column", "line").cogroup(spread.groupBy("column", "line")).applyInArrow(
        _cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
