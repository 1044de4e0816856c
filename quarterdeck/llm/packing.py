"""Packing documents into sequences of a fixed length, with bounds that certify the result.

Pieces are dealt out at random, each partition packs its own by best-fit decreasing, and
lower bounds from dual-feasible functions tell whether it needs fewer sequences at all.
Partitions with a gap, and everywhere the sequences that an open piece may still improve, give
their pieces to the next round, which deals them out anew. No round gives a partition more
pieces than the first did. The rounds end when one partition held all that was left, or
when a round saved no sequence; what it packed again then stays as it was.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.common import rows_out, texts_of
from quarterdeck.llm.word_cache import space_dropping
from quarterdeck.session import pin

#: Pieces that one task packs at a time, and the share of a sequence that may stay free in a closed one.
AT_ONCE, FREE = 1 << 16, 1 / 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, certified boolean, open boolean, free long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64())])


def _cutter(tokenizer: str, end_id: int, capacity: int):
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for ident, ids in zip(batch.column("doc_id").to_pylist(), map(space_dropping(tokenizer).encode, texts), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at:at + size]
                    yield ident, piece, at // 4, len(part) // 4, zlib.crc32(part)

    return lambda batches: rows_out(rows(batches), _PIECES)


def pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: a document whole if it fits, else cut at every ``capacity`` tokens."""
    return texts_of(df, key, text).mapInArrow(_cutter(tokenizer, end_id, capacity), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (sequence, offset) of each piece and the number of sequences.

    Open sequences stand in stacks by free room; the bits of one integer tell which
    stacks hold any, so the tightest fit is its lowest set bit from the length on.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        if fits := rooms >> length:
            room = length + (fits & -fits).bit_length() - 1
            own = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, own, count = capacity, count, count + 1
        sequence[i], offset[i] = own, capacity - room
        left = room - length
        stacks[left].append(own)
        rooms |= 1 << left
    return sequence, offset, count


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 32) -> int:
    """The most that the dual-feasible functions below prove; no packing has fewer sequences.

    Threshold functions count a piece above ``capacity - t`` as a whole sequence and drop those below ``t``;
    staircase functions round a piece up to k-ths.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    t = np.arange(0, capacity // 2 + 1)
    wholes = number[capacity + 1] - number[capacity - t + 1]
    middle = total[capacity - t + 1] - total[t]
    best = int(np.max(wholes + -(-middle // capacity)))
    for k in range(1, steps + 1):
        scaled = (k + 1) * sizes
        exact = scaled % capacity == 0
        # in units of capacity * k: an exact multiple keeps its size, others are rounded down to whole k-ths
        value = np.where(exact, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def _packer(capacity: int, number: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        # one order whatever the shuffle brought, so that a task that runs again does the same
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        sequence, offset, count = best_fit(lengths, capacity)
        filled = np.bincount(sequence, weights=lengths, minlength=count)
        gap = count > lower_bound(lengths, capacity)
        loose = filled < capacity if gap else filled < capacity * (1 - FREE)
        base = (number << 52) + (int(group["part"].iloc[0]) << 24)
        return group.drop(columns="part").assign(sequence_id=base + sequence, offset=offset, certified=not gap, open=loose[sequence],
                                                  free=(capacity - filled[sequence]).astype(np.int64))

    return pack


def pack(found: DataFrame, capacity: int, at_once: int = AT_ONCE) -> DataFrame:
    """Place each piece: the columns of PIECES with sequence_id, offset and certified.

    ``certified``: the partition that packed it last met its lower bound. A partition packs about
    ``at_once`` pieces at most, in every round. An empty table gives an empty result.
    """
    pool, closed, number, before, held = pin(found, "pieces"), [], 0, None, 0
    while True:
        parts = max(1, -(-pool.count() // at_once))
        # by the place in the written files, so that copies of a row are spread too
        seed = F.xxhash64(F.monotonically_increasing_id(), F.lit(number))
        packed = pin(pool.withColumn("part", F.pmod(seed, F.lit(parts)).cast("long")).groupBy("part")
                     .applyInPandas(_packer(capacity, number), PACKED), "packed")
        # each sequence has one piece at its begin
        count, smallest = packed.agg(F.count_if(F.col("offset") == 0), F.min(F.when(F.col("open"), F.col("length")))).first()
        if before is not None and count >= held:
            closed.append(before)
            break
        if parts == 1 or smallest is None:
            closed.append(packed)
            break
        # where the bound is met, exchanging pieces saves nothing, and room below the smallest of them takes none
        stays = F.col("open") & (~F.col("certified") | (F.col("free") >= smallest))
        closed.append(packed.where(~stays))
        before, number = packed.where(stays), number + 1
        held = before.where("offset = 0").count()
        pool = before.select("doc_id", "piece", "start", "length", "ids_crc32")
    out = closed[0]
    for part in closed[1:]:
        out = out.unionAll(part)
    return out.drop("open", "free")


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    A null or empty text is its end id alone. Rows that repeat an id are documents of their own; a
    missing id stays missing. Further columns are left out.
    """
    return pack(pieces(df, tokenizer, end_id, capacity, key, text), capacity)
