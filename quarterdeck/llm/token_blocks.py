"""Token ids in files of patched frame-of-reference blocks.

A file is a Parquet table with a row per segment: the documents in it, an index of its
blocks and the packed bytes. A block holds BLOCK ids: their minimum is subtracted, the
rest is packed at the width that a percentile of them needs, and what is wider goes to
an exception list (position in the block, high bits). The index has each block's minimum,
width, exceptions and starts, so a reader decodes only the blocks it asks for.

Documents are dealt out by ranges of their id and sorted, so shard after shard the ids
ascend. A document never crosses segments, and a segment ends with the document that
fills it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarterdeck.llm.byte_words import byte_level
from quarterdeck.llm.common import texts_of

#: Ids in a block, and ids after which a segment ends with the document it is in.
BLOCK, SEGMENT = 1024, 1 << 18
INDEX = np.dtype([("start", "<u4"), ("exceptions_start", "<u4"), ("minimum", "<u4"), ("exceptions", "<u2"), ("width", "u1")])
#: Widths at which the packed values are machine integers.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
SEGMENTS = pa.schema([
    ("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("block_index", pa.binary()),
    ("packed", pa.binary()), ("positions", pa.binary()), ("highs", pa.binary())])
SEGMENT_DDL = ("shard int, segment int, start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, "
               "block_index binary, packed binary, positions binary, highs binary")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each non-negative value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack_rows(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width, packed into rows of BLOCK * width / 64 words."""
    if width in WHOLE:
        return rows.astype(WHOLE[width]).view("<u8")
    groups = rows.reshape(len(rows), BLOCK // 64, 64).astype(np.uint64)
    words = np.zeros((len(rows), BLOCK // 64, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, :, word] |= groups[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, word + 1] |= groups[:, :, j] >> np.uint64(64 - shift)
    return words.reshape(len(rows), -1)


def _unpack_rows(words: np.ndarray, width: int) -> np.ndarray:
    if width in WHOLE:
        return words.view(WHOLE[width]).astype(np.uint64)
    groups = words.reshape(len(words), BLOCK // 64, width)
    rows = np.empty((len(words), BLOCK // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = groups[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | groups[:, :, word + 1] << np.uint64(64 - shift)
        rows[:, :, j] = value & mask
    return rows.reshape(len(words), BLOCK)


def pack(ids: np.ndarray, percentile: float = 0.95) -> tuple[bytes, bytes, bytes, bytes]:
    """(block index, packed bytes, exception positions, exception high bits) of unsigned 32-bit ids."""
    count = -(-len(ids) // BLOCK)
    index = np.zeros(count, INDEX)
    if not count:
        return index.tobytes(), b"", b"", b""
    rows = np.pad(ids, (0, count * BLOCK - len(ids)), "edge").reshape(count, BLOCK)
    index["minimum"] = rows.min(axis=1)
    rows = rows - index["minimum"][:, None]
    place = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    index["width"] = _bits(np.partition(rows, place, axis=1)[:, place])
    width = index["width"][:, None]
    high = np.where(width < 32, rows >> np.minimum(width, 31), 0)
    at_block, at_place = np.nonzero(high)
    index["exceptions"] = np.bincount(at_block, minlength=count)
    index["exceptions_start"] = np.cumsum(index["exceptions"]) - index["exceptions"]
    sizes = index["width"].astype(np.int64) * (BLOCK // 8)
    index["start"] = np.cumsum(sizes) - sizes
    packed = [b""] * count
    for width in np.unique(index["width"]):
        own = np.flatnonzero(index["width"] == width)
        if width:
            low = rows[own] & np.uint32((1 << int(width)) - 1)
            for block, words in zip(own, _pack_rows(low, int(width)), strict=True):
                packed[block] = words.tobytes()
    return index.tobytes(), b"".join(packed), at_place.astype("<u2").tobytes(), high[at_block, at_place].astype("<u4").tobytes()


def unpack(index: bytes, packed: bytes, positions: bytes, highs: bytes, start: int, stop: int) -> np.ndarray:
    """The ids at [start, stop) of a segment; only their blocks are decoded."""
    first, last = start // BLOCK, -(-stop // BLOCK)
    blocks = np.frombuffer(index, INDEX)[first:last]
    rows = np.zeros((len(blocks), BLOCK), np.uint64)
    for width in np.unique(blocks["width"]):
        if width:
            own, size = np.flatnonzero(blocks["width"] == width), int(width) * (BLOCK // 8)
            words = b"".join(packed[s:s + size] for s in blocks["start"][own].tolist())
            rows[own] = _unpack_rows(np.frombuffer(words, "<u8").reshape(len(own), -1), int(width))
    if len(blocks) and (total := int(blocks["exceptions"].sum())):
        at = slice(int(blocks["exceptions_start"][0]), int(blocks["exceptions_start"][0]) + total)
        block = np.repeat(np.arange(len(blocks)), blocks["exceptions"])
        rows[block, np.frombuffer(positions, "<u2")[at]] |= (
            np.frombuffer(highs, "<u4")[at].astype(np.uint64) << blocks["width"][block].astype(np.uint64))
    rows += blocks["minimum"][:, None]
    return rows.reshape(-1)[start - first * BLOCK:stop - first * BLOCK].astype("<u4")


def _writer(tokenizer: str, end_id: int, percentile: float):
    def segments(batches) -> Iterator[pa.RecordBatch]:
        shard, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        docs, lengths, ids, held, start, number = [], [], [], 0, 0, 0

        def segment():
            values = np.frombuffer(b"".join(ids), "<u4")
            row = [shard, number, start, len(values), docs, lengths, *pack(values, percentile)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENTS, strict=True)], schema=SEGMENTS)

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for ident, found in zip(batch.column("doc_id").to_pylist(), byte_level(tokenizer).encode_all(texts), strict=True):
                docs.append(ident)
                ids.append(found + end)
                lengths.append(len(ids[-1]) // 4)
                held += lengths[-1]
                if held >= SEGMENT:
                    yield segment()
                    docs, lengths, ids, held, start, number = [], [], [], 0, start + held, number + 1
        if docs:
            yield segment()

    return segments


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, percentile: float = 0.95,
                 key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, end each with ``end_id`` and write the files at ``path`` in ascending id order.

    A null or empty text is the end id alone. Rows without an id come first; rows that share an id, or have
    none, follow each other by the xxhash64 of their text, and so fill many tasks. Further columns are left out. An
    empty table gives files without segments.
    """
    docs = texts_of(df, key, text).withColumn("tie", F.xxhash64("text"))
    (docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
     .mapInArrow(_writer(tokenizer, end_id, percentile), SEGMENT_DDL).write.parquet(path))


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with their place in the whole output; one row per shard is summed up in order."""
    segments = spark.read.schema(SEGMENT_DDL).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # broadcast, as it has one row per shard: as many as there were write tasks, whatever the number of ids
    bases = shards.select("shard", before.alias("base"))
    return segments.join(F.broadcast(bases), "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _documents(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["block_index"], row["packed"], row["positions"], row["highs"], 0, row["n_tokens"])
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            data = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"], pa.int64()),
                pa.array(row["lengths"], pa.int64()), pa.array(data, pa.binary())], schema=_DOCS)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start, n_tokens and ids (little-endian unsigned 32-bit), as the files hold them."""
    return _segments(spark, path).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """The ids at [first, first + count) of the whole output: start and ids of each touched segment.

    Other segments are filtered out by their numbers, and of a touched one only the
    blocks in the range are decoded.
    """
    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                low = max(first - row["start"], 0)
                high = min(first + count - row["start"], row["n_tokens"])
                ids = unpack(row["block_index"], row["packed"], row["positions"], row["highs"], low, high)
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + low], pa.int64()), pa.array([ids.tobytes()], pa.binary())],
                                                 names=["start", "ids"])

    touched = (F.col("start") < first + count) & (F.col("start") + F.col("n_tokens") > first)
    return _segments(spark, path).where(touched).mapInArrow(cut, "start long, ids binary")
