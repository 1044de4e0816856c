"""Lines that repeat across documents, answered by keep bitmaps.

The key of a line is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z
lower-cased. Keys of at least ``min_chars`` code points are hashed to 128 bits, and only
hashes, ids and positions travel. They are dealt out by ranges of (hash, document,
position) and sorted, so a key that a third of all lines share fills many tasks. A task
streams over its rows: the first document of a run of equal hashes owns the key, later
ones lose the line. Only the first run of a task may have begun in an earlier one; of
that run only the lines of its first document are open, and they are settled by the
first and last runs of all tasks, two rows each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterdeck.llm.common import SPACES, rows_out, texts_of, utf8
from quarterdeck.session import pin

#: Stands for a missing id, which comes after all others.
NO_ID = (1 << 63) - 1
LINE, DROPPED, OPEN, EDGE = 0, 1, 2, 3
_KEYS = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("position", pa.int32())])
_VERDICTS = pa.schema([("kind", pa.int8()), *_KEYS])
_BITMAPS = pa.schema([("doc", pa.int64()), ("body", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc, body, text: a row is known by its id and a hash of its text, so rows that repeat an id stay apart."""
    return texts_of(df, key, text).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("body"), "text")


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _keys(min_chars: int):
    def of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, docs, bodies, positions = [], [], [], []
            for doc, body, text in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), utf8(batch, "text"), strict=True):
                for position, line in enumerate(text.split(b"\n")):
                    key = line.strip(SPACES).lower()
                    if _long_enough(key, min_chars):
                        hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                        docs.append(doc)
                        bodies.append(body)
                        positions.append(position)
            pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                (pairs[:, 0].copy(), pairs[:, 1].copy(), docs, bodies, positions), _KEYS, strict=True)], schema=_KEYS)

    return of


def _first_occurrences(batches) -> Iterator[pa.RecordBatch]:
    """The lines that go, the open ones, and the edges of this task."""
    head = run = None  # (high, low) and the first document, of the first and of the current run
    for batch in batches:
        columns = {n: batch.column(n).to_numpy() for n in _KEYS.names}
        high, low, doc = columns["high"], columns["low"], columns["doc"]
        if not len(doc):
            continue
        begins = np.ones(len(doc), bool)
        begins[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        begins[0] = run is None or run[:2] != (high[0], low[0])
        if head is None:
            head = (high[0], low[0], doc[0])
        at = np.maximum.accumulate(np.where(begins, np.arange(len(doc)), -1))
        owner = np.where(at < 0, run[2] if run else 0, doc[at])
        kind = np.full(len(doc), LINE, np.int8)
        kind[doc != owner] = DROPPED
        kind[(high == head[0]) & (low == head[1]) & (doc == head[2])] = OPEN
        run = (high[-1], low[-1], owner[-1])
        told = kind != LINE
        if told.any():
            yield pa.RecordBatch.from_arrays([pa.array(kind[told])] + [pa.array(columns[n][told]) for n in _KEYS.names], schema=_VERDICTS)
    if head is not None:
        yield from rows_out([(EDGE, int(h), int(w), int(d), 0, -1) for h, w, d in (head, run)], _VERDICTS)


def _bitmaps(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, body, positions in zip(*(batch.column(n).to_pylist() for n in ("doc", "body", "positions")), strict=True):
            keep = np.ones(-(-(max(positions) + 1) // 8) * 8, np.uint8)
            keep[positions] = 0
            rows.append((doc, body, len(positions), zlib.compress(np.packbits(keep, bitorder="little").tobytes())))
        yield from rows_out(rows, _BITMAPS)


def _keep_bitmaps(docs: DataFrame, min_chars: int) -> DataFrame:
    # written once, as the range partitioner reads its input twice
    keys = pin(docs.mapInArrow(_keys(min_chars), "high long, low long, doc long, body long, position int"), "lines")
    order = ["high", "low", "doc", "body", "position"]
    verdicts = pin(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _first_occurrences, "kind byte, high long, low long, doc long, body long, position int"), "verdicts")
    owners = verdicts.where(F.col("kind") == EDGE).groupBy("high", "low").agg(F.min("doc").alias("owner"))
    settled = verdicts.where(F.col("kind") == OPEN).join(owners, ["high", "low"]).where("owner < doc")
    dropped = verdicts.where(F.col("kind") == DROPPED).select("doc", "body", "position").unionAll(
        settled.select("doc", "body", "position"))
    return dropped.groupBy("doc", "body").agg(F.collect_set("position").alias("positions")).mapInArrow(
        _bitmaps, "doc long, body long, n_dropped long, keep binary")


def keep_bitmaps(df: DataFrame, min_chars: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, body, n_dropped, keep for each document that loses lines.

    ``keep`` holds a bit per line, lowest bit first, compressed with zlib; lines beyond its end stay.
    ``body`` is the xxhash64 of the text, which tells rows with the same id apart. Keys found in two or more
    documents stay in the smallest id, all their lines there included. A missing id comes after all others.
    """
    found = _keep_bitmaps(_documents(df, key, text), min_chars)
    return found.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "body", "n_dropped", "keep")


def _apply(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, dropped, sizes = [], [], [], []
        for text, keep in zip(utf8(batch, "text"), batch.column("keep").to_pylist(), strict=True):
            lines.append(text.count(b"\n") + 1)
            dropped.append(0)
            sizes.append(len(text))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
                stay = np.ones(max(lines[-1], len(bits)), np.uint8)
                stay[:len(bits)] = bits
                text = b"\n".join(line for line, s in zip(text.split(b"\n"), stay.tolist(), strict=False) if s)
                dropped[-1] = lines[-1] - int(stay[:lines[-1]].sum())
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()),
                                          pa.array(dropped, pa.int64()), pa.array(sizes, pa.int64())], names=["rest", "text", "n_lines", "n_dropped", "size"])


def _applied(df: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """rest (a struct of the other columns), text, n_lines, n_dropped, size (bytes before)."""
    bitmaps = _keep_bitmaps(_documents(df, key, text), min_chars).select("doc", "body", "keep")
    own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    rows = df.select(rest.alias("rest"), own.alias("text"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(own).alias("body"))
    joined = rows.join(bitmaps, ["doc", "body"], "left").select("rest", "text", "keep")
    return joined.mapInArrow(_apply, T.StructType([joined.schema["rest"], joined.schema["text"], *(
        T.StructField(c, T.LongType()) for c in ("n_lines", "n_dropped", "size"))]))


def drop_repeated_lines(df: DataFrame, min_chars: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text without the lines that go, n_lines, n_dropped.

    A null or empty text is one empty line. Other lines stay as they are, joined by line ends. Rows that
    repeat an id are parts of the same document. A missing id comes after all others. Further columns are
    left out. An empty table gives an empty result.
    """
    kept = _applied(df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), min_chars, "doc_id", "text")
    return kept.select("rest.doc_id", "text", "n_lines", "n_dropped")


def without_repeated_lines(df: DataFrame, min_chars: int = 10, key: str = "doc_id", text: str = "text", least_left: float = 0.0) -> DataFrame:
    """``df`` with all its columns, the lines that go taken out of ``text``; a null text becomes empty.

    Rows that lose lines and keep less than ``least_left`` of their bytes go as well; 0 keeps all rows.
    """
    kept = _applied(df, min_chars, key, text).where((F.col("n_dropped") == 0) | (F.octet_length("text") >= F.col("size") * least_left))
    return kept.select(*[F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`") for c in df.columns])
