"""SentencePiece encoding that keeps the place of every piece in the original text.

The model file's normaliser is read here: at each place the longest key of the compiled
character map is replaced, otherwise one character stays, and each byte of the normalised
text remembers the byte of the original it came from. The sentencepiece library gives the
pieces; their lengths in the normalised text, laid end to end, are projected through
that alignment to byte spans of the original.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.common import texts_of, worker_store

SPACE = "▁".encode()
#: Numbers of the fields of a model file that are read here, and the kinds of pieces (fixed values of the format).
PIECES, NORMALISER = 1, 3
PIECE, KIND = 1, 3
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
UNKNOWN, BYTE = 2, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, data[at:at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 keys, and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]
        # the bytes that a key may begin with: others need no look-up
        self.first = {b for b in range(1, 256) if self.units and self._step(self._offset(self.units[0]), b) is not None}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, base: int, byte: int) -> int | None:
        """The unit that ``byte`` leads to."""
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & (1 << 31 | 255) == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key at ``at``."""
        if text[at] not in self.first:
            return None
        found, base = None, self._offset(self.units[0])
        for end in range(at, len(text)):
            here = self._step(base, text[end])
            if here is None:
                break
            unit = self.units[here]
            base = here ^ self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[base] & ((1 << 31) - 1)
                found = end + 1 - at, self.texts[value:self.texts.index(b"\0", value)]
        return found


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.read_normaliser(b"".join(v for n, v in fields if n == NORMALISER))
        pieces = [dict(_fields(v)) for n, v in fields if n == PIECES]
        self.unknown = next(i for i, p in enumerate(pieces) if p.get(KIND) == UNKNOWN)
        self.sizes = np.array([1 if p.get(KIND) == BYTE else len(p[PIECE]) for p in pieces], np.int64)
        self.end = self.library.eos_id()

    def read_normaliser(self, message: bytes) -> None:
        normaliser = dict(_fields(message))
        self.map = CharacterMap(normaliser.get(CHARACTER_MAP, b""))
        self.prefix, self.squeeze = normaliser.get(DUMMY_PREFIX, 1), normaliser.get(REMOVE_EXTRA_SPACES, 1)
        self.space = SPACE if normaliser.get(ESCAPE_SPACES, 1) else b" "

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the place in the original."""
        if not self.map.first and not self.squeeze:
            return self._spaces_only(text)
        parts, places, at, after_space = [], [], 0, bool(self.squeeze)
        size = len(text)
        while at < size:
            found = self.map.longest(text, at)
            if found is None:
                lead = text[at]
                step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = step, text[at:at + step]
            new = found[1]
            while after_space and new.startswith(b" "):
                new = new[1:]
            if new:
                shown = new.replace(b" ", self.space)
                if not parts and self.prefix:
                    shown = self.space + shown
                parts.append(shown)
                places.append(np.full(len(shown), at, np.int64))
                after_space = bool(self.squeeze) and new.endswith(b" ")
            elif found[1] and not self.squeeze:
                after_space = False
            at += found[0]
        normal, end = b"".join(parts), size
        place = np.concatenate([*places, [end]]) if parts else np.array([end])
        if self.squeeze:
            while normal.endswith(self.space):
                normal = normal[:-len(self.space)]
                end = int(place[len(normal)])
            place = np.append(place[:len(normal)], end)
        return normal, place

    def _spaces_only(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map and with spaces kept, only the prefix and the escape of spaces are left."""
        if not text:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(text, np.uint8)
        place = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(self.space), 1))
        prefix = self.space if self.prefix else b""
        return prefix + text.replace(b" ", self.space), np.concatenate([np.zeros(len(prefix), np.int64), place, [len(raw)]])

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans in the original of each piece; a byte piece covers its byte."""
        numbers = np.array(ids, np.int64)
        sizes = self.sizes[numbers]
        if (numbers == self.unknown).any():
            sizes = np.array([len(p.encode()) if i == self.unknown else s for i, s, p in zip(
                ids, sizes.tolist(), self.library.encode(text, out_type=str), strict=True)], np.int64)
        normal, place = self.normalise(text.encode())
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return place[ends - sizes], place[ends]


def model(path: str) -> Model:
    return worker_store(("pieces", path), lambda: Model(path))


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                     ("spans_crc32", pa.int64())])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()),
                                    pa.array(np.concatenate(rows).astype(np.int32), pa.int32()))


def _encoder(path: str, at_once: int):
    def encode(batches) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            idents, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            edges = np.cumsum([0, *map(len, texts)]) // at_once
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(edges[:-1])) + 1) if texts else ():
                some = [texts[i] for i in part]
                found = own.library.encode(some, num_threads=1)
                spans = [own.spans(t, ids) for t, ids in zip(some, found, strict=True)]
                sizes = [len(t.encode()) for t in some]
                starts = [np.append(s, n).astype("<u4") for (s, _), n in zip(spans, sizes, strict=True)]
                ends = [np.append(e, n).astype("<u4") for (_, e), n in zip(spans, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([idents[i] for i in part], pa.int64()),
                    _lists([np.array([*ids, own.end], np.int32) for ids in found]),
                    _lists(starts), _lists(ends),
                    pa.array([zlib.crc32(e, zlib.crc32(s)) for s, e in zip(starts, ends, strict=True)], pa.int64())], schema=_ENCODED)

    return encode


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", at_once: int = 1 << 19) -> DataFrame:
    """Per row doc_id, ids with the end id, and the byte spans (starts, ends) of each piece in the text.

    ``spans_crc32`` is the crc32 of all starts, then all ends, as little-endian unsigned 32-bit integers.
    The end id covers the empty span at the end. A null or empty text is the end id alone. Rows that
    repeat an id stay rows of their own; further columns are left out.
    """
    return texts_of(df, key, text).mapInArrow(
        _encoder(path, at_once), "doc_id long, ids array<int>, starts array<int>, ends array<int>, spans_crc32 long")


def decode(path: str, ids) -> F.Column:
    """The text of a column of ids, as the library decodes them; null for null."""
    @F.pandas_udf("string")
    def decoded(rows):
        own = model(path).library
        return rows.map(lambda x: None if x is None else own.decode(x.tolist()))

    return decoded(ids)
