"""Alignment of two tokenizers' tokens, and how often their ids meet in a whole corpus.

A text is cut into units that no token of either tokenizer crosses: its words where single spaces part them, else the whole
text. Of a block of documents each distinct unit is encoded once by both tokenizers. The tokens of all units are laid end to
end and sorted by start; where a start reaches the running maximum of the ends, a group of tokens is complete, and
within a group all overlapping pairs are linked.

A block leaves as one row: its documents as numbers of units, its units as numbers of pairs, and its distinct pairs of ids.
Only the distinct pairs of blocks are summed up over the corpus and sent back to them, never the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterdeck.llm.byte_words import AT_ONCE, ByteLevel, Numbers, flat, plain_word
from quarterdeck.llm.common import texts_of, worker_store
from quarterdeck.session import pin

#: A pair of ids is one number, the second id in its lower bits.
SHIFT = 32
MARK = "▁"


class Pieces:
    """Tokenizer B: a sentencepiece model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        # merges cross the end of a word only if a piece goes on behind one
        self.parts_words = not any(MARK in p.lstrip(MARK) for p in pieces)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat(self.library.encode(words, num_threads=1))


def coalesce(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A, group of each B, A of each link, B of each link) of two ascending lists of intervals.

    Groups end where both lists have an end in common. Links are the overlapping pairs, by A and then B.
    """
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.arange(len(start)) >= len(a_start), start))
    reached = np.maximum.accumulate(end[order])
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(np.concatenate([np.zeros(min(1, len(start)), np.int64), start[order][1:] >= reached[:-1]]))
    first = np.searchsorted(b_end, a_start, "right")
    count = np.searchsorted(b_start, a_end, "left") - first
    link_a = np.repeat(np.arange(len(a_start)), count)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return group[:len(a_start)], group[len(a_start):], link_a, link_b


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of consecutive runs of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path, specials=False), Pieces(b_path)
        self.sizes = [np.array(list(map(len, t.bytes)), np.int64) for t in (self.a, self.b)]
        # how an id is written inside a group, and as the last of its kind there; A's ids, then B's
        texts = [f"{i}{mark}" for t, last in ((self.a, "|"), (self.b, ";")) for mark in (",", last) for i in range(len(t.bytes))]
        self.texts = np.array(texts, object)

    def _encode(self, which: int, words: list[str], wholes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all units, their counts, and whether their bytes are those of the unit behind a space."""
        tokenizer, lengths = (self.a, self.b)[which], self.sizes[which]
        parts = [words[i:i + AT_ONCE] for i in range(0, len(words), AT_ONCE)] + [[t] for t in wholes]
        found = [tokenizer.words(p) for p in parts[:len(parts) - len(wholes)]] + [flat([tokenizer.whole(" " * (which == 0) + t)]) for t in wholes]
        fine = []
        for part, (ids, counts) in zip(parts, found, strict=True):
            want = [b" " + unit.encode() for unit in part]
            given, sizes = b"".join(map(tokenizer.bytes.__getitem__, ids.tolist())), _sums(lengths[ids], counts)
            fine.append(sizes == np.fromiter(map(len, want), np.int64, len(want)))
            if given != b"".join(want):
                ends = np.cumsum(sizes).tolist()
                fine[-1] &= [given[s:e] == w for s, e, w in zip([0, *ends], ends, want, strict=False)]
        none = [np.array([], np.int64)]
        return tuple(np.concatenate([*none, *x]) for x in ([f[0] for f in found], [f[1] for f in found])) + (np.concatenate([np.array([], bool), *fine]),)

    def units(self, words: list[str], wholes: list[str]) -> dict:
        """Counts, groups and linked pairs of each unit; a unit that either tokenizer doesn't give back has none and isn't ``fine``."""
        (a, n_a, fine), (b, n_b, fine_b) = (self._encode(which, words, wholes) for which in (0, 1))
        fine &= fine_b
        a, b, n_a, n_b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)], n_a * fine, n_b * fine
        a_end, b_end = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        group_a, group_b, link_a, link_b = coalesce(a_end - self.sizes[0][a], a_end, b_end - self.sizes[1][b], b_end)
        unit_a = np.repeat(np.arange(len(fine)), n_a)
        # a group's tokens in a row, A's before B's; the last of either kind in it closes its list
        group, kind = np.concatenate([group_a, group_b]), np.repeat([0, 1], [len(a), len(b)])
        closes = np.ones(len(group), bool)
        closes[:-1] = group[1:] != group[:-1]
        closes[len(a) - 1:len(a)] = True
        rows = np.concatenate([a + closes[:len(a)] * len(self.a.bytes), 2 * len(self.a.bytes) + b + closes[len(a):] * len(self.b.bytes)])
        written = self.texts[rows[np.lexsort((kind, group))]].tolist()
        ends = np.cumsum(n_a + n_b).tolist()
        texts = ["".join(written[s:e]) for s, e in zip([0, *ends], ends)]
        begins = np.flatnonzero(np.diff(group_a, prepend=-1))
        pairs, link = np.unique(a[link_a] << SHIFT | b[link_b], return_inverse=True)
        count = lambda units: np.bincount(units, minlength=len(fine)).astype(np.int64)
        return {"fine": fine, "n_a": n_a, "n_b": n_b, "n_groups": count(unit_a[begins]), "n_links": count(unit_a[link_a]),
                "texts": texts, "pairs": pairs, "links": link.reshape(-1)}

    def block(self, idents: list, texts: list[str], digest: bool) -> dict:
        """One row for a block of documents."""
        numbers = Numbers()
        if self.b.parts_words:
            coded = [list(map(numbers.__getitem__, t.split(" "))) if t else [] for t in texts]
        else:
            coded = [[] for _ in texts]
        words = list(numbers)
        plain = np.fromiter(map(plain_word, words), bool, len(words))
        parted, odd = plain.tolist(), []
        place = (np.cumsum(plain) - 1).tolist()
        kept = int(plain.sum())
        for i, row in enumerate(coded):
            if row and all(map(parted.__getitem__, row)):
                coded[i] = list(map(place.__getitem__, row))
            elif texts[i]:
                coded[i] = [kept + len(odd)]
                odd.append(texts[i])
        found = self.units([w for w, p in zip(words, parted, strict=True) if p], odd)
        fine = found["fine"].tolist()
        coded = [row if all(map(fine.__getitem__, row)) else [] for row in coded]
        units, sizes = flat(coded)
        times = np.bincount(units, minlength=len(fine))
        heard = np.bincount(found["links"], np.repeat(times, found["n_links"]), len(found["pairs"])).astype(np.int64)
        groups = ["".join(map(found["texts"].__getitem__, row))[:-1] for row in coded]
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        packed = lambda values: pa.compress(values.astype("<u4").tobytes(), "zstd", asbytes=True)
        return {"doc_ids": idents, **{c: _sums(found[c][units], sizes) for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups": groups,
                "sizes": sizes, "n_units": len(fine), "units": packed(units), "unit_links": packed(found["n_links"]),
                "links": packed(found["links"]), "pairs": found["pairs"], "heard": heard}


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in _COUNTS],
                     ("groups", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("n_units", pa.int64()), ("units", pa.binary()),
                     ("unit_links", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("heard", pa.list_(pa.int64()))])
_BLOCKS_DDL = ("block long, doc_ids array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in _COUNTS) + ", groups array<string>, "
               "sizes array<bigint>, n_units long, units binary, unit_links binary, links binary, pairs array<bigint>, heard array<bigint>")


def _blocks(a_path: str, b_path: str, digest: bool):
    def cut(batches) -> Iterator[pa.RecordBatch]:
        own = worker_store(("alignment", a_path, b_path), lambda: Aligner(a_path, b_path))
        for number, batch in enumerate(batches):
            row = own.block(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), digest)
            row["block"] = TaskContext.get().partitionId() << 32 | number
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _BLOCKS], schema=_BLOCKS)

    return cut


_OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])


def _settle(block: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a block, whose pairs' totals have come back."""
    row = {f.name: block.column(f.name)[0] for f in _BLOCKS}
    many = lambda name: row[name].values.to_numpy()
    unpacked = lambda name, n: np.frombuffer(pa.decompress(row[name].as_py(), 4 * n, "zstd", asbytes=True), "<u4")
    total, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
    place = pairs.column("place").to_numpy()
    total[place], best[place] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
    sizes, n_units = many("sizes"), row["n_units"].as_py()
    per_unit = unpacked("unit_links", n_units).astype(np.int64)
    links, units = unpacked("links", int(per_unit.sum())), unpacked("units", int(sizes.sum()))
    over = lambda values: pa.array(_sums(_sums(values[links], per_unit)[units], sizes), pa.int64())
    return pa.Table.from_arrays([row["doc_ids"].values, *[row[c].values for c in _COUNTS], over(best), over(total), row["groups"].values], schema=_OUT)


def align(df: DataFrame, a_path: str, b_path: str, digest: bool = False, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the alignment of every row, and how often each pair of ids is linked in the corpus.

    Documents have doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id, ties
    included), count_sum (their pairs' frequencies summed up) and groups, like ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its sha256.
    Pairs have a, b, total and best. A null or empty text, and one that either tokenizer doesn't give back byte for byte behind a
    space, has no tokens: zeros and an empty string. Rows that repeat a text or an id are rows of their own and count as often
    as they stand there. Further columns are left out.
    """
    blocks = pin(texts_of(df, key, text).mapInArrow(_blocks(a_path, b_path, digest), _BLOCKS_DDL), "blocks")
    heard = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "heard")).alias("place", "of")).select(
        "block", "place", F.col("of.pairs").alias("pair"), F.col("of.heard").alias("heard")).where("heard > 0")
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    totals = heard.groupBy("pair").agg(F.sum("heard").alias("total"))
    # as many rows of a B id as there are A ids at most
    highest = F.max("total").over(Window.partitionBy("b"))
    totals = pin(totals.withColumn("b", b).withColumn("best", F.col("total") == highest), "totals")
    known = heard.join(totals.select("pair", "total", F.col("best").cast("int").alias("best")), "pair").select(
        F.col("block").alias("home"), "place", "total", "best")
    documents = blocks.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(
        _settle, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return documents, totals.select(F.shiftright("pair", SHIFT).alias("a"), "b", "total", "best")
