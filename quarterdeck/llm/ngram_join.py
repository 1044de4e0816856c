"""Near duplicates by the Jaccard similarity of word shingles, exact at any threshold.

Size-aware heavy-light join. A *light* set, of few shingles, is entered under every subset that a
partner of similar size must share whole. A *heavy* set is entered in the inverted lists of
its rarest shingles, as many as a partner can't all miss. The boundary between the two is
where the entries, counted from the sizes of the corpus, are fewest; sets just below it are in
both, as they may be linked with larger ones.

Entries with the same signature meet in a list. Lists aren't expanded into pairs:

1. Every member is compared with its pivot, the smallest member of fitting size. Links found so far
   make components, and lists within one component are done.
2. In the short lists left, members of different components are compared.
3. A long list left is worked out in cells of bounded size, which hold the sets of their members: a member
   outside the largest component scans the inverted lists of its shingles and so counts what it shares with
   every other one. Only links that join two components leave the cell.

Before two texts meet, the parity bitmaps of their sets do: bits that differ are shingles that differ, so
too many of them rule out a link.

Signatures that are frequent in a part of the corpus are put last in the order of a set's shingles, so
shared passages don't make lists. If a signature is hot within one task its entries are salted; each salt has
its pivot, and the second step sees the whole list.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.common import rows_out, texts_of, utf8, worker_store
from quarterdeck.session import pin, unpin

#: Largest size that may be light, signatures put last at most, members of a list in a block, words a worker keeps.
MOST_LIGHT, MOST_FREQUENT, BLOCK, KEPT = 12, 500_000, 2_000, 150_000
#: Members of a short list, and shingles of a block's members together.
SHORT, BLOCK_SHINGLES = 64, 1 << 20
#: Documents that hold a shingle from which on it is put last, and shingles that a task counts at a time.
OFTEN, COUNTED = 8, 1 << 22
#: Entries of one signature in a batch from which on it is salted, and the salts.
HOT, SALTS = 64, 64
#: Odd multipliers that tell the places in a shingle apart.
PLACES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


class _Words(dict):
    """word -> 64-bit hash; the first KEPT words stay."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < KEPT:
            self[word] = value
        return value


def _words() -> _Words:
    return worker_store("words of shingles", _Words)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct shingles of ``width`` words; of all words if there are fewer.

    A-Z are lower-cased, words are runs of other characters than [\\x20\\x09-\\x0D]. Two sets of a thousand
    shingles are miscounted with a probability below 1e-12.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    size = min(width, len(words))
    many = len(words) - size + 1
    total = np.full(many, size, np.uint64)
    for place in range(size):
        total += hashes[place:place + many] * np.uint64(PLACES[place % len(PLACES)] * (2 * (place // len(PLACES)) + 1) & (1 << 64) - 1)
    total = _mixed(total)
    total.sort()
    fresh = np.ones(many, bool)
    np.not_equal(total[1:], total[:-1], out=fresh[1:])
    return total[fresh]


class Threshold:
    """Links when ``parts`` * |A & B| >= ``share`` * |A | B|, in whole numbers."""

    def __init__(self, share: int = 80, parts: int = 100):
        self.share, self.parts = share, parts

    def linked(self, common: int, a: int, b: int) -> bool:
        return a > 0 and b > 0 and self.parts * common >= self.share * (a + b - common)

    def least_common(self, size: int) -> int:
        """What a set of ``size`` has in common with any set that it is linked with."""
        return -(-self.share * size // self.parts)

    def prefix(self, size: int) -> int:
        """So many of its first shingles can't all be missing from a linked set."""
        return size - self.least_common(size) + 1 if size else 0

    def most_apart(self, a: int, b: int) -> int:
        """Shingles in one but not both of two linked sets of these sizes."""
        return (a + b) * (self.parts - self.share) // (self.parts + self.share)

    def subsets(self, size: int) -> int:
        return sum(math.comb(size, k) for k in range(self.least_common(size), size + 1))


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return texts_of(df, key, text).where("doc_id IS NOT NULL")


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("bits", pa.binary()), ("signature", pa.int64())])


def _sets(width: int):
    """A row per document with its set's size, key and bitmap, and rows of frequent shingles: n is their count, doc_id null."""
    def of(batches) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()

        def count() -> None:
            nonlocal counts
            every = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            every.sort()
            values = np.unique(every[2:][every[2:] == every[:-2]])  # three times or more
            found = np.searchsorted(every, values, "right") - np.searchsorted(every, values)
            for value, times in zip(values.view(np.int64).tolist(), found.tolist(), strict=True):
                counts[value] = counts.get(value, 0) + times
            if len(counts) > MOST_FREQUENT:  # lossy counting: the rare half goes
                middle = sorted(counts.values())[len(counts) // 2]
                counts = {v: c for v, c in counts.items() if c > middle}
            seen.clear()

        waiting = 0
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                own = shingles(text, width)
                high, low = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8").tolist()
                rows.append((ident, len(own), high, low, parity_bits(own), None))
                if (high, low) not in seen:  # copies don't make a shingle frequent
                    seen.add((high, low))
                    held.append(own)
                    waiting += len(own)
                    if waiting >= COUNTED:
                        count()
                        waiting = 0
            yield from rows_out(rows, _SETS)
        count()
        yield from rows_out(((None, c, None, None, None, v) for v, c in counts.items()), _SETS)

    return of


def _boundary(sizes: dict[int, int], threshold: Threshold) -> int:
    """The largest size of a light set, where the entries of both kinds are fewest."""
    def cost(most: int) -> int:
        light = sum(n * threshold.subsets(s) for s, n in sizes.items() if s <= most)
        heavy = sum(n * threshold.prefix(s) for s, n in sizes.items() if s >= threshold.least_common(most + 1))
        return light + heavy

    return min(range(MOST_LIGHT + 1), key=cost)


_ENTRIES = pa.schema([("signature", pa.int64()), ("salt", pa.int32()), ("n", pa.int32()), ("doc", pa.int64())])


class Order:
    """The order of shingles: those not known to be frequent first, then by the magnitude of their count, then by value."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        by_value = np.argsort(values)
        self.values, self.levels = values[by_value], np.log2(counts[by_value]).astype(np.uint8)

    def sort(self, own: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return own
        at = np.minimum(np.searchsorted(self.values, own), len(self.values) - 1)
        known = self.values[at] == own
        return own[np.argsort(np.where(known, self.levels[at], 0), kind="stable")] if known.any() else own


def _signatures(own: np.ndarray, order: Order, light: int, threshold: Threshold) -> np.ndarray:
    """The signatures that a set is entered under."""
    size, out = len(own), []
    if size <= light:
        for many in range(threshold.least_common(size), size + 1):
            picks = np.array(list(combinations(range(size), many)))
            # a sum that doesn't depend on the order, kept apart from single shingles by the size
            out.append(_mixed(_mixed(own[picks] + np.uint64(many)).sum(axis=1, dtype=np.uint64) + np.uint64(many)))
    if size >= threshold.least_common(light + 1):
        out.append(order.sort(own)[:threshold.prefix(size)])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _entries(width: int, order: Order, light: int, threshold: Threshold, hot_from: int):
    def of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            found, sizes, docs = [], [], []
            for ident, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                own = shingles(text, width)
                mark = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                if len(own) and mark not in seen:  # one of a batch's copies stands for all
                    seen.add(mark)
                    found.append(_signatures(own, order, light, threshold))
                    sizes.append(len(own))
                    docs.append(ident)
            if not found:
                continue
            each = [len(f) for f in found]
            signature = np.concatenate(found)
            n, doc = np.repeat(np.array(sizes, np.int32), each), np.repeat(np.array(docs, np.int64), each)
            values, at, count = np.unique(signature, return_inverse=True, return_counts=True)
            hot = count[at] >= hot_from
            salt = np.where(hot, 1 + doc % SALTS, 0).astype(np.int32)
            # the list without a salt must know that the signature has other members: marks, of size 0 unlike any member
            known = values[count >= hot_from]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([signature, known]).view(np.int64)), pa.array(np.concatenate([salt, np.zeros(len(known), np.int32)])),
                pa.array(np.concatenate([n, np.zeros(len(known), np.int32)])), pa.array(np.concatenate([doc, np.zeros(len(known), np.int64)]))], schema=_ENTRIES)

    return of


_LISTS = pa.schema([*_ENTRIES, ("pivot", pa.int64())])
LIST_DDL = "signature long, salt int, n int, doc long, pivot long"


def _lists(threshold: Threshold):
    """Members of lists of two or more, with their pivots; input is sorted by signature, salt, n, doc.

    A member that comes several times is told once. Salted members stay, as their list goes on elsewhere, and so do marks that
    tell of it, whose n is 0. Any long may be an id.
    """
    def of(batches) -> Iterator[pa.RecordBatch]:
        previous = None  # the last row, not yet told
        alone, pivot, pivot_n = True, 0, 0  # a pivot of size 0 is none
        for batch in batches:
            columns = [batch.column(n).to_numpy() for n in _ENTRIES.names]
            if previous is not None:
                columns = [np.concatenate([[p], c]).astype(c.dtype) for p, c in zip(previous, columns, strict=True)]
            signature, salt, n, doc = columns
            fresh = np.ones(len(signature), bool)
            fresh[1:] = (signature[1:] != signature[:-1]) | (salt[1:] != salt[:-1]) | (n[1:] != n[:-1]) | (doc[1:] != doc[:-1])
            signature, salt, n, doc = columns = [c[fresh] for c in columns]
            size = len(signature)
            if not size:
                continue
            same = (signature[1:] == signature[:-1]) & (salt[1:] == salt[:-1])
            before = np.concatenate([[previous is not None and not alone], same])
            rows = np.flatnonzero(before[:-1] | same | (salt[:-1] > 0))
            pivots = np.zeros(size, np.int64)
            for i in rows.tolist():
                if i == 0 and previous is not None and not alone:
                    pass  # the list goes on with its pivot
                elif i == 0 or not same[i - 1]:
                    pivot, pivot_n = 0, 0
                if n[i] > 0 and (not pivot_n or threshold.parts * pivot_n < threshold.share * n[i]):
                    pivot, pivot_n = doc[i], n[i]
                pivots[i] = pivot
            if len(rows):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in columns), pa.array(pivots[rows])], schema=_LISTS)
            alone = not before[-1]
            if size > 1 and alone:
                pivot, pivot_n = 0, 0
            previous = [c[-1] for c in columns]
        if previous is not None and (not alone or previous[1] > 0):
            signature, salt, n, doc = (int(x) for x in previous)
            if n > 0 and (not pivot_n or threshold.parts * pivot_n < threshold.share * n):
                pivot = doc
            yield from rows_out([(signature, salt, n, doc, int(pivot))], _LISTS)

    return of


def _met(entries: DataFrame, threshold: Threshold) -> DataFrame:
    return entries.repartition("signature", "salt").sortWithinPartitions("signature", "salt", "n", "doc").mapInArrow(_lists(threshold), LIST_DDL)


def parity_bits(own: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles falls on it. A bit or two a shingle, and 512 bytes at most."""
    size = 1 << max(6, min(12, (max(1, len(own)) - 1).bit_length()))
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """So many shingles at least are in one but not both of the sets."""
    x, y = (a, b) if len(a) >= len(b) else (b, a)
    large, size = int.from_bytes(x, "little"), 8 * len(x)
    while size > 8 * len(y):  # halves laid over each other are the bitmap of half the size
        size //= 2
        large = large >> size ^ large & (1 << size) - 1
    return (large ^ int.from_bytes(y, "little")).bit_count()


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The texts of the documents in ``needed``, whose files tell Spark how few they are."""
    return pin(docs.join(pin(needed.toDF("doc_id").distinct(), "needed"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")


def _plausible(pairs: DataFrame, bitmaps: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs that their bitmaps (doc_id, n, bits) don't rule out."""
    both = pairs.join(bitmaps.toDF("a", "a_n", "a_bits"), "a").join(bitmaps.toDF("b", "b_n", "b_bits"), "b")

    def of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_bits", "b_bits")]
            keep = pa.array([least_apart(x, y) <= threshold.most_apart(m, n) for m, n, x, y in zip(*columns, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pin(both.mapInArrow(of, "a long, b long"), "plausible")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(width: int, threshold: Threshold):
    """The linked pairs. Input is sorted by a and salt; each begins with the row of a itself, whose b is null."""
    def of(batches) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), utf8(batch, "text"), strict=True):
                other = shingles(text, width)
                if b is None:
                    own = other
                    continue
                if threshold.linked(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other)):
                    out.append((a, b))
            yield from rows_out(out, _PAIRS)

    return of


def _compare(pairs: DataFrame, texts: DataFrame, width: int, threshold: Threshold, block: int) -> DataFrame:
    """The pairs that are linked, by their whole texts; ``pairs`` are distinct.

    The text of a meets those of its partners: each is shuffled once for an a and not once for a pair. An a with very
    many partners is spread over salts of ``block`` of them.
    """
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    salted = pairs.join(heads, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    partners = salted.select("a", "salt", "b").join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
    own = heads.join(texts.withColumnRenamed("doc_id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    rows = own.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return pin(rows.mapInArrow(_linked(width, threshold), "a long, b long"), "compared")


def components(links: DataFrame) -> DataFrame:
    """(doc, component) of each end of the links (a, b); the component is its smallest member.

    Every node's label falls to the smallest label around it, and labels are followed to their own labels, so
    the rounds grow with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    edges = pin(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = pin(edges.groupBy(F.col("a").alias("doc")).agg(F.least(F.col("doc"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("near").alias("near"))
        # a label's own label is at most itself; a root hears from all that point to it
        heard = labels.join(near, "doc").select("doc", "component", F.least("component", "near").alias("least"))
        roots = heard.groupBy(F.col("component").alias("root")).agg(F.min("least").alias("lowest"))
        hooked = heard.join(roots, F.col("component") == F.col("root")).select("doc", "component", F.least("least", "lowest").alias("new"))
        jump = hooked.select(F.col("doc").alias("new"), F.col("new").alias("next"))
        following = pin(hooked.join(jump, "new").select("doc", "component", F.least("new", "next").alias("following")), "labels")
        changed = following.where("following <> component").limit(1).count()
        labels = following.select("doc", F.col("following").alias("component"))
        if not changed:
            return labels


def _left_over(lists: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """The members of lists that hold several components, with the number of members and of blocks of their list."""
    named = lists.join(known, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = named.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"),
                                           F.sum("n").alias("shingles"), (F.max("pivot") != F.min("pivot")).alias("several"))
    # two members with one pivot were compared: one of them is the pivot
    mixed = mixed.where("low <> high AND (members > 2 OR several)")
    blocks = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return pin(named.drop("salt").join(mixed.select("signature", "members", blocks.alias("blocks")), "signature"), "left_over")


def _short_pairs(members: DataFrame, bitmaps: DataFrame, star: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs of different components in the short lists that their bitmaps don't rule out; ``star`` are compared already."""
    told = members.join(bitmaps.select(F.col("doc_id").alias("doc"), "bits"), "doc")
    pairs = told.select("signature", *_MEMBERS).repartition("signature").sortWithinPartitions("signature", "n", "doc").mapInArrow(
        _cross(threshold), "a long, b long").distinct()
    return pairs.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


_MEMBERS = ["n", "doc", "component", "pivot", "bits"]


def _cross(threshold: Threshold):
    """Pairs within each list; input is sorted by signature, n, doc."""
    def pairs_of(columns: list[np.ndarray]) -> np.ndarray:
        n, doc, component, pivot, bits = columns
        out = []
        for i in range(len(doc) - 1):
            at = np.arange(i + 1, np.searchsorted(n, threshold.parts * n[i] // threshold.share, side="right"))
            at = at[(component[at] != component[i]) & (doc[at] != pivot[i]) & (pivot[at] != doc[i])]
            for j in at.tolist():
                if least_apart(bits[i], bits[j]) <= threshold.most_apart(int(n[i]), int(n[j])):
                    out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
        return np.array(out, np.int64).reshape(-1, 2)

    def of(batches) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("signature", *_MEMBERS)]
            held = columns if held is None else [np.concatenate(c) for c in zip(held, columns, strict=True)]
            edges = [0, *(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist()]
            found = [pairs_of([c[begin:end] for c in held[1:]]) for begin, end in zip(edges[:-1], edges[1:], strict=True)]
            held = [c[edges[-1]:] for c in held]
            yield _pairs_batch(found)
        if held is not None:
            yield _pairs_batch([pairs_of(held[1:])])

    return of


def _pairs_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _long_links(members: DataFrame, texts: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """Links that join different components within the long lists.

    Block i of a list meets block j >= i in a cell of its own: a row goes to all cells of its line and column.
    """
    members = members.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = members.select("signature", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "component")
    filled = cells.join(texts.withColumnRenamed("doc_id", "doc"), "doc").repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j", "doc")
    return filled.mapInArrow(_scanned(width, threshold), "a long, b long").distinct()


def scan(sets: list[np.ndarray], labels: np.ndarray, threshold: Threshold) -> list[tuple[int, int]]:
    """Places of linked sets with different ``labels``, as many as join all that are linked.

    A set outside the largest component scans the inverted lists of its shingles, which counts what it has in common
    with every set. Two linked sets of different components can't both be in the largest one, so one of them scans.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingle, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = shingle[order][1:] != shingle[order][:-1]
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.append(starts, len(order)))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    postings, ends = owner[order], np.cumsum(sizes)
    labels, waiting, links = np.unique(labels, return_inverse=True)[1], np.ones(len(sets), bool), []
    while True:
        left = np.flatnonzero(waiting & (labels != np.bincount(labels).argmax()))
        if not len(left):
            return links
        i = left[0]
        waiting[i] = False
        lists = number[ends[i] - sizes[i]:ends[i]]
        lists = lists[lengths[lists] > 1]
        size = lengths[lists]
        at = np.arange(size.sum()) + np.repeat(starts[lists] - np.cumsum(size) + size, size)
        common = np.bincount(postings[at], minlength=len(sets))
        linked = np.flatnonzero((threshold.parts * common >= threshold.share * (sizes + sizes[i] - common)) & (labels != labels[i]))
        for label, j in zip(*np.unique(labels[linked], return_index=True), strict=True):
            links.append((i, int(linked[j])))
            labels[labels == label] = labels[i]


def _scanned(width: int, threshold: Threshold):
    """Links within each cell; input is sorted by cell. A cell has two blocks at most."""
    def links_of(rows: list[tuple[int, int, np.ndarray]]) -> list[np.ndarray]:
        docs, labels, sets = zip(*rows, strict=True)
        found = scan(list(sets), np.array(labels), threshold)
        return [np.array([sorted((docs[i], docs[j])) for i, j in found], np.int64).reshape(-1, 2)]

    def of(batches) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("signature", "i", "j", "doc", "component")]
            for *own, doc, component, text in zip(*columns, utf8(batch, "text"), strict=True):
                if own != cell and rows:
                    yield _pairs_batch(links_of(rows))
                    rows = []
                cell = own
                rows.append((doc, component, shingles(text, width)))
        if rows:
            yield _pairs_batch(links_of(rows))

    return of


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: Threshold | None = None,
                    hot: int = HOT, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that a document is joined to by links.

    Documents without words are linked with nothing. Rows that repeat an id must repeat its text; they are
    one document with a row each. ``hot`` entries of a signature in a batch salt it, lists of up to
    ``short`` members are taken pair by pair, longer ones by cells of ``block`` members; none of them changes the result. A row without an id can't be linked and has no component. Further
    columns are left out. An empty table gives an empty result.
    """
    threshold = threshold or Threshold()
    docs = _keyed(df, key, text)
    described = pin(texts_of(df, key, text).mapInArrow(_sets(width), "doc_id long, n long, high long, low long, bits binary, signature long"), "sets")
    sets = described.where("signature IS NULL")
    # signatures put last: the most frequent ones, at most MOST_FREQUENT longs on the driver and in each task
    often = described.where("signature IS NOT NULL").groupBy("signature").agg(F.sum("n").alias("n"))
    late = often.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "signature").limit(MOST_FREQUENT).toPandas()
    order = Order(late["signature"].to_numpy(np.int64).view(np.uint64), late["n"].to_numpy(np.int64))
    sizes = {r["n"]: r["count"] for r in sets.where(F.col("n").between(1, 2 * MOST_LIGHT)).groupBy("n").count().collect()}
    light = _boundary(sizes, threshold)

    entries = docs.mapInArrow(_entries(width, order, light, threshold, hot), "signature long, salt int, n int, doc long")
    shared = pin(_met(entries, threshold).drop("pivot"), "shared")

    # copies are linked as they are, by their sets' keys; only the first of them is compared
    named = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "high", "low").distinct()
    first = named.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = pin(named.join(first, ["high", "low"]).where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "copies")
    to_first = copies.select(F.col("a").alias("first"), F.col("b").alias("copy"))
    firsts = shared.join(to_first, F.col("doc") == F.col("copy"), "left").withColumn("doc", F.coalesce("first", "doc")).select(*_ENTRIES.names)
    lists = pin(_met(firsts, threshold).where("n > 0"), "lists")
    unpin(shared)
    star_pairs = pin(lists.where("pivot <> doc").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct(), "star")
    bitmaps = pin(sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "bits").dropDuplicates(["doc_id"]), "bitmaps")
    plausible = _plausible(star_pairs, bitmaps, threshold)
    star = _compare(plausible, _texts(docs, plausible.select(F.explode(F.array("a", "b")))), width, threshold, block)
    links = star.unionAll(copies)

    left = _left_over(lists, components(links), block)
    pairs = pin(_short_pairs(left.where(F.col("members") <= short), bitmaps, star_pairs, threshold), "pairs")
    members = left.where(F.col("members") > short)
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b"))).unionAll(members.select("doc")))
    rest = _compare(pairs, texts, width, threshold, block)
    rest = pin(rest.unionAll(_long_links(members, texts, width, threshold)), "links")
    unpin(lists, star_pairs, bitmaps, left, pairs, texts)
    known = components(links.unionAll(rest))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(known.toDF("doc_id", "component_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
