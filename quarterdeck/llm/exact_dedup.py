"""Exact duplicates by owners in radix tries.

Rows meet by length and a short content hash. A partition holds the texts of many such keys, sorted as
byte strings, and puts them all into one compressed trie; the terminal node that a text ends
at decides which texts are equal, and stores their smallest id. As texts come in order, every
subtree beside the path to the last one is complete: once the trie holds ``spill_bytes``, those
are given out and dropped, so memory is bounded by that and by one text.

Before the shuffle each batch keeps one copy of a text with the ids that have it, so a text that
fills a third of the corpus crosses once per batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.common import SPACES, rows_out, texts_of, utf8
from quarterdeck.session import pin

#: Bits of the content hash that texts of one length are spread by.
HASH_BITS = 20
KEYED = "n_bytes long, hash long, text binary, ids array<long>"
OWNED = "owner long, ids array<long>, keep_id long, group_size long, digest binary"
_KEYED = pa.schema([("n_bytes", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("ids", pa.list_(pa.int64()))])
_OWNED = pa.schema([("owner", pa.int64()), ("ids", pa.list_(pa.int64())), ("keep_id", pa.int64()), ("group_size", pa.int64()),
                    ("digest", pa.binary())])


def squeeze(text: bytes) -> bytes:
    """``text`` with each run of [\\x20\\x09-\\x0D] replaced by one space."""
    words = b" ".join(text.split())
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in SPACES else b"") + words + (b" " if text[-1] in SPACES else b"")


def _smallest(known: int | None, ids: list[int | None]) -> int | None:
    """The smallest id; a missing one counts as larger than all."""
    return min((i for i in (known, *ids) if i is not None), default=None)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Terminal:
    """The end of a text: its smallest id, how many rows have it, and the ids that came first."""

    __slots__ = ("owner", "smallest", "rows", "held", "digest")

    def __init__(self, owner: int, digest: bytes):
        self.owner, self.digest = owner, digest
        self.smallest, self.rows, self.held = None, 0, None


class RadixTrie:
    """A compressed trie over byte strings that are inserted in ascending order.

    A node is [edge label, {first byte of a child's label: child}, terminal or None].
    """

    def __init__(self, first_owner: int = 0):
        self.root: list = [b"", {}, None]
        self.path: list[list] = [self.root]
        self.size, self.splits, self.next_owner = 0, 0, first_owner

    def insert(self, key: bytes) -> Terminal:
        """The terminal node of ``key``."""
        node, rest = self.root, key
        self.path = [node]
        while rest:
            child = node[1].get(rest[0])
            if child is None:
                child = node[1][rest[0]] = [rest, {}, None]
                self.size += len(rest)
                rest = b""
            elif rest.startswith(child[0]):
                rest = rest[len(child[0]):]
            else:
                cut = _shared(rest, child[0])
                upper = [child[0][:cut], {child[0][cut]: child}, None]
                child[0] = child[0][cut:]
                node[1][rest[0]] = child = upper
                self.splits += 1
                rest = rest[cut:]
            node = child
            self.path.append(node)
        if node[2] is None:
            node[2] = Terminal(self.next_owner, hashlib.sha256(key).digest())
            self.next_owner += 1
        return node[2]

    def _drop(self, node: list) -> Iterator[Terminal]:
        stack = [node]
        while stack:
            node = stack.pop()
            self.size -= len(node[0])
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())

    def complete(self) -> Iterator[Terminal]:
        """Drops all that later, larger texts can't reach, and gives out its terminals."""
        for node, after in zip(self.path, self.path[1:], strict=False):
            if node[2] is not None:
                yield node[2]
                node[2] = None
            for first, child in list(node[1].items()):
                if child is not after:
                    yield from self._drop(child)
                    del node[1][first]

    def rest(self) -> Iterator[Terminal]:
        """Drops everything."""
        yield from self._drop(self.root)
        self.__init__(self.next_owner)


def _distinct(bits: int):
    def distinct(batches):
        for batch in batches:
            found: dict[bytes, list] = {}
            for ident, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                found.setdefault(squeeze(text), []).append(ident)
            yield from rows_out(((len(t), zlib.crc32(t) & ((1 << bits) - 1), t, ids) for t, ids in found.items()), _KEYED, 1024)

    return distinct


def _closing(terminals):
    """What is known of a text once no more of its copies can come."""
    for t in terminals:
        yield t.owner, t.held, t.smallest, t.rows, t.digest


def _owned(spill_bytes: int):
    def subtrees(batches):
        # owners of different tasks don't meet
        trie, ids_held = RadixTrie(TaskContext.get().partitionId() << 40), 0
        for batch in batches:
            for text, ids in zip(batch.column("text"), batch.column("ids"), strict=True):
                text, ids = text.as_py(), ids.as_py()
                end = trie.insert(text)
                if end.rows == 0:
                    end.held = ids
                    ids_held += len(ids)
                else:
                    if end.held is not None:
                        yield end.owner, end.held, None, None, None
                        ids_held -= len(end.held)
                        end.held = None
                    yield end.owner, ids, None, None, None
                end.smallest, end.rows = _smallest(end.smallest, ids), end.rows + len(ids)
                if trie.size + 8 * ids_held >= spill_bytes:
                    for row in _closing(trie.complete()):
                        ids_held -= len(row[1] or ())
                        yield row
        yield from _closing(trie.rest())

    return lambda batches: rows_out(subtrees(batches), _OWNED, 64)


def owners(df: DataFrame, key: str = "doc_id", text: str = "text", spill_bytes: int = 64 << 20, hash_bits: int = HASH_BITS) -> DataFrame:
    """What the tries say: owner (the number of a terminal node), ids, keep_id, group_size, digest.

    Each terminal node gives one row with all it knows; its ``ids`` are those of the whole group
    unless that came from several batches. Then ``ids`` is null, and the ids are in rows that hold the owner alone.
    """
    distinct = texts_of(df, key, text).mapInArrow(_distinct(hash_bits), KEYED)
    return (distinct.repartition("n_bytes", "hash").sortWithinPartitions("text").select("text", "ids")
            .mapInArrow(_owned(spill_bytes), OWNED))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", spill_bytes: int = 64 << 20, hash_bits: int = HASH_BITS) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after each run of [\\x20\\x09-\\x0D] became one
    space; a null text is empty, and an empty one is a text like any other. Of equal texts the row
    with the smallest id stays. Rows that repeat an id with its text count in ``group_size``
    and share the verdict. A missing id counts as larger than any other. Further columns are
    left out. An empty table gives an empty result.
    """
    # written once, so that the numbers of the nodes are settled before they are joined
    found = pin(owners(df, key, text, spill_bytes, hash_bits), "owned")
    told = found.where("ids IS NOT NULL AND group_size IS NOT NULL").select("ids", "keep_id", "group_size", "digest")
    groups = found.where("ids IS NULL").select("owner", "keep_id", "group_size", "digest")
    members = found.where("ids IS NOT NULL AND group_size IS NULL").select("owner", "ids")
    every = told.unionAll(members.join(groups, "owner").select("ids", "keep_id", "group_size", "digest"))
    rows = every.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "digest")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))
