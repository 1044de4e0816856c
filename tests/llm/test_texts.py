"""Token blocks, exact dedup and line dedup against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quarterdeck.llm import exact_dedup, line_dedup, token_blocks
from quarterdeck.llm.byte_words import ByteLevel
from quarterdeck.llm.word_cache import SpaceDroppingEncoder
from tests.llm.brute import kept_lines

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = "\n".join(f"line {i % 700} of a very long text, {i}" for i in range(30_000))
ODD = [(5, None), (6, ""), (7, " \n\t"), (8, LONG), (8, LONG), (9, "same words"), (9, "same words"), (11, "same  words"), (None, "same words"),
       (None, None), (12, "É x́ İ ẞ 中文 <|endoftext|> 🙂"), (13, "\n\n"), (3, "Same Words repeat here\nsame words REPEAT here")]
CLASH = "doc_id long, text string, body string, digest string, kept string, __keep string"


def _odd(rows):
    return rows(CLASH, [(*r, "x", None, "y", "z") for r in ODD])


@pytest.mark.parametrize("kind,path", [(ByteLevel, BYTE), (SpaceDroppingEncoder, WORD)])
def test_words_are_encoded_as_the_library_does(kind, path):
    rnd = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", " ", "'s", "'S", "é", "é", "́", "1", "23", "!", ".", "the", "Thing", "<|endoftext|>",
             "<|startoftext|>", " \n", "\r\n", "\x1c", "Σ", "ß", "中", "　", "İ", "\x85", "🙂", "Ġ", "</w>", "ª"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(5000)] + ["", LONG]
    library, own = Tokenizer.from_file(path), kind(path)
    for text, found in zip(texts, own.encode_all(texts) if kind is ByteLevel else map(own.encode, texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("top", [0, 1, 200, 256, 50_256, (1 << 32) - 1])
@pytest.mark.parametrize("percentile", [0.0, 0.5, 0.95, 1.0])
def test_blocks_return_what_was_packed(top, percentile):
    rnd = np.random.default_rng(top + 1)
    for count in (0, 1, 1023, 1024, 1025, 4000):
        ids = rnd.integers(0, top, count, dtype=np.uint32, endpoint=True)
        ids[::41] = rnd.integers(0, (1 << 32) - 1, len(ids[::41]), dtype=np.uint32)
        packed = token_blocks.pack(ids, percentile)
        for start, stop in ((0, count), (count // 3, count // 2), (count // 2, count), (count, count)):
            assert token_blocks.unpack(*packed, start, stop).tolist() == ids[start:stop].tolist()


def test_token_files(rows, spark, tmp_path):
    token_blocks.write_tokens(_odd(rows).repartition(3), str(tmp_path / "t"), BYTE, end_id=2)
    library = Tokenizer.from_file(BYTE)
    tie = lambda text: int.from_bytes(xxhash.xxh64(text.encode(), seed=42).digest(), "big", signed=True)
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1] or "")))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in ordered]
    starts = np.cumsum([0, *map(len, ids)])
    want = sorted(((i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(ordered, starts, ids, strict=False)), key=str)
    found = token_blocks.read_tokens(spark, str(tmp_path / "t")).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found), key=str) == want
    flat = [x for part in ids for x in part]
    for first, count in ((0, 1), (1000, 5000), (len(flat) - 3, 10)):
        parts = sorted(token_blocks.read_range(spark, str(tmp_path / "t"), first, count).collect())
        assert [x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()] == flat[first:first + count]


def test_token_files_of_an_empty_table(rows, spark, tmp_path):
    token_blocks.write_tokens(rows("doc_id long, text string", []), str(tmp_path / "t"), BYTE, end_id=2)
    assert token_blocks.read_tokens(spark, str(tmp_path / "t")).collect() == []


def test_exact_groups(rows):
    groups = {}
    for ident, text in ODD:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(ident)
    want = []
    for ident, text in ODD:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        keep = min((i for i in groups[text] if i is not None), default=None)
        want.append((ident, keep, len(groups[text]), ident == keep, hashlib.sha256(text.encode()).hexdigest()))
    # with 0 to 4 bits of hash, texts of one length share a trie, and the trie alone tells them apart
    for spill, bits in ((1, 20), (1 << 20, 20), (1, 4), (1 << 20, 4), (300, 0)):
        found = exact_dedup.exact_groups(_odd(rows).repartition(4), spill_bytes=spill, hash_bits=bits).collect()
        assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_groups(rows("doc_id long, text string", [])).collect() == []


def test_tries_decide_among_texts_that_share_length_and_hash(rows):
    """2,000 texts of one length in 16 hash values: equal ones meet, others don't, whatever is spilled."""
    rnd = random.Random(5)
    docs = [(i, "common start " + "".join(rnd.choice("ab") for _ in range(9))) for i in rnd.sample(range(10**6), 2000)]
    groups = {}
    for i, t in docs:
        groups.setdefault(t, []).append(i)
    assert len(groups) < 520 and max(map(len, groups.values())) > 3
    want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    frame = rows("doc_id long, text string", docs).repartition(6)  # members of a group come from several batches
    for spill in (1, 400, 1 << 20):
        assert sorted(map(tuple, exact_dedup.exact_groups(frame, spill_bytes=spill, hash_bits=4).collect())) == want


@pytest.mark.parametrize("spill", [1, 40, 1 << 20])
def test_radix_trie_splits_and_drops_complete_subtrees(spill):
    rnd = random.Random(3)
    keys = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 7))) for _ in range(600))
    trie, found, most = exact_dedup.RadixTrie(), {}, 0
    for key in keys:
        end = trie.insert(key)
        end.rows += 1
        found.setdefault(key, set()).add(end.owner)
        if trie.size >= spill:
            list(trie.complete())
            assert trie.size <= len(key)  # only the path to the last text is left
        most = max(most, trie.size)
    assert len(found) == len(set(keys)) and all(len(f) == 1 for f in found.values())
    assert len(set.union(*found.values())) == len(found) and trie.splits > 0 and most <= spill + 7
    list(trie.rest())
    assert trie.size == 0


@pytest.mark.parametrize("text,out", [(b"", b""), (b" \t", b" "), (b" a\n\nb ", b" a b "), ("  x".encode(), "  x".encode())])
def test_squeeze(text, out):
    assert exact_dedup.squeeze(text) == out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_the_plain_version(rows, spark, seed):
    rnd = random.Random(seed)
    lines = ["", " ", "short", "a common line here", "\tA Common Line HERE ", *(f"line number {i} of some" for i in range(40)), "É" * 9, "é" * 10, "É" * 10]
    docs = [(i, "\n".join(rnd.choice(lines[:6] if rnd.random() < 0.4 else lines) for _ in range(rnd.randint(0, 9)))) for i in rnd.sample(range(9999), 400)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # the common line fills several tasks
    try:
        found = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(rows("doc_id long, text string", docs)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == kept_lines(docs)


def test_lines_of_odd_rows(rows):
    found = line_dedup.drop_repeated_lines(_odd(rows)).collect()
    assert len(found) == len(ODD)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.text))
    assert by[5] == [(1, 0, "")] and by[13] == [(3, 0, "\n\n")] and by[8] == [(30_000, 0, LONG)] * 2
    assert by[9] == [(1, 0, "same words")] * 2  # an id's own repeats stay
    assert sorted(by[None], key=str) == [(1, 0, ""), (1, 1, "")]  # a row without an id comes last
    assert by[3] == [(2, 0, "Same Words repeat here\nsame words REPEAT here")]
    whole = line_dedup.without_repeated_lines(_odd(rows))
    assert whole.columns == _odd(rows).columns and {r["__keep"] for r in whole.collect()} == {"z"}
    assert line_dedup.drop_repeated_lines(rows("doc_id long, text string", [])).collect() == []


def test_bitmaps_tell_the_lines_that_stay(rows):
    docs = [(1, "first common line\nown line of one"), (2, "own line of two\nfirst common line\nlast line of two")]
    (row,) = line_dedup.keep_bitmaps(rows("doc_id long, text string", docs)).collect()
    bits = np.unpackbits(np.frombuffer(zlib.decompress(row.keep), np.uint8), bitorder="little")
    assert (row.doc_id, row.n_dropped, bits[:3].tolist()) == (2, 1, [1, 0, 1])
