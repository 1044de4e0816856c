"""Packing: every token placed once, no gaps, and bounds that hold."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarterdeck.llm.packing import PIECES, best_fit, lower_bound, pack, pack_documents

WORD = public_tokenizers.path("word_bpe_49k.json")


def _check(found, capacity):
    """Each sequence is filled without gaps or overlaps, up to its capacity."""
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(sequences)


def _fewest(lengths, capacity):
    """By trying all packings, for a few pieces."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_fewest():
    rnd = random.Random(1)
    for _ in range(150):
        lengths = np.array([rnd.randint(1, 20) for _ in range(rnd.randint(0, 8))], np.int64)
        fewest = _fewest(sorted(lengths.tolist(), reverse=True), 20)
        assert lower_bound(lengths, 20) <= fewest <= best_fit(lengths, 20)[2]


@pytest.mark.parametrize("lengths,bound", [([11] * 6, 6), ([7] * 9, 5), ([20, 20], 2), ([5] * 8, 2), ([6, 6, 6, 7, 7, 7], 2)])
def test_bounds_beyond_the_sum(lengths, bound):
    assert lower_bound(np.array(lengths), 20) == bound


def test_rounds_exchange_pieces(rows):
    rnd = random.Random(2)
    data = [(i, 0, 0, rnd.choice([3, 5, 9, 31, 47, 64]), i) for i in range(3000)]
    found = pack(rows(PIECES, data), 64, at_once=100).collect()
    assert sorted((r.doc_id, r.length) for r in found) == sorted((d[0], d[3]) for d in data)
    bound = lower_bound(np.array([d[3] for d in data]), 64)
    assert bound <= _check(found, 64) <= bound * 1.02


@pytest.mark.parametrize("ones", [0, 40])
def test_no_round_packs_all_that_fits_nowhere(rows, ones):
    """No two pieces fit together, so all stay open; one-token pieces keep sequences improvable."""
    rnd = random.Random(3)
    data = [(i, 0, 0, 1 if i < ones else rnd.randint(33, 62), i) for i in range(2000)]
    found = pack(rows(PIECES, data), 64, at_once=100).collect()
    assert sorted((r.doc_id, r.length) for r in found) == sorted((d[0], d[3]) for d in data)
    assert _check(found, 64) == 2000 - ones
    packed_together = Counter(r.sequence_id >> 24 for r in found)
    assert max(packed_together.values()) <= 200


def test_documents_are_cut_and_packed(rows):
    long = " ".join(f"word{i}" for i in range(9000))
    docs = [(1, None), (2, ""), (3, "a few words"), (3, "a few words"), (None, "É Other \n words"), (4, long)]
    frame = rows("doc_id long, text string, length string, piece string", [(*d, "x", None) for d in docs])
    found = pack_documents(frame, WORD, capacity=256).collect()
    library, want = Tokenizer.from_file(WORD), []
    for ident, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(ident, n, at, len(ids[at:at + 256]), zlib.crc32(ids[at:at + 256].tobytes())) for n, at in enumerate(range(0, len(ids), 256))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(want, key=str)
    assert _check(found, 256) == lower_bound(np.array([w[3] for w in want]), 256)
    assert pack_documents(rows("doc_id long, text string", []), WORD).collect() == []
