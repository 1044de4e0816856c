"""The n-gram join against all pairs."""

import random

import numpy as np
import pytest

from quarterdeck.llm.ngram_join import Threshold, components, least_apart, near_duplicates, parity_bits
from tests.llm.brute import near_components


def _corpus(seed, count=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    texts = []
    for _ in range(count):
        if texts and rnd.random() < 0.6:  # a copy with a word changed, dropped or added
            own = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(own) + 1)
                own[at:at + rnd.randint(0, 1)] = [rnd.choice(words)] * rnd.randint(0, 1)
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 5, 6, 8, 9, 11, 13, 16, 20, 60]))))
    ids = rnd.sample(range(10_000), count)
    return list(zip(ids, texts, strict=True))


def _found(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed,hot,short,block", [(1, 64, 64, 2000), (2, 2, 2, 3), (3, 3, 4, 2), (4, 1, 64, 1000), (5, 2, 0, 7), (6, 64, 3, 50)])
def test_same_as_all_pairs(rows, seed, hot, short, block):
    docs = _corpus(seed)
    got = _found(near_duplicates(rows("doc_id long, text string", docs).repartition(3), hot=hot, short=short, block=block))
    assert got == near_components(docs)


@pytest.mark.parametrize("hot", [2, 64])
def test_any_long_is_an_id(rows, hot):
    texts = [t for _, t in _corpus(7)]
    ids = [-1, 0, -(1 << 63), (1 << 63) - 1, *random.Random(8).sample(range(-5000, 5000), 4 * len(texts))]
    docs = list(zip([i for i in dict.fromkeys(ids)][:len(texts)], texts, strict=True))
    assert _found(near_duplicates(rows("doc_id long, text string", docs).repartition(3), hot=hot)) == near_components(docs)


def test_odd_rows(rows):
    long = " ".join(f"x{i % 997}y{i % 31}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "Same Words here"), (5, "same\twords HERE"), (5, "same\twords HERE"), (None, "same words here"),
            (7, long), (8, long + " end"), (9, "É same words here")]
    frame = rows("doc_id long, text string, n long, high string, component string", [(*d, 1, "x", None) for d in docs])
    got = _found(near_duplicates(frame))
    assert got == near_components([d for d in docs if d[0] is not None]) | {(None, 1, None)}
    assert near_duplicates(rows("doc_id long, text string", [])).collect() == []


def test_long_chains_are_one_component(rows):
    rnd = random.Random(5)
    ids = rnd.sample(range(1000), 60)
    chain = [*zip(ids[:40], ids[1:41], strict=False), *zip(ids[41:], ids[42:], strict=False)]
    got = {r.doc: r.component for r in components(rows("a long, b long", chain)).collect()}
    assert got == {**dict.fromkeys(ids[:41], min(ids[:41])), **dict.fromkeys(ids[41:], min(ids[41:]))}


def test_threshold_counts_in_whole_numbers():
    t = Threshold()
    assert t.linked(4, 5, 4) and not t.linked(3, 4, 4) and not t.linked(0, 0, 0)
    assert [t.least_common(n) for n in (1, 4, 5, 9, 10)] == [1, 4, 4, 8, 8]


def test_bitmaps_never_rule_out_too_much():
    rnd = np.random.default_rng(1)
    for size in (1, 5, 40, 300, 40_000):
        own = rnd.integers(0, 1 << 63, size).astype(np.uint64)
        for other_size in (size, max(1, size // 2), size * 2):
            keep = own[rnd.random(size) < 0.7]
            other = np.concatenate([keep, rnd.integers(0, 1 << 63, max(0, other_size - len(keep))).astype(np.uint64)])
            assert least_apart(parity_bits(own), parity_bits(other)) <= len(np.setxor1d(own, other))
    assert least_apart(parity_bits(own), parity_bits(own)) == 0
    t = Threshold()
    assert all(t.linked((a + b - d) // 2, a, b) == (d <= t.most_apart(a, b)) for a in range(1, 40) for b in range(1, 40) for d in range(abs(a - b), a + b + 1, 2))
