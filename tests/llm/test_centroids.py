"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import pytest

from quarterdeck.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, cluster string, near string"


def _brute(data, size, k, rounds, prefix="3:"):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in data
             if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, hashlib.sha256(f"{prefix}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    middles = [v for _, v in sorted(whole, key=order)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middles))
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(near(v)[1], []).append(v)
        middles = [[sum(c) // len(groups[n]) for c in zip(*groups[n], strict=True)] if n in groups else middles[n] for n in range(len(middles))]
    last = [(i, *near(v)) for i, v in whole]
    total = {n: sum(d for _, d, m in last if m == n) for _, _, n in last}
    return sorted(((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, middles[n])).encode()).hexdigest())
                   for i, d, n in last), key=str)


def _found(rows, data, size, **more):
    frame = rows(SCHEMA, [(*d, 1, "i", "v", "c", "n") for d in data])
    return sorted((tuple(r) for r in centroids.cluster(frame, size, **more).collect()), key=str)


def test_same_as_plain_integers(rows):
    rnd = random.Random(2)
    data = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    data = [(i, [float(f"{x:.2f}") // 0.25 * 0.25 for x in v]) for i, v in data]  # many ties and repeated vectors
    data += [(5, [0.5] * 4), (5, [0.5] * 4), (None, [0.25] * 4), (400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4),
             (403, [float("inf")] * 4), (404, [1.0] * 3), (405, []), (406, [1.0] * 5)]
    for rounds in (0, 1, 10):
        assert _found(rows, data, 4, k=8, rounds=rounds) == _brute(data, 4, 8, rounds)


def test_few_vectors_empty_centroids_and_empty_tables(rows):
    data = [(i, [1.0, -1.0]) for i in range(20)]  # eight equal centroids: seven of them stay empty
    assert _found(rows, data, 2) == _brute(data, 2, 8, 10) and {r[1] for r in _found(rows, data, 2)} == {0}
    assert _found(rows, data[:3], 2) == _brute(data[:3], 2, 8, 10)
    assert _found(rows, [], 2) == [] and _found(rows, [(1, None)], 2) == []


def test_components_beyond_64_bits_fail(rows):
    with pytest.raises(Exception, match="too large"):
        _found(rows, [(1, [3e30, 0.0])], 2)
