"""Top-k against all scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarterdeck.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label string, id string, vector string, score string"


def _all(rows, k=10):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in fine if i is not None and i % 100 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), math.inf if i is None else i) for i, w in fine if i != q)
        out += [(q, n + 1, None if i == math.inf else i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def _found(frame, **sizes):
    good = frame.where(topk.usable(F.col("embedding")))
    vectors = good.select(F.col("vec_id").alias("id"), topk.whole_numbers(F.col("embedding")).alias("vector"))
    return sorted(map(tuple, topk.top_k(vectors.where("id % 100 = 0"), vectors, **sizes).collect()), key=str)


def test_same_as_all_scores(rows):
    rnd = random.Random(1)
    data = [(i, [rnd.choice([0.0, 0.0, 0.5, -0.25, 1.0]) for _ in range(6)]) for i in range(700)]  # many ties, many zeros
    data += [(701, None), (702, [None, 1.0]), (800, [float("nan")] * 6), (703, [float("inf"), 0.0]), (704, []), (900, [1.0, 2.0]), (705, [0.5] * 6), (705, [0.5] * 6),
             (None, [1.0] * 6)]
    frame = rows(SCHEMA, [(*d, "l", "i", "v", "s") for d in data])
    want = _all(data)
    assert _found(frame) == want
    assert _found(frame, query_block=2, block=64) == want


def test_few_candidates_and_empty_tables(rows):
    data = [(0, [1.0, -1.0]), (100, [0.5, 0.5]), (1, [2.0, 0.0])]
    frame = rows("vec_id long, embedding array<float>", data)
    assert _found(frame) == _all(data)
    assert _found(rows("vec_id long, embedding array<float>", [(0, [1.0])])) == []
    assert _found(rows("vec_id long, embedding array<float>", [])) == []


def test_large_components(rows):
    rnd = random.Random(2)
    data = [(i, [float(rnd.randint(-2_400_000, 2_400_000))]) for i in range(300)]  # beyond 32 bits once scaled
    frame = rows("vec_id long, embedding array<float>", data)
    assert _found(frame, block=50) == _all(data)
    for huge in (1e30, -1e30, 3e6 * 1024):
        with pytest.raises(ValueError, match="64 bits"):
            _found(rows("vec_id long, embedding array<float>", [(0, [huge] * 4), (1, [1.0] * 4), (100, [huge] * 4)]))
