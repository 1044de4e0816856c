import datetime as dt
import random

import pandas as pd
import pytest

from quarterdeck.operators.asof import asof_join, peer_features

DAY = dt.date(2020, 1, 1)


def _day(i):
    return None if i is None else DAY + dt.timedelta(days=i)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("grouped", [True, False])
def test_equals_sorted_merge_on_random_days(rows, strict, grouped):
    rnd = random.Random(1)
    left = [(i, rnd.choice("ab"), _day(rnd.randrange(200))) for i in range(300)]
    right = [(rnd.choice("ab"), _day(rnd.randrange(200)), i) for i in range(60)]
    by = {"g": "h"} if grouped else None
    got = asof_join(rows("i int, g string, t date", left), rows("h string, u date, v int", right), "t", "u", ["v"],
                    by=by, strict=strict, tiebreak="v")
    ours = {r["i"]: r["v"] for r in got.collect()}
    l = pd.DataFrame(left, columns=["i", "g", "t"]).assign(t=lambda d: pd.to_datetime(d["t"])).sort_values("t")
    r = pd.DataFrame(right, columns=["h", "u", "v"]).assign(u=lambda d: pd.to_datetime(d["u"])).sort_values(["u", "v"])
    extra = {"left_by": "g", "right_by": "h"} if grouped else {}
    want = pd.merge_asof(l, r, left_on="t", right_on="u", allow_exact_matches=not strict, **extra)
    assert ours == {int(a): (None if pd.isna(b) else int(b)) for a, b in zip(want["i"], want["v"])}


def test_null_times_equal_times_and_null_payloads(rows):
    left = rows("i int, t date", [(1, None), (2, _day(40)), (3, _day(0)), (4, _day(90))])
    right = rows("u date, v int, w int", [(_day(0), 1, 1), (_day(40), None, 2), (None, 9, 9), (_day(2), 5, 5)])
    strict = {r["i"]: (r["v"], r["w"]) for r in asof_join(left, right, "t", "u", ["v", "w"], strict=True).collect()}
    assert strict == {1: (None, None), 2: (5, 5), 3: (None, None), 4: (None, 2)}
    equal = {r["i"]: (r["v"], r["w"]) for r in asof_join(left, right, "t", "u", ["v", "w"], strict=False).collect()}
    assert equal == {1: (None, None), 2: (None, 2), 3: (1, 1), 4: (None, 2)}


def test_strict_never_returns_an_equal_time(rows):
    left = rows("i int, t date", [(i, _day(i % 50)) for i in range(100)])
    right = rows("u date, at date", [(_day(i), _day(i)) for i in range(50)])
    got = asof_join(left, right, "t", "u", ["at"], strict=True).collect()
    assert all(r["at"] is None or r["at"] < r["t"] for r in got)


def test_timestamps_with_one_key_holding_a_third_of_the_rows(spark, rows):
    base = dt.datetime(2024, 1, 1)
    rnd = random.Random(5)
    left = [(i, 0 if i % 3 == 0 else i % 40, base + dt.timedelta(seconds=rnd.randrange(10 ** 6))) for i in range(1500)]
    right = [(0 if i % 3 == 0 else i % 40, base + dt.timedelta(seconds=rnd.randrange(10 ** 6)), i) for i in range(900)]
    got = asof_join(rows("i int, g int, t timestamp", left), rows("h int, u timestamp, v int", right), "t", "u", ["v"],
                    by={"g": "h"}, tiebreak="v", block_rows=50)
    want = {}
    for i, g, t in left:
        before = [(u, v) for h, u, v in right if h == g and u < t]
        want[i] = max(before)[1] if before else None
    assert {r["i"]: r["v"] for r in got.collect()} == want


def test_peers_side_by_side(rows):
    df = rows("e string, t date, v int", [("p", _day(1), 1), ("p", _day(5), 2), ("q", _day(3), 3), ("r", _day(4), 4),
                                         ("r", _day(9), 5), ("r", None, 6)])
    got = {(r["e"], r["t"]): (r["v_P"], r["v_Q"]) for r in peer_features(df, {"P": "p", "Q": "q"}, "e", "t", ["v"]).collect()}
    assert got == {("p", _day(1)): (None, None), ("p", _day(5)): (1, 3), ("q", _day(3)): (1, None),
                   ("r", _day(4)): (1, 3), ("r", _day(9)): (2, 3), ("r", None): (None, None)}


@pytest.mark.parametrize("strict", [True, False])
def test_a_date_meets_a_timestamp_as_its_midnight(rows, strict):
    day, noon = dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 15)
    late = asof_join(rows("t date", [(day,)]), rows("u timestamp, v int", [(noon, 1)]), "t", "u", ["v"], strict=strict)
    assert late.first()["v"] is None
    found = asof_join(rows("t timestamp", [(noon,), (dt.datetime(2020, 1, 1),)]), rows("u date, v int", [(day, 1)]), "t", "u", ["v"], strict=strict)
    assert {r["t"].hour: r["v"] for r in found.collect()} == {15: 1, 0: None if strict else 1}
    twice = rows("u timestamp, v int", [(dt.datetime(2020, 1, 1, 9), 1), (dt.datetime(2020, 1, 1, 11), 2)])
    assert asof_join(rows("t timestamp", [(dt.datetime(2020, 1, 1, 10),)]), twice, "t", "u", ["v"], strict=strict).first()["v"] == 1


def test_ties_are_settled_by_all_tie_break_columns(rows):
    day = dt.date(2020, 1, 1)
    peers = rows("e string, t date, y int, q int, v int", [("p", day, 2019, 4, 1), ("p", day, 2020, 1, 2), ("p", day, 2019, 3, 9), ("x", dt.date(2020, 2, 1), 2020, 1, 0)])
    for _ in range(3):
        got = peer_features(peers.repartition(3), {"P": "p"}, "e", "t", ["v"], tiebreak=["y", "q"])
        assert got.where("e = 'x'").first()["v_P"] == 2
    assert peer_features(peers, {"P": "p"}, "e", "t", ["v"]).where("e = 'x'").first()["v_P"] == 9
