import random

import numpy as np
import pandas as pd
import pytest

from quarterdeck.operators import windows
from quarterdeck.operators.ordered import global_position
from quarterdeck.panel import PanelSpec, duplicate_keys

PLAIN = PanelSpec.of("e", "t")
# blocks far smaller than an entity, so that every frame crosses their borders
BLOCKS = PanelSpec.of("e", "t", bounded=False, block_rows=7)


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    data = []
    for e in range(5):
        n = 150 if e == 0 else rnd.randrange(1, 30)  # one entity holds most of the rows
        for t in range(n):
            gap = rnd.random() < 0.3 or (e == 0 and 40 < t < 60)
            data.append((e, t, None if gap else float(rnd.randrange(0, 6)), float(rnd.randrange(1, 9))))
    return spark.createDataFrame(data, "e int, t int, x double, y double").repartition(6)


def _pandas(df):
    return df.toPandas().sort_values(["e", "t"]).reset_index(drop=True)


OPERATORS = {
    "lead": lambda d, s: windows.add_lead_targets(d, s, ["x", "y"]),
    "lead_all": lambda d, s: windows.add_lead_targets(d, s, ["x"], drop_last=False),
    "year_ago": lambda d, s: windows.add_year_ago(d, s, ["x"]),
    "moving": lambda d, s: windows.moving_average(d, s, ["x", "y"], (3, 6)),
    "rolling": lambda d, s: windows.rolling_average(d, s, ["x"], 4, 2),
    "difference": lambda d, s: windows.first_difference(d, s, ["x", "y"]),
    "lags": lambda d, s: windows.add_lags(d, s, ["y"], (1, 5)),
    "return": lambda d, s: windows.period_return(d, s, "y", 6),
    "scaled": lambda d, s: windows.scaled_difference(d, s, "y"),
    "growth": lambda d, s: windows.growth_rate(d, s, ["x", "y"]),
    "ema": lambda d, s: windows.ema(d, s, ["x", "y"], 3, fold_rows=7),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_blocks_equal_plain_windows(series, name):
    plain, blocks = (_pandas(OPERATORS[name](series, s)) for s in (PLAIN, BLOCKS))
    assert sorted(plain.columns) == sorted(blocks.columns)
    pd.testing.assert_frame_equal(plain, blocks[plain.columns], rtol=1e-12)


@pytest.mark.parametrize("spec", [PLAIN, BLOCKS])
def test_ema_never_forgets(rows, spec):
    x = [1e30] + [1.0] * 79
    got = _pandas(windows.ema(rows("e int, t int, x double", [(1, t, v) for t, v in enumerate(x)]), spec, ["x"], 3, fold_rows=9))
    np.testing.assert_allclose(got["x_ema_3"], pd.Series(x).ewm(span=3, adjust=False).mean(), rtol=1e-12)
    assert got["x_ema_3"].iloc[-1] == pytest.approx(1654362.2251060551, rel=1e-12)


def test_ema_equals_pandas(series):
    got = _pandas(windows.ema(series, PLAIN, ["x"], 3))
    want = got.groupby("e")["x"].transform(lambda s: s.ewm(span=3, adjust=False).mean())
    np.testing.assert_allclose(got["x_ema_3"], want, rtol=1e-12)


def test_ema_keeps_decaying_over_a_long_gap(rows):
    x = [1.0, 4.0] + [None] * 70 + [2.0]
    df = rows("e int, t int, x double", [(0, i, v) for i, v in enumerate(x)])
    got = _pandas(windows.ema(df, PLAIN, ["x"], 6))
    want = pd.Series(x, dtype=float).ewm(span=6, adjust=False).mean()
    np.testing.assert_allclose(got["x_ema_6"], want, rtol=1e-12)


def test_growth_equals_pandas_without_zero_bases(series):
    got = _pandas(windows.growth_rate(series, PLAIN, ["y"]))
    pct = got.groupby("e")["y"].transform(lambda s: s.ffill().pct_change(fill_method=None))
    np.testing.assert_allclose(got["y_q2q_pct_change"], pct * 100, rtol=1e-9, atol=1e-9)
    total = (1 + pct).groupby(got["e"]).cumprod()
    np.testing.assert_allclose(got["y_q2q_cumulative_growth"], total, rtol=1e-9)


def test_growth_is_null_from_a_zero_base_on(rows):
    df = rows("e int, t int, x double", [(0, i, v) for i, v in enumerate([None, 2.0, 0.0, 3.0, 6.0])])
    got = windows.growth_rate(df, PLAIN, ["x"]).orderBy("t").collect()
    assert [r["x_q2q_pct_change"] for r in got] == [None, None, -100.0, None, 100.0]
    assert [r["x_q2q_cumulative_growth"] for r in got] == [None, None, 0.0, None, None]


def test_moving_average_needs_all_values(rows):
    df = rows("e int, t int, x double", [(0, i, v) for i, v in enumerate([1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0])])
    got = windows.moving_average(df, PLAIN, ["x"], (3,), "m").orderBy("t").collect()
    assert [r["m"] for r in got] == [None, None, 2.0, None, None, None, 6.0]


def test_lead_then_lag_is_identity(series):
    led = windows.add_lead_targets(series, PLAIN, ["y"], drop_last=False)
    back = windows.add_lags(led, PLAIN, ["y_lag1"], (1,), "back").where("back is not null")
    assert back.where("back <> y").count() == 0 and back.count() > 0


def test_last_row_is_dropped_by_place_not_by_null(rows):
    df = rows("e int, t int, x double", [(0, 0, 1.0), (0, 1, None), (1, 0, 2.0)])
    got = windows.add_lead_targets(df, PLAIN, ["x"]).collect()
    assert [(r["e"], r["t"], r["x_lag1"]) for r in got] == [(0, 0, None)]


def test_positions_number_every_row_once(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as k").repartition(9)
    got = [r["_position"] for r in global_position(df, ["k", "id"]).orderBy("k", "id").collect()]
    assert got == list(range(5000))


def test_frames_larger_than_a_block_are_refused(series):
    with pytest.raises(ValueError):
        windows.moving_average(series, BLOCKS, ["x"], (24,)).count()


def test_duplicate_keys_are_found(rows):
    df = rows("e int, t int", [(0, 1), (0, 1), (0, 2)])
    assert [r["count"] for r in duplicate_keys(df, PLAIN).collect()] == [2]
