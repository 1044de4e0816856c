import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import impute
from quarterdeck.operators.ar1 import impute_ar1
from quarterdeck.panel import PanelSpec

SPEC = PanelSpec.of("e", "t")
SHAPES = {
    0: [None, None, 3.0, 4.0, None, 8.0, None, None],      # head, interior, tail after a run of one
    1: [1.0, None, 2.0, 4.0, 6.0, None, None, None],       # tail on a line through three values
    2: [None] * 8,                                          # no value at all
    3: [None, None, None, 5.0, None, None, None, None],    # one value
    4: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0],           # complete
    5: [None, 2.0, 4.0, None, None, None, None, None],     # the back-filled cell counts in the run
}


@pytest.fixture(scope="module")
def shapes(spark):
    data = [(e, t, v) for e, s in SHAPES.items() for t, v in enumerate(s)]
    return spark.createDataFrame(data, "e int, t int, x double").repartition(3)


def _lists(df):
    out = {}
    for r in df.orderBy("e", "t").collect():
        out.setdefault(r["e"], []).append(None if r["x"] is None else round(r["x"], 9))
    return out


def _by_hand(s):
    """Head, tail and interior fills restated on one list."""
    x = np.array([np.nan if v is None else v for v in s], float)
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return [None] * len(s)
    x[:known[0]] = x[known[0]]
    last = known[-1]
    first = last
    while first > 0 and not np.isnan(x[first - 1]):
        first -= 1
    run, n = x[first:last + 1], len(x) - last - 1
    if n:
        x[last + 1:] = (np.polyval(np.polyfit(range(len(run)), run, 1), np.arange(len(run), len(run) + n))
                        if len(run) > 1 else run[-1])
    gaps = np.isnan(x)
    x[gaps] = np.interp(np.flatnonzero(gaps), np.flatnonzero(~gaps), x[~gaps])
    return [round(v, 9) for v in x.tolist()]


def test_edge_shapes(shapes):
    got = _lists(impute.impute_panel(shapes, SPEC, ["x"]))
    assert got == {e: _by_hand(s) for e, s in SHAPES.items()}


def test_random_shapes_and_known_cells_never_change(spark):
    rnd = np.random.default_rng(4)
    shapes = {e: [None if rnd.random() < rnd.random() else float(rnd.integers(0, 50)) for _ in range(20)]
              for e in range(60)}
    df = spark.createDataFrame([(e, t, v) for e, s in shapes.items() for t, v in enumerate(s)], "e int, t int, x double")
    got = _lists(impute.impute_panel(df, SPEC, ["x"]))
    for e, s in shapes.items():
        want = _by_hand(s)
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) for a, b in zip(got[e], want))
        assert all(a == v for a, v in zip(got[e], s) if v is not None)


def test_single_steps(shapes):
    assert _lists(impute.fill_head(shapes, SPEC, ["x"]))[0][:3] == [3.0, 3.0, 3.0]
    assert _lists(impute.fill_tail_trend(shapes, SPEC, ["x"]))[1][-3:] == [8.0, 10.0, 12.0]
    assert _lists(impute.fill_interior_linear(shapes, SPEC, ["x"]))[0] == [None, None, 3.0, 4.0, 6.0, 8.0, None, None]


def test_sparse_columns_become_zero_above_the_threshold(shapes):
    got = _lists(impute.neutralize_sparse_columns(shapes, SPEC, ["x"], 0.8))
    assert got[3] == [0.0] * 8 and got[2] == [0.0] * 8 and got[0] == SHAPES[0]


def test_unbounded_panels_are_refused(shapes):
    with pytest.raises(ValueError):
        impute.fill_head(shapes, PanelSpec.of("e", "t", bounded=False), ["x"])


def _walk_by_hand(s):
    x = list(s)
    for i, v in enumerate(x):
        if v is not None:
            continue
        past = [p for p in x[:i]]
        while past and past[0] is None:
            past = past[1:]
        if not past:
            continue
        a, b = np.array(past[:-1], float), np.array(past[1:], float)
        if len(a) < 3 or np.ptp(a) == 0:
            x[i] = past[-1]
            continue
        slope = np.clip(np.cov(a, b, bias=True)[0, 1] / np.var(a), -0.999999, 0.999999)
        x[i] = b.mean() + slope * (past[-1] - a.mean())
    return x


def test_ar1_equals_refitting_before_every_gap(spark):
    rnd = np.random.default_rng(8)
    series = {}
    for e in range(12):
        v, x = 5.0, []
        for _ in range(40):
            v = 2 + 0.6 * v + rnd.normal()
            x.append(None if rnd.random() < 0.3 else float(v))
        series[e] = x
    series[12] = [None, None, 4.0, None, None]
    series[13] = [7.0] * 6 + [None] * 3
    df = spark.createDataFrame([(e, t, v) for e, s in series.items() for t, v in enumerate(s)], "e int, t int, x double")
    got = _lists(impute_ar1(df.repartition(5), SPEC, ["x"]))
    for e, s in series.items():
        for ours, want in zip(got[e], _walk_by_hand(s)):
            assert (ours is None) == (want is None) and (ours is None or abs(ours - want) < 1e-6)


def test_ar1_finds_planted_coefficients(spark):
    rnd = np.random.default_rng(2)
    v, x = 5.0, []
    for _ in range(3000):
        v = 2 + 0.6 * v + 0.1 * rnd.normal()
        x.append(float(v))
    x.append(None)
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(x)], "e int, t int, x double")
    filled = impute_ar1(df, SPEC, ["x"]).where("t = 3000").first()["x"]
    assert abs(filled - (2 + 0.6 * x[-2])) < 0.05


def test_ar1_state_survives_batch_borders(spark):
    df = spark.createDataFrame([(e, t, float((t * 7 + e) % 5) if t % 4 else None) for e in range(3) for t in range(100)],
                               "e int, t int, x double")
    whole = _lists(impute_ar1(df, SPEC, ["x"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert _lists(impute_ar1(df, SPEC, ["x"])) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _panel(spark, shock=0.0):
    data = [(e, y, q, None if (e + y + q) % 5 == 0 else float(e + y % 7 + q) + (shock if y >= 2018 else 0.0), float(q * e))
            for e in range(4) for y in range(2014, 2021) for q in range(1, 5)]
    return spark.createDataFrame(data, "entity int, yr int, qtr int, x double, y double").where("entity < 3 or yr >= 2017 and qtr = 1")


QUARTERS = PanelSpec.of("entity", ("yr", "qtr"))


def test_test_years_do_not_reach_the_training_frames(spark):
    train = {}
    for shock in (0.0, 100.0):
        f = impute.build_train_test(_panel(spark, shock), QUARTERS, ["x"], ["y"])
        train[shock] = (f["train_x"].orderBy("entity", "yr", "qtr").collect(), f["train_y"].orderBy("entity", "yr", "qtr").collect())
    assert train[0.0] == train[100.0]


def test_four_frames(spark):
    f = impute.build_train_test(_panel(spark), QUARTERS, ["x"], ["y"])
    assert f["train_x"].columns == ["entity", "yr", "qtr", "x"] and f["test_y"].columns == ["entity", "yr", "qtr", "y"]
    assert f["train_x"].where("yr >= 2018").count() == 0 and f["test_x"].where("yr < 2018").count() == 0
    # the entity with too few training rows is in neither part
    assert all(f[k].where("entity = 3").count() == 0 for k in f)
    assert f["test_x"].where(F.col("x").isNull()).count() == 0
    assert f["test_x"].count() == f["test_y"].count() == 3 * 12


@pytest.mark.parametrize("level", [0.0, 1e8, 1e10])
def test_ar1_holds_at_any_level(rows, level):
    series = [200.0, 210.0, 190.0, 205.0, 220.0, 200.0, 195.0, None]
    got = impute_ar1(rows("e int, t int, x double", [(1, t, None if v is None else v + level) for t, v in enumerate(series)]), SPEC, ["x"])
    known = np.array(series[:-1])
    slope, base = np.polyfit(known[:-1] - 200, known[1:] - 200, 1)
    assert got.where("t = 7").first()["x"] - level == pytest.approx(200 + base + slope * (known[-1] - 200), abs=1e-4)


def test_a_key_that_occurs_twice_fails(rows):
    twice = rows("e int, yr int, x double, y double", [(1, 2016, 1.0, 1.0), (1, 2017, 2.0, 2.0), (1, 2017, 3.0, 3.0), (1, 2019, 4.0, 4.0)])
    with pytest.raises(Exception, match="holds a key twice: 1, 2017"):
        impute.build_train_test(twice, PanelSpec.of("e", "yr"), ["x"], ["y"])["train_x"].collect()


def test_series_of_any_length_are_filled_as_panels(rows):
    rnd = np.random.default_rng(4)
    data = [(e, i, None if rnd.random() < share or i < head else float(rnd.integers(0, 50)), None if i % 3 else float(i))
            for e, n, share, head in ((1, 90, 0.4, 0), (2, 40, 0.0, 7), (3, 25, 0.9, 3), (4, 6, 1.0, 0), (None, 12, 0.3, 2), (5, 1, 0.0, 0))
            for i in range(n)]
    df = rows("e int, i int, x double, y double", data).repartition(5)
    want = impute.impute_panel(df, PanelSpec.of("e", "i"), ["x", "y"]).collect()
    # blocks far smaller than the series
    found = impute.impute_events(df, PanelSpec.of("e", "i", bounded=False, block_rows=7), ["x", "y"])
    assert found.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for one, two in zip(sorted(want, key=key), sorted(found.collect(), key=key), strict=True):
        assert one[:2] == two[:2]
        assert all(x is y if x is None else x == pytest.approx(y, rel=1e-9, abs=1e-9) for x, y in zip(one[2:], two[2:], strict=True))


def test_wide_panels_are_filled_like_narrow_ones(rows):
    rnd = random.Random(4)
    data = [(e, i, f"s{e}", *[rnd.choice([None, None, round(rnd.uniform(-5, 5), 2)]) for _ in range(6)]) for e in (1, 2, None) for i in range(12)]
    names = [f"m{n}" for n in range(6)]
    df = rows("e int, i int, note string, " + ", ".join(f"`{n}` double" for n in names), data).select("note", *[f"`{n}`" for n in names], "i", "e")
    spec = PanelSpec.of("e", "i")
    wide = impute.impute_wide(df, spec, names)
    assert wide.columns == df.columns
    key = lambda r: (r["e"] is None, r["e"] or 0, r["i"])
    for one, two in zip(sorted(impute.impute_panel(df, spec, names).collect(), key=key), sorted(wide.collect(), key=key), strict=True):
        assert one["note"] == two["note"]
        assert all(two[n] is None if one[n] is None else two[n] == pytest.approx(one[n], rel=1e-9, abs=1e-9) for n in names)
    lines = lambda cols: impute.impute_wide(df, spec, cols)._jdf.queryExecution().executedPlan().toString().count("\n")
    assert lines(names) == lines(names[:2])
    with pytest.raises(Exception, match="key twice"):
        impute.impute_wide(df.unionAll(df), spec, names).collect()
    assert impute.impute_wide(df.where("false"), spec, names).collect() == []


def test_wide_measures_are_filled_without_a_row_for_each_cell(rows):
    nan, inf = float("nan"), float("inf")
    data = [(1, i, *v) for i, v in enumerate([(None, nan, None, 1.0), (2.0, None, None, None), (None, 3.0, None, inf), (None, None, None, 2.0),
                                              (5.0, 4.0, None, None), (nan, None, None, -0.5), (None, None, None, None)])]
    data += [(2, 0, None, 1.0, None, 7.0), (2, 1, None, None, nan, None), (None, 0, 1.0, None, 2.0, None)]
    names = ["a", "b", "c", "e"]
    df = rows("k int, i int, " + ", ".join(f"`{n}` double" for n in names), data).repartition(3)
    spec = PanelSpec.of("k", "i")
    wide = impute.impute_wide(df, spec, names)
    key = lambda r: (r["k"] is None, r["k"] or 0, r["i"])
    for one, two in zip(sorted(impute.impute_panel(df, spec, names).collect(), key=key), sorted(wide.collect(), key=key), strict=True):
        assert str(one) == str(two)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Window") <= 4
