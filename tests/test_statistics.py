import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import aggregate, crosssection, drift


def _values(spark, arrays):
    return spark.createDataFrame([(g, None if v is None else float(v)) for g, a in arrays.items() for v in a],
                                 "x string, v double").repartition(5)


def test_positions_give_exact_quantiles(spark):
    rnd = np.random.default_rng(1)
    arrays = {"normal": rnd.normal(0, 1e6, 4001), "ties": rnd.integers(0, 3, 5000), "spread": 10.0 ** rnd.uniform(-20, 20, 997),
              "signs": np.concatenate([-(10.0 ** rnd.uniform(0, 9, 500)), 10.0 ** rnd.uniform(0, 9, 501)]),
              "constant": np.full(300, 7.25), "two": [1.0, 2.0], "one": [3.0], "mostly": [0.0] * 3000 + [1.0] * 5 + [1e9]}
    got = crosssection.group_quantiles(_values(spark, arrays), ["x"], "v", (0.0, 0.25, 0.5, 0.75, 1.0), group_limit=100)
    found = {r["x"]: r["quantiles"] for r in got.collect()}
    for g, a in arrays.items():
        np.testing.assert_allclose(found[g], np.quantile(a, [0, 0.25, 0.5, 0.75, 1]), rtol=1e-12, err_msg=g)


def test_both_ways_take_the_same_values(spark):
    inf = float("inf")
    arrays = {"low": [-inf, *range(9)], "high": [*range(9), inf], "both": [-inf, inf, 1.0], "small": [0.0, 5e-324], "subnormal": [5e-324, 1e-323, 2e-323],
              "all": [inf] * 5, "large": [1.7e308, -1.7e308, 1.7e308]}
    values, probs = _values(spark, arrays), (0.0, 0.25, 0.5, 0.75, 1.0)
    few, many = ({r["x"]: [str(q) for q in r["quantiles"]] for r in crosssection.group_quantiles(values, ["x"], "v", probs, limit).collect()}
                 for limit in (10 ** 6, 0))
    assert few == many


def test_null_values_and_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), (None, 5.0), ("b", None)], "x string, v double")
    for limit in (0, 100):
        assert {r["x"]: r["quantiles"] for r in crosssection.group_quantiles(df, ["x"], "v", (0.5,), limit).collect()} == {"a": [2.0]}


def test_statistics_of_null_groups_are_null(spark):
    df = spark.createDataFrame([(1, "a", "s", 1.0), (1, "a", "s", 3.0), (1, None, "s", 5.0), (2, "a", None, None)],
                               "q int, g string, h string, v double")
    for limit in (0, 100):
        out = crosssection.group_statistics(df, ["v"], ["g", "h"], ["q"], limit).orderBy("q", "v").collect()
        assert out[0]["v_g_mean"] == 2.0 and out[0]["v_g_std"] == pytest.approx(2 ** 0.5) and out[0]["v_g_q1"] == 1.5
        assert out[2]["v_g_mean"] is None and out[2]["v_g_median"] is None and out[2]["v_h_median"] == 3.0
        assert out[3]["v_g_max"] is None and out[3]["v_h_min"] is None and len(out) == 4


def test_totals_of_missing_are_zero(rows):
    out = crosssection.period_total(rows("q int, v double", [(1, 2.0), (1, None), (2, None)]), ["v"], ["q"])
    assert {r["q"]: r["v_industry_sum"] for r in out.collect()} == {1: 2.0, 2: 0.0}


@pytest.mark.parametrize("bins", [3, 10, 37])
def test_histogram_equals_numpy(spark, bins):
    rnd = np.random.default_rng(bins)
    base = np.round(rnd.normal(0, 1, 700), 1)
    other = np.concatenate([np.round(rnd.normal(0.5, 1.5, 900), 1), np.linspace(base.min(), base.max(), bins + 1)])
    frame = lambda a: spark.createDataFrame([(float(v),) for v in a] + [(None,)], "v double")
    got = drift.equal_width_histogram(frame(other), ["v"], bins, frame(base)).orderBy("bin").collect()
    counts, edges = np.histogram(other, bins=np.histogram_bin_edges(base, bins=bins))
    assert [r["n"] for r in got] == counts.tolist()
    np.testing.assert_allclose([r["lower"] for r in got] + [got[-1]["upper"]], edges, rtol=0, atol=1e-12)


def test_histogram_of_one_value_is_widened(rows):
    got = drift.equal_width_histogram(rows("v double", [(3.0,), (3.0,)]), ["v"], 2).orderBy("bin").collect()
    assert [(r["lower"], r["upper"], r["n"]) for r in got] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]


def test_histograms_of_odd_values_pass_no_row_for_each_cell(rows):
    nan, inf = float("nan"), float("inf")
    schema = "plain double, none double, whole int, some_nan double, infinite double"
    base = rows(schema, [(0.0, None, 1, 1.0, -inf), (10.0, None, 3, nan, 2.0), (None, None, None, 2.0, inf)]).repartition(3)
    other = rows(schema, [(0.0, 1.0, 1, 1.0, 1.0), (10.0, None, 2, nan, inf), (nan, None, 3, 3.0, nan), (-0.1, None, 4, None, 0.0), (9.999, nan, None, 1.5, -inf),
                          (2.0, None, 2, nan, 5.0), (1.9999999999999998, inf, 2, inf, None)]).repartition(2)
    names = schema.replace(" double", "").replace(" int", "").split(", ")
    out = drift.equal_width_histogram(other, names, 5, base)
    got = {}
    for r in out.collect():
        got.setdefault(r["column"], {})[r["bin"]] = r["n"]
    counts = {c: [n[b] for b in range(5)] for c, n in got.items()}
    assert counts == {"plain": [2, 1, 0, 0, 2], "whole": [1, 0, 3, 0, 1], "some_nan": [0, 2, 0, 0, 0], "infinite": [0, 0, 0, 0, 0]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "MapInArrow" in plan


def test_psi(spark):
    rnd = np.random.default_rng(42)
    a = spark.createDataFrame([(float(x), float(y)) for x, y in zip(rnd.normal(0, 1, 1000), rnd.uniform(0, 1, 1000))], "x double, y double")
    b = spark.createDataFrame([(float(x), float(y)) for x, y in zip(rnd.normal(0.5, 1, 800), rnd.uniform(0, 1, 800))], "x double, y double")
    assert all(r["psi"] == 0 for r in drift.population_stability_index(a, a, ["x", "y"]).collect())
    got = {r["column"]: r["psi"] for r in drift.population_stability_index(a, b, ["x", "y"]).collect()}
    for i, c in enumerate("xy"):
        e, o = (np.array([r[i] for r in d.collect()]) for d in (a, b))
        edges = np.histogram_bin_edges(e, bins=10)
        pe, po = (np.clip(np.histogram(v, bins=edges)[0] / np.histogram(v, bins=edges)[0].sum(), 1e-10, 1) for v in (e, o))
        assert got[c] == pytest.approx(np.sum((pe - po) * np.log(pe / po)), rel=1e-9)


def test_metrics_of_edge_groups(rows):
    df = rows("g string, y double, p double", [("met", 2.0, 2.0), ("met", 2.0, 2.0), ("missed", 2.0, 2.0), ("missed", 2.0, 3.0),
                                              ("one", 1.0, 2.0), ("ok", 1.0, 1.0), ("ok", 2.0, 3.0), ("ok", 3.0, 3.0),
                                              ("ok", None, 1.0), ("ok", 9.0, None)])
    got = {r["g"]: r for r in aggregate.regression_metrics(df, "y", "p", ["g"]).collect()}
    assert (got["met"]["r2"], got["missed"]["r2"], got["one"]["r2"]) == (1.0, 0.0, None)
    assert got["ok"]["n"] == 3 and got["ok"]["r2"] == pytest.approx(0.5) and got["ok"]["rmse"] == pytest.approx((1 / 3) ** 0.5)
    assert aggregate.group_count(df.withColumn("g", F.nullif("g", F.lit("one"))), ["g"]).count() == 3
