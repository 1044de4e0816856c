import datetime as dt

import pytest
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from quarterdeck.functions.dates import parse_date
from quarterdeck.functions.numeric import parse_numeric_text
from quarterdeck.operators import clean, derive, joins, reshape
from quarterdeck.sources.tables import (drop_suffixed_columns, read_csv_typed, read_sheet_set, sanitize_columns,
                                        write_dataset)


def _schema(**kinds):
    return StructType([StructField(k, v) for k, v in kinds.items()])


def test_csv_cells_that_do_not_fit_are_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x\na,1.5\nb,oops\nc,\nd,1,2\n")
    schema = _schema(k=StringType(), x=DoubleType())
    read = lambda **how: read_csv_typed(spark, str(tmp_path), schema, **how)
    assert [tuple(r) for r in read().collect()] == [("a", 1.5), ("b", None), ("c", None), ("d", 1.0)]
    assert [r["k"] for r in read(misfits="drop").select("k").collect()] == ["a", "c"]
    bad = read(rejected=True)
    assert [r["_bad_row"] for r in bad.collect()] == ["b,oops", "d,1,2"] and bad.count() == 2
    assert (read().count(), read(misfits="drop").count()) == (4, 2)
    with pytest.raises(Exception, match="b,oops"):
        read(misfits="fail").collect()
    with pytest.raises(ValueError):
        read(misfits="ignore")


@pytest.mark.parametrize("titles", [[], ["Rigs"], ["Back", ","], [",", "1970,1971,1972"]])
def test_lines_are_skipped_by_their_place(spark, tmp_path, titles):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text("\n".join([*titles, "k,1970,1971", f"a{n},1,2", "", f"b{n},3,"]) + "\n")
    schema = _schema(**{"k": StringType(), "1970": DoubleType(), "1971": DoubleType()})
    got = sorted(map(tuple, read_csv_typed(spark, str(tmp_path), schema, skip=len(titles)).collect()))
    assert got == sorted(r for n in range(3) for r in ((f"a{n}", 1.0, 2.0), (f"b{n}", 3.0, None)))


def test_sheets_with_title_lines(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(f"Back\nKeys,x\nDate,Value\n2020-01-0{len(name) - 2},4\n")
    sheets = read_sheet_set(spark, str(tmp_path), {n: _schema(d=DateType(), v=IntegerType()) for n in ("one", "two")}, 2)
    assert [tuple(r) for r in sheets["two"].collect()] == [(dt.date(2020, 1, 1), 4, "two")]
    texts = read_csv_typed(spark, f"{tmp_path}/one", _schema(k=StringType(), v=StringType()), skip=2)
    assert [tuple(r) for r in texts.collect()] == [("2020-01-01", "4")]


def test_written_by_year_and_read_with_pruning(spark, rows, tmp_path):
    path = write_dataset(rows("yr int, x int", [(2000, 1), (2001, 2), (2001, 3)]), str(tmp_path / "out"), ["yr"])
    back = spark.read.parquet(path).where("yr = 2001")
    assert sorted(r["x"] for r in back.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(yr" in back._jdf.queryExecution().executedPlan().toString()


def test_column_names(rows):
    df = rows("`a` int, `a.1` int, `b c` int", [(1, 2, 3)])
    assert drop_suffixed_columns(df).columns == ["a", "b c"]
    assert sanitize_columns(drop_suffixed_columns(df), "p_").columns == ["p_a", "p_b_c"]
    with pytest.raises(ValueError):
        sanitize_columns(rows("`a b` int, `a_b` int", [(1, 2)]))


@pytest.mark.parametrize("text, fmt, want", [
    ("20200131", "yyyyMMdd", dt.date(2020, 1, 31)), ("31/01/2020", "dd/MM/yyyy", dt.date(2020, 1, 31)),
    ("2020-02", "yyyy-MM", dt.date(2020, 2, 1)), ("20201", "yyyyMM", dt.date(2020, 1, 1)),
    ("202011", "yyyyMM", dt.date(2020, 11, 1)), ("Jan-97", "MMM-yy", dt.date(1997, 1, 1)),
    ("Feb-05", "MMM-yy", dt.date(2005, 2, 1)), ("Dec-68", "MMM-yy", dt.date(2068, 12, 1)),
    ("Jan-69", "MMM-yy", dt.date(1969, 1, 1)), ("19700", "year-week", dt.date(1969, 12, 29)),
    ("19701", "year-week", dt.date(1970, 1, 5)), ("201252", "year-week", dt.date(2012, 12, 24)),
    ("2020-13", "yyyy-MM", None), ("junk", "yyyyMMdd", None), (None, "year-week", None)])
def test_dates(rows, text, fmt, want):
    assert rows("s string", [(text,)]).select(parse_date("s", fmt)).first()[0] == want


def test_numbers_in_text(rows):
    df = rows("s string", [("1,234.5 E",), (" ",), ("--",), ("7",), (None,)])
    assert [r[0] for r in df.select(parse_numeric_text("s")).collect()] == [1234.5, None, None, 7.0, None]


def test_periods_by_kind(rows):
    df = rows("label string", [("2020 A",), ("2020 Q3",), ("2019 Q1 restated",), ("FQ4 2021 - Dec 2021",), ("x",), (None,)])
    got = lambda kind: [tuple(r)[1:] for r in clean.parse_fiscal_period(df, "label", kind).collect()]
    assert got("annual") == [(2020,)]
    assert got("quarter") == [(2020, 3), (2019, 1)]
    assert got("estimate") == [(2021, 4)]


def test_sentinels(rows):
    df = rows("i int, x double, s string", [(0, 0.0, "0"), (1, float("inf"), "NULL"), (2, float("nan"), "--"), (3, 2.5, " ")])
    assert [tuple(r) for r in clean.sentinels_to_null(df).collect()] == [
        (None, None, "0"), (1, None, None), (2, None, None), (3, 2.5, None)]


def test_outlier_keeps_nulls_and_empty_columns(rows):
    df = rows("x double, y double", [(9.0, 1.0), (1.0, 9.0), (None, 2.0), (2.0, None)])
    assert [tuple(r) for r in clean.drop_max_outlier(df, "x", ["y"]).collect()] == [(None, 2.0), (2.0, None)]
    empty = rows("x double", [(None,), (None,)])
    assert clean.drop_max_outlier(empty, "x").count() == 2


def test_rows_with_the_training_maximum_anywhere(rows):
    train = rows("x double, i int", [(5.0, 1), (3.0, 5)])
    test = rows("x double, i int", [(4.0, 5), (None, 6), (5.0, 1)])
    assert [tuple(r) for r in clean.drop_rows_containing(test, train, "x").collect()] == [(None, 6)]
    assert clean.drop_rows_containing(train, train, "x").count() == 0


def test_last_label_of_a_code_wins(rows):
    dim = rows("code int, label string, pos int", [(1, "old", 1), (1, "new", 2), (2, "x", 1), (2, None, 2)])
    got = clean.map_codes(rows("c int", [(1,), (2,), (3,), (None,)]), dim, {"c": ("code", "label")}, "pos")
    assert {r["c"]: r["c_mapped"] for r in got.collect()} == {1: "new", 2: None, 3: None, None: None}


def test_categories_unseen_in_training_share_an_index(rows):
    model = clean.index_categories(rows("c string", [("a",), ("b",), ("b",)]), ["c"])
    got = model.transform(rows("c string", [("a",), ("b",), ("z",)])).collect()
    assert [r["c_index"] for r in got] == [1.0, 0.0, 2.0]


def test_ratio_by_zero_and_logs(rows):
    df = rows("a double, b double", [(1.0, 0.0), (-1.0, 2.0)])
    got = derive.log_features(derive.interaction_features(df, ["a", "b"]), ["a", "b"]).collect()
    assert [(r["a_over_b"], r["a_times_b"]) for r in got] == [(None, 0.0), (-0.5, -2.0)]
    assert got[0]["b_log"] is None and got[1]["a_log"] is None and got[0]["a_log"] == 0.0


def test_repeated_cells_are_an_error(rows):
    df = rows("m int, k string, v int", [(1, "a", 1), (1, "a", 2)])
    with pytest.raises(Exception, match="several values"):
        reshape.pivot_series(df, ["m"], "k", "v", {"a": "a"}).collect()


def test_joins_on_null_keys(rows):
    l, r = rows("k int, x int", [(None, 1), (1, 2)]), rows("k int, y int", [(None, 3), (1, 4)])
    assert {(a["x"], a["y"]) for a in joins.join_dimension(l, r, "k").collect()} == {(1, None), (2, 4)}
    assert {(a["x"], a["y"]) for a in joins.join_dimension(l, r, "k", null_safe=True).collect()} == {(1, 3), (2, 4)}


def test_statements_keep_the_first_copy_of_a_column(rows):
    a, b, c = rows("k int, x int", [(1, 1)]), rows("k int, x int, y int", [(1, 9, 2)]), rows("k int, y int, z int", [(1, 9, 3)])
    assert joins.join_statements(a, b, c, keys=["k"]).collect()[0].asDict() == {"k": 1, "x": 1, "y": 2, "z": 3}


def test_filters_reach_the_scan(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = clean.filter_between_dates(clean.filter_in(li, "l_returnflag", ["A"]), "l_shipdate", "1996-01-01", "1997-01-01") \
        .select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_shipdate" in plan and "EqualTo(l_returnflag,A)" in plan
    assert "l_extendedprice" not in plan


def test_dividend_sign_and_unknown_entity(rows):
    from quarterdeck.panel import PanelSpec
    df = rows("e string, t int, rf double, m double, pay double, roe double, d double, s double, p double",
              [("a", i, 0.02, 0.07, 50.0, 0.1, 1.0 + i, 10.0, 100.0) for i in range(4)] + [("z", 0, 0.02, 0.07, 50.0, 0.1, 1.0, 10.0, 100.0)])
    params = rows("e string, beta double, price_col string", [("a", 0.8, "p")])
    args = dict(risk_free="rf", market_return="m", payout="pay", roe_growth="roe", dividend="d", shares="s", prices=["p"])
    got = {(r["e"], r["t"]): r for r in derive.dividend_estimate(df, PanelSpec.of("e", "t"), params, **args).collect()}
    last = got[("a", 3)]
    required, growth = 0.02 - 0.8 * 0.05, (4.0 - 1.0) / 3.0
    assert last["required_return"] == pytest.approx(required) and last["dividend_growth_rate"] == pytest.approx(growth)
    assert last["estimated_NI_wD1"] == pytest.approx(100 * (required - growth) * 10 / 0.5)
    assert got[("z", 0)]["D1"] is None and got[("z", 0)]["required_return"] == pytest.approx(0.02 - 1.2 * 0.05)
    plus = derive.dividend_estimate(df, PanelSpec.of("e", "t"), params, capm_sign=1, **args)
    assert plus.where("e = 'a'").first()["required_return"] == pytest.approx(0.02 + 0.8 * 0.05)
