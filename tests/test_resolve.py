import datetime
import random
import re

from pyspark.sql import functions as F

from quarterdeck.operators import resolve
from quarterdeck.operators.resolve import (ACCOUNTING_STANDARD_RANK, FILING_STATUS_RANK, latest_revision,
                                           latest_revision_join, resolve_by_priority, resolve_wide)

SCHEMA = "k string, x double, d int, c string, s string, a string"
ARGS = ("d", "c", "s", "a")


def _resolved(df, value="x"):
    return {r["k"]: r[value] for r in resolve_by_priority(df, ["k"], [value], *ARGS).collect()}


def _by_rules(group):
    """The rules restated as successive filters of a list of rows."""
    left = [g for g in group if g["x"] is not None]
    only = lambda part: {g["x"] for g in part}
    if len(only(left)) <= 1:
        return left[0]["x"] if left else None
    for step in ("d", "c", "s", "a"):
        if step == "d":
            dates = [g["d"] for g in left if g["d"] is not None]
            left = [g for g in left if dates and g["d"] == max(dates)]
        elif step == "c":
            left = [g for g in left if g["c"] == "Y"] or left
        else:
            ranks = FILING_STATUS_RANK if step == "s" else ACCOUNTING_STANDARD_RANK
            known = [ranks[g[step]] for g in left if g[step] in ranks]
            left = [g for g in left if known and ranks.get(g[step]) == min(known)]
        if len(only(left)) == 1:
            return left[0]["x"]
    return None


def test_one_golden_per_stage(rows):
    data = [
        ("single", 5.0, None, None, None, None), ("single", 5.0, 3, "N", "ER", "x"), ("single", None, 9, "Y", "MR", "US GAAP"),
        ("empty", None, 1, "Y", "MR", "US GAAP"),
        ("date", 1.0, 1, "Y", "MR", "US GAAP"), ("date", 2.0, 2, "N", "ER", "x"),
        ("cons", 1.0, 2, "N", "MR", "US GAAP"), ("cons", 2.0, 2, "Y", "ER", "x"),
        ("status", 1.0, 2, "Y", "PR", "x"), ("status", 2.0, 2, "Y", "OR", "x"), ("status", 3.0, 2, "N", "MR", "x"),
        ("nostatus_y", 1.0, 2, "N", "RS", "x"), ("nostatus_y", 2.0, 2, "N", "ER", "US GAAP"),
        ("standard", 1.0, 2, "Y", "MR", "US GAAP"), ("standard", 2.0, 2, "Y", "MR", "IAS/IFRS"),
        ("undecided", 1.0, 2, "Y", "MR", "US GAAP"), ("undecided", 2.0, 2, "Y", "MR", "US GAAP"),
        ("unknown_status", 1.0, 2, "Y", "??", "US GAAP"), ("unknown_status", 2.0, 2, "Y", None, "IAS/IFRS"),
        ("unknown_standard", 1.0, 2, "Y", "MR", "a"), ("unknown_standard", 2.0, 2, "Y", "MR", "b"),
        ("no_dates", 1.0, None, "Y", "MR", "US GAAP"), ("no_dates", 2.0, None, "N", "ER", "x"),
        (None, 1.0, 1, "Y", "MR", "US GAAP"),
    ]
    assert _resolved(rows(SCHEMA, data)) == {
        "single": 5.0, "empty": None, "date": 2.0, "cons": 2.0, "status": 2.0, "nostatus_y": 1.0, "standard": 2.0,
        "undecided": None, "unknown_status": None, "unknown_standard": None, "no_dates": None}


def test_random_groups_follow_the_rules_in_any_layout(rows):
    rnd = random.Random(7)
    data = [(f"g{rnd.randrange(400)}", rnd.choice([None, 1.0, 2.0, 3.0]), rnd.choice([None, 1, 2, 3]),
             rnd.choice(["Y", "N", None]), rnd.choice([*FILING_STATUS_RANK, "??", None]),
             rnd.choice([*ACCOUNTING_STANDARD_RANK, "other"])) for _ in range(3000)]
    names = ["k", "x", "d", "c", "s", "a"]
    groups = {}
    for r in data:
        groups.setdefault(r[0], []).append(dict(zip(names, r)))
    want = {k: _by_rules(g) for k, g in groups.items()}
    df = rows(SCHEMA, data)
    assert _resolved(df) == want
    assert _resolved(df.orderBy(F.rand(3)).repartition(7)) == want


def test_update_times_instead_of_days(rows):
    rnd = random.Random(11)
    data = [(f"g{rnd.randrange(50)}", rnd.choice([1.0, 2.0, 3.0]), rnd.randrange(4), rnd.choice("YN"),
             rnd.choice(["MR", "OR"]), rnd.choice([*ACCOUNTING_STANDARD_RANK])) for _ in range(400)]
    df = rows(SCHEMA, data)
    timed = df.withColumn("d", F.timestamp_seconds("d"))
    plan = resolve_by_priority(timed, ["k"], ["x"], *ARGS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    assert _resolved(timed) == _resolved(df)


def test_text_and_several_columns(rows):
    df = rows("k int, v string, x double, d int, c string, s string, a string",
              [(1, "old", 1.0, 1, "Y", "MR", "x"), (1, "new", None, 2, "Y", "MR", "x")])
    got = resolve_by_priority(df, ["k"], ["v", "x"], *ARGS).first()
    assert (got["v"], got["x"]) == ("new", 1.0)


def test_plan_has_two_exchanges_and_no_python(rows):
    df = rows(SCHEMA, [("a", 1.0, 1, "Y", "MR", "x")])
    plan = resolve_by_priority(df, ["k"], ["x"], *ARGS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Python" not in plan and "SortAggregate" not in plan


def test_latest_revision_keeps_ties_and_null_groups(rows):
    df = rows("k string, j int, r int, v int", [("a", 1, 1, 1), ("a", 1, 2, 2), ("a", 1, 2, 3), ("b", 1, None, 4),
                                               ("b", 1, None, 5), (None, 1, 1, 6), (None, 1, 3, 7), ("c", None, 1, 8)])
    assert sorted(r["v"] for r in latest_revision(df, ["k", "j"], "r").collect()) == [2, 3, 4, 5, 7, 8]


def test_latest_revision_join_is_inner_and_repeats_ties(rows):
    base = rows("k string, w int", [("a", 1), ("z", 2)])
    rev = rows("k string, r int, v int", [("a", 1, 1), ("a", 2, 2), ("a", 2, 3)])
    got = latest_revision_join(base, rev, ["k"], "r").collect()
    assert sorted((r["k"], r["w"], r["v"]) for r in got) == [("a", 1, 2), ("a", 1, 3)]


def test_wide_measures_are_resolved_as_narrow_ones(rows):
    rnd = random.Random(8)
    pick = lambda *of: rnd.choice([*of, None])
    schema = "k string, j int, x double, y string, z double, u date, d int, c string, s string, a string"
    data = [(rnd.choice("abcdef"), rnd.choice([1, 2, None]), pick(1.0, 2.0, 0.0), pick("p", "q"), pick(5.0, float("nan")), None,
             pick(1, 2), pick("Y", "N"), pick("MR", "OR", "zz"), pick("IAS/IFRS", "US GAAP", "zz")) for _ in range(400)]
    data += [("empty", 1, None, None, None, None, 1, "Y", "MR", "US GAAP"), (None, 1, 1.0, "p", 1.0, None, 1, "Y", "MR", "US GAAP")]
    df = rows(schema, data)
    args = (df, ["k", "j"], ["x", "y", "z", "u"], *ARGS)
    wide, narrow = resolve_wide(*args), resolve_by_priority(*args)
    assert wide.dtypes == narrow.dtypes
    assert sorted(map(repr, wide.collect())) == sorted(map(repr, narrow.collect())) and wide.count() == 13


def test_wide_measures_take_two_exchanges(rows):
    df = rows("k string, " + ", ".join(f"m{i} double" for i in range(300)) + ", d int, c string, s string, a string",
              [("a", *map(float, range(300)), 1, "Y", "MR", "US GAAP")])
    found = resolve_wide(df, ["k"], [f"m{i}" for i in range(300)], *ARGS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert list(found.first()[1:]) == list(map(float, range(300)))


def test_wide_measures_travel_in_runs_and_not_as_cells(rows):
    schema = "k string, " + ", ".join(f"m{i} double" for i in range(150)) + ", d int, c string, s string, a string"
    blank = [None] * 150
    df = rows(schema, [("a", *blank[:70], 7.0, *blank[71:], 1, "Y", "MR", "US GAAP"), ("a", *blank[:70], 8.0, *blank[71:], 2, "Y", "MR", "US GAAP"),
                       ("a", *blank[:149], 9.0, 0, "N", "zz", None), ("b", *blank, 1, "Y", "MR", "US GAAP")])
    found = resolve_wide(df, ["k"], [f"m{i}" for i in range(150)], *ARGS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and "_run" in dealt[1] and not any("_at" in line for line in dealt)
    assert plan.index("_xs") < plan.rindex("Exchange hashpartitioning")
    assert {r["k"]: {i: v for i, v in enumerate(r[1:]) if v is not None} for r in found.collect()} == {"a": {70: 8.0, 149: 9.0}, "b": {}}


def test_wide_measures_are_aggregated_as_columns_of_a_row_and_not_as_cells(rows, monkeypatch):
    schema = "k string, " + ", ".join(f"m{i} double" for i in range(150)) + ", d int, c string, s string, a string"
    df = rows(schema, [("a", *map(float, range(150)), 1, "Y", "MR", "US GAAP"), ("b", *[None] * 150, 1, "Y", "MR", "US GAAP")])
    taken, grouped = [], resolve._grouped
    monkeypatch.setattr(resolve, "_grouped", lambda df, *args: taken.append(df) or grouped(df, *args))
    found = {r["k"]: list(r[1:]) for r in resolve_wide(df, ["k"], [f"m{i}" for i in range(150)], *ARGS).collect()}
    assert found == {"a": list(map(float, range(150))), "b": [None] * 150}
    # three runs of 64 for the first row, one for the row without values; 16 measures a row
    assert taken[0].count() == 4 * (resolve.RUN // resolve.SIDE)


def test_wide_measures_are_resolved_across_the_borders_of_runs(rows, monkeypatch):
    rnd = random.Random(5)
    names = [f"m{i}" for i in range(11)]
    schema = "k string, " + ", ".join(f"{m} {'string' if i % 4 == 3 else 'double'}" for i, m in enumerate(names)) + ", d date, c string, s string, a string"
    day = lambda n: n and datetime.date(2020, 1, n)
    data = [(rnd.choice(["a", "b", "c", None]), *[None if rnd.random() < 0.7 else rnd.choice("pq") if i % 4 == 3 else rnd.choice([1.0, 2.0, 0.0]) for i in range(11)],
             day(rnd.choice([None, 1, 2, 3])), rnd.choice(["Y", "N", None]), rnd.choice(["MR", "PR", "??", None]), rnd.choice(["IAS/IFRS", "x"]))
            for _ in range(120)]
    df = rows(schema, data + [("empty", *[None] * 11, None, None, None, None)])
    narrow = sorted(map(repr, resolve_by_priority(df, ["k"], names, *ARGS).collect()))
    for run, side in ((4, 2), (2, 2), (64, 16)):
        monkeypatch.setattr(resolve, "RUN", run)
        monkeypatch.setattr(resolve, "SIDE", side)
        assert sorted(map(repr, resolve_wide(df, ["k"], names, *ARGS).collect())) == narrow and len(narrow) == 4


def test_groups_of_a_resolution_are_dealt_to_as_many_tasks_as_shuffles_have(spark, rows):
    df = rows("k int, x double, d date, c string, s string, a string", [(i, 1.0, None, "Y", "MR", "US GAAP") for i in range(50)])
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        found = resolve_by_priority(df, ["k"], ["x"], *ARGS)
        assert found.rdd.getNumPartitions() == 7 and found.count() == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_days_are_resolved_as_numbers_and_rows_are_dealt_out_before_they_are_held(rows):
    rnd = random.Random(11)
    data = [(rnd.choice(["a", "b", "c", "d", None]), rnd.choice([None, 1.0, 2.0]), rnd.choice([None, 1, 2, 3]), rnd.choice(["Y", "N", None]),
             rnd.choice(["MR", "PR", "??", None]), rnd.choice(["IAS/IFRS", "x"])) for _ in range(60)]
    data += [("heavy", 5.0, None, "Y", "MR", "x")] * 900 + [("late", 1.0, 1, "Y", "MR", "x")] * 300 + [("late", 7.0, 3, "N", "MR", "x")] * 300
    plain = rows(SCHEMA, data).repartition(7)
    days = plain.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    assert _resolved(days) == _resolved(plain)
    plan = resolve_by_priority(days, ["k"], ["x"], *ARGS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    # read upwards: the exchange of the rows lies below every aggregate
    assert plan.rindex("HashAggregate") < plan.rindex("Exchange hashpartitioning")


def test_the_tasks_of_a_resolution_grow_with_the_files_read(spark, rows, tmp_path, monkeypatch):
    at = str(tmp_path / "some rows")
    rows("k int, x double, d date, c string, s string, a string",
         [(i % 50, float(i), None, "Y", "MR", "US GAAP") for i in range(2000)]).coalesce(1).write.parquet(at)
    (size,) = [f.stat().st_size for f in (tmp_path / "some rows").glob("*.parquet")]
    monkeypatch.setattr(resolve, "DEALT", size // 10)
    monkeypatch.setattr(resolve, "FOLDED", size // 40)
    found = resolve_by_priority(spark.read.parquet(at), ["k"], ["x"], *ARGS)
    assert found.rdd.getNumPartitions() >= 40 and found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt, folded = sorted({int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", plan)})
    assert 10 <= dealt < 40 <= folded


def test_rows_are_dealt_out_to_no_more_tasks_than_a_map_side_writes_to_without_holding_them(spark, rows, tmp_path, monkeypatch):
    at = str(tmp_path / "rows")
    rows("k int, x double, d date, c string, s string, a string",
         [(i % 50, float(i), None, "Y", "MR", "US GAAP") for i in range(2000)]).coalesce(1).write.parquet(at)
    (size,) = [f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet")]

    def tasks():
        """Of the rows and of the groups; read upwards, the exchange of the rows is the last one."""
        plan = resolve_by_priority(spark.read.parquet(at), ["k"], ["x"], *ARGS)._jdf.queryExecution().executedPlan().toString()
        return [int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", plan)][::-1]

    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        assert tasks() == [200, 300]
        # rows of which each task would get too much are held by the map side instead
        monkeypatch.setattr(resolve, "DEALT_HELD", size // 250)
        dealt, folded = tasks()
        assert 250 <= dealt < 300 == folded
        assert resolve_by_priority(spark.read.parquet(at), ["k"], ["x"], *ARGS).count() == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
