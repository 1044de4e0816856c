"""Types found from cells, and tables written in buckets."""

import uuid

from pyspark.sql import functions as F

from quarterdeck.operators import impute
from quarterdeck.operators.joins import join_on_period
from quarterdeck.panel import PanelSpec
from quarterdeck.sources.tables import infer_types, read_csv_inferred, write_bucketed


def test_types(rows):
    data = [("1", " 2.5", "2020-01-31", "x", None, "1", "9999999999999999999", "1e400"), ("+7", "-3", "2021-12-01", "", " ", "2.", "1", "2"),
            ("-0", ".5e3", "1999-02-28", "1", "", "n/a", "2", "3"), (None, "4", "2020-02-30", "2", None, "3", "3", "4")]
    df = rows(", ".join(f"`c.{i}` string" for i in range(8)), data)
    kinds = {r["name"]: r["type"] for r in infer_types(df).collect()}
    assert [kinds[f"c.{i}"] for i in range(8)] == ["bigint", "double", "string", "string", "string", "string", "double", "double"]
    loose = {r["name"]: r["type"] for r in infer_types(df, misfits=0.25).collect()}
    assert [loose[f"c.{i}"] for i in range(8)] == ["bigint", "double", "date", "string", "string", "double", "bigint", "bigint"]
    assert infer_types(df.where("false")).collect() == []


def test_reading_with_found_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b b,c\n1,2020-01-01,x\n2,,\n")
    (tmp_path / "b.csv").write_text("a,b b,c\n3.5,2020-01-02,3\n")
    df = read_csv_inferred(spark, str(tmp_path))
    assert df.dtypes == [("a", "double"), ("b b", "date"), ("c", "string")]
    assert sorted(r["a"] for r in df.collect()) == [1.0, 2.0, 3.5]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("a,b\n")
    assert read_csv_inferred(spark, str(tmp_path / "empty")).dtypes == [("a", "string"), ("b", "string")]


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_buckets_spare_the_exchanges(spark, tmp_path):
    panel = spark.range(4000).select((F.col("id") % 50).alias("e"), (F.col("id") / 50).cast("int").alias("i"),
                                     F.when(F.col("id") % 7 > 1, F.col("id").cast("double")).alias("x"))
    names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    one, two = (write_bucketed(panel, n, ["e"], ["i"], 4, str(tmp_path / n)) for n in names)
    spec = PanelSpec.of("e", "i")
    before, after = impute.impute_panel(panel, spec, ["x"]), impute.impute_panel(one, spec, ["x"])
    assert _exchanges(before) > 0 and _exchanges(after) == 0
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = join_on_period(one, two.withColumnRenamed("x", "z"), ["e", "i"])
        assert _exchanges(joined) == 0 and joined.count() == 4000
    finally:
        for name in settings:
            spark.conf.unset(name)
        for n in names:
            spark.sql(f"DROP TABLE {n}")
