import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import joins, resolve, skew


@pytest.fixture(scope="module")
def lopsided(spark):
    """A third of the rows on one key, most of them copies of each other, in several input parts."""
    i = F.col("id")
    return spark.range(0, 12000, 1, 6).select(F.when(i % 3 == 0, 0).otherwise(i % 500 + 1).alias("k"),
                                              F.when(i % 3 == 0, 1).otherwise(i % 4).alias("r"),
                                              F.when(i % 3 == 0, i % 5).otherwise(i).alias("x"))


def test_heavy_keys_are_found_exactly(spark, lopsided):
    heavy = skew.heavy_keys(lopsided, ["k"])
    (found,) = heavy
    assert heavy[found] == pytest.approx(1 / 3) and found == spark.range(1).select(F.xxhash64(F.lit(0).cast("bigint"))).first()[0]
    assert skew.heavy_keys(spark.range(5000), ["id"]) == {}


def test_salt_spreads_a_heavy_key_and_its_copies(lopsided):
    left, (right,), on = skew.spread(lopsided, [lopsided.groupBy("k").agg(F.max("x").alias("m"))], ["k"], skew.heavy_keys(lopsided, ["k"]))
    assert on == ["k", skew.SALT]
    per_salt = [r["count"] for r in left.where("k = 0").groupBy(skew.SALT).count().collect()]
    assert len(per_salt) > 1 and max(per_salt) < sum(per_salt)
    assert left.where(f"k <> 0 and {skew.SALT} <> 0").count() == 0
    assert right.where("k = 0").count() > 1 and right.where("k = 7").count() == 1


def test_joins_keep_every_row(lopsided):
    sums = lopsided.groupBy("k").agg(F.max("x").alias("m"))
    mins = lopsided.groupBy("k").agg(F.min("x").alias("n"))
    got = joins.join_statements(lopsided, sums, mins, keys=["k"], heavy=skew.heavy_keys(lopsided, ["k"]))
    assert got.columns == ["k", "r", "x", "m", "n"]
    want = lopsided.join(sums, "k", "left").join(mins, "k", "left")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_latest_revision_of_a_heavy_key(lopsided):
    got = resolve.latest_revision(lopsided, ["k"], "r")
    want = lopsided.join(lopsided.groupBy("k").agg(F.max("r").alias("r")), ["k", "r"]).select("k", "r", "x")
    assert got.columns == ["k", "r", "x"]
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_even_keys_are_left_alone(spark):
    df = spark.range(1000).withColumn("x", F.lit(1))
    left, rights, on = skew.spread(df, [df], ["id"], skew.heavy_keys(df, ["id"]))
    assert left is df and on == ["id"]
