"""Running aggregates against plain windows, with a key that holds most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.operators.running import Running, first_rows, number_rows, running


pytestmark = pytest.mark.usefixtures("many_segments")


def _skewed(spark, n=4000):
    hot = F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    return spark.range(n).select(
        hot.alias("key"),
        ((F.col("id") * 7919) % n).alias("at"),
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("value"),
    )


def test_running_equals_window(spark, rows):
    df = _skewed(spark)
    got = running(
        df,
        ["key"],
        ["at"],
        n=Running("count", F.lit(1)),
        total=Running("sum", F.col("value")),
        best=Running("max", F.col("value"), "before"),
        low=Running("min", F.col("value"), "after"),
        last=Running("max", F.struct("at", "value"), "before"),
    )
    window = Window.partitionBy("key").orderBy("at")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    after = window.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "*",
        F.count(F.lit(1)).over(upto).alias("n"),
        F.coalesce(F.sum("value").over(upto), F.lit(0)).alias("total"),
        F.max("value").over(before).alias("best"),
        F.min("value").over(after).alias("low"),
        F.max(F.struct("at", "value")).over(before).alias("last"),
    )
    assert rows(got) == rows(want)


def test_hot_key_is_spread(spark):
    df = _skewed(spark, 200_000)
    placed = df.repartitionByRange("key", "at")
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_numbers_over_everything(spark):
    numbers = number_rows(_skewed(spark, 1000), [], ["-at"])
    got = [(r["at"], r["position"]) for r in numbers.orderBy("position").collect()]
    assert got == [(999 - i, i + 1) for i in range(1000)]


def test_null_keys_are_a_key(spark, rows):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").alias("key"), "id")
    got = number_rows(df, ["key"], ["id"]).groupBy("key").agg(F.max("position"), F.count("*"))
    assert rows(got) == [("a", 1000, 1000), (None, 2000, 2000)]


def test_first_rows_cut_before_the_shuffle(spark):
    df = first_rows(_skewed(spark), ["key"], ["at"], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert df.where("key = 'hot'").count() == 3


def test_empty_input(spark):
    assert number_rows(_skewed(spark).limit(0), ["key"], ["at"]).count() == 0
