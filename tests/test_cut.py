"""Cut tables: the estimated size of a plan is that of its table, and small files of many rows are not broadcast."""

from copperline.operators import xnet


def estimate(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_estimates_of_cut_tables_are_not_multiplied(spark):
    rows = spark.range(50).selectExpr("id AS a", "id + 1 AS b")
    for _ in range(4):
        rows = xnet.cut(rows.join(rows.selectExpr("a AS b", "b AS c"), "b", "left").selectExpr("a", "coalesce(c, b) AS b"))
    assert rows.where("a = 0").first().b == 16 and estimate(rows) < 1 << 40


def test_cut_tables_are_not_broadcast_for_being_small(spark):
    rows = xnet.cut(spark.range(1000).selectExpr("id AS a", "'x' AS same"))
    plan = rows.join(xnet.cut(rows.groupBy("a").count()), "a")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
