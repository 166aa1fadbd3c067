"""What tasks and the driver hold of study plans doesn't grow with their number."""

import datetime as dt

from pyspark.sql import functions as F

from abacusloom.operators import plan


def _requests(spark, n):
    start, exam = dt.date(2026, 3, 1), dt.date(2026, 4, 12)
    return spark.range(n).select(F.col("id").alias("plan_id"), F.lit(start).alias("start_date"), F.lit(exam).alias("exam_date"))


def _text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_holds_so_many_plans(spark):
    days = plan.day_kinds(plan.runway(_requests(spark, 100), 10))
    assert days.rdd.getNumPartitions() == 10  # dealt once, and nothing after it deals again
    assert plan.summary(days).rdd.getNumPartitions() == plan.spans(days).rdd.getNumPartitions() == 10
    papers = spark.range(3 * plan.PAPERS_A_TASK // 4).selectExpr("id AS plan_id", "explode(array(0, 1, 2, 3)) AS paper").selectExpr("*", "paper AS number", "paper % 2 AS stream", "paper = 1 AS weak")
    chapters = spark.createDataFrame([(p, f"c{i}", i, 1.0) for p in range(4) for i in range(3)], "paper int, chapter string, number int, weight double")
    assert plan.revision_stream(papers, chapters, "chapter").rdd.getNumPartitions() == 3


def test_listed_days_are_never_broadcast(spark, tmp_path):
    at = str(tmp_path / "requests")
    _requests(spark, 50).write.parquet(at)  # a table of a few KB: days that are listed from it seem as small
    days = plan.day_kinds(plan.runway(spark.read.parquet(at)))
    asked = spark.range(50).select(F.col("id").alias("plan_id"), F.lit(dt.date(2026, 3, 4)).alias("date"))
    items = spark.range(50).selectExpr("id AS plan_id", "explode(array(0, 1)) AS stream").selectExpr("*", "explode(sequence(0L, 29L)) AS ord")
    looked, paired = plan.day_of(days.select("plan_id", "date", "kind"), asked), plan.paired_days(days, items, "study")
    for df in (looked, paired):
        assert "Broadcast" not in _text(df)
    assert looked.count() == 50
    each = paired.groupBy("plan_id", "stream").agg(F.count("*").alias("n"), F.count_distinct("date").alias("dates")).select("n", "dates").distinct().collect()
    assert len(each) == 1 and each[0]["n"] == 30 and each[0]["dates"] == days.filter("plan_id = 0 AND kind = 'study'").count()


def test_an_item_stands_until_the_next(spark):
    items = spark.createDataFrame([("a", 0, "x"), ("b", 0, "x"), ("b", 1, "y"), ("b", 2, "z")], "k string, ord long, item string")
    got = sorted((r["k"], r["day"], r["item"], r["repeat"]) for r in plan.deal(items, 5, "k").collect())
    assert [g[1:] for g in got if g[0] == "a"] == [(0, "x", False), (1, "x", True), (2, "x", True), (3, "x", True), (4, "x", False)]
    assert [g[1:] for g in got if g[0] == "b"] == [(0, "x", False), (1, "x", False), (2, "x", True), (3, "y", False), (4, "z", False)]
    few = sorted((r["day"], r["item"], r["repeat"]) for r in plan.deal(items.filter("k = 'b'"), 2, "k").collect())
    assert few == [(0, "x", False), (1, "y", False), (1, "z", False)]
