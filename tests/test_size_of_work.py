"""Queries read whole tables, and what they do grows with them."""

import re
from collections import Counter

from pyspark.sql import functions as F

from abacusloom.operators import compose, learner
from abacusloom.plans.registry import QUERIES


def test_pool_sizes_counts_every_part(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert QUERIES["pool_sizes"](spark, sf_dir).agg(F.sum("pool")).first()[0] == parts


def test_a_session_meets_its_own_candidates_only(spark):
    """Joined by rank too: by prefix alone each session would meet all questions of it."""
    questions = spark.range(400).select(F.col("id").alias("question_id"), F.lit("p").alias("prefix"), (F.col("id") % 10 == 0).alias("is_case"))
    served = spark.range(30).selectExpr("id AS session", "explode(array(id, id + 1)) AS question_id").withColumn("prefix", F.lit("p"))
    got = learner.session_variants(served, questions)
    rows = got.collect()
    assert len(rows) == 60 and len({(r["session"], r["variant_id"]) for r in rows}) == 60
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\], \[[^\]]*\], Inner", got._jdf.queryExecution().executedPlan().toString())
    assert joins and all("_rank" in j for j in joins)


def test_a_draw_is_greedy_and_even(spark):
    """What is left of the room holds no unit that wasn't taken, early units come first, and each unit is taken about as often as its like."""
    units = spark.range(40).select(F.lit("p").alias("pool"), F.concat(F.lit("u"), "id").alias("unit"), (F.col("id") >= 4).alias("late"), F.when(F.col("id") < 4, 8.0).otherwise(F.col("id") % 4 + 2.0).alias("marks"))
    of = {r["unit"]: (r["late"], r["marks"]) for r in units.collect()}
    got = {}
    for r in compose.greedy_draw(spark.range(2_000).select("id", F.lit("p").alias("pool")), units, "id", ["pool"], 30.0, "s").collect():
        assert of[r["unit"]][1] == r["marks"]
        got.setdefault(r["id"], []).append(r["unit"])
    assert len(got) == 2_000
    for names in got.values():
        left = 30 - sum(of[u][1] for u in names)
        assert left >= 0 and len(set(names)) == len(names) and sum(not of[u][0] for u in names) == 3
        assert all(m > left for u, (_, m) in of.items() if u not in names)
    often = Counter(u for names in got.values() for u in names)
    assert all(1_400 < often[u] < 1_600 for u in of if not of[u][0])  # three of four
    for m in (2.0, 3.0, 4.0, 5.0):
        like = [often[u] for u, (late, marks) in of.items() if late and marks == m]
        assert max(like) < 2 * min(like)


def test_requests_dont_meet_whole_pools(spark):
    """A paper's requests times its questions would be 25 million rows here."""
    asks = spark.range(5_000).select("id", F.lit("p").alias("pool"))
    units = spark.range(5_000).select(F.lit("p").alias("pool"), F.col("id").alias("unit"), F.lit(True).alias("late"), F.lit(2.0).alias("marks"))
    got = compose.greedy_draw(asks, units, "id", ["pool"], 30.0, "s")
    assert got.count() == 75_000 and got.distinct().count() == 75_000
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", got._jdf.queryExecution().executedPlan().toString())
    assert joins and all("_rank" in j for j in joins)


def _rows_moved(spark, run):
    """Rows that the run's stages wrote to shuffles."""
    store, listed = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList

    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = store.stageList(listed(), False, False, none, listed())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = moved()
    run()
    return sum(n for k, n in moved().items() if k not in before)


def test_a_draw_leaves_most_items_in_place(spark, monkeypatch):
    """Also where Spark takes every table for a large one: only counts by bucket and items up to a cut move, and two groups of any size aren't two tasks' sorts."""
    monkeypatch.setattr(compose, "BUCKETS", 64)
    pool = spark.range(40_000).select((F.col("id") % 2).alias("paper"), (F.col("id") % 4).alias("grp"), F.col("id").alias("item"))
    targets = spark.createDataFrame([(0, 0, 20), (0, 5, 30), (1, 1, 10)], "paper long, grp long, target long")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        assert _rows_moved(spark, lambda: got.extend(compose.stratified_draw(pool, targets, "paper", "grp", "item", "s").collect())) < 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert Counter((r["paper"], r["source"]) for r in got) == {(0, "target"): 20, (0, "backfill"): 30, (1, "target"): 10}


def test_a_group_of_items_is_many_tasks(spark, monkeypatch):
    """Joined by group, nearly all items would be one task's, where Spark takes the dimension for large; and a task holds so many items."""
    monkeypatch.setattr(learner, "ITEMS_A_TASK", 100, raising=False)
    items = spark.range(1_000).selectExpr("id DIV 4 AS mock_id", "CASE WHEN id % 100 = 0 THEN 'A' WHEN id % 100 <> 1 THEN 'N' END AS group_id", "IF(id % 2 = 0, 'correct', 'wrong') AS status", "1.5D AS secs")
    groups = spark.createDataFrame([("A",), ("R",)], "group_id string")
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = learner.group_stats(items, groups)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.rdd.getNumPartitions() == 10
        rows = got.groupBy("group_id").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.sum("secs").alias("secs")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert sorted(map(tuple, rows)) == [("A", 10, 10, 15.0), ("ungrouped", 990, 490, 1485.0)]
