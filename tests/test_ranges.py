"""Blocks of large keys: the same results as a plain window or loop, and no task with more than some blocks' rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from abacusloom.operators import compose, learner, ledger, ranges, state, stats

HOT = "item_id long, ts timestamp_ntz, seq long, units double, rate double"


def moves(spark, n=3_000, seed=1):
    """One item with most of the movements, some small ones, a null key; equal times, stock-outs and issues beyond the stock."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        item = rnd.choice([7, 7, 7, 1, 2, None])
        out = rnd.random() < 0.45
        rows.append((item, f"2026-01-{rnd.randrange(1, 29):02d} 0{rnd.randrange(10)}:00:00", i, -float(rnd.randrange(0, 12)) if out else float(rnd.randrange(1, 9)), 0.0 if out else rnd.randrange(100, 999) / 8))
    return spark.createDataFrame(rows, "item_id long, ts string, seq long, units double, rate double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_blocks_are_consecutive_and_small(spark):
    cut, any_cut = ranges.in_blocks(moves(spark), ["item_id"], ["ts", "seq"], 100)
    found = cut.groupBy("item_id", "_block").agg(F.count("*").alias("n"), F.min(F.struct("ts", "seq")).alias("lo"), F.max(F.struct("ts", "seq")).alias("hi")).collect()
    assert any_cut and sum(r["n"] for r in found) == 3_000
    hot = sorted((r for r in found if r["item_id"] == 7), key=lambda r: r["_block"])
    assert len(hot) >= 10 and max(r["n"] for r in hot) < 300
    assert all(a["hi"] < b["lo"] for a, b in zip(hot, hot[1:]))
    assert any(r["item_id"] is None for r in found)
    plain, any_cut = ranges.in_blocks(moves(spark), ["item_id"], ["ts", "seq"], 3_000)
    assert not any_cut and plain.filter("_block IS NOT NULL").isEmpty()


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_blocks(spark, descending):
    rows = moves(spark).withColumn("part", F.when(F.col("seq") % 9 != 0, F.col("units")))
    kw = {"descending": descending}
    args = (["item_id"], ["ts", "seq"], {"upto": "part", "n": F.lit(1)}, {"all": "upto", "every": "n"})
    plain = ranges.running(rows, *args, **kw)
    assert plain.columns == [*rows.columns, "upto", "n", "all", "every"]
    want = Window.partitionBy("item_id").orderBy(*((F.desc if descending else F.asc)(c) for c in ("ts", "seq"))).rowsBetween(Window.unboundedPreceding, 0)
    assert rows_of(plain.select("seq", "upto", "n")) == rows_of(rows.select("seq", F.sum("part").over(want), F.row_number().over(want).cast("long")))
    cut = ranges.running(rows, *args, block_rows=90, **kw)
    assert cut.columns == plain.columns and rows_of(cut) == rows_of(plain)


def test_no_task_sums_a_whole_key(spark):
    """The rows of the hot key lie in many tasks of the window's stage."""
    cut = ranges.running(moves(spark), ["item_id"], ["ts", "seq"], {"upto": "units"}, block_rows=60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = cut.withColumn("p", F.spark_partition_id()).filter("item_id = 7").groupBy("p").agg(F.count("*").alias("count"), F.max("upto")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total = sum(r["count"] for r in placed)
    assert len(placed) >= 8 and max(r["count"] for r in placed) < total / 3


def stock(df):
    lots = df.filter("units > 0 AND item_id IS NOT NULL")
    issues = df.filter("units < 0 AND seq % 3 = 0").select("item_id", (-F.col("units")).alias("units"))
    return lots, issues


@pytest.mark.parametrize("method", ["fifo", "lifo"])
def test_closing_stock_in_blocks(spark, method):
    lots, issues = stock(moves(spark))
    assert rows_of(ledger.closing_stock(lots, issues, method)) == rows_of(ledger.closing_stock(lots, issues, method, block_rows=50))


def averaged(rows):
    """By the loop: each movement at the average of its moment."""
    found = {}
    for item, _, _, units, rate in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        n, v = found.get(item, (0.0, 0.0))
        found[item] = n + units, v + units * (rate if units > 0 else v / n if n > 0 else 0.0)
    return found


def test_moving_average_in_blocks(spark):
    df = moves(spark)
    want = averaged([tuple(r) for r in df.collect()])
    for block_rows in (10**6, 400, 60):
        got = {r["item_id"]: (r["units"], r["value"]) for r in ledger.moving_average(df, block_rows).collect()}
        assert got.keys() == want.keys()
        for k, (n, v) in want.items():
            assert got[k][0] == pytest.approx(n, abs=1e-4) and got[k][1] == pytest.approx(v, rel=1e-9, abs=1e-4)


def test_moving_average_of_unknown_movements(spark):
    rows = [(1, i, i, 2.0, 5.0) for i in range(100)] + [(2, i, i, 2.0, None if i == 40 else 5.0) for i in range(100)] + [(3, i, i, None if i == 40 else 2.0, 5.0) for i in range(100)]
    df = spark.createDataFrame(rows, "item_id long, ts long, seq long, units double, rate double")
    for block_rows in (1_000, 10):
        assert rows_of(ledger.moving_average(df, block_rows)) == [(1, 200.0, 1000.0), (2, 200.0, None), (3, None, None)]
    assert ledger.moving_average(df.filter("false")).count() == 0


def test_waterfall_in_blocks(spark):
    rows = moves(spark).filter("item_id IS NOT NULL").select("item_id", "seq", F.abs("units").alias("due"), F.lit(700.0).alias("available"))
    assert rows_of(ledger.waterfall(rows, "item_id", "seq")) == rows_of(ledger.waterfall(rows, "item_id", "seq", block_rows=40))


@pytest.mark.parametrize("exam", [None, "2026-02-10 00:00:00"])
def test_card_state_in_blocks(spark, exam):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2]), rnd.choice([5, 5, 6]), f"2026-01-{rnd.randrange(1, 29):02d} 10:00:00", i, rnd.choices(["again", "hard", "good", "easy"], [1, 2, 4, 2])[0]) for i in range(2_000)]
    rows += [(9, 9, f"2026-01-{1 + i // 20:02d} 10:00:00", 5_000 + i, "good" if i % 7 else "hard") for i in range(300)]  # never again
    df = spark.createDataFrame(rows, "learner_id long, card_id long, at string, event_id long, rating string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    want = {}
    days = None
    for learner_id, card_id, at, _, rating in sorted(rows, key=lambda r: (r[2], r[3])):
        ivl, ease, reps = want.get((learner_id, card_id), (0.0, 2.5, 0))
        cap = 365.0
        if exam:
            days = 31 - int(at[8:10]) + 10  # whole days, rounded up
            cap = min(max(2.0, days / 4), days) if days <= 30 else min(365.0, days)
        want[learner_id, card_id] = *state.rated(ivl, ease, rating, cap), reps + 1
    results = [rows_of(state.card_state(df, exam, b)) for b in (10**6, 200, 30)]
    for found in results:
        assert {r[:2] for r in found} == want.keys()
        for learner_id, card_id, ivl, ease, reps, _ in found:
            assert (ivl, ease, reps) == (pytest.approx(want[learner_id, card_id][0], abs=2e-6), pytest.approx(want[learner_id, card_id][1], abs=2e-6), want[learner_id, card_id][2])
    assert [r[4:] for r in results[0]] == [r[4:] for r in results[2]]


def test_order_statistics_in_blocks(spark):
    rows = moves(spark).filter("item_id IS NOT NULL").select(F.col("item_id").alias("k"), (F.col("seq") * 7919 % 1009 + F.col("units")).alias("v"), "seq")
    for f in (stats.quartiles, stats.dispersion):
        assert rows_of(f(rows, "k", "v")) == rows_of(f(rows, "k", "v", block_rows=70))
    assert rows_of(stats.average_ranks(rows, "k", "v", "rank")) == rows_of(stats.average_ranks(rows, "k", "v", "rank", block_rows=70))
    items = rows.select(F.col("k").alias("mock_id"), F.col("v").alias("secs"))
    assert rows_of(learner.time_stats(items)) == rows_of(learner.time_stats(items, block_rows=70))


def pool_of(spark, n=4_000):
    rnd = random.Random(12)
    return spark.createDataFrame([(rnd.choice([1, 1, 2]), rnd.choice("AAAAB"), i) for i in range(n)] + [(3, "A", i) for i in range(5)], "paper int, grp string, item long")


def test_draws_are_those_of_a_ranking(spark, monkeypatch):
    """The rows that windows over whole groups would give, with few rows ranked."""
    pool = pool_of(spark)
    targets = spark.createDataFrame([(1, "A", 30), (1, "B", 900), (1, "C", 25), (2, "A", 10), (2, "B", 0), (3, "A", 40)], "paper int, grp string, target long")
    h = compose.chance("s", "paper", "item")
    ranked = pool.withColumn("h", h).withColumn("at", F.row_number().over(Window.partitionBy("paper", "grp").orderBy("h", "item"))).join(targets, ["paper", "grp"], "left").collect()
    want = {(r["paper"], r["grp"], r["item"], "target") for r in ranked if r["at"] <= (r["target"] or 0)}
    for paper, all_of in ((1, 955), (3, 40)):
        have = sum(w[0] == paper for w in want)
        rest = sorted((r["h"], r["item"], r["grp"]) for r in ranked if r["paper"] == paper and r["at"] > (r["target"] or 0))
        want |= {(paper, g, i, "backfill") for _, i, g in rest[: all_of - have]}
    for buckets in (4_096, 16, 1):
        monkeypatch.setattr(compose, "BUCKETS", buckets)
        assert {tuple(r) for r in compose.stratified_draw(pool, targets, "paper", "grp", "item", "s").collect()} == want
    monkeypatch.setattr(compose, "BUCKETS", 256)
    rows = pool.select("paper", "grp", "item", h.alias("_h"), F.floor(h * 256).cast("int").alias("_bucket"))
    cuts = compose._cuts(rows, ["paper", "grp"], targets.filter("target > 0").withColumnRenamed("target", "_want"))
    assert rows.join(cuts, ["paper", "grp"]).filter("_bucket = _cut").count() < 60


def test_systematic_in_blocks(spark):
    pool = pool_of(spark)
    assert rows_of(compose.systematic(pool, "paper", "item", 7, 2)) == rows_of(compose.systematic(pool, "paper", "item", 7, 2, block_rows=100))
