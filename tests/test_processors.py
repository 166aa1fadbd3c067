"""Processors against the batch forms: shuffled, repeated and late events, snapshots, the cap and timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from abacusloom.operators import learner, state
from abacusloom.streaming import processors

ANSWER = "learner_id long, question_id long, event_id long, at timestamp, correct boolean, sure boolean"
REVIEW = "learner_id long, card_id long, event_id long, at timestamp, rating string"
BEGIN = dt.datetime(2026, 1, 1)


def answers(n=160, seed=1, learners=3, gap=True):
    rnd, at, out = random.Random(seed), BEGIN, []
    for k in range(n):
        at += dt.timedelta(hours=rnd.choice([1, 3, 9, 40] if not gap or k % 40 else [120]), milliseconds=rnd.randrange(4))
        out.append((rnd.randrange(learners), rnd.randrange(9), k, at, rnd.random() < 0.4, rnd.choice([True, False, None])))
    return out


def streamed(spark, tmp_path, batches, schema, name, run, mode="update"):
    """All rows that a stream has written that takes one file a batch."""
    processors.use_rocksdb(spark)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    query = run(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("exam", [None, "2026-02-10 00:00:00"])
def test_cards_go_on_from_a_snapshot(spark, tmp_path, exam):
    rnd = random.Random(2)
    rows = [(k % 3, rnd.randrange(4), k, BEGIN + dt.timedelta(hours=5 * k), rnd.choice(["again", "hard", "good", "good", "easy"])) for k in range(150)]
    early, late = rows[:90], rows[90:]
    snapshot = state.card_snapshot(spark.createDataFrame(early, REVIEW), exam)
    batches = [late[:30][::-1] + early[80:], late[30:] + late[20:35]]  # out of order within a batch, and repeated with what the snapshot holds
    found = streamed(spark, tmp_path, batches, REVIEW, f"cards_{bool(exam)}", lambda s: processors.card_stream(s, snapshot, exam))
    last = found.groupBy("learner_id", "card_id").agg(F.max_by(F.struct("ivl", "ease", "reps", "due"), "reps").alias("s")).select("learner_id", "card_id", "s.*")
    want = rows_of(state.card_state(spark.createDataFrame(rows, REVIEW), exam).withColumn("due", F.col("due").cast("timestamp")))
    got = rows_of(last)
    assert [r[:2] + r[4:] for r in got] == [r[:2] + r[4:] for r in want]
    assert all(a[2:4] == pytest.approx(b[2:4], abs=2e-6) for a, b in zip(got, want, strict=True))


def test_notebooks_with_cap_and_snapshot(spark, tmp_path):
    rows = answers(170)
    early, late = rows[:80], rows[80:]
    snapshot = state.notebook_snapshot(spark.createDataFrame(early, ANSWER), most=3)
    batches = [[*late[:40][::-1], *early[70:]], [*late[40:], *late[30:45]]]
    found = streamed(spark, tmp_path, batches, ANSWER, "notebooks", lambda s: processors.notebook_stream(s, snapshot, most=3))
    last = found.groupBy("learner_id", "question_id").agg(F.max_by(F.struct("open", "first_at", "last_at", "reps", "sure"), "nth").alias("s")).select("learner_id", "question_id", "s.*")
    touched = {(r[0], r[1]) for r in last.collect()}
    got = {tuple(r) for r in last.filter("open").drop("open").collect()}
    held = {tuple(r) for r in state.capped_notebook(spark.createDataFrame(rows, ANSWER), most=3).select("learner_id", "question_id", F.col("first_at").cast("timestamp"), F.col("last_at").cast("timestamp"), "reps", "sure").collect()}
    assert got == {h for h in held if h[:2] in touched}
    before = {(r["learner_id"], r["question_id"]) for r in snapshot.collect()}
    assert {h[:2] for h in held} <= touched | before and found.filter("NOT open").count() > 10 and max(r["nth"] for r in found.collect()) > 20


def shuffled(rows, seed=3):
    """Batches in which events come up to a day late, some of them twice; a last event far ahead moves the watermark past all others."""
    rnd = random.Random(seed)
    waits = sorted(((r[3] + dt.timedelta(hours=rnd.randrange(23)), r) for r in rows), key=lambda w: w[0])
    order = [r for _, r in waits]
    cut = len(order) // 3
    far = (99, 0, 10**6, BEGIN + dt.timedelta(days=3_000), True, None)
    return [order[:cut], [*order[cut : 2 * cut], *order[cut - 5 : cut]], order[2 * cut :], [far]]


def test_trailing_week_at_every_change(spark, tmp_path):
    rows = answers(90)
    found = streamed(spark, tmp_path, shuffled(rows), ANSWER, "weeks", lambda s: processors.week_stream(s, "1 day"), "append")
    want = learner.week_changes(spark.createDataFrame(rows, ANSWER))
    got = rows_of(found.filter("learner_id < 99"))
    assert got == rows_of(want) and min(r[2] for r in got) == 0
    loop = []
    for who, moment in {(r[0], m) for r in rows for m in (r[3], r[3] + dt.timedelta(days=7, milliseconds=1))}:
        inside = [r for r in rows if r[0] == who and moment - dt.timedelta(days=7) <= r[3] <= moment]
        loop.append((who, moment, len(inside), sum(r[4] for r in inside)))
    assert sorted(loop, key=str) == got
    assert rows_of(learner.week_changes(spark.createDataFrame(rows, ANSWER), block_rows=20)) == got


def test_returns_in_order(spark, tmp_path):
    rows = answers(120, seed=5)
    found = streamed(spark, tmp_path, shuffled(rows), ANSWER, "returns", lambda s: processors.return_stream(s, 4, "1 day"), "append")
    want = learner.returns_after_gap(spark.createDataFrame(rows, ANSWER), 4)
    assert rows_of(found.filter("learner_id < 99")) == rows_of(want) and want.count() >= 3
