"""Appends that happen once, dimensions from files and their versions, interval joins."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from abacusloom.operators import content, intervals, quality
from abacusloom.plans import content as plans
from abacusloom.sources import appends, dimensions

ROW = "question_id long, run string, note string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table_of(spark, path):
    return appends.appended(spark, path, ROW).drop("batch")


def test_a_batch_is_added_once(spark, tmp_path):
    path = str(tmp_path / "queue")
    a = spark.createDataFrame([(1, "r1", "x"), (2, "r1", "y"), (2, "r1", "z"), (None, "r1", "n")], ROW)
    assert table_of(spark, path).count() == 0
    assert appends.append_once(a, path, "b-0", ["question_id", "run"])
    assert not appends.append_once(a, path, "b-0", ["question_id", "run"])
    first = [(1, "r1", "x"), (2, "r1", "y"), (None, "r1", "n")]
    assert rows_of(table_of(spark, path)) == sorted(first, key=str)
    again = a.unionByName(spark.createDataFrame([(1, "r2", "x"), (3, "r1", "w")], ROW))
    assert appends.append_once(again, path, "b-1", ["question_id", "run"])  # keys of an earlier batch
    assert rows_of(table_of(spark, path)) == sorted([*first, (1, "r2", "x"), (3, "r1", "w")], key=str)
    assert appends.append_once(a.filter("false"), path, "b-2", ["question_id"]) and table_of(spark, path).count() == 5


def test_a_killed_batch_leaves_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "answers")
    df = spark.createDataFrame([(1, "r", "x")], ROW)
    appends.append_once(df, path, "s-0")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(appends, "rename_once", killed)
        with pytest.raises(KeyboardInterrupt):
            appends.append_once(df, path, "s-1")
    assert list((tmp_path / "answers").glob("_staged-s-1-*")) and table_of(spark, path).count() == 1
    assert appends.append_once(df, path, "s-1") and table_of(spark, path).count() == 2
    assert not list((tmp_path / "answers").glob("_staged*"))


def test_of_two_writers_of_a_batch_one_adds_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "answers")
    df = spark.createDataFrame([(1, "r", "x")], ROW)
    rename = appends.rename_once

    def second_first(spark_, source, target):
        monkeypatch.setattr(appends, "rename_once", rename)
        assert appends.append_once(df, path, "s-0")
        return rename(spark_, source, target)

    monkeypatch.setattr(appends, "rename_once", second_first)
    assert not appends.append_once(df, path, "s-0")
    assert table_of(spark, path).count() == 1 and not list((tmp_path / "answers").glob("_staged*"))


def test_a_stream_adds_each_batch_once_over_restarts(spark, tmp_path):
    source, path, at = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "at"
    key = ["question_id", "run"]

    def run(name="s", at=at):
        rows = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
        appends.append_stream(rows, path, name, key).option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination(120)

    for n in range(3):
        spark.createDataFrame([(10 * n + i, "r", "x") for i in range(5)] + [(0, "r", "x")], ROW).coalesce(1).write.mode("append").parquet(source)
    run()
    want = sorted(10 * n + i for n in range(3) for i in range(5))
    assert sorted(r[0] for r in table_of(spark, path).collect()) == want
    last = max((p for p in (at / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()  # killed after the rows were added, before the batch was committed
    (at / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted(r[0] for r in table_of(spark, path).collect()) == want
    run("anew", tmp_path / "other")  # a stream without the old checkpoint reads all again
    assert sorted(r[0] for r in table_of(spark, path).collect()) == want


def test_review_queue_of_blind_runs(spark, tmp_path):
    bank = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "question_id long, k string")
    fresh = spark.createDataFrame([(1, "A"), (2, "D"), (3, "D")], "question_id long, fresh string")
    compared = quality.compare_answers(bank, fresh, "question_id", "k", "fresh")
    path, key = str(tmp_path / "queue"), ["question_id", "run"]
    for run, batch in (("r1", "a"), ("r1", "b"), ("r2", "c")):
        appends.append_once(appends.review_rows(compared, "question_id", run), path, batch, key)
    found = spark.read.parquet(path).select("question_id", "run").collect()
    assert sorted(map(tuple, found)) == [(2, "r1"), (2, "r2"), (3, "r1"), (3, "r2")]


def test_dimensions_from_files(spark, tmp_path):
    chapters = [{"number": n, "slug": f"c{n}", "name": f"Chapter {n}", "hasNotes": n == 1} for n in (1, 2)]
    paper = {"id": "f1", "slug": "accounts", "number": 1, "name": "Accounts", "marks": 100, "pattern": {"style": "Descriptive", "mcqPct": 0}, "sections": [{"name": "One", "chapters": chapters}, {"name": "Two", "chapters": []}], "other": 5}
    (tmp_path / "good.json").write_text(json.dumps([paper, paper | {"id": "f2", "slug": "law"}]))
    (tmp_path / "typed.json").write_text(json.dumps([paper | {"id": "f3", "slug": "x"}, paper | {"id": "f4", "marks": "many"}]))
    (tmp_path / "cut.json").write_text('[{"id": "f5", "slug": ')
    (tmp_path / "nameless.json").write_text(json.dumps([{"slug": "y"}]))
    good, bad = dimensions.read_dimension(spark, str(tmp_path), "papers")
    assert sorted(r["id"] for r in good.collect()) == ["f1", "f2"] and sorted(r["path"].rpartition("/")[2] for r in bad.collect()) == ["cut.json", "nameless.json", "typed.json"]
    rows = dimensions.chapters_of(good.filter("id = 'f1'")).collect()
    assert [(r["paper"], r["section"], r["number"], r["chapter"], r["has_notes"]) for r in rows] == [("accounts", "One", 1, "c1", True), ("accounts", "One", 2, "c2", False)]
    labels = spark.createDataFrame([("Sept 2026",), ("May 2027",), (" Jan 2027",), ("soon",), (None,)], "l string").select(dimensions.month_start(F.col("l"))).collect()
    assert [r[0] for r in labels] == [dt.date(2026, 9, 1), dt.date(2027, 5, 1), dt.date(2027, 1, 1), None, None]


LOAD = "loaded date, topic string, weight int, tags array<string>"
D = [dt.date(2026, m, 1) for m in range(1, 6)]


def loads():
    return [
        (D[0], "a", 1, ["x"]), (D[1], "a", 1, ["x"]), (D[2], "a", 2, ["x"]), (D[3], "a", 1, ["x"]), (D[4], "a", 1, ["x"]),
        (D[0], "b", 1, None), (D[1], "b", None, None), (D[3], "b", None, None),
        (D[2], "c", 5, []), (D[3], "c", 5, ["y"]), (D[4], "c", 5, ["y"]), (D[4], "c", 5, ["y"]),
        (D[4], None, 3, []),
    ]


VERSIONS = [
    ("a", 1, ["x"], D[0], D[2]), ("a", 2, ["x"], D[2], D[3]), ("a", 1, ["x"], D[3], None), ("b", 1, None, D[0], D[1]), ("b", None, None, D[1], D[2]), ("b", None, None, D[3], D[4]),
    ("c", 5, [], D[2], D[3]), ("c", 5, ["y"], D[3], None), (None, 3, [], D[4], None),
]


def test_versions_of_all_loads(spark):
    found = dimensions.versions(spark.createDataFrame(loads(), LOAD), ["topic"], "loaded")
    assert found.columns == ["topic", "weight", "tags", "valid_from", "valid_to"] and rows_of(found) == sorted(VERSIONS, key=str)


def test_merging_load_by_load(spark):
    every = spark.createDataFrame(loads(), LOAD)
    held = dimensions.versions(every.filter("false"), ["topic"], "loaded")
    for date in D:
        for _ in range(2):  # the second time changes nothing
            held = dimensions.merge(held, every.filter(F.col("loaded") == F.lit(date)), ["topic"], F.lit(date))
        held = spark.createDataFrame(held.collect(), held.schema)
    assert rows_of(held) == sorted(VERSIONS, key=str)


def test_a_weight_counts_from_its_date(spark):
    held = dimensions.versions(spark.createDataFrame(loads(), LOAD), ["topic"], "loaded")
    asked = [("a", D[2] - dt.timedelta(1)), ("a", D[2]), ("a", D[3] - dt.timedelta(1)), ("a", dt.date(2030, 1, 1)), ("a", dt.date(2025, 1, 1)), ("b", D[2]), ("b", D[4]), ("z", D[1]), (None, D[4])]
    facts = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(asked)], "i int, topic string, date date")
    got = [r["weight"] for r in dimensions.as_of(facts, held, ["topic"], "date").orderBy("i").collect()]
    assert got == [1, 2, 2, 1, None, None, None, None, None]


def test_interval_join_against_all_pairs(spark):
    rnd = random.Random(5)
    points = [(i, rnd.choice([None, float(rnd.randrange(200))])) for i in range(120)]
    ranges = [(i, lo, rnd.choice([None, lo, lo - 3, lo + rnd.randrange(150)])) for i in range(60) for lo in [float(rnd.randrange(200))]]
    p, r = spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, lo double, hi double")
    want = sorted((a, b) for a, x in points for b, lo, hi in ranges if x is not None and hi is not None and lo <= x <= hi)
    for width in (1.0, 30.0, 1_000.0):
        found = intervals.within(p, r, F.col("x"), F.col("lo"), F.col("hi"), width)
        assert found.columns == ["p", "x", "r", "lo", "hi"] and sorted((q["p"], q["r"]) for q in found.collect()) == want


def test_changes_up_to_a_cutoff_need_no_nested_loop(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.applicable_changes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    loops = [line for line in plan.split("\n") if "NestedLoop" in line or "Cartesian" in line]
    assert "SortMergeJoin" in plan and all("_first" in plan for _ in loops) and len(loops) <= 1  # the one row of the first change
    assert content.upto_cutoff(plans._changes(spark, sf_dir).filter("false"), plans._sittings(spark, sf_dir)).count() == 0
