"""Golden numbers worked by hand, planted errors for the gates, and streams against their batch forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from abacusloom.functions import scalars
from abacusloom.operators import compose, learner, ledger, plan, quality, state, stats
from abacusloom.sources import banks
from abacusloom.streaming import cards


def one(df):
    (row,) = df.collect()
    return row


def test_four_ways_to_value_stock(spark):
    lots = spark.createDataFrame([(1, 1, 1, 200.0, 50.0), (1, 2, 2, 300.0, 60.0), (1, 4, 4, 500.0, 64.0)], "item_id int, ts int, seq int, units double, rate double")
    issues = spark.createDataFrame([(1, 3, 3, 200.0), (1, 5, 5, 450.0)], "item_id int, ts int, seq int, units double")
    value = {m: one(ledger.closing_stock(lots, issues, m))["value"] for m in ("fifo", "lifo", "periodic")}
    moves = lots.unionByName(issues.select("item_id", "ts", "seq", (-F.col("units")).alias("units"), F.lit(0.0).alias("rate")))
    assert value == {"fifo": 22_400.0, "lifo": 19_000.0, "periodic": 21_000.0}
    assert one(ledger.moving_average(moves))["value"] == pytest.approx(21_350.0)
    short = one(ledger.closing_stock(lots, issues.withColumn("units", F.col("units") * 2)))
    assert short["short"] and short["value"] is None


def test_lower_of_cost_and_nrv(spark):
    rows = spark.createDataFrame([(1, 60e3, 68e3), (1, 45e3, 39e3), (1, 30e3, 25.5e3), (1, 25e3, 27e3)], "k int, cost double, nrv double")
    assert tuple(one(ledger.lower_of_cost_and_nrv(rows, "k")))[1:] == (149_500.0, 10_500.0)


def test_indices(spark):
    rows = spark.createDataFrame([(6.0, 10.0, 10.0, 12.0), (2.0, 20.0, 3.0, 25.0), (4.0, 15.0, 5.0, 10.0)], "p0 double, q0 double, p1 double, q1 double")
    r = one(stats.price_indices(rows))
    assert [round(r[k], 2) for k in ("laspeyres", "paasche", "fisher")] == [146.88, 151.23, 149.04]
    t = one(stats.reversal_tests(rows))
    assert t["time_reversal"] and t["factor_reversal"]


def test_loan(spark):
    loans = spark.createDataFrame([(1, 3_600_000.0, 0.0075, 240)], "loan_id int, principal double, rate double, n int")
    r = ledger.amortisation(loans).filter("k = 60").first()
    assert (r["instalment"], r["balance"]) == (32_390.13, 3_193_453.76)
    assert abs(ledger.amortisation(loans).filter("k = 240").first()["balance"]) < 0.01


def test_net_present_value(spark):
    flows = spark.createDataFrame([(1, 0, -2e6)] + [(1, y, 6e5) for y in range(1, 6)], "k int, year int, amount double")
    assert one(stats.net_present_value(flows, "k", F.lit(0.13)))["npv"] == 110_338.76


def test_grouped_median(spark):
    classes = spark.createDataFrame([(1, 10.0 * i, 10.0, f) for i, f in enumerate((5, 8, 15, 7, 5))], "k int, lower double, width double, freq int")
    assert one(stats.partition_values(classes, "k", {"median": 0.5}))["median"] == pytest.approx(20 + (20 - 13) / 15 * 10, abs=1e-4)


def test_correlation_of_five_points(spark):
    pts = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(range(1, 6), (3, 2, 5, 6, 4))], "k int, x double, y double")
    r = one(stats.correlation(pts, "k"))
    assert r["cov"] == pytest.approx(1.2) and r["r"] == pytest.approx(0.6) and r["r_from_slopes"] == r["r"]
    assert one(stats.spearman(pts, "k"))["rho"] == pytest.approx(0.6)


@pytest.mark.parametrize(
    ("ratings", "want"),
    [("good", (1, 2.5, 1)), ("good good", (2.5, 2.5, 2)), ("easy", (4, 2.65, 1)), ("good easy", (3.445, 2.65, 2)), ("good again", (0, 2.3, 2)), ("hard", (1, 2.35, 1))],
)
def test_card_goldens(spark, ratings, want):
    rows = [(1, 1, i, dt.datetime(2026, 1, 1 + i), r) for i, r in enumerate(ratings.split())]
    got = one(state.card_state(spark.createDataFrame(rows, "learner_id long, card_id long, event_id long, at timestamp, rating string")))
    assert (got["ivl"], got["ease"], got["reps"]) == pytest.approx(want)
    if ratings == "good again":
        assert got["due"] == dt.datetime(2026, 1, 2, 0, 10)


def streamed(spark, tmp_path, rows, schema, name, run):
    """All rows that a stream over files of the rows (some delivered twice) has written in update mode."""
    step = max(1, len(rows) // 4)
    for n in range(0, len(rows), step):
        spark.createDataFrame(rows[n : n + step + 5], schema).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    query = run(source).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.mark.parametrize("exam", [None, "2026-01-20 00:00:00"])
def test_card_stream_equals_batch(spark, tmp_path, exam):
    rows = [(k % 7, k % 5, k, dt.datetime(2026, 1, 1) + dt.timedelta(hours=k), ("again", "hard", "good", "easy")[k * k % 4]) for k in range(200)]
    schema = "learner_id long, card_id long, event_id long, at timestamp, rating string"
    found = streamed(spark, tmp_path, rows, schema, f"cards_{bool(exam)}", lambda s: cards.card_stream(s, "30 days", exam))
    last = found.groupBy("learner_id", "card_id").agg(F.max_by(F.struct("ivl", "ease", "reps", "due"), "reps").alias("s")).collect()
    batch = state.card_state(spark.createDataFrame(rows, schema), exam).collect()
    want = {(r["learner_id"], r["card_id"]): (round(r["ivl"], 4), round(r["ease"], 4), r["reps"]) for r in batch}
    assert {(r[0], r[1]): (round(r[2][0], 4), round(r[2][1], 4), r[2][2]) for r in last} == want
    if exam:
        assert max(r["ivl"] for r in batch) <= 20


ANSWERS = [(k % 3, k * 7 % 11, k, dt.datetime(2026, 1, 1) + dt.timedelta(hours=5 * k), k * k % 3 > 0, (True, False, None)[k % 3], f"t{k % 2}") for k in range(240)]
ANSWER = "learner_id long, question_id long, event_id long, at timestamp, correct boolean, sure boolean, topic string"


def test_notebook_stream_equals_batch(spark, tmp_path):
    found = streamed(spark, tmp_path, ANSWERS, ANSWER, "notebook", lambda s: cards.notebook_stream(s, "90 days"))
    last = found.groupBy("learner_id", "question_id").agg(F.max_by(F.struct("open", "first_at", "last_at", "reps", "sure"), "seen").alias("s")).filter("s.open").collect()
    batch = learner.notebook(spark.createDataFrame(ANSWERS, ANSWER), F.lit(3)).collect()
    assert {(r[0], r[1]): tuple(r[2])[1:] for r in last} == {(r["learner_id"], r["question_id"]): (r["first_at"], r["last_at"], r["reps"], r["sure"]) for r in batch} and batch
    whole = state.capped_notebook(spark.createDataFrame(ANSWERS, ANSWER)).collect()
    assert {(r["learner_id"], r["question_id"], r["reps"], r["sure"]) for r in whole} == {(r["learner_id"], r["question_id"], r["reps"], r["sure"]) for r in batch}


def test_capped_notebook_against_a_loop(spark):
    books = {}
    for who, question, _, at, correct, _, _ in ANSWERS:
        book = books.setdefault(who, [])
        if correct and question in book:
            book.remove(question)
        elif not correct and question not in book:
            book.append(question)
            del book[:-2]
    got = state.capped_notebook(spark.createDataFrame(ANSWERS, ANSWER), most=2).collect()
    assert {(r["learner_id"], r["question_id"]) for r in got} == {(w, q) for w, book in books.items() for q in book}


def test_mastery_stream_equals_batch(spark, tmp_path):
    rows = [(*r[:4], r[4] or r[2] % 4 > 0, *r[5:]) for r in ANSWERS]
    rows = [(w, q, e, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=20 * e), c, s, t) for w, q, e, _, c, s, t in rows] + [(w, q, e + 1_000, dt.datetime(2026, 1, 5) + dt.timedelta(hours=e), c, s, t) for w, q, e, _, c, s, t in rows]
    found = streamed(spark, tmp_path, rows, ANSWER, "mastery", lambda s: cards.mastery_stream(s, "90 days"))
    last = found.groupBy("learner_id", "topic").agg(F.max_by(F.struct("level", "proficient_days"), "seen").alias("s")).collect()
    batch = learner.mastery(learner.session_levels(spark.createDataFrame(rows, ANSWER), [F.to_date("at")])).collect()
    assert {(r[0], r[1]): tuple(r[2]) for r in last} == {(r["learner_id"], r["topic"]): (r["level"], r["proficient_days"]) for r in batch}
    assert {r["level"] for r in batch} & {2, 3}


def test_week_and_session_streams(spark, tmp_path):
    rows = [r for r in ANSWERS if not 40 <= r[2] % 90 < 64]  # gaps of more than four days
    found = streamed(spark, tmp_path, rows, ANSWER, "weeks", lambda s: cards.week_stream(s.dropDuplicates(["event_id"]), "90 days"))
    weeks = {(r[0], r[1]): tuple(r[2]) for r in found.groupBy("learner_id", "window.end").agg(F.max_by(F.struct("attempted", "correct"), "attempted")).collect()}
    for (who, end), counts in weeks.items():
        inside = [r for r in rows if r[0] == who and end - dt.timedelta(days=7) <= r[3] < end]
        assert counts == (len(inside), sum(r[4] for r in inside))
    spans = cards.activity_sessions(spark.createDataFrame(rows, ANSWER)).groupBy("learner_id").agg((F.count("*") - 1).alias("returns")).collect()
    batch = learner.returns_after_gap(spark.createDataFrame(rows, ANSWER), days=4).groupBy("learner_id").count().collect()
    assert {r[0]: r[1] for r in spans} == {r[0]: r[1] for r in batch} and batch


def test_late_events_lie_behind_the_watermark(spark):
    at = lambda d, h=0: dt.datetime(2026, 1, d, h)
    rows = [(1, at(1), at(1)), (2, at(5), at(5)), (3, at(2), at(6)), (4, at(4, 12), at(6, 1)), (5, at(1), at(5, 1)), (6, at(6), at(7))]
    got = cards.late_events(spark.createDataFrame(rows, "event_id long, at timestamp, taken_at timestamp"), "2 days", []).collect()
    assert {r["event_id"] for r in got} == {3, 5}


def test_waterfall_never_exceeds_the_surplus(spark):
    claims = spark.createDataFrame([(k, i, float(10 * i), 25.0 + k) for k in range(5) for i in range(1, 5)], "k int, i int, due double, available double")
    got = ledger.waterfall(claims, "k", "i").groupBy("k").agg(F.sum("applied").alias("paid"), F.min("applied").alias("least")).collect()
    assert all(r["paid"] == 25.0 + r["k"] and r["least"] >= 0 for r in got)


def test_apportionment(spark):
    rows = spark.createDataFrame([("a", i, w, 10) for i, w in enumerate((5.0, 3.0, 1.0))] + [("b", i, 1.0, 2) for i in range(3)], "k string, i int, w double, total int")
    got = {(r["k"], r["i"]): r["share"] for r in compose.largest_remainder(rows, "k", "i", "w", "total").collect()}
    assert got == {("a", 0): 5, ("a", 1): 3, ("a", 2): 2, ("b", 0): 1, ("b", 1): 1, ("b", 2): 1}


def test_union_is_idempotent(spark):
    old, new = (spark.createDataFrame(r, "k int, v string, ord int") for r in ([(1, "a", 0), (2, "b", 1)], [(2, "c", 0), (3, "d", 1)]))
    once = compose.union_by_key(old, new, ["k"]).drop("from_new")
    assert {(r["k"], r["v"]) for r in once.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r["k"], r["v"]) for r in compose.union_by_key(once, once, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def bank(**question):
    return {"level": "x", "questions": [question]}


@pytest.fixture
def bank_dir(tmp_path):
    option = lambda k, t: {"key": k, "text": t, "explanation": "why"}
    options = [option("A", "₹30,000"), option("B", "25,000"), option("C", "1"), option("D", "90,000")]
    tags = {"applicableAttempts": ["may"], "lawAsOnDate": "2026-01-01"}
    base = {"type": "mcq", "stem": "s", "options": options, "numerical": True}
    questions = [
        {**base, "id": "q1", "topic": "t", "correct": "B", **tags},
        {**base, "id": "q2", "topic": "t", "correct": "B", **tags},
        {**base, "id": "q3", "topic": "t", "correct": "A"},
        {"id": "q4", "type": "case", "topic": "case", "case": "text", **tags, "questions": [{**base, "id": "q4-a", "correct": "B"}, {**base, "id": "q4-b", "correct": "A", "numerical": False}]},
    ]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "bank.json").write_text(json.dumps({"level": "x", "questions": questions}))
    (tmp_path / "other.json").write_text(json.dumps({"level": "x"}))
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "note.mdx").write_text("---\ntitle: T\ntags:\n  - a\nempty:\n---\n## One *thing*\nbody\n## Two\n| a | b |\n|---|---|\n| c | d |\n")
    return str(tmp_path)


def test_banks_and_gates(spark, bank_dir):
    good, broken = banks.read_banks(spark, bank_dir)
    assert broken.count() == 1
    questions = quality.flatten(good)
    rows = {r["id"]: r for r in questions.collect()}
    assert set(rows) == {"q1", "q2", "q3", "q4-a", "q4-b"}
    assert rows["q4-a"]["topic"] == "case" and rows["q4-a"]["case_size"] == 2 and rows["q4-b"]["applicableAttempts"] == ["may"]
    computed = spark.createDataFrame([("q1", "D", None), ("q2", "b ", None), ("q4-a", "A", None)], "id string, answer string, error string")
    status = {r["id"]: r["status"] for r in quality.verify(questions, computed).collect()}
    assert status == {"q1": "mismatch", "q2": "ok", "q3": "no verifier", "q4-a": "mismatch"}
    assert one(quality.gate(quality.verify(questions, computed), "ok"))["failures"] == 3
    assert "explanation" not in quality.blind(questions).schema.simpleString() and "correct" not in quality.blind(questions).columns
    assert {(r["id"], r["missing"]) for r in quality.tag_violations(good).collect()} == {("q3", "applicableAttempts"), ("q3", "lawAsOnDate")}
    values = spark.createDataFrame([("q1", 90_000.0), ("q2", 2.0)], "id string, value double")
    assert {r["id"]: r["picked"] for r in quality.pick_option(questions, values, 0.5).collect()} == {"q1": "D", "q2": None}


@pytest.mark.parametrize(("answers", "code"), [("B B A B A", 0), ("b|b | A|B|a", 0), ("D B A A A", 1), ("B", 2)])
def test_consistency_gate(spark, answers, code):
    ids = ["1", "2", "3", "4", "5"]
    keys = spark.createDataFrame(list(zip(ids, "BBABA")), "id string, k string")
    fresh = spark.createDataFrame(list(zip(ids, answers.split("|") if "|" in answers else answers.split())), "id string, f string")
    assert one(quality.consistency_gate(quality.compare_answers(keys, fresh, "id", "k", "f")))["code"] == code


def test_notes(spark, bank_dir):
    notes = banks.read_notes(spark, bank_dir)
    assert [r["heading"] for r in quality.headings(notes, "path", "text").orderBy("at").collect()] == ["One thing", "Two"]
    front = scalars.frontmatter(F.col("text"))
    r = one(notes.select(scalars.has_value(front, "title").alias("title"), scalars.has_value(front, "tags").alias("tags"), scalars.has_value(front, "empty").alias("empty"), scalars.table_rows(F.col("text")).alias("cells"), scalars.section(F.col("text"), "Two", "One").alias("two"), scalars.section(F.col("text"), "Nope", "One").alias("one")))
    assert r["title"] and r["tags"] and not r["empty"]
    assert r["cells"] == [["a", "b"], ["c", "d"]] and r["two"]["found"] == "summary" and r["one"]["found"] == "fallback"


def test_backups(spark):
    history = spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "learner_id long, question_id long")
    documents = banks.export_state({"history": history}, 2, "2026-01-01").select("document")
    assert json.loads(documents.filter("document LIKE '%:1}%'").first()[0]) == {"version": 2, "exportedAt": "2026-01-01", "history": [{"question_id": 1}, {"question_id": 2}]}
    rows = documents.unionByName(spark.createDataFrame([("{}",), ("no json",), (None,), ('{"version":1}',)], "document string"))
    good, bad = banks.validate_backups(rows)
    assert good.count() == 2 and bad.count() == 4


def test_scalars(spark):
    row = spark.createDataFrame([("3 Jul 2026", "9 Sept 2026", "2026-02-01", "nope")], "a string, b string, c string, d string").select(*(scalars.human_date(F.col(c)).alias(c) for c in "abcd"))
    assert list(one(row)) == [dt.date(2026, 7, 3), dt.date(2026, 9, 9), dt.date(2026, 2, 1), None]
    day = lambda s: F.lit(s).cast("date")
    r = one(spark.range(1).select(
        scalars.bill_due(day("2026-05-03"), F.lit(3), F.lit(0), F.lit(False)).alias("bill"),
        scalars.human_label(day("2026-09-09")).alias("label"),
        scalars.topic_prefix(F.lit(" Leases — part 2")).alias("prefix"),
        scalars.topic_segments(F.lit("Ch 4 · Leases · Lessee")).alias("parts"),
        scalars.half_up_whole(F.lit(-2.5)).alias("half"),
        scalars.expected_value(F.lit(4)).alias("guess"),
        scalars.days_to_exam(day("2026-05-03"), F.lit("2026-05-03 00:00:00").cast("timestamp")).alias("left"),
    ))
    assert tuple(r) == (dt.date(2026, 8, 6), "9 Sept 2026", "leases", ["Leases", "Lessee"], -2, 0.0625, 1)


def test_same_rows_for_any_partitioning(spark, sf_dir):
    from abacusloom.plans.registry import QUERIES

    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, QUERIES["stratified_draw"](spark, sf_dir).collect())), sorted(map(str, QUERIES["mixed_set"](spark, sf_dir).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert rows("1") == rows("40")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_bank_file_comes_out_on_one_side(spark, tmp_path):
    files = {"good.json": {"questions": [{"id": "q1", "marks": 2}]}, "typed.json": {"questions": [{"id": "q2", "marks": "two"}]}, "none.json": {"level": "x"}}
    for name, bank in files.items():
        (tmp_path / name).write_text(json.dumps(bank))
    (tmp_path / "cut.json").write_text('{"questions": [')
    good, broken = banks.read_banks(spark, str(tmp_path))
    assert [r["path"].rsplit("/")[-1] for r in good.collect()] == ["good.json"]
    assert sorted(r["path"].rsplit("/")[-1] for r in broken.collect()) == ["cut.json", "typed.json"]


def test_appends_and_upgrades(spark, tmp_path):
    for n in (1, 2):
        banks.append(spark.createDataFrame([(n,)], "event_id int"), str(tmp_path / "facts"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "facts")).collect()) == [1, 2]
    now = "2026-01-05 00:00:00"
    old = spark.createDataFrame([(1, None, None), (2, 3, dt.datetime(2026, 1, 1))], "question_id int, reps int, due timestamp")
    assert [(r["reps"], r["due"]) for r in banks.upgrade_mistakes(old, now).orderBy("question_id").collect()] == [(0, dt.datetime(2026, 1, 5)), (3, dt.datetime(2026, 1, 1))]
    mastery = spark.createDataFrame([("a", dt.datetime(2026, 1, 2), None), ("b", None, None), ("c", None, [dt.date(2026, 1, 3)])], "topic string, mastered_at timestamp, days array<date>")
    assert [r["days"] for r in banks.upgrade_mastery(mastery).orderBy("topic").collect()] == [[dt.date(2026, 1, 2)], [], [dt.date(2026, 1, 3)]]


def test_plan_phases_and_mocks_by_hand(spark):
    # Monday, 5 January to the eve of Wednesday, 4 February 2026: four Saturdays and the Wednesday of the third week are buffers
    requests = spark.createDataFrame([(1, dt.date(2026, 1, 5), dt.date(2026, 2, 4))], "plan_id int, start_date date, exam_date date")
    days = plan.day_kinds(plan.runway(requests)).orderBy("date").collect()
    assert [r["date"].day for r in days if r["buffer"]] == [10, 17, 21, 24, 31] and len(days) == 30
    work = [r for r in days if r["work"]]
    # 24 work days: 12 for study, 5 (a fifth, rounded) at the end, 7 between; from 21 January on the third revision, but one day at least is the second
    assert [sum(r["phase"] == p for r in work) for p in ("study", "revision1", "revision2", "revision3")] == [12, 7, 1, 4]
    # all work days up to the fourth before the exam may be mocks, but for the last two of the third revision: a fifth of 24 is four; three are Sundays, the fourth is 22 days before
    assert [r["date"].day for r in days if r["mock"]] == [11, 13, 18, 25]


def test_tables_front_matter_and_inline_marks(spark):
    text = "| a | b\n|---|:-:|\n|- x | 2 |\n not | one\n| - | : |"
    front = "title : 'A b'\nempty:\nlist :\n\n  - x\nlast: "
    row = one(spark.createDataFrame([(text, front, "<b>On</b> **the** `law` a_b * c")], "t string, f string, h string").select(
        scalars.table_rows(F.col("t")).alias("t"), scalars.front_value(F.col("f"), "title").alias("v"), scalars.front_value(F.col("f"), "none").alias("n"), *(scalars.has_value(F.col("f"), k).alias(k) for k in ("title", "empty", "list", "last")), scalars.plain_text(F.col("h")).alias("h")
    ))
    assert row["t"] == [["a", "b"], ["- x", "2"]]
    assert (row["v"], row["n"], row["title"], row["list"], row["last"]) == ("A b", None, True, True, False)
    assert row["h"] == "On the law a_b * c"


def test_plan_covers_every_day(spark):
    requests = spark.createDataFrame([(1, dt.date(2026, 1, 5), dt.date(2026, 5, 3)), (2, dt.date(2026, 5, 3), dt.date(2026, 5, 3))], "plan_id int, start_date date, exam_date date")
    days = plan.day_kinds(plan.runway(requests)).collect()
    assert {r["plan_id"] for r in days} == {1} and len(days) == 118 and all(r["kind"] for r in days)
    assert [r["kind"] for r in days if r["date"] == dt.date(2026, 5, 2)] == ["gap"]


def test_moving_average_gathers_no_array(spark):
    rows = [(k, t, 0, float(5 if t % 3 else -2), 1.0 + t % 7) for k in (1, None) for t in range(3_000)]
    done = ledger.moving_average(spark.createDataFrame(rows, "item_id long, ts long, seq long, units double, rate double"))
    assert "collect_list" not in done._jdf.queryExecution().optimizedPlan().toString()
    units = value = 0.0
    for _, _, _, u, rate in rows[:3_000]:
        average = value / units if units > 0 else 0.0
        units, value = units + u, value + u * (rate if u > 0 else average)
    got = {r["item_id"]: (r["units"], r["value"]) for r in done.collect()}
    assert got.keys() == {1, None} and all(v == (round(units, 4), pytest.approx(value, abs=1e-4)) for v in got.values())
