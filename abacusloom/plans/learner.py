"""Learner analytics over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import learner as op
from ..operators.compose import union_by_key
from ..sources import adapters as a
from ..sources.adapters import ANSWER, MOCK_ITEM, NOW
from .composition import chance as chance_sql

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {ANSWER}, c AS (SELECT learner_id, count(*) FILTER (WHERE sure) AS n_sure, count(*) FILTER (WHERE sure AND correct) AS hs,
  count(*) FILTER (WHERE NOT sure) AS n_unsure, count(*) FILTER (WHERE NOT sure AND correct) AS hu FROM ans WHERE sure IS NOT NULL GROUP BY 1),
r AS (SELECT *, CASE WHEN n_sure > 0 THEN CAST(floor(100.0 * hs / n_sure + 0.5) AS BIGINT) END AS pct_sure,
  CASE WHEN n_unsure > 0 THEN CAST(floor(100.0 * hu / n_unsure + 0.5) AS BIGINT) END AS pct_unsure FROM c)
SELECT learner_id, n_sure, pct_sure, n_unsure, pct_unsure, pct_sure - pct_unsure AS gap,
  CASE WHEN pct_sure - pct_unsure IS NULL THEN 'calibrated' WHEN pct_unsure >= 70 AND pct_sure - pct_unsure < 15 THEN 'underconfident'
    WHEN pct_sure < 75 OR pct_sure - pct_unsure < 15 THEN 'overconfident' ELSE 'calibrated' END AS verdict FROM r""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.calibration(a.fact_answer(spark, sf_dir))


@query(f"""WITH {ANSWER} SELECT learner_id, count(*) AS attempted, count(*) FILTER (WHERE correct) AS correct FROM ans
WHERE "at" >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1""")
def week_stats(spark, sf_dir):
    return op.week_stats(a.fact_answer(spark, sf_dir), NOW)


@query(f"""WITH {ANSWER}, s AS (SELECT learner_id, epoch_us("at") // 1000 AS ms, 1 AS n, CAST(correct AS INTEGER) AS r FROM ans UNION ALL SELECT learner_id, epoch_us("at") // 1000 + 604800001, -1, -CAST(correct AS INTEGER) FROM ans),
g AS (SELECT learner_id, ms, sum(n) AS n, sum(r) AS r FROM s GROUP BY 1, 2) SELECT learner_id, make_timestamp(ms * 1000) AS "at", CAST(sum(n) OVER w AS BIGINT) AS attempted, CAST(sum(r) OVER w AS BIGINT) AS correct FROM g WINDOW w AS (PARTITION BY learner_id ORDER BY ms)""")
def week_changes(spark, sf_dir):
    """The trailing seven days at each moment at which they change."""
    return op.week_changes(a.fact_answer(spark, sf_dir)).withColumn("at", F.col("at").cast("timestamp_ntz"))


LEVELS = f"""{ANSWER}, lev AS (SELECT learner_id, chapter AS topic, "at", event_id,
  CASE WHEN NOT correct THEN 0 WHEN sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER (PARTITION BY learner_id, chapter, CAST("at" AS DATE) ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) >= 3 THEN 2 ELSE 1 END AS level FROM ans),
mas AS (SELECT learner_id, topic, count(DISTINCT CASE WHEN level >= 2 THEN CAST("at" AS DATE) END) AS proficient_days, max(level) AS seen FROM lev GROUP BY 1, 2),
mastery AS (SELECT learner_id, topic, CASE WHEN proficient_days >= 3 THEN 3 ELSE seen END AS level, proficient_days FROM mas)"""


def _mastery(spark, sf_dir):
    answers = a.fact_answer(spark, sf_dir).withColumnRenamed("chapter", "topic")
    return op.mastery(op.session_levels(answers, [F.to_date("at")]))


@query(f"WITH {LEVELS} SELECT * FROM mastery")
def mastery_level(spark, sf_dir):
    return _mastery(spark, sf_dir)


@query(f"""WITH {LEVELS} SELECT learner_id, least(100, CAST(floor(100.0 * count(*) FILTER (WHERE level >= 2 AND (topic LIKE 'c%' OR topic LIKE 'p%' OR topic LIKE 'v%')) / 4 + 0.5) AS BIGINT)) AS progress
FROM mastery GROUP BY 1""")
def paper_progress(spark, sf_dir):
    return op.paper_progress(_mastery(spark, sf_dir), ["c", "p", "v"], 4)


@query(f"WITH {ANSWER} SELECT learner_id, max(\"at\") AS last_at FROM ans GROUP BY 1")
def last_activity(spark, sf_dir):
    return op.last_activity(a.fact_answer(spark, sf_dir))


@query(f"""WITH {ANSWER}, r AS (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY "at" DESC, event_id DESC) AS n FROM ans)
SELECT learner_id, event_id, "at", question_id FROM r WHERE n <= 20""")
def recent_history(spark, sf_dir):
    return op.newest(a.fact_answer(spark, sf_dir), "learner_id", 20).select("learner_id", "event_id", "at", "question_id")


@query(f"""WITH {ANSWER}, r AS (SELECT *, lag("at") OVER (PARTITION BY learner_id ORDER BY "at", event_id) AS before FROM ans)
SELECT learner_id, event_id, "at", before FROM r WHERE "at" - before >= INTERVAL 1 DAY""")
def return_after_gap(spark, sf_dir):
    return op.returns_after_gap(a.fact_answer(spark, sf_dir), days=1)


OPEN = f"""{ANSWER}, cl AS (SELECT learner_id, question_id, "at" AS cat, event_id AS cid FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, question_id ORDER BY "at" DESC, event_id DESC) AS n FROM ans WHERE correct) WHERE n = 1),
miss AS (SELECT ans.* FROM ans LEFT JOIN cl USING (learner_id, question_id) WHERE NOT correct AND (cat IS NULL OR "at" > cat OR ("at" = cat AND event_id > cid))),
tag AS (SELECT learner_id, question_id, sure FROM (SELECT *, row_number() OVER (PARTITION BY learner_id, question_id ORDER BY "at" DESC, event_id DESC) AS n FROM miss WHERE sure IS NOT NULL) WHERE n = 1),
agg AS (SELECT learner_id, question_id, min("at") AS first_at, max("at") AS last_at, count(*) - 1 AS reps FROM miss GROUP BY 1, 2),
book AS (SELECT agg.*, sure, last_at + INTERVAL 3 DAY AS due FROM agg LEFT JOIN tag USING (learner_id, question_id))"""


def _notebook(spark, sf_dir):
    return op.notebook(a.fact_answer(spark, sf_dir), F.lit(3))


@query(f"WITH {OPEN} SELECT learner_id, question_id, first_at, last_at, reps, sure, due FROM book")
def notebook_state(spark, sf_dir):
    return _notebook(spark, sf_dir)


@query(f"""WITH {OPEN} SELECT learner_id, question_id, first_at, last_at, reps, sure, last_at + to_seconds(CAST(floor((3 + 4 * {chance_sql('wait', 'learner_id', 'question_id', 'reps')}) * 86400) AS BIGINT)) AS due FROM book""")
def notebook_jitter(spark, sf_dir):
    """Due times with the seeded wait of three to seven days."""
    return op.notebook(a.fact_answer(spark, sf_dir))


@query(f"""WITH {OPEN} SELECT learner_id, question_id, first_at, row_number() OVER (PARTITION BY learner_id ORDER BY coalesce(sure, false) DESC, first_at, question_id) AS place
FROM book WHERE due <= TIMESTAMP '{NOW}'""")
def due_mistakes(spark, sf_dir):
    return op.due_order(_notebook(spark, sf_dir), NOW).select("learner_id", "question_id", "first_at", "place")


def _questions(spark, sf_dir):
    """Parts as the question bank: the chapter is the part's brand."""
    return a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("chapter"))


@query(f"""WITH {OPEN} SELECT learner_id, p_brand AS chapter, count(*) AS due FROM book JOIN part ON p_partkey = question_id
WHERE due <= TIMESTAMP '{NOW}' GROUP BY 1, 2""")
def due_by_chapter(spark, sf_dir):
    return op.due_by_chapter(_notebook(spark, sf_dir), _questions(spark, sf_dir), NOW)


@query(f"""WITH {LEVELS} SELECT d.learner_id, d.chapter, d.chapter AS topic, coalesce(m.level, 0) AS level
FROM (SELECT DISTINCT learner_id, chapter FROM ans) d LEFT JOIN mastery m ON m.learner_id = d.learner_id AND m.topic = d.chapter""")
def chapter_levels(spark, sf_dir):
    answers = a.fact_answer(spark, sf_dir)
    chapters = answers.groupBy("chapter").agg(F.first("chapter").alias("topic"), F.lit(1).alias("ord"))
    return op.chapter_levels(answers.select("learner_id", "chapter").distinct(), chapters, _mastery(spark, sf_dir))


@query(f"WITH {OPEN} SELECT learner_id, p_partkey AS question_id, p_brand AS chapter FROM part JOIN book ON book.question_id = p_partkey")
def notebook_deck(spark, sf_dir):
    """Each learner's own deck: the questions of their notebook that the bank still has."""
    return _questions(spark, sf_dir).join(_notebook(spark, sf_dir).select("learner_id", "question_id"), "question_id").select("learner_id", "question_id", "chapter")


@query(f"WITH {ANSWER} SELECT p_partkey AS question_id, p_brand AS chapter FROM part WHERE p_partkey NOT IN (SELECT question_id FROM ans WHERE question_id IS NOT NULL)")
def unused_questions(spark, sf_dir):
    return _questions(spark, sf_dir).join(a.fact_answer(spark, sf_dir), "question_id", "left_anti")


@query("""SELECT o_custkey AS learner_id, o_orderkey AS card_id, due FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS due FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) s ON l_orderkey = o_orderkey
WHERE due IS NULL OR due <= TIMESTAMP '1996-01-01 00:00:00'""")
def cards_due(spark, sf_dir):
    cards = a.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("learner_id"), F.col("o_orderkey").alias("card_id"))
    shipped = a.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("card_id")).agg(F.max("l_shipdate").alias("due"))
    return op.cards_due(cards, shipped.join(cards, "card_id"), "1996-01-01 00:00:00")


@query(f"""WITH q AS (SELECT p_partkey AS question_id, lower(p_type) AS prefix, p_brand AS paper, p_size > 45 AS is_case, {chance_sql('variant', 'p_partkey')} AS h FROM part),
f AS MATERIALIZED (SELECT question_id, prefix, paper, row_number() OVER (PARTITION BY prefix, paper ORDER BY h, question_id) AS n1, row_number() OVER (PARTITION BY prefix ORDER BY h, question_id) AS n2 FROM q WHERE NOT is_case),
near AS (SELECT q.question_id, arg_min(f.question_id, n1) AS v FROM q JOIN f ON f.prefix = q.prefix AND f.paper = q.paper AND f.question_id <> q.question_id AND n1 <= 2 GROUP BY 1),
far AS (SELECT q.question_id, arg_min(f.question_id, n2) AS v FROM q JOIN f ON f.prefix = q.prefix AND f.question_id <> q.question_id AND n2 <= 2 GROUP BY 1)
SELECT q.prefix, q.paper, q.question_id, coalesce(near.v, far.v, q.question_id) AS variant_id FROM q LEFT JOIN near USING (question_id) LEFT JOIN far USING (question_id)""")
def variant_pick(spark, sf_dir):
    """Parts of one type are variants of each other."""
    part = a.table(spark, sf_dir, "part")
    questions = part.select(F.col("p_partkey").alias("question_id"), F.lower(F.col("p_type")).alias("prefix"), F.col("p_brand").alias("paper"), (F.col("p_size") > 45).alias("is_case"))
    return op.variant_pick(questions, questions)


@query(f"""WITH {ANSWER}, s AS (SELECT DISTINCT learner_id AS session, question_id FROM ans WHERE question_id % 3 = 0 AND question_id < (SELECT count(*) FROM part)) SELECT session, count(*) AS served, count(*) AS variants FROM s GROUP BY 1""")
def session_variants(spark, sf_dir):
    """Variants of what each session serves: as many different ones as questions. Which ones is up to the hash."""
    part = a.table(spark, sf_dir, "part")
    questions = part.select(F.col("p_partkey").alias("question_id"), F.lower(F.col("p_type")).alias("prefix"), F.col("p_brand").alias("paper"), (F.col("p_size") > 45).alias("is_case"))
    served = a.fact_answer(spark, sf_dir).filter("question_id % 3 = 0").select(F.col("learner_id").alias("session"), "question_id").distinct().join(questions.drop("is_case"), "question_id")
    return op.session_variants(served, questions).groupBy("session").agg(F.count("*").alias("served"), F.count_distinct("variant_id").alias("variants"))


def _mock(spark, sf_dir):
    return a.fact_mock_item(spark, sf_dir)


COUNTS = "count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'wrong') AS wrong, count(*) FILTER (WHERE status = 'blank') AS blank, sum(secs) AS secs"


@query(f"""WITH {MOCK_ITEM}, s AS (SELECT mock_id, count(*) AS questions, {COUNTS} FROM mock GROUP BY 1), t AS (SELECT *, CAST(correct * 1.0 + wrong * -0.25 AS DOUBLE) AS net FROM s)
SELECT *, round(100 * CAST(net AS DOUBLE) / questions, 4) AS pct, round(100 * CAST(net AS DOUBLE) / questions, 4) >= 40 AS passed, CAST(wrong * 0.25 AS DOUBLE) AS penalty, CAST(wrong AS DOUBLE) AS forgone, CAST(blank * -0.25 AS DOUBLE) AS blank_low, CAST(blank AS DOUBLE) AS blank_high FROM t""")
def mock_totals(spark, sf_dir):
    return op.mock_totals(_mock(spark, sf_dir))


@query(f"""WITH {MOCK_ITEM}, g AS (SELECT mock_id, CASE WHEN group_id IN ('A', 'R') THEN group_id ELSE 'ungrouped' END AS group_id, status, secs FROM mock),
s AS (SELECT mock_id, group_id, count(*) AS n, {COUNTS} FROM g GROUP BY 1, 2) SELECT *, CAST(correct * 1.0 + wrong * -0.25 AS DOUBLE) AS net FROM s""")
def mock_group_stats(spark, sf_dir):
    groups = a.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group_id")).filter("group_id IN ('A', 'R')").distinct()
    return op.group_stats(_mock(spark, sf_dir), groups)


@query(f"""WITH {MOCK_ITEM}, s AS (SELECT mock_id, case_id, count(*) AS size, count(*) FILTER (WHERE status = 'correct') AS correct FROM mock GROUP BY 1, 2) SELECT *, size = correct AS whole FROM s""")
def case_scores(spark, sf_dir):
    return op.case_scores(_mock(spark, sf_dir))


@query(f"""WITH {MOCK_ITEM}, r AS (SELECT mock_id, secs, row_number() OVER (PARTITION BY mock_id ORDER BY secs) AS "at", count(*) OVER (PARTITION BY mock_id) AS n FROM mock)
SELECT mock_id, min(secs) AS fastest, max(CASE WHEN "at" = n // 2 + 1 THEN secs END) AS middle, max(secs) AS slowest FROM r GROUP BY 1""")
def upper_median(spark, sf_dir):
    return op.time_stats(_mock(spark, sf_dir))


@query(f"""WITH {MOCK_ITEM}, r AS (SELECT mock_id, question_id, secs, row_number() OVER (PARTITION BY mock_id ORDER BY secs DESC, pos, question_id) AS place FROM mock)
SELECT mock_id, place, question_id, secs FROM r WHERE place <= 5""")
def slowest_five(spark, sf_dir):
    return op.slowest(_mock(spark, sf_dir))


@query(f"""WITH {MOCK_ITEM}, p AS (SELECT mock_id, group_id, sum(marks) AS possible, sum(CASE WHEN status = 'correct' THEN marks ELSE 0 END) AS earned FROM mock GROUP BY 1, 2),
t AS (SELECT mock_id, sum(possible) AS possible, sum(earned) AS earned, count(*) FILTER (WHERE earned * 2 < possible) AS weak_parts FROM p GROUP BY 1)
SELECT *, round(100.0 * CAST(earned AS DOUBLE) / CAST(possible AS DOUBLE), 2) AS scaled FROM t""")
def self_grade(spark, sf_dir):
    return op.self_grade(_mock(spark, sf_dir).select("mock_id", F.col("group_id").alias("part"), "marks", (F.col("status") == "correct").alias("ticked")))


@query(f"""WITH {MOCK_ITEM} SELECT mock_id, pos AS slot, sum(CASE WHEN status = 'correct' THEN 0 ELSE marks END) AS missed, count(*) AS points FROM mock GROUP BY 1, 2""")
def missed_marks(spark, sf_dir):
    return op.missed_by_slot(_mock(spark, sf_dir).select("mock_id", F.col("pos").alias("slot"), "marks", (F.col("status") == "correct").alias("ticked")))


HALVES = f"""{ANSWER}, o AS (SELECT learner_id, question_id, max("at") AS "at", min(event_id) AS ord FROM ans WHERE event_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT learner_id, question_id, max("at") AS "at", min(event_id) AS ord FROM ans WHERE event_id % 2 = 1 GROUP BY 1, 2)"""


@query(f"""WITH {HALVES} SELECT coalesce(n.learner_id, o.learner_id) AS learner_id, coalesce(n.question_id, o.question_id) AS question_id, coalesce(n."at", o."at") AS "at", CASE WHEN o.learner_id IS NULL THEN 1 ELSE 0 END AS from_new, coalesce(o.ord, n.ord) AS ord
FROM o FULL JOIN n ON o.learner_id = n.learner_id AND o.question_id = n.question_id""")
def restored_mistakes(spark, sf_dir):
    """Mistakes of a restored backup over those that are there: by question, the backup wins, the first place is kept."""
    answers = a.fact_answer(spark, sf_dir).filter("question_id IS NOT NULL")
    of = lambda half: answers.filter(F.col("event_id") % 2 == half).groupBy("learner_id", "question_id").agg(F.max("at").alias("at"), F.min("event_id").alias("ord"))
    return union_by_key(of(0), of(1), ["learner_id", "question_id"])


@query(f"""WITH {ANSWER}, u AS (SELECT DISTINCT learner_id, question_id, "at" FROM ans), r AS (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY "at" DESC, question_id DESC) AS n FROM u) SELECT learner_id, question_id, "at" FROM r WHERE n <= 50""")
def restored_history(spark, sf_dir):
    """Answers of a backup and those that are there, once by question and time, the newest of them."""
    answers = a.fact_answer(spark, sf_dir).select("learner_id", "question_id", "at", F.col("question_id").alias("event_id"))
    both = answers.filter("event_id % 2 = 0").unionByName(answers).dropDuplicates(["learner_id", "question_id", "at"])
    return op.newest(both, "learner_id", 50).select("learner_id", "question_id", "at")


@query(f"""WITH {OPEN}, m AS (SELECT learner_id, count(*) AS mistakes FROM book WHERE due <= TIMESTAMP '{NOW}' GROUP BY 1),
c AS (SELECT learner_id, count(DISTINCT question_id) AS cards FROM ans WHERE event_id % 4 = 0 GROUP BY 1),
b AS (SELECT coalesce(m.learner_id, c.learner_id) AS learner_id, coalesce(mistakes, 0) AS mistakes, coalesce(cards, 0) AS cards FROM m FULL JOIN c ON m.learner_id = c.learner_id)
SELECT *, 1 + mistakes + cards AS items, greatest(5, CAST(floor((1 + mistakes + cards) * 1.5 + 0.5) AS BIGINT)) AS minutes FROM b""")
def review_queue(spark, sf_dir):
    answers = a.fact_answer(spark, sf_dir)
    cards = answers.filter("event_id % 4 = 0").select("learner_id", "question_id").distinct()
    return op.review_queue(op.due_order(_notebook(spark, sf_dir), NOW), cards)


@query(f"""WITH {OPEN}, due AS (SELECT learner_id, question_id, row_number() OVER (PARTITION BY learner_id ORDER BY coalesce(sure, false) DESC, first_at, question_id) AS place FROM book WHERE due <= TIMESTAMP '{NOW}'),
f AS (SELECT learner_id, question_id, 0 AS section, place AS ord FROM due WHERE place <= 5),
deck AS (SELECT learner_id, question_id, min(event_id) AS ord FROM ans GROUP BY 1, 2),
u AS (SELECT * FROM f UNION ALL SELECT learner_id, question_id, 1, ord FROM deck WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.learner_id = deck.learner_id AND f.question_id = deck.question_id))
SELECT learner_id, row_number() OVER (PARTITION BY learner_id ORDER BY section, ord, question_id) AS place, question_id, section FROM u""")
def front_loaded_deck(spark, sf_dir):
    deck = a.fact_answer(spark, sf_dir).groupBy("learner_id", "question_id").agg(F.min("event_id").alias("ord"))
    return op.front_load(op.due_order(_notebook(spark, sf_dir), NOW), deck)


@query(f"""WITH {ANSWER}, w AS (SELECT learner_id, CAST(date_trunc('week', "at") AS DATE) AS week, chapter FROM ans)
SELECT learner_id, week, count(*) FILTER (WHERE chapter = 'click') AS click, count(*) FILTER (WHERE chapter = 'view') AS view, count(*) FILTER (WHERE chapter = 'purchase') AS purchase, count(DISTINCT chapter) AS kinds FROM w GROUP BY 1, 2""")
def kind_tally(spark, sf_dir):
    """Activities by kind and week, with how many kinds there were."""
    weeks = a.fact_answer(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "at")))
    tally = [F.count_if(F.col("chapter") == k).alias(k) for k in ("click", "view", "purchase")]
    return weeks.groupBy("learner_id", "week").agg(*tally, F.count_distinct("chapter").alias("kinds"))


@query(f"""WITH {ANSWER}, d AS (SELECT learner_id, CAST("at" AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE correct) AS right_n FROM ans GROUP BY 1, 2)
SELECT learner_id, day, sum(n) OVER w AS attempted, sum(right_n) OVER w AS correct FROM d
WINDOW w AS (PARTITION BY learner_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def trailing_week(spark, sf_dir):
    """Answers of the seven days up to each active day: the batch form of the trailing stream."""
    days = a.fact_answer(spark, sf_dir).groupBy("learner_id", F.to_date("at").alias("day")).agg(F.count("*").alias("n"), F.count_if("correct").alias("right_n"))
    frame = Window.partitionBy("learner_id").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return days.select("learner_id", "day", F.sum("n").over(frame).alias("attempted"), F.sum("right_n").over(frame).alias("correct"))
