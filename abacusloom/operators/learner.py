"""Learner analytics over answer and review logs and mock exams.

Every function takes DataFrames keyed by ``learner_id`` (or ``mock_id``) and aggregates or windows within the key only, so the
work splits by learner; a learner's events are never gathered in an array unless a function says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compose import chance
from .ranges import BLOCK_ROWS, dealt, running

WEEK_MS = 7 * 86_400_000


def half_up(x: Column) -> Column:
    """The whole number nearest to ``x``, halves upwards also below zero."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(100.0 * part / whole))


def week_stats(answers: DataFrame, now: str) -> DataFrame:
    """Answers of the last seven days, per learner."""
    recent = answers.filter(F.col("at") >= F.to_timestamp_ntz(F.lit(now)) - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy("learner_id").agg(F.count("*").alias("attempted"), F.count_if("correct").alias("correct"))


def week_changes(answers: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each learner's answers of the trailing seven days at every moment at which they change: ``at`` (to the millisecond), ``attempted``, ``correct``. An answer
    counts from its own moment to seven days later, that moment included, and is gone a millisecond after."""
    at = F.unix_millis(F.col("at").cast("timestamp"))
    right = F.col("correct").cast("long")
    moves = F.array(F.struct(at.alias("ms"), F.lit(1).cast("long").alias("n"), right.alias("r")), F.struct((at + WEEK_MS + 1).alias("ms"), F.lit(-1).cast("long").alias("n"), (-right).alias("r")))
    steps = answers.select("learner_id", F.inline(moves)).groupBy("learner_id", "ms").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    rows = running(steps, ["learner_id"], ["ms"], {"attempted": "n", "correct": "r"}, block_rows=block_rows)
    return rows.select("learner_id", F.timestamp_millis("ms").alias("at"), "attempted", "correct")


def calibration(answers: DataFrame) -> DataFrame:
    """How often sure and unsure answers were right, per learner, and what that says about the learner's confidence.

    Only answers with a confidence tag count. A high hit rate when unsure with a small gap is underconfidence; then a low one when
    sure, or a small gap, is overconfidence; anything else, or either side without answers, is calibrated."""
    tagged = answers.filter(F.col("sure").isNotNull())
    counts = tagged.groupBy("learner_id").agg(
        F.count_if("sure").alias("n_sure"),
        F.count_if(F.col("sure") & F.col("correct")).alias("hits_sure"),
        F.count_if(~F.col("sure")).alias("n_unsure"),
        F.count_if(~F.col("sure") & F.col("correct")).alias("hits_unsure"),
    )
    rates = counts.withColumns({"pct_sure": percent(F.col("hits_sure"), F.col("n_sure")), "pct_unsure": percent(F.col("hits_unsure"), F.col("n_unsure"))})
    rates = rates.withColumn("gap", F.col("pct_sure") - F.col("pct_unsure"))
    verdict = (
        F.when(F.col("gap").isNull(), "calibrated")
        .when((F.col("pct_unsure") >= 70) & (F.col("gap") < 15), "underconfident")
        .when((F.col("pct_sure") < 75) | (F.col("gap") < 15), "overconfident")
        .otherwise("calibrated")
    )
    return rates.select("learner_id", "n_sure", "pct_sure", "n_unsure", "pct_unsure", "gap", verdict.alias("verdict"))


def session_levels(answers: DataFrame, session: Sequence[Column | str]) -> DataFrame:
    """Level that each right answer earns in its session and topic: 1, or 2 from the third on. A wrong answer doesn't reset it."""
    order = Window.partitionBy("learner_id", "topic", *session).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    right = F.sum(F.col("correct").cast("int")).over(order)
    return answers.withColumn("level", F.when(F.col("correct"), F.when(right >= 3, 2).otherwise(1)).otherwise(0))


def mastery(answers: DataFrame, days: int = 3) -> DataFrame:
    """Highest level per learner and topic; 3 after level 2 on ``days`` distinct days. ``answers`` has ``level`` and ``at``."""
    top = answers.groupBy("learner_id", "topic").agg(F.max("level").alias("seen"), F.count_distinct(F.when(F.col("level") >= 2, F.to_date("at"))).alias("proficient_days"))
    return top.select("learner_id", "topic", F.when(F.col("proficient_days") >= days, 3).otherwise(F.col("seen")).alias("level"), "proficient_days")


def paper_progress(mastered: DataFrame, prefixes: Sequence[str], total: int) -> DataFrame:
    """Share of ``total`` topics at level 2 or more whose name has one of the prefixes, at most 100."""
    named = F.lit(False)
    for p in prefixes:
        named = named | F.col("topic").startswith(p)
    return mastered.groupBy("learner_id").agg(F.least(F.lit(100), half_up(100.0 * F.count_if((F.col("level") >= 2) & named) / total)).alias("progress"))


def last_activity(answers: DataFrame) -> DataFrame:
    return answers.groupBy("learner_id").agg(F.max("at").alias("last_at"))


def newest(events: DataFrame, key: str, most: int) -> DataFrame:
    """The last ``most`` events of each key; ``event_id`` breaks ties."""
    order = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def returns_after_gap(answers: DataFrame, days: int = 4) -> DataFrame:
    """Answers that come at least ``days`` days after the learner's answer before."""
    order = Window.partitionBy("learner_id").orderBy("at", "event_id")
    before = F.lag("at").over(order)
    rows = answers.withColumn("before", before)
    return rows.filter(F.col("at") - F.col("before") >= F.expr(f"INTERVAL {days} DAYS")).select("learner_id", "event_id", "at", "before")


def notebook(answers: DataFrame, due_days: Column | None = None) -> DataFrame:
    """Open mistakes per learner and question: wrong answers since the last right one.

    ``first_at`` is when it was entered, ``reps`` how often it was missed again, ``sure`` the last tag that was given,
    ``due`` a seeded 3 to 7 days after the last miss."""
    key = Window.partitionBy("learner_id", "question_id")
    stamp = F.struct("at", "event_id")
    rows = answers.withColumn("cleared", F.max(F.when(F.col("correct"), stamp)).over(key))
    missed = rows.filter(~F.col("correct") & (F.col("cleared").isNull() | (stamp > F.col("cleared"))))
    found = missed.groupBy("learner_id", "question_id").agg(
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        (F.count("*") - 1).alias("reps"),
        F.max(F.when(F.col("sure").isNotNull(), F.struct("at", "event_id", "sure")))["sure"].alias("sure"),
    )
    wait = due_days if due_days is not None else jitter_days(F.col("learner_id"), F.col("question_id"), F.col("reps"))
    seconds = (wait * 86_400).cast("long")
    return found.withColumn("due", F.col("last_at") + F.make_dt_interval(secs=seconds))


def jitter_days(*parts: Column) -> Column:
    """A wait of 3 to 7 days that depends on the parts alone."""
    return 3 + 4 * chance("wait", *parts)


def due_order(mistakes: DataFrame, now: str) -> DataFrame:
    """Due mistakes with their place in the queue: confidently wrong ones first, then the oldest."""
    order = Window.partitionBy("learner_id").orderBy(F.desc(F.coalesce("sure", F.lit(False))), "first_at", "question_id")
    due = mistakes.filter(F.col("due") <= F.to_timestamp_ntz(F.lit(now)))
    return due.withColumn("place", F.row_number().over(order))


def due_by_chapter(mistakes: DataFrame, questions: DataFrame, now: str) -> DataFrame:
    """Due mistakes per chapter; those of unknown questions are left out."""
    due = mistakes.filter(F.col("due") <= F.to_timestamp_ntz(F.lit(now)))
    return due.join(questions.select("question_id", "chapter"), "question_id").groupBy("learner_id", "chapter").agg(F.count("*").alias("due"))


def chapter_levels(learners: DataFrame, chapters: DataFrame, mastered: DataFrame) -> DataFrame:
    """Level of every learner in every chapter of their deck by the chapter's mastery topic, 0 without evidence."""
    first = chapters.groupBy("chapter").agg(F.min_by("topic", "ord").alias("topic"))
    rows = learners.join(first, "chapter")
    return rows.join(mastered.select("learner_id", "topic", "level"), ["learner_id", "topic"], "left").select("learner_id", "chapter", "topic", F.coalesce("level", F.lit(0)).alias("level"))


def cards_due(cards: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """Cards that have no state or are due. ``cards`` lists (learner_id, card_id)."""
    rows = cards.join(state.select("learner_id", "card_id", "due"), ["learner_id", "card_id"], "left")
    return rows.filter(F.col("due").isNull() | (F.col("due") <= F.to_timestamp_ntz(F.lit(now))))


def variant_pick(served: DataFrame, questions: DataFrame) -> DataFrame:
    """For each question served the variant to ask instead: same topic prefix, same paper first, no case row, else itself.

    Candidates of a prefix are ranked once, by a hash; the best two per prefix and paper are enough, as only the question itself has to be
    avoided. ``served`` and ``questions`` have ``question_id``, ``prefix``, ``paper``."""
    free = questions.filter(~F.col("is_case")).select("question_id", "prefix", "paper")
    def best_two(by: list[str], name: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("h", "question_id")
        ranked = free.withColumn("h", chance("variant", "question_id")).withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
        return ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("h", F.col("question_id").alias("q")))).alias(name))

    rows = served.join(best_two(["prefix", "paper"], "near"), ["prefix", "paper"], "left").join(best_two(["prefix"], "far"), ["prefix"], "left")
    other = lambda name: F.get(F.filter(F.col(name)["q"], lambda q: q != F.col("question_id")), F.lit(0))
    return rows.select(*[served[c] for c in ("prefix", "paper", "question_id")], F.coalesce(other("near"), other("far"), F.col("question_id")).alias("variant_id"))


def session_variants(served: DataFrame, questions: DataFrame) -> DataFrame:
    """Variants of the questions that a session serves (``session``, ``question_id``, ``prefix``), of which no two are the same: the served questions of a prefix
    take the session's free questions of that prefix in turn, by a hash; where these run out a question stays itself. ``questions`` has question_id, prefix, is_case."""
    turn = F.crc32(F.concat_ws("/", F.col("session").cast("string"), F.col("question_id").cast("string")))
    w = Window.partitionBy("session", "prefix")
    asked = served.withColumns({"_at": F.row_number().over(w.orderBy("question_id")), "_n": F.count("*").over(w)})
    need = asked.groupBy("session", "prefix").agg(F.max("_n").alias("_n"))
    pool = questions.filter(~F.col("is_case")).select("prefix", "question_id")
    ranked = pool.withColumn("_rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.crc32(F.col("question_id").cast("string")), "question_id")))
    # twice as many candidates as served ones are enough: at most that many of them are served themselves. They are looked up by their ranks, so that a session
    # meets its own candidates and not all questions of the prefix; the list of ranks seems small to Spark, and isn't
    ranks = need.select("session", "prefix", F.explode(F.sequence(F.lit(1), (2 * F.col("_n")).cast("int"))).alias("_rank"))
    near = ranks.hint("merge").join(ranked, ["prefix", "_rank"])
    free = near.join(served.select("session", "question_id"), ["session", "question_id"], "left_anti").withColumn("_turn", turn)
    free = free.select("session", "prefix", F.col("question_id").alias("_free"), F.row_number().over(w.orderBy("_turn", "question_id")).alias("_at"))
    return asked.join(free, ["session", "prefix", "_at"], "left").select("session", "prefix", "question_id", F.coalesce("_free", "question_id").alias("variant_id"))


RIGHT, WRONG = 1.0, -0.25  # marks of an answer in an exam with negative marking
ITEMS_A_TASK = 2_000_000


def mock_totals(items: DataFrame, bar: float = 40.0) -> DataFrame:
    """Counts, net marks, share of the paper, the bar, the penalty paid and what blanks could have brought."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = items.groupBy("mock_id").agg(F.count("*").alias("questions"), n("correct").alias("correct"), n("wrong").alias("wrong"), n("blank").alias("blank"), F.sum("secs").alias("secs"))
    net = F.col("correct") * RIGHT + F.col("wrong") * WRONG
    pct = F.round(100 * net / F.col("questions"), 4)
    return sums.select("*", net.alias("net"), pct.alias("pct"), (pct >= bar).alias("passed"), (F.col("wrong") * -WRONG).alias("penalty"), (F.col("wrong") * RIGHT).alias("forgone"), (F.col("blank") * WRONG).alias("blank_low"), (F.col("blank") * RIGHT).alias("blank_high"))


def group_stats(items: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Accuracy and time per mock and group; groups that the dimension lacks are ``ungrouped``. Groups are few and their items many: the dimension is
    broadcast, so that a group's items never meet in one task."""
    source = items
    if groups is not None:
        items = items.join(F.broadcast(groups.select("group_id", F.lit(True).alias("known"))), "group_id", "left").withColumn("group_id", F.when(F.col("known"), F.col("group_id")).otherwise("ungrouped"))
    items = dealt(items.select("mock_id", "group_id", "status", "secs"), ["mock_id", "group_id"], ITEMS_A_TASK, source)
    n = lambda s: F.count_if(F.col("status") == s)
    sums = items.groupBy("mock_id", "group_id").agg(F.count("*").alias("n"), n("correct").alias("correct"), n("wrong").alias("wrong"), n("blank").alias("blank"), F.sum("secs").alias("secs"))
    return sums.withColumn("net", F.col("correct") * RIGHT + F.col("wrong") * WRONG)


def case_scores(items: DataFrame) -> DataFrame:
    """A case set counts as one: right only if all its questions are."""
    return items.groupBy("mock_id", "case_id").agg(F.count("*").alias("size"), F.count_if(F.col("status") == "correct").alias("correct")).withColumn("whole", F.col("size") == F.col("correct"))


def time_stats(items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fastest, slowest and middle seconds of each mock; of an even number the upper middle, an element of the list. Only distinct seconds are sorted."""
    counts = items.groupBy("mock_id", "secs").agg(F.count("*").alias("c"))
    rows = running(counts, ["mock_id"], ["secs"], {"upto": "c"}, {"n": "upto"}, block_rows=block_rows, source=items)
    middle = F.min(F.when(F.col("upto") >= F.floor(F.col("n") / 2) + 1, F.col("secs")))
    return rows.groupBy("mock_id").agg(F.min("secs").alias("fastest"), middle.alias("middle"), F.max("secs").alias("slowest"))


def slowest(items: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("mock_id").orderBy(F.desc("secs"), "pos", "question_id")
    return items.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("mock_id", "place", "question_id", "secs")


def self_grade(points: DataFrame, paper_marks: float = 100.0) -> DataFrame:
    """Self-graded descriptive answers: earned and possible marks, scaled to the paper, and parts below half.

    ``points`` has ``mock_id``, ``part``, ``marks`` and ``ticked``."""
    part = points.groupBy("mock_id", "part").agg(F.sum("marks").alias("possible"), F.sum(F.when(F.col("ticked"), F.col("marks")).otherwise(0.0)).alias("earned"))
    total = part.groupBy("mock_id").agg(F.sum("possible").alias("possible"), F.sum("earned").alias("earned"), F.count_if(F.col("earned") * 2 < F.col("possible")).alias("weak_parts"))
    return total.withColumn("scaled", F.round(paper_marks * F.col("earned") / F.col("possible"), 2))


def missed_by_slot(points: DataFrame) -> DataFrame:
    """Marks that each slot of a paper missed. ``points`` has ``mock_id``, ``slot``, ``marks`` and ``ticked``."""
    return points.groupBy("mock_id", "slot").agg(F.sum(F.when(F.col("ticked"), 0.0).otherwise(F.col("marks"))).alias("missed"), F.count("*").alias("points"))


def review_queue(mistakes_due: DataFrame, cards_due_: DataFrame) -> DataFrame:
    """Items and minutes of the daily queue: one more than what is due, a minute and a half each, five at least."""
    m = mistakes_due.groupBy("learner_id").agg(F.count("*").alias("mistakes"))
    c = cards_due_.groupBy("learner_id").agg(F.count("*").alias("cards"))
    both = m.join(c, "learner_id", "full").select("learner_id", F.coalesce("mistakes", F.lit(0)).alias("mistakes"), F.coalesce("cards", F.lit(0)).alias("cards"))
    items = 1 + F.col("mistakes") + F.col("cards")
    return both.select("*", items.alias("items"), F.greatest(F.lit(5), half_up(items * 1.5)).alias("minutes"))


def front_load(due: DataFrame, deck: DataFrame, most: int = 5) -> DataFrame:
    """A deck with at most ``most`` due questions in front; a question is asked once. ``due`` has ``place``, ``deck`` has ``ord``."""
    first = due.filter(F.col("place") <= most).select("learner_id", "question_id", F.lit(0).alias("section"), F.col("place").cast("long").alias("ord"))
    rest = deck.join(first.select("learner_id", "question_id"), ["learner_id", "question_id"], "left_anti").select("learner_id", "question_id", F.lit(1).alias("section"), F.col("ord").cast("long").alias("ord"))
    order = Window.partitionBy("learner_id").orderBy("section", "ord", "question_id")
    return first.unionByName(rest).withColumn("place", F.row_number().over(order)).select("learner_id", "place", "question_id", "section")
