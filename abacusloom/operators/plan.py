"""Study plans for many learners at once: calendar rows per plan, with kinds of days by precedence.

Plans are dealt to tasks before their days are listed, so that a task holds so many plans and not a share of all days. Spark takes tables of
listed days for as small as the requests they come from, so joins with them name their kind: never a broadcast.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .compose import largest_remainder
from .ranges import dealt

#: Shares of the working days, days before the exam, situations with their weekly hours.
LEARN, PRACTICE, REVISE = 0.5, 0.3, 0.2
SHORT_RUNWAY, LAST_CYCLE_DAYS = 21, 14
MOCK_FROM, MOCK_TO, ANCHORS = 35, 4, (22, 8)
MOCK_TARGETS = ((20, 6), (14, 5), (8, 3), (4, 2), (1, 1))
LIGHT_FROM_WORK_DAYS = 30
WEAK = 1.35
HOURS = {"class12": (14, 27), "postboards": (35, 60), "bcom": (20, 40)}
PLANS_A_TASK, PAPERS_A_TASK = 2_048, 8_192


def runway(requests: DataFrame, plans_a_task: int = PLANS_A_TASK) -> DataFrame:
    """One row per plan and day from its start to the day before the exam. ``requests`` has plan_id, start_date, exam_date."""
    last = F.date_sub("exam_date", 1)
    days = dealt(requests, ["plan_id"], plans_a_task).filter(F.col("start_date") <= last).withColumn("date", F.explode(F.sequence("start_date", last)))
    return days.withColumns({"weekday": F.weekday("date"), "week": F.to_date(F.date_trunc("week", "date")), "seq": F.date_diff("date", "start_date")})


def scaffold(days: DataFrame) -> DataFrame:
    """``days`` with ``eve`` (of the exam), ``buffer`` (Saturdays, and Wednesdays of every third week), ``work``, how many work days a plan
    has (``works``), the rank of each among them from 0, and the days of the runway."""
    plan = Window.partitionBy("plan_id")
    eve = F.col("date") == F.date_sub("exam_date", 1)
    buffer = ((F.col("weekday") == 5) | ((F.col("weekday") == 2) & (F.floor(F.col("seq") / 7) % 3 == 2))) & ~eve
    rows = days.withColumns({"eve": eve, "buffer": buffer, "work": ~eve & ~buffer, "runway": F.count("*").over(plan)})
    rank = F.sum(F.col("work").cast("int")).over(plan.orderBy("date")) - 1
    return rows.withColumns({"works": F.count_if("work").over(plan), "rank": F.when(F.col("work"), rank)})


def phases(days: DataFrame) -> DataFrame:
    """``scaffold`` with the ``phase`` of each work day: half of them study, three tenths the first revision, the rest the second and, from
    two weeks before the exam, the third. A runway of less than three weeks has the three revisions only."""
    nearest = lambda share: F.floor(F.col("works") * share + 0.5).cast("int")
    short = F.col("runway") < SHORT_RUNWAY
    rows = days.withColumns({"_study": nearest(LEARN), "_last": nearest(REVISE), "_more": nearest(PRACTICE)})
    rows = rows.withColumn("_tail", F.least(F.col("works").cast("int"), F.col("_study") + F.greatest(F.lit(0), F.col("works").cast("int") - F.col("_study") - F.col("_last"))))
    place, left = F.col("rank") - F.col("_tail"), F.col("works") - F.col("_tail")
    gate = F.date_sub("exam_date", LAST_CYCLE_DAYS)
    first = F.min(F.when((place >= 0) & (F.col("date") >= gate), place)).over(Window.partitionBy("plan_id"))
    cut = F.coalesce(first, F.greatest(F.lit(0), left - 2))
    cut = F.when(left >= 3, F.least(F.greatest(cut, F.lit(1)), left - 2)).otherwise(cut)
    one = F.greatest(F.lit(1), F.col("_study"))
    two = one + F.greatest(F.when(F.col("works") - one > 1, 1).otherwise(0), F.col("_more"))
    rank = F.col("rank")
    long_form = F.when(rank < F.col("_study"), "study").when(rank < F.col("_tail"), "revision1").when(place < cut, "revision2").otherwise("revision3")
    short_form = F.when(rank < one, "revision1").when(rank < two, "revision2").otherwise("revision3")
    return rows.withColumn("phase", F.when(F.col("work"), F.when(short, short_form).otherwise(long_form))).drop("_study", "_last", "_more", "_tail")


def mock_days(days: DataFrame) -> DataFrame:
    """``phases`` with ``mock``: of the work days 35 to 4 days before the exam, but for the last two of the third revision, as many as their number and
    a fifth of all work days allow; Sundays first, then the two anchor days, then days spread evenly, then any."""
    plan = Window.partitionBy("plan_id")
    left = F.date_diff("exam_date", "date")
    kept = (F.col("phase") == "revision3") & (F.col("rank") >= F.col("works") - 2)
    rows = days.withColumn("_pool", F.coalesce(F.col("work") & left.between(MOCK_TO, MOCK_FROM) & ~kept, F.lit(False)))
    n = F.count_if("_pool").over(plan).cast("int")
    target = F.lit(0)
    for least, mocks in reversed(MOCK_TARGETS):
        target = F.when(n >= least, mocks).otherwise(target)
    order = plan.orderBy("date")
    rows = rows.withColumns({"_n": n, "_target": F.least(target, F.greatest(F.lit(1), F.floor(F.col("works") / 5).cast("int"))), "_at": F.sum(F.col("_pool").cast("int")).over(order) - 1})
    # kinds of days by preference, each with the order within it
    turn = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n"))), lambda k: (F.floor(k * F.col("_n") / (F.col("_target") + 1)) % F.greatest(F.lit(1), F.col("_n"))).cast("int")), F.col("_at").cast("int"))
    wish = F.when(F.col("weekday") == 6, F.struct(F.lit(0).alias("kind"), F.col("_at").cast("long").alias("turn")))
    for k, before in enumerate(ANCHORS, 1):
        wish = wish.when(left == before, F.struct(F.lit(k).alias("kind"), F.lit(0).cast("long").alias("turn")))
    wish = wish.when(turn > 0, F.struct(F.lit(3).alias("kind"), turn.cast("long").alias("turn"))).otherwise(F.struct(F.lit(4).alias("kind"), F.col("_at").cast("long").alias("turn")))
    rows = rows.withColumn("_wish", F.when(F.col("_pool"), wish))
    chosen = F.row_number().over(plan.orderBy(F.col("_wish").isNull(), "_wish")) <= F.col("_target")
    return rows.withColumn("mock", F.col("_pool") & chosen).drop("_pool", "_n", "_target", "_at", "_wish")


def day_kinds(days: DataFrame) -> DataFrame:
    """The kind of each day of a runway: the gap before the exam, buffer, mock, minimum (the day after a mock in plans of 30 work days or more), else the phase."""
    rows = mock_days(phases(scaffold(days)))
    after = F.lag("mock", 1, False).over(Window.partitionBy("plan_id").orderBy("date"))
    minimum = after & F.col("work") & ~F.col("mock") & (F.col("works") >= LIGHT_FROM_WORK_DAYS)
    kind = F.when(F.col("eve"), "gap").when(F.col("buffer"), "buffer").when(F.col("mock"), "mock").when(minimum, "minimum").otherwise(F.col("phase"))
    return rows.withColumn("kind", kind)


def exam_window(papers: DataFrame) -> DataFrame:
    """A row per plan and day from its first to its last paper: ``exam`` days with their paper, ``gap`` days with the next one."""
    ends = papers.groupBy("plan_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = ends.select("plan_id", F.explode(F.sequence("first", "last")).alias("date"))
    rows = days.join(papers.select("plan_id", "date", "paper").hint("merge"), ["plan_id", "date"], "left")
    ahead = Window.partitionBy("plan_id").orderBy("date", "paper").rowsBetween(0, Window.unboundedFollowing)
    return rows.select("plan_id", "date", F.when(F.col("paper").isNotNull(), "exam").otherwise("gap").alias("kind"), F.first("paper", ignorenulls=True).over(ahead).alias("paper"))


def in_exam_window(dates: DataFrame, papers: DataFrame) -> DataFrame:
    """``dates`` with whether each lies between the day before the plan's first paper and its last."""
    ends = papers.groupBy("plan_id").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    return dates.join(ends.hint("merge"), "plan_id", "left").withColumn("in_window", F.coalesce(F.col("date").between(F.date_sub("_first", 1), F.col("_last")), F.lit(False))).drop("_first", "_last")


def mock_rotation(days: DataFrame, papers: DataFrame) -> DataFrame:
    """What each mock of ``day_kinds`` is: the plan's papers in turn, weak ones first, the last two of three or more all papers. ``papers`` has
    plan_id, paper, number, weak. ``anchor`` marks the days that track the usual series."""
    plan = Window.partitionBy("plan_id")
    mocks = days.filter("mock").select("plan_id", "date", "exam_date", (F.row_number().over(plan.orderBy("date")) - 1).alias("nth"), F.count("*").over(plan).alias("mocks"))
    ranked = dealt(papers, ["plan_id"], PAPERS_A_TASK).select("plan_id", "paper", (F.row_number().over(plan.orderBy(F.desc("weak"), "number", "paper")) - 1).alias("place"), F.count("*").over(plan).alias("n"))
    rows = mocks.join(ranked.hint("merge"), "plan_id").filter(F.col("nth") % F.col("n") == F.col("place"))
    full = (F.col("mocks") >= 3) & (F.col("nth") >= F.col("mocks") - 2)
    anchor = F.date_diff("exam_date", "date").isin(*ANCHORS)
    return rows.select("plan_id", "date", "nth", F.when(full, "full").otherwise(F.col("paper").cast("string")).alias("scope"), anchor.alias("anchor"))


def chapter_weights(papers: DataFrame, chapters: DataFrame, groups: DataFrame, bridge: DataFrame) -> DataFrame:
    """Marks of each chapter: of every group that covers it an even part of the group's midpoint (a share of the paper, or of its section where the
    paper says so) or of its fixed marks; a chapter without any takes the average of the paper's others, or 1. ``papers`` has paper, marks, by_section;
    ``groups`` paper, group, lo, hi, marks, section_marks; ``bridge`` paper, group, chapter. Not normalised."""
    covered = bridge.join(chapters.select("paper", "chapter"), ["paper", "chapter"], "left").withColumn("_size", F.count("*").over(Window.partitionBy("paper", "group")))
    basis = F.when(F.col("by_section"), F.coalesce("section_marks", "paper_marks")).otherwise(F.col("paper_marks"))
    fixed = F.coalesce(F.col("marks"), F.lit(0.0))
    valued = groups.join(papers.select("paper", F.coalesce("marks", F.lit(100.0)).alias("paper_marks"), "by_section"), "paper")
    valued = valued.select("paper", "group", F.when(F.col("lo").isNotNull(), (F.col("lo") + F.col("hi")) / 2 / 100 * basis).otherwise(fixed).alias("_marks"))
    parts = covered.join(valued, ["paper", "group"]).groupBy("paper", "chapter").agg(F.sum(F.col("_marks") / F.col("_size")).alias("weight"))
    rows = chapters.join(parts, ["paper", "chapter"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    average = F.avg(F.when(F.col("weight") > 0, F.col("weight"))).over(Window.partitionBy("paper"))
    return rows.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.coalesce(average, F.lit(1.0))))


def study_stream(slots: DataFrame, papers: DataFrame, chapters: DataFrame) -> DataFrame:
    """Visits to chapters in the order of study, per plan and stream. ``slots`` has plan_id, slots; ``papers`` plan_id, paper, number, stream, weak (two papers a
    stream at most); ``chapters`` paper, chapter, number, weight. Slots go to the papers by mass, weak ones tilted, then to their chapters by weight, each at least
    once; the two papers of a stream are interleaved in proportion. Chapters are broadcast: each plan lists all those of its papers, so they are few against the result."""
    pair, one = ["plan_id", "stream"], ["plan_id", "stream", "paper"]
    mass = chapters.groupBy("paper").agg(F.sum("weight").alias("mass"))
    of = dealt(papers, ["plan_id"], PAPERS_A_TASK).join(slots.filter("slots > 0").hint("merge"), "plan_id").join(F.broadcast(mass), "paper")
    of = of.withColumn("mass", F.col("mass") * F.when(F.col("weak"), WEAK).otherwise(1.0))
    of = largest_remainder(of, pair, "number", "mass", "slots").withColumn("second", F.row_number().over(Window.partitionBy(*pair).orderBy("number")) > 1)
    rows = of.select(*one, "second", F.col("share").alias("paper_slots")).join(F.broadcast(chapters.select("paper", "chapter", "number", "weight")), "paper")
    rows = largest_remainder(rows, one, "number", "weight", "paper_slots")
    visits = rows.select(*one, "chapter", "number", "second", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"))).alias("visit"))
    visits = visits.withColumn("ord", F.row_number().over(Window.partitionBy(*one).orderBy("number", "visit")) - 1)
    return in_turn(visits, pair, "second").select(*pair, "paper", "chapter", "visit", (F.col("place") - 1).alias("ord"))


def revision_stream(papers: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """Every chapter (or group) of the papers of a stream once, the two papers interleaved in proportion. Items are broadcast, as chapters are in ``study_stream``."""
    pair = ["plan_id", "stream"]
    rows = dealt(papers, ["plan_id"], PAPERS_A_TASK).withColumn("second", F.row_number().over(Window.partitionBy(*pair).orderBy("number")) > 1)
    rows = rows.select(*pair, "paper", "second").join(F.broadcast(items.select("paper", item, F.col("number").alias("_number"))), "paper")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy(*pair, "paper").orderBy("_number")) - 1)
    return in_turn(rows, pair, "second").select(*pair, "paper", item, (F.col("place") - 1).alias("ord"))


def paired_days(days: DataFrame, items: DataFrame, phase: str) -> DataFrame:
    """Items of every stream (plan_id, stream, ord) over the days of a phase, so that each day has one of each. Mocks and the days after them don't teach."""
    teaching = days.filter(F.col("kind") == phase).groupBy("plan_id").agg(F.sort_array(F.collect_list("date")).alias("_dates"))
    rows = items.join(teaching.withColumn("_teaching", F.size("_dates")).hint("merge"), "plan_id")
    return deal(rows, "_teaching", ["plan_id", "stream"]).withColumn("date", F.get("_dates", F.col("day").cast("int"))).drop("_dates", "_teaching", "day", "ord")


def paper_cycle(days: DataFrame, papers: DataFrame, phase: str = "revision3", a_day: int = 2) -> DataFrame:
    """Papers as wholes in turn, by number, so many on each teaching day of the last phase: with n papers place ``k`` of the phase's days goes to the paper k modulo n."""
    plan = Window.partitionBy("plan_id")
    teaching = days.filter(F.col("kind") == phase).select("plan_id", "date", (F.row_number().over(plan.orderBy("date")) - 1).alias("_day"))
    places = teaching.select("plan_id", "date", F.explode(F.sequence(F.lit(0), F.lit(a_day - 1))).alias("slot"), (F.col("_day") * a_day).alias("_first"))
    ranked = dealt(papers, ["plan_id"], PAPERS_A_TASK).select("plan_id", "paper", (F.row_number().over(plan.orderBy("number", "paper")) - 1).alias("_at"), F.count("*").over(plan).alias("_n"))
    return places.join(ranked.hint("merge"), "plan_id").filter((F.col("_first") + F.col("slot")) % F.col("_n") == F.col("_at")).select("plan_id", "date", "slot", "paper")


def day_of(plan_days: DataFrame, dates: DataFrame) -> DataFrame:
    """The plan's record for each asked date."""
    return dates.join(plan_days.hint("merge"), ["plan_id", "date"])


def summary(days: DataFrame) -> DataFrame:
    """Days, working days, share of buffers, days of each phase and mocks of each plan of ``day_kinds``."""
    phase = lambda p: F.count_if(F.col("phase") == p)
    return days.groupBy("plan_id").agg(
        F.count("*").alias("runway"),
        F.count_if("work").alias("work"),
        F.floor(100.0 * F.count_if("buffer") / F.count("*") + 0.5).alias("buffer_pct"),
        *(phase(p).alias(p) for p in ("study", "revision1", "revision2", "revision3")),
        F.count_if("mock").alias("mocks"),
        (F.count("*") < SHORT_RUNWAY).alias("compressed"),
    )


def spans(days: DataFrame) -> DataFrame:
    return days.groupBy("plan_id", "kind").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))


def warnings(requests: DataFrame, kinds: DataFrame, chapters: int) -> DataFrame:
    """Flags of a plan: hours missing or outside those of the situation (``bcom`` where it isn't known), cut-off before the start or within 30 days of it, a short
    runway, and study or first-revision days too few for the chapters."""
    lo, hi = F.lit(HOURS["bcom"][0]), F.lit(HOURS["bcom"][1])
    for mode, (least, most) in HOURS.items():
        lo, hi = F.when(F.col("mode") == mode, least).otherwise(lo), F.when(F.col("mode") == mode, most).otherwise(hi)
    hours, left = F.col("hours"), F.date_diff("cutoff", "start_date")
    none = hours.isNull() | (hours <= 0)
    n = kinds.groupBy("plan_id").agg(F.count_if(F.col("kind") == "study").alias("_study"), F.count_if(F.col("kind") == "revision1").alias("_first"))
    return requests.join(n.hint("merge"), "plan_id").select(
        "plan_id",
        none.alias("no_hours"),
        (~none & (hours < lo)).alias("few_hours"),
        (~none & (hours > hi)).alias("many_hours"),
        (left < 0).alias("cutoff_passed"),
        left.between(0, 30).alias("cutoff_near"),
        (F.date_diff("exam_date", "start_date") < SHORT_RUNWAY).alias("short_runway"),
        ((F.col("_study") > 0) & (F.col("_study") * 2 < chapters)).alias("dense_study"),
        ((F.col("_first") > 0) & (F.lit(chapters) > F.col("_first") * 6)).alias("dense_revision"),
    )


def deal(items: DataFrame, days: str | int, key: str | Sequence[str]) -> DataFrame:
    """``items`` (with ``ord`` from 0) over ``days`` days (a number, or a column that is equal in a key) evenly and in order: day d has those from floor(d n / D) on.
    A day that has none repeats the item before; where none came before it opens with the first. So an item stands for the days from its own to the next one's."""
    keys = [key] if isinstance(key, str) else list(key)
    over = (F.lit(days) if isinstance(days, int) else F.col(days)).cast("long")
    w = Window.partitionBy(*keys)
    rows = items.withColumn("_own", F.floor(((F.col("ord") + 1) * over - 1) / F.count("*").over(w)))
    rows = rows.withColumn("_next", F.coalesce(F.lead("_own").over(w.orderBy("ord")), over))
    first = F.when(F.col("ord") == 0, F.lit(0).cast("long")).otherwise(F.col("_own"))
    rows = rows.filter(over > 0).withColumn("day", F.explode(F.sequence(first, F.greatest(F.col("_own"), F.col("_next") - 1))))
    return rows.select(*keys, "day", *(c for c in items.columns if c not in keys), ((F.col("day") != F.col("_own")) & (F.col("day") > 0)).alias("repeat"))


def in_turn(rows: DataFrame, key: Sequence[str], stream: str) -> DataFrame:
    """``place`` of the rows of each key's streams (each with ``ord`` from 0) in proportion to their lengths; on ties the lower stream comes first."""
    rows = rows.withColumn("_at", F.col("ord") / F.count("*").over(Window.partitionBy(*key, stream)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("_at", stream, "ord"))).drop("_at")


def merge_streams(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two ordered streams (``ord`` from 0) of each key in proportion to their lengths; on ties the first one comes first."""
    return in_turn(a.withColumn("stream", F.lit(0)).unionByName(b.withColumn("stream", F.lit(1))), [key], "stream")


def next_on_or_after(dates: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """The next paper of each row's key on or after its date, if there is one: a forward as-of join by one sorted pass."""
    rows = dates.select(key, "date", F.lit(0).alias("_paper"), F.lit(None).cast("string").alias("paper"), F.lit(None).cast("date").alias("paper_date"))
    rows = rows.unionByName(papers.select(key, "date", F.lit(1).alias("_paper"), "paper", F.col("date").alias("paper_date")))
    ahead = Window.partitionBy(key).orderBy("date", "_paper", "paper").rowsBetween(0, Window.unboundedFollowing)
    named = F.when(F.col("_paper") == 1, F.struct("paper", "paper_date"))
    return rows.withColumn("_next", F.first(named, ignorenulls=True).over(ahead)).filter("_paper = 0").select(key, "date", F.col("_next.paper").alias("paper"), F.col("_next.paper_date").alias("paper_date"))
