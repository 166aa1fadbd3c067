"""Question banks as tables: pools, scopes, gates of attempts, papers composed of them, and the dimensions around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chapter_number, paper_number, slug
from .compose import greedy_draw
from .intervals import within

NEGATIVE_PAPERS = (3, 4)
MCQ_MARKS, MCQ_PART, WRITTEN_PART = 2, 30, 70


def deck(questions: DataFrame) -> DataFrame:
    """Multiple-choice questions of ``quality.flatten``, those of case sets among them, with their place in the set from 1."""
    return questions.filter("type = 'mcq'").withColumn("place", F.when(F.col("case_id").isNotNull(), F.col("sub") + 1))


def with_meta(questions: DataFrame) -> DataFrame:
    """What the bank's display texts say: numbers of paper and chapter, whether wrong answers cost marks, the id under which mastery is kept."""
    rows = questions.withColumns({"paper_no": paper_number(F.coalesce("paper", F.lit(""))), "chapter_no": chapter_number(F.coalesce("chapter", F.lit("")))})
    foundation = F.col("level") == "foundation"
    mastery = F.concat(F.when(foundation, "f").otherwise("i"), "paper_no", F.lit("-ch"), "chapter_no")
    return rows.withColumns({"negative": foundation & F.col("paper_no").isin(*NEGATIVE_PAPERS), "mastery_id": F.when((F.col("paper_no") > 0) & (F.col("chapter_no") > 0), mastery)})


def in_scope(questions: DataFrame, level: str | None = None, paper: str | None = None, chapter: str | None = None) -> DataFrame:
    """Questions of a level (those without one are intermediate), a paper (by its slug, or where it has none by its name) and a chapter."""
    if level:
        questions = questions.filter(F.coalesce("level", F.lit("intermediate")) == level)
    if paper:
        named = slug(F.coalesce("paper", F.lit(""))).contains(paper.lower())
        questions = questions.filter(F.when(F.coalesce("paper_slug", F.lit("")) != "", F.col("paper_slug") == paper.lower()).otherwise(named))
    return questions.filter(F.col("chapter_slug") == chapter) if chapter else questions


def about(questions: DataFrame, topic: str) -> DataFrame:
    return questions.filter(F.lower("topic").contains(topic.lower()))


def applicable(attempts: Column, attempt: Column) -> Column:
    """Questions without tags suit every sitting, the others those that they name."""
    return attempts.isNull() | F.array_contains(attempts, attempt)


def written(questions: DataFrame) -> DataFrame:
    """Written questions that have a skeleton, with their marks: as stated, else those of its points, one where a point has none."""
    points = F.aggregate("skeleton", F.lit(0.0), lambda total, p: total + F.coalesce(p["marks"], F.lit(1.0)))
    return questions.filter("type = 'descriptive' AND skeleton IS NOT NULL").withColumn("total_marks", F.coalesce("marks", points))


def exam_pool(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """Each question of ``deck`` on its own with the group of its chapter, ``ungrouped`` where none covers it. ``groups`` has chapter_slug, group_id."""
    return questions.join(groups, "chapter_slug", "left").withColumn("group_id", F.coalesce("group_id", F.lit("ungrouped")))


def deck_mode(decks: DataFrame, key: str) -> DataFrame:
    """Scoring of each deck: negative marking if every row has it, else without any if all rows are intermediate, else mixed."""
    flags = decks.groupBy(key).agg(F.bool_and("negative").alias("_negative"), F.bool_and(F.coalesce("level", F.lit("intermediate")) == "intermediate").alias("_inter"))
    return flags.select(key, F.when(F.col("_negative"), "negative").when(F.col("_inter"), "intermediate").otherwise("mixed").alias("mode"))


def deck_size(banks: DataFrame) -> DataFrame:
    """Questions of each bank, those of case sets counted one by one."""
    return banks.select("path", F.aggregate("questions", F.lit(0), lambda n, q: n + F.when(F.size(q["questions"]) > 0, F.size(q["questions"])).when(q["type"] == "mcq", 1).otherwise(0)).alias("questions"))


def all_questions(legacy: DataFrame, banked: DataFrame) -> DataFrame:
    """Questions of an older form after the present one's columns, missing ones null."""
    return legacy.unionByName(banked, allowMissingColumns=True)


def compose_papers(requests: DataFrame, questions: DataFrame, written_: DataFrame, seed: str) -> DataFrame:
    """For each request (request_id, paper, attempt) a paper of 30 marks of choice, case sets first and only whole, and 70 of written questions; what finds no room is passed
    over. ``missing`` are the marks that the bank can't fill. Order is chance, fixed by the seed."""
    pools = requests.select("paper", "attempt").distinct()
    within_ = lambda rows: rows.join(F.broadcast(pools), "paper").filter(applicable(F.col("applicableAttempts"), F.col("attempt")))  # noqa: E731  a row for each paper and sitting
    unit = F.coalesce("case_id", "id")
    units = within_(questions).groupBy("paper", "attempt", unit.alias("unit"), F.col("case_id").isNull().alias("late")).agg((F.count("*") * MCQ_MARKS).cast("double").alias("marks"))
    long = within_(written_).select("paper", "attempt", F.col("id").alias("unit"), F.lit(True).alias("late"), F.col("total_marks").alias("marks"))
    asks = requests.select("request_id", "paper", "attempt")
    parts = [greedy_draw(asks, rows, "request_id", ["paper", "attempt"], float(room), f"{seed}/{n}").withColumn("part", F.lit(n)) for n, (rows, room) in enumerate(((units, MCQ_PART), (long, WRITTEN_PART)), 1)]
    return parts[0].unionByName(parts[1])


def shortfall(requests: DataFrame, composed: DataFrame) -> DataFrame:
    """Marks that each composed paper lacks in its two parts."""
    of = lambda n: F.coalesce(F.sum(F.when(F.col("part") == n, F.col("marks"))), F.lit(0.0))
    rows = requests.select("request_id").join(composed.hint("merge"), "request_id", "left").groupBy("request_id").agg(of(1).alias("choice"), of(2).alias("written"))
    return rows.withColumns({"missing_choice": MCQ_PART - F.col("choice"), "missing_written": WRITTEN_PART - F.col("written")})


def next_cutoff(sittings: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """For each learner the registration that closes next: that of the sitting they chose if it is still ahead, else the nearest of all. ``sittings`` (sitting, cutoff) is a
    dimension of few rows that all learners see; ``chosen`` has learner_id, sitting."""
    ahead = sittings.filter(F.col("cutoff") > now)
    nearest = ahead.agg(F.min(F.struct("cutoff", "sitting")).alias("near"))
    own = ahead.select("sitting", F.struct("cutoff", "sitting").alias("own"))
    rows = chosen.join(own, "sitting", "left").withColumn("_one", F.lit(1)).join(F.broadcast(nearest.withColumn("_one", F.lit(1))), "_one")  # one row
    found = F.coalesce("own", "near")
    return rows.select("learner_id", found["sitting"].alias("sitting"), found["cutoff"].alias("cutoff"))


def pass_rates(rates: DataFrame) -> DataFrame:
    """Range of the pass rate of each scheme, the latest one, and how many sittings have counts. Figures of different schemes don't compare."""
    return rates.groupBy("scheme").agg(F.min("pct").alias("lo"), F.max("pct").alias("hi"), F.max_by("pct", "ord").alias("latest"), F.count("*").alias("sittings"), F.count("appeared").alias("with_counts"))


def paper_hub(papers: DataFrame, chapters: DataFrame, weights: DataFrame, resources: DataFrame) -> DataFrame:
    """A row per paper: chapters, weight groups with their label, links, those behind a login, and the oldest check."""
    c = chapters.groupBy("paper").agg(F.count("*").alias("chapters"))
    w = weights.groupBy("paper").agg(F.count("*").alias("groups"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    r = resources.groupBy("paper").agg(F.count("*").alias("links"), F.count_if("requires_login").alias("behind_login"), F.min("last_checked").alias("oldest_check"))
    out = papers.join(c, "paper", "left").join(w, "paper", "left").join(r, "paper", "left")
    return out.fillna(0, ["chapters", "groups", "links", "behind_login"])


def amendments_of(amendments: DataFrame, papers: DataFrame) -> DataFrame:
    """Changes in the law of the given papers, a row for each chapter affected, or one without any."""
    return amendments.join(papers, "paper", "left_semi").select("amendment_id", "paper", "applies_from", F.explode_outer("affected").alias("chapter"))


def unverified(sittings: DataFrame) -> DataFrame:
    """Facts of sittings that still have something to verify, with how much."""
    return sittings.filter("NOT verified").select("sitting", F.size("verify").alias("open"))


def upto_cutoff(changes: DataFrame, sittings: DataFrame, days: int = 366) -> DataFrame:
    """Which changes count for which sitting: those that apply up to its cut-off. A sitting's range begins with the first change there is; changes and ranges meet
    in buckets of so many days."""
    first = F.broadcast(changes.agg(F.unix_date(F.min("applies_from")).alias("_first")))  # one row
    found = within(changes, sittings.join(first), F.unix_date("applies_from"), F.col("_first"), F.unix_date("cutoff"), days)
    return found.select("sitting", "amendment_id")
