"""Replay of per-key histories in the order of time and event: spaced-repetition cards, and the notebook that keeps so many mistakes.

A history passes by as sorted rows and leaves one state, so a key of any number of events takes no more memory than any other; a card's long
history is cut into blocks, each of which leaves the map from the state before it to the state after it. The rules are plain functions, which
the streams share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import BLOCK_ROWS, in_blocks, meet

DAY = 86_400.0
LEAST_EASE, FIRST_EASE, LONGEST = 1.3, 2.5, 365.0
KEPT_MISTAKES = 200


def interval_cap(days_left: Column) -> Column:
    """Longest interval in days: the days left to the exam, in the last thirty a quarter of them but two at least; 365 without or
    after an exam."""
    near = F.greatest(F.lit(2.0), days_left / 4.0)
    return F.when(days_left.isNull() | (days_left <= 0), LONGEST).when(days_left <= 30, F.least(near, days_left.cast("double"))).otherwise(F.least(F.lit(LONGEST), days_left.cast("double")))


def cap_at(at: Column, exam: str | None) -> Column:
    """Cap of a rating at its own time."""
    if not exam:
        return F.lit(LONGEST)
    return interval_cap(F.ceil((F.unix_timestamp(F.lit(exam).cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / DAY))


def rated(ivl: float, ease: float, rating: str, cap: float = LONGEST) -> tuple[float, float]:
    """Interval and ease of a card after one more rating. What is due again at once isn't capped."""
    if rating == "again":
        return 0.0, max(LEAST_EASE, ease - 0.2)
    if rating == "hard":
        return min(cap, max(1.0, ivl * 1.2)), max(LEAST_EASE, ease - 0.15)
    if rating == "good":
        return min(cap, ivl * ease if ivl else 1.0), ease
    ease += 0.15
    return min(cap, ivl * ease * 1.3 if ivl else 4.0), ease


def ordered_fold(rows: DataFrame, key: list[str], order: list[str], schema: str, start: Callable[[], Any], step: Callable[..., Any], finish: Callable[[tuple, Any], list[tuple]]) -> DataFrame:
    """Fold of each key's rows in order. ``step(state, *others)`` gives the next state from the columns that follow the key, ``finish(key, state)`` the rows of
    ``schema`` that are left. Keys are shuffled once and sorted within their partitions; only the state of the key that passes by is held."""
    columns = [*key, *(c for c in rows.columns if c not in key)]
    names = [part.strip().split(" ")[0].strip("`") for part in schema.split(",")]
    width = len(key)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, done = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:width] != held:
                    if held is not None:
                        done += finish(held, state)
                    held, state = row[:width], start()
                state = step(state, *row[width:])
            if done:
                yield _table(done)
                done = []
        if held is not None and (last := finish(held, state)):
            yield _table(last)

    def _table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found, strict=True)), strict=True)), schema=wanted)

    ordered = rows.select(*columns).repartition(*key).sortWithinPartitions(*key, *order)
    wanted = _arrow(rows.sparkSession.createDataFrame([], schema))
    return ordered.mapInArrow(fold, schema)


def _arrow(empty: DataFrame) -> pa.Schema:
    return empty.toArrow().schema


Ease = tuple[float, float]  # (c, d): an ease e becomes max(c, e + d)
Interval = tuple[float, float, float, float]  # (zero, low, high, g): 0 becomes zero, a positive x becomes min(high, max(low, g * x))
SAME_EASE: Ease = (float("-inf"), 0.0)
SAME_INTERVAL: Interval = (0.0, 0.0, float("inf"), 1.0)


def rate_ease(ease: Ease, rating: str) -> Ease:
    """The map of eases after one more rating."""
    least, step = {"again": (LEAST_EASE, -0.2), "hard": (LEAST_EASE, -0.15), "good": SAME_EASE}.get(rating, (float("-inf"), 0.15))
    return max(least, ease[0] + step), ease[1] + step


def rate_interval(interval: Interval, ease: float, rating: str, cap: float) -> Interval:
    """The map of intervals after one more rating of a card that has this ease before it."""
    zero, low, high, g = interval
    zero = rated(zero, ease, rating, cap)[0]
    if rating == "again" or high == 0:  # a positive interval is 0 by now, or was, and is what a single card's would be
        now = rated(0.0, ease, rating, cap)[0]
        return zero, now, now, 0.0
    least, times = {"hard": (1.0, 1.2), "good": (0.0, ease)}.get(rating, (0.0, (ease + 0.15) * 1.3))
    return zero, max(least, times * low), min(cap, max(least, times * high)), times * g


def card_snapshot(reviews: DataFrame, exam: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each learner's card after all its ratings: learner_id, card_id, ivl, ease, reps, and of the last rating us (its time), event_id and rating. The
    cap counts from the time of the rating.

    Ratings map the ease before them to a bounded sum, and given the ease the interval to a clamped product; both kinds of maps compose. So each block
    of a card's ratings passes by in order and leaves its map, and a card's maps give its state: a card of any number of ratings is the work of many tasks."""
    key, order = ["learner_id", "card_id"], ["us", "event_id"]
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = reviews.select(*key, micros.alias("us"), "event_id", "rating", cap_at(F.col("at"), exam).alias("cap"))
    cut, any_cut = in_blocks(rows, key, order, block_rows)
    first = F.lit(FIRST_EASE)
    if any_cut:
        eases = ordered_fold(cut.filter("_block IS NOT NULL").select(*key, "_block", *order, "rating"), [*key, "_block"], order, "learner_id long, card_id long, _block int, c double, d double", lambda: SAME_EASE, lambda ease, us, event, rating: rate_ease(ease, rating), lambda k, ease: [(*k, *ease)])
        listed = eases.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_block", "c", "d"))).alias("maps"))
        upto = lambda i: F.aggregate(F.slice("maps", F.lit(1), i), first, lambda e, m: F.greatest(m["c"], e + m["d"]))
        before = listed.select(*key, F.explode(F.transform("maps", lambda m, i: F.struct(m["_block"].alias("_block"), upto(i).alias("before")))).alias("m")).select(*key, "m.*")
        cut = meet(cut, before, [*key, "_block"]).withColumn("before", F.coalesce("before", first))
    else:
        cut = cut.withColumn("before", first)

    def step(state: tuple | None, us: int, event_id: int, rating: str, cap: float, before: float) -> tuple:
        interval, ease, reps, *_ = state or (SAME_INTERVAL, before, 0)
        return rate_interval(interval, ease, rating, cap), rated(0.0, ease, rating)[1], reps + 1, us, event_id, rating

    shape = "learner_id long, card_id long, _block int, zero double, low double, high double, g double, ease double, reps int, us long, event_id long, rating string"
    maps = ordered_fold(cut.select(*key, "_block", *order, "rating", "cap", "before"), [*key, "_block"], order, shape, lambda: None, step, lambda k, s: [(*k, *s[0], *s[1:])])
    done = maps.withColumn("ivl", F.col("zero"))
    if any_cut:
        listed = maps.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_block", "zero", "low", "high", "g", "ease", "reps", "us", "event_id", "rating"))).alias("maps"))
        ivl = F.aggregate("maps", F.lit(0.0), lambda x, m: F.when(x == 0, m["zero"]).otherwise(F.least(m["high"], F.greatest(m["low"], m["g"] * x))))
        reps = F.aggregate("maps", F.lit(0), lambda n, m: n + m["reps"])
        done = listed.select(*key, ivl.alias("ivl"), reps.alias("reps"), F.element_at("maps", -1).alias("last")).select(*key, "ivl", "last.ease", "reps", "last.us", "last.event_id", "last.rating")
    return done.select(*key, "ivl", "ease", "reps", "us", "event_id", "rating")


def card_state(reviews: DataFrame, exam: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Interval, ease, count and due time of each learner's card after all its ratings."""
    done = card_snapshot(reviews, exam, block_rows)
    wait = F.when(F.col("rating") == "again", 600.0).otherwise(F.col("ivl") * DAY)
    return done.select("learner_id", "card_id", F.round("ivl", 6).alias("ivl"), F.round("ease", 6).alias("ease"), "reps", F.timestamp_seconds(F.round(F.floor(F.col("us") / 1e6) + wait)).alias("due"))


def mistake(entry: tuple | None, us: int, correct: bool, sure: bool | None) -> tuple | None:
    """A notebook's entry (first_us, last_us, reps, sure) after one more answer to its question; None is no entry."""
    if correct:
        return None
    if entry is None:
        return us, us, 0, sure
    return entry[0], us, entry[2] + 1, entry[3] if sure is None else sure


def notebook_snapshot(answers: DataFrame, most: int = KEPT_MISTAKES) -> DataFrame:
    """Each learner's capped notebook with what a stream needs to go on from it: learner_id, question_id, first_us, last_us, reps, sure, ``entered`` (the
    entry's number), and of the learner's last answer ``us`` and ``event_id``. A learner without open mistakes has one row, of null question."""

    def step(state: tuple, us: int, event_id: int, question: int, correct: bool, sure: bool | None) -> tuple:
        entries, numbers, entered, *_ = state
        found = mistake(entries.get(question), us, correct, sure)
        if found is None:
            entries.pop(question, None)
            numbers.pop(question, None)
        elif question in entries:
            entries[question] = found
        else:
            entries[question], numbers[question], entered = found, entered, entered + 1
            if len(entries) > most:
                oldest = next(iter(entries))
                del entries[oldest], numbers[oldest]
        return entries, numbers, entered, us, event_id

    def finish(key: tuple, state: tuple) -> list[tuple]:
        entries, numbers, _, us, event_id = state
        return [(*key, q, *v, numbers[q], us, event_id) for q, v in entries.items()] or [(*key, *[None] * 6, us, event_id)]

    rows = answers.filter(F.col("question_id").isNotNull()).select("learner_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "event_id", "question_id", "correct", "sure")
    shape = "learner_id long, question_id long, first_us long, last_us long, reps int, sure boolean, entered long, us long, event_id long"
    return ordered_fold(rows, ["learner_id"], ["us", "event_id"], shape, lambda: ({}, {}, 0, None, None), step, finish)


def capped_notebook(answers: DataFrame, most: int = KEPT_MISTAKES) -> DataFrame:
    """Open mistakes of each learner when a notebook holds ``most`` of them: a new one pushes out the one entered first, for good. A right answer clears a
    mistake; a wrong one to a question in the notebook counts again."""
    done = notebook_snapshot(answers, most).filter(F.col("question_id").isNotNull())
    return done.select("learner_id", "question_id", F.timestamp_micros("first_us").alias("first_at"), F.timestamp_micros("last_us").alias("last_at"), "reps", "sure")
