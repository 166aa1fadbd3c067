"""Streaming forms of the stateful operators. With all events within the watermark each ends equal to its batch form.

Events carry an ``event_id``: repeated deliveries are dropped within the watermark. An event that comes behind one of its key that was taken already
changes nothing here: it is what ``late_events`` finds, and the batch form, which is the truth, takes it in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import FIRST_EASE, cap_at, rated

CARD_STATE = "ivl double, ease double, reps int, us long, event_id long"
CARDS = "learner_id long, card_id long, ivl double, ease double, reps int, due timestamp"
MISTAKE_STATE = "first_us long, last_us long, reps int, sure int, us long, event_id long"
MISTAKES = "learner_id long, question_id long, open boolean, first_at timestamp, last_at timestamp, reps int, sure boolean, seen long"
LEVEL_STATE = "seen int, day long, right int, days int, proficient long, us long, event_id long"
LEVELS = "learner_id long, topic string, level int, proficient_days int, seen long"
DAY_US = 86_400_000_000


def in_order(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """Events of one key in a micro-batch by time and id; the first two columns are those."""
    rows = [row for b in batches for row in b[["us", "event_id", *columns]].itertuples(index=False)]
    return sorted(rows, key=lambda e: (e[0], e[1]))


def _fresh(events: DataFrame, late: str) -> DataFrame:
    found = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    return found.withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))


def _card(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ivl, ease, reps, last, last_id = state.get if state.exists else (0.0, FIRST_EASE, 0, -1, -1)
    rating = None
    for us, event_id, rating_, cap in in_order(batches, ["rating", "cap"]):
        if (us, event_id) <= (last, last_id):
            continue
        (ivl, ease), reps, rating, last, last_id = rated(ivl, ease, rating_, cap), reps + 1, rating_, int(us), int(event_id)
    state.update((ivl, ease, reps, last, last_id))
    if rating:
        wait = 600 if rating == "again" else ivl * 86_400
        due = pd.Timestamp(round(last // 1_000_000 + wait), unit="s")
        yield pd.DataFrame([(*key, round(ivl, 6), round(ease, 6), reps, due)], columns=["learner_id", "card_id", "ivl", "ease", "reps", "due"])


def card_stream(reviews: DataFrame, late: str = "1 day", exam: str | None = None) -> DataFrame:
    """Cards that new ratings changed, with their state; write in update mode. ``at`` is a timestamp."""
    fresh = _fresh(reviews, late).withColumn("cap", cap_at(F.col("at"), exam))
    return fresh.groupBy("learner_id", "card_id").applyInPandasWithState(_card, CARDS, CARD_STATE, "update", GroupStateTimeout.NoTimeout)


def _mistake(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    first, at, reps, sure, last, last_id = state.get if state.exists else (-1, -1, -1, -1, -1, -1)
    for us, event_id, correct, tag in in_order(batches, ["correct", "sure"]):
        if (us, event_id) <= (last, last_id):
            continue
        last, last_id = int(us), int(event_id)
        if correct:
            first, at, reps, sure = -1, -1, -1, -1
            continue
        first, at, reps = (last if reps < 0 else first), last, reps + 1
        sure = sure if tag is None or pd.isna(tag) else int(tag)
    state.update((first, at, reps, sure, last, last_id))
    when = lambda us: pd.Timestamp(us, unit="us") if reps >= 0 else None
    row = (*key, reps >= 0, when(first), when(at), reps if reps >= 0 else None, bool(sure) if sure >= 0 else None, last)
    yield pd.DataFrame([row], columns=["learner_id", "question_id", "open", "first_at", "last_at", "reps", "sure", "seen"])


def notebook_stream(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """Mistakes that new answers opened, changed or cleared (``open`` is false then); ``seen`` is the time of the last answer in microseconds."""
    return _fresh(answers, late).groupBy("learner_id", "question_id").applyInPandasWithState(_mistake, MISTAKES, MISTAKE_STATE, "update", GroupStateTimeout.NoTimeout)


def _level(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, day, right, days, proficient, last, last_id = state.get if state.exists else (0, -1, 0, 0, -1, -1, -1)
    for us, event_id, correct in in_order(batches, ["correct"]):
        if (us, event_id) <= (last, last_id):
            continue
        last, last_id = int(us), int(event_id)
        if last // DAY_US != day:
            day, right = last // DAY_US, 0
        if not correct:
            continue
        right += 1
        seen = max(seen, 2 if right >= 3 else 1)
        if right >= 3 and proficient != day:
            days, proficient = days + 1, day
    state.update((seen, day, right, days, proficient, last, last_id))
    yield pd.DataFrame([(*key, 3 if days >= 3 else seen, days, last)], columns=["learner_id", "topic", "level", "proficient_days", "seen"])


def mastery_stream(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """Mastery of each learner and topic as answers come; a session is a day in UTC, and levels never fall."""
    return _fresh(answers, late).groupBy("learner_id", "topic").applyInPandasWithState(_level, LEVELS, LEVEL_STATE, "update", GroupStateTimeout.NoTimeout)


def late_events(events: DataFrame, late: str, key: list[str]) -> DataFrame:
    """Of stored events (with ``taken_at``, when each came) those that came behind the watermark, which all that came before it had set: what a stream left to the batch form.
    ``key`` names what else to keep."""
    from pyspark.sql import Window

    # days bound the sort: the highest time of all earlier days is one row each
    day = F.to_date("taken_at")
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    tops = events.groupBy(day.alias("_day")).agg(F.max("at").alias("_top")).select("_day", F.max("_top").over(before).alias("_earlier"))
    within = Window.partitionBy("_day").orderBy("taken_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_day", day).withColumn("_inday", F.max("at").over(within)).join(F.broadcast(tops), "_day")
    mark = F.greatest("_earlier", "_inday") - F.expr(f"INTERVAL {late}")
    return rows.filter(F.col("at") < mark).select(*key, "event_id", "at", "taken_at")


def week_stream(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """Answers of each learner in windows of seven days that begin daily."""
    windows = answers.withWatermark("at", late).groupBy("learner_id", F.window("at", "7 days", "1 day"))
    return windows.agg(F.count("*").alias("attempted"), F.count_if("correct").alias("correct"))


def activity_sessions(answers: DataFrame, gap: str = "4 days", late: str = "1 day") -> DataFrame:
    """Spans of activity without a gap: a learner's second and later ones are returns."""
    spans = answers.withWatermark("at", late).groupBy("learner_id", F.session_window("at", gap).alias("span"))
    return spans.agg(F.count("*").alias("answers"))
