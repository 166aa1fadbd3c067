"""Stateful processors: card schedules and capped notebooks that go on from a batch snapshot, and event-time timers for the trailing week and for returns.

Cards and notebooks take each key's events in the order of time and id within a micro-batch; an event behind one that was taken already (among them every repeated delivery,
and every event that the snapshot holds) changes nothing: it is left to the batch form. A stream that starts from the batch form of all
earlier events ends equal to the batch form of all events.

The trailing week and returns wait with each answer until the watermark has passed it, so that answers come in order however they arrive within the
watermark, and repeated ones are told by their ids; what they emit is final.

The session needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider: call ``use_rocksdb`` before the stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.learner import WEEK_MS
from ..operators.state import FIRST_EASE, KEPT_MISTAKES, cap_at, mistake, rated
from .cards import CARDS, in_order

NOTEBOOK = "learner_id long, question_id long, open boolean, first_at timestamp, last_at timestamp, reps int, sure boolean, seen long, nth long"
WEEKS = "learner_id long, at timestamp, attempted long, correct long"
RETURNS = "learner_id long, event_id long, at timestamp, before timestamp"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def table_of(rows: list[tuple], schema: str) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(",")])


def instant(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


class Cards(StatefulProcessor):
    """One card: interval, ease, count, and the time and id of its last rating."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.card = handle.getValueState("card", "ivl double, ease double, reps int, us long, event_id long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        for r in initialState.itertuples(index=False):
            self.card.update((float(r.ivl), float(r.ease), int(r.reps), int(r.us), int(r.event_id)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ivl, ease, reps, last, last_id = self.card.get() or (0.0, FIRST_EASE, 0, -1, -1)
        rating = None
        for us, event_id, rating_, cap in in_order(rows, ["rating", "cap"]):
            if (us, event_id) > (last, last_id):
                (ivl, ease), reps, rating, last, last_id = rated(ivl, ease, rating_, cap), reps + 1, rating_, int(us), int(event_id)
        if rating:
            self.card.update((ivl, ease, reps, last, last_id))
            due = pd.Timestamp(round(last // 1_000_000 + (600 if rating == "again" else ivl * 86_400)), unit="s")
            yield from table_of([(*key, round(ivl, 6), round(ease, 6), reps, due)], CARDS)

    def close(self) -> None:
        pass


class Notebook(StatefulProcessor):
    """A learner's open mistakes by question, at most so many: a new one pushes out the one entered first."""

    def __init__(self, most: int = KEPT_MISTAKES):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "question_id long", "first_us long, last_us long, reps int, sure int, entered long")
        self.last = handle.getValueState("last", "us long, event_id long, entered long, size int, nth long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        size = entered = 0
        for r in initialState.itertuples(index=False):
            if not pd.isna(r.question_id):
                self.entries.updateValue((int(r.question_id),), (int(r.first_us), int(r.last_us), int(r.reps), -1 if pd.isna(r.sure) else int(r.sure), int(r.entered)))
                size, entered = size + 1, max(entered, int(r.entered) + 1)
            us, event_id, *_ = self.last.get() or (-1, -1)
            self.last.update((max(us, int(r.us)), int(r.event_id), entered, size, 0))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, last_id, entered, size, nth = self.last.get() or (-1, -1, 0, 0, 0)
        out = []
        for us, event_id, question, correct, sure in in_order(rows, ["question_id", "correct", "sure"]):
            if (us, event_id) <= (last, last_id):
                continue
            last, last_id, question = int(us), int(event_id), int(question)
            held = self.entries.getValue((question,)) if self.entries.containsKey((question,)) else None
            entry = (*held[:3], None if held[3] < 0 else bool(held[3])) if held else None
            found = mistake(entry, last, bool(correct), None if sure is None or pd.isna(sure) else bool(sure))
            if found is None and held:
                self.entries.removeKey((question,))
                size -= 1
            elif found:
                number = held[4] if held else entered
                self.entries.updateValue((question,), (*found[:3], -1 if found[3] is None else int(found[3]), number))
                if not held:
                    size, entered = size + 1, entered + 1
            if found or held:
                nth += 1
                out.append(self._row(key, question, found, last, nth))
            if size > self.most:
                (oldest,), _ = min(self.entries.iterator(), key=lambda e: e[1][4])
                self.entries.removeKey((oldest,))
                size, nth = size - 1, nth + 1
                out.append(self._row(key, oldest, None, last, nth))
        self.last.update((last, last_id, entered, size, nth))
        yield from table_of(out, NOTEBOOK)

    @staticmethod
    def _row(key: tuple, question: int, entry: tuple | None, seen: int, nth: int) -> tuple:
        first, at, reps, sure = entry or (None, None, None, None)
        return (*key, question, entry is not None, instant(first) if entry else None, instant(at) if entry else None, reps, sure, seen, nth)

    def close(self) -> None:
        pass


class Waiting(StatefulProcessor):
    """Answers of a learner by time and id, each with a timer at its own moment."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "us long, event_id long", "correct int")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        pass

    def moments(self, us: int) -> list[int]:
        """Milliseconds at which an answer matters."""
        return [-(-us // 1_000)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for us, event_id, correct in in_order(rows, ["correct"]):
            self.answers.updateValue((int(us), int(event_id)), (int(bool(correct)),))
            for ms in self.moments(int(us)):
                self.handle.registerTimer(ms)
        yield from ()

    def close(self) -> None:
        pass


class Week(Waiting):
    """The trailing seven days: one timer when an answer comes in, one when it leaves."""

    def moments(self, us: int) -> list[int]:
        return [us // 1_000, us // 1_000 + WEEK_MS + 1]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        inside = right = 0
        for (us, event_id), (correct,) in list(self.answers.iterator()):
            if us // 1_000 + WEEK_MS < now:
                self.answers.removeKey((us, event_id))
            elif us // 1_000 <= now:
                inside, right = inside + 1, right + correct
        yield from table_of([(*key, instant(now * 1_000), inside, right)], WEEKS)


class Returns(Waiting):
    """The first answer after so many days without one."""

    def __init__(self, days: int = 4):
        self.gap = days * 86_400_000_000

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "us long")

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs() * 1_000, []
        for us, event_id in sorted(k for k, _ in self.answers.iterator() if k[0] <= now):
            before = self.before.get()
            if before and us - before[0] >= self.gap:
                out.append((*key, event_id, instant(us), instant(before[0])))
            self.before.update((us,))
            self.answers.removeKey((us, event_id))
        yield from table_of(out, RETURNS)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))


def card_stream(reviews: DataFrame, snapshot: DataFrame | None = None, exam: str | None = None) -> DataFrame:
    """Cards that new ratings changed; write in update mode. ``snapshot`` is ``state.card_snapshot`` of all earlier ratings."""
    rows = _timed(reviews).withColumn("cap", cap_at(F.col("at"), exam)).groupBy("learner_id", "card_id")
    start = snapshot.groupBy("learner_id", "card_id") if snapshot is not None else None
    return rows.transformWithStateInPandas(Cards(), CARDS, "update", "none", start)


def notebook_stream(answers: DataFrame, snapshot: DataFrame | None = None, most: int = KEPT_MISTAKES) -> DataFrame:
    """Mistakes that new answers opened, changed, cleared or pushed out (``open`` is false then), a learner's in the order of ``nth``; write in update
    mode. ``snapshot`` is ``state.notebook_snapshot`` of all earlier answers."""
    rows = _timed(answers.filter(F.col("question_id").isNotNull())).groupBy("learner_id")
    start = snapshot.groupBy("learner_id") if snapshot is not None else None
    return rows.transformWithStateInPandas(Notebook(most), NOTEBOOK, "update", "none", start)


def week_stream(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows of ``learner.week_changes``, each as soon as the watermark has passed its moment; write in append mode."""
    rows = _timed(answers.withWatermark("at", late)).groupBy("learner_id")
    return rows.transformWithStateInPandas(Week(), WEEKS, "append", "eventTime")


def return_stream(answers: DataFrame, days: int = 4, late: str = "1 day") -> DataFrame:
    """Rows of ``learner.returns_after_gap``, each as soon as the watermark has passed it; write in append mode."""
    rows = _timed(answers.withWatermark("at", late)).groupBy("learner_id")
    return rows.transformWithStateInPandas(Returns(days), RETURNS, "append", "eventTime")
