"""Quality by compression: dictionaries of good and of bad labelled text.

The difference of the two compressed sizes, over their sum, is calibrated to a probability by a logistic
curve that is fitted to a second bounded sample of labelled rows. A text of one word over and over is small under
any dictionary, so the share of its bytes that the good dictionary leaves joins the curve as a second term.

Null and empty texts score as the fitted curve's value of a text that neither dictionary shortens. Rows that occur twice are
judged alike. Without labels of both kinds every score is the share of good labels (1 without any); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, give_back, small_batches, table, take_over
from .compression import Sizer, dictionary, drawn, halves, passages

SAMPLE_ROWS = 250  # labelled documents of each kind that give a passage each, at most about so many
CALIBRATION_ROWS = 600  # labelled documents of each kind that are judged whole for the curve, at most about so many
PASSAGE_CHARS = 4_000
DICTIONARY_BYTES = 1 << 22  # more than the passages take, so that none is cut
ACCEPT = 0.3


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])
    constant: float = 1.0


def features(text: str | None, sizer: Sizer) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    a, b = sizer.sizes(raw)
    difference = (b - a) / (a + b) if a + b else 0.0
    left = min(1.0, a / len(raw)) if raw else 0.5
    return [1.0, difference * 10, difference * min(1.0, len(raw) / 400) * 10, left * 4]


def _features(text: str, dictionaries: list[bytes]) -> Column:
    @F.pandas_udf("array<double>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        take_over("quality")
        sizer = Sizer(dictionaries)
        for texts in batches:
            yield texts.map(lambda x: features(x, sizer))

    return found(text)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> Model:
    """Dictionaries and curve from labels drawn by a hash of their key, so few that they are broadcast and no text is
    shuffled to meet them; the bounds above are the sample."""
    small_batches(docs.sparkSession)
    labels = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    counts = {r[0]: r[1] for r in labels.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return Model(constant=1.0 if 1 in counts or not counts else 0.0)
    told, rest = halves(labels, "_key")
    texts = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_words"))
    told, rest = (texts.join(F.broadcast(drawn(part, "_label", "_key", counts, 2 * rows)), F.col("_id") == F.col("_key")) for part, rows in ((told, SAMPLE_ROWS), (rest, CALIBRATION_ROWS)))
    kinds: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(passages(told, "_label", "_words", "_id", PASSAGE_CHARS).collect()):
        kinds[r[0]].append(r[2])
    good, bad = (dictionary(kinds[k], DICTIONARY_BYTES) for k in (1, 0))
    judged = sorted(rest.select("_label", _features("_words", [good, bad]).alias("x")).collect()) if good and bad else []
    if not judged:
        return Model(constant=counts[1] / (counts[0] + counts[1]))
    x = np.array([r[1] for r in judged])
    y = np.array([r[0] for r in judged], float)
    prior = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, len(y) - y.sum()))
    return Model(good, bad, list(_logistic(x, y, prior / prior.mean())))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's steps, with a ridge that keeps the curve finite where the kinds part completely."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_one(text: str | None, model: Model, sizer: Sizer) -> float:
    if not model.good:
        return model.constant
    return float(1 / (1 + np.exp(-np.clip(np.dot(features(text, sizer), model.weights), -30, 30))))


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``ACCEPT`` on); columns of these names are replaced."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        take_over("quality")
        sizer = Sizer([model.good, model.bad] if model.good else [])
        for texts in batches:
            yield pd.Series([score_one(x if isinstance(x, str) else None, model, sizer) for x in texts], dtype=float)
        give_back()

    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    rows = docs.withColumn("score", scored(text))
    return rows.withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from labels of the rows that aren't held out. Null texts score as empty ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return judge(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
