"""Language identification by compression: the language whose dictionary makes the text smallest.

A dictionary holds the words, in lower case, of a bounded sample of passages of labelled documents. A document is rejected

* if the winner's margin is narrow: the runner-up's size is larger by a share below ``NARROW``, ties among them; or
* if the winner shortens it too little: more bits a letter than nearly all labelled documents of that length take under
  their language's dictionary, as is the case for a language that none of the dictionaries holds.

The second limit is calibrated, by octaves of length, on a second bounded sample of labelled documents, read whole.

A null text, or one without a letter, is ``und`` with score 0 and is rejected. Of languages that tie the first by name is
predicted, and the row is rejected. Rows that occur twice are judged alike. Texts of any length are compressed whole.
Without any labelled row every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, give_back, small_batches, table, take_over
from .compression import Sizer, dictionary, drawn, halves, passages

SAMPLE_ROWS = 256  # labelled documents per language that give a passage each, at most about so many
CALIBRATION_ROWS = 400  # labelled documents per language that are judged whole to calibrate, at most about so many
PASSAGE_CHARS = 512
DICTIONARY_BYTES = 131_072
BITS_PER_NAT = 24.0  # saved bits that multiply the odds by e
NARROW = 0.004
SPARE = 1.05  # times the bits that all but one of ``TAIL`` calibrating documents of that length take
TAIL, LEAST_ROWS = 200, 40
OTHERS = re.compile(r"[\W\d_]+")


@dataclass
class Model:
    """Dictionaries by language, and the most bits a letter by octave of letters (-1 where it isn't known)."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    most_bits: list[float] = field(default_factory=list)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """The model of rows with a language; the bounds above are the samples, drawn by a hash of the key. A language without
    letters in its sample isn't learnt."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("_words"), F.col(lang).alias("_lang"))
    counts = {r[0]: r[1] for r in rows.groupBy("_lang").count().collect()}
    told, rest = halves(rows, "_id")
    found: dict[str, list[str]] = {}
    for r in sorted(passages(drawn(told, "_lang", "_id", counts, 2 * SAMPLE_ROWS), "_lang", "_words", "_id", PASSAGE_CHARS).collect()):
        found.setdefault(r[0], []).append(letters(r[2]))
    model = Model({k: d for k, p in sorted(found.items()) if (d := dictionary(p, DICTIONARY_BYTES)).strip()})
    if model.dictionaries:
        model.most_bits = _calibrated(drawn(rest, "_lang", "_id", counts, 2 * CALIBRATION_ROWS), model)
    return model


def _calibrated(rows: DataFrame, model: Model) -> list[float]:
    judged = measured(rows, model, "_words").filter(F.col("_found.lang_pred") == F.col("_lang"))
    octaves: dict[int, list[float]] = {}
    for octave, bits in judged.select("_found.octave", "_found.bits").collect():
        octaves.setdefault(octave, []).append(bits)
    out = []
    for octave in range(max(octaves, default=-1) + 1):
        found = sorted(octaves.get(octave, []))
        out.append(found[-1 - len(found) // TAIL] * SPARE if len(found) >= LEAST_ROWS else -1.0)
    return out


def letters(text: str) -> str:
    """Words in lower case with single spaces between: what tells languages apart."""
    return OTHERS.sub(" ", text.lower())


def classify(text: str | None, languages: list[str], sizer: Sizer) -> tuple[str, float, float, float, int]:
    """Language, its share, its margin over the runner-up as a share of that one's size, its bits a letter, octave of letters."""
    count = sum(map(str.isalpha, text)) if text and languages else 0
    if not count:
        return "und", 0.0, 0.0, 0.0, -1
    found = np.array(sizer.sizes(letters(text).encode("utf-8", "replace")), float)
    best = int(found.argmin())
    share = np.exp(8 * (found[best] - found) / BITS_PER_NAT)
    second = float(np.delete(found, best).min()) if len(found) > 1 else found[best]
    margin = (second - found[best]) / second if len(found) > 1 and second else float(len(found) == 1)
    return languages[best], float(1 / share.sum()), float(margin), float(8 * found[best] / count), count.bit_length() - 1


FOUND = "struct<lang_pred: string, score: double, margin: double, bits: double, octave: int>"


def measured(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """``docs`` with ``_found``, what ``classify`` gives."""
    languages, dictionaries = list(model.dictionaries), list(model.dictionaries.values())

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        take_over("language ID")
        sizer = Sizer(dictionaries)
        for texts in batches:
            yield pd.DataFrame([classify(x if isinstance(x, str) else None, languages, sizer) for x in texts], columns=["lang_pred", "score", "margin", "bits", "octave"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.withColumn("_found", found(text))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of the odds), ``margin`` and ``rejected``; columns of these names (and ``_found``)
    are replaced."""
    docs = docs.drop("lang_pred", "score", "margin", "rejected", "_found")
    most = F.lit(-1.0)
    for octave, bits in enumerate(model.most_bits):
        if bits > 0:
            most = F.when(F.col("_found.octave") == octave, bits).otherwise(most)
    unlike = (most > 0) & (F.col("_found.bits") > most)
    rejected = (F.col("_found.lang_pred") == "und") | (F.col("_found.margin") < NARROW) | unlike
    return measured(docs, model, text).select(*docs.columns, "_found.lang_pred", "_found.score", "_found.margin", rejected.alias("rejected"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the rows that aren't held out. Null texts are ``und``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(fold("doc_id", 4) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
