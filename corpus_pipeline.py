"""Corpus pipeline: language, quality, exact copies, near copies, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back as the next stage's documents. All stages but the last return the columns of ``documents``, whatever their
names. Null and empty texts have no language and go in the first stage. Texts of any length are judged whole; an empty table
stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacusloom.llm import exact_dedup, language_id, near_dedup, packing, quality
from abacusloom.llm.common import fold, materialise, maybe_among, table


def held(docs: DataFrame) -> DataFrame:
    """Documents as ``row``, beside the columns that operators read: no column of theirs can clash with a document's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no letters, a narrow margin between languages, or like none of them. A row that
    occurs twice is judged twice alike."""
    model = language_id.learn(docs.filter(fold("doc_id", 4) != 2))
    return language_id.identify(held(docs), model).filter("NOT rejected").select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 0 go. A row that occurs twice is judged twice alike."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return quality.judge(held(docs), model).filter("predicted = 1").select("row.*")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, one of those that have it. Hashes are computed once, into a table."""
    keyed = materialise(exact_dedup.with_keys(held(docs)).drop("text"))
    return exact_dedup.dedup_keyed(keyed).filter("kept").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays, the first by a hash of id and text: rows, not ids, are told apart."""
    rows = held(docs).withColumn("place", F.xxhash64("doc_id", "text"))
    gone = materialise(near_dedup.near_classes(rows, key="place").filter("NOT kept").select("place").distinct())
    rows = maybe_among(rows.drop("text", "doc_id"), "place", gone, "doubtful")
    stay = rows.filter("NOT doubtful").select("row.*")
    return stay.unionByName(rows.filter("doubtful").join(gone, "place", "left_anti").select("row.*"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence. Every row that is left is packed, whole."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("quality", good), ("exact dedup", unique), ("near dedup", distinct), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
