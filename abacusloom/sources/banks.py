"""Question banks, notes and backups: nested JSON and text in, tables and exports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTION = "struct<key:string,text:string,explanation:string>"
SUB = f"struct<id:string,topic:string,type:string,numerical:boolean,stem:string,options:array<{OPTION}>,correct:string>"
QUESTION = (
    f"struct<id:string,topic:string,type:string,numerical:boolean,stem:string,`case`:string,options:array<{OPTION}>,correct:string,"
    f"applicableAttempts:array<string>,lawAsOnDate:string,marks:double,skeleton:array<struct<point:string,marks:double,citation:string>>,questions:array<{SUB}>>"
)
BANK = f"level string, paper string, paperSlug string, chapterSlug string, chapter string, questions array<{QUESTION}>, _corrupt string"
STATE_KEYS = ("history", "mistakes", "mastery", "cards", "mocks")


def read_banks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Banks below ``path`` that have questions, and a row for each file that can't be parsed, be it in one field only. Files without questions are in neither."""
    files = spark.read.schema(BANK).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    files = files.withColumn("path", F.col("_metadata.file_path"))
    # Spark parses only fields that are used, and finds a mistyped field only if it parses it: the condition on questions, which always holds, makes it
    return files.filter("_corrupt IS NULL AND questions IS NOT NULL").drop("_corrupt"), files.filter("_corrupt IS NOT NULL AND coalesce(size(questions), 0) >= -1").select("path", F.lit("unparseable").alias("status"))


def read_notes(spark: SparkSession, path: str, glob: str = "*.mdx") -> DataFrame:
    """Whole notes with their paths."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def append(df: DataFrame, path: str) -> None:
    """Append events, exam results or rows for review to a table, again if it is called again; ``appends.append_once`` doesn't repeat a batch."""
    df.write.mode("append").parquet(path)


def export_state(tables: dict[str, DataFrame], version: int, at: str) -> DataFrame:
    """One JSON document per learner of all its state, with version and time. A learner's state is bounded by what it is."""
    out = None
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "learner_id"]
        part = df.groupBy("learner_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = part if out is None else out.join(part, "learner_id", "full")
    return out.select("learner_id", F.to_json(F.struct(F.lit(version).alias("version"), F.lit(at).alias("exportedAt"), *tables)).alias("document"))


def validate_backups(backups: DataFrame, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """Backups with a version and one known key at least, and the others."""
    keys = F.json_object_keys(document)
    good = F.coalesce(F.array_contains(keys, "version") & F.arrays_overlap(keys, F.array(*map(F.lit, STATE_KEYS))), F.lit(False))
    rows = backups.withColumn("valid", good)
    return rows.filter("valid").drop("valid"), rows.filter("NOT valid").drop("valid")


def upgrade_mistakes(mistakes: DataFrame, now: str) -> DataFrame:
    """Mistakes of the first version in the shape of the second: a count of 0 and due now where these are missing."""
    return mistakes.withColumns({"reps": F.coalesce("reps", F.lit(0)), "due": F.coalesce("due", F.lit(now).cast("timestamp"))})


def upgrade_mastery(mastery: DataFrame) -> DataFrame:
    """The single day of the first version as a list of days."""
    return mastery.withColumn("days", F.coalesce("days", F.when(F.col("mastered_at").isNotNull(), F.array(F.to_date("mastered_at"))), F.array().cast("array<date>"))).drop("mastered_at")
