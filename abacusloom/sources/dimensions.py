"""Dimensions from typed JSON, and their versions over time.

Every load of a dimension is a whole snapshot of it on a date. A version of a key is a stretch of loads in which its attributes stayed the same: valid from the
first such load's date to the date of the load that changed it or left it out (null as long as that hasn't happened). Facts look up the version of their
own date, so a changed weight counts from its date on and not before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHAPTER = "struct<number:int,slug:string,name:string,hasNotes:boolean>"
KINDS = {
    "papers": f"id string, slug string, number int, name string, shortName string, marks double, status string, pattern struct<style:string,mcqPct:double,descriptivePct:double,negativeMarking:boolean>, sections array<struct<name:string,chapters:array<{CHAPTER}>>>",
    "weights": "paperSlug string, section string, `group` string, label string, lo double, hi double, fixed double, chapters array<string>",
    "sittings": "id string, level string, label string, examDate string, cutoff string, verified boolean, verify array<string>",
    "amendments": "id string, paperSlug string, appliesFrom string, title string, old string, now string, source string, sourceUrl string, affected array<struct<label:string,href:string>>, todo boolean",
    "cards": "id string, paperSlug string, chapter string, front string, back string",
}


def read_dimension(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a dimension's JSON files (each an array of objects) by the types of its kind, and a row for each file that doesn't fit them: one that can't be
    parsed, has a field of another type, or an object without its first field. Of such a file no row is taken."""
    rows = spark.read.schema(f"{KINDS[kind]}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumn("_path", F.col("_metadata.file_path"))
    whole = F.length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c[0] != "_"))))  # Spark parses only fields that are used: a mistyped one has to be
    bad = rows.filter(F.col("_corrupt").isNotNull() | F.col(rows.columns[0]).isNull() | (F.coalesce(whole, F.lit(0)) < 0)).select("_path").distinct()
    good = rows.join(F.broadcast(bad), "_path", "left_anti")  # a row for each bad file
    return good.drop("_corrupt", "_path"), bad.select(F.col("_path").alias("path"), F.lit("unparseable").alias("status"))


def chapters_of(papers: DataFrame) -> DataFrame:
    """A row for each chapter of each section of each paper."""
    sections = papers.select(F.col("slug").alias("paper"), F.posexplode("sections").alias("section_at", "s"))
    return sections.select("paper", F.col("section_at").alias("section_at"), F.col("s.name").alias("section"), F.explode("s.chapters").alias("c")).select("paper", "section_at", "section", "c.number", F.col("c.slug").alias("chapter"), "c.name", F.col("c.hasNotes").alias("has_notes"))


def month_start(label: Column) -> Column:
    """The first day of the month that a label such as ``Sept 2026`` or ``May 2027`` names; null for any other."""
    return F.try_to_date(F.concat(F.lit("1 "), F.regexp_replace(F.trim(label), r"^Sept\b", "Sep")), "d MMM yyyy")


def fingerprint(df: DataFrame, skip: Sequence[str]) -> Column:
    """A digest of all attributes, nested ones too; nulls are values."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns) if c not in skip)), {"ignoreNullFields": "false"}), 256)


def versions(loads: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """All versions from all loads: the attributes with ``valid_from`` and ``valid_to`` (exclusive). A key is loaded once a date; of rows of one key and date one is taken, the
    smallest by its digest. Loads are as many as dates, which is what is broadcast."""
    rows = loads.withColumn("_print", fingerprint(loads, [*key, at]))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key, at).orderBy("_print"))).filter("_n = 1").drop("_n")
    dates = loads.select(F.col(at).alias("_at")).distinct()
    dates = dates.withColumn("_next", F.lead("_at").over(Window.orderBy("_at")))  # a row for each load
    rows = rows.join(F.broadcast(dates), F.col(at) == F.col("_at")).drop("_at")
    order = Window.partitionBy(*key).orderBy(at)
    begins = ~(F.lag("_print").over(order).eqNullSafe(F.col("_print")) & F.lag("_next").over(order).eqNullSafe(F.col(at)))
    rows = rows.withColumn("_version", F.sum(begins.cast("int")).over(order))
    attributes = [c for c in loads.columns if c not in (*key, at)]
    last = F.max_by(F.struct("_next"), at)["_next"]
    out = rows.groupBy(*key, "_version").agg(*(F.first(f"`{c}`").alias(c) for c in attributes), F.min(at).alias("valid_from"), last.alias("valid_to"))
    return out.drop("_version")


def merge(held: DataFrame, load: DataFrame, key: Sequence[str], at: Column) -> DataFrame:
    """Versions after one more load, later than all before. Closed versions stay; an open one stays open if the load has the same attributes, and ends at its date
    otherwise; new and changed keys open a version. Merging the same load again changes nothing."""
    attributes = [c for c in held.columns if c not in (*key, "valid_from", "valid_to")]
    load = load.select(*key, *attributes).withColumn("_print", fingerprint(load.select(*key, *attributes), key))
    load = load.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_print"))).filter("_n = 1").drop("_n")
    current = held.filter("valid_to IS NULL").withColumn("_held", fingerprint(held, [*key, "valid_from", "valid_to"]))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key]
    both = current.alias("h").join(load.alias("l"), same, "full")
    kept, came = F.col("h._held").isNotNull(), F.col("l._print").isNotNull()
    equal = F.col("h._held").eqNullSafe(F.col("l._print"))
    old = both.filter(kept).select(*(F.col(f"h.{c}").alias(c) for c in (*key, *attributes)), "h.valid_from", F.when(~(came & equal), at).alias("valid_to"))
    new = both.filter(came & ~(kept & equal)).select(*(F.col(f"l.{c}").alias(c) for c in (*key, *attributes)), at.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return held.filter("valid_to IS NOT NULL").unionByName(old.filter("valid_to IS NULL OR valid_to > valid_from")).unionByName(new)


def as_of(facts: DataFrame, held: DataFrame, key: Sequence[str], date: str) -> DataFrame:
    """Facts with the attributes of their key's version on their own date; null where there was none."""
    dims = held.select(*(F.col(c).alias(f"_dim_{c}" if c in key else c) for c in held.columns))
    on = [F.col(k) == F.col(f"_dim_{k}") for k in key] + [F.col(date) >= F.col("valid_from"), F.coalesce(F.col(date) < F.col("valid_to"), F.lit(True))]
    return facts.join(dims, on, "left").drop(*(f"_dim_{k}" for k in key), "valid_from", "valid_to")
