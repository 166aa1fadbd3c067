"""Line deduplication by a log-template tree.

A line's path through the tree is its token count and its first ``DEPTH`` tokens, those with a digit as wildcards. Within
a leaf, a token is constant at its place if lines of enough documents have it there, and any other one is a variable field; the line with
its variables as wildcards is its template. What is enough is told at several ``LEVELS``, from ``MIN_DOCS`` documents to half of the leaf's, so that a field stays
a field however large the table is, and whether it has many values or few. A template of some level that lines of ``MIN_DOCS`` documents
share, and half of whose tokens at least are constant, is boilerplate: its lines are dropped from every document, and the others stay
in place.

Equal lines are counted together before anything else, so that a line of a third of all documents is one row; only lines in
leaves that several documents reach are looked at further. Only DataFrame functions are used.

Null counts as empty text. Empty and blank lines stay. A document may lose all lines; it is then the empty text. Copies of a
document count once, so copying alone makes no boilerplate. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

DEPTH = 3
MIN_DOCS = 3
LEVELS = (0.0, 0.02, 0.1, 0.5)  # share of a leaf's documents that have a constant token, besides the least number
CONSTANT_SHARE = 0.5
WILDCARD = "<*>"
MOST_LEAVES = 1_000_000  # broadcast up to so many leaves of 16 bytes; more are joined by shuffle


def _tokens(line: str | Column) -> Column:
    return F.split(F.trim(F.col(line) if isinstance(line, str) else line), r"\s+")


def _leaf(line: Column) -> Column:
    """Hash of the path: token count and leading tokens with digits masked. Long lines aren't split beyond their head."""
    head = F.split(F.trim(line), r"\s+", DEPTH + 1)
    spaces = F.length(F.trim(line)) - F.length(F.regexp_replace(F.trim(line), r"\s+", ""))
    masked = F.transform(F.slice(head, 1, DEPTH), lambda t: F.when(t.rlike("[0-9]"), WILDCARD).otherwise(t))
    return F.xxhash64(spaces, masked)


def _lines(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    found = F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return docs.select(*keep, F.explode(found).alias("line")).withColumn("leaf", _leaf(F.col("line")))


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text") -> DataFrame:
    """``line_hash`` and ``template`` of each distinct line that is dropped."""
    lines = _lines(docs, text, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    leaves = lines.groupBy("leaf", "content").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("n"))
    busy = materialise(leaves.filter(F.col("n") >= min_docs).select("leaf", F.col("n").alias("all")))
    known = F.broadcast(busy) if busy.count() <= MOST_LEAVES else busy
    reached = materialise(lines.join(known.select("leaf"), "leaf").groupBy("leaf", "line", "content").agg(F.xxhash64("line").alias("line_hash")))
    distinct = reached.groupBy("leaf", "line_hash").agg(F.min("line").alias("line"), F.count("*").alias("docs"))
    tokens = materialise(distinct.select("leaf", "line_hash", "docs", F.posexplode(_tokens("line")).alias("at", "token")))
    shared = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs).join(known, "leaf")
    levels = sum((F.when(F.col("n") >= F.col("all") * share, 1).otherwise(0) for share in LEVELS), F.lit(0))  # a token is constant at so many levels
    marked = tokens.join(shared.select("leaf", "at", "token", levels.alias("levels")), ["leaf", "at", "token"], "left")
    constant = F.when(F.col("token").rlike("[0-9]"), 0).otherwise(F.coalesce("levels", F.lit(0)))
    found = marked.groupBy("leaf", "line_hash").agg(F.sort_array(F.collect_list(F.struct("at", "token", constant.alias("levels")))).alias("t"))
    words = lambda level: F.transform("t", lambda x: F.when(x["levels"] > level, x["token"]).otherwise(WILDCARD))
    each = found.select("line_hash", F.explode(F.array_distinct(F.array(*(words(n) for n in range(len(LEVELS)))))).alias("t"))
    fixed = F.size(F.filter("t", lambda x: x != WILDCARD)) / F.size("t")
    templates = materialise(each.filter(fixed >= CONSTANT_SHARE).select("line_hash", F.concat_ws(" ", "t").alias("template")))
    per_doc = reached.select("line_hash", "content").join(templates, "line_hash").select("template", "content").distinct()
    often = per_doc.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("template")
    return templates.join(often, "template").groupBy("line_hash").agg(F.min("template").alias("template"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` and ``n_dropped``; columns of these names are replaced."""
    docs = docs.drop("clean_text", "n_lines", "n_dropped")
    dropped = materialise(boilerplate(docs, min_docs, text).select("line_hash").distinct())
    found = _lines(docs, text, F.col(key).alias("doc")).select("doc", F.xxhash64("line").alias("line_hash"))
    hit = found.join(dropped, "line_hash", "left_semi").groupBy("doc").agg(F.collect_set("line_hash").alias("_hit")).withColumnRenamed("doc", "_doc")
    rows = docs.join(hit, F.col(key).eqNullSafe(F.col("_doc")), "left")
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    stays = F.when(F.col("_hit").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains("_hit", F.xxhash64(x))))
    rows = rows.withColumn("_stays", stays)
    return rows.select(*docs.columns, F.array_join("_stays", "\n").alias("clean_text"), F.size(split).alias("n_lines"), (F.size(split) - F.size("_stays")).alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its boilerplate lines, by counts and digest."""
    clean = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.length("clean_text").cast("long").alias("n_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))
