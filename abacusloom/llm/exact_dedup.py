"""Exact deduplication with two passes over a Bloom filter.

The first pass hashes every normalised text to two bits of a filter and keeps the bits that more than
one row set. In the second pass a row goes to the shuffle only if both of its bits are among them; all
other rows are unique for certain and pass straight through. False positives cost a shuffle of one row,
never a wrong result. The filter grows with the rows: up to ``MAX_BLOCKS`` it is broadcast. Beyond it, hashes alone meet their block of it in a
join, and those found there are looked for by a filter of their own, so that rows that don't repeat stay where they are at any size.

Texts are equal when identical after each run of ASCII white space became one space; null counts as
empty. Of equal texts the row with the smallest key stays, a null key only where the whole group has none; of rows that
have that key and that text, one stays. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BITS, MAX_BLOCKS, bit_set, bitmaps, materialise, maybe_among, table

BITS_PER_ROW = 32


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def repeated_bits(hashes: DataFrame, blocks: int) -> DataFrame:
    """The filter: for each block a bitmap of the bits that rows of ``hashes`` set more than once."""
    bits = hashes.select(F.pmod("hash", F.lit(blocks)).alias("block"), F.explode(F.array_distinct(F.array(_bit(1), _bit(2)))).alias("bit"))
    return bitmaps(bits.groupBy("block", "bit").agg(F.count("*").alias("n")).filter("n > 1"))


def _bit(which: int) -> Column:
    return F.pmod(F.shiftrightunsigned("hash", 13 + 16 * which), F.lit(BLOCK_BITS)).cast("long")


def with_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the 64-bit ``hash`` and the ``text_sha256`` of its normalised text."""
    plain = normalised(text)
    return docs.withColumns({"hash": F.xxhash64(plain), "text_sha256": F.sha2(plain, 256)})


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; one row per row of ``docs``.

    Columns of these names (and ``hash``) are replaced. An empty table gives an empty result."""
    return dedup_keyed(with_keys(docs.drop("keep_id", "group_size", "kept", "hash", "text_sha256"), text), key)


def _marked(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with what tells whether both bits of a row's hash are in the filter, and that condition."""
    blocks = max(1, docs.count() * BITS_PER_ROW // BLOCK_BITS)
    filled = repeated_bits(docs.select("hash"), blocks)
    place, found = F.pmod("hash", F.lit(blocks)) == F.col("_block"), bit_set("_bitmap", _bit(1)) & bit_set("_bitmap", _bit(2))
    if blocks <= MAX_BLOCKS:
        return docs.join(F.broadcast(filled), place, "left"), found
    hashes = materialise(docs.select("hash").join(filled, place).filter(found).select("hash").distinct())
    return maybe_among(docs, "hash", hashes, "_again"), F.col("_again")


def dedup_keyed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for rows that have ``hash`` and ``text_sha256`` already. Only rows that may repeat are shuffled: the
    equal ones are counted on the map side first, and a hot group meets its one result row in a join that adaptive
    execution splits."""
    docs = docs.drop("keep_id", "group_size", "kept")
    marked, again = _marked(docs)
    own = [F.col(c) for c in docs.columns if c != "hash"]
    once = marked.filter(~again).select(*own, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    often = marked.filter(again).select(*own)
    keys = often.groupBy("text_sha256", F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    first = F.min(F.struct(F.col("_key").isNull(), "_key", "_n"))
    groups = keys.groupBy("text_sha256").agg(first.alias("_first"), F.sum("_n").alias("group_size"))
    groups = materialise(groups.select("text_sha256", F.col("_first._key").alias("keep_id"), F.col("_first._n").alias("_ties"), "group_size"))
    found = often.join(groups, "text_sha256").withColumn("kept", F.col(key).eqNullSafe(F.col("keep_id")))
    if not groups.filter("_ties > 1").isEmpty():  # rows of one key and text: one of them stays
        tied = materialise(found.filter("kept AND _ties > 1").withColumn("_row", F.monotonically_increasing_id()))
        stays = tied.groupBy("text_sha256").agg(F.min("_row").alias("_stays"))
        tied = tied.join(stays, "text_sha256").withColumn("kept", F.col("_row") == F.col("_stays")).drop("_row", "_stays")
        found = found.filter("NOT kept OR _ties = 1").unionByName(tied)
    return once.unionByName(found.drop("_ties"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays."""
    keyed = materialise(with_keys(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return dedup_keyed(keyed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY plain) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY plain) AS kept, sha256(plain) AS text_sha256
FROM t
"""
