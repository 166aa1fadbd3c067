"""Ordered work within keys of any size: a task holds a block of a key's rows, never a key.

A key of more than ``block_rows`` rows is cut into blocks of consecutive rows, at bounds that a sample of its own rows gives. Running
sums are sums within each block, in order, plus the sums of the blocks before it: the blocks' totals are few (one for each ``block_rows`` rows,
about) and are scanned by themselves. Which rows lie in which block changes the work of tasks, never a result. Where no key is that
large, which a count by key tells, there is one block for each key, and nothing else is computed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000
MOST_BLOCKS = 200_000  # what is broadcast at most: a bound for each block
SAMPLED = 24  # rows of the sample for each block


def dealt(rows: DataFrame, key: Sequence[str], a_task: int, source: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt by key to as many partitions as give a task about ``a_task`` of them, so that what a task holds doesn't grow with the table; what follows by
    the same key stays where it is. Rows that explode later are dealt before. ``source`` is a table of as many rows that is cheaper to count."""
    n = (rows if source is None else source).count()
    return rows.repartition(max(1, -(-n // a_task)), *key)


def meet(rows: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` left joined with a few broadcast rows; null keys meet null keys."""
    named = few.select(*(F.col(c).alias(f"_of_{c}" if c in on else c) for c in few.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return rows.join(F.broadcast(named), same, "left").drop(*(f"_of_{c}" for c in on))


def in_blocks(rows: DataFrame, key: Sequence[str], order: Sequence[str], block_rows: int = BLOCK_ROWS, source: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """``rows`` with ``_block``, which is null where a key has one block only and rises with ``order`` otherwise; and whether any key was cut.
    Rows that are equal in ``order`` share a block. ``source`` is a table of as many rows or more that is cheaper to count than ``rows``."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("_rows"))
    large = counts.filter(F.col("_rows") > block_rows)
    every = (rows if source is None else source).count()
    if every <= block_rows or large.isEmpty():
        return rows.withColumn("_block", F.lit(None).cast("int")), False
    block_rows = max(block_rows, every // MOST_BLOCKS)  # so that there are no more bounds than that
    large = large.filter(F.col("_rows") > block_rows)
    at = F.struct(*order)
    share = F.ceil(F.col("_rows") / block_rows) * SAMPLED / F.col("_rows")
    drawn = F.pmod(F.xxhash64(*key, *order), F.lit(1 << 20)) / float(1 << 20)
    sample = meet(rows, large, key).filter(drawn < share).groupBy(*key).agg(F.sort_array(F.collect_set(at)).alias("_sample"))
    bounds = sample.select(*key, F.filter("_sample", lambda _, i: i % SAMPLED == SAMPLED - 1).alias("_bounds"))
    cut = meet(rows, bounds, key)
    return cut.withColumn("_block", F.when(F.col("_bounds").isNotNull(), F.size(F.filter("_bounds", lambda b: b < at)))).drop("_bounds"), True


def before_blocks(cut: DataFrame, key: Sequence[str], sums: Mapping[str, str | Column], descending: bool = False) -> DataFrame:
    """Of each block of a cut key the sums of the blocks before it (after it, if ``descending``), and as ``_all_<name>`` of all its blocks: a row for each block."""
    totals = cut.filter(F.col("_block").isNotNull()).groupBy(*key, "_block").agg(*(F.sum(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in sums.items()))
    w = Window.partitionBy(*key)
    prior = w.orderBy(F.desc("_block") if descending else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*key, "_block", *(F.sum(n).over(prior).alias(n) for n in sums), *(F.sum(n).over(w).alias(f"_all_{n}") for n in sums))


def running(rows: DataFrame, key: Sequence[str], order: Sequence[str], sums: Mapping[str, str | Column], totals: Mapping[str, str] | None = None, descending: bool = False, block_rows: int = BLOCK_ROWS, source: DataFrame | None = None) -> DataFrame:
    """``rows`` with running sums within each key in ``order``, the row itself counted, and ``totals`` of them: ``{name: name of the sum}``.
    ``order`` has to tell a key's rows apart, or their order among each other is any."""
    cut, any_cut = in_blocks(rows, key, order, block_rows, source)
    block = Window.partitionBy(*key, "_block") if any_cut else Window.partitionBy(*key)
    upto = block.orderBy(*((F.desc if descending else F.asc)(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    of = {n: F.col(v) if isinstance(v, str) else v for n, v in sums.items()}
    totals = totals or {}
    out = cut.withColumns({n: F.sum(v).over(upto) for n, v in of.items()} | {n: F.sum(of[s]).over(block) for n, s in totals.items()})
    if not any_cut:
        return out.drop("_block")
    prior = before_blocks(cut, key, sums, descending)
    prior = prior.select(*key, "_block", *(F.col(n).alias(f"_before_{n}") for n in sums), *(f"_all_{s}" for s in totals.values()))
    out = meet(out, prior, [*key, "_block"])
    out = out.withColumns({n: F.coalesce(F.col(n) + F.col(f"_before_{n}"), F.col(n), F.col(f"_before_{n}")) for n in sums} | {n: F.coalesce(f"_all_{s}", n) for n, s in totals.items()})
    return out.drop("_block", *(f"_before_{n}" for n in sums), *(f"_all_{s}" for s in totals.values()))
