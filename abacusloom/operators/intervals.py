"""Joins of points with the intervals that hold them, as an equality of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Pairs of a point and a range with ``low <= point <= high``. Each range stands in every bucket of ``width`` that it touches and each point in its own, so
    that Spark joins them by hash or by sorting, and splits hot buckets; the bounds are then checked exactly. A width near the usual length of
    ranges keeps both the copies of a range and the candidates of a point few. Null points and bounds pair with nothing; an empty range holds nothing."""
    bucket = lambda x: F.floor(x / width)
    spread = ranges.filter(low <= high).withColumns({"_low": low, "_high": high})
    spread = spread.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high")))))
    placed = points.withColumn("_point", point).withColumn("_bucket", bucket(F.col("_point")))
    return placed.join(spread, "_bucket").filter(F.col("_point").between(F.col("_low"), F.col("_high"))).drop("_bucket", "_point", "_low", "_high")
