"""The given tables as the facts and dimensions that the operators take.

All columns are derived by deterministic rules, so SQL over the same tables can state them too; the SQL of
each adapter stands beside it, as a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("learner_id"),
        "event_id",
        F.col("ts").alias("at"),
        F.get_json_object("props", "$.k").cast("long").alias("question_id"),
        F.col("event_type").alias("chapter"),
        (F.col("event_id") % 3 != 0).alias("correct"),
        F.when(F.col("event_id") % 4 == 0, True).when(F.col("event_id") % 4 == 1, False).alias("sure"),
    )


ANSWER = """ans AS (SELECT user_id AS learner_id, event_id, ts AS "at", CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id,
  event_type AS chapter, event_id % 3 <> 0 AS correct, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS sure FROM events)"""


def fact_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rating = F.element_at(F.array(*map(F.lit, ("again", "hard", "good", "easy"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("user_id").alias("learner_id"), "event_id", F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("card_id"), rating.alias("rating"))


REVIEW = """rev AS (SELECT user_id AS learner_id, event_id, ts AS "at", CAST(json_extract_string(props, '$.k') AS BIGINT) AS card_id,
  CASE event_id % 4 WHEN 0 THEN 'again' WHEN 1 THEN 'hard' WHEN 2 THEN 'good' ELSE 'easy' END AS rating FROM events)"""


def fact_mock_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exam per order: its lines are the questions. The position breaks ties by all columns that differ."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.col("l_orderkey").alias("mock_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("question_id"),
        F.col("l_returnflag").alias("group_id"),
        F.when(F.col("l_partkey") % 7 == 0, "blank").when(F.col("l_partkey") % 3 == 0, "wrong").otherwise("correct").alias("status"),
        F.col("l_quantity").alias("secs"),
        F.col("l_suppkey").alias("case_id"),
        F.when(F.col("l_quantity") >= 25, 2.0).otherwise(1.0).alias("marks"),
    )


MOCK_ITEM = """mock AS (SELECT l_orderkey AS mock_id, l_linenumber AS pos, l_partkey AS question_id, l_returnflag AS group_id,
  CASE WHEN l_partkey % 7 = 0 THEN 'blank' WHEN l_partkey % 3 = 0 THEN 'wrong' ELSE 'correct' END AS status, l_quantity AS secs,
  l_suppkey AS case_id, CAST(CASE WHEN l_quantity >= 25 THEN 2 ELSE 1 END AS DOUBLE) AS marks FROM lineitem)"""


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases by item in order. Rows alike in all columns share a position, and are one lot of their joint units."""
    item = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    return item.select(F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("ts"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"), F.col("l_quantity").alias("units"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'")
    return item.select(F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("ts"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"), (F.col("l_quantity") / 2).alias("units"))


STOCK = """lot AS (SELECT l_partkey AS item_id, l_shipdate AS ts, l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3, l_quantity AS k4,
  l_extendedprice AS k5, l_quantity AS units, l_extendedprice / l_quantity AS rate FROM lineitem WHERE l_linestatus = 'O'),
issue AS (SELECT l_partkey AS item_id, l_shipdate AS ts, l_quantity / 2 AS units FROM lineitem WHERE l_linestatus = 'F')"""


def price_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and quantity of each part in each year, for baskets by the part's manufacturer or the like."""
    item = table(spark, sf_dir, "lineitem")
    return item.groupBy(F.col("l_partkey").alias("item"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("q"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("p"))


PRICE = """pq AS (SELECT l_partkey AS item, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS q, sum(l_extendedprice) / sum(l_quantity) AS p
  FROM lineitem GROUP BY 1, 2)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs per order: a debit to the customer's account, a credit to the sales account of its priority."""
    o = table(spark, sf_dir, "orders")
    legs = F.array(
        F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account"), F.lit("dr").alias("side")),
        F.struct(F.concat(F.lit("S"), F.substring("o_orderpriority", 1, 1)).alias("account"), F.lit("cr").alias("side")),
    )
    return o.select(F.col("o_orderkey").alias("entry"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("amount"), F.explode(legs).alias("leg")).select("entry", "at", "leg.account", "leg.side", "amount")


POSTING = """post AS (SELECT o_orderkey AS entry, o_orderdate AS "at", 'C' || CAST(o_custkey AS VARCHAR) AS account, 'dr' AS side, o_totalprice AS amount FROM orders
  UNION ALL SELECT o_orderkey, o_orderdate, 'S' || substr(o_orderpriority, 1, 1), 'cr', o_totalprice FROM orders)"""


def xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of (quantity, price per unit) points for each supplier."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_suppkey").alias("series_id"), F.col("l_quantity").alias("x"), F.round(F.col("l_extendedprice") / 1000, 0).alias("y"))


XY = "xy AS (SELECT l_suppkey AS series_id, l_quantity AS x, round(l_extendedprice / 1000, 0) AS y FROM lineitem)"


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loan per order: its price over two to ten years of months at 6.37 to 10.37 per cent a year."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("loan_id"), F.col("o_totalprice").alias("principal"), ((F.col("o_custkey") % 5 + 6.37) / 1200.0).alias("rate"), ((F.col("o_orderkey") % 9 + 2) * 12).cast("int").alias("n"))


LOAN = """loan AS (SELECT o_orderkey AS loan_id, o_totalprice AS principal, (o_custkey % 5 + 6.37) / 1200.0 AS rate,
  CAST((o_orderkey % 9 + 2) * 12 AS INTEGER) AS n FROM orders)"""
