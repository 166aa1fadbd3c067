"""The further ledger operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import band, bill_due, is_small, relation
from ..operators import accounts as op
from ..operators import learner
from ..sources.adapters import table
from .ledger import halves_up

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = halves_up(sql)
        return f

    return add


HOLIDAYS = ((1, 26), (8, 15))
# days are closed or open in a calendar of all of them; what is asked for is looked up in it
CALENDAR = """cal AS (SELECT DATE '1994-12-01' + CAST(unnest(range(0, 4000)) AS INTEGER) AS d), opened AS (SELECT d FROM cal WHERE isodow(d) <> 7 AND NOT (month(d) = 1 AND day(d) = 26) AND NOT (month(d) = 8 AND day(d) = 15))"""


@query(f"""WITH {CALENDAR}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), p AS (SELECT date, opened.d AS previous_open FROM d ASOF LEFT JOIN opened ON d.date >= opened.d)
SELECT date, previous_open, opened.d AS next_open FROM p ASOF LEFT JOIN opened ON p.date <= opened.d""")
def business_calendar(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return op.business_calendar(days, HOLIDAYS)


@query(f"""WITH {CALENDAR}, b AS (SELECT o_orderkey AS bill_id, CAST(o_orderdate AS DATE) AS start, o_orderkey % 5 AS months, CASE WHEN o_orderkey % 5 = 0 THEN 60 ELSE 0 END AS days, o_orderkey % 11 = 0 AS on_demand FROM orders),
m AS (SELECT *, CAST(start + to_months(CAST(months AS INTEGER)) AS DATE) + days + CASE WHEN on_demand THEN 0 ELSE 3 END AS matures FROM b), e AS (SELECT *, bill_id % 50 = 7 AS hit FROM m),
p AS (SELECT e.*, opened.d AS back FROM e ASOF LEFT JOIN opened ON e.matures >= opened.d), n AS (SELECT p.*, opened.d AS ahead FROM p ASOF LEFT JOIN opened ON p.matures < opened.d)
SELECT bill_id, matures, CASE WHEN hit THEN ahead ELSE back END AS due FROM n""")
def bills_due(spark, sf_dir):
    k = F.col("o_orderkey")
    bills = table(spark, sf_dir, "orders").select(k.alias("bill_id"), F.to_date("o_orderdate").alias("start"), (k % 5).cast("int").alias("months"), F.when(k % 5 == 0, 60).otherwise(0).alias("days"), (k % 11 == 0).alias("on_demand"))
    closed = bill_due(F.col("start"), F.col("months"), F.col("days"), F.col("on_demand"))
    bills = bills.withColumn("emergency", F.when(F.col("bill_id") % 50 == 7, closed))  # closes some bills' very day
    return op.settle_bills(bills, HOLIDAYS).select("bill_id", "matures", "due")


@query("WITH b AS (SELECT o_custkey AS company, o_totalprice AS amount, 6.37 + o_orderkey % 7 AS rate FROM orders) SELECT company, round(sum(amount * CAST(rate AS DOUBLE)) / sum(amount) + 1e-8, 4) AS rate, round(sum(amount * CAST(rate AS DOUBLE)) / 100, 5) AS cost FROM b GROUP BY 1")
def weighted_borrowing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_totalprice").alias("amount"), (6.37 + F.col("o_orderkey") % 7).alias("rate"))
    return op.weighted_rate(rows, "company", "amount", "rate")


@query("WITH p AS (SELECT p_partkey AS product, p_retailprice * 100 AS overhead, 1000.0 + p_size AS normal, 900.0 + p_size * 5 AS actual FROM part) SELECT product, round(overhead * least(1, CAST(actual AS DOUBLE) / CAST(normal AS DOUBLE)), 5) AS absorbed, round(overhead - overhead * least(1, CAST(actual AS DOUBLE) / CAST(normal AS DOUBLE)), 5) AS unabsorbed FROM p")
def absorbed_overhead(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), (F.col("p_retailprice") * 100).alias("overhead"), (1000.0 + F.col("p_size")).alias("normal"), (900.0 + F.col("p_size") * 5).alias("actual"))
    return op.absorbed_overhead(rows, "product")


@query("WITH m AS (SELECT o_custkey AS partner, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount, 12 - month(o_orderdate) AS months_left FROM orders) SELECT partner, round(sum(amount), 5) AS closing, round(sum(amount * months_left) * 6.0 / 1200, 5) AS interest FROM m GROUP BY 1")
def capital_interest(spark, sf_dir):
    amount = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    moves = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("partner"), amount.alias("amount"), (12 - F.month("o_orderdate")).alias("months_left"))
    return op.time_weighted_interest(moves, "partner", 6.0)


@query("SELECT o_custkey AS company, o_orderpriority AS activity, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 5) AS net FROM orders GROUP BY ROLLUP (o_custkey, o_orderpriority) HAVING o_custkey IS NOT NULL")
def cash_flow(spark, sf_dir):
    net = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    flows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("activity"), net.alias("amount"))
    return op.by_activity(flows, "company", "activity", "amount")


_PART = ("consumption", "investment", "government", "abroad", "depreciation")


@query("WITH s AS (SELECT c_nationkey AS country, " + ", ".join(f"sum(CASE WHEN c_custkey % 6 = {i} THEN c_acctbal ELSE 0 END) AS {n}" for i, n in enumerate([*_PART, "indirect_tax"])) + " FROM customer GROUP BY 1), t AS (SELECT country, " + ", ".join(f"round({n}, 5) AS {n}" for n in [*_PART, "indirect_tax"]) + """ FROM s)
SELECT country, round(consumption + investment + government, 5) AS gdp, round(consumption + investment + government + abroad, 5) AS gnp, round(consumption + investment + government + abroad - depreciation, 5) AS nnp, round(consumption + investment + government + abroad - depreciation - indirect_tax, 5) AS national_income FROM t""")
def national_income(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("country"), (F.col("c_custkey") % 6).alias("kind"), F.col("c_acctbal").alias("amount"))
    return op.national_income(op.components(rows, "country", "kind", "amount", {n: i for i, n in enumerate([*_PART, "indirect_tax"])}))


@query("""WITH o AS (SELECT n_regionkey AS pair, n_nationkey AS country, count(*) FILTER (WHERE c_custkey % 2 = 0) + 1 AS a, count(*) FILTER (WHERE c_custkey % 3 = 0) + 1 AS b FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY a DESC, country) AS ra, row_number() OVER (PARTITION BY pair ORDER BY b DESC, country) AS rb, row_number() OVER (PARTITION BY pair ORDER BY CAST(b AS DOUBLE) / a, country) AS ca, row_number() OVER (PARTITION BY pair ORDER BY CAST(a AS DOUBLE) / b, country) AS cb FROM o)
SELECT pair, max(CASE WHEN ra = 1 THEN country END) AS absolute_a, max(CASE WHEN rb = 1 THEN country END) AS absolute_b, max(CASE WHEN ca = 1 THEN country END) AS comparative_a, max(CASE WHEN cb = 1 THEN country END) AS comparative_b FROM r GROUP BY 1""")
def comparative_advantage(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    output = rows.groupBy(F.col("n_regionkey").alias("pair"), F.col("n_nationkey").alias("country")).agg((F.count_if(F.col("c_custkey") % 2 == 0) + 1).alias("a"), (F.count_if(F.col("c_custkey") % 3 == 0) + 1).alias("b"))
    return op.comparative_advantage(output, "a", "b")


@query("""WITH r AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS day, l_returnflag || l_linestatus AS currency, avg(l_extendedprice) AS rate FROM lineitem GROUP BY 1, 2), b AS (SELECT day, rate AS base FROM r WHERE currency = 'NO')
SELECT r.day, currency, round(rate / base + 1e-8, 6) AS "cross" FROM r JOIN b ON b.day = r.day""")
def cross_rates(spark, sf_dir):
    rates = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("day"), F.concat("l_returnflag", "l_linestatus").alias("currency")).agg(F.avg("l_extendedprice").alias("rate"))
    return op.cross_rates(rates, "NO")


@query("""WITH h AS (SELECT c_custkey AS company, 51.0 + c_custkey % 49 AS share, abs(c_acctbal) * 3 AS cost, abs(c_acctbal) * (1 + c_custkey % 7) AS net_assets, abs(c_acctbal) AS stock, 10.0 + c_custkey % 30 AS loading FROM customer),
g AS (SELECT *, CAST(share AS DOUBLE) / 100 AS s, CAST(loading AS DOUBLE) AS l FROM h)
SELECT company, round(net_assets * s, 5) AS group_share, round(net_assets * (1 - s), 5) AS minority, round(greatest(0, cost - net_assets * s), 5) AS goodwill, round(greatest(0, net_assets * s - cost), 5) AS reserve, round(stock * l / (100 + l), 5) AS unrealised FROM g""")
def consolidation(spark, sf_dir):
    k, b = F.col("c_custkey"), F.abs("c_acctbal")
    rows = table(spark, sf_dir, "customer").select(k.alias("company"), (51.0 + k % 49).alias("share"), (b * 3).alias("cost"), (b * (1 + k % 7)).alias("net_assets"), b.alias("stock"), (10.0 + k % 30).alias("loading"))
    return op.consolidation(rows)


@query("SELECT o_custkey AS trader, round(sum(o_totalprice * CASE WHEN o_orderkey % 4 IN (0, 1) THEN 1 ELSE -1 END), 5) AS profit FROM orders GROUP BY 1")
def net_worth_profit(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("closing", "drawings", "opening", "introduced"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trader"), kind.alias("kind"), F.col("o_totalprice").alias("amount"))
    return op.net_worth_profit(rows, "trader")


@query("""WITH c AS (SELECT l_orderkey AS holder, max(l_quantity) AS n, sum(CASE WHEN l_linestatus = 'F' THEN l_tax * 100 ELSE 0 END) AS p, sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_tax * 100 END) AS d FROM lineitem GROUP BY 1)
SELECT holder, round(n * p, 5) AS forfeited, round(n * d, 5) AS unpaid, round(n * greatest(0, p - greatest(0, 10 - 7.5)), 5) AS to_reserve FROM c""")
def forfeiture(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("holder"), F.col("l_quantity").alias("shares"), (F.col("l_tax") * 100).alias("amount"), (F.col("l_linestatus") == "F").alias("paid"), F.lit(10.0).alias("face"), F.lit(7.5).alias("reissue"))
    return op.forfeiture(rows, "holder")


@query("""WITH b AS (SELECT o_orderkey AS bill_id, o_totalprice AS amount, date_diff('day', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 AS INTEGER)) AS whole, greatest(0, date_diff('day', DATE '1996-12-31', CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 AS INTEGER))) AS after FROM orders)
SELECT bill_id, round(amount * 9.0 / 100 * whole / 365, 5) AS discount, round(amount * 9.0 / 100 * least(whole, after) / 365, 5) AS rebate FROM b""")
def bill_discount(spark, sf_dir):
    day = F.to_date("o_orderdate")
    bills = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bill_id"), F.col("o_totalprice").alias("amount"), day.alias("discounted"), F.date_add(day, (F.col("o_custkey") % 120).cast("int")).alias("due"))
    return op.discount_and_rebate(bills, "1996-12-31", 9.0)


@query("""WITH o AS (SELECT user_id, event_type AS topic, CAST(max(event_id % 4) AS INTEGER) AS l FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_type AS topic, CAST(max(event_id % 4) AS INTEGER) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2),
d AS (SELECT user_id, topic, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS days FROM (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY day DESC) AS i FROM (SELECT DISTINCT user_id, event_type AS topic, CAST(ts AS DATE) AS day FROM events) q) w WHERE i <= 5 GROUP BY 1, 2)
SELECT d.user_id, d.topic, greatest(coalesce(l, 0), coalesce(m, 0)) AS level, days FROM d LEFT JOIN o ON o.user_id = d.user_id AND o.topic = d.topic LEFT JOIN n ON n.user_id = d.user_id AND n.topic = d.topic""")
def restored_mastery(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of = lambda half: events.filter(F.col("event_id") % 2 == half).groupBy("user_id", F.col("event_type").alias("topic")).agg(F.max(F.col("event_id") % 4).cast("int").alias("level"), F.array_sort(F.collect_set(F.to_date("ts"))).alias("days"))
    rows = op.restore(of(0), of(1), ["user_id", "topic"])
    return rows.withColumn("days", F.array_join(F.transform("days", lambda d: d.cast("string")), ","))


@query("""WITH f AS (SELECT l_suppkey AS firm, sum(l_extendedprice) AS turnover, sum(CASE WHEN month(l_shipdate) <= 7 THEN l_extendedprice ELSE 0 END) AS part FROM lineitem GROUP BY 1)
SELECT firm, round(turnover * 0.2 * 0.25 * CASE WHEN firm % 2 = 0 THEN part / turnover ELSE CAST(7 AS DOUBLE) / 12 END, 5) AS share FROM f""")
def share_to_exit(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("firm")).agg(F.sum("l_extendedprice").alias("turnover"), F.sum(F.when(F.month("l_shipdate") <= 7, F.col("l_extendedprice")).otherwise(0.0)).alias("turnover_to_exit"))
    rows = sums.withColumns({"profit": F.col("turnover") * 0.2, "ratio": F.lit(0.25), "months": F.lit(7)})
    return op.share_to_exit(rows, "firm", F.col("firm") % 2 == 0)


@query("""WITH w AS (SELECT c_nationkey AS nation, c_custkey AS learner_id, floor(100.0 * (c_custkey % 50) / 50 + 0.5) AS pct FROM customer) SELECT nation, count(*) AS learners, count(*) FILTER (WHERE pct >= 40) AS passed FROM w GROUP BY 1""")
def pass_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), learner.percent(F.col("c_custkey") % 50, F.lit(50)).alias("pct"))
    return rows.groupBy("nation").agg(F.count("*").alias("learners"), F.count_if(F.col("pct") >= 40).alias("passed"))


@query("""WITH h AS (SELECT o_custkey AS company, o_orderkey % 20 AS holder, max(o_orderkey % 37) AS pct FROM orders GROUP BY 1, 2), t AS (SELECT company, count(*) AS holders, sum(pct) AS held FROM h GROUP BY 1)
SELECT company, holders, held, CASE WHEN held > 50 THEN 'subsidiary' WHEN held >= 20 THEN 'associate' ELSE 'none' END AS relation, c_custkey % 3 <> 0 AND abs(c_acctbal) * 10000 <= 4e7 AND c_custkey % 800 * 1e6 <= 4e8 AS small,
  CASE WHEN abs(c_acctbal) * 1000 > 2000000 THEN 'district' WHEN abs(c_acctbal) * 1000 > 300000 THEN 'senior' ELSE 'junior' END AS court FROM t JOIN customer ON c_custkey = company""")
def company_classes(spark, sf_dir):
    """Relation by shares held (a joint holding counts once), small companies, and the court that a claim's value leads to."""
    held = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company"), (F.col("o_orderkey") % 20).alias("holder")).agg(F.max(F.col("o_orderkey") % 37).alias("pct"))
    sums = held.groupBy("company").agg(F.count("*").alias("holders"), F.sum("pct").alias("held"))
    rows = sums.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("company"))
    worth, k = F.abs("c_acctbal"), F.col("c_custkey")
    return rows.select("company", "holders", "held", relation(F.col("held")).alias("relation"), is_small(worth * 10000, k % 800 * 1e6, k % 3 == 0).alias("small"), band(worth * 1000, ((300_000, "senior"), (2_000_000, "district")), "junior").alias("court"))
