"""Reports from amounts by kind: orders and lines of the given tables as entries of their customer or supplier, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reporting as op
from ..sources.adapters import table
from .firms import _entries, _kind, _kind_sql, _sums, dec, total

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _part(percent):
    """So many units of money for each unit of a line as it has per cent: whole numbers, which no engine rounds."""
    return F.col("l_quantity") * F.round(F.col(percent) * 100, 0)


FLOWS = tuple(k for kinds in op.ACTIVITIES.values() for k in kinds)


def _activity(name):
    return " + ".join(f"{k} * {n}" for k, n in op.ACTIVITIES[name].items())


@query(f"""WITH {_sums('entity', FLOWS)}, w AS (SELECT o_custkey AS entity, CAST(sum({dec('o_totalprice')} * CASE WHEN (o_orderpriority < '4') = (o_orderdate < DATE '1998-01-01') THEN 1 ELSE -1 END) AS DOUBLE) AS working FROM orders GROUP BY 1)
SELECT entity, round({_activity('operating')} + working, 6) AS operating, round({_activity('investing')}, 6) AS investing, round({_activity('financing')}, 6) AS financing, round({_activity('operating')} + {_activity('investing')} + {_activity('financing')} + working, 6) AS net FROM s JOIN w USING (entity)""")
def indirect_cash_flow(spark, sf_dir):
    """Orders of urgent priorities as working assets, the others as working liabilities, before 1998 as opening balances and then as closing ones."""
    o = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    side = F.when(F.col("o_orderpriority") < "4", "asset").otherwise("liability")
    balances = o.select(F.col("o_custkey").alias("entity"), side.alias("side"), F.when(early, F.col("o_totalprice")).otherwise(0.0).alias("opening"), F.when(early, 0.0).otherwise(F.col("o_totalprice")).alias("closing"))
    return op.cash_flow(_entries(spark, sf_dir, "entity", FLOWS), balances, "entity")


BALANCING = ("provision_open", "charge", "provision_close", "asset_open", "depreciation", "sold_value", "asset_close")


@query(f"WITH {_sums('entity', BALANCING)} SELECT entity, round(provision_open + charge - provision_close, 6) AS tax_paid, round(asset_close + depreciation + sold_value - asset_open, 6) AS assets_bought FROM s")
def by_balancing(spark, sf_dir):
    return op.by_balancing(_entries(spark, sf_dir, "entity", BALANCING), "entity")


CONTRACT = ("revenue", "cost", "revenue", "future", "billed")


@query(f"""WITH e AS (SELECT l_partkey AS contract, {_kind_sql('l_orderkey', CONTRACT)} AS kind, l_extendedprice AS amount FROM lineitem WHERE l_linenumber <> 1), s AS (SELECT contract, {', '.join(total(f"kind = '{k}'", k) for k in ('revenue', 'cost', 'future', 'billed'))} FROM e GROUP BY 1),
t AS (SELECT *, coalesce(cost / nullif(cost + future, 0), 0) AS stage, greatest(cost + future - revenue, 0) AS loss FROM s), r AS (SELECT *, revenue * stage AS earned, CASE WHEN loss > 0 THEN -loss ELSE revenue * stage - cost END AS result FROM t)
SELECT contract, round(stage, 6) AS stage, round(earned, 6) AS earned, round(loss, 6) AS expected_loss, CASE WHEN loss > 0 THEN round(greatest(loss - (cost - earned), 0), 6) ELSE 0 END AS provision, round(result, 6) AS result, round(greatest(cost + result - billed, 0), 6) AS due_from, round(greatest(-(cost + result - billed), 0), 6) AS due_to FROM r""")
def contract_dues(spark, sf_dir):
    """Parts as contracts; first lines of orders as parts that don't count."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("contract"), _kind("l_orderkey", CONTRACT).alias("kind"), F.col("l_extendedprice").alias("amount"), (F.col("l_linenumber") != 1).alias("eligible"))
    return op.contract_dues(rows, "contract")


SALES = ("sale", "agency", "consignment", "approval")


@query(f"""WITH e AS (SELECT l_suppkey AS entity, {_kind_sql('l_partkey', SALES)} AS kind, {dec('l_extendedprice')} AS amount, {dec('l_quantity * round(l_discount * 100, 0)')} AS discount, {dec('l_quantity * round(l_tax * 100, 0)')} AS charge, l_returnflag <> 'N' AS settled FROM lineitem)
SELECT entity, CAST(sum(CASE WHEN kind = 'sale' THEN amount - discount WHEN kind = 'agency' THEN charge WHEN kind = 'consignment' OR settled THEN amount ELSE 0 END) AS DOUBLE) AS revenue, CAST(sum(CASE WHEN kind IN ('sale', 'consignment') THEN charge ELSE 0 END) AS DOUBLE) AS expense FROM e GROUP BY 1""")
def recognised_revenue(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), _kind("l_partkey", SALES).alias("kind"), F.col("l_extendedprice").alias("amount"), _part("l_discount").alias("discount"), _part("l_tax").alias("charge"), (F.col("l_returnflag") != "N").alias("settled"))
    return op.recognised_revenue(rows, "entity")


ASSETS = ("opening", "contributions", "benefits", "closing")


@query(f"WITH {_sums('plan', ASSETS)}, r AS (SELECT plan, opening * 8.0::DOUBLE / 100 + (contributions - benefits) * 8.0::DOUBLE / 200 AS e, closing - opening - (contributions - benefits) AS a FROM s) SELECT plan, round(e, 6) AS expected, round(a, 6) AS actual, round(a - e, 6) AS gain FROM r")
def plan_assets(spark, sf_dir):
    return op.plan_assets(_entries(spark, sf_dir, "plan", ASSETS), "plan", 8.0)


@query(f"""WITH e AS (SELECT l_suppkey AS entity, greatest(CAST(l_linenumber AS BIGINT) - l_orderkey % 4, 0) AS extra, l_quantity AS pay FROM lineitem)
SELECT entity, CAST(sum(extra) AS BIGINT) AS days, CAST(sum({dec('extra * pay')}) AS DOUBLE) AS liability FROM e GROUP BY 1""")
def leave_liability(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), (F.col("l_orderkey") % 4).alias("entitled"), F.col("l_linenumber").cast("long").alias("expected"), F.col("l_quantity").alias("daily_pay"))
    return op.leave_liability(rows, "entity")


@query(f"""WITH h AS (SELECT l_suppkey AS company, CASE WHEN l_linenumber % 3 = 0 THEN 'cash' ELSE 'shares' END AS kind, l_quantity AS number, floor(l_extendedprice / 1000) AS price, l_returnflag = 'A' AS held, l_partkey % 17 > 1 AS agrees FROM lineitem),
s AS (SELECT company, CAST(sum({dec('number * price')}) AS DOUBLE) AS consideration, sum(CASE WHEN kind = 'shares' AND NOT held THEN number ELSE 0 END) AS outside, sum(CASE WHEN kind = 'shares' AND NOT held AND agrees THEN number ELSE 0 END) AS agreed FROM h GROUP BY 1),
n AS (SELECT o_custkey AS company, CAST(sum({dec('CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice ELSE -o_totalprice END')}) AS DOUBLE) AS net FROM orders GROUP BY 1), g AS (SELECT s.*, coalesce(net, 0) AS net_assets FROM s LEFT JOIN n USING (company))
SELECT company, consideration, net_assets, round(greatest(consideration - net_assets, 0), 6) AS goodwill, round(greatest(net_assets - consideration, 0), 6) AS reserve, outside > 0 AND agreed >= outside * CAST(0.9 AS DOUBLE) AS merger FROM g""")
def amalgamation(spark, sf_dir):
    """Suppliers' lines as what their holders get, orders of the customer of the same number as assets and liabilities."""
    holders = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company"), F.when(F.col("l_linenumber") % 3 == 0, "cash").otherwise("shares").alias("kind"), F.col("l_quantity").alias("number"), F.floor(F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_returnflag") == "A").alias("held"), (F.col("l_partkey") % 17 > 1).alias("agrees"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.when(F.col("o_orderkey") % 4 > 0, "asset").otherwise("liability").alias("kind"), F.col("o_totalprice").alias("amount"))
    return op.purchase(holders, lines, "company")


BRANCH = ("remitted", "closing_stock", "opening_stock", "goods", "expenses", "retail_sales", "wholesale_value", "head_office", "cash_in_transit", "goods_in_transit")


@query(f"WITH {_sums('branch', BRANCH)} SELECT branch, round(remitted + closing_stock - opening_stock - goods - expenses, 6) AS profit, round(retail_sales - wholesale_value, 6) AS above_wholesale, round(head_office - cash_in_transit - goods_in_transit, 6) AS own_side FROM s")
def branch_profit(spark, sf_dir):
    return op.branch_profit(_entries(spark, sf_dir, "branch", BRANCH), "branch")


SHARED = ("profit", "profit", "drawings_interest", "capital_interest", "salary", "to_reserve", "capital")


@query(f"""WITH {_sums('firm', tuple(dict.fromkeys(SHARED))).replace(_kind_sql('o_orderkey', tuple(dict.fromkeys(SHARED))), _kind_sql('o_orderkey', SHARED))}, d AS (SELECT firm, profit + drawings_interest - capital_interest - salary - to_reserve AS divisible, profit - capital * 10.0::DOUBLE / 100 AS extra FROM s),
p AS (SELECT c_custkey AS firm, q AS partner_id, q + c_custkey % 3 AS ratio FROM customer, (SELECT unnest([1, 2, 3]) AS q) t)
SELECT firm, partner_id, round(divisible, 6) AS divisible, round(divisible * ratio / sum(ratio) OVER (PARTITION BY firm), 6) AS share, round(extra, 6) AS super_profit FROM p JOIN d USING (firm)""")
def appropriation(spark, sf_dir):
    partners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("firm"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("partner_id")).withColumn("ratio", F.col("partner_id") + F.col("firm") % 3)
    return op.appropriation(_entries(spark, sf_dir, "firm", SHARED), partners, "firm", 10.0)


@query("""WITH d AS (SELECT o_orderkey AS drawing, o_totalprice AS amount, [12, 4, 2, 6][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS n, ['beginning', 'middle', 'end'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS timing FROM orders),
m AS (SELECT *, 12 - 12.0::DOUBLE / n * CASE timing WHEN 'beginning' THEN 0.0 WHEN 'middle' THEN 0.5 ELSE 1.0 END AS first FROM d), v AS (SELECT *, (first + (first - 12.0::DOUBLE / n * (n - 1))) / 2 AS months FROM m)
SELECT drawing, round(months, 6) AS months, round(amount * n * months * 6.0::DOUBLE / 1200, 6) AS interest FROM v""")
def instalment_drawings(spark, sf_dir):
    pick = lambda key, values: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("drawing"), F.col("o_totalprice").alias("amount"), pick("o_orderkey", (12, 4, 2, 6)).alias("n"), pick("o_custkey", ("beginning", "middle", "end")).alias("timing"))
    return op.instalment_drawings(rows, 6.0).select("drawing", "months", "interest")


@query("""WITH i AS (SELECT l_orderkey AS holding, l_linenumber AS lot, l_extendedprice AS cost, l_extendedprice - l_quantity * round(l_discount * 100, 0) AS carrying, l_extendedprice - 5 * l_quantity + l_quantity * round(l_tax * 100, 0) AS fair, l_returnflag = 'N' AS to_current FROM lineitem)
SELECT holding, lot, CASE WHEN to_current THEN least(cost, carrying) ELSE least(cost, fair) END AS transfer, round(greatest(carrying - CASE WHEN to_current THEN least(cost, carrying) ELSE least(cost, fair) END, 0), 6) AS loss FROM i""")
def investment_transfers(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("holding"), c("l_linenumber").alias("lot"), c("l_extendedprice").alias("cost"), (c("l_extendedprice") - _part("l_discount")).alias("carrying"), (c("l_extendedprice") - 5 * c("l_quantity") + _part("l_tax")).alias("fair"), (c("l_returnflag") == "N").alias("to_current"))
    return op.transfers(rows).select("holding", "lot", "transfer", "loss")


EQUATION = ("closing_assets", "closing_liabilities", "opening_assets", "opening_liabilities", "capital_in", "drawings")


@query(f"WITH {_sums('entity', EQUATION)} SELECT entity, round(closing_assets - closing_liabilities - opening_assets + opening_liabilities - capital_in + drawings, 6) AS profit FROM s")
def profit_equation(spark, sf_dir):
    return op.profit_equation(_entries(spark, sf_dir, "entity", EQUATION), "entity")


INCOME = ("wages", "rent", "interest", "profit", "mixed", "consumption", "investment", "government", "exports", "imports")


@query(f"""WITH {_sums('nation', INCOME)}, t AS (SELECT *, wages + rent + interest + profit + mixed AS earned FROM s)
SELECT nation, round(earned, 6) AS income, round(consumption + investment + government + exports - imports, 6) AS product, round(earned - consumption, 6) AS saving, round((earned - consumption) / nullif(earned, 0), 6) AS average_saving FROM t""")
def income_methods(spark, sf_dir):
    return op.income_methods(_entries(spark, sf_dir, "nation", INCOME), "nation")


@query(f"""WITH a AS (SELECT l_suppkey AS economy, CAST(sum({dec('l_extendedprice')}) AS DOUBLE) AS autonomous, CAST(sum({dec('l_quantity * round(l_discount * 100, 0)')}) AS DOUBLE) AS investment, l_suppkey % 9 / 10.0::DOUBLE AS propensity, CAST(count(*) AS DOUBLE) AS more FROM lineitem GROUP BY 1),
y AS (SELECT *, 1 / (1 - propensity) AS k, (autonomous + investment) * (1 / (1 - propensity)) AS y FROM a) SELECT economy, round(y, 6) AS income, round(autonomous + propensity * y, 6) AS consumption, round(k * more, 6) AS added FROM y""")
def equilibrium_income(spark, sf_dir):
    d = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("economy")).agg(d(F.col("l_extendedprice")).alias("autonomous"), d(_part("l_discount")).alias("investment"), F.count("*").cast("double").alias("more"))
    return op.equilibrium(rows.withColumn("propensity", F.col("economy") % 9 / 10)).select("economy", "income", "consumption", "added")


ADJUSTMENTS = tuple(op.LEGS)
ACCOUNTS = ("purchases", "sales", "debtors", "drawings", "other")


def _legs_sql():
    return " UNION ALL ".join(f"SELECT entity, '{account}' AS account, {dec(f'{part} * {sign}')} AS change FROM adj WHERE kind = '{kind}'" for kind, parts in op.LEGS.items() for account, part, sign in parts)


@query(f"""WITH a0 AS (SELECT l_suppkey AS entity, {_kind_sql('l_orderkey', ADJUSTMENTS)} AS kind, l_quantity * 125 AS amount, CAST(l_linenumber * 7 % 50 AS DOUBLE) AS ins FROM lineitem),
a1 AS (SELECT entity, kind, amount, amount * 100 / 125 AS cost, ins FROM a0), adj AS (SELECT entity, kind, amount, cost, least(ins, cost) AS insured, cost - least(ins, cost) AS uninsured FROM a1),
ch AS (SELECT entity, account, sum(change) AS change FROM ({_legs_sql()}) l GROUP BY 1, 2),
bal AS (SELECT o_custkey AS entity, {_kind_sql('o_orderkey', ACCOUNTS)} AS account, sum({dec('o_totalprice')}) AS before FROM orders GROUP BY 1, 2)
SELECT coalesce(bal.entity, ch.entity) AS entity, coalesce(bal.account, ch.account) AS account, CAST(coalesce(before, 0) AS DOUBLE) AS before, CAST(coalesce(before, 0) + coalesce(change, 0) AS DOUBLE) AS after FROM bal FULL JOIN ch ON bal.entity = ch.entity AND bal.account = ch.account""")
def adjusted_accounts(spark, sf_dir):
    """Suppliers' lines as adjustments of the accounts of the customer of the same number."""
    c = F.col
    adjustments = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("entity"), _kind("l_orderkey", ADJUSTMENTS).alias("kind"), (c("l_quantity") * 125).alias("amount"), F.lit(25.0).alias("margin"), (c("l_linenumber") * 7 % 50).cast("double").alias("insured"))
    balances = _entries(spark, sf_dir, "entity", ACCOUNTS).withColumnRenamed("kind", "account")
    return op.adjusted_accounts(balances, adjustments, "entity")


FUND = ("opening", "receipt", "income", "expense", "asset", "expense")


@query(f"""WITH e AS (SELECT o_custkey AS entity, o_orderstatus AS fund, {_kind_sql('o_orderkey', FUND)} AS kind, o_totalprice AS amount FROM orders), s AS (SELECT entity, fund, {', '.join(total(f"kind = '{k}'", k) for k in dict.fromkeys(FUND))} FROM e GROUP BY 1, 2),
t AS (SELECT *, opening + receipt + income AS held, greatest(opening + receipt + income - expense, 0) AS rest FROM s)
SELECT entity, fund, round(rest - least(asset, rest), 6) AS closing, round(greatest(expense - held, 0), 6) AS excess, round(least(asset, rest), 6) AS to_capital FROM t""")
def special_funds(spark, sf_dir):
    """Orders of each status as a fund of their customer."""
    o = table(spark, sf_dir, "orders")
    return op.special_funds(o.select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("fund"), _kind("o_orderkey", FUND).alias("kind"), F.col("o_totalprice").alias("amount")), "entity")


CAPITAL = ("assets", "debts", "capitalised", "income", "expense", "stock_open", "paid", "creditors_open", "creditors_close", "stock_close")


@query(f"""WITH {_sums('entity', CAPITAL)}, t AS (SELECT *, stock_open + paid - creditors_open + creditors_close - stock_close AS used FROM s)
SELECT entity, round(used, 6) AS consumed, round(income - expense - used, 6) AS surplus, round(assets - debts + capitalised + (income - expense - used), 6) AS closing FROM t""")
def capital_fund(spark, sf_dir):
    return op.capital_fund(_entries(spark, sf_dir, "entity", CAPITAL), "entity")


@query("""WITH q AS (SELECT l_partkey % 400 AS basket, CAST(l_linenumber * 10 + l_partkey % 7 AS BIGINT) AS p0, CAST(l_quantity AS BIGINT) AS q0, CAST(l_linenumber * 11 + l_partkey % 5 AS BIGINT) AS p1, CAST(l_quantity + l_linenumber % 3 AS BIGINT) AS q1 FROM lineitem),
s AS (SELECT basket, CAST(sum(p0 * q0) AS BIGINT) AS s00, CAST(sum(p0 * q1) AS BIGINT) AS s01, CAST(sum(p1 * q0) AS BIGINT) AS s10, CAST(sum(p1 * q1) AS BIGINT) AS s11 FROM q GROUP BY 1)
SELECT basket, CAST((s10 * 20000 + s00) // (2 * s00) AS DOUBLE) / 100 AS laspeyres, CAST((s11 * 20000 + s01) // (2 * s01) AS DOUBLE) / 100 AS paasche, round_even(100 * sqrt(CAST(s10 AS DOUBLE) / s00 * s11 / s01), 2) AS fisher FROM s""")
def published_indices(spark, sf_dir):
    c = F.col
    n, part = c("l_linenumber"), c("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select((part % 400).alias("basket"), (n * 10 + part % 7).cast("long").alias("p0"), c("l_quantity").cast("long").alias("q0"), (n * 11 + part % 5).cast("long").alias("p1"), (c("l_quantity") + n % 3).cast("long").alias("q1"))
    return op.published_indices(rows.groupBy("basket").agg(*(F.sum(c(f"p{i}") * c(f"q{j}")).alias(f"s{i}{j}") for i in (0, 1) for j in (0, 1))), "basket")
