"""Accounts of firms, banks and nations over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import firms as op
from ..operators import reporting
from ..sources.adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KINDS = ("sales", "returns_in", "opening", "purchases", "returns_out", "carriage", "closing", "receipts", "payments", "accrued", "prepaid", "provision")
SIGNS = {
    "trading_profit": {"sales": 1, "returns_in": -1, "opening": -1, "purchases": -1, "returns_out": 1, "carriage": -1, "closing": 1},
    "goods_consumed": {"opening": 1, "purchases": 1, "returns_out": -1, "closing": -1},
    "income_of_the_year": {"receipts": 1, "accrued": 1, "prepaid": -1},
    "debtors_account": {"opening": 1, "sales": 1, "returns_in": -1, "receipts": -1, "provision": -1},
    "creditors_account": {"opening": 1, "purchases": 1, "returns_out": -1, "payments": -1},
    "receipts_less_payments": {"receipts": 1, "payments": -1, "carriage": -1},
    "special_fund": {"receipts": 1, "accrued": 1, "payments": -1},
    "profit_after_adjustments": {"closing": 1, "accrued": -1, "prepaid": 1, "provision": -1},
}


def _signs(spark):
    return spark.createDataFrame([(s, k, n) for s, kinds in SIGNS.items() for k, n in kinds.items()], "statement string, kind string, sign int")


def _kind(key: str, names: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))


def _kind_sql(key: str, names: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(n) for n in names)}][CAST({key} % {len(names)} + 1 AS INTEGER)]"


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18, 2))"


def total(kind: str, name: str, amount: str = "amount") -> str:
    return f"CAST(sum(CASE WHEN {kind} THEN {dec(amount)} ELSE 0 END) AS DOUBLE) AS {name}"


def _entries(spark, sf_dir, name, kinds):
    """Orders as entries of their customer, their kind by their key."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias(name), _kind("o_orderkey", kinds).alias("kind"), F.col("o_totalprice").alias("amount"))


def _sums(name, kinds):
    return f"s AS (SELECT o_custkey AS {name}, {', '.join(total(f'kind = {k!r}', k) for k in kinds)} FROM (SELECT o_custkey, {_kind_sql('o_orderkey', kinds)} AS kind, o_totalprice AS amount FROM orders) e GROUP BY 1)"


def _by_kind(spark, sf_dir, name, kinds):
    """A customer's orders summed by kind, a column for each."""
    return reporting.by_kind(_entries(spark, sf_dir, name, kinds), name, kinds)


def _lines_by_kind(spark, sf_dir, name, kinds):
    """A part's lines summed by kind, a column for each."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias(name), _kind("l_orderkey", kinds).alias("kind"), F.col("l_extendedprice").alias("amount"))
    return reporting.by_kind(rows, name, kinds)


def _line_sums(name, kinds):
    return f"s AS (SELECT l_partkey AS {name}, {', '.join(total(f'kind = {k!r}', k) for k in kinds)} FROM (SELECT l_partkey, {_kind_sql('l_orderkey', kinds)} AS kind, l_extendedprice AS amount FROM lineitem) e GROUP BY 1)"


MOVES = f"mv AS (SELECT o_custkey AS entity, {_kind_sql('o_orderkey', KINDS)} AS kind, o_totalprice AS amount FROM orders)"


def _moves(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), _kind("o_orderkey", KINDS).alias("kind"), F.col("o_totalprice").alias("amount"))


@query(f"WITH {MOVES}, sg AS (SELECT * FROM (VALUES {', '.join(f'({s!r}, {k!r}, {n})' for s, kinds in SIGNS.items() for k, n in kinds.items())}) t(statement, kind, sign)) SELECT entity, statement, CAST(sum({dec('amount')} * sign) AS DOUBLE) AS total FROM mv JOIN sg USING (kind) GROUP BY 1, 2")
def statements(spark, sf_dir):
    return op.statements(_moves(spark, sf_dir), _signs(spark), "entity")


@query(f"WITH {MOVES} SELECT entity, CAST(sum({dec('amount')} * CASE WHEN kind IN ('opening', 'purchases') THEN 1 WHEN kind IN ('returns_out', 'closing') THEN -1 ELSE 0 END) AS DOUBLE) AS cost FROM mv GROUP BY 1")
def cost_of_sales(spark, sf_dir):
    return op.cost_of_sales(_moves(spark, sf_dir), "entity")


@query("SELECT c_custkey AS entity, round(greatest(c_acctbal, 0) * 5.0::DOUBLE / 100, 6) AS before, round(greatest(c_acctbal, 0) * 5.0::DOUBLE / 105, 6) AS after FROM customer")
def commission(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("profit"))
    return op.commission(rows, 5.0).drop("profit")


@query("SELECT s_suppkey AS entity, round((abs(s_acctbal) * 10 - s_suppkey % 100) * 4.0::DOUBLE / 100, 6) AS closing, round(s_suppkey % 100 + (abs(s_acctbal) * 10 - s_suppkey % 100) * 4.0::DOUBLE / 100 - s_suppkey % 30, 6) AS charge FROM supplier")
def provision_charge(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("entity"), (F.abs("s_acctbal") * 10).alias("debtors"), (k % 100).cast("double").alias("bad_debts"), (k % 30).cast("double").alias("opening"))
    return op.provision_charge(rows, 4.0).select("entity", "closing", "charge")


@query("""WITH a AS (SELECT o_orderkey AS applicant, o_custkey AS category, CAST(o_orderkey % 500 + 10 AS DOUBLE) AS applied FROM orders), c AS (SELECT *, sum(applied) OVER (PARTITION BY category) AS ca, CAST(category % 900 + 100 AS DOUBLE) AS offered FROM a),
b AS (SELECT *, least(applied, floor(applied * least(CAST(1 AS DOUBLE), offered / ca))) AS allotted FROM c), e AS (SELECT *, (applied - allotted) * 3 AS excess FROM b), t AS (SELECT *, least(excess, allotted * 4) AS ta FROM e), u AS (SELECT *, least(excess - ta, allotted * 3) AS tc FROM t)
SELECT applicant, category, CAST(allotted AS DOUBLE) AS allotted, excess, ta AS to_allotment, tc AS to_calls, excess - ta - tc AS refund FROM u""")
def pro_rata_allotment(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("applicant"), F.col("o_custkey").alias("category"), (k % 500 + 10).cast("double").alias("applied"), (F.col("o_custkey") % 900 + 100).cast("double").alias("offered"), F.lit(3.0).alias("per_application"), F.lit(4.0).alias("per_allotment"), F.lit(3.0).alias("per_call"))
    found = op.allotment(rows)
    return found.select("applicant", "category", F.col("allotted").cast("double").alias("allotted"), "excess", "to_allotment", "to_calls", "refund")


@query("""WITH d AS (SELECT l_partkey AS issue_id, CAST(sum(l_quantity) AS BIGINT) AS units, 90 + l_partkey % 21 AS issue, 100 + l_partkey % 6 AS redeem FROM lineitem GROUP BY ALL)
SELECT issue_id, issue * units AS received, greatest(100 - issue, 0) * units AS discount, greatest(issue - 100, 0) * units AS premium, greatest(redeem - 100, 0) * units AS payable, (greatest(100 - issue, 0) + greatest(redeem - 100, 0)) * units AS loss FROM d""")
def debenture_issue(spark, sf_dir):
    """An issue for each part, of as many units as its lines have."""
    k = F.col("l_partkey")
    units = table(spark, sf_dir, "lineitem").groupBy(k.alias("issue_id")).agg(F.sum("l_quantity").cast("long").alias("units"))
    found = op.debenture_issue(units.withColumns({"issue": 90 + F.col("issue_id") % 21, "redeem": 100 + F.col("issue_id") % 6}))
    return found.select("issue_id", *(F.col(c).cast("long").alias(c) for c in ("received", "discount", "premium", "payable", "loss")))


BRANCH = ("stock", "debtors", "credit_sales", "received", "returns", "sent", "arrived")


@query(f"""WITH {_sums('branch', BRANCH)} SELECT branch, round(stock * 25.0::DOUBLE / 125, 6) AS stock_reserve, round(debtors + credit_sales - received - returns, 6) AS closing_debtors, round(greatest(sent - arrived, 0), 6) AS in_transit FROM s""")
def branch_accounts(spark, sf_dir):
    found = op.branch_accounts(_by_kind(spark, sf_dir, "branch", BRANCH), 25.0)
    return found.select("branch", "stock_reserve", F.round("closing_debtors", 6).alias("closing_debtors"), F.round("in_transit", 6).alias("in_transit"))


CREDITS = ("capital_cut", "losses", "creditors_cut", "losses", "revalued")


@query(f"""WITH {_sums('company', tuple(dict.fromkeys(CREDITS))).replace(_kind_sql('o_orderkey', tuple(dict.fromkeys(CREDITS))), _kind_sql('o_orderkey', CREDITS))}, b AS (SELECT *, capital_cut + creditors_cut + revalued AS c FROM s)
SELECT company, round(c, 6) AS credit, round(greatest(c - losses, 0), 6) AS to_reserve, round(greatest(losses - c, 0), 6) AS loss_left, round(capital_cut / nullif(c, 0), 6) AS share_of_holders FROM b""")
def reconstruction(spark, sf_dir):
    rows = reporting.by_kind(_entries(spark, sf_dir, "company", CREDITS), "company", tuple(dict.fromkeys(CREDITS)))
    found = op.reconstruction(rows)
    return found.select("company", *(F.round(c, 6).alias(c) for c in ("credit", "to_reserve", "loss_left")), "share_of_holders")


@query("""WITH p AS (SELECT o_custkey AS firm, o_orderkey AS partner, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS ratio, CAST(o_orderkey % 1000 AS DOUBLE) AS received FROM orders) SELECT firm, partner, round(sum(received) OVER w * ratio / sum(ratio) OVER w - received, 6) AS adjust FROM p WINDOW w AS (PARTITION BY firm)""")
def past_adjustment(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("firm"), k.alias("partner"), (k % 3 + 1).cast("double").alias("ratio"), (k % 1000).cast("double").alias("received"))
    return op.past_adjustment(rows, "firm").select("firm", "partner", "adjust")


@query(f"""WITH y AS (SELECT o_custkey AS firm, year(o_orderdate) AS yr, CAST(sum({dec('o_totalprice')}) AS DOUBLE) AS profit FROM orders GROUP BY 1, 2), s AS (SELECT firm, CAST(sum({dec('profit')}) AS DOUBLE) AS p, count(*) AS n, CAST(sum(CAST(profit * (yr - 1994) AS DECIMAL(20, 2))) AS DOUBLE) AS wp, sum(yr - 1994) AS w FROM y GROUP BY 1),
a AS (SELECT *, p / n AS av, CAST(firm % 7 * 500000 AS DOUBLE) AS cap FROM s) SELECT firm, round(av * 3, 6) AS by_average, round(wp / w * 3, 6) AS by_weighted, round(greatest(av - cap * 12.0::DOUBLE / 100, 0) * 3, 6) AS by_super_profit, round(greatest(av - cap * 12.0::DOUBLE / 100, 0) * CAST(2.4 AS DOUBLE), 6) AS by_annuity, round(greatest(av * 100 / 12.0::DOUBLE - cap, 0), 6) AS by_capital FROM a""")
def goodwill_methods(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("firm"), (F.year("o_orderdate") - 1994).alias("weight")).agg(op.whole("o_totalprice").alias("profit"))
    found = op.goodwill_methods(years.withColumn("capital", (F.col("firm") % 7 * 500000).cast("double")), 3.0, 12.0, 2.4)
    return found.withColumnRenamed("by_weight", "by_weighted")


BOOK = ("cash_in", "cash_out", "bank_in", "bank_out", "deposit")


@query(f"""WITH e AS (SELECT l_suppkey AS firm, {_kind_sql('l_orderkey', BOOK)} AS kind, {dec('l_extendedprice')} AS amount FROM lineitem) SELECT firm, CAST(sum(CASE kind WHEN 'cash_in' THEN amount WHEN 'cash_out' THEN -amount WHEN 'deposit' THEN -amount ELSE 0 END) AS DOUBLE) AS cash,
  CAST(sum(CASE kind WHEN 'bank_in' THEN amount WHEN 'bank_out' THEN -amount WHEN 'deposit' THEN amount ELSE 0 END) AS DOUBLE) AS bank, CAST(sum(CASE WHEN kind = 'cash_out' THEN amount ELSE 0 END) AS DOUBLE) AS imprest FROM e GROUP BY 1""")
def cash_book(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("firm"), _kind("l_orderkey", BOOK).alias("kind"), F.col("l_extendedprice").alias("amount"))
    return op.cash_book(rows, "firm")


GOODS = ("lost", "insured", "on_approval", "stock")


@query(f"""WITH {_line_sums('item', GOODS)} SELECT item, round(greatest(lost - insured, 0), 6) AS loss, round(on_approval - on_approval * 100 / (100 + (item % 50 + 1)), 6) AS unearned, round(stock + on_approval * 100 / (100 + (item % 50 + 1)), 6) AS closing FROM s""")
def stock_adjustments(spark, sf_dir):
    rows = _lines_by_kind(spark, sf_dir, "item", GOODS).withColumn("margin", F.col("item") % 50 + 1)
    return op.stock_adjustments(rows).select("item", F.round("loss", 6).alias("loss"), "unearned", "closing")


@query(f"""WITH d AS (SELECT o_custkey AS firm, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS bought, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS due, CASE WHEN o_orderkey % 2 = 0 THEN 'debt' ELSE 'deposit' END AS kind FROM orders)
SELECT firm, {total("kind = 'debt' AND due <= DATE '1998-06-30' + INTERVAL 12 MONTH", '"current"')}, {total("kind = 'debt' AND due > DATE '1998-06-30' + INTERVAL 12 MONTH", 'later')}, {total("kind = 'deposit' AND due <= bought + INTERVAL 3 MONTH", 'cash_equivalents')} FROM d GROUP BY 1""")
def maturities(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("firm"), F.col("o_totalprice").alias("amount"), day.alias("bought"), F.date_add(day, (k % 400).cast("int")).alias("due"), F.when(k % 2 == 0, "debt").otherwise("deposit").alias("kind"))
    return op.maturities(rows, "firm", "1998-06-30")


TAX = ("profit", "timing", "permanent", "loss", "certain")


@query(f"""WITH e AS (SELECT o_custkey AS company, {_kind_sql('o_orderkey', TAX)} AS kind, o_totalprice AS amount FROM orders), s AS (SELECT company, {', '.join(total(f"kind = '{k}'", k) for k in TAX)} FROM e GROUP BY 1)
SELECT company, round(greatest(profit + permanent - timing, 0) * 30.0::DOUBLE / 100, 6) AS "current", round(timing * 30.0::DOUBLE / 100, 6) AS deferred, round(least(loss, certain) * 30.0::DOUBLE / 100, 6) AS loss_asset FROM s""")
def taxes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), _kind("o_orderkey", TAX).alias("kind"), F.col("o_totalprice").alias("amount"))
    return op.taxes(rows, "company", 30.0)


@query("""WITH c AS (SELECT o_orderkey AS contract, DATE '1998-01-01' AS begins, CAST(DATE '1998-01-01' + to_months(CAST(o_orderkey % 11 + 1 AS INTEGER)) AS DATE) AS ends, o_orderkey % 11 + 1 AS term, CAST(60 + o_custkey % 5 AS DOUBLE) AS spot, CAST(61 + o_custkey % 7 AS DOUBLE) AS forward, CAST(62 + o_custkey % 3 AS DOUBLE) AS closing, CAST(60 + o_custkey % 11 AS DOUBLE) AS remaining, CAST(o_orderkey % 100 AS DOUBLE) AS units, o_orderkey % 4 = 0 AS speculates FROM orders)
SELECT contract, CASE WHEN NOT speculates THEN round((forward - spot) * units * (CAST(least(term, 3) AS DOUBLE) / term), 6) END AS premium, CASE WHEN speculates THEN round((remaining - forward) * units, 6) END AS gain, round(closing * units, 6) AS restated FROM c""")
def forward_contracts(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    begins = F.lit("1998-01-01").cast("date")
    rows = table(spark, sf_dir, "orders").select(k.alias("contract"), begins.alias("begins"), F.add_months(begins, (k % 11 + 1).cast("int")).alias("ends"), (60.0 + c % 5).alias("spot"), (61.0 + c % 7).alias("forward"), (62.0 + c % 3).alias("closing"), (60.0 + c % 11).alias("remaining"), (k % 100).cast("double").alias("units"), (k % 4 == 0).alias("speculates"))
    return op.forward_contracts(rows, "1998-04-01").select("contract", "premium", "gain", "restated")


GRANTED = ("cost", "grant", "refund")


@query(f"""WITH {_line_sums('asset', GRANTED).replace(' AS grant,', ' AS granted,')} SELECT asset, round((cost - granted) / 10, 6) AS charge_if_deducted, round(granted / 10, 6) AS income_if_deferred, round(least(refund, granted * (10 - asset % 10) / 10), 6) AS against_deferred, round(greatest(refund - granted * (10 - asset % 10) / 10, 0), 6) AS to_profit FROM s""")
def grants(spark, sf_dir):
    rows = _lines_by_kind(spark, sf_dir, "asset", GRANTED).withColumns({"life": F.lit(10), "years": F.col("asset") % 10})
    return op.grants(rows).select("asset", "charge_if_deducted", "income_if_deferred", "against_deferred", "to_profit")


BENEFITS = ("obligation", "plan_assets", "unrecognised", "ceiling")


@query(f"""WITH e AS (SELECT o_custkey AS company, {_kind_sql('o_orderkey', BENEFITS)} AS kind, o_totalprice AS amount, o_custkey % 20 AS cut FROM orders), s AS (SELECT company, min(cut) AS cut, {', '.join(total(f"kind = '{k}'", k) for k in BENEFITS)} FROM e GROUP BY 1)
SELECT company, round(greatest(obligation - plan_assets - unrecognised, 0), 6) AS liability, round(least(greatest(plan_assets + unrecognised - obligation, 0), ceiling), 6) AS asset, round((obligation - unrecognised) * cut / 100, 6) AS curtailment FROM s""")
def benefit_obligation(spark, sf_dir):
    """Plans of customers, whose orders are their obligations, assets, unrecognised cost and ceilings."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), _kind("o_orderkey", BENEFITS).alias("kind"), F.col("o_totalprice").alias("amount"))
    rows = reporting.by_kind(rows, "company", BENEFITS).withColumn("curtailed", F.col("company") % 20)
    found = op.benefit_obligation(rows)
    return found.select("company", F.round("liability", 6).alias("liability"), F.round("asset", 6).alias("asset"), "curtailment")


@query("""WITH l AS (SELECT p_partkey AS lease, p_retailprice * 4 AS fair, p_retailprice AS payment, CAST(p_size % 5 + 6 AS DOUBLE) AS rate, p_size % 6 + 3 AS n, 2 AS k FROM part), i AS (SELECT *, rate / 100 AS i FROM l), v AS (SELECT *, least(fair, payment * (1 - pow(1 + i, -n)) / i) AS first FROM i)
SELECT lease, round(first, 4) AS initial, round(first * pow(1 + i, k) - payment * (pow(1 + i, k) - 1) / i, 4) AS after FROM v""")
def finance_lease(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lease"), (F.col("p_retailprice") * 4).alias("fair"), F.col("p_retailprice").alias("payment"), (F.col("p_size") % 5 + 6).cast("double").alias("rate"), (F.col("p_size") % 6 + 3).alias("n"), F.lit(2).alias("k"))
    return op.finance_lease(rows).select("lease", "initial", "after")


@query("""WITH f AS (SELECT c_custkey AS firm, CAST(c_custkey % 900 + 100 AS DOUBLE) AS o, CAST(c_custkey % 1100 + 150 AS DOUBLE) AS c, CAST(100 AS DOUBLE) AS a, CAST(100 + c_custkey % 20 AS DOUBLE) AS b, CAST(c_custkey % 60 AS DOUBLE) AS u, CAST(c_custkey % 9 + 1 AS DOUBLE) AS p FROM customer)
SELECT firm, c - o AS financial, round(o * b / a, 6) AS restated, round(c - o * b / a, 6) AS real, round(c - u * p, 6) AS physical FROM f""")
def purchasing_power(spark, sf_dir):
    k = F.col("c_custkey")
    of = lambda x: x.cast("double")
    rows = table(spark, sf_dir, "customer").select(k.alias("firm"), of(k % 900 + 100).alias("opening"), of(k % 1100 + 150).alias("closing"), F.lit(100.0).alias("index_open"), of(100 + k % 20).alias("index_close"), of(k % 60).alias("units"), of(k % 9 + 1).alias("price_close"))
    return op.purchasing_power(rows).select("firm", "financial", "restated", "real", "physical")


NATION_YEAR = f"""ny AS (SELECT c_nationkey AS country, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum({dec('o_totalprice')}) AS DOUBLE) AS nominal, CAST(sum(CASE WHEN o_orderkey % 3 > 0 THEN {dec('o_totalprice')} ELSE 0 END) AS DOUBLE) AS consumption, CAST(count(*) * 250000 AS DOUBLE) AS real, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS people FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query(f"""WITH {NATION_YEAR}, m AS (SELECT *, (consumption - lag(consumption) OVER w) / nullif(nominal - lag(nominal) OVER w, 0) AS mpc FROM ny WINDOW w AS (PARTITION BY country ORDER BY year))
SELECT country, year, round(100 * nominal / real, 6) AS deflator, round(real / people, 6) AS per_head, round(consumption / nominal, 6) AS average_propensity, round(mpc, 6) AS marginal_propensity, CASE WHEN mpc >= 0 AND mpc < 0.99 THEN round(1 / (1 - mpc), 6) END AS multiplier FROM m""")
def national_accounts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    years = rows.groupBy(F.col("c_nationkey").alias("country"), F.year("o_orderdate").alias("year")).agg(
        op.whole("o_totalprice").alias("nominal"), op.whole(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).otherwise(0.0)).alias("consumption"), (F.count("*") * 250000).cast("double").alias("real"), F.count_distinct("o_custkey").cast("double").alias("people")
    )
    return op.national_accounts(years, "country")


MONEY = ("currency", "demand", "other", "time")


@query(f"""WITH e AS (SELECT c_nationkey AS country, {_kind_sql('c_custkey', MONEY)} AS kind, abs(c_acctbal) AS amount FROM customer), s AS (SELECT country, {total("kind <> 'time'", 'm1')}, {total('true', 'm3')}, {total("kind = 'demand'", '"primary"')} FROM e GROUP BY 1)
SELECT *, round("primary" * 100 / 20.0::DOUBLE, 6) AS created, round("primary" * 100 / 20.0::DOUBLE - "primary", 6) AS derived FROM s""")
def money_supply(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("country"), _kind("c_custkey", MONEY).alias("kind"), F.abs("c_acctbal").alias("amount"))
    return op.money_supply(rows, "country", 20.0)


BUDGET = ("revenue_in", "revenue_out", "capital_in", "capital_out", "interest")


@query(f"""WITH e AS (SELECT c_nationkey AS country, {_kind_sql('c_custkey', BUDGET)} AS kind, abs(c_acctbal) AS amount FROM customer), s AS (SELECT country, {', '.join(total(f"kind = '{k}'", k) for k in BUDGET)} FROM e GROUP BY 1)
SELECT country, revenue_out + interest - revenue_in AS revenue_deficit, revenue_out + interest + capital_out - revenue_in - capital_in AS fiscal_deficit, revenue_out + interest + capital_out - revenue_in - capital_in - interest AS primary_deficit FROM s""")
def budget_deficits(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("country"), _kind("c_custkey", BUDGET).alias("kind"), F.abs("c_acctbal").alias("amount"))
    found = op.budget_deficits(rows, "country")
    return found.select("country", *(F.round(c, 4).alias(c) for c in ("revenue_deficit", "fiscal_deficit", "primary_deficit")))


ORACLES["budget_deficits"] = f"SELECT country, round(revenue_deficit, 4) AS revenue_deficit, round(fiscal_deficit, 4) AS fiscal_deficit, round(primary_deficit, 4) AS primary_deficit FROM ({ORACLES['budget_deficits']})"

TRADE = ("export", "import", "service_in", "service_out", "transfer_in")


@query(f"""WITH e AS (SELECT c_nationkey AS country, {_kind_sql('o_orderkey', TRADE)} AS kind, o_totalprice AS amount, CAST(o_orderkey % 9 AS DOUBLE) AS units FROM orders JOIN customer ON c_custkey = o_custkey), s AS (SELECT country, {total("kind = 'export'", 'x')}, {total("kind = 'import'", 'm')}, {total("kind IN ('service_in', 'transfer_in')", 's')}, {total("kind = 'service_out'", 't')}, sum(CASE WHEN kind = 'import' THEN units ELSE 0 END) AS u FROM e GROUP BY 1)
SELECT country, round(x - m, 4) AS trade, round(x - m + s - t, 4) AS "current", round(u * 2.5::DOUBLE + m * 8.0::DOUBLE / 100, 6) AS tariff, round(100 * x / nullif(m, 0), 6) AS terms FROM s""")
def trade_balance(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = joined.select(F.col("c_nationkey").alias("country"), _kind("o_orderkey", TRADE).alias("kind"), F.col("o_totalprice").alias("amount"), (F.col("o_orderkey") % 9).cast("double").alias("units"))
    return op.trade_balance(rows, "country", 2.5, 8.0).withColumns({c: F.round(c, 4) for c in ("trade", "current")})


ASSET = """ast AS (SELECT p_partkey AS asset, p_retailprice * 10 AS cost, p_retailprice AS residual, p_size % 8 + 3 AS life, p_size % 6 AS years, p_partkey % 12 + 1 AS months, CAST(p_size * 20 AS DOUBLE) AS produced, CAST(2000 AS DOUBLE) AS capacity, CAST(p_partkey % 9000 AS DOUBLE) AS sold_for, CAST(p_size % 20 + 5 AS DOUBLE) AS rate FROM part)"""


def _assets(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("asset"), (F.col("p_retailprice") * 10).alias("cost"), F.col("p_retailprice").alias("residual"), (s % 8 + 3).alias("life"), (s % 6).alias("years"), (k % 12 + 1).alias("months"), (s * 20).cast("double").alias("produced"), F.lit(2000.0).alias("capacity"), (k % 9000).cast("double").alias("sold_for"), (s % 20 + 5).cast("double").alias("rate"))


@query(f"""WITH {ASSET}, c AS (SELECT *, (cost - residual) / life AS y, greatest(cost - (cost - residual) / life * years, 0) AS left_ FROM ast) SELECT asset, round(y * months / 12, 6) AS first_year, round((cost - residual) * produced / capacity, 6) AS by_use, round(greatest(sold_for - left_, 0), 6) AS gain, round(greatest(left_ - sold_for, 0), 6) AS loss FROM c""")
def asset_disposal(spark, sf_dir):
    return op.asset_disposal(_assets(spark, sf_dir)).select("asset", "first_year", "by_use", "gain", "loss")


@query(f"""WITH {ASSET}, c AS (SELECT asset, cost * (1 - pow(1 - rate / 100, years)) AS w, (cost - residual) / life * least(years, life) AS s FROM ast) SELECT asset, round(w, 3) AS charged, round(s, 6) AS would_be, round(w - s, 3) AS difference FROM c""")
def method_change(spark, sf_dir):
    return op.method_change(_assets(spark, sf_dir)).select("asset", "charged", "would_be", "difference")


EARNINGS = ("earnings", "earnings_before", "shares", "shares_before", "saved", "potential")


@query(f"""WITH {_sums('company', EARNINGS)}, e AS (SELECT company, earnings AS e, earnings_before AS eb, shares + 1 AS s, shares_before + 1 AS sb, CAST(company % 3 AS DOUBLE) / 4 AS bonus, saved, potential AS pot FROM s)
SELECT company, round(e / (s * (1 + bonus)), 6) AS basic, round(eb / (sb * (1 + bonus)), 6) AS before_restated, round(least(e / (s * (1 + bonus)), (e + saved) / (s * (1 + bonus) + pot)), 6) AS diluted FROM e""")
def restated_eps(spark, sf_dir):
    rows = _by_kind(spark, sf_dir, "company", EARNINGS).withColumns({"shares": F.col("shares") + 1, "shares_before": F.col("shares_before") + 1, "bonus": (F.col("company") % 3).cast("double") / 4})
    return op.restated_eps(rows).select("company", "basic", "before_restated", "diluted")


@query("""WITH o AS (SELECT l_orderkey AS claim, l_linenumber AS outcome, max(CAST(l_quantity AS DOUBLE)) AS chance, max(CASE WHEN l_linestatus = 'O' THEN round(l_extendedprice, 0) ELSE 0 END) AS amount FROM lineitem GROUP BY 1, 2), n AS (SELECT *, chance / 50 AS c FROM o)
SELECT claim, round(sum(c * amount), 6) AS expected, max_by(amount, c * 1e9 + amount) AS likeliest, max_by(amount, c * 1e9 + amount) > 0 AS provide FROM n GROUP BY 1""")
def expected_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("outcome")).agg((F.max("l_quantity") / 50).alias("chance"), F.max(F.when(F.col("l_linestatus") == "O", F.round("l_extendedprice", 0)).otherwise(0.0)).alias("amount"))
    return op.expected_loss(rows, "claim")


@query("""WITH c AS (SELECT o_orderkey AS claim_id, o_custkey AS debtor, round(o_totalprice, 0) AS claim, CAST(o_custkey % 100 * 20000 AS DOUBLE) AS assets FROM orders), r AS (SELECT *, least(1, assets / sum(claim) OVER (PARTITION BY debtor)) AS rate FROM c)
SELECT claim_id, debtor, round(claim * rate, 6) AS dividend, round(claim - claim * rate, 6) AS bad FROM r""")
def insolvency_dividend(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("debtor"), F.round("o_totalprice", 0).alias("claim"), (F.col("o_custkey") % 100 * 20000).cast("double").alias("assets"))
    return op.insolvency_dividend(rows, "debtor").select("claim_id", "debtor", "dividend", "bad")


ASSOCIATE = ("cost", "results", "dividends", "assets")


@query(f"""WITH {_sums('associate', ASSOCIATE)}, v AS (SELECT *, CAST(20 + associate % 31 AS DOUBLE) AS share, cost + CAST(20 + associate % 31 AS DOUBLE) / 100 * (results - 150000) - CAST(20 + associate % 31 AS DOUBLE) / 100 * dividends AS v FROM s)
SELECT associate, round(greatest(v, 0), 6) AS carrying, round(greatest(-v, 0), 6) AS unrecognised, round(share / 100 * assets, 6) AS venture_share FROM v""")
def equity_method(spark, sf_dir):
    """Results are less a loss of 150,000, so that some associates are worth nothing."""
    rows = _by_kind(spark, sf_dir, "associate", ASSOCIATE).withColumns({"share": (20 + F.col("associate") % 31).cast("double"), "results": F.col("results") - 150_000})
    return op.equity_method(rows).select("associate", "carrying", "unrecognised", "venture_share")


NEWCOMER = ("brought", "capitals", "revalued_assets", "revalued_debts")


@query(f"""WITH {_sums('newcomer', NEWCOMER)}, n AS (SELECT *, CAST(newcomer % 4 + 1 AS DOUBLE) / 10 AS share FROM s)
SELECT newcomer, round(brought / share, 6) AS implied, round(greatest(brought / share - capitals - brought, 0), 6) AS hidden, round(revalued_assets - revalued_debts, 6) AS revaluation FROM n""")
def hidden_goodwill(spark, sf_dir):
    rows = _by_kind(spark, sf_dir, "newcomer", NEWCOMER).withColumn("share", (F.col("newcomer") % 4 + 1).cast("double") / 10)
    return op.hidden_goodwill(rows).select("newcomer", "implied", "hidden", F.round("revaluation", 6).alias("revaluation"))


@query("""WITH f AS (SELECT o_custkey AS firm, o_orderkey % 3 AS project, year(o_orderdate) - 1995 AS t, CASE WHEN year(o_orderdate) = 1995 THEN -o_totalprice ELSE o_totalprice / 4 END AS amount FROM orders), n AS (SELECT firm, project, sum(amount / pow(CAST(1.08 AS DOUBLE), t)) AS npv FROM f GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY round(npv, 6) DESC, project) AS i, count(*) OVER (PARTITION BY firm) AS projects FROM n) SELECT firm, project, round(npv, 4) AS npv, projects FROM r WHERE i = 1""")
def best_project(spark, sf_dir):
    y = F.year("o_orderdate")
    flows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("firm"), (F.col("o_orderkey") % 3).alias("project"), (y - 1995).alias("t"), F.when(y == 1995, -F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 4).alias("amount"), F.lit(0.08).alias("rate"))
    return op.best_project(flows, "firm")


@query("""WITH d AS (SELECT o_orderkey AS fund_id, o_totalprice AS fund, CAST(o_orderkey % 9 + 1 AS DOUBLE) / 100 AS rate, o_orderkey % 20 + 5 AS n, o_orderkey % 5 AS k FROM orders), p AS (SELECT *, fund * rate / (1 - pow(1 + rate, -n)) AS pay FROM d)
SELECT fund_id, round(pay, 4) AS pays, round(fund * pow(1 + rate, k) - pay * (pow(1 + rate, k) - 1) / rate, 4) AS "left" FROM p""")
def draw_down(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("fund_id"), F.col("o_totalprice").alias("fund"), ((k % 9 + 1).cast("double") / 100).alias("rate"), (k % 20 + 5).alias("n"), (k % 5).alias("k"))
    return op.draw_down(rows).select("fund_id", "pays", "left")


@query("""WITH f AS (SELECT l_suppkey AS series, l_quantity AS x, count(*) AS f FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(f) OVER (PARTITION BY series ORDER BY x) AS upto, sum(f) OVER (PARTITION BY series) AS n FROM f) SELECT series, min(x) AS median, CAST(max(n) AS BIGINT) AS n FROM c WHERE upto * 2 >= n GROUP BY 1""")
def grouped_median(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("series"), F.col("l_quantity").alias("x")).agg(F.count("*").alias("f"))
    return op.grouped_median(counts, "series")


@query("""WITH s AS (SELECT o_custkey AS learner_id, CAST(year(o_orderdate) AS INTEGER) AS sitting, o_orderkey * 7 % 101 AS pct FROM orders), t AS (SELECT learner_id, sitting, count(*) AS papers, min(pct) AS lo, sum(pct) AS total, count(*) FILTER (WHERE pct >= 60) AS high FROM s GROUP BY 1, 2)
SELECT learner_id, sitting, papers, lo >= 40 AND total >= 50 * papers AS passed, CASE WHEN lo >= 40 AND total >= 50 * papers THEN 0 ELSE high END AS exempt FROM t""")
def sitting_results(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("learner_id"), F.year("o_orderdate").alias("sitting"), (F.col("o_orderkey") * 7 % 101).alias("pct"))
    return op.sitting_results(rows)
