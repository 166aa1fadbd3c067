"""Ledger operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as op
from ..sources import adapters as a
from ..sources.adapters import LOAN, POSTING, STOCK, table

QUERIES, ORACLES = {}, {}


def halves_up(sql: str) -> str:
    """The SQL with the nudge of ``money`` in each rounding to its places."""
    out, mark = "", f", {op.PLACES})"
    while (at := sql.find("round(")) >= 0:
        end, depth = at + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = halves_up(sql[at + 6 : end - 1])
        if sql[:end].endswith(mark):
            inner = f"({inner.rpartition(',')[0]}) + {op.NUDGE:.0e}, {op.PLACES}"
        out, sql = f"{out}{sql[:at]}round({inner})", sql[end:]
    return out + sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = halves_up(sql)
        return f

    return add


ISSUED = f"""{STOCK}, issued AS (SELECT item_id, sum(units) AS issued FROM issue GROUP BY 1),
tot AS (SELECT l.item_id, bought, cost, coalesce(issued, 0) AS issued FROM (SELECT item_id, sum(units) AS bought, sum(units * rate) AS cost FROM lot GROUP BY 1) l LEFT JOIN issued USING (item_id))"""


def _ordered_stock(direction: str) -> str:
    return f"""WITH {ISSUED}, c AS (SELECT item_id, units, rate, sum(units) OVER (PARTITION BY item_id ORDER BY ts {direction}, k1 {direction}, k2 {direction}, k3 {direction}, k4 {direction}, k5 {direction} ROWS UNBOUNDED PRECEDING) AS cum FROM lot),
v AS (SELECT c.item_id, sum(greatest(0, least(units, cum - tot.issued)) * rate) AS v FROM c JOIN tot ON tot.item_id = c.item_id GROUP BY 1)
SELECT tot.item_id, bought - issued AS units, CASE WHEN bought >= issued THEN round(v, 5) END AS value, bought < issued AS short FROM tot JOIN v ON v.item_id = tot.item_id"""


def _stock(spark, sf_dir, method):
    return op.closing_stock(a.lots(spark, sf_dir), a.issues(spark, sf_dir), method)


@query(_ordered_stock("ASC"))
def fifo_value(spark, sf_dir):
    return _stock(spark, sf_dir, "fifo")


@query(_ordered_stock("DESC"))
def lifo_value(spark, sf_dir):
    return _stock(spark, sf_dir, "lifo")


@query(f"""WITH {ISSUED} SELECT item_id, bought - issued AS units, CASE WHEN bought >= issued THEN round(cost / bought * (bought - issued), 5) END AS value, bought < issued AS short FROM tot""")
def periodic_average_value(spark, sf_dir):
    return _stock(spark, sf_dir, "periodic")


@query("""WITH RECURSIVE mv AS MATERIALIZED (SELECT item_id, units, rate, row_number() OVER (PARTITION BY item_id ORDER BY ts, k1, k2, k3, k4, k5, units, rate) AS i, count(*) OVER (PARTITION BY item_id) AS n
  FROM (SELECT l_partkey AS item_id, l_shipdate AS ts, l_orderkey AS k1, l_linenumber AS k2, l_suppkey AS k3, l_quantity AS k4, l_extendedprice AS k5, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity / 2 END AS units, CASE WHEN l_linestatus = 'O' THEN l_extendedprice / l_quantity ELSE 0 END AS rate FROM lineitem WHERE l_linestatus IN ('O', 'F')) m),
f AS (SELECT item_id, n, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v FROM mv WHERE i = 1
UNION ALL SELECT f.item_id, f.n, mv.i, u + units, CASE WHEN units > 0 THEN v + units * mv.rate WHEN u > 0 THEN v + units * (v / u) ELSE v END FROM f JOIN mv ON mv.item_id = f.item_id AND mv.i = f.i + 1)
SELECT item_id, round(u, 4) AS units, round(v, 5) AS value FROM f WHERE i = n""")
def moving_average_value(spark, sf_dir):
    lots = a.lots(spark, sf_dir).select("item_id", "ts", "seq", "units", "rate")
    out = a.issues(spark, sf_dir).select("item_id", "ts", "seq", (-F.col("units")).alias("units"), F.lit(0.0).alias("rate"))
    return op.moving_average(lots.unionByName(out))


@query("""SELECT l_suppkey AS entity, round(sum(least(l_extendedprice, l_extendedprice * (1 + l_tax - l_discount * 2))), 5) AS carried,
  round(sum(greatest(0, l_extendedprice - l_extendedprice * (1 + l_tax - l_discount * 2))), 5) AS write_down FROM lineitem GROUP BY 1""")
def cost_or_nrv(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_extendedprice").alias("cost"), (F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount") * 2)).alias("nrv"))
    return op.lower_of_cost_and_nrv(lines, "entity")


@query("""WITH t AS (SELECT l_suppkey AS shop, sum(CASE WHEN l_linestatus = 'F' THEN -l_extendedprice ELSE l_extendedprice END) AS v FROM lineitem GROUP BY 1)
SELECT shop, round(v, 5) AS retail, round(v * (1 - 0.25), 5) AS cost FROM t""")
def retail_stock(spark, sf_dir):
    moves = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("shop"), F.when(F.col("l_linestatus") == "F", "sale").otherwise("purchase").alias("kind"), F.col("l_extendedprice").alias("amount"))
    return op.retail_stock(moves, "shop", 0.25)


@query(f"""WITH {POSTING}, s AS (SELECT account, round(sum(CASE WHEN side = 'dr' THEN amount ELSE 0 END), 5) AS dr, round(sum(CASE WHEN side = 'cr' THEN amount ELSE 0 END), 5) AS cr FROM post GROUP BY 1)
SELECT account, dr, cr, abs(round(dr - cr, 5)) AS balance, CASE WHEN round(dr - cr, 5) > 0 THEN 'dr' WHEN round(dr - cr, 5) < 0 THEN 'cr' END AS side, greatest(dr, cr) AS ruled_at FROM s""")
def ledger_balance(spark, sf_dir):
    return op.ledger_balance(a.postings(spark, sf_dir))


@query(f"""WITH {POSTING}, n AS (SELECT account, sum(CAST(CASE WHEN side = 'dr' THEN amount ELSE -amount END AS DECIMAL(20, 2))) AS net FROM post GROUP BY 1)
SELECT count(*) AS accounts, CAST(sum(greatest(net, 0)) AS DOUBLE) AS debit, CAST(sum(greatest(-net, 0)) AS DOUBLE) AS credit, sum(greatest(net, 0)) = sum(greatest(-net, 0)) AS agrees FROM n""")
def trial_balance(spark, sf_dir):
    return op.trial_balance(a.postings(spark, sf_dir))


@query(f"""WITH {POSTING}, g AS (SELECT entry, round(sum(CASE WHEN side = 'dr' THEN amount ELSE -amount END), 5) AS gap FROM post WHERE NOT (entry % 10 = 3 AND side = 'cr') AND NOT (entry % 10 = 7 AND side = 'dr') GROUP BY 1)
SELECT entry, abs(gap) AS amount, CASE WHEN gap > 0 THEN 'cr' ELSE 'dr' END AS suspense_side, CASE WHEN gap > 0 THEN 'dr' ELSE 'cr' END AS cleared_by FROM g WHERE gap <> 0""")
def suspense_account(spark, sf_dir):
    return op.suspense(a.postings(spark, sf_dir).filter("NOT (entry % 10 = 3 AND side = 'cr') AND NOT (entry % 10 = 7 AND side = 'dr')"))


SIGNED = {
    # name: (group column, kind column, amount column, signs)
    "profit_adjustments": ("o_custkey", "o_orderpriority", "o_totalprice", {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": -1, "5-LOW": -0.5}),
    "cash_by_activity": ("o_custkey", "o_orderstatus", "o_totalprice", {"O": 1, "F": -1}),
    "control_account": ("l_suppkey", "l_returnflag", "l_extendedprice", {"N": 1, "R": -1, "A": -0.02}),
    "bank_reconciliation": ("l_orderkey", "l_linestatus", "l_extendedprice", {"O": 1, "F": -1}),
}
TABLE = {"o": "orders", "l": "lineitem"}


def _signed(name):
    key, kind, amount, signs = SIGNED[name]

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, TABLE[key[0]]).select(F.col(key).alias("entity"), F.col(kind).alias("kind"), F.col(amount).alias("amount"))
        return op.signed_total(rows, "entity", signs)

    case = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in signs.items())
    QUERIES[name] = run
    ORACLES[name] = halves_up(f"SELECT {key} AS entity, round(sum({amount} * CASE {kind} {case} ELSE 0 END), 5) AS total FROM {TABLE[key[0]]} GROUP BY 1")


for _name in SIGNED:
    _signed(_name)


@query(f"""WITH {POSTING} SELECT account, count(*) FILTER (WHERE entry % 50 = 7) AS unknown, CASE WHEN count(*) FILTER (WHERE entry % 50 = 7) = 1 THEN
  round(-sum(CASE WHEN entry % 50 = 7 THEN NULL WHEN side = 'dr' THEN amount ELSE -amount END), 5) END AS missing FROM post GROUP BY 1""")
def missing_side(spark, sf_dir):
    rows = a.postings(spark, sf_dir).withColumn("amount", F.when(F.col("entry") % 50 != 7, F.col("amount")))
    return op.missing_side(rows, "account")


@query("""WITH o AS (SELECT o_orderkey AS k, round(o_totalprice, 0) AS a FROM orders WHERE o_orderkey % 5 <> 0), t AS (SELECT l_orderkey AS k, round(max(l_extendedprice), 0) AS a FROM lineitem GROUP BY 1)
SELECT coalesce(o.k, t.k) AS k, o.a AS our_amount, t.a AS their_amount, CASE WHEN t.a IS NULL THEN 'not in theirs' WHEN o.a IS NULL THEN 'not in ours' WHEN o.a = t.a THEN 'agreed' ELSE 'differs' END AS status FROM o FULL JOIN t ON o.k = t.k""")
def reconcile_books(spark, sf_dir):
    ours = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 0).alias("amount"))
    theirs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.max("l_extendedprice"), 0).alias("amount"))
    return op.reconcile(ours, theirs, "k")


CLAIMS = "claim AS (SELECT o_custkey AS debtor, o_orderkey AS claim_id, o_totalprice AS due, c_acctbal * 100 AS available, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS tier FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0)"


def _claims(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_custkey").alias("debtor"), F.col("o_orderkey").alias("claim_id"), F.col("o_totalprice").alias("due"), (F.col("c_acctbal") * 100).alias("available"), F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"))


@query(f"""WITH {CLAIMS}, p AS (SELECT *, coalesce(sum(due) OVER (PARTITION BY debtor ORDER BY claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM claim)
SELECT debtor, claim_id, round(greatest(0, least(due, available - prev)), 5) AS applied, round(due - greatest(0, least(due, available - prev)), 5) AS unpaid FROM p""")
def waterfall(spark, sf_dir):
    return op.waterfall(_claims(spark, sf_dir), "debtor", "claim_id").select("debtor", "claim_id", "applied", "unpaid")


@query(f"""WITH {CLAIMS}, t AS (SELECT debtor, tier, available, sum(due) AS td FROM claim GROUP BY 1, 2, 3),
r AS (SELECT debtor, tier, least(1, greatest(0, available - coalesce(sum(td) OVER (PARTITION BY debtor ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / td) AS rate FROM t)
SELECT claim.debtor, claim_id, claim.tier, round(due * rate, 5) AS paid FROM claim JOIN r ON r.debtor = claim.debtor AND r.tier = claim.tier""")
def rateable_settlement(spark, sf_dir):
    return op.tiered(_claims(spark, sf_dir), "debtor").select("debtor", "claim_id", "tier", "paid")


@query(f"""WITH {CLAIMS} SELECT debtor, claim_id, round(due * least(1, available / sum(due) OVER (PARTITION BY debtor)), 5) AS share FROM claim""")
def scaled_claims(spark, sf_dir):
    return op.scaled_claims(_claims(spark, sf_dir), "debtor", "due").select("debtor", "claim_id", "share")


PARTNERS = "partner AS (SELECT s_nationkey AS firm, s_suppkey AS partner_id, (s_suppkey % 4 + 1) * 1.0 AS ratio, CASE WHEN s_suppkey % 7 = 0 THEN 40000.0 END AS guarantee, 100000.0 + s_nationkey * 10000 AS profit FROM supplier)"


def _partners(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("firm"), F.col("s_suppkey").alias("partner_id"), (F.col("s_suppkey") % 4 + 1.0).alias("ratio"), F.when(F.col("s_suppkey") % 7 == 0, 40000.0).alias("guarantee"), (100000.0 + F.col("s_nationkey") * 10000).alias("profit"))


@query(f"""WITH {PARTNERS}, s AS (SELECT *, CAST(profit AS DOUBLE) * ratio / sum(ratio) OVER (PARTITION BY firm) AS own FROM partner), l AS (SELECT *, greatest(0, coalesce(guarantee, 0) - own) AS lack FROM s),
b AS (SELECT *, CASE WHEN lack > 0 THEN 0 ELSE CAST(ratio AS DOUBLE) END AS bears FROM l)
SELECT firm, partner_id, round(own + lack - sum(lack) OVER (PARTITION BY firm) * bears / nullif(sum(bears) OVER (PARTITION BY firm), 0), 5) AS share FROM b""")
def guaranteed_shares(spark, sf_dir):
    return op.guaranteed_shares(_partners(spark, sf_dir), "firm").select("firm", "partner_id", "share")


@query(f"""WITH {PARTNERS}, o AS (SELECT *, CASE WHEN partner_id % 5 = 0 THEN NULL ELSE CAST(ratio AS DOUBLE) / sum(CASE WHEN partner_id % 5 = 0 THEN 0 ELSE ratio END) OVER (PARTITION BY firm) END AS old_share, 1.0 / count(*) OVER (PARTITION BY firm) AS new_share FROM partner)
SELECT firm, partner_id, round(greatest(0, coalesce(old_share, 0) - new_share), 6) AS sacrifice, round(greatest(0, new_share - coalesce(old_share, 0)), 6) AS gain, round((new_share - coalesce(old_share, 0)) * profit, 5) AS goodwill_due FROM o""")
def goodwill_settlement(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("firm")
    newcomer = F.col("partner_id") % 5 == 0
    rows = _partners(spark, sf_dir).withColumns({"old_share": F.when(~newcomer, F.col("ratio") / F.sum(F.when(newcomer, 0.0).otherwise(F.col("ratio"))).over(w)), "new_share": 1.0 / F.count("*").over(w), "goodwill": F.col("profit")})
    return op.ratio_change(rows, "firm").select("firm", "partner_id", "sacrifice", "gain", "goodwill_due")


@query("""WITH u AS (SELECT ps.unit, item, amount, item % 6 = 0 AS g, total * 0.3 AS loss FROM (SELECT p_size AS unit, p_partkey AS item, p_retailprice AS amount, sum(p_retailprice) OVER (PARTITION BY p_size) AS total FROM part) ps),
t AS (SELECT *, sum(CASE WHEN g THEN amount ELSE 0 END) OVER (PARTITION BY unit) AS gw, sum(CASE WHEN g THEN 0 ELSE amount END) OVER (PARTITION BY unit) AS ot FROM u)
SELECT unit, item, round(CASE WHEN g THEN CASE WHEN gw > 0 THEN least(loss, gw) * amount / gw ELSE 0 END WHEN ot > 0 THEN least(amount, (loss - least(loss, gw)) * amount / ot) ELSE 0 END, 5) AS charged FROM t""")
def impairment(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("unit"), F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("amount"), (F.col("p_partkey") % 6 == 0).alias("is_goodwill"))
    rows = rows.withColumn("loss", F.sum("amount").over(Window.partitionBy("unit")) * 0.3)
    return op.impairment(rows, "unit").select("unit", "item", "charged")


ASSETS = "asset AS (SELECT p_partkey AS asset_id, p_retailprice * 10 AS cost, p_retailprice AS residual, CAST(p_size % 7 + 1 AS INTEGER) AS life, p_size % 20 + 5.0 AS rate FROM part)"


def _assets(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_retailprice") * 10).alias("cost"), F.col("p_retailprice").alias("residual"), (F.col("p_size") % 7 + 1).cast("int").alias("life"), (F.col("p_size") % 20 + 5.0).alias("rate"))


@query(f"WITH {ASSETS}, y AS (SELECT *, unnest(range(1, life + 1)) AS year FROM asset) SELECT asset_id, CAST(year AS INTEGER) AS year, round((cost - residual) / life, 5) AS charge, round(cost - (cost - residual) / life * year, 5) AS carrying FROM y")
def straight_line(spark, sf_dir):
    return op.depreciation(_assets(spark, sf_dir), "slm")


@query(f"WITH {ASSETS}, y AS (SELECT *, CAST(rate AS DOUBLE) AS rr, unnest(range(1, life + 1)) AS year FROM asset) SELECT asset_id, CAST(year AS INTEGER) AS year, round(cost * pow(1 - rr / 100, year - 1) * rr / 100, 5) AS charge, round(cost * pow(1 - rr / 100, year), 5) AS carrying FROM y")
def written_down(spark, sf_dir):
    return op.depreciation(_assets(spark, sf_dir), "wdv")


@query(f"WITH {ASSETS} SELECT asset_id, round((cost - (cost - residual) / life * (life / 2.0) - residual) / (life + 1), 5) AS charge FROM asset")
def revised_estimate(spark, sf_dir):
    c = F.col
    return _assets(spark, sf_dir).select("asset_id", op.revised_charge(c("cost"), c("residual"), c("life"), c("life") / 2.0, c("life") + 1).alias("charge"))


@query("SELECT o_custkey AS account, round(sum(o_totalprice * (12 - month(o_orderdate))) * 6.0 / 1200, 5) AS interest FROM orders GROUP BY 1")
def product_interest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.col("o_totalprice").alias("amount"), (12 - F.month("o_orderdate")).alias("months"))
    return op.product_interest(rows, "account", 6.0)


LOAN_SQL = f"""WITH {LOAN}, l AS (SELECT loan_id, principal, CAST(rate AS DOUBLE) AS i, n FROM loan), p AS (SELECT *, principal * i / (1 - pow(1 + i, -n)) AS pay FROM l)"""


@query(f"""{LOAN_SQL}, k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM p)
SELECT loan_id, CAST(k AS INTEGER) AS k, round(pay + 1e-7, 2) AS instalment, round((principal * pow(1 + i, k - 1) - pay * (pow(1 + i, k - 1) - 1) / i) * i + 1e-7, 2) AS interest, round(principal * pow(1 + i, k) - pay * (pow(1 + i, k) - 1) / i + 1e-7, 2) AS balance FROM k""")
def amortisation(spark, sf_dir):
    return op.amortisation(a.loans(spark, sf_dir))


@query(f"{LOAN_SQL} SELECT loan_id, round(pay + 1e-7, 2) AS instalment, round(pay * n - principal + 1e-7, 2) AS interest FROM p")
def loan_totals(spark, sf_dir):
    return op.loan_totals(a.loans(spark, sf_dir))


SLABS = ((0.0, 50_000.0, 0.0), (50_000.0, 200_000.0, 5.0), (200_000.0, 500_000.0, 20.0), (500_000.0, None, 30.0))
_TAX = " + ".join(f"greatest(0, {f'least(income, {hi})' if hi else 'income'} - {lo}) * {rate} / 100" for lo, hi, rate in SLABS)


@query(f"WITH t AS (SELECT o_custkey AS payer, sum(o_totalprice) AS income FROM orders GROUP BY 1) SELECT payer, round(income, 5) AS income, round({_TAX}, 5) AS tax, CASE WHEN income > 0 THEN round(100 * ({_TAX}) / income, 4) END AS average_rate FROM t")
def slab_tax(spark, sf_dir):
    incomes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("payer")).agg(F.sum("o_totalprice").alias("income"))
    return op.slab_tax(incomes, SLABS, "payer", "income").withColumn("income", op.money(F.col("income")))


SEGMENT = """seg AS (SELECT n_regionkey AS entity, n_nationkey AS segment, round(sum(greatest(c_acctbal, 0)) * (n_nationkey % 3 * n_nationkey % 3 + 0.25::DOUBLE), 5) AS external, round(sum(abs(c_acctbal)) * 0.1, 5) AS internal, round(sum(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE -c_acctbal END), 5) AS result, round(sum(abs(c_acctbal)) * (n_nationkey % 4 * n_nationkey % 4 + 0.25::DOUBLE), 5) AS assets
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"""


@query(f"""WITH {SEGMENT}, t AS (SELECT *, sum(external + internal) OVER w AS r, sum(greatest(result, 0)) OVER w AS gain, sum(greatest(-result, 0)) OVER w AS loss, sum(assets) OVER w AS a, sum(external) OVER w AS e FROM seg WINDOW w AS (PARTITION BY entity)),
f AS (SELECT *, external + internal >= 0.1 * r AS by_revenue, abs(result) >= 0.1 * greatest(gain, loss) AS by_result, assets >= 0.1 * a AS by_assets FROM t), g AS (SELECT *, by_revenue OR by_result OR by_assets AS reportable FROM f)
SELECT entity, segment, by_revenue, by_result, by_assets, reportable, sum(CASE WHEN reportable THEN external ELSE 0 END) OVER (PARTITION BY entity) >= 0.75 * e AS covers_three_quarters FROM g""")
def segment_test(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    balance = F.col("c_acctbal")
    seg = rows.groupBy(F.col("n_regionkey").alias("entity"), F.col("n_nationkey").alias("segment")).agg(
        op.money(F.sum(F.greatest(balance, F.lit(0.0))) * (F.first("n_nationkey") % 3 * F.first("n_nationkey") % 3 + 0.25)).alias("external"),
        op.money(F.sum(F.abs(balance)) * 0.1).alias("internal"),
        op.money(F.sum(F.when(F.col("c_custkey") % 2 == 0, balance).otherwise(-balance))).alias("result"),
        op.money(F.sum(F.abs(balance)) * (F.first("n_nationkey") % 4 * F.first("n_nationkey") % 4 + 0.25)).alias("assets"),
    )
    return op.segment_test(seg, "entity").select("entity", "segment", "by_revenue", "by_result", "by_assets", "reportable", "covers_three_quarters")


@query("""WITH s AS (SELECT o_custkey AS company_id, max(o_totalprice) * 10 AS e, sum(o_totalprice / 100 * month(o_orderdate)) / 12 AS s, max(o_totalprice) AS xe, count(*) * CAST(o_custkey % 5 * 40 + 1 AS DOUBLE) AS xs FROM orders GROUP BY 1)
SELECT company_id, round(e / s, 4) AS basic, round(least(e / s, (e + xe) / (s + xs)), 4) AS diluted, (e + xe) / (s + xs) < e / s AS dilutive FROM s""")
def earnings_per_share(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), (F.max("o_totalprice").over(w) * 10).alias("earnings"), (F.col("o_totalprice") / 100).alias("shares"), F.month("o_orderdate").alias("months"), F.max("o_totalprice").over(w).alias("extra_earnings"), (F.count("*").over(w) * (F.col("o_custkey") % 5 * 40 + 1).cast("double")).alias("extra_shares"))
    return op.earnings_per_share(rows, "company_id")


@query("""WITH p AS (SELECT l_suppkey AS contract, year(l_shipdate) AS period, sum(l_extendedprice) AS c FROM lineitem GROUP BY 1, 2), c AS (SELECT contract, period, sum(c) OVER (PARTITION BY contract ORDER BY period) AS cost_to_date, sum(c) OVER (PARTITION BY contract) AS total FROM p),
q AS (SELECT *, total * (0.9 + contract % 4 * 0.1) * least(1, cost_to_date / total) AS cum FROM c)
SELECT contract, CAST(period AS INTEGER) AS period, round(cum, 5) AS revenue_to_date, round(cum - coalesce(lag(cum) OVER (PARTITION BY contract ORDER BY period), 0), 5) AS revenue, round(greatest(0, total - total * (0.9 + contract % 4 * 0.1)), 5) AS expected_loss FROM q""")
def completion(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("contract")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("contract"), F.year("l_shipdate").alias("period")).agg(F.sum("l_extendedprice").alias("c"))
    rows = rows.select("contract", "period", F.sum("c").over(w.orderBy("period")).alias("cost_to_date"), F.sum("c").over(w).alias("estimated_total"))
    return op.completion(rows.withColumn("price", F.col("estimated_total") * (0.9 + F.col("contract") % 4 * 0.1)), "contract")


@query("""SELECT o_custkey AS debtor, round(sum(o_totalprice * CASE WHEN d >= 2000 THEN 50.0 WHEN d >= 1000 THEN 10.0 WHEN d >= 365 THEN 2.5 ELSE 0 END / 100), 5) AS provision, round(sum(o_totalprice), 5) AS debts
FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS d FROM orders) GROUP BY 1""")
def age_provision(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("debtor"), F.col("o_totalprice").alias("amount"), F.date_diff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate")).alias("age_days"))
    return op.age_provision(rows, ((365, 2.5), (1000, 10.0), (2000, 50.0)), "debtor")


RATES = """fx AS (SELECT n_nationkey AS currency, k AS rate_kind, 1 + n_nationkey / 10.0 + CASE k WHEN 'closing' THEN 0.05 WHEN 'average' THEN 0.02 ELSE 0 END AS rate FROM nation, (SELECT unnest(['closing', 'average', 'historical']) AS k))"""


@query(f"""WITH {RATES}, line AS (SELECT c_nationkey AS currency, c_custkey % 40 AS branch, c_custkey % 2 = 0 AS integral, CASE WHEN (c_custkey // 40) % 3 = 0 THEN 'average' WHEN c_custkey % 2 <> 0 OR (c_custkey // 40) % 3 = 1 THEN 'closing' ELSE 'historical' END AS rate_kind, c_acctbal AS amount FROM customer)
SELECT branch, round(sum(amount * CAST(rate AS DOUBLE)), 5) AS difference, CASE WHEN integral THEN 'profit' ELSE 'reserve' END AS taken_to FROM line JOIN fx USING (currency, rate_kind) GROUP BY branch, integral""")
def fx_translation(spark, sf_dir):
    part = F.floor(F.col("c_custkey") / 40) % 3
    lines = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("currency"), (F.col("c_custkey") % 40).alias("branch"), (F.col("c_custkey") % 2 == 0).alias("integral"), (part == 0).alias("is_income"), (part == 1).alias("monetary"), F.col("c_acctbal").alias("amount"))
    kinds = F.array(*(F.struct(F.lit(k).alias("rate_kind"), F.lit(x).alias("add")) for k, x in (("closing", 0.05), ("average", 0.02), ("historical", 0.0))))
    rates = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("currency"), F.explode(kinds).alias("k")).select("currency", "k.rate_kind", (1 + F.col("currency") / 10.0 + F.col("k.add")).alias("rate"))
    return op.translate(lines, rates, "branch")


@query("""WITH c AS (SELECT c_custkey AS company_id, 10000 + c_custkey % 100 * 100 AS shares, 10.0 + c_custkey % 30 AS price, abs(c_acctbal) * 50 AS funds, abs(c_acctbal) * (c_custkey % 120) AS debt, c_custkey % 5 * 1000 AS fresh FROM customer),
l AS (SELECT *, CAST(floor(shares * 0.25) AS BIGINT) AS by_shares, CAST(floor(funds * 0.25 / price) AS BIGINT) AS by_funds, CAST(floor(greatest(0, funds - debt / 2) / price) AS BIGINT) AS by_debt FROM c)
SELECT company_id, by_shares, by_funds, by_debt, least(by_shares, by_funds, by_debt) AS "limit", CAST(greatest(0, least(by_shares, by_funds, by_debt) * 10 - fresh) AS DOUBLE) AS reserve, round(funds * 0.1, 5) AS board_amount FROM l""")
def buyback_limit(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("company_id"), (10000 + k % 100 * 100).alias("shares"), (10.0 + k % 30).alias("price"), (F.abs("c_acctbal") * 50).alias("funds"), (F.abs("c_acctbal") * (k % 120)).alias("debt"), F.lit(10.0).alias("face"), (k % 5 * 1000).alias("fresh_issue"))
    return op.buyback_limit(rows)
