"""Accounts of firms, banks and nations: statements as signed sums by a dimension of kinds, and rules that take one row or window per entity.

Amounts are summed as decimals, so that no order of rows changes a total, and become doubles for ratios; results are rounded last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6


def exact(amount: str | Column) -> Column:
    """Exact sum of an amount of two places."""
    return F.sum((F.col(amount) if isinstance(amount, str) else amount).cast("decimal(18,2)"))


def whole(amount: str | Column) -> Column:
    return exact(amount).cast("double")


def out(x: Column) -> Column:
    return F.round(x, PLACES)


def over(x: Column) -> Column:
    """What lies above nil."""
    return F.greatest(x, F.lit(0.0))


def statements(moves: DataFrame, signs: DataFrame, entity: str) -> DataFrame:
    """Totals of every statement: moves (entity, kind, amount) by the sign that the dimension (statement, kind, sign) gives their kind. Moves are summed by kind
    before they meet it; a kind may count in several statements and a statement without moves has no row."""
    sums = moves.groupBy(entity, "kind").agg(exact("amount").alias("amount"))
    return sums.join(signs, "kind").groupBy(entity, "statement").agg(F.sum(F.col("amount") * F.col("sign")).cast("double").alias("total"))


def commission(rows: DataFrame, rate: float) -> DataFrame:
    """Manager's commission of a profit before it is charged, and after; nothing of a loss."""
    return rows.withColumns({"before": out(over(F.col("profit")) * rate / 100), "after": out(over(F.col("profit")) * rate / (100 + rate))})


def provision_charge(rows: DataFrame, rate: float) -> DataFrame:
    """Closing provision of the debts left after bad ones, and what that and the bad debts cost beyond the opening provision."""
    closing = (F.col("debtors") - F.col("bad_debts")) * rate / 100
    return rows.withColumns({"closing": out(closing), "charge": out(F.col("bad_debts") + closing - F.col("opening"))})


def allotment(rows: DataFrame) -> DataFrame:
    """Shares allotted in proportion to a category's applications (``applied``, ``offered``), money paid with them (``per_application``) beyond what they need, how much of that the
    allotment takes (``per_allotment``), the calls (``per_call``) and what is refunded."""
    allotted = F.least(F.col("applied"), F.floor(F.col("applied") * F.least(F.lit(1.0), F.col("offered") / F.col("category_applied"))))
    excess = (F.col("applied") - F.col("allotted")) * F.col("per_application")
    to_allotment, to_calls = F.col("allotted") * F.col("per_allotment"), F.col("allotted") * F.col("per_call")
    rows = rows.withColumn("category_applied", F.sum("applied").over(Window.partitionBy("category"))).withColumn("allotted", allotted)
    rows = rows.withColumn("excess", excess).withColumn("to_allotment", F.least(F.col("excess"), to_allotment))
    rows = rows.withColumn("to_calls", F.least(F.col("excess") - F.col("to_allotment"), to_calls))
    return rows.withColumn("refund", F.col("excess") - F.col("to_allotment") - F.col("to_calls"))


def debenture_issue(rows: DataFrame) -> DataFrame:
    """Legs of an issue of ``units`` of nominal 100 at ``issue`` and redeemable at ``redeem``."""
    n = F.col("units")
    discount, premium, payable = over(100 - F.col("issue")) * n, over(F.col("issue") - 100) * n, over(F.col("redeem") - 100) * n
    return rows.withColumns({"received": F.col("issue") * n, "discount": discount, "premium": premium, "payable": payable, "loss": discount + payable})


def branch_accounts(rows: DataFrame, loading: float) -> DataFrame:
    """Stock reserve in invoiced stock, debtors at the end, and goods and cash in transit."""
    debtors = F.col("debtors") + F.col("credit_sales") - F.col("received") - F.col("returns")
    return rows.withColumns({"stock_reserve": out(F.col("stock") * loading / (100 + loading)), "closing_debtors": debtors, "in_transit": over(F.col("sent") - F.col("arrived"))})


def reconstruction(rows: DataFrame) -> DataFrame:
    """What holders and creditors give up, the losses that it writes off, and the balance to reserve, or the loss that stays."""
    credit = F.col("capital_cut") + F.col("creditors_cut") + F.col("revalued")
    return rows.withColumns({"credit": credit, "to_reserve": over(credit - F.col("losses")), "loss_left": over(F.col("losses") - credit), "share_of_holders": out(F.try_divide(F.col("capital_cut"), credit))})


def past_adjustment(rows: DataFrame, firm: str) -> DataFrame:
    """What each partner should have had of the firm's total by ratio, less what they got; nets to nil within a firm."""
    w = Window.partitionBy(firm)
    entitled = F.sum("received").over(w) * F.col("ratio") / F.sum("ratio").over(w)
    return rows.withColumn("adjust", out(entitled - F.col("received")))


def goodwill_methods(rows: DataFrame, years: float, normal: float, annuity: float) -> DataFrame:
    """Goodwill of a firm from ``profit`` per year (``weight`` growing with the year) and ``capital``: average and weighted profits times years, super profit times years, or its
    annuity, and the capital that the average profit would carry beyond the firm's."""
    sums = rows.groupBy("firm").agg(whole("profit").alias("p"), F.count("*").alias("n"), F.sum((F.col("profit") * F.col("weight")).cast("decimal(20,2)")).cast("double").alias("wp"), F.sum("weight").alias("w"), F.max("capital").alias("capital"))
    average = F.col("p") / F.col("n")
    extra = average - F.col("capital") * normal / 100
    return sums.select("firm", out(average * years).alias("by_average"), out(F.col("wp") / F.col("w") * years).alias("by_weight"), out(over(extra) * years).alias("by_super_profit"), out(over(extra) * annuity).alias("by_annuity"), out(over(average * 100 / normal - F.col("capital"))).alias("by_capital"))


def cash_book(entries: DataFrame, key: str) -> DataFrame:
    """Balances of the cash and the bank column. ``kind`` tells where an entry counts: received or paid in cash or by bank, or a contra entry, which is both a payment of one column and a
    receipt of the other. ``imprest`` is what brings petty cash back to its float."""
    legs = F.when(F.col("kind") == "cash_in", F.array(F.struct(F.lit("cash").alias("book"), F.lit(1).alias("sign"))))
    legs = legs.when(F.col("kind") == "cash_out", F.array(F.struct(F.lit("cash").alias("book"), F.lit(-1).alias("sign")))).when(F.col("kind") == "bank_in", F.array(F.struct(F.lit("bank").alias("book"), F.lit(1).alias("sign"))))
    legs = legs.when(F.col("kind") == "bank_out", F.array(F.struct(F.lit("bank").alias("book"), F.lit(-1).alias("sign")))).when(F.col("kind") == "deposit", F.array(F.struct(F.lit("cash").alias("book"), F.lit(-1).alias("sign")), F.struct(F.lit("bank").alias("book"), F.lit(1).alias("sign"))))
    posted = entries.select(key, "kind", "amount", F.explode(legs).alias("leg"))
    of = lambda book: F.sum(F.when(F.col("leg.book") == book, (F.col("amount") * F.col("leg.sign")).cast("decimal(18,2)")).otherwise(0)).cast("double")
    return posted.groupBy(key).agg(of("cash").alias("cash"), of("bank").alias("bank"), F.sum(F.when(F.col("kind") == "cash_out", F.col("amount").cast("decimal(18,2)")).otherwise(0)).cast("double").alias("imprest"))


def stock_adjustments(rows: DataFrame) -> DataFrame:
    """Goods lost, given away or out on approval: the loss beyond the insurer's payment, the profit that goods on approval hold, and closing stock with their cost."""
    cost = F.col("on_approval") * 100 / (100 + F.col("margin"))
    return rows.withColumns({"loss": over(F.col("lost") - F.col("insured")), "unearned": out(F.col("on_approval") - cost), "closing": out(F.col("stock") + cost)})


def maturities(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Debts due within twelve months and later, and deposits that were bought within three months of their end, which count as cash."""
    day = F.lit(at).cast("date")
    soon = F.col("due") <= F.add_months(day, 12)
    of = lambda c: F.sum(F.when(c, F.col("amount").cast("decimal(18,2)")).otherwise(0)).cast("double")
    return rows.groupBy(key).agg(of(soon & (F.col("kind") == "debt")).alias("current"), of(~soon & (F.col("kind") == "debt")).alias("later"), of((F.col("kind") == "deposit") & (F.col("due") <= F.add_months("bought", 3))).alias("cash_equivalents"))


def taxes(rows: DataFrame, key: str, rate: float) -> DataFrame:
    """Current tax on taxable income, deferred tax on differences of timing only, and the asset of losses up to income that is certain."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("amount").cast("decimal(18,2)")).otherwise(0)).cast("double")
    sums = rows.groupBy(key).agg(*(of(k).alias(k) for k in ("profit", "timing", "permanent", "loss", "certain")))
    return sums.select(key, out(over(F.col("profit") + F.col("permanent") - F.col("timing")) * rate / 100).alias("current"), out(F.col("timing") * rate / 100).alias("deferred"), out(F.least("loss", "certain") * rate / 100).alias("loss_asset"))


def forward_contracts(rows: DataFrame, year_end: str) -> DataFrame:
    """Premium of contracts that hedge, by the months of the term up to the year's end; gain of those that speculate at the forward rate that the year's end has
    for the ``remaining`` time; the liability restated at the closing spot rate."""
    term = F.months_between("ends", "begins")
    gone = F.least(term, over(F.months_between(F.lit(year_end).cast("date"), F.col("begins"))))
    premium = (F.col("forward") - F.col("spot")) * F.col("units")
    return rows.withColumns({"premium": F.when(~F.col("speculates"), out(premium * F.try_divide(gone, term))), "gain": F.when(F.col("speculates"), out((F.col("remaining") - F.col("forward")) * F.col("units"))), "restated": out(F.col("closing") * F.col("units"))})


def grants(rows: DataFrame) -> DataFrame:
    """A grant deducted from its asset or deferred over its life: yearly charge either way, and a refund after some years, first against what isn't yet taken to income."""
    left = F.col("grant") * (F.col("life") - F.col("years")) / F.col("life")
    return rows.withColumns({"charge_if_deducted": out((F.col("cost") - F.col("grant")) / F.col("life")), "income_if_deferred": out(F.col("grant") / F.col("life")), "against_deferred": out(F.least(F.col("refund"), left)), "to_profit": out(over(F.col("refund") - left))})


def benefit_obligation(rows: DataFrame) -> DataFrame:
    """Net liability of a benefit plan, or its asset up to the ceiling, and the gain of curtailing a share of it: the cut of the obligation less the same share of past
    service cost that isn't recognised yet."""
    net = F.col("obligation") - F.col("plan_assets") - F.col("unrecognised")
    return rows.withColumns({"liability": over(net), "asset": F.least(over(-net), F.col("ceiling")), "curtailment": out((F.col("obligation") - F.col("unrecognised")) * F.col("curtailed") / 100)})


def finance_lease(rows: DataFrame) -> DataFrame:
    """Lower of fair value and present value of ``n`` equal payments at ``rate``, and the liability after ``k`` of them."""
    i = F.col("rate") / 100
    pv = F.col("payment") * (1 - F.pow(1 + i, -F.col("n"))) / i
    first = F.least(F.col("fair"), pv)
    grown = F.pow(1 + i, F.col("k"))
    return rows.withColumns({"initial": F.round(first, 4), "after": F.round(first * grown - F.col("payment") * (grown - 1) / i, 4)})


def purchasing_power(rows: DataFrame) -> DataFrame:
    """Opening equity restated by the index, and the profit that is left once that, or the physical stock at its closing price, is maintained."""
    restated = F.col("opening") * F.col("index_close") / F.col("index_open")
    return rows.withColumns({"financial": F.col("closing") - F.col("opening"), "restated": out(restated), "real": out(F.col("closing") - restated), "physical": out(F.col("closing") - F.col("units") * F.col("price_close"))})


def national_accounts(rows: DataFrame, country: str) -> DataFrame:
    """Deflator, real income and income a head of each year, and the propensity to consume between years with its multiplier. ``rows`` has year, nominal, real, consumption, people."""
    w = Window.partitionBy(country).orderBy("year")
    step = F.try_divide(F.col("consumption") - F.lag("consumption").over(w), F.col("nominal") - F.lag("nominal").over(w))
    rows = rows.withColumn("_mpc", step)
    return rows.select(country, "year", out(F.try_divide(100 * F.col("nominal"), F.col("real"))).alias("deflator"), out(F.col("real") / F.col("people")).alias("per_head"), out(F.try_divide(F.col("consumption"), F.col("nominal"))).alias("average_propensity"), out(F.col("_mpc")).alias("marginal_propensity"), out(F.when((F.col("_mpc") >= 0) & (F.col("_mpc") < 0.99), 1 / (1 - F.col("_mpc")))).alias("multiplier"))


def money_supply(rows: DataFrame, key: str, reserve: float) -> DataFrame:
    """Narrow and broad money, the deposits that primary ones can create at the reserve ratio, and the derived part of them."""
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("amount").cast("decimal(18,2)")).otherwise(0)).cast("double")
    sums = rows.groupBy(key).agg(of("currency", "demand", "other").alias("m1"), of("currency", "demand", "other", "time").alias("m3"), of("demand").alias("primary"))
    return sums.withColumns({"created": out(F.col("primary") * 100 / reserve), "derived": out(F.col("primary") * 100 / reserve - F.col("primary"))})


def budget_deficits(rows: DataFrame, key: str) -> DataFrame:
    """Deficit of the revenue account, of the whole budget without borrowing, and that less interest paid."""
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("amount").cast("decimal(18,2)")).otherwise(0)).cast("double")
    sums = rows.groupBy(key).agg(of("revenue_out", "interest").alias("a"), of("revenue_in").alias("b"), of("capital_out").alias("c"), of("capital_in").alias("d"), of("interest").alias("i"))
    fiscal = F.col("a") + F.col("c") - F.col("b") - F.col("d")
    return sums.select(key, (F.col("a") - F.col("b")).alias("revenue_deficit"), fiscal.alias("fiscal_deficit"), (fiscal - F.col("i")).alias("primary_deficit"))


def trade_balance(rows: DataFrame, key: str, specific: float, ad_valorem: float) -> DataFrame:
    """Trade and current balance, and tariffs on imports by unit and by value."""
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("amount").cast("decimal(18,2)")).otherwise(0)).cast("double")
    units = F.sum(F.when(F.col("kind") == "import", F.col("units")).otherwise(0.0))
    sums = rows.groupBy(key).agg(of("export").alias("x"), of("import").alias("m"), of("service_in", "transfer_in").alias("s"), of("service_out").alias("t"), units.alias("u"))
    return sums.select(key, (F.col("x") - F.col("m")).alias("trade"), (F.col("x") - F.col("m") + F.col("s") - F.col("t")).alias("current"), out(F.col("u") * specific + F.col("m") * ad_valorem / 100).alias("tariff"), out(F.try_divide(100 * F.col("x"), F.col("m"))).alias("terms"))


def asset_disposal(rows: DataFrame) -> DataFrame:
    """Straight-line charge by months held of the year of purchase, carrying amount by use (``produced`` of ``capacity``), and the result of a sale after some years."""
    yearly = (F.col("cost") - F.col("residual")) / F.col("life")
    carrying = over(F.col("cost") - yearly * F.col("years"))
    return rows.withColumns({"first_year": out(yearly * F.col("months") / 12), "by_use": out((F.col("cost") - F.col("residual")) * F.col("produced") / F.col("capacity")), "gain": out(over(F.col("sold_for") - carrying)), "loss": out(over(carrying - F.col("sold_for")))})


def method_change(rows: DataFrame) -> DataFrame:
    """Depreciation so far by reducing balance, what straight line would have charged, and the difference that a change of method brings into account."""
    wdv = F.col("cost") * (1 - F.pow(1 - F.col("rate") / 100, F.col("years")))
    slm = (F.col("cost") - F.col("residual")) / F.col("life") * F.least(F.col("years"), F.col("life"))
    return rows.withColumns({"charged": F.round(wdv, 3), "would_be": out(slm), "difference": F.round(wdv - slm, 3)})


def restated_eps(rows: DataFrame) -> DataFrame:
    """Earnings a share before and after a bonus issue, which counts from the beginning also in the year before."""
    factor = 1 + F.col("bonus")
    return rows.withColumns({"basic": out(F.col("earnings") / (F.col("shares") * factor)), "before_restated": out(F.col("earnings_before") / (F.col("shares_before") * factor)), "diluted": out(F.least(F.col("earnings") / (F.col("shares") * factor), (F.col("earnings") + F.col("saved")) / (F.col("shares") * factor + F.col("potential"))))})


def expected_loss(rows: DataFrame, key: str) -> DataFrame:
    """Outcomes by chance, and whether the likeliest outcome is a loss, so that a provision is due."""
    return rows.groupBy(key).agg(F.sum(F.col("chance") * F.col("amount")).alias("expected"), F.max_by("amount", F.struct("chance", "amount")).alias("likeliest")).select(key, out(F.col("expected")).alias("expected"), "likeliest", (F.col("likeliest") > 0).alias("provide"))


def insolvency_dividend(rows: DataFrame, debtor: str) -> DataFrame:
    """Share of each claim that an insolvent's assets pay, at most all of it, and what is lost."""
    rate = F.least(F.lit(1.0), F.col("assets") / F.sum("claim").over(Window.partitionBy(debtor)))
    return rows.withColumns({"dividend": out(F.col("claim") * rate), "bad": out(F.col("claim") - F.col("claim") * rate)})


def equity_method(rows: DataFrame) -> DataFrame:
    """Associates at cost and share of results, floored at nil with the loss kept apart; joint ventures by their share of each line."""
    value = F.col("cost") + F.col("share") / 100 * F.col("results") - F.col("share") / 100 * F.col("dividends")
    return rows.withColumns({"carrying": out(over(value)), "unrecognised": out(over(-value)), "venture_share": out(F.col("share") / 100 * F.col("assets"))})


def hidden_goodwill(rows: DataFrame) -> DataFrame:
    """A newcomer's capital over their share gives the firm's whole capital; what that is beyond all capitals is goodwill. Revaluation goes to the old partners."""
    implied = F.col("brought") / F.col("share")
    return rows.withColumns({"implied": out(implied), "hidden": out(over(implied - F.col("capitals") - F.col("brought"))), "revaluation": F.col("revalued_assets") - F.col("revalued_debts")})


def best_project(flows: DataFrame, group: str) -> DataFrame:
    """Of exclusive projects of a group the one of highest net present value; ties go to the first."""
    sums = flows.groupBy(group, "project").agg(F.sum(F.col("amount") / F.pow(1 + F.col("rate"), F.col("t"))).alias("npv"))
    best = F.max_by(F.struct("project", "npv"), F.struct(F.round("npv", 6), -F.col("project")))
    return sums.groupBy(group).agg(best.alias("b"), F.count("*").alias("projects")).select(group, F.col("b.project").alias("project"), F.round("b.npv", 4).alias("npv"), "projects")


def draw_down(rows: DataFrame) -> DataFrame:
    """A fund that pays ``n`` equal sums at ``rate``: the sum, and what is left after ``k`` of them."""
    pay = F.col("fund") * F.col("rate") / (1 - F.pow(1 + F.col("rate"), -F.col("n")))
    grown = F.pow(1 + F.col("rate"), F.col("k"))
    return rows.withColumns({"pays": F.round(pay, 4), "left": F.round(F.col("fund") * grown - pay * (grown - 1) / F.col("rate"), 4)})


def grouped_median(counts: DataFrame, key: str) -> DataFrame:
    """Median of values with frequencies (``x``, ``f``): the least value up to which half of all lie."""
    w = Window.partitionBy(key)
    rows = counts.withColumns({"_upto": F.sum("f").over(w.orderBy("x")), "_all": F.sum("f").over(w)})
    return rows.groupBy(key).agg(F.min(F.when(F.col("_upto") * 2 >= F.col("_all"), F.col("x"))).alias("median"), F.max("_all").alias("n"))


def cost_of_sales(moves: DataFrame, key: str) -> DataFrame:
    """Cost of what was sold: opening stock and purchases less returns and closing stock."""
    sign = F.when(F.col("kind").isin("opening", "purchases"), 1).when(F.col("kind").isin("returns_out", "closing"), -1).otherwise(0)
    return moves.groupBy(key).agg(whole(F.col("amount") * sign).alias("cost"))


def sitting_results(rows: DataFrame) -> DataFrame:
    """Whether a sitting is passed: two fifths of every paper and half of all marks. A failed one exempts from papers of three fifths and more."""
    sums = rows.groupBy("learner_id", "sitting").agg(F.count("*").alias("papers"), F.min("pct").alias("least"), F.sum("pct").alias("total"), F.count_if(F.col("pct") >= 60).alias("high"))
    passed = (F.col("least") >= 40) & (F.col("total") >= 50 * F.col("papers"))
    return sums.select("learner_id", "sitting", "papers", passed.alias("passed"), F.when(passed, 0).otherwise(F.col("high")).alias("exempt"))
