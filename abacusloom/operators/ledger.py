"""Ledger operators: stock valuation, postings, allocation, schedules, tests and rates over tables keyed by entity.

Amounts stay doubles until the last column, which is rounded to ``PLACES``. Running totals lie within one item, account or case;
those that may be large are cut into blocks, so that no task holds a whole item. Nothing is gathered across keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import BLOCK_ROWS, before_blocks, in_blocks, meet, running
from .state import ordered_fold

PLACES = 5
NUDGE = 1e-7


def money(x: Column, places: int = PLACES) -> Column:
    """Rounded with halves up, also those that a binary fraction holds slightly too low."""
    return F.round(x + NUDGE, places)


def signed(amount: Column, side: Column, positive: str = "dr") -> Column:
    return F.when(side == positive, amount).otherwise(-amount)


# stock


def _left_units(lots: DataFrame, issued: DataFrame, newest_first: bool, block_rows: int) -> DataFrame:
    """Units of each lot that the issues leave; lots are used up from the oldest, or from the newest."""
    rows = running(lots, ["item_id"], ["ts", "seq"], {"cum": "units"}, descending=newest_first, block_rows=block_rows).join(issued, "item_id", "left")
    return rows.withColumn("left_units", F.greatest(F.lit(0.0), F.least(F.col("units"), F.col("cum") - F.coalesce("issued", F.lit(0.0)))))


def closing_stock(lots: DataFrame, issues: DataFrame, method: str = "fifo", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Units and value left per item by ``fifo``, ``lifo`` or ``periodic`` average. Items issued beyond their lots are
    ``short``: an error, with a null value. ``lots`` has item_id, ts, seq, units, rate; ``issues`` has item_id, units."""
    issued = issues.groupBy("item_id").agg(F.sum("units").alias("issued"))
    total = lots.groupBy("item_id").agg(F.sum("units").alias("bought"), F.sum(F.col("units") * F.col("rate")).alias("cost")).join(issued, "item_id", "left").fillna(0.0, ["issued"])
    closing = F.col("bought") - F.col("issued")
    if method == "periodic":
        value = total.withColumn("value", F.col("cost") / F.col("bought") * closing)
    else:
        left = _left_units(lots, issued, method == "lifo", block_rows).groupBy("item_id").agg(F.sum(F.col("left_units") * F.col("rate")).alias("value"))
        value = total.join(left, "item_id")
    return value.select("item_id", closing.alias("units"), F.when(closing >= 0, money(F.col("value"))).alias("value"), (closing < 0).alias("short"))


def moving_average(moves: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Units and value per item when each issue leaves at the average cost of that moment. ``moves`` has item_id, ts, seq, units (issues below zero), rate.

    A movement maps the value before it to ``a * value + b``: a receipt adds its cost, an issue takes its share of the units that are there (nothing, where
    there are none). Such maps compose to one of the same form, so each block of an item's movements passes by in order and leaves one map; an item's maps, in the order of its blocks, give its
    value. Units that are null leave nothing known, a null rate no value."""
    kind, order = moves.schema["item_id"].dataType.simpleString(), ["ts", "seq", "units", "rate"]
    double = lambda c: F.col(c).cast("double").alias(c)
    cut, any_cut = in_blocks(moves.select("item_id", "ts", "seq", double("units"), double("rate")), ["item_id"], order, block_rows)
    prior = before_blocks(cut, ["item_id"], {"before": "units"}) if any_cut else None
    rows = meet(cut, prior.drop("_all_before"), ["item_id", "_block"]) if any_cut else cut.withColumn("before", F.lit(None).cast("double"))

    def step(state: tuple, ts, seq, moved: float | None, rate: float | None, before: float | None) -> tuple:
        units, a, b = state or (before or 0.0, 1.0, 0.0)
        if moved is None or units is None:
            return None, None, None
        if moved > 0:
            b = None if b is None or rate is None else b + moved * rate
        elif units > 0 and b is not None:
            a, b = a * (1 + moved / units), b * (1 + moved / units)
        return units + moved, a, b

    rows = rows.select("item_id", "_block", "ts", "seq", "units", "rate", "before")
    maps = ordered_fold(rows, ["item_id", "_block"], order, f"item_id {kind}, _block int, units double, a double, b double", lambda: None, step, lambda key, state: [(*key, *state)])
    if any_cut:
        listed = maps.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("_block", "units", "a", "b"))).alias("maps"))
        known = lambda c: ~F.exists("maps", lambda m: m[c].isNull())
        value = F.aggregate("maps", F.lit(0.0), lambda v, m: m["a"] * v + m["b"])
        maps = listed.select("item_id", F.when(known("units"), F.element_at("maps", -1)["units"]).alias("units"), F.when(known("b"), value).alias("b"))
    return maps.select("item_id", F.round("units", 4).alias("units"), money(F.col("b")).alias("value"))


def lower_of_cost_and_nrv(lines: DataFrame, key: str) -> DataFrame:
    return lines.groupBy(key).agg(money(F.sum(F.least("cost", "nrv"))).alias("carried"), money(F.sum(F.greatest(F.lit(0.0), F.col("cost") - F.col("nrv")))).alias("write_down"))


def retail_stock(moves: DataFrame, key: str, margin: float) -> DataFrame:
    """Closing stock at cost from selling prices: what was stocked less what was sold, less the margin."""
    retail = F.sum(F.when(F.col("kind") == "sale", -F.col("amount")).otherwise(F.col("amount")))
    return moves.groupBy(key).agg(money(retail).alias("retail"), money(retail * (1 - margin)).alias("cost"))


# postings


def ledger_balance(postings: DataFrame) -> DataFrame:
    """Both totals of each account, the balance with its side, and the total at which the account is ruled off."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0.0))
    sums = postings.groupBy("account").agg(money(side("dr")).alias("dr"), money(side("cr")).alias("cr"))
    balance = money(F.col("dr") - F.col("cr"))
    return sums.select("account", "dr", "cr", F.abs(balance).alias("balance"), F.when(balance > 0, "dr").when(balance < 0, "cr").alias("side"), F.greatest("dr", "cr").alias("ruled_at"))


def trial_balance(postings: DataFrame) -> DataFrame:
    """The two columns of the trial balance and whether they agree to the last digit that is kept."""
    net = postings.groupBy("account").agg(F.sum(signed(F.col("amount"), F.col("side")).cast("decimal(20,2)")).alias("net"))
    debit, credit = F.sum(F.greatest(F.col("net"), F.lit(0).cast("decimal(20,2)"))), F.sum(F.greatest(-F.col("net"), F.lit(0).cast("decimal(20,2)")))
    return net.agg(F.count("*").alias("accounts"), debit.cast("double").alias("debit"), credit.cast("double").alias("credit"), (debit == credit).alias("agrees"))


def suspense(postings: DataFrame) -> DataFrame:
    """Balance of the suspense account per entry: the signed shortfall of its credits, and the mirror leg that clears it."""
    gap = postings.groupBy("entry").agg(money(F.sum(signed(F.col("amount"), F.col("side")))).alias("gap")).filter("gap <> 0")
    return gap.select("entry", F.abs("gap").alias("amount"), F.when(F.col("gap") > 0, "cr").otherwise("dr").alias("suspense_side"), F.when(F.col("gap") > 0, "dr").otherwise("cr").alias("cleared_by"))


def signed_total(rows: DataFrame, key: str | Sequence[str], signs: Mapping[str, float], kind: str = "kind", amount: str = "amount", name: str = "total") -> DataFrame:
    """Sum per key of amounts with the sign of their kind; kinds without a sign don't count."""
    sign = reduce(lambda acc, kv: acc.when(F.col(kind) == kv[0], float(kv[1])), signs.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    keys = [key] if isinstance(key, str) else list(key)
    return rows.groupBy(*keys).agg(money(F.sum(F.col(amount) * sign)).alias(name))


def missing_side(rows: DataFrame, key: str) -> DataFrame:
    """The one unknown amount of each account (null ``amount``), by which its sides agree; null unless exactly one is unknown."""
    sums = rows.groupBy(key).agg(F.count_if(F.col("amount").isNull()).alias("unknown"), F.sum(signed(F.col("amount"), F.col("side"))).alias("net"))
    return sums.select(key, "unknown", F.when(F.col("unknown") == 1, money(-F.col("net"))).alias("missing"))


def reconcile(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Items of two books by where they stand: in both, in both with other amounts, or in one only."""
    rows = ours.select(key, F.col("amount").alias("our_amount")).join(theirs.select(key, F.col("amount").alias("their_amount")), key, "full")
    status = (
        F.when(F.col("their_amount").isNull(), "not in theirs")
        .when(F.col("our_amount").isNull(), "not in ours")
        .when(F.col("our_amount") == F.col("their_amount"), "agreed")
        .otherwise("differs")
    )
    return rows.withColumn("status", status)


# allocation


def waterfall(claims: DataFrame, key: str, order: str, available: str = "available", due: str = "due", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A surplus fills the claims of its key in order; ``applied`` never exceeds a claim, nor all of them the surplus."""
    rows = running(claims, [key], [order], {"_upto": due}, block_rows=block_rows)
    applied = F.greatest(F.lit(0.0), F.least(F.col(due), F.col(available) - (F.col("_upto") - F.col(due))))
    return rows.withColumns({"applied": money(applied), "unpaid": money(F.col(due) - applied)}).drop("_upto")


def tiered(claims: DataFrame, key: str, tier: str = "tier", due: str = "due", available: str = "available") -> DataFrame:
    """Settlement by tiers: each tier is paid before the next, and rateably within itself."""
    totals = claims.groupBy(key, tier, available).agg(F.sum(due).alias("_tier_due"))
    before = Window.partitionBy(key).orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0.0), F.col(available) - F.coalesce(F.sum("_tier_due").over(before), F.lit(0.0)))
    rate = totals.select(key, tier, F.least(F.lit(1.0), left / F.col("_tier_due")).alias("_rate"))
    return claims.join(rate, [key, tier]).withColumn("paid", money(F.col(due) * F.col("_rate"))).drop("_rate")


def pro_rata(rows: DataFrame, key: str, weight: Column, total: Column) -> Column:
    """Share of ``total`` by weight within the key."""
    return total * weight / F.sum(weight).over(Window.partitionBy(key))


def scaled_claims(rows: DataFrame, key: str, claim: str = "claim", available: str = "available") -> DataFrame:
    """Claims in full if the available amount holds them, else scaled down to it."""
    every = F.sum(claim).over(Window.partitionBy(key))
    return rows.withColumn("share", money(F.col(claim) * F.least(F.lit(1.0), F.col(available) / every)))


def guaranteed_shares(rows: DataFrame, key: str) -> DataFrame:
    """Profit shares by ratio where some partners are guaranteed a minimum, which the others bear by their ratios.

    ``rows`` has profit, ratio, guarantee (null for none)."""
    w = Window.partitionBy(key)
    share = F.col("profit") * F.col("ratio") / F.sum("ratio").over(w)
    rows = rows.withColumn("_share", share).withColumn("_lack", F.greatest(F.lit(0.0), F.coalesce("guarantee", F.lit(0.0)) - F.col("_share")))
    bears = F.when(F.col("_lack") > 0, 0.0).otherwise(F.col("ratio"))
    return rows.withColumn("share", money(F.col("_share") + F.col("_lack") - F.sum("_lack").over(w) * bears / F.sum(bears).over(w))).drop("_share", "_lack")


def ratio_change(shares: DataFrame, key: str) -> DataFrame:
    """Sacrifice and gain of each partner when ``old_share`` becomes ``new_share``, and their settlement of goodwill."""
    old, new = F.coalesce("old_share", F.lit(0.0)), F.coalesce("new_share", F.lit(0.0))
    return shares.withColumns({"sacrifice": F.round(F.greatest(F.lit(0.0), old - new), 6), "gain": F.round(F.greatest(F.lit(0.0), new - old), 6), "goodwill_due": money((new - old) * F.col("goodwill"))})


def impairment(rows: DataFrame, key: str) -> DataFrame:
    """Loss of a unit: its goodwill first, the rest over the other assets by carrying amount. ``rows`` has loss, amount, is_goodwill."""
    w = Window.partitionBy(key)
    goodwill = F.sum(F.when(F.col("is_goodwill"), F.col("amount")).otherwise(0.0)).over(w)
    first = F.least(F.col("loss"), goodwill)
    weight = F.when(F.col("is_goodwill"), 0.0).otherwise(F.col("amount"))
    others = F.sum(weight).over(w)
    own = F.when(F.col("is_goodwill"), F.when(goodwill > 0, first * F.col("amount") / goodwill).otherwise(0.0)).otherwise(F.when(others > 0, F.least(F.col("amount"), (F.col("loss") - first) * F.col("amount") / others)).otherwise(0.0))
    return rows.withColumn("charged", money(own))


# schedules


def depreciation(assets: DataFrame, method: str = "slm") -> DataFrame:
    """One row per asset and year: charge and carrying amount at its end.

    ``assets`` has asset_id, cost, residual, life (years), rate (per cent), and ``units`` (array per year) for ``units``."""
    rows = assets.withColumn("year", F.explode(F.sequence(F.lit(1), F.col("life"))))
    if method == "slm":
        charge = (F.col("cost") - F.col("residual")) / F.col("life")
        carrying = F.col("cost") - charge * F.col("year")
    elif method == "wdv":
        carrying = F.col("cost") * F.pow(1 - F.col("rate") / 100, F.col("year"))
        charge = F.col("cost") * F.pow(1 - F.col("rate") / 100, F.col("year") - 1) * F.col("rate") / 100
    else:
        every = F.aggregate("units", F.lit(0.0), lambda s, x: s + x)
        upto = F.aggregate(F.slice("units", F.lit(1), F.col("year")), F.lit(0.0), lambda s, x: s + x)
        charge = (F.col("cost") - F.col("residual")) * F.element_at("units", F.col("year")) / every
        carrying = F.col("cost") - (F.col("cost") - F.col("residual")) * upto / every
    return rows.select("asset_id", "year", money(charge).alias("charge"), money(carrying).alias("carrying"))


def revised_charge(cost: Column, residual: Column, life: Column, used: Column, new_life: Column) -> Column:
    """Yearly charge after the remaining life was estimated anew: the carrying amount over it."""
    carrying = cost - (cost - residual) / life * used
    return money((carrying - residual) / new_life)


def product_interest(rows: DataFrame, key: str, rate: float) -> DataFrame:
    """Interest by products: amount times months outstanding, at a yearly rate per cent."""
    return rows.groupBy(key).agg(money(F.sum(F.col("amount") * F.col("months")) * rate / 1200).alias("interest"))


def amortisation(loans: DataFrame) -> DataFrame:
    """One row per loan and instalment: interest, principal and balance, from the closed form of the balance.

    ``loans`` has loan_id, principal, rate (a period), n. The instalment is computed once per loan, and loans are dealt out before they unfold: a small
    file would unfold in one task."""
    i, n = F.col("rate"), F.col("n")
    instalment = F.when(i == 0, F.col("principal") / n).otherwise(F.col("principal") * i / (1 - F.pow(1 + i, -n)))
    rows = loans.repartition("loan_id").withColumn("pay", instalment).select("loan_id", "principal", "rate", "pay", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    grown = F.pow(1 + i, F.col("k") - 1)
    before = F.when(i == 0, F.col("principal") - F.col("pay") * (F.col("k") - 1)).otherwise(F.col("principal") * grown - F.col("pay") * (grown - 1) / i)
    rows = rows.withColumn("open", before)
    cents = lambda x: F.floor((x + NUDGE) * 100 + 0.5) / 100
    return rows.select("loan_id", "k", cents(F.col("pay")).alias("instalment"), cents(F.col("open") * i).alias("interest"), cents(F.col("open") * (1 + i) - F.col("pay")).alias("balance"))


def loan_totals(loans: DataFrame) -> DataFrame:
    i, n = F.col("rate"), F.col("n")
    instalment = F.when(i == 0, F.col("principal") / n).otherwise(F.col("principal") * i / (1 - F.pow(1 + i, -n)))
    return loans.select("loan_id", money(instalment, 2).alias("instalment"), money(instalment * n - F.col("principal"), 2).alias("interest"))


# tests and rates


def slab_tax(incomes: DataFrame, slabs: Sequence[tuple[float, float | None, float]], key: str, income: str) -> DataFrame:
    """Tax over bands (from, to, per cent), and the average rate."""
    tax = F.lit(0.0)
    for lo, hi, rate in slabs:
        top = F.least(F.col(income), F.lit(float(hi))) if hi is not None else F.col(income)
        tax = tax + F.greatest(F.lit(0.0), top - lo) * rate / 100
    return incomes.select(key, income, money(tax).alias("tax"), F.when(F.col(income) > 0, F.round(100 * tax / F.col(income), 4)).alias("average_rate"))


def segment_test(segments: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """Reportable segments of each entity: a tenth of revenue, of assets, or of the larger pool of profits and losses."""
    w = Window.partitionBy(key)
    revenue = F.col("external") + F.col("internal")
    profits, losses = F.sum(F.greatest("result", F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("result"), F.lit(0.0))).over(w)
    tests = {
        "by_revenue": revenue >= share * F.sum(revenue).over(w),
        "by_result": F.abs("result") >= share * F.greatest(profits, losses),
        "by_assets": F.col("assets") >= share * F.sum("assets").over(w),
    }
    rows = segments.withColumns(tests).withColumn("reportable", F.expr("by_revenue OR by_result OR by_assets"))
    covered = F.sum(F.when(F.col("reportable"), F.col("external")).otherwise(0.0)).over(w) >= 0.75 * F.sum("external").over(w)
    return rows.withColumn("covers_three_quarters", covered)


def earnings_per_share(rows: DataFrame, key: str) -> DataFrame:
    """Basic and diluted earnings over time-weighted shares; potential shares count only if they dilute.

    ``rows`` has earnings, shares, months, extra_earnings, extra_shares per change of the share count."""
    sums = rows.groupBy(key).agg(F.max("earnings").alias("e"), (F.sum(F.col("shares") * F.col("months")) / 12).alias("s"), F.max("extra_earnings").alias("xe"), F.max("extra_shares").alias("xs"))
    basic, diluted = F.col("e") / F.col("s"), (F.col("e") + F.col("xe")) / (F.col("s") + F.col("xs"))
    return sums.select(key, F.round(basic, 4).alias("basic"), F.round(F.least(basic, diluted), 4).alias("diluted"), (diluted < basic).alias("dilutive"))


def completion(rows: DataFrame, key: str) -> DataFrame:
    """Revenue of each period by percentage of completion, and the loss that is expected in all.

    ``rows`` has period, cost_to_date, estimated_total, price."""
    order = Window.partitionBy(key).orderBy("period")
    cumulative = F.col("price") * F.least(F.lit(1.0), F.col("cost_to_date") / F.col("estimated_total"))
    rows = rows.withColumn("_cum", cumulative)
    return rows.select(key, "period", money(F.col("_cum")).alias("revenue_to_date"), money(F.col("_cum") - F.coalesce(F.lag("_cum").over(order), F.lit(0.0))).alias("revenue"), money(F.greatest(F.lit(0.0), F.col("estimated_total") - F.col("price"))).alias("expected_loss"))


def age_provision(rows: DataFrame, bands: Sequence[tuple[int, float]], key: str) -> DataFrame:
    """Provision for debts by age: of the bands (from days, per cent) the last one reached holds."""
    rate = F.lit(0.0)
    for days, pct in sorted(bands):
        rate = F.when(F.col("age_days") >= days, pct).otherwise(rate)
    return rows.groupBy(key).agg(money(F.sum(F.col("amount") * rate / 100)).alias("provision"), money(F.sum("amount")).alias("debts"))


def translate(lines: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """Balance-sheet lines in the reporting currency: the rate depends on how the branch and the line are classed.

    An integral branch takes closing rates for monetary lines, historical ones for others and averages for income; a branch of its own
    closing rates for the balance sheet. The difference goes to profit or to the reserve accordingly."""
    kind = F.when(F.col("is_income"), "average").when(~F.col("integral") | F.col("monetary"), "closing").otherwise("historical")
    rows = lines.withColumn("rate_kind", kind).join(rates, ["currency", "rate_kind"])
    sums = rows.groupBy(key, "integral").agg(money(F.sum(F.col("amount") * F.col("rate"))).alias("difference"))
    return sums.select(key, "difference", F.when(F.col("integral"), "profit").otherwise("reserve").alias("taken_to"))


def buyback_limit(companies: DataFrame) -> DataFrame:
    """Shares that may be bought back: the least of a quarter of the shares, of what a quarter of the funds pays, and of what
    leaves twice the own funds to the debt. ``companies`` has shares, price, funds, debt, face, fresh_issue; ``reserve`` is the nominal value bought
    back beyond a fresh issue, ``board_amount`` what the board may spend alone."""
    by_shares, by_funds = F.floor(F.col("shares") * 0.25), F.floor(F.col("funds") * 0.25 / F.col("price"))
    by_debt = F.floor(F.greatest(F.lit(0.0), F.col("funds") - F.col("debt") / 2) / F.col("price"))
    rows = companies.withColumns({"by_shares": by_shares, "by_funds": by_funds, "by_debt": by_debt}).withColumn("limit", F.least("by_shares", "by_funds", "by_debt"))
    return rows.select("company_id", "by_shares", "by_funds", "by_debt", "limit", money(F.greatest(F.lit(0.0), F.col("limit") * F.col("face") - F.col("fresh_issue"))).alias("reserve"), money(F.col("funds") * 0.1).alias("board_amount"))
