"""Accounts from amounts by kind: cash flow by activity, contracts and revenue, plan assets and leave, purchases of businesses, branches, appropriations,
drawings, and income by three methods.

Rows carry an entity, a ``kind`` and an ``amount`` of two places; amounts of a kind are summed as decimals before any rule applies, so that no order of rows changes a
result. Missing kinds count as nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .firms import out, over

# How each kind of entry moves cash, by activity.
ACTIVITIES = {
    "operating": {"profit": 1, "depreciation": 1, "loss_on_sale": 1, "gain_on_sale": -1},
    "investing": {"assets_bought": -1, "sale_proceeds": 1, "investments_bought": -1, "dividends_received": 1},
    "financing": {"shares_issued": 1, "loans_repaid": -1, "dividends_paid": -1, "interest_paid": -1},
}


def by_kind(rows: DataFrame, key: str | Sequence[str], kinds: Sequence[str], amount: str = "amount") -> DataFrame:
    """A column of exact sums for each kind."""
    keys = [key] if isinstance(key, str) else list(key)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col(amount).cast("decimal(18,2)")).otherwise(0)).cast("double").alias(k)
    return rows.groupBy(*keys).agg(*map(of, kinds))


def cash_flow(entries: DataFrame, balances: DataFrame, entity: str) -> DataFrame:
    """Cash from operations by the indirect method (profit with what took no cash put back, less the rise of working assets, plus that of working
    liabilities), from investing and from financing, and their sum. ``balances`` has side (asset or liability), opening, closing."""
    sign = lambda kinds: sum((F.col(k) * n for k, n in kinds.items()), F.lit(0.0))
    sums = by_kind(entries, entity, [k for kinds in ACTIVITIES.values() for k in kinds])
    rise = F.when(F.col("side") == "asset", F.col("opening") - F.col("closing")).otherwise(F.col("closing") - F.col("opening"))
    working = balances.groupBy(entity).agg(F.sum(rise.cast("decimal(18,2)")).cast("double").alias("working"))
    rows = sums.join(working, entity, "full").fillna(0.0)
    flows = {name: out(sign(kinds) + (F.col("working") if name == "operating" else 0.0)) for name, kinds in ACTIVITIES.items()}
    return rows.select(entity, *(c.alias(n) for n, c in flows.items()), out(sum((sign(kinds) for kinds in ACTIVITIES.values()), F.col("working"))).alias("net"))


def by_balancing(rows: DataFrame, entity: str) -> DataFrame:
    """What an account must have had to close as it does: tax paid from the provision and the charge, assets bought from depreciation and what was sold."""
    sums = by_kind(rows, entity, ["provision_open", "charge", "provision_close", "asset_open", "depreciation", "sold_value", "asset_close"])
    paid = F.col("provision_open") + F.col("charge") - F.col("provision_close")
    return sums.select(entity, out(paid).alias("tax_paid"), out(F.col("asset_close") + F.col("depreciation") + F.col("sold_value") - F.col("asset_open")).alias("assets_bought"))


def contract_dues(rows: DataFrame, contract: str) -> DataFrame:
    """Contracts by stage of cost: kinds ``revenue`` (the price and what may be added to it), ``cost`` so far, ``future`` cost and ``billed``; parts that aren't ``eligible`` don't count.

    Where all costs exceed the price the whole loss is taken at once: ``provision`` is what of it the period's own figures don't show yet. Customers owe the cost, plus the profit or less the
    whole loss, less what was billed."""
    sums = by_kind(rows.filter("eligible"), contract, ["revenue", "cost", "future", "billed"])
    every = F.col("cost") + F.col("future")
    stage = F.coalesce(F.try_divide(F.col("cost"), every), F.lit(0.0))
    loss = over(every - F.col("revenue"))
    earned = F.col("revenue") * stage
    result = F.when(loss > 0, -loss).otherwise(earned - F.col("cost"))
    due = F.col("cost") + result - F.col("billed")
    return sums.select(contract, out(stage).alias("stage"), out(earned).alias("earned"), out(loss).alias("expected_loss"), out(F.when(loss > 0, over(loss - (F.col("cost") - earned))).otherwise(0.0)).alias("provision"), out(result).alias("result"), out(over(due)).alias("due_from"), out(over(-due)).alias("due_to"))


def recognised_revenue(rows: DataFrame, entity: str) -> DataFrame:
    """Revenue and the expense beside it: of a sale the amount less trade discount and rebate (a cash discount is an expense), of an agent its own charge, of a
    consignment what the consignee sold for (its commission is an expense), of goods on approval what was accepted or kept beyond the time to reject.
    ``rows`` has kind, amount, discount, charge, settled."""
    d = lambda c: F.col(c).cast("decimal(18,2)")
    revenue = F.when(F.col("kind") == "sale", d("amount") - d("discount")).when(F.col("kind") == "agency", d("charge")).when(F.col("kind") == "consignment", d("amount")).when((F.col("kind") == "approval") & F.col("settled"), d("amount")).otherwise(0)
    expense = F.when(F.col("kind").isin("sale", "consignment"), d("charge")).otherwise(0)
    return rows.groupBy(entity).agg(F.sum(revenue).cast("double").alias("revenue"), F.sum(expense).cast("double").alias("expense"))


def plan_assets(rows: DataFrame, plan: str, rate: float) -> DataFrame:
    """Expected return of plan assets at a yearly rate (on the net inflow of the middle of the year for half of it), and the actual one."""
    sums = by_kind(rows, plan, ["opening", "contributions", "benefits", "closing"])
    inflow = F.col("contributions") - F.col("benefits")
    expected, actual = F.col("opening") * rate / 100 + inflow * rate / 200, F.col("closing") - F.col("opening") - inflow
    return sums.select(plan, out(expected).alias("expected"), out(actual).alias("actual"), out(actual - expected).alias("gain"))


def leave_liability(rows: DataFrame, entity: str) -> DataFrame:
    """Pay for the days of leave that unused entitlement is expected to add. ``rows`` has entitled, expected (days) and daily_pay."""
    extra = F.greatest(F.col("expected") - F.col("entitled"), F.lit(0))
    return rows.groupBy(entity).agg(F.sum(extra).cast("long").alias("days"), F.sum((extra * F.col("daily_pay")).cast("decimal(18,2)")).cast("double").alias("liability"))


def purchase(holders: DataFrame, lines: DataFrame, company: str, assent: float = 0.9) -> DataFrame:
    """The purchase of a business: consideration is what its holders get, shares at their issue price and cash; net assets are agreed values less outside liabilities. The gap is
    goodwill or capital reserve. ``merger`` if holders of nine tenths of the shares agree, those left out that the buyer held before.
    ``holders`` has kind (shares or cash), number, price, held (by the buyer before), agrees; ``lines`` kind (asset or liability), amount."""
    paid = F.sum((F.col("number") * F.col("price")).cast("decimal(18,2)")).cast("double")
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("number"))), F.lit(0))
    equity = F.col("kind") == "shares"
    sums = holders.groupBy(company).agg(paid.alias("consideration"), of(equity & ~F.col("held")).alias("_outside"), of(equity & ~F.col("held") & F.col("agrees")).alias("_agreed"))
    net = by_kind(lines, company, ["asset", "liability"]).select(company, (F.col("asset") - F.col("liability")).alias("net_assets"))
    rows = sums.join(net, company, "left").fillna(0.0, ["net_assets"])
    gap = F.col("consideration") - F.col("net_assets")
    return rows.select(company, "consideration", "net_assets", out(over(gap)).alias("goodwill"), out(over(-gap)).alias("reserve"), ((F.col("_outside") > 0) & (F.col("_agreed") >= F.col("_outside") * assent)).alias("merger"))


def branch_profit(rows: DataFrame, branch: str) -> DataFrame:
    """A branch by the debtors method (what it sent and has at the end, less what it had and got), what it sold above the wholesale value, and its side of the head
    office's account: that balance less cash and goods still on their way."""
    sums = by_kind(rows, branch, ["remitted", "closing_stock", "opening_stock", "goods", "expenses", "retail_sales", "wholesale_value", "head_office", "cash_in_transit", "goods_in_transit"])
    profit = F.col("remitted") + F.col("closing_stock") - F.col("opening_stock") - F.col("goods") - F.col("expenses")
    return sums.select(branch, out(profit).alias("profit"), out(F.col("retail_sales") - F.col("wholesale_value")).alias("above_wholesale"), out(F.col("head_office") - F.col("cash_in_transit") - F.col("goods_in_transit")).alias("own_side"))


def appropriation(rows: DataFrame, partners: DataFrame, firm: str, normal: float) -> DataFrame:
    """Profit to share among partners (plus interest on drawings, less interest on capital, salaries and what goes to reserve), each one's share by ratio, and the
    firm's super profit: what its profit exceeds the normal return of its capital by. ``partners`` has partner_id, ratio."""
    sums = by_kind(rows, firm, ["profit", "drawings_interest", "capital_interest", "salary", "to_reserve", "capital"])
    divisible = F.col("profit") + F.col("drawings_interest") - F.col("capital_interest") - F.col("salary") - F.col("to_reserve")
    firms = sums.select(firm, divisible.alias("divisible"), (F.col("profit") - F.col("capital") * normal / 100).alias("super_profit"))
    ratios = partners.groupBy(firm).agg(F.sum("ratio").alias("_all"))
    rows = partners.join(firms, firm).join(ratios, firm)
    return rows.select(firm, "partner_id", out(F.col("divisible")).alias("divisible"), out(F.try_divide(F.col("divisible") * F.col("ratio"), F.col("_all"))).alias("share"), out(F.col("super_profit")).alias("super_profit"))


def instalment_drawings(rows: DataFrame, rate: float) -> DataFrame:
    """Interest on ``n`` equal drawings of ``amount`` a year, drawn at the ``beginning``, ``middle`` or ``end`` of each period: all of them for the average of the months that the first and the
    last one stay out."""
    length = F.lit(12.0) / F.col("n")
    first = 12 - length * F.when(F.col("timing") == "beginning", 0.0).when(F.col("timing") == "middle", 0.5).otherwise(1.0)
    last = first - length * (F.col("n") - 1)
    average = (first + last) / 2
    return rows.withColumns({"months": out(average), "interest": out(F.col("amount") * F.col("n") * average * rate / 1200)})


def transfers(rows: DataFrame) -> DataFrame:
    """Value at which an investment changes its class: the lower of cost and carrying amount where it becomes current, of cost and fair value where it
    becomes long-term. ``loss`` is what the carrying amount falls by."""
    value = F.when(F.col("to_current"), F.least("cost", "carrying")).otherwise(F.least("cost", "fair"))
    return rows.withColumns({"transfer": value, "loss": out(over(F.col("carrying") - value))})


def profit_equation(rows: DataFrame, entity: str) -> DataFrame:
    """Profit without a profit account: the rise of net assets, less capital brought in, plus drawings."""
    sums = by_kind(rows, entity, ["closing_assets", "closing_liabilities", "opening_assets", "opening_liabilities", "capital_in", "drawings"])
    c = F.col
    return sums.select(entity, out(c("closing_assets") - c("closing_liabilities") - c("opening_assets") + c("opening_liabilities") - c("capital_in") + c("drawings")).alias("profit"))


def income_methods(rows: DataFrame, nation: str) -> DataFrame:
    """Domestic income from what factors earn, domestic product from what is spent, and saving with its share."""
    sums = by_kind(rows, nation, ["wages", "rent", "interest", "profit", "mixed", "consumption", "investment", "government", "exports", "imports"])
    of = lambda *kinds: sum((F.col(k) for k in kinds), F.lit(0.0))
    income, product = of("wages", "rent", "interest", "profit", "mixed"), of("consumption", "investment", "government", "exports") - F.col("imports")
    saving = income - F.col("consumption")
    return sums.select(nation, out(income).alias("income"), out(product).alias("product"), out(saving).alias("saving"), out(F.try_divide(saving, income)).alias("average_saving"))


def equilibrium(rows: DataFrame) -> DataFrame:
    """Income at which spending equals it, for ``autonomous`` consumption, ``propensity`` to consume and ``investment``, and what ``more`` investment adds."""
    k = F.try_divide(F.lit(1.0), 1 - F.col("propensity"))
    y = (F.col("autonomous") + F.col("investment")) * k
    return rows.withColumns({"income": out(y), "consumption": out(F.col("autonomous") + F.col("propensity") * y), "added": out(k * F.col("more"))})


# What an adjustment does to accounts with debit balances (sales, whose balance is a credit, fall by a debit), in parts of its amount: all of it, its cost, the part that an
# insurer pays, or the rest of the cost.
LEGS = {
    "withdrawn": (("purchases", "cost", -1), ("drawings", "cost", 1)),
    "samples": (("purchases", "cost", -1), ("advertising", "cost", 1)),
    "abnormal_loss": (("purchases", "cost", -1), ("insurer", "insured", 1), ("losses", "uninsured", 1)),
    "on_approval": (("sales", "amount", 1), ("debtors", "amount", -1), ("closing_stock", "cost", 1), ("trading", "cost", -1)),
}


def adjusted_accounts(balances: DataFrame, adjustments: DataFrame, entity: str) -> DataFrame:
    """Accounts after adjustments, each of which changes its accounts by equal debits and credits. ``balances`` has account, amount (debits above zero);
    ``adjustments`` kind, amount (at selling price), margin (per cent on cost) and insured. An account that only an adjustment touches begins at nil."""
    d = lambda c: c.cast("decimal(18,2)")
    rows = adjustments.withColumn("cost", F.round(F.col("amount") * 100 / (100 + F.col("margin")), 2))
    rows = rows.withColumn("insured", F.least(F.coalesce("insured", F.lit(0.0)), "cost")).withColumn("uninsured", F.col("cost") - F.col("insured"))
    legs = F.lit(None).cast("array<struct<account:string,change:decimal(18,2)>>")
    for kind, parts in LEGS.items():
        legs = F.when(F.col("kind") == kind, F.array(*(F.struct(F.lit(account).alias("account"), d(F.col(part) * sign).alias("change")) for account, part, sign in parts))).otherwise(legs)
    changes = rows.select(entity, F.inline(legs)).groupBy(entity, "account").agg(F.sum("change").alias("change"))
    held = balances.groupBy(entity, "account").agg(F.sum(d(F.col("amount"))).alias("before"))
    both = held.join(changes, [entity, "account"], "full")
    before, change = F.coalesce("before", F.lit(0)), F.coalesce("change", F.lit(0))
    return both.select(entity, "account", before.cast("double").alias("before"), (before + change).cast("double").alias("after"))


def special_funds(rows: DataFrame, entity: str) -> DataFrame:
    """Funds kept for a purpose: what came in and what they were spent on. A fund pays its own expenses as far as it reaches (the rest is an ``excess`` that the year's
    income bears), and what it bought goes to the capital fund, as far as it still reaches. ``rows`` has fund, kind (opening, receipt, income, expense, asset), amount."""
    sums = by_kind(rows, [entity, "fund"], ["opening", "receipt", "income", "expense", "asset"])
    held = F.col("opening") + F.col("receipt") + F.col("income")
    left = over(held - F.col("expense"))
    moved = F.least(F.col("asset"), left)
    return sums.select(entity, "fund", out(left - moved).alias("closing"), out(over(F.col("expense") - held)).alias("excess"), out(moved).alias("to_capital"))


def capital_fund(rows: DataFrame, entity: str) -> DataFrame:
    """The capital fund of a body without owners: opening assets less debts, what is capitalised of special receipts, and the surplus of the year. Consumables that are used up are
    bought ones and those held at first, less those left and what suppliers of the year before were paid."""
    sums = by_kind(rows, entity, ["assets", "debts", "capitalised", "income", "expense", "stock_open", "paid", "creditors_open", "creditors_close", "stock_close"])
    consumed = F.col("stock_open") + F.col("paid") - F.col("creditors_open") + F.col("creditors_close") - F.col("stock_close")
    surplus = F.col("income") - F.col("expense") - consumed
    return sums.select(entity, out(consumed).alias("consumed"), out(surplus).alias("surplus"), out(F.col("assets") - F.col("debts") + F.col("capitalised") + surplus).alias("closing"))


def published_indices(sums: DataFrame, key: str) -> DataFrame:
    """Indices as they are published, with two places: ratios of exact sums with halves up, Fisher's root with halves to the even digit. ``sums`` has s00, s01, s10, s11 as whole numbers:
    prices of the base (0) or current (1) period, then quantities."""
    two = lambda top, low: F.floor((F.col(top) * 20_000 + F.col(low)).cast("decimal(38,0)") / (2 * F.col(low)).cast("decimal(38,0)")).cast("double") / 100
    fisher = 100 * F.sqrt(F.col("s10") / F.col("s00") * F.col("s11") / F.col("s01"))
    return sums.select(key, two("s10", "s00").alias("laspeyres"), two("s11", "s01").alias("paasche"), F.bround(fisher, 2).alias("fisher"))
