"""More ledger operators: calendars, rates by weight, components of aggregates, exchange, advantage, groups of companies, merges of state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bill_due
from .ledger import money

HOLIDAY_RUN = 14  # days within which a business day lies


def open_day(date: Column, holidays: Sequence[tuple[int, int]], forward: bool = False) -> Column:
    """The date itself if it is a business day, else the last one before it, or the next one. Sundays and the ``holidays`` (month, day) are closed; each
    row looks at its own days around, so no calendar is sorted or joined."""
    days = F.transform(F.sequence(F.lit(0), F.lit(HOLIDAY_RUN)), lambda i: F.date_add(date, i if forward else -i))
    closed = lambda d: (F.weekday(d) == 6) | reduce(or_, [(F.month(d) == m) & (F.dayofmonth(d) == n) for m, n in holidays], F.lit(False))
    return F.get(F.filter(days, lambda d: ~closed(d)), F.lit(0))


def business_calendar(days: DataFrame, holidays: Sequence[tuple[int, int]]) -> DataFrame:
    """``date`` with the business day on or before it and the one on or after it."""
    return days.withColumns({"previous_open": open_day(F.col("date"), holidays), "next_open": open_day(F.col("date"), holidays, forward=True)})


def settle_bills(bills: DataFrame, holidays: Sequence[tuple[int, int]]) -> DataFrame:
    """When bills fall due: ``start`` with its months and days, grace of three days unless payable on demand, and then the last business day up to that; where an emergency
    closes that very day (``emergency``) the next business day after it."""
    rows = bills.withColumn("matures", bill_due(F.col("start"), F.col("months"), F.col("days"), F.col("on_demand")))
    hit = F.coalesce(F.col("emergency") == F.col("matures"), F.lit(False))
    return rows.withColumn("due", F.when(hit, open_day(F.date_add("matures", 1), holidays, forward=True)).otherwise(open_day(F.col("matures"), holidays)))


def weighted_rate(rows: DataFrame, key: str, amount: str, rate: str) -> DataFrame:
    """Rate of a pool of borrowings by amount, and the cost of the whole pool."""
    return rows.groupBy(key).agg(F.round(F.sum(F.col(amount) * F.col(rate)) / F.sum(amount) + 1e-8, 4).alias("rate"), money(F.sum(F.col(amount) * F.col(rate)) / 100).alias("cost"))


def absorbed_overhead(rows: DataFrame, key: str) -> DataFrame:
    """Fixed overhead by normal capacity: what the output absorbs and what is charged at once. ``rows`` has overhead, normal, actual."""
    absorbed = F.col("overhead") * F.least(F.lit(1.0), F.col("actual") / F.col("normal"))
    return rows.select(key, money(absorbed).alias("absorbed"), money(F.col("overhead") - absorbed).alias("unabsorbed"))


def time_weighted_interest(moves: DataFrame, key: str, rate: float) -> DataFrame:
    """Interest on capital with changes within the year: each signed movement counts for the months that remain."""
    return moves.groupBy(key).agg(money(F.sum("amount")).alias("closing"), money(F.sum(F.col("amount") * F.col("months_left")) * rate / 1200).alias("interest"))


def by_activity(flows: DataFrame, key: str, activity: str, amount: str) -> DataFrame:
    """Cash flow of each activity and, with a null activity, of each key as a whole."""
    return flows.rollup(key, activity).agg(money(F.sum(amount)).alias("net")).filter(F.col(key).isNotNull())


def components(rows: DataFrame, key: str, kind: str, amount: str, names: Mapping[str, str]) -> DataFrame:
    """One column per component of an aggregate, 0 where it is missing."""
    return rows.groupBy(key).agg(*(money(F.sum(F.when(F.col(kind) == k, F.col(amount)).otherwise(0.0))).alias(n) for n, k in names.items()))


def national_income(parts: DataFrame) -> DataFrame:
    """Domestic, national and net products from the components of spending, and both price bases."""
    gdp = F.col("consumption") + F.col("investment") + F.col("government")
    gnp = gdp + F.col("abroad")
    nnp = gnp - F.col("depreciation")
    return parts.select(parts.columns[0], money(gdp).alias("gdp"), money(gnp).alias("gnp"), money(nnp).alias("nnp"), money(nnp - F.col("indirect_tax")).alias("national_income"))


def comparative_advantage(output: DataFrame, good_a: str, good_b: str) -> DataFrame:
    """Per pair of countries (``pair``): who makes more of each good, and who gives up less of the other one for it; ties by name."""
    first = lambda value: F.min(F.struct(value.alias("v"), F.col("country").alias("c")))["c"]
    a, b = F.col(good_a), F.col(good_b)
    return output.groupBy("pair").agg(first(-a).alias("absolute_a"), first(-b).alias("absolute_b"), first(b / a).alias("comparative_a"), first(a / b).alias("comparative_b"))


def cross_rates(rates: DataFrame, base: str) -> DataFrame:
    """Rates of all currencies against ``base``, through the common currency that ``rate`` counts."""
    at = rates.filter(F.col("currency") == base).select(F.col("day"), F.col("rate").alias("_base"))
    return rates.join(at, "day").select("day", "currency", F.round(F.col("rate") / F.col("_base") + 1e-8, 6).alias("cross"))


def consolidation(holdings: DataFrame) -> DataFrame:
    """Per subsidiary: the group's and the minority's share of net assets, goodwill or reserve on the cost, and the unrealised profit
    in stock that goes out. ``holdings`` has share (per cent), cost, net_assets, stock, loading (per cent on cost)."""
    share = F.col("share") / 100
    gap = F.col("cost") - F.col("net_assets") * share
    return holdings.select("company", money(F.col("net_assets") * share).alias("group_share"), money(F.col("net_assets") * (1 - share)).alias("minority"), money(F.greatest(F.lit(0.0), gap)).alias("goodwill"), money(F.greatest(F.lit(0.0), -gap)).alias("reserve"), money(F.col("stock") * F.col("loading") / (100 + F.col("loading"))).alias("unrealised"))


def net_worth_profit(rows: DataFrame, key: str) -> DataFrame:
    """Profit from two statements of affairs: the rise in net worth, plus drawings, less capital brought in."""
    sign = F.when(F.col("kind").isin("closing", "drawings"), 1.0).when(F.col("kind").isin("opening", "introduced"), -1.0).otherwise(0.0)
    return rows.groupBy(key).agg(money(F.sum(F.col("amount") * sign)).alias("profit"))


def forfeiture(calls: DataFrame, key: str) -> DataFrame:
    """Forfeited shares by holder: what was paid, what is due, and what a reissue at ``reissue`` a share leaves to reserve.

    ``calls`` has a row per instalment: shares, amount (a share), paid, face, reissue."""
    sums = calls.groupBy(key).agg(F.max("shares").alias("n"), F.sum(F.when(F.col("paid"), F.col("amount")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("paid"), 0.0).otherwise(F.col("amount"))).alias("d"), F.max("face").alias("f"), F.max("reissue").alias("r"))
    return sums.select(key, money(F.col("n") * F.col("p")).alias("forfeited"), money(F.col("n") * F.col("d")).alias("unpaid"), money(F.col("n") * F.greatest(F.lit(0.0), F.col("p") - F.greatest(F.lit(0.0), F.col("f") - F.col("r")))).alias("to_reserve"))


def discount_and_rebate(bills: DataFrame, year_end: str, rate: float) -> DataFrame:
    """Discount of each bill for its days, and the rebate for those after the year's end."""
    whole, after = F.date_diff("due", "discounted"), F.greatest(F.lit(0), F.date_diff("due", F.lit(year_end).cast("date")))
    of = lambda days: money(F.col("amount") * rate / 100 * days / 365)
    return bills.select("bill_id", of(whole).alias("discount"), of(F.least(whole, after)).alias("rebate"))


def restore(own: DataFrame, imported: DataFrame, keys: Sequence[str], days: int = 5) -> DataFrame:
    """Mastery after a backup was restored: the higher level, and the last days of both lists. Levels aren't derived anew from the days."""
    a = own.select(*keys, F.col("level").alias("_l"), F.col("days").alias("_d"))
    b = imported.select(*keys, F.col("level").alias("_m"), F.col("days").alias("_e"))
    none = F.array().cast(dict(own.dtypes)["days"])
    every = F.array_sort(F.array_union(F.coalesce("_d", none), F.coalesce("_e", none)))
    rows = a.join(b, [*keys], "full")
    return rows.select(*keys, F.greatest(F.coalesce("_l", F.lit(0)), F.coalesce("_m", F.lit(0))).alias("level"), F.slice(every, F.greatest(F.lit(1), F.size(every) - days + 1), F.lit(days)).alias("days"))


def share_to_exit(rows: DataFrame, key: str, by_turnover: Column) -> DataFrame:
    """Share of a year's profit up to a partner's exit: by months, or by turnover to then."""
    part = F.when(by_turnover, F.col("turnover_to_exit") / F.col("turnover")).otherwise(F.col("months") / 12)
    return rows.select(key, money(F.col("profit") * F.col("ratio") * part).alias("share"))
