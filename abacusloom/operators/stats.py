"""Statistics and time value over grouped tables. Sums are gathered once; ratios and roots come last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import BLOCK_ROWS, running

NUDGE = 1e-8


def r(x: Column, places: int = 4) -> Column:
    """Rounded with halves up, also those that a binary fraction holds slightly too low."""
    return F.round(x + NUDGE, places)


# index numbers


def price_indices(rows: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Price and quantity indices of a basket from four sums of one pass. ``rows`` has p0, q0, p1, q1 per item."""
    s = {f"s{a}{b}": F.sum(F.col(f"p{a}") * F.col(f"q{b}")) for a in (0, 1) for b in (0, 1)}
    sums = rows.groupBy(*key).agg(*(c.alias(n) for n, c in s.items()), F.count("*").alias("items"), F.sum("p0").alias("p0"), F.sum("p1").alias("p1"), F.avg(F.col("p1") / F.col("p0")).alias("relative"))
    laspeyres, paasche = F.col("s10") / F.col("s00"), F.col("s11") / F.col("s01")
    found = {
        "simple_aggregate": F.col("p1") / F.col("p0"),
        "mean_of_relatives": F.col("relative"),
        "laspeyres": laspeyres,
        "paasche": paasche,
        "fisher": F.sqrt(laspeyres * paasche),
        "marshall_edgeworth": (F.col("s10") + F.col("s11")) / (F.col("s00") + F.col("s01")),
        "dorbish_bowley": (laspeyres + paasche) / 2,
        "value": F.col("s11") / F.col("s00"),
        "quantity_laspeyres": F.col("s01") / F.col("s00"),
        "quantity_fisher": F.sqrt(F.col("s01") / F.col("s00") * F.col("s11") / F.col("s10")),
    }
    return sums.select(*key, "items", *(r(100 * c).alias(n) for n, c in found.items()))


def reversal_tests(rows: DataFrame, key: Sequence[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """Whether the Fisher index passes the time and the factor reversal test, and how far Laspeyres misses the former."""
    s = lambda a, b: F.sum(F.col(f"p{a}") * F.col(f"q{b}"))
    sums = rows.groupBy(*key).agg(s(0, 0).alias("s00"), s(0, 1).alias("s01"), s(1, 0).alias("s10"), s(1, 1).alias("s11"))
    forth = F.sqrt(F.col("s10") / F.col("s00") * F.col("s11") / F.col("s01"))
    back = F.sqrt(F.col("s01") / F.col("s11") * F.col("s00") / F.col("s10"))
    quantity = F.sqrt(F.col("s01") / F.col("s00") * F.col("s11") / F.col("s10"))
    return sums.select(*key, (F.abs(forth * back - 1) < tolerance).alias("time_reversal"), (F.abs(forth * quantity - F.col("s11") / F.col("s00")) < tolerance).alias("factor_reversal"), r(F.col("s10") / F.col("s00") * F.col("s01") / F.col("s11") - 1, 6).alias("laspeyres_gap"))


def family_budget(rows: DataFrame, key: Sequence[str], relative: str = "relative", weight: str = "weight") -> DataFrame:
    """Weighted mean of price relatives, and the purchasing power it leaves."""
    index = F.sum(F.col(relative) * F.col(weight)) / F.sum(weight)
    return rows.groupBy(*key).agg(r(index).alias("index"), r(100 / index, 6).alias("purchasing_power"))


def shift_base(series: DataFrame, key: Sequence[str], period: str, base: int | str) -> DataFrame:
    """Index series with ``base`` as 100; series without that period have null."""
    at = F.max(F.when(F.col(period) == base, F.col("index"))).over(Window.partitionBy(*key))
    return series.withColumn("shifted", r(100 * F.col("index") / at))


def splice(old: DataFrame, new: DataFrame, key: Sequence[str], period: str, overlap: int | str) -> DataFrame:
    """One series on the old base: the old one up to the overlap period, the new one after it, scaled so that both agree there."""
    link = old.filter(F.col(period) == overlap).select(*key, F.col("index").alias("_old")).join(new.filter(F.col(period) == overlap).select(*key, F.col("index").alias("_new")), [*key])
    late = new.filter(F.col(period) > overlap).join(link, [*key]).select(*key, period, r(F.col("index") * F.col("_old") / F.col("_new")).alias("index"))
    return old.filter(F.col(period) <= overlap).select(*key, period, r(F.col("index")).alias("index")).unionByName(late)


def deflate(values: DataFrame, index: DataFrame, period: str, value: str) -> DataFrame:
    """Money values at base prices, by the cost index of their period, and what a unit of money then buys. The index is one row a period."""
    rows = values.join(index.select(period, "index"), period)
    return rows.withColumns({"real": r(100 * F.col(value) / F.col("index")), "purchasing_power": r(100 / F.col("index"), 6)}).drop("index")


# correlation


def correlation(points: DataFrame, key: str) -> DataFrame:
    """Pearson's r, covariance, both regression slopes, r from the slopes, and the probable error."""
    n, cov = F.count("*"), F.covar_pop("x", "y")
    sums = points.groupBy(key).agg(n.alias("n"), cov.alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    corr = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("cov") / F.sqrt(F.col("vx") * F.col("vy")))
    byx, bxy = F.when(F.col("vx") > 0, F.col("cov") / F.col("vx")), F.when(F.col("vy") > 0, F.col("cov") / F.col("vy"))
    return sums.select(key, "n", r(F.col("cov")).alias("cov"), r(corr).alias("r"), r(byx).alias("slope_yx"), r(bxy).alias("slope_xy"), r(F.col("my") - byx * F.col("mx")).alias("intercept"), r(F.signum(byx) * F.sqrt(byx * bxy)).alias("r_from_slopes"), r(0.6745 * (1 - corr * corr) / F.sqrt("n")).alias("probable_error"))


def average_ranks(rows: DataFrame, key: str, value: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rank 1 for the highest; equal values share the mean of their ranks. Only distinct values are sorted, a large group's in blocks."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    above = running(counts, [key], [value], {"_upto": "_n"}, descending=True, block_rows=block_rows, source=rows)
    ranks = above.select(key, value, (F.col("_upto") - F.col("_n") + 1 + (F.col("_n") - 1) / 2).alias(name))
    return rows.join(ranks, [key, value])


def spearman(points: DataFrame, key: str) -> DataFrame:
    """Rank correlation with the correction for ties, a twelfth of m^3 - m for every set of m equal values."""
    ranked = average_ranks(average_ranks(points.select(key, "x", "y"), key, "x", "rx"), key, "y", "ry")
    base = ranked.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("rx") - F.col("ry"), 2)).alias("d2"))
    for v in ("x", "y"):
        sets = points.groupBy(key, v).agg(F.count("*").cast("double").alias("m")).groupBy(key).agg(F.sum(F.pow("m", 3) - F.col("m")).alias(f"t{v}"))
        base = base.join(sets, key)
    n = F.col("n").cast("double")
    return base.select(key, "n", F.when(F.col("n") > 1, r(1 - 6 * (F.col("d2") + (F.col("tx") + F.col("ty")) / 12) / (F.pow(n, 3) - n))).alias("rho"))


# averages and spread


def averages(rows: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """Arithmetic, weighted, geometric and harmonic mean of positive values."""
    v, w = F.col(value), F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy(key).agg(r(F.avg(v)).alias("mean"), r(F.sum(v * w) / F.sum(w)).alias("weighted"), r(F.exp(F.avg(F.log(v)))).alias("geometric"), r(F.count("*") / F.sum(1 / v)).alias("harmonic"))


def dispersion(rows: DataFrame, key: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Range, population variance and deviation, coefficient of variation, and mean deviation about mean and median. Distinct values with their counts stand for
    the rows, so that no group's values are held together."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ranked = running(counts, [key], ["v"], {"upto": "c"}, {"all": "upto"}, block_rows=block_rows, source=rows)
    median = (_at("upto", "v", F.floor((F.col("all") + 1) / 2)) + _at("upto", "v", F.floor(F.col("all") / 2) + 1)) / 2
    base = ranked.groupBy(key).agg(F.max("all").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("m"), median.alias("med"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    n = F.sum("c")
    about = counts.join(base.select(key, "m", "med"), key).groupBy(key).agg(*((F.sum(x * F.col("c")) / n).alias(name) for name, x in (("md_mean", F.abs(F.col("v") - F.col("m"))), ("md_median", F.abs(F.col("v") - F.col("med"))), ("variance", (F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))))))
    sd = F.sqrt("variance")
    return base.join(about, key).select(key, "n", r(F.col("m")).alias("mean"), r(F.col("med")).alias("median"), r(F.col("hi") - F.col("lo")).alias("range"), r(F.col("variance")).alias("variance"), r(sd).alias("sd"), r(100 * sd / F.col("m")).alias("cv"), r(F.col("md_mean")).alias("md_mean"), r(F.col("md_median")).alias("md_median"))


def combined(parts: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of groups together from the n, mean and sd of each."""
    n, m, s = F.col("n"), F.col("mean"), F.col("sd")
    sums = parts.groupBy(*key).agg(F.sum(n).alias("n"), (F.sum(n * m) / F.sum(n)).alias("m"), (F.sum(n * (s * s + m * m)) / F.sum(n)).alias("q"))
    return sums.select(*key, "n", r(F.col("m")).alias("mean"), r(F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")))).alias("sd"))


def steadiest(spread: DataFrame, key: str) -> DataFrame:
    """The series with the smallest coefficient of variation; of equal ones that with the smallest key."""
    return spread.agg(F.min(F.struct("cv", key)).alias("s")).select(F.col(f"s.{key}").alias(key), "s.cv")


def mode_discrete(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value; of equally frequent ones the lowest."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("x"))).alias("s"))
    return best.select(key, F.col("s.x").alias("mode"), (-F.col("s.m")).alias("freq"))


def _at(upto: str, found: str, place: Column) -> Column:
    """The value at a place (from 1) of the ordered values whose distinct ones have running counts ``upto``: the first that reaches the place."""
    return F.min(F.when(F.col(upto) >= place, F.col(found)))


def quartiles(rows: DataFrame, key: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Quartiles at positions (n + 1) / 4 and so on of the ordered values, with their deviation and its coefficient. Only distinct values are sorted."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ranked = running(counts, [key], ["v"], {"upto": "c"}, {"n": "upto"}, block_rows=block_rows, source=rows)
    found = {}
    for q in (1, 2, 3):
        at = (F.col("n") + 1) * q / 4
        low = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(at)))
        found |= {f"lo{q}": _at("upto", "v", low), f"hi{q}": _at("upto", "v", F.least(F.col("n"), low + 1)), f"part{q}": F.max(F.when(at < 1, 0.0).otherwise(at - F.floor(at)))}
    sums = ranked.groupBy(key).agg(*(c.alias(n) for n, c in found.items()))
    for q in (1, 2, 3):
        sums = sums.withColumn(f"q{q}", F.col(f"lo{q}") + F.col(f"part{q}") * (F.col(f"hi{q}") - F.col(f"lo{q}")))
    half = (F.col("q3") - F.col("q1")) / 2
    return sums.select(key, *(r(F.col(f"q{q}")).alias(f"q{q}") for q in (1, 2, 3)), r(half).alias("quartile_deviation"), r((F.col("q3") - F.col("q1")) / (F.col("q3") + F.col("q1"))).alias("coefficient"))


# grouped data: key, lower, width, freq


def partition_values(classes: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """Partition values of grouped data by linear interpolation in the first class that reaches the position."""
    order = Window.partitionBy(key).orderBy("lower")
    rows = classes.select(key, "lower", "width", "freq", F.sum("freq").over(order).alias("cum"), F.sum("freq").over(Window.partitionBy(key)).alias("total"))
    found = {}
    for name, share in shares.items():
        at = F.col("total") * share
        inside = (F.col("cum") >= at) & (F.col("cum") - F.col("freq") < at) & (F.col("freq") > 0)
        found[name] = F.min(F.when(inside, F.col("lower") + (at - (F.col("cum") - F.col("freq"))) / F.col("freq") * F.col("width")))
    return rows.groupBy(key).agg(*(r(c).alias(n) for n, c in found.items()))


def mode_grouped(classes: DataFrame, key: str) -> DataFrame:
    """Mode of grouped data from the fullest class (the lowest of equal ones) and its neighbours."""
    order = Window.partitionBy(key).orderBy("lower")
    rows = classes.select(key, "lower", "width", F.col("freq").alias("f1"), F.coalesce(F.lag("freq").over(order), F.lit(0)).alias("f0"), F.coalesce(F.lead("freq").over(order), F.lit(0)).alias("f2"))
    best = rows.groupBy(key).agg(F.min(F.struct((-F.col("f1")).alias("m"), "lower", "width", "f0", "f1", "f2")).alias("c")).select(key, "c.*")
    bend = 2 * F.col("f1") - F.col("f0") - F.col("f2")
    return best.select(key, F.when(bend > 0, r(F.col("lower") + (F.col("f1") - F.col("f0")) / bend * F.col("width"))).alias("mode"))


def grouped_mean(classes: DataFrame, key: str) -> DataFrame:
    """Mean and population deviation of grouped data at the class marks."""
    x, f = F.col("lower") + F.col("width") / 2, F.col("freq")
    sums = classes.groupBy(key).agg(F.sum(f).alias("n"), (F.sum(f * x) / F.sum(f)).alias("m"), (F.sum(f * x * x) / F.sum(f)).alias("q"))
    return sums.select(key, "n", r(F.col("m")).alias("mean"), r(F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")))).alias("sd"))


def frequency_table(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Classes by Sturges' rule, with boundaries, mark, shares, density, pie angle and both cumulative counts."""
    span = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    span = span.withColumn("classes", F.ceil(1 + 3.322 * F.log10("n"))).withColumn("width", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("classes")).otherwise(1.0))
    placed = rows.select(key, value).join(span, key).withColumn("at", F.least(F.col("classes") - 1, F.floor((F.col(value) - F.col("lo")) / F.col("width"))))
    counts = placed.groupBy(key, "at", "lo", "width", "n").agg(F.count("*").alias("freq"))
    less = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    more = Window.partitionBy(key).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    lower = F.col("lo") + F.col("at") * F.col("width")
    return counts.select(key, "at", r(lower).alias("lower"), r(lower + F.col("width")).alias("upper"), r(lower + F.col("width") / 2).alias("mark"), "freq", r(F.col("freq") / F.col("n"), 6).alias("share"), r(F.col("freq") / F.col("width"), 6).alias("density"), r(360 * F.col("freq") / F.col("n"), 3).alias("angle"), F.sum("freq").over(less).alias("less_than"), F.sum("freq").over(more).alias("more_than"))


# series


def marginal(series: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """Average and marginal of a total over the ordered quantity."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.col(order) - F.lag(order).over(w)
    return series.select(key, order, total, r(F.when(F.col(order) != 0, F.col(total) / F.col(order))).alias("average"), r(F.when(step != 0, (F.col(total) - F.lag(total).over(w)) / step)).alias("marginal"))


def elasticity(series: DataFrame, key: str, order: str) -> DataFrame:
    """Point and arc elasticity of quantity ``q`` to price ``p`` between consecutive observations; null without a change of price."""
    w = Window.partitionBy(key).orderBy(order)
    rows = series.select(key, order, "p", "q", F.lag("p").over(w).alias("p0"), F.lag("q").over(w).alias("q0")).filter("p0 IS NOT NULL")
    point = F.try_divide((F.col("q") - F.col("q0")) / F.col("q0"), (F.col("p") - F.col("p0")) / F.col("p0"))
    arc = F.try_divide((F.col("q") - F.col("q0")) / (F.col("q") + F.col("q0")), (F.col("p") - F.col("p0")) / (F.col("p") + F.col("p0")))
    return rows.select(key, order, r(point).alias("point"), r(arc).alias("arc"))


def best_output(schedule: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key before marginal cost ``mc`` first exceeds marginal revenue ``mr``: how many, and the last of them."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = schedule.withColumn("_breach", F.max((F.col("mc") > F.col("mr")).cast("int")).over(upto))
    kept = F.col("_breach") == 0
    return rows.groupBy(key).agg(F.count_if(kept).alias("steps"), F.max(F.when(kept, F.col(order))).alias("last"))


# time value


def growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def annuity_present(rate: Column, n: Column) -> Column:
    return F.when(rate == 0, n).otherwise((1 - F.pow(1 + rate, -n)) / rate)


def annuity_future(rate: Column, n: Column) -> Column:
    return F.when(rate == 0, n).otherwise((F.pow(1 + rate, n) - 1) / rate)


def net_present_value(flows: DataFrame, key: str, rate: Column) -> DataFrame:
    """Net present value and profitability index; ``flows`` has year (0 for outlays) and amount."""
    pv = F.col("amount") / F.pow(1 + rate, F.col("year"))
    out, back = -F.sum(F.when(F.col("year") == 0, F.col("amount")).otherwise(0.0)), F.sum(F.when(F.col("year") > 0, pv).otherwise(0.0))
    return flows.groupBy(key).agg(r(F.sum(pv), 2).alias("npv"), F.when(out > 0, r(back / out)).alias("profitability"))


def sinking_fund(rows: DataFrame, key: str, target: str, rate: str, n: str) -> DataFrame:
    """Instalment that grows to the target, and the fund after each period."""
    pay = F.col(target) / annuity_future(F.col(rate), F.col(n))
    return rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col(n)))).select(key, "k", r(pay, 2).alias("instalment"), r(pay * annuity_future(F.col(rate), F.col("k")), 2).alias("fund"))


def binomial(params: DataFrame, key: str) -> DataFrame:
    """Probability of each number of successes (columns n, p with 0 < p < 1), by sums of logarithms; and the mode."""
    rows = params.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n"))))
    log_choose = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("x"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("x"), F.log((F.col("n") - F.col("x") + i) / i)).otherwise(0.0))
    return rows.select(key, "x", r(F.exp(log_choose + F.col("x") * F.log("p") + (F.col("n") - F.col("x")) * F.log(1 - F.col("p"))), 6).alias("probability"), F.floor((F.col("n") + 1) * F.col("p")).alias("mode"))


def poisson(params: DataFrame, key: str, upto: int) -> DataFrame:
    rows = params.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(upto))))
    log_factorial = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("x"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i))
    return rows.select(key, "x", r(F.exp(F.col("x") * F.log("mean") - F.col("mean") - log_factorial), 6).alias("probability"))
