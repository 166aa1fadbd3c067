"""Statistics over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as op
from ..sources import adapters as a
from ..sources.adapters import PRICE, XY, table

QUERIES, ORACLES = {}, {}


def halves_up(sql: str) -> str:
    """The SQL with the nudge of ``r`` in each rounding of a result; roundings of inputs to no places stay."""
    out = ""
    while (at := sql.find("round(")) >= 0:
        end, depth = at + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        value, _, places = halves_up(sql[at + 6 : end - 1]).rpartition(",")
        kept = places.strip() == "0" or sql[:end].endswith("/* input */)")
        out, sql = f"{out}{sql[:at]}round({value}{'' if kept else f' + {op.NUDGE:.0e}'},{places})", sql[end:]
    return out + sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = halves_up(sql)
        return f

    return add


BASKET = f"""{PRICE}, b AS (SELECT p_brand AS basket, o.item, o.p AS p0, o.q AS q0, n.p AS p1, n.q AS q1 FROM pq o JOIN pq n ON n.item = o.item AND o.year = 1996 AND n.year = 1999 JOIN part ON p_partkey = o.item),
s AS (SELECT basket, count(*) AS items, sum(p0 * q0) AS s00, sum(p0 * q1) AS s01, sum(p1 * q0) AS s10, sum(p1 * q1) AS s11, sum(p0) AS p0, sum(p1) AS p1, avg(p1 / p0) AS rel FROM b GROUP BY 1)"""


def _basket(spark, sf_dir):
    pq = a.price_qty(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("basket"))
    of = lambda year, n: pq.filter(F.col("year") == year).select("item", F.col("p").alias(f"p{n}"), F.col("q").alias(f"q{n}"))
    return of(1996, 0).join(of(1999, 1), "item").join(part, "item")


@query(f"""WITH {BASKET} SELECT basket, items, round(100 * p1 / p0, 4) AS simple_aggregate, round(100 * rel, 4) AS mean_of_relatives, round(100 * s10 / s00, 4) AS laspeyres, round(100 * s11 / s01, 4) AS paasche,
  round(100 * sqrt(s10 / s00 * s11 / s01), 4) AS fisher, round(100 * (s10 + s11) / (s00 + s01), 4) AS marshall_edgeworth, round(100 * (s10 / s00 + s11 / s01) / 2, 4) AS dorbish_bowley, round(100 * s11 / s00, 4) AS value,
  round(100 * s01 / s00, 4) AS quantity_laspeyres, round(100 * sqrt(s01 / s00 * s11 / s10), 4) AS quantity_fisher FROM s""")
def price_indices(spark, sf_dir):
    return op.price_indices(_basket(spark, sf_dir), ["basket"])


@query(f"""WITH {BASKET} SELECT basket, abs(sqrt(s10 / s00 * s11 / s01) * sqrt(s01 / s11 * s00 / s10) - 1) < 1e-9 AS time_reversal,
  abs(sqrt(s10 / s00 * s11 / s01) * sqrt(s01 / s00 * s11 / s10) - s11 / s00) < 1e-9 AS factor_reversal, round(s10 / s00 * s01 / s11 - 1, 6) AS laspeyres_gap FROM s""")
def reversal_tests(spark, sf_dir):
    return op.reversal_tests(_basket(spark, sf_dir), ["basket"])


@query(f"""WITH {BASKET} SELECT basket, round(sum(100 * p1 / p0 * (p0 * q0)) / sum(p0 * q0), 4) AS "index", round(100 / (sum(100 * p1 / p0 * (p0 * q0)) / sum(p0 * q0)), 6) AS purchasing_power FROM b GROUP BY 1""")
def family_budget(spark, sf_dir):
    rows = _basket(spark, sf_dir).select("basket", (100 * F.col("p1") / F.col("p0")).alias("relative"), (F.col("p0") * F.col("q0")).alias("weight"))
    return op.family_budget(rows, ["basket"])


SERIES = "ser AS (SELECT p_brand AS brand, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_extendedprice) / sum(l_quantity) / 10 AS idx FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"


def _series(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.col("p_brand").alias("brand"), F.year("l_shipdate").alias("year")).agg((F.sum("l_extendedprice") / F.sum("l_quantity") / 10).alias("index"))


@query(f"WITH {SERIES}, b AS (SELECT brand, idx AS base FROM ser WHERE year = 1996) SELECT ser.brand, year, round(100 * idx / base, 4) AS shifted FROM ser LEFT JOIN b ON b.brand = ser.brand")
def shifted_series(spark, sf_dir):
    return op.shift_base(_series(spark, sf_dir), ["brand"], "year", 1996).select("brand", "year", "shifted")


@query(f"""WITH {SERIES}, o AS (SELECT * FROM ser WHERE year <= 1998), n AS (SELECT brand, year, idx * 0.8 AS idx FROM ser WHERE year >= 1998), l AS (SELECT o.brand, o.idx / n.idx AS f FROM o JOIN n ON n.brand = o.brand AND n.year = 1998 AND o.year = 1998)
SELECT brand, year, round(idx, 4) AS "index" FROM o UNION ALL SELECT n.brand, year, round(idx * f, 4) FROM n JOIN l ON l.brand = n.brand WHERE year > 1998""")
def spliced_series(spark, sf_dir):
    s = _series(spark, sf_dir)
    return op.splice(s.filter("year <= 1998"), s.filter("year >= 1998").withColumn("index", F.col("index") * 0.8), ["brand"], "year", 1998)


@query("""WITH y AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_extendedprice) / sum(l_quantity) AS p FROM lineitem GROUP BY 1), i AS (SELECT year, round(100 * p / (SELECT p FROM y WHERE year = 1996), 4) AS idx FROM y),
w AS (SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS money FROM orders GROUP BY 1, 2)
SELECT w.year, customer, money, round(100 * money / idx, 4) AS real, round(100 / idx, 6) AS purchasing_power FROM w JOIN i ON i.year = w.year""")
def deflated_spending(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("p"))
    index = op.shift_base(prices.select(F.lit("all").alias("series"), "year", F.col("p").alias("index")), ["series"], "year", 1996).select("year", F.col("shifted").alias("index"))
    money = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("money"))
    return op.deflate(money, index, "year", "money")


@query(f"""WITH {XY}, s AS (SELECT series_id, count(*) AS n, covar_pop(x, y) AS cov, var_pop(x) AS vx, var_pop(y) AS vy, avg(x) AS mx, avg(y) AS my FROM xy GROUP BY 1),
t AS (SELECT *, CASE WHEN vx > 0 AND vy > 0 THEN cov / sqrt(vx * vy) END AS r0, CASE WHEN vx > 0 THEN cov / vx END AS byx, CASE WHEN vy > 0 THEN cov / vy END AS bxy FROM s)
SELECT series_id, n, round(cov, 4) AS cov, round(r0, 4) AS r, round(byx, 4) AS slope_yx, round(bxy, 4) AS slope_xy, round(my - byx * mx, 4) AS intercept, round(sign(byx) * sqrt(byx * bxy), 4) AS r_from_slopes, round(0.6745 * (1 - r0 * r0) / sqrt(n), 4) AS probable_error FROM t""")
def correlation(spark, sf_dir):
    return op.correlation(a.xy(spark, sf_dir), "series_id")


@query(f"""WITH {XY}, k AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY x DESC) + (count(*) OVER (PARTITION BY series_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY series_id ORDER BY y DESC) + (count(*) OVER (PARTITION BY series_id, y) - 1) / 2.0 AS ry FROM xy),
b AS (SELECT series_id, count(*) AS n, CAST(sum((rx - ry) * (rx - ry)) AS DOUBLE) AS d2 FROM k GROUP BY 1),
t AS (SELECT series_id, sum(CAST(m * m * m - m AS DOUBLE)) AS t FROM (SELECT series_id, x AS v, count(*) AS m FROM xy GROUP BY 1, 2 UNION ALL SELECT series_id, y, count(*) FROM xy GROUP BY 1, 2) u GROUP BY 1)
SELECT b.series_id, n, CASE WHEN n > 1 THEN round(1 - 6 * (d2 + t / 12) / (CAST(n AS DOUBLE) * n * n - n), 4) END AS rho FROM b JOIN t ON t.series_id = b.series_id""")
def spearman_ties(spark, sf_dir):
    return op.spearman(a.xy(spark, sf_dir), "series_id")


@query("SELECT l_suppkey AS k, round(avg(l_quantity), 4) AS mean, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 4) AS weighted, round(exp(avg(ln(l_quantity))), 4) AS geometric, round(count(*) / sum(1 / l_quantity), 4) AS harmonic FROM lineitem GROUP BY 1")
def averages(spark, sf_dir):
    return op.averages(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k"), "k", "l_quantity", "l_extendedprice")


SPREAD = """b AS (SELECT l_suppkey AS k, count(*) AS n, avg(l_quantity) AS m, median(l_quantity) AS med, max(l_quantity) - min(l_quantity) AS range, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1),
d AS (SELECT l_suppkey AS k, avg(abs(l_quantity - m)) AS dm, avg(abs(l_quantity - med)) AS dd FROM lineitem JOIN b ON b.k = l_suppkey GROUP BY 1)"""


def _quantities(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))


@query(f"WITH {SPREAD} SELECT b.k, n, round(m, 4) AS mean, round(med, 4) AS median, round(range, 4) AS range, round(v, 4) AS variance, round(sqrt(v), 4) AS sd, round(100 * sqrt(v) / m, 4) AS cv, round(dm, 4) AS md_mean, round(dd, 4) AS md_median FROM b JOIN d ON d.k = b.k")
def dispersion(spark, sf_dir):
    return op.dispersion(_quantities(spark, sf_dir), "k", "v")


@query(f"WITH {SPREAD} SELECT k, round(100 * sqrt(v) / m, 4) AS cv FROM b ORDER BY 2, 1 LIMIT 1")
def steadiest_series(spark, sf_dir):
    return op.steadiest(op.dispersion(_quantities(spark, sf_dir), "k", "v"), "k")


@query("WITH p AS (SELECT l_suppkey % 10 AS g, l_suppkey AS k, count(*) AS n, round(avg(l_quantity), 6 /* input */) AS m, round(stddev_pop(l_quantity), 6 /* input */) AS s FROM lineitem GROUP BY 1, 2), c AS (SELECT g, sum(n) AS n, sum(n * m) / sum(n) AS m, sum(n * (s * s + m * m)) / sum(n) AS q FROM p GROUP BY 1) SELECT g, CAST(n AS BIGINT) AS n, round(m, 4) AS mean, round(sqrt(greatest(0, q - m * m)), 4) AS sd FROM c")
def combined_groups(spark, sf_dir):
    parts = _quantities(spark, sf_dir).groupBy((F.col("k") % 10).alias("g"), "k").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))
    return op.combined(parts, ["g"])


@query("WITH c AS (SELECT l_suppkey AS k, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, x) AS i FROM c) SELECT k, x AS mode, n AS freq FROM r WHERE i = 1")
def mode_discrete(spark, sf_dir):
    return op.mode_discrete(_quantities(spark, sf_dir), "k", "v")


_Q = "max(CASE WHEN i = greatest(1, least(n, CAST(floor((n + 1) * {q} / 4.0) AS BIGINT))) THEN CASE WHEN (n + 1) * {q} / 4.0 < 1 THEN v ELSE v + coalesce(CAST((n + 1) * {q} / 4.0 - floor((n + 1) * {q} / 4.0) AS DOUBLE) * (nx - v), 0) END END) AS q{q}"


@query(f"""WITH o AS (SELECT l_suppkey AS k, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n, lead(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS nx FROM lineitem),
s AS (SELECT k, {', '.join(_Q.format(q=q) for q in (1, 2, 3))} FROM o GROUP BY 1)
SELECT k, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, round((q3 - q1) / 2, 4) AS quartile_deviation, round((q3 - q1) / (q3 + q1), 4) AS coefficient FROM s""")
def raw_quartiles(spark, sf_dir):
    return op.quartiles(_quantities(spark, sf_dir), "k", "v")


CLASSES = "cls AS (SELECT l_suppkey AS k, floor(l_quantity / 10) * 10 AS lower, 10.0 AS width, count(*) AS freq FROM lineitem GROUP BY 1, 2)"


def _classes(spark, sf_dir):
    q = _quantities(spark, sf_dir)
    return q.groupBy("k", (F.floor(F.col("v") / 10) * 10.0).alias("lower")).agg(F.lit(10.0).alias("width"), F.count("*").alias("freq"))


_P = "min(CASE WHEN cum >= total * {s} AND cum - freq < total * {s} THEN lower + (CAST(total * {s} AS DOUBLE) - (cum - freq)) / freq * 10 END)"


@query(f"""WITH {CLASSES}, c AS (SELECT *, sum(freq) OVER (PARTITION BY k ORDER BY lower) AS cum, sum(freq) OVER (PARTITION BY k) AS total FROM cls)
SELECT k, round({_P.format(s=0.5)}, 4) AS median, round({_P.format(s=0.25)}, 4) AS q1, round({_P.format(s=0.75)}, 4) AS q3, round({_P.format(s=0.9)}, 4) AS p90 FROM c GROUP BY 1""")
def grouped_quantiles(spark, sf_dir):
    return op.partition_values(_classes(spark, sf_dir), "k", {"median": 0.5, "q1": 0.25, "q3": 0.75, "p90": 0.9})


@query(f"""WITH {CLASSES}, c AS (SELECT k, lower, freq AS f1, coalesce(lag(freq) OVER (PARTITION BY k ORDER BY lower), 0) AS f0, coalesce(lead(freq) OVER (PARTITION BY k ORDER BY lower), 0) AS f2 FROM cls),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f1 DESC, lower) AS i FROM c) SELECT k, CASE WHEN 2 * f1 - f0 - f2 > 0 THEN round(lower + CAST(f1 - f0 AS DOUBLE) / (2 * f1 - f0 - f2) * 10, 4) END AS mode FROM r WHERE i = 1""")
def mode_grouped(spark, sf_dir):
    return op.mode_grouped(_classes(spark, sf_dir), "k")


@query(f"""WITH {CLASSES}, c AS (SELECT k, CAST(sum(freq) AS BIGINT) AS n, sum(freq * (lower + 5)) / sum(freq) AS m, sum(freq * (lower + 5) * (lower + 5)) / sum(freq) AS q FROM cls GROUP BY 1) SELECT k, n, round(m, 4) AS mean, round(sqrt(greatest(0, q - m * m)), 4) AS sd FROM c""")
def grouped_mean(spark, sf_dir):
    return op.grouped_mean(_classes(spark, sf_dir), "k")


@query("""WITH s AS (SELECT l_suppkey AS k, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1), t AS (SELECT *, ceil(1 + 3.322 * log10(n)) AS c FROM s), w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / CAST(c AS DOUBLE) ELSE 1 END AS width FROM t),
p AS (SELECT w.*, CAST(least(c - 1, floor((l_quantity - lo) / width)) AS BIGINT) AS slot FROM lineitem JOIN w ON w.k = l_suppkey), f AS (SELECT k, slot, lo, width, n, count(*) AS freq FROM p GROUP BY 1, 2, 3, 4, 5)
SELECT k, slot AS "at", round(lo + slot * width, 4) AS lower, round(lo + slot * width + width, 4) AS upper, round(lo + slot * width + width / 2, 4) AS mark, freq, round(CAST(freq AS DOUBLE) / n, 6) AS share, round(freq / width, 6) AS density, round(CAST(360 * freq AS DOUBLE) / n, 3) AS angle,
  CAST(sum(freq) OVER (PARTITION BY k ORDER BY slot) AS BIGINT) AS less_than, CAST(sum(freq) OVER (PARTITION BY k ORDER BY slot DESC) AS BIGINT) AS more_than FROM f""")
def frequency_table(spark, sf_dir):
    return op.frequency_table(_quantities(spark, sf_dir), "k", "v")


COST = "tc AS (SELECT l_suppkey AS firm, CAST(year(l_shipdate) - 1991 AS INTEGER) AS output, round(sum(sum(l_extendedprice)) OVER (PARTITION BY l_suppkey ORDER BY year(l_shipdate)), 2 /* input */) AS total FROM lineitem GROUP BY l_suppkey, year(l_shipdate))"


def _costs(spark, sf_dir):
    from pyspark.sql import Window

    yearly = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("firm"), (F.year("l_shipdate") - 1991).alias("output")).agg(F.sum("l_extendedprice").alias("c"))
    return yearly.select("firm", "output", F.round(F.sum("c").over(Window.partitionBy("firm").orderBy("output")), 2).alias("total"))


@query(f"""WITH {COST}, l AS (SELECT *, lag(total) OVER (PARTITION BY firm ORDER BY output) AS t0, output - lag(output) OVER (PARTITION BY firm ORDER BY output) AS step FROM tc)
SELECT firm, output, total, CASE WHEN output <> 0 THEN round(total / output, 4) END AS average, CASE WHEN step <> 0 THEN round((total - t0) / step, 4) END AS marginal FROM l""")
def marginal_cost(spark, sf_dir):
    return op.marginal(_costs(spark, sf_dir), "firm", "output", "total")


@query(f"""WITH {PRICE}, l AS (SELECT *, lag(p) OVER (PARTITION BY item ORDER BY year) AS p0, lag(q) OVER (PARTITION BY item ORDER BY year) AS q0 FROM pq)
SELECT item, year, CASE WHEN p <> p0 THEN round((q - q0) / q0 / ((p - p0) / p0), 4) END AS point, CASE WHEN p <> p0 THEN round((q - q0) / (q + q0) / ((p - p0) / (p + p0)), 4) END AS arc FROM l WHERE p0 IS NOT NULL""")
def elasticity(spark, sf_dir):
    return op.elasticity(a.price_qty(spark, sf_dir), "item", "year")


@query(f"""WITH {PRICE}, l AS (SELECT item, year, p AS mc, q * 40 AS mr FROM pq), b AS (SELECT *, max(CASE WHEN mc > mr THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY year) AS br FROM l)
SELECT item, count(*) FILTER (WHERE br = 0) AS steps, max(CASE WHEN br = 0 THEN year END) AS last FROM b GROUP BY 1""")
def best_output(spark, sf_dir):
    rows = a.price_qty(spark, sf_dir).select("item", "year", F.col("p").alias("mc"), (F.col("q") * 40).alias("mr"))
    return op.best_output(rows, "item", "year")


@query("""WITH f AS (SELECT l_suppkey AS project, CAST(year(l_shipdate) AS INTEGER) - 1992 AS year, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2), g AS (SELECT project, year, amount FROM f UNION ALL SELECT project, 0, -3 * avg(amount) FROM f GROUP BY 1),
p AS (SELECT project, year, amount, amount / pow(1.13, year) AS pv FROM g) SELECT project, round(sum(pv), 2) AS npv, CASE WHEN -sum(CASE WHEN year = 0 THEN amount ELSE 0 END) > 0 THEN round(sum(CASE WHEN year > 0 THEN pv ELSE 0 END) / -sum(CASE WHEN year = 0 THEN amount ELSE 0 END), 4) END AS profitability FROM p GROUP BY 1""")
def net_present_value(spark, sf_dir):
    flows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("project"), (F.year("l_shipdate") - 1992).alias("year")).agg(F.sum("l_extendedprice").alias("amount"))
    out = flows.groupBy("project").agg(F.lit(0).alias("year"), (-3 * F.avg("amount")).alias("amount"))
    return op.net_present_value(flows.unionByName(out), "project", F.lit(0.13))


@query("""WITH f AS (SELECT p_partkey AS fund_id, p_retailprice * 100 AS target, 0.0437 AS rate, CAST(p_size % 12 + 1 AS INTEGER) AS n FROM part), p AS (SELECT fund_id, CAST(rate AS DOUBLE) AS i, target / ((pow(1 + CAST(rate AS DOUBLE), n) - 1) / CAST(rate AS DOUBLE)) AS pay, unnest(range(1, n + 1)) AS k FROM f)
SELECT fund_id, CAST(k AS INTEGER) AS k, round(pay, 2) AS instalment, round(pay * ((pow(1 + i, k) - 1) / i), 2) AS fund FROM p""")
def sinking_fund(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fund_id"), (F.col("p_retailprice") * 100).alias("target"), F.lit(0.0437).alias("rate"), (F.col("p_size") % 12 + 1).cast("int").alias("n"))
    return op.sinking_fund(rows, "fund_id", "target", "rate", "n")


@query("""WITH f AS (SELECT s_suppkey AS k, CAST(s_suppkey % 15 + 1 AS INTEGER) AS n, (s_nationkey + 1) / 27.0 AS p FROM supplier), x AS (SELECT *, unnest(range(0, n + 1)) AS x FROM f)
SELECT k, CAST(x AS INTEGER) AS x, round(CAST(factorial(n) AS DOUBLE) / CAST(factorial(CAST(x AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(n - x AS INTEGER)) AS DOUBLE) * pow(CAST(p AS DOUBLE), x) * pow(1 - CAST(p AS DOUBLE), n - x), 6) AS probability, CAST(floor((n + 1) * p) AS BIGINT) AS mode FROM x""")
def binomial(spark, sf_dir):
    params = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 15 + 1).cast("int").alias("n"), ((F.col("s_nationkey") + 1) / 27.0).alias("p"))
    return op.binomial(params, "k")


@query("""WITH f AS (SELECT s_suppkey AS k, (s_nationkey + 1) / 5.0 AS m FROM supplier), x AS (SELECT *, unnest(range(0, 13)) AS x FROM f)
SELECT k, CAST(x AS INTEGER) AS x, round(exp(-CAST(m AS DOUBLE)) * pow(CAST(m AS DOUBLE), x) / CAST(factorial(CAST(x AS INTEGER)) AS DOUBLE), 6) AS probability FROM x""")
def poisson(spark, sf_dir):
    params = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_nationkey") + 1) / 5.0).alias("mean"))
    return op.poisson(params, "k", 12)
