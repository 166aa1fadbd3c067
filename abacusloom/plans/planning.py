"""Study plans for the customers as learners, each with its SQL: calendar, kinds of days, mocks, streams of chapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import plan
from ..sources.adapters import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


REQUEST = """req AS (SELECT c_custkey AS plan_id, DATE '2026-01-05' + CAST(c_custkey * 7 % 113 AS INTEGER) AS start_date, DATE '2026-05-03' + CAST(c_custkey % 11 AS INTEGER) AS exam_date,
  c_custkey % 70 AS hours, DATE '2026-01-20' + CAST(c_custkey % 90 AS INTEGER) AS cutoff, CASE c_custkey % 4 WHEN 0 THEN 'class12' WHEN 1 THEN 'postboards' WHEN 2 THEN 'bcom' END AS mode FROM customer)"""


def _requests(spark, sf_dir):
    k = F.col("c_custkey")
    on = lambda day, n: F.date_add(F.lit(day).cast("date"), n.cast("int"))
    mode = F.when(k % 4 == 0, "class12").when(k % 4 == 1, "postboards").when(k % 4 == 2, "bcom")
    return table(spark, sf_dir, "customer").select(k.alias("plan_id"), on("2026-01-05", k * 7 % 113).alias("start_date"), on("2026-05-03", k % 11).alias("exam_date"), (k % 70).alias("hours"), on("2026-01-20", k % 90).alias("cutoff"), mode.alias("mode"))


# by the rule's own steps: lists of days, slices of them, then one choice after another
DAYS = f"""{REQUEST}, d0 AS MATERIALIZED (SELECT plan_id, start_date, exam_date, unnest(range(0, date_diff('day', start_date, exam_date))) AS seq FROM req),
d1 AS MATERIALIZED (SELECT plan_id, start_date + CAST(seq AS INTEGER) AS date, exam_date, CAST(seq AS INTEGER) AS seq, CAST(isodow(start_date + CAST(seq AS INTEGER)) - 1 AS INTEGER) AS weekday, count(*) OVER (PARTITION BY plan_id) AS runway FROM d0),
d2 AS MATERIALIZED (SELECT *, date + 1 = exam_date AS eve, (weekday = 5 OR (weekday = 2 AND (seq // 7) % 3 = 2)) AND date + 1 <> exam_date AS buffer FROM d1),
wk AS MATERIALIZED (SELECT plan_id, date, weekday, exam_date, runway, count(*) OVER (PARTITION BY plan_id) AS works, row_number() OVER (PARTITION BY plan_id ORDER BY date) - 1 AS rank FROM d2 WHERE NOT eve AND NOT buffer),
cuts AS MATERIALIZED (SELECT DISTINCT plan_id, exam_date, runway, works, CAST(floor(works * CAST(0.5 AS DOUBLE) + 0.5) AS BIGINT) AS n1, CAST(floor(works * CAST(0.2 AS DOUBLE) + 0.5) AS BIGINT) AS n3, CAST(floor(works * CAST(0.3 AS DOUBLE) + 0.5) AS BIGINT) AS np FROM wk),
sl AS MATERIALIZED (SELECT *, greatest(0, works - n1 - n3) AS n2, greatest(1, n1) AS c1, greatest(CASE WHEN works - greatest(1, n1) > 1 THEN 1 ELSE 0 END, np) AS c2 FROM cuts),
tail AS MATERIALIZED (SELECT wk.plan_id, min(rank - n1 - n2) FILTER (WHERE date >= wk.exam_date - 14) AS hit, count(*) AS l FROM wk JOIN sl USING (plan_id) WHERE rank >= n1 + n2 GROUP BY 1),
cut AS MATERIALIZED (SELECT plan_id, CASE WHEN l >= 3 THEN least(greatest(coalesce(hit, l - 2), 1), l - 2) ELSE coalesce(hit, greatest(0, l - 2)) END AS cut FROM tail),
ph AS MATERIALIZED (SELECT wk.*, CASE WHEN wk.runway < 21 THEN CASE WHEN rank < c1 THEN 'revision1' WHEN rank < c1 + c2 THEN 'revision2' ELSE 'revision3' END
  WHEN rank < n1 THEN 'study' WHEN rank < n1 + n2 THEN 'revision1' WHEN rank - n1 - n2 < cut THEN 'revision2' ELSE 'revision3' END AS phase FROM wk JOIN sl USING (plan_id) LEFT JOIN cut USING (plan_id)),
pool AS MATERIALIZED (SELECT plan_id, date, weekday, exam_date, works, row_number() OVER (PARTITION BY plan_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY plan_id) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY plan_id, phase ORDER BY date DESC) AS back FROM ph) WHERE date >= exam_date - 35 AND date <= exam_date - 4 AND NOT (phase = 'revision3' AND back <= 2)),
tg AS MATERIALIZED (SELECT DISTINCT plan_id, n, least(CASE WHEN n >= 20 THEN 6 WHEN n >= 14 THEN 5 WHEN n >= 8 THEN 3 WHEN n >= 4 THEN 2 ELSE 1 END, greatest(1, works // 5)) AS target FROM pool),
spread AS MATERIALIZED (SELECT plan_id, ((k + 1) * n // (target + 1)) % n AS i, min(k) AS k FROM (SELECT *, unnest(range(0, n)) AS k FROM tg) q GROUP BY 1, 2),
ranked AS MATERIALIZED (SELECT pool.plan_id, date, row_number() OVER (PARTITION BY pool.plan_id ORDER BY CASE WHEN weekday = 6 THEN 0 WHEN date = exam_date - 22 THEN 1 WHEN date = exam_date - 8 THEN 2 WHEN k IS NOT NULL THEN 3 ELSE 4 END, CASE WHEN weekday = 6 OR k IS NULL THEN pool.i ELSE k END) AS place FROM pool LEFT JOIN spread ON spread.plan_id = pool.plan_id AND spread.i = pool.i),
mock AS MATERIALIZED (SELECT ranked.plan_id, date FROM ranked JOIN tg USING (plan_id) WHERE place <= target),
days AS MATERIALIZED (SELECT d2.plan_id, d2.date, d2.weekday, d2.seq, d2.exam_date, d2.runway, buffer, phase, m.date IS NOT NULL AS mock, CASE WHEN eve THEN 'gap' WHEN buffer THEN 'buffer' WHEN m.date IS NOT NULL THEN 'mock' WHEN y.date IS NOT NULL AND ph.works >= 30 THEN 'minimum' ELSE phase END AS kind
  FROM d2 LEFT JOIN ph ON ph.plan_id = d2.plan_id AND ph.date = d2.date LEFT JOIN mock m ON m.plan_id = d2.plan_id AND m.date = d2.date LEFT JOIN mock y ON y.plan_id = d2.plan_id AND y.date = d2.date - 1)"""


def _days(spark, sf_dir):
    return plan.day_kinds(plan.runway(_requests(spark, sf_dir)))


@query(f"WITH {DAYS} SELECT plan_id, date, weekday, seq, kind, phase FROM days")
def plan_days(spark, sf_dir):
    return _days(spark, sf_dir).select("plan_id", "date", "weekday", "seq", "kind", "phase")


@query(f"""WITH {DAYS} SELECT plan_id, count(*) AS runway, count(phase) AS work, CAST(floor(100.0 * count(*) FILTER (WHERE buffer) / count(*) + 0.5) AS BIGINT) AS buffer_pct, count(*) FILTER (WHERE phase = 'study') AS study,
  count(*) FILTER (WHERE phase = 'revision1') AS revision1, count(*) FILTER (WHERE phase = 'revision2') AS revision2, count(*) FILTER (WHERE phase = 'revision3') AS revision3, count(*) FILTER (WHERE mock) AS mocks, count(*) < 21 AS compressed FROM days GROUP BY 1""")
def plan_summary(spark, sf_dir):
    return plan.summary(_days(spark, sf_dir))


@query(f"WITH {DAYS} SELECT plan_id, kind, min(date) AS first, max(date) AS last, count(*) AS days FROM days GROUP BY 1, 2")
def phase_spans(spark, sf_dir):
    return plan.spans(_days(spark, sf_dir))


@query(f"""WITH {DAYS}, w AS (SELECT plan_id, count(*) FILTER (WHERE kind = 'study') AS s, count(*) FILTER (WHERE kind = 'revision1') AS r FROM days GROUP BY 1),
e AS (SELECT req.*, s, r, CASE mode WHEN 'class12' THEN 14 WHEN 'postboards' THEN 35 ELSE 20 END AS lo, CASE mode WHEN 'class12' THEN 27 WHEN 'postboards' THEN 60 ELSE 40 END AS hi FROM req JOIN w USING (plan_id))
SELECT plan_id, hours <= 0 AS no_hours, hours > 0 AND hours < lo AS few_hours, hours > 0 AND hours > hi AS many_hours, start_date > cutoff AS cutoff_passed, cutoff >= start_date AND cutoff <= start_date + 30 AS cutoff_near,
  date_diff('day', start_date, exam_date) < 21 AS short_runway, s > 0 AND s * 2 < 24 AS dense_study, r > 0 AND 24 / r > 6 AS dense_revision FROM e""")
def plan_warnings(spark, sf_dir):
    return plan.warnings(_requests(spark, sf_dir), _days(spark, sf_dir), 24)


SYLLABUS = """pap AS (SELECT DISTINCT p_size % 4 AS paper, CAST(CASE WHEN p_size % 4 < 3 THEN 100 ELSE 80 END AS DOUBLE) AS marks, p_size % 4 = 2 AS by_section FROM part),
chap AS (SELECT paper, chapter, row_number() OVER (PARTITION BY paper ORDER BY chapter) AS number FROM (SELECT DISTINCT p_size % 4 AS paper, p_type AS chapter FROM part) q),
bridge AS (SELECT DISTINCT paper, length(chapter) % 3 AS grp, chapter FROM chap WHERE NOT (paper = 3 AND length(chapter) % 3 = 0)),
wg AS (SELECT p_size % 4 AS paper, length(p_type) % 3 AS grp, CASE WHEN length(p_type) % 3 < 2 THEN CAST(count(*) % 20 + 5 AS DOUBLE) END AS lo, CASE WHEN length(p_type) % 3 < 2 THEN CAST(count(*) % 20 + 5 + count(*) % 7 AS DOUBLE) END AS hi, CASE WHEN length(p_type) % 3 = 2 THEN CAST(30 AS DOUBLE) END AS marks, CAST(40 AS DOUBLE) AS section_marks FROM part GROUP BY 1, 2),
wpart AS (SELECT b.paper, b.chapter, sum(CASE WHEN lo IS NOT NULL THEN (lo + hi) / 2 / 100 * CASE WHEN by_section THEN section_marks ELSE pap.marks END ELSE wg.marks END / n) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY paper, grp) AS n FROM bridge) b
  JOIN wg ON wg.paper = b.paper AND wg.grp = b.grp JOIN pap ON pap.paper = b.paper GROUP BY 1, 2),
weights AS (SELECT chap.*, coalesce(weight, avg(weight) OVER (PARTITION BY chap.paper), 1) AS weight FROM chap LEFT JOIN wpart ON wpart.paper = chap.paper AND wpart.chapter = chap.chapter)"""


def _syllabus(spark, sf_dir):
    """Papers, chapters, weight groups and the chapters that they cover."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("paper"), F.col("p_type").alias("chapter"), (F.length("p_type") % 3).alias("group"))
    papers = part.select("paper").distinct().select("paper", F.when(F.col("paper") < 3, 100.0).otherwise(80.0).alias("marks"), (F.col("paper") == 2).alias("by_section"))
    chapters = part.select("paper", "chapter").distinct().withColumn("number", F.row_number().over(Window.partitionBy("paper").orderBy("chapter")))
    lo = F.count("*") % 20 + 5.0
    ranged = F.col("group") < 2
    groups = part.groupBy("paper", "group").agg(F.when(ranged, lo).alias("lo"), F.when(ranged, lo + F.count("*") % 7).alias("hi"), F.when(~ranged, 30.0).alias("marks"), F.lit(40.0).alias("section_marks"))
    bridge = part.filter("NOT (paper = 3 AND group = 0)").select("paper", "group", "chapter").distinct()
    return papers, chapters, groups, bridge


def _weights(spark, sf_dir):
    return plan.chapter_weights(*_syllabus(spark, sf_dir))


@query(f"WITH {SYLLABUS} SELECT paper, chapter, round(weight, 6) AS weight FROM weights")
def chapter_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select("paper", "chapter", F.round("weight", 6).alias("weight"))


PAPERS = "pp AS (SELECT c_custkey AS plan_id, p AS paper, p AS number, p % 2 AS stream, c_custkey % 4 = p AS weak, DATE '2026-05-03' + CAST(c_custkey % 11 + p * 2 AS INTEGER) AS date FROM customer, (SELECT unnest([0, 1, 2, 3]) AS p) q)"


def _papers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plan_id"), F.explode(F.array(*map(F.lit, range(4)))).alias("paper"))
    date = F.date_add(F.lit("2026-05-03").cast("date"), (F.col("plan_id") % 11 + F.col("paper") * 2).cast("int"))
    return rows.select("plan_id", "paper", F.col("paper").alias("number"), (F.col("paper") % 2).alias("stream"), (F.col("plan_id") % 4 == F.col("paper")).alias("weak"), date.alias("date"))


def _share(name: str, rows: str, key: str, weight: str, total: str, order: str) -> str:
    """Largest remainders with one at least, for each key."""
    return f"""{name}_e AS (SELECT *, greatest(0, {total} - count(*) OVER w) AS spare, {weight} / sum({weight}) OVER w * greatest(0, {total} - count(*) OVER w) AS ex FROM {rows} WINDOW w AS (PARTITION BY {key})),
{name}_f AS (SELECT *, spare - sum(floor(ex)) OVER (PARTITION BY {key}) AS lft, row_number() OVER (PARTITION BY {key} ORDER BY round(ex - floor(ex), 9) DESC, {order}) AS place FROM {name}_e),
{name} AS (SELECT * EXCLUDE (spare, ex, lft, place), CAST(1 + floor(ex) + CASE WHEN place <= lft THEN 1 ELSE 0 END AS BIGINT) AS {name}_n FROM {name}_f)"""


STUDY = f"""{DAYS}, {SYLLABUS}, {PAPERS}, slot AS (SELECT plan_id, count(*) AS slots FROM days WHERE kind = 'study' GROUP BY 1),
mass AS (SELECT pp.plan_id, pp.stream, pp.paper, slots, m * CASE WHEN weak THEN CAST(1.35 AS DOUBLE) ELSE 1 END AS mass FROM pp JOIN slot USING (plan_id) JOIN (SELECT paper, sum(weight) AS m FROM weights GROUP BY 1) q USING (paper)),
{_share('a', 'mass', 'plan_id, stream', 'mass', 'slots', 'paper')}, ac AS (SELECT a.plan_id, a.stream, a.paper, a_n, chapter, number, weight FROM a JOIN weights USING (paper)),
{_share('b', 'ac', 'plan_id, stream, paper', 'weight', 'a_n', 'number')},
v AS (SELECT plan_id, stream, paper, chapter, number, unnest(range(1, b_n + 1)) AS visit FROM b),
vo AS (SELECT *, row_number() OVER (PARTITION BY plan_id, stream, paper ORDER BY number, visit) - 1 AS i, count(*) OVER (PARTITION BY plan_id, stream, paper) AS n, paper > 1 AS second FROM v),
study AS (SELECT plan_id, stream, paper, chapter, visit, row_number() OVER (PARTITION BY plan_id, stream ORDER BY CAST(i AS DOUBLE) / n, second, i) - 1 AS ord FROM vo)"""


def _study(spark, sf_dir):
    slots = _days(spark, sf_dir).filter("kind = 'study'").groupBy("plan_id").agg(F.count("*").alias("slots"))
    return plan.study_stream(slots, _papers(spark, sf_dir).drop("date"), _weights(spark, sf_dir))


@query(f"WITH {STUDY} SELECT * FROM study")
def study_stream(spark, sf_dir):
    return _study(spark, sf_dir)


@query(f"""WITH {STUDY}, t AS (SELECT plan_id, date, row_number() OVER (PARTITION BY plan_id ORDER BY date) - 1 AS d, count(*) OVER (PARTITION BY plan_id) AS dn FROM days WHERE kind = 'study'),
s AS (SELECT *, count(*) OVER (PARTITION BY plan_id, stream) AS n FROM study), g AS (SELECT t.plan_id, date, d, dn, n, stream FROM t JOIN (SELECT DISTINCT plan_id, stream, n FROM s) q USING (plan_id)),
j AS (SELECT g.*, paper, chapter, visit, ord FROM g LEFT JOIN s ON s.plan_id = g.plan_id AND s.stream = g.stream AND ord >= d * g.n // dn AND ord < (d + 1) * g.n // dn)
SELECT j.plan_id, j.date, j.stream, coalesce(j.paper, s.paper) AS paper, coalesce(j.chapter, s.chapter) AS chapter, coalesce(j.visit, s.visit) AS visit, j.ord IS NULL AND d > 0 AS repeat
FROM j JOIN s ON s.plan_id = j.plan_id AND s.stream = j.stream AND s.ord = coalesce(j.ord, greatest(0, j.d * j.n // j.dn - 1))""")
def paired_days(spark, sf_dir):
    return plan.paired_days(_days(spark, sf_dir), _study(spark, sf_dir), "study").select("plan_id", "date", "stream", "paper", "chapter", "visit", "repeat")


@query(f"""WITH {SYLLABUS}, {PAPERS}, r AS (SELECT plan_id, stream, pp.paper, chapter, row_number() OVER (PARTITION BY plan_id, pp.paper ORDER BY chap.number) - 1 AS i, count(*) OVER (PARTITION BY plan_id, pp.paper) AS n FROM pp JOIN chap ON chap.paper = pp.paper)
SELECT plan_id, stream, paper, chapter, row_number() OVER (PARTITION BY plan_id, stream ORDER BY CAST(i AS DOUBLE) / n, paper, i) - 1 AS ord FROM r""")
def revision_stream(spark, sf_dir):
    return plan.revision_stream(_papers(spark, sf_dir), _syllabus(spark, sf_dir)[1], "chapter")


@query(f"""WITH {DAYS}, {PAPERS}, t AS (SELECT plan_id, date, row_number() OVER (PARTITION BY plan_id ORDER BY date) - 1 AS d FROM days WHERE kind = 'revision3'),
o AS (SELECT plan_id, paper, row_number() OVER (PARTITION BY plan_id ORDER BY number, paper) - 1 AS place, count(*) OVER (PARTITION BY plan_id) AS n FROM pp)
SELECT t.plan_id, date, CAST(slot AS INTEGER) AS slot, paper FROM t JOIN o ON o.plan_id = t.plan_id CROSS JOIN (SELECT unnest([0, 1]) AS slot) q WHERE (d * 2 + slot) % n = place""")
def paper_cycle(spark, sf_dir):
    return plan.paper_cycle(_days(spark, sf_dir), _papers(spark, sf_dir))


@query(f"""WITH {DAYS}, {PAPERS}, m AS (SELECT plan_id, date, exam_date, row_number() OVER (PARTITION BY plan_id ORDER BY date) - 1 AS nth, count(*) OVER (PARTITION BY plan_id) AS n FROM days WHERE mock),
o AS (SELECT plan_id, paper, row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN weak THEN 0 ELSE 1 END, number) - 1 AS place FROM pp)
SELECT m.plan_id, date, nth, CASE WHEN n >= 3 AND nth >= n - 2 THEN 'full' ELSE CAST(paper AS VARCHAR) END AS scope, date IN (exam_date - 22, exam_date - 8) AS anchor FROM m JOIN o ON o.plan_id = m.plan_id AND o.place = nth % 4""")
def mock_rotation(spark, sf_dir):
    return plan.mock_rotation(_days(spark, sf_dir), _papers(spark, sf_dir))


@query(f"""WITH {PAPERS}, e AS (SELECT plan_id, min(date) AS first, max(date) AS last FROM pp GROUP BY 1), d AS (SELECT plan_id, first + CAST(unnest(range(0, date_diff('day', first, last) + 1)) AS INTEGER) AS date FROM e)
SELECT d.plan_id, d.date, CASE WHEN pp.paper IS NOT NULL THEN 'exam' ELSE 'gap' END AS kind, coalesce(pp.paper, (SELECT min(q.paper) FROM pp q WHERE q.plan_id = d.plan_id AND q.date > d.date)) AS paper FROM d LEFT JOIN pp ON pp.plan_id = d.plan_id AND pp.date = d.date""")
def exam_window(spark, sf_dir):
    return plan.exam_window(_papers(spark, sf_dir))


@query(f"""WITH {PAPERS}, a AS (SELECT o_custkey AS plan_id, DATE '2026-04-20' + CAST(o_orderkey % 40 AS INTEGER) AS date, o_orderkey FROM orders)
SELECT o_orderkey AS visit, a.plan_id, a.date, a.date >= min(pp.date) - 1 AND a.date <= max(pp.date) AS in_window FROM a JOIN pp ON pp.plan_id = a.plan_id GROUP BY 1, 2, 3""")
def in_exam_window(spark, sf_dir):
    return plan.in_exam_window(_visits(spark, sf_dir), _papers(spark, sf_dir))


def _visits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit"), F.col("o_custkey").alias("plan_id"), F.date_add(F.lit("2026-04-20").cast("date"), (F.col("o_orderkey") % 40).cast("int")).alias("date"))


@query(f"""WITH {DAYS} SELECT o_orderkey AS visit, plan_id, date, kind FROM orders JOIN days ON plan_id = o_custkey AND date = DATE '2026-04-20' + CAST(o_orderkey % 40 AS INTEGER)""")
def plan_day_lookup(spark, sf_dir):
    return plan.day_of(_days(spark, sf_dir).select("plan_id", "date", "kind"), _visits(spark, sf_dir))


def _items(spark, sf_dir, status):
    w = Window.partitionBy("k").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"), "o_orderkey")
    return rows.select("k", F.col("o_orderkey").alias("item"), (F.row_number().over(w) - 1).alias("ord"))


_ITEMS = "SELECT o_custkey AS k, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = '{}'"


@query(f"""WITH u AS (SELECT k, item, ord, 0 AS stream, CAST(ord AS DOUBLE) / n AS p FROM ({_ITEMS.format('O')}) a UNION ALL SELECT k, item, ord, 1, CAST(ord AS DOUBLE) / n FROM ({_ITEMS.format('F')}) b)
SELECT k, item, stream, row_number() OVER (PARTITION BY k ORDER BY p, stream, ord) AS place FROM u""")
def merged_streams(spark, sf_dir):
    return plan.merge_streams(_items(spark, sf_dir, "O"), _items(spark, sf_dir, "F"), "k").select("k", "item", "stream", "place")


@query(f"""WITH i AS ({_ITEMS.format('O')}), c AS (SELECT k, n, unnest(range(0, 12)) AS day FROM (SELECT DISTINCT k, n FROM i) q),
j AS (SELECT c.k, c.day, item, ord FROM c LEFT JOIN i ON i.k = c.k AND ord >= c.day * c.n // 12 AND ord < (c.day + 1) * c.n // 12),
l AS (SELECT k, CAST(day AS BIGINT) AS day, item AS own, last_value(item IGNORE NULLS) OVER (PARTITION BY k ORDER BY day, ord NULLS FIRST ROWS UNBOUNDED PRECEDING) AS item, ord FROM j)
SELECT l.k, l.day, coalesce(l.item, f.item) AS item, own IS NULL AND l.day > 0 AS repeat FROM l JOIN i f ON f.k = l.k AND f.ord = 0""")
def dealt_days(spark, sf_dir):
    return plan.deal(_items(spark, sf_dir, "O"), 12, "k").select("k", "day", "item", "repeat")


@query("""WITH d AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS date FROM orders), p AS (SELECT c_custkey AS k, DATE '1995-01-01' + CAST(c_custkey % 900 AS INTEGER) AS pd, 'P' || CAST(c_custkey % 4 AS VARCHAR) AS paper FROM customer)
SELECT d.k, d.date, CASE WHEN pd >= date THEN paper END AS paper, CASE WHEN pd >= date THEN pd END AS paper_date FROM d LEFT JOIN p ON p.k = d.k""")
def next_paper(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("date"))
    k = F.col("c_custkey")
    papers = table(spark, sf_dir, "customer").select(k.alias("k"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int")).alias("date"), F.concat(F.lit("P"), (k % 4).cast("string")).alias("paper"))
    return plan.next_on_or_after(dates, papers, "k")


