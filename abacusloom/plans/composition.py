"""Allocation, sampling, plans, replay and quality gates over the given tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compose as op
from ..operators import quality, state
from ..sources import adapters as a
from ..sources.adapters import REVIEW, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _chapters(spark, sf_dir):
    """Parts as chapters of the paper that their size names, weighed by price; the total differs by paper."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_size").alias("paper"), F.col("p_partkey").alias("chapter"), F.col("p_retailprice").alias("weight"), (F.col("p_size") * 7).cast("long").alias("total"))


CHAPTER = "ch AS (SELECT p_size AS paper, p_partkey AS chapter, p_retailprice AS weight, CAST(p_size * 7 AS BIGINT) AS total FROM part)"


@query(f"""WITH {CHAPTER}, s AS (SELECT *, count(*) OVER w AS n, weight / sum(weight) OVER w * greatest(0, total - count(*) OVER w) AS ex FROM ch WINDOW w AS (PARTITION BY paper)),
f AS (SELECT *, greatest(0, total - n) - sum(floor(ex)) OVER (PARTITION BY paper) AS lft, row_number() OVER (PARTITION BY paper ORDER BY round(ex - floor(ex), 9) DESC, chapter) AS place FROM s)
SELECT paper, chapter, CAST(1 + floor(ex) + CASE WHEN place <= lft THEN 1 ELSE 0 END AS BIGINT) AS share FROM f""")
def largest_remainder(spark, sf_dir):
    return op.largest_remainder(_chapters(spark, sf_dir), "paper", "chapter", "weight", "total").select("paper", "chapter", "share")


def _groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.groupBy((F.col("p_size") % 10).alias("paper"), (F.col("p_partkey") % 2).alias("section"), (F.col("p_partkey") % 8).alias("grp")).agg((F.round(F.avg("p_retailprice"), 2)).alias("mid"))
    return rows.withColumn("marks", F.when(F.col("section") == 0, 40.0).otherwise(60.0))


TARGETS = """g AS (SELECT p_size % 10 AS paper, p_partkey % 2 AS section, p_partkey % 8 AS grp, round(avg(p_retailprice), 2) AS mid FROM part GROUP BY 1, 2, 3),
e AS (SELECT *, CASE WHEN section = 0 THEN 40 ELSE 60 END * mid / sum(mid) OVER (PARTITION BY paper, section) AS ex FROM g),
l AS (SELECT *, 100 - sum(floor(ex)) OVER (PARTITION BY paper) AS lft, count(*) OVER (PARTITION BY paper) AS n, row_number() OVER (PARTITION BY paper ORDER BY round(ex - floor(ex), 9) DESC, grp) AS place FROM e),
target AS (SELECT paper, grp, CAST(floor(ex) + floor(lft / n) + CASE WHEN place <= lft % n THEN 1 ELSE 0 END AS BIGINT) AS target FROM l)"""


def _targets(spark, sf_dir):
    return op.group_targets(_groups(spark, sf_dir), "paper", "section", "grp", "mid", "marks").select("paper", "grp", "target")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("paper"), (F.col("p_partkey") % 8).alias("grp"), F.col("p_partkey").alias("item"))


def _pool(spark, sf_dir):
    """Papers of low numbers lack some of their groups."""
    return _items(spark, sf_dir).filter("grp < 2 + paper")


@query(f"WITH {TARGETS} SELECT * FROM target")
def group_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


@query(f"""WITH {TARGETS}, p AS (SELECT p_size % 10 AS paper, p_partkey % 8 AS grp, count(*) AS pool FROM part GROUP BY 1, 2), s AS (SELECT t.paper, target, coalesce(pool, 0) AS pool FROM target t LEFT JOIN p ON p.paper = t.paper AND p.grp = t.grp)
SELECT paper, CAST(sum(pool) AS BIGINT) AS pool, CAST(least(100, sum(least(target, pool)) + sum(greatest(0, pool - target))) AS BIGINT) AS composable FROM s GROUP BY 1""")
def pool_sizes(spark, sf_dir):
    return op.pool_sizes(_items(spark, sf_dir), _targets(spark, sf_dir), "paper", "grp")


@query(f"""WITH {TARGETS}, p AS (SELECT p_size % 10 AS paper, p_partkey % 8 AS grp, count(*) AS pool FROM part WHERE p_partkey % 8 < 2 + p_size % 10 GROUP BY 1, 2), s AS (SELECT t.paper, t.grp, least(target, coalesce(pool, 0)) AS n FROM target t LEFT JOIN p ON p.paper = t.paper AND p.grp = t.grp)
SELECT paper, grp, CAST(n AS BIGINT) AS drawn FROM s WHERE n > 0""")
def stratified_draw(spark, sf_dir):
    """How many items each group gives to its target; which ones is up to the hash, and tested by its rules."""
    drawn = op.stratified_draw(_pool(spark, sf_dir), _targets(spark, sf_dir), "paper", "grp", "item", "seed")
    return drawn.filter("source = 'target'").groupBy("paper", "grp").agg(F.count("*").alias("drawn"))


@query(f"""WITH {TARGETS}, p AS (SELECT p_size % 10 AS paper, p_partkey % 8 AS grp, count(*) AS pool FROM part WHERE p_partkey % 8 < 2 + p_size % 10 GROUP BY 1, 2), s AS (SELECT t.paper, sum(target) AS want, sum(least(target, coalesce(pool, 0))) AS drawn, sum(coalesce(pool, 0)) AS pool FROM target t LEFT JOIN p ON p.paper = t.paper AND p.grp = t.grp GROUP BY 1)
SELECT paper, CAST(want AS BIGINT) AS want, CAST(drawn AS BIGINT) AS drawn, CAST(least(want - drawn, pool - drawn) AS BIGINT) AS backfilled, CAST(want - drawn AS BIGINT) AS short FROM s""")
def draw_shortfall(spark, sf_dir):
    drawn = op.stratified_draw(_pool(spark, sf_dir), _targets(spark, sf_dir), "paper", "grp", "item", "seed")
    return op.draw_shortfall(drawn, _targets(spark, sf_dir), "paper")


def chance(seed: str, *keys: str) -> str:
    """SQL of ``compose.chance``."""
    return f"((CAST('0x' || substr(md5(concat_ws('/', '{seed}', {', '.join(keys)})), 1, 12) AS BIGINT) + 0.5) / {float(1 << 48)!r})"


@query(f"""WITH RECURSIVE line AS MATERIALIZED (SELECT DISTINCT l_suppkey AS learner_id, l_partkey % 9 AS chapter, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS unit, l_linenumber % 4 + 1 AS questions, l_returnflag = 'R' AS wrong, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem),
ch AS MATERIALIZED (SELECT learner_id, chapter, max(quantity) FILTER (WHERE wrong) % 7 AS due, (sum(quantity) + chapter) % 4 AS mastery FROM line GROUP BY 1, 2),
wt AS MATERIALIZED (SELECT learner_id, chapter, (1 + least(coalesce(due, 0), 5)) * (3 - least(mastery, 2)) AS weight, mastery >= 1 AS started FROM ch),
el AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(started) OVER (PARTITION BY learner_id) AS begun FROM wt) WHERE started OR NOT begun),
pool AS MATERIALIZED (SELECT learner_id, chapter, list({{'h': h, 'unit': unit, 'questions': questions}} ORDER BY h, unit) AS units FROM (SELECT DISTINCT learner_id, chapter, unit, questions, {chance('seed', 'learner_id', 'unit')} AS h FROM line) GROUP BY 1, 2),
pick AS MATERIALIZED (SELECT learner_id, chapter, 0 AS turn, CAST(-weight AS DOUBLE) AS moment FROM el UNION ALL SELECT learner_id, chapter, 1, sum(-ln({chance('seed/pick', 'learner_id', 'chapter', 'k')}) / weight) OVER (PARTITION BY learner_id, chapter ORDER BY k) FROM el, range(1, 21) AS r(k)),
ev AS MATERIALIZED (SELECT learner_id, p.chapter, units, row_number() OVER (PARTITION BY learner_id ORDER BY turn, moment, p.chapter) AS i FROM pick p JOIN pool USING (learner_id, chapter)),
tk AS (SELECT DISTINCT learner_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS names, CAST([] AS STRUCT(chapter BIGINT, unit VARCHAR, questions INTEGER)[]) AS taken FROM el
UNION ALL SELECT learner_id, i, used + coalesce(one.questions, 0), CASE WHEN one IS NULL THEN names ELSE list_append(names, one.unit) END, CASE WHEN one IS NULL THEN taken ELSE list_append(taken, {{'chapter': chapter, 'unit': one.unit, 'questions': CAST(one.questions AS INTEGER)}}) END
  FROM (SELECT t.*, e.i AS nxt, e.chapter, list_filter(e.units, lambda x: x.questions <= 20 - t.used AND NOT list_contains(t.names, x.unit))[1] AS one FROM tk t JOIN ev e ON e.learner_id = t.learner_id AND e.i = t.i + 1) s(learner_id, before, used, names, taken, i, chapter, one)),
fin AS MATERIALIZED (SELECT learner_id, arg_max(taken, i) AS taken FROM tk GROUP BY 1),
cnt AS MATERIALIZED (SELECT learner_id, x.chapter AS chapter, count(*) AS n FROM (SELECT learner_id, unnest(taken) AS x FROM fin) GROUP BY 1, 2),
il AS (SELECT learner_id, 0 AS place, CAST(NULL AS BIGINT) AS chapter, list({{'k': -n, 'pos': 0, 'c': chapter}} ORDER BY chapter) AS piles FROM cnt GROUP BY 1
UNION ALL SELECT learner_id, place + 1, of, list_transform(ranked, lambda p: {{'k': p.k + CASE WHEN p.c = of THEN 1 ELSE 0 END, 'pos': 0, 'c': p.c}})
  FROM (SELECT *, coalesce(list_filter(ranked, lambda p: p.c IS DISTINCT FROM chapter)[1].c, ranked[1].c) AS of
    FROM (SELECT *, list_sort(list_transform(list_filter(piles, lambda p: p.k < 0), lambda p, i: {{'k': p.k, 'pos': CAST(i AS INTEGER), 'c': p.c}})) AS ranked FROM il) WHERE len(ranked) > 0)),
put AS (SELECT learner_id, place, chapter, row_number() OVER (PARTITION BY learner_id, chapter ORDER BY place) AS j FROM il WHERE place > 0)
SELECT learner_id, place, put.chapter, list_filter(taken, lambda x: x.chapter = put.chapter)[j].unit AS unit, list_filter(taken, lambda x: x.chapter = put.chapter)[j].questions AS questions FROM put JOIN fin USING (learner_id)""")
def mixed_set(spark, sf_dir):
    """Lines as units of their supplier; a part's key names the chapter, whose mastery and mistakes come from quantities."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("learner_id"), (F.col("l_partkey") % 9).alias("chapter"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("unit"), (F.col("l_linenumber") % 4 + 1).alias("questions"), (F.col("l_returnflag") == "R").alias("wrong"), F.col("l_quantity").cast("long").alias("quantity")).distinct()
    due, mastery = F.max(F.when(F.col("wrong"), F.col("quantity"))) % 7, (F.sum("quantity") + F.col("chapter")) % 4
    chapters = line.groupBy("learner_id", "chapter").agg(due.alias("due"), mastery.alias("mastery"))
    chapters = chapters.select("learner_id", "chapter", op.chapter_weight(F.col("due"), F.col("mastery")).alias("weight"), (F.col("mastery") >= 1).alias("started"))
    units = line.select("learner_id", "chapter", "unit", "questions").distinct().join(chapters, ["learner_id", "chapter"])
    return op.mixed_set(units, "learner_id", "chapter", "unit", 20, "seed")


@query("""WITH r AS (SELECT l_suppkey AS k, l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem)
SELECT k, o, n, p, q FROM r WHERE (i - 1) % greatest(1, c // 10) = 0""")
def systematic_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    return op.systematic(rows.withColumn("s", F.struct("o", "n", "p", "q")), "k", "s", 10).drop("s")


@query("SELECT o_orderpriority AS stratum, count(*) AS size, round(500.0 * count(*) / (SELECT count(*) FROM orders), 4) AS sample FROM orders GROUP BY 1")
def proportional_strata(spark, sf_dir):
    return op.proportional_strata(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "stratum"), "stratum", 500)


@query("""WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS v, min(o_orderkey) AS ord FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_totalprice) AS v, min(o_orderkey) AS ord FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, CASE WHEN o.k IS NULL THEN 1 ELSE 0 END AS from_new, coalesce(o.ord, n.ord) AS ord FROM o FULL JOIN n ON o.k = n.k""")
def union_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    of = lambda s: orders.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"), F.min("o_orderkey").alias("ord"))
    return op.union_by_key(of("O"), of("F"), ["k"])


@query("""WITH f AS (SELECT event_id // 3 AS member, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS in_0, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS in_1, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS in_2 FROM events GROUP BY 1)
SELECT in_0, in_1, in_2, count(*) AS members, in_0 + in_1 + in_2 AS of_sets FROM f GROUP BY 1, 2, 3""")
def venn_regions(spark, sf_dir):
    return op.venn(table(spark, sf_dir, "events").withColumn("member", F.floor(F.col("event_id") / 3)), "member", "event_type", ["click", "view", "purchase"])


_EASE = "CASE rating WHEN 'again' THEN greatest(1.3, ease - 0.2) WHEN 'hard' THEN greatest(1.3, ease - 0.15) WHEN 'easy' THEN ease + 0.15 ELSE ease END"


@query(f"""WITH RECURSIVE {REVIEW}, o AS (SELECT *, row_number() OVER (PARTITION BY learner_id, card_id ORDER BY "at", event_id) AS i, count(*) OVER (PARTITION BY learner_id, card_id) AS n FROM rev),
f AS (SELECT learner_id, card_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS ivl, CAST(2.5 AS DOUBLE) AS ease, CAST(NULL AS TIMESTAMP) AS "at", 'none' AS last FROM o WHERE i = 1
UNION ALL SELECT o.learner_id, o.card_id, o.i, CAST(least(365, CASE o.rating WHEN 'again' THEN 0 WHEN 'hard' THEN greatest(1, ivl * 1.2) WHEN 'good' THEN CASE WHEN ivl = 0 THEN 1 ELSE ivl * ease END ELSE CASE WHEN ivl = 0 THEN 4 ELSE ivl * (ease + 0.15) * 1.3 END END) AS DOUBLE),
  CAST({_EASE.replace('rating', 'o.rating')} AS DOUBLE), o."at", o.rating FROM f JOIN o ON o.learner_id = f.learner_id AND o.card_id = f.card_id AND o.i = f.i + 1)
SELECT f.learner_id, f.card_id, round(ivl, 6) AS ivl, round(ease, 6) AS ease, CAST(f.i AS INTEGER) AS reps FROM f JOIN o ON o.learner_id = f.learner_id AND o.card_id = f.card_id AND o.i = f.i AND o.n = f.i""")
def card_state(spark, sf_dir):
    return state.card_state(a.fact_review(spark, sf_dir)).select("learner_id", "card_id", "ivl", "ease", "reps")


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN ' ' || CAST(1 - quality AS VARCHAR) ELSE ' ' || CAST(quality AS VARCHAR) END AS fresh, CAST(quality AS VARCHAR) AS k FROM labels),
s AS (SELECT CASE WHEN fresh IS NULL THEN 'unanswered' WHEN trim(fresh) = k THEN 'agreed' ELSE 'mismatch' END AS status FROM f), c AS (SELECT count(*) FILTER (WHERE status = 'agreed') AS agreed, count(*) FILTER (WHERE status = 'mismatch') AS mismatch, count(*) FILTER (WHERE status = 'unanswered') AS unanswered FROM s)
SELECT *, CASE WHEN mismatch > 0 THEN 1 WHEN unanswered > 0 THEN 2 ELSE 0 END AS code FROM c""")
def blind_gate(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("k"))
    wrong = F.col("doc_id") % 5 == 0
    fresh = labels.filter("doc_id % 11 <> 0").select("doc_id", F.concat(F.lit(" "), F.when(wrong, 1 - F.col("k").cast("int")).otherwise(F.col("k").cast("int")).cast("string")).alias("fresh"))
    return quality.consistency_gate(quality.compare_answers(labels, fresh, "doc_id", "k", "fresh"))


@query("SELECT p_partkey AS item, count(DISTINCT l_suppkey) AS groups FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity < 4 GROUP BY 1 HAVING count(DISTINCT l_suppkey) <> 1")
def not_exactly_one(spark, sf_dir):
    """Parts as chapters, suppliers of their small lines as groups: of none or of several."""
    members = table(spark, sf_dir, "lineitem").filter("l_quantity < 4").withColumnRenamed("l_partkey", "item")
    return quality.not_exactly_one(members, "item", "l_suppkey", table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "item"))


@query("SELECT DISTINCT o_orderpriority AS confusable, o_custkey AS slug FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def unresolved_slugs(spark, sf_dir):
    """Priorities as sets of slugs that are customers' keys; those of one segment were renamed."""
    known = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").withColumnRenamed("c_custkey", "slug")
    references = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("confusable"), F.col("o_custkey").alias("slug"))
    return quality.unresolved(references, known, "slug", "confusable")


@query("SELECT DISTINCT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def vacuous_keys(spark, sf_dir):
    key = "n_nationkey"
    checked = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias(key))
    return quality.vacuous(table(spark, sf_dir, "nation").select(key), checked, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias(key)), key)
