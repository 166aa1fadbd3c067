"""Allocation and sampling: apportionment, stratified and weighted draws, packing by greedy fit. Chance is a seeded hash, so a retry or a
new partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import BLOCK_ROWS, dealt, running


def chance(seed: str, *keys: str | Column) -> Column:
    """A number from 0 to 1 that the seed and the keys fix: 48 bits of their MD5, which any SQL engine has too."""
    parts = (F.col(k) if isinstance(k, str) else k for k in keys)
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(seed), *(p.cast("string") for p in parts))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def _remainders(rows: DataFrame, key: str | Sequence[str], order: str, exact: Column, total: Column) -> DataFrame:
    """``share``: the floors of ``exact``, what ``total`` leaves over going to the largest remainders, in turns; ties by order."""
    w = Window.partitionBy(key)
    rows = rows.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    rows = rows.withColumns({"_left": total - F.sum("_floor").over(w), "_n": F.count("*").over(w)})
    place = F.row_number().over(w.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), order))
    share = F.col("_floor") + F.floor(F.col("_left") / F.col("_n")) + F.when(place <= F.col("_left") % F.col("_n"), 1).otherwise(0)
    return rows.withColumn("share", share.cast("long")).drop("_exact", "_floor", "_left", "_n")


def largest_remainder(rows: DataFrame, key: str | Sequence[str], order: str, weight: str, total: str) -> DataFrame:
    """Whole shares of ``total`` by weight: one for each row, the others by largest remainder. Where rows are as many as units
    or more, each gets one; weights that are all 0 count alike."""
    w = Window.partitionBy(key)
    n, every = F.count("*").over(w), F.sum(weight).over(w)
    rows = rows.withColumns({"_spare": F.greatest(F.lit(0), F.col(total) - n), "_part": F.when(every == 0, 1.0 / n).otherwise(F.col(weight) / every)})
    rows = _remainders(rows, key, order, F.col("_part") * F.col("_spare"), F.col("_spare"))
    return rows.withColumn("share", F.col("share") + 1).drop("_spare", "_part")


def group_targets(groups: DataFrame, paper: str, section: str, order: str, mid: str, section_marks: str) -> DataFrame:
    """Targets of a 100-mark paper: each section's marks over the midpoints of its groups, then largest remainders."""
    exact = F.col(section_marks) * F.col(mid) / F.sum(mid).over(Window.partitionBy(paper, section))
    return _remainders(groups, paper, order, exact, F.lit(100)).withColumnRenamed("share", "target")


def pool_sizes(pool: DataFrame, targets: DataFrame, paper: str, group: str, total: int = 100) -> DataFrame:
    """What a pool can fill of its targets: rows and surplus per paper, and how many questions can be composed."""
    sizes = targets.join(pool.groupBy(paper, group).agg(F.count("*").alias("pool")), [paper, group], "left").fillna(0, ["pool"])
    return sizes.groupBy(paper).agg(F.sum("pool").alias("pool"), F.least(F.lit(total), F.sum(F.least("target", "pool")) + F.sum(F.greatest(F.lit(0), F.col("pool") - F.col("target")))).alias("composable"))


BUCKETS = 4_096


def _reached(counts: DataFrame, key: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``_cuts`` from counts (``_n``) by key and bucket."""
    upto = F.sum("_n").over(Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    reached = wanted.join(counts.withColumn("_upto", upto), list(key), "left")
    first = F.min(F.when(F.col("_upto") >= F.col("_want"), F.col("_bucket")))
    before = F.coalesce(F.max(F.when(F.col("_upto") < F.col("_want"), F.col("_upto"))), F.lit(0))
    cuts = reached.groupBy(*key, "_want").agg(first.alias("_cut"), before.alias("_before"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_size"))
    return cuts.withColumn("_before", F.when(F.col("_cut").isNotNull(), F.col("_before")))


def _counts(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))


def _cuts(rows: DataFrame, key: Sequence[str], wanted: DataFrame) -> DataFrame:
    """For each key of ``wanted`` (with ``_want``) the bucket of chance in which that many rows are reached, ``_cut`` (null if there are fewer), the rows in
    buckets before it, and all its rows, ``_size``. A key has at most ``BUCKETS`` counts, whatever its rows."""
    return _reached(_counts(rows, key), key, wanted)


def _within(want: Column, cut: Column) -> Column:
    """Rows of a bucket up to that of the cut: none of a key that wants none."""
    return want.isNotNull() & (cut.isNull() | (F.col("_bucket") <= cut))


def _taken(want: Column, cut: Column, before: Column, rank: Column) -> Column:
    """Of these the wanted ones, by their rank in the bucket of the cut."""
    return _within(want, cut) & (cut.isNull() | (F.col("_bucket") < cut) | (rank + before <= want))


def stratified_draw(pool: DataFrame, targets: DataFrame, paper: str, group: str, item: str, seed: str) -> DataFrame:
    """Per paper, items drawn without replacement to the targets of its groups; what groups lack is filled from the rest of the pool.
    ``source`` tells ``target`` from ``backfill``.

    Drawn are the items of lowest chance. A histogram of the chances tells the bucket in which a group's target falls, and what it leaves over tells that of a paper's
    backfill. The cuts, a row for each target, are broadcast; only items up to a cut leave their place, and they are ranked bucket by bucket, so that a group of any
    number of items is the work of many tasks and no task sorts a group."""
    h = chance(seed, paper, item)
    rows = pool.select(paper, group, item, h.alias("_h")).withColumn("_bucket", F.floor(F.col("_h") * BUCKETS).cast("int"))
    wanted = targets.groupBy(paper, group).agg(F.sum("target").alias("_want")).filter("_want > 0")
    counts = _counts(rows, [paper, group])
    cuts = _reached(counts, [paper, group], wanted)
    short = cuts.groupBy(paper).agg(F.sum(F.greatest(F.lit(0), F.col("_want") - F.col("_size"))).alias("_want")).filter("_want > 0")
    cuts = cuts.drop("_size")
    over = F.when(F.col("_want").isNull() | (F.col("_bucket") > F.col("_cut")), F.col("_n")).when(F.col("_bucket") == F.col("_cut"), F.col("_n") - (F.col("_want") - F.col("_before")))
    rest = counts.join(F.broadcast(cuts), [paper, group], "left").select(paper, "_bucket", over.alias("_n")).filter("_n > 0")
    fill = _reached(rest.groupBy(paper, "_bucket").agg(F.sum("_n").alias("_n")), [paper], short)
    fill = fill.select(paper, F.col("_want").alias("_fill"), F.col("_cut").alias("_fill_cut"), F.col("_before").alias("_fill_before"))
    marked = rows.join(F.broadcast(cuts), [paper, group], "left").join(F.broadcast(fill), paper, "left")
    target, filled = (F.col("_want"), F.col("_cut")), (F.col("_fill"), F.col("_fill_cut"))
    near = marked.filter(_within(*target) | _within(*filled))
    at = lambda *by: F.row_number().over(Window.partitionBy(paper, "_bucket", *by).orderBy("_h", item, group))
    first = near.withColumn("_first", _taken(*target, F.col("_before"), at(group)))
    drawn = first.withColumn("_second", ~F.col("_first") & _taken(*filled, F.col("_fill_before"), at("_first"))).filter("_first OR _second")
    return drawn.select(paper, group, item, F.when(F.col("_first"), "target").otherwise("backfill").alias("source"))


def chapter_weight(due: Column, mastery: Column) -> Column:
    """Weight of a chapter in a mixed set: more for what is due, up to five, and for what is little known."""
    return (1 + F.least(F.coalesce(due, F.lit(0)), F.lit(5))) * (3 - F.least(F.coalesce(mastery, F.lit(0)), F.lit(2)))


def draw_shortfall(drawn: DataFrame, targets: DataFrame, paper: str) -> DataFrame:
    """Of each paper what ``stratified_draw`` was to give, what the groups gave, what they lacked, and how much of that the rest filled."""
    want = targets.groupBy(paper).agg(F.sum("target").alias("want"))
    have = drawn.groupBy(paper).agg(F.count_if(F.col("source") == "target").alias("drawn"), F.count_if(F.col("source") == "backfill").alias("backfilled"))
    return want.join(have, paper, "left").fillna(0, ["drawn", "backfilled"]).withColumn("short", F.col("want") - F.col("drawn"))


def interleaved(taken: Column, chapter: str = "chapter") -> Column:
    """An array of units so ordered that neighbours come from different chapters wherever they can: each place goes to the largest pile but for the
    last place's chapter, of equal piles to the one that stood first, at first by chapter. Units of a chapter keep their order."""
    chapters = F.array_sort(F.array_distinct(F.transform(taken, lambda t: t[chapter])))
    piles = F.transform(chapters, lambda c: F.struct(F.size(F.filter(taken, lambda t: t[chapter] == c)).alias("left"), c.alias("of")))
    start = F.struct(piles.alias("piles"), F.slice(chapters, 1, 0).alias("order"))

    def place(state: Column, _: Column) -> Column:
        """Piles are sorted anew for each place; the sort keeps the order of equal ones."""
        ranked = F.array_sort(F.filter(state["piles"], lambda p: p["left"] > 0), lambda a, b: b["left"] - a["left"])
        last = F.try_element_at(state["order"], F.lit(-1))
        of = F.coalesce(F.get(F.filter(ranked, lambda p: ~p["of"].eqNullSafe(last)), F.lit(0))["of"], F.get(ranked, F.lit(0))["of"])
        left = F.transform(ranked, lambda p: F.struct((p["left"] - F.when(p["of"] == of, 1).otherwise(0)).alias("left"), p["of"].alias("of")))
        return F.struct(left.alias("piles"), F.concat(state["order"], F.array(of)).alias("order"))

    order = F.aggregate(taken, start, place)["order"]
    nth = lambda c, i: F.size(F.filter(F.slice(order, F.lit(1), i + 1), lambda x: x == c))
    return F.transform(order, lambda c, i: F.element_at(F.filter(taken, lambda t: t[chapter] == c), nth(c, i)))


def mixed_set(units: DataFrame, key: str, chapter: str, unit: str, size: int, seed: str) -> DataFrame:
    """A mixed set of up to ``size`` questions per key: ``place``, chapter, unit, questions.

    ``units`` has ``questions`` (a unit's size; units are never cut), and of the chapter ``weight`` and ``started``. Chapters that aren't started
    are left out unless none is. Each chapter first gives one unit, the heaviest chapter first; then chapters are picked by weight again and again. These picks are a race of
    Poisson processes: a chapter's k-th pick comes at the sum of k exponential times over its weight, so that in order of time the next
    pick is a chapter's in proportion to its weight, however many units it has. A pick takes the chapter's first unit, in an order by chance,
    that still fits; a chapter without one loses its picks, which leaves the others' chances as they are. Units come interleaved.

    Of a chapter's units of one size only as many as fill a set can be taken, so a key's candidates are few, however many units it has."""
    like = Window.partitionBy(key, chapter, "questions").orderBy("_h", unit)
    fits = units.filter(F.col("questions").between(1, size)).withColumn("_h", chance(seed, key, unit)).withColumn("_n", F.row_number().over(like))
    fits = fits.filter((F.col("_n") <= size) & (F.col("_n") * F.col("questions") <= size))
    pool = F.sort_array(F.collect_list(F.struct("_h", F.col(unit).alias("unit"), F.col("questions").cast("int").alias("questions"))))
    pools = fits.groupBy(key, F.col(chapter).alias("chapter")).agg(F.max("weight").alias("weight"), F.max("started").alias("started"), pool.alias("pool"))
    gaps = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: -F.log(chance(f"{seed}/pick", key, "chapter", k)) / F.col("weight"))
    times = F.transform("_gaps", lambda _, i: F.aggregate(F.slice("_gaps", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x))
    pools = pools.withColumn("_gaps", gaps).withColumn("times", times)
    per_key = pools.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chapter", "weight", "started", "pool", "times"))).alias("all"))
    per_key = per_key.select(key, F.filter("all", lambda c: c["started"] | ~F.exists("all", lambda x: x["started"])).alias("pools"))
    pick = lambda turn, at, c: F.struct(F.lit(turn).alias("turn"), at.alias("at"), c.alias("chapter"))
    picks = F.transform("pools", lambda c: F.concat(F.array(pick(0, -c["weight"].cast("double"), c["chapter"])), F.transform(c["times"], lambda t: pick(1, t, c["chapter"]))))
    per_key = per_key.select(key, "pools", F.array_sort(F.flatten(picks)).alias("picks"))

    def take(taken: Column, at: Column) -> Column:
        used = F.aggregate(taken, F.lit(0), lambda a, t: a + t["questions"])
        of = F.get(F.filter("pools", lambda c: c["chapter"] == at["chapter"]), F.lit(0))["pool"]
        fit = F.filter(of, lambda u: (u["questions"] <= size - used) & ~F.exists(taken, lambda t: t["unit"] == u["unit"]))
        return F.concat(taken, F.transform(F.slice(fit, 1, 1), lambda u: F.struct(at["chapter"].alias("chapter"), u["unit"].alias("unit"), u["questions"].alias("questions"))))

    kinds = dict(pools.dtypes) | {"unit": dict(units.dtypes)[unit]}
    none = F.array().cast(f"array<struct<chapter:{kinds['chapter']},unit:{kinds['unit']},questions:int>>")
    sets = per_key.select(key, F.aggregate("picks", none, take).alias("taken"))
    placed = sets.select(key, F.posexplode(interleaved(F.col("taken"))).alias("at", "t"))
    return placed.select(key, (F.col("at") + 1).alias("place"), F.col("t.chapter").alias(chapter), F.col("t.unit").alias(unit), "t.questions")


ASKS_A_TASK = 2_048


def greedy_draw(asks: DataFrame, units: DataFrame, key: str, pool: Sequence[str], room: float, seed: str) -> DataFrame:
    """For each of ``asks`` (``key`` and the columns of ``pool``) units of its pool in an order by chance, taken if they fit into what is left of the room: ``key``, unit,
    marks. ``units`` has the columns of ``pool``, unit, marks, and ``late`` for those that come after all others.

    No ask looks at all units of its pool. Units of equal size fit or don't fit together, and what didn't fit never will: so the next unit taken is of one of the sizes
    that fit, by chance in proportion to the units left of each, and which one of its size is any that isn't taken. Places in a size are drawn by chance without repeats,
    and only the units at the places drawn are looked up."""
    of = [*pool, "late", "marks"]
    fits = running(units.filter((F.col("marks") > 0) & (F.col("marks") <= room)), of, ["unit"], {"_rank": F.lit(1)}).withColumn("_rank", F.col("_rank") - 1)
    each = fits.groupBy(*of).agg(F.count("*").alias("n")).groupBy(*pool)
    sizes = each.agg(F.sort_array(F.collect_list(F.struct("late", "marks", "n", F.lit(0).cast("long").alias("taken")))).alias("sizes"), F.floor(room / F.min("marks")).cast("int").alias("_most"))
    rows = dealt(asks, [key], ASKS_A_TASK).join(F.broadcast(sizes), list(pool))  # a row for each pool
    kind = dict(sizes.dtypes)["sizes"]

    let = lambda value, of: F.transform(F.array(value), of)[0]  # noqa: E731  computed once, however often it is named
    left = lambda c: c["n"] - c["taken"]

    def step(state: Column, k: Column, open_: Column) -> Column:
        now = F.filter(open_, lambda c: c["late"] == open_[0]["late"])  # sorted: if any is early, the first is
        every = F.aggregate(now, F.lit(0).cast("long"), lambda a, c: a + left(c))
        start = F.struct(F.floor(chance(f"{seed}/size", key, k) * every).alias("rest"), F.lit(None).cast("boolean").alias("late"), F.lit(None).cast("double").alias("marks"))

        def pick(a: Column, c: Column) -> Column:
            here = a["marks"].isNull() & (a["rest"] < left(c))
            return F.struct((a["rest"] - left(c)).alias("rest"), F.when(here, c["late"]).otherwise(a["late"]).alias("late"), F.when(here, c["marks"]).otherwise(a["marks"]).alias("marks"))

        def taken(at: Column) -> Column:
            one = lambda c: F.when((c["late"] == at["late"]) & (c["marks"] == at["marks"]), 1).otherwise(0)
            more = F.transform(state["sizes"], lambda c: F.struct(c["late"].alias("late"), c["marks"].alias("marks"), c["n"].alias("n"), (c["taken"] + one(c)).alias("taken")))
            return F.struct((state["used"] + F.coalesce(at["marks"], F.lit(0.0))).alias("used"), more.cast(kind).alias("sizes"))

        return F.when(F.size(open_) > 0, let(F.aggregate(now, start, pick), taken)).otherwise(state)

    def take(state: Column, k: Column) -> Column:
        return let(F.filter(state["sizes"], lambda c: (left(c) > 0) & (c["marks"] <= room - state["used"])), lambda open_: step(state, k, open_))

    start = F.struct(F.lit(0.0).alias("used"), F.col("sizes").alias("sizes"))
    drawn = rows.select(key, *pool, F.explode(F.aggregate(F.sequence(F.lit(1), F.col("_most")), start, take)["sizes"]).alias("c")).select(key, *pool, "c.*").filter("taken > 0")

    def place(places: Column, j: Column) -> Column:
        """Floyd's draw without repeats: of the first j + 1 places one by chance, or the last of them if that one is taken."""
        at = F.floor(chance(f"{seed}/place", key, "late", "marks", j) * (j + 1))
        return F.concat(places, F.array(F.when(F.array_contains(places, at), j).otherwise(at)))

    places = F.aggregate(F.sequence(F.col("n") - F.col("taken"), F.col("n") - 1), F.array().cast("array<bigint>"), place)
    found = drawn.select(key, *of, F.explode(places).alias("_rank")).hint("merge").join(fits, [*of, "_rank"])
    return found.select(key, "unit", "marks")


def systematic(rows: DataFrame, key: str, order: str, n: int, start: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every k-th row of each stratum from ``start`` on, k being its size over n. Large strata are numbered in blocks."""
    placed = running(rows, [key], [order], {"_at": F.lit(1)}, {"_size": "_at"}, block_rows=block_rows)
    k = F.greatest(F.lit(1), F.floor(F.col("_size") / n))
    return placed.filter(((F.col("_at") - start) % k == 0) & (F.col("_at") >= start)).drop("_at", "_size")


def proportional_strata(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Sample size of each stratum in proportion to it."""
    every = rows.agg(F.count("*").alias("_every"))
    sizes = rows.groupBy(key).agg(F.count("*").alias("size")).join(F.broadcast(every))  # one row
    return sizes.select(key, "size", F.round(n * F.col("size") / F.col("_every"), 4).alias("sample"))


def union_by_key(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both by key: the new one wins, in the place (``ord``) where the key stood first."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(*key)
    ranked = both.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("_src"), "ord")), "_first": F.min(F.struct("_src", "ord")).over(w)})
    return ranked.filter("_n = 1").select(*[c for c in old.columns if c != "ord"], F.col("_first._src").alias("from_new"), F.col("_first.ord").alias("ord"))


def venn(members: DataFrame, key: str, label: str, sets: Sequence[str]) -> DataFrame:
    """Members by the exact combination of sets they are in, and how many sets that is."""
    flags = members.groupBy(key).agg(*(F.max(F.when(F.col(label) == s, 1).otherwise(0)).alias(f"in_{i}") for i, s in enumerate(sets)))
    names = [f"in_{i}" for i in range(len(sets))]
    return flags.groupBy(*names).agg(F.count("*").alias("members")).withColumn("of_sets", sum((F.col(c) for c in names), F.lit(0)))


