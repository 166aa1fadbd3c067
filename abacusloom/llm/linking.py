"""From bands to classes: candidate pairs without quadratic buckets, verified links, connected components.

Rows of equal content become one representative before anything else. In each band bucket every member is
paired with the bucket's leaders only, so candidates grow with the members, not with their square, and a
bucket of any size is a partial aggregation plus a join that adaptive execution may split. After the
first links are known, buckets whose members still lie in different components get new leaders, drawn
anew for each bucket, and the members outside the leader's component are paired with those.

Leaders only save work. What decides is the settling after them: every two members of a bucket that still lie in
different components are compared, or ruled out exactly by ``meet``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, materialise

BLOCK = 1_024  # members of a bucket or list that one block of a join holds on its right
LEADERS = 8  # of a bucket whose first leader had near members
LEFT, RIGHT, LARGEST = 1, 2, 4  # a member's sides in a block, and whether it is of the bucket's largest component


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for edges ``a``, ``b``; alternates stars until stable."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("v", "u", F.lit(1))), F.lit(0))).first())


def in_blocks(lists: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Pairs ``a`` < ``b`` of rows of equal ``key`` that lie in different components; ``names`` are further columns, with suffixes
    ``_a`` and ``_b``. Members of a list's largest component aren't paired with each other, and long lists go in blocks."""
    counts = lists.groupBy(key, "component").agg(F.count("*").alias("n")).groupBy(key)
    held = materialise(counts.agg(F.max_by("component", F.struct("n", "component")).alias("big"), F.sum("n").alias("n"), F.count("*").alias("k")).filter("k > 1").drop("k"))
    rows = lists.join(held, key).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    side = lambda s: [key, "block", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "component", *names))]
    left = rows.filter("component <> big").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*side("x"))
    right = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(*side("y"), (F.col("component") == F.col("big")).alias("heavy"))
    return left.join(right, [key, "block"]).filter("component_x <> component_y AND (heavy OR id_x < id_y)")


def all_pairs(told: DataFrame) -> DataFrame:
    """Every two members of a bucket that lie in different components."""
    return in_blocks(told, "band", []).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def link_by_bands(
    rows: DataFrame,
    bands: Column,
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    meet: Callable[[DataFrame], DataFrame] = all_pairs,
    rounds: int = 2,
) -> DataFrame:
    """One row per row of ``rows``: ``id``, ``class_id`` (smallest id of its class), ``class_size``.

    ``rows`` has ``id`` and ``content``, and perhaps columns that depend on the content alone; ``bands`` is
    an array computed from them. ``verify(pairs, groups)`` keeps those pairs ``a``, ``b`` that are near; ``groups``
    has a row per content. ``meet(told)`` gives, for members ``id``, ``band``, ``component`` of the buckets that leaders left in
    several components, pairs ``a``, ``b`` among which are all near ones of one bucket and different components."""
    extra = [c for c in rows.columns if c not in ("id", "content")]
    groups = materialise(rows.groupBy("content").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in extra)))
    banded = groups.select("id", F.explode(F.array_distinct(bands)).alias("band"))
    leaders = banded.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    met = materialise(banded.join(leaders, "band").select("id", "band", "leader"))
    pairs = met.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    tested = materialise(pairs)
    edges = materialise(verify(tested, groups).select("a", "b"))
    component = cut(connected_components(edges))
    for _ in range(rounds - 1):
        told = met.join(component, met.id == component.node, "left").select("id", "band", F.coalesce("component", "id").alias("component"))
        order, own = F.xxhash64("band", "id"), F.struct("id", "component")
        new = (
            told.groupBy("band")
            .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.array(F.min_by(own, order), F.max_by(own, order), F.max(own), F.max_by(own, "component"), F.min_by(own, "component")).alias("others"))
            .filter("lo < hi")
            .select("band", F.explode(F.array_distinct("others")).alias("other"))
        )
        pairs = (
            told.join(new, "band")
            .filter("component <> other.component")
            .select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b"))
            .distinct()
            .join(tested, ["a", "b"], "left_anti")
        )
        pairs = materialise(pairs)
        if pairs.isEmpty():
            break
        more = materialise(verify(pairs, groups).select("a", "b"))
        tested, edges = tested.unionByName(pairs), edges.unionByName(more)
        if not more.isEmpty():
            component = cut(connected_components(edges))
    told = met.join(component, met.id == component.node, "left").select("id", "band", F.coalesce("component", "id").alias("component"))
    open_ = told.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi AND n > 2")  # of two, both are tested
    told = materialise(told.join(open_.select("band"), "band", "left_semi"))
    if not told.isEmpty():
        pairs = materialise(meet(told).join(tested, ["a", "b"], "left_anti"))
        more = materialise(verify(pairs, groups).select("a", "b"))
        if not more.isEmpty():
            component = cut(connected_components(edges.unionByName(more)))
    return _classes(rows, groups, component)


def _classes(rows: DataFrame, groups: DataFrame, component: DataFrame) -> DataFrame:
    """``id``, ``class_id``, ``class_size`` of each row, from the components of the contents' smallest ids."""
    classes = materialise(
        groups.select("id", "content", "copies")
        .join(component.withColumnRenamed("node", "id"), "id", "left")
        .select("content", "copies", F.coalesce("component", "id").alias("class_id"))
    )
    sizes = materialise(classes.groupBy("class_id").agg(F.sum("copies").alias("class_size")))  # apart, so that the join may be split
    known = materialise(classes.join(sizes, "class_id", "left").select("content", "class_id", F.coalesce("class_size", "copies").alias("class_size")))
    return rows.select("id", "content").join(known, "content").select("id", "class_id", "class_size")


def link_by_marked_bands(
    rows: DataFrame,
    bands: Column,
    mark: Column,
    alike: Callable[[Column, Column], Column],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    leading: int = 6,
    rounds: int = 3,
) -> DataFrame:
    """As ``link_by_bands``, for bands so short that unlike rows share them by chance, in numbers that grow with the square of the rows.

    ``mark`` is a small value of the content; ``alike(mark, mark)`` holds for all near pairs that share a band, and for few others. Marks travel with
    the bands and are compared where a bucket's members meet, so that only pairs of like marks are written, shuffled and verified.
    Leaders are taken in the first ``leading`` bands alone, and after the first round in those buckets alone in which one had members of like mark. What
    decides is the settling over all bands: buckets of up to ``BLOCK`` members meet whole, longer ones in blocks, without the pairs of their largest component."""
    extra = [c for c in rows.columns if c not in ("id", "content")]
    groups = materialise(rows.groupBy("content").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in extra)))
    marked = materialise(groups.select("id", bands.alias("bands"), mark.alias("mark")))
    component = groups.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    edges = None

    def placed(members: DataFrame) -> DataFrame:
        return members.join(component, members.id == component.node, "left").drop("node").withColumn("component", F.coalesce("component", "id"))

    def link(pairs: DataFrame) -> None:
        nonlocal edges, component
        more = materialise(verify(materialise(pairs), groups).select("a", "b"))
        if not more.isEmpty():
            edges = more if edges is None else edges.unionByName(more)
            component = cut(connected_components(edges))

    near = (F.col("x.component") != F.col("y.component")) & alike(F.col("x.mark"), F.col("y.mark"))
    pair = (F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    told = marked.select("id", "mark", F.explode(F.slice("bands", 1, leading)).alias("band"))
    for nth in range(rounds):
        order = [F.xxhash64("id", F.lit(nth * LEADERS + i)) for i in range(LEADERS if nth else 1)]
        told = placed(told)
        least = told.groupBy("band").agg(F.array(*map(F.min, order)).alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band", "least")
        leads = reduce(or_, (o == F.col("least")[i] for i, o in enumerate(order)))
        told = materialise(told.join(least, "band").select("id", "mark", "band", "component", leads.alias("leads")))
        found = materialise(told.alias("x").join(told.filter("leads").alias("y"), "band").filter(near).select("band", *pair))
        if found.isEmpty():
            break
        link(found.select("a", "b").distinct())
        told = told.join(found.select("band").distinct(), "band", "left_semi").select("id", "mark", "band")

    each = placed(marked).select("id", "mark", "component", F.explode("bands").alias("band"))
    crowded = materialise(each.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("band"))  # one for each BLOCK rows at most
    counts = each.join(F.broadcast(crowded), "band").groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band")
    held = materialise(counts.agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")))
    at = lambda block, sides: F.struct(block.cast("int").alias("block"), sides.cast("int").alias("sides"))
    largest = F.col("component") == F.col("largest")
    right = F.array(at(F.pmod(F.xxhash64("id"), F.col("blocks")), F.when(largest, RIGHT | LARGEST).otherwise(RIGHT)))
    left = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda block: at(block, F.lit(LEFT)))
    places = F.when(F.col("blocks").isNull(), F.array(at(F.lit(0), F.lit(LEFT | RIGHT)))).when(largest, right).otherwise(F.concat(right, left))
    dealt = each.join(F.broadcast(held), "band", "left").select("id", "mark", "component", "band", F.explode(places).alias("at")).select("id", "mark", "component", "band", "at.*")
    sides = F.col("x.sides").bitwiseAND(LEFT) + F.col("y.sides").bitwiseAND(RIGHT) == F.lit(LEFT | RIGHT)  # in one term, so that both sides of the join are one exchange
    once = (F.col("y.sides") >= LARGEST) | (F.col("x.id") < F.col("y.id"))
    link(dealt.alias("x").join(dealt.alias("y"), ["band", "block"]).filter(sides & once & near).select(*pair).distinct())
    return _classes(rows, groups, component)
