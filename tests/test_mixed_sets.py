"""Mixed sets: the odds of chapters, what counts as eligible, units that fit, and the order of a set."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abacusloom.operators import compose

UNITS = "learner long, chapter string, unit string, questions int, weight int, started boolean"


def sets_of(df):
    out = {}
    for r in df.orderBy("learner", "place").collect():
        out.setdefault(r["learner"], []).append((r["chapter"], r["unit"], r["questions"]))
    return out


@pytest.mark.parametrize("sizes", [(90, 30), (30, 90)])
def test_a_chapters_share_is_its_weight_whatever_its_units(spark, sizes):
    rows = [(k, c, f"{c}{i}", 1, w, True) for k in range(300) for c, w, n in (("A", 1, sizes[0]), ("B", 9, sizes[1])) for i in range(n)]
    found = sets_of(compose.mixed_set(spark.createDataFrame(rows, UNITS), "learner", "chapter", "unit", 20, "probe"))
    assert len(found) == 300 and all(len(s) == 20 for s in found.values())
    picks = [Counter(c for c, _, _ in s) for s in found.values()]
    share = sum(p["B"] - 1 for p in picks) / (18 * 300)  # each chapter's first unit is no pick by weight
    assert share == pytest.approx(0.9, abs=0.02)
    firsts = Counter(u for s in found.values() for c, u, _ in s if c == "A")
    assert len(firsts) == sizes[0]  # every unit has its chance


def test_started_chapters_only_unless_none_is(spark):
    rows = [(1, c, f"{c}{i}", 1, 1, c != "A") for c in "ABC" for i in range(9)] + [(2, c, f"{c}{i}", 1, 1, False) for c in "AB" for i in range(30)]
    found = sets_of(compose.mixed_set(spark.createDataFrame(rows, UNITS), "learner", "chapter", "unit", 20, "s"))
    assert {c for c, _, _ in found[1]} == {"B", "C"} and len(found[1]) == 18
    assert {c for c, _, _ in found[2]} == {"A", "B"} and len(found[2]) == 20


def test_heaviest_chapters_first_and_units_that_fit(spark):
    rows = [(1, c, f"{c}{i}", 9, w, True) for c, w in (("A", 1), ("B", 5), ("C", 3)) for i in range(4)]
    rows += [(2, "A", "big", 21, 9, True), (2, "A", "two", 2, 9, True), (2, "B", "x", 19, 1, True), (2, "B", "y", 18, 1, True)]
    rows += [(3, "A", "only", 30, 1, True)]
    found = sets_of(compose.mixed_set(spark.createDataFrame(rows, UNITS), "learner", "chapter", "unit", 20, "s"))
    assert [c for c, _, _ in found[1]] == ["B", "C"]  # eighteen questions; the lightest chapter has no room left
    assert {u for _, u, _ in found[2]} == {"two", "y"} and 3 not in found
    assert compose.mixed_set(spark.createDataFrame([], UNITS), "learner", "chapter", "unit", 20, "s").count() == 0


def test_a_chapter_that_no_longer_fits_leaves_the_others_odds(spark):
    """A heavy chapter of large units drops out of the race; what is left goes to the others by their weights, to the last question."""
    rows = [(k, c, f"{c}{i}", q, w, True) for k in range(200) for c, w, q in (("A", 50, 8), ("B", 1, 1), ("C", 3, 1)) for i in range(20)]
    found = sets_of(compose.mixed_set(spark.createDataFrame(rows, UNITS), "learner", "chapter", "unit", 20, "s"))
    assert all(sum(q for _, _, q in s) == 20 for s in found.values())
    picks = Counter(c for s in found.values() for c, _, _ in s if c != "A")
    assert (picks["C"] - 200) / (picks["B"] + picks["C"] - 400) == pytest.approx(0.75, abs=0.06)


def ordered(spark, piles):
    """The chapters of a set with piles of so many units, in its order."""
    rows = spark.createDataFrame([(n, [(c, i) for c, k in p for i in range(k)]) for n, p in enumerate(piles)], "n int, taken array<struct<chapter:string,nth:int>>")
    return [r[0] for r in rows.orderBy("n").select(compose.interleaved(F.col("taken"))).collect()]


def test_interleaving(spark):
    (found,) = ordered(spark, [[("A", 5), ("B", 1), ("C", 1)]])
    assert "".join(c for c, _ in found) == "ABACAAA" and [i for c, i in found if c == "A"] == [0, 1, 2, 3, 4]
    assert ordered(spark, [[]]) == [[]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.integers(1, 7), min_size=1, max_size=6), min_size=30, max_size=40))
def test_interleaving_against_the_rule(spark, sizes):
    piles = [[("ABCDEF"[i], n) for i, n in enumerate(s)] for s in sizes]
    for pile, found in zip(piles, ordered(spark, piles), strict=True):
        left, standing, last = dict(pile), [c for c, _ in pile], None
        for c, i in found:
            standing = sorted((x for x in standing if left[x]), key=lambda x: -left[x])
            assert c == next((x for x in standing if x != last), standing[0])
            assert i == dict(pile)[c] - left[c]
            left[c] -= 1
            last = c
        assert not any(left.values())
        equal = sum(a[0] == b[0] for a, b in zip(found, found[1:]))
        most = max(n for _, n in pile)
        rest = sum(n for _, n in pile) - most
        assert equal >= max(0, most - rest - 1) and (equal == 0 or most > 1)


def test_sets_don_t_depend_on_partitions(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice("ABCD"), f"u{i}", rnd.randrange(1, 5), 2, True) for k in range(9) for i in range(40)]
    df = spark.createDataFrame(rows, UNITS)
    a, b = (sets_of(compose.mixed_set(x, "learner", "chapter", "unit", 20, "s")) for x in (df, df.repartition(7)))
    assert a == b
