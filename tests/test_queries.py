"""Every query with SQL returns the same rows as its SQL on the given tables; the others are tested by their rules."""

import os
import subprocess
import sys

import compare
import pytest
from pyspark.sql import functions as F

from abacusloom.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, sf_dir, name):
    assert compare.compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) == ""


def test_every_sql_has_its_query():
    assert ORACLES.keys() <= QUERIES.keys()


def test_jitter_keeps_its_bounds(spark, sf_dir):
    rows = QUERIES["notebook_jitter"](spark, sf_dir)
    days = (F.unix_timestamp(F.col("due").cast("timestamp")) - F.unix_timestamp(F.col("last_at").cast("timestamp"))) / 86_400
    low, high = rows.agg(F.min(days), F.max(days)).first()
    assert 3 <= low <= high <= 7 and high - low > 1


def test_variants_share_the_prefix_and_avoid_cases(spark, sf_dir):
    picked = QUERIES["variant_pick"](spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("variant_id"), F.lower("p_type").alias("type"), "p_brand", "p_size")
    rows = picked.join(part, "variant_id").collect()
    by_prefix = {}
    for r in part.filter("p_size <= 45").collect():
        by_prefix.setdefault(r["type"], []).append((r["variant_id"], r["p_brand"]))
    assert len(rows) == part.count()
    for r in rows:
        others = [v for v in by_prefix.get(r["prefix"], []) if v[0] != r["question_id"]]
        if not others:
            assert r["variant_id"] == r["question_id"]
        else:
            same = [v for v, b in others if b == r["paper"]]
            assert r["variant_id"] in (same or [v for v, _ in others])


def test_moving_average_follows_the_loop(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()
    moves = {}
    for r in rows:
        seq = (r["l_orderkey"], r["l_linenumber"], r["l_suppkey"], r["l_quantity"], r["l_extendedprice"])
        buy = r["l_linestatus"] == "O"
        units, rate = (r["l_quantity"], r["l_extendedprice"] / r["l_quantity"]) if buy else (-r["l_quantity"] / 2, 0.0)
        moves.setdefault(r["l_partkey"], []).append((r["l_shipdate"], seq, units, rate))
    for r in QUERIES["moving_average_value"](spark, sf_dir).collect():
        n = v = 0.0
        for _, _, units, rate in sorted(moves[r["item_id"]]):
            v += units * (rate if units > 0 else v / n if n > 0 else 0.0)
            n += units
        assert r["units"] == pytest.approx(n, abs=1e-3) and r["value"] == pytest.approx(v, abs=1e-2)


def test_composed_papers_fit_and_are_greedy(spark, sf_dir):
    from abacusloom.plans import content

    made = {}
    for r in content.composed(spark, sf_dir).collect():
        made.setdefault(r["request_id"], {}).setdefault(r["part"], []).append((r["unit"], r["marks"]))
    assert made
    for parts in made.values():
        for part, room in ((1, 30), (2, 70)):
            units = parts.get(part, [])
            assert sum(m for _, m in units) <= room and len({u for u, _ in units}) == len(units)
    lack = QUERIES["composed_papers"](spark, sf_dir).collect()
    assert len(lack) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert all(r["missing_choice"] == 30 - sum(m for _, m in made.get(r["request_id"], {}).get(1, [])) for r in lack)


def test_a_missing_library_costs_no_other_query():
    """Without a library that only the optional subpackage needs, all other queries are there."""
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['zstandard'] = None; import __spark_entry__ as e; from abacusloom.plans.registry import QUERIES, ORACLES; print(set(QUERIES) == set(e.queries()), set(ORACLES) == set(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["True", "True"]
