"""Goldens of the reports, worked by hand from their rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from abacusloom.functions import scalars
from abacusloom.operators import firms, plan, quality, reporting


def entries(spark, **amounts):
    return spark.createDataFrame([(1, k, float(v)) for k, v in amounts.items()], "e int, kind string, amount double")


def one(df):
    (row,) = df.collect()
    return row.asDict()


def test_cash_flow_by_activity(spark):
    moves = entries(spark, profit=420_000, depreciation=80_000, loss_on_sale=10_000, assets_bought=600_000, sale_proceeds=150_000, investments_bought=200_000, dividends_received=40_000, shares_issued=800_000, loans_repaid=300_000, dividends_paid=120_000, interest_paid=60_000, other=5)
    balances = spark.createDataFrame([(1, "asset", 100_000.0, 130_000.0), (1, "asset", 70_000.0, 50_000.0), (1, "liability", 40_000.0, 55_000.0), (2, "asset", 9.5, 0.0)], "e int, side string, opening double, closing double")
    rows = {r["e"]: r for r in reporting.cash_flow(moves, balances, "e").collect()}
    assert tuple(rows[1])[1:] == (515_000, -610_000, 320_000, 225_000)  # debtors up 30,000, stock down 20,000, creditors up 15,000
    assert tuple(rows[2])[1:] == (9.5, 0, 0, 9.5)


def test_balancing_figures(spark):
    got = one(reporting.by_balancing(entries(spark, provision_open=90_000, charge=120_000, provision_close=105_000, asset_open=800_000, depreciation=100_000, sold_value=50_000, asset_close=950_000), "e"))
    assert (got["tax_paid"], got["assets_bought"]) == (105_000, 300_000)


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ({"revenue": 900, "cost": 600, "future": 400, "billed": 650}, {"stage": 0.6, "earned": 540, "expected_loss": 100, "provision": 40, "result": -100, "due_from": 0, "due_to": 150}),
        ({"revenue": 1_000, "cost": 400, "future": 400, "billed": 300}, {"stage": 0.5, "earned": 500, "expected_loss": 0, "provision": 0, "result": 100, "due_from": 200, "due_to": 0}),
        ({"revenue": 800, "cost": 360, "future": 540}, {"stage": 0.4, "earned": 320, "expected_loss": 100, "provision": 60, "result": -100, "due_from": 260, "due_to": 0}),
        ({"revenue": 50}, {"stage": 0, "earned": 0, "expected_loss": 0, "provision": 0, "result": 0, "due_from": 0, "due_to": 0}),
    ],
)
def test_contracts(spark, parts, want):
    rows = entries(spark, **parts).withColumn("eligible", F.lit(True))
    rows = rows.unionByName(rows.withColumns({"eligible": F.lit(False), "amount": F.lit(7e6)}))
    assert one(reporting.contract_dues(rows, "e")) == {"e": 1} | want


def test_revenue_by_kind_of_sale(spark):
    rows = [(1, "sale", 2_500_000.0, 190_000.0, 18_000.0, None), (2, "agency", 960_000.0, 0.0, 180_000.0, None), (3, "consignment", 480_000.0, 0.0, 24_000.0, None)]
    rows += [(4, "approval", 350_000.0, 0.0, 0.0, True), (4, "approval", 150_000.0, 0.0, 0.0, True), (4, "approval", 100_000.0, 0.0, 0.0, False), (5, "gift", 9.0, 0.0, 9.0, True)]
    df = spark.createDataFrame(rows, "e int, kind string, amount double, discount double, charge double, settled boolean")
    got = {r["e"]: (r["revenue"], r["expense"]) for r in reporting.recognised_revenue(df, "e").collect()}
    assert got == {1: (2_310_000, 18_000), 2: (180_000, 0), 3: (480_000, 24_000), 4: (500_000, 0), 5: (0, 0)}


def test_plans_and_leave(spark):
    got = one(reporting.plan_assets(entries(spark, opening=600_000, contributions=120_000, benefits=40_000, closing=740_000), "e", 8.0))
    assert (got["expected"], got["actual"], got["gain"]) == (51_200, 60_000, 8_800)
    row = spark.createDataFrame([(1_680_000.0, 1_150_000.0, 80_000.0, 150_000.0, 25.0), (500.0, 940.0, 0.0, 150.0, 0.0)], "obligation double, plan_assets double, unrecognised double, ceiling double, curtailed double")
    a, b = firms.benefit_obligation(row).orderBy(F.desc("obligation")).collect()
    assert (a["liability"], a["asset"], a["curtailment"]) == (450_000, 0, 400_000)  # a quarter of 1,680,000 less a quarter of 80,000
    assert (b["liability"], b["asset"]) == (0, 150)
    days = spark.createDataFrame([(1, 20, 26, 1_000.0), (1, 20, 15, 900.0), (1, 20, 22, 500.0)], "e int, entitled int, expected int, daily_pay double")
    assert one(reporting.leave_liability(days, "e")) == {"e": 1, "days": 8, "liability": 7_000}


def test_forward_contracts(spark):
    row = spark.createDataFrame([(dt.date(2026, 1, 1), dt.date(2026, 7, 1), 64.0, 66.4, 65.2, 67.0, 1_000.0, s) for s in (False, True)], "begins date, ends date, spot double, forward double, closing double, remaining double, units double, speculates boolean")
    hedge, bet = firms.forward_contracts(row, "2026-04-01").orderBy("speculates").collect()
    assert (hedge["premium"], hedge["gain"]) == (pytest.approx(1_200), None)  # half of (66.4 - 64) on 1,000
    assert (bet["premium"], bet["gain"], bet["restated"]) == (None, pytest.approx(600), 65_200)  # the rate for the remaining months, not the spot rate of the day


def test_purchase_of_a_business(spark):
    holders = spark.createDataFrame([(1, "shares", 32_000.0, 18.0, False, True), (1, "cash", 80_000.0, 3.0, False, False), (2, "shares", 100.0, 1.0, True, False), (2, "shares", 90.0, 1.0, False, True), (2, "shares", 11.0, 1.0, False, False)], "c int, kind string, number double, price double, held boolean, agrees boolean")
    lines = spark.createDataFrame([(1, "asset", 1_000_000.0), (1, "liability", 250_000.0), (1, "capital", 1.0), (2, "asset", 500.0)], "c int, kind string, amount double")
    a, b = reporting.purchase(holders, lines, "c").orderBy("c").collect()
    assert tuple(a)[1:] == (816_000, 750_000, 66_000, 0, True)
    assert tuple(b)[1:] == (201, 500, 0, 299, False)


def test_branches(spark):
    got = one(reporting.branch_profit(entries(spark, remitted=230_000, closing_stock=30_000, opening_stock=25_000, goods=200_000, expenses=15_000, retail_sales=240_000, wholesale_value=192_000, head_office=346_000, cash_in_transit=16_000, goods_in_transit=30_000), "e"))
    assert (got["profit"], got["above_wholesale"], got["own_side"]) == (20_000, 48_000, 300_000)


def test_appropriation_and_drawings(spark):
    partners = spark.createDataFrame([(1, 1, 3), (1, 2, 2)], "e int, partner_id int, ratio int")
    a, b = reporting.appropriation(entries(spark, profit=200_000, drawings_interest=3_000, capital_interest=18_000, salary=24_000, to_reserve=11_000, capital=1_500_000), partners, "e", 10.0).orderBy("partner_id").collect()
    assert (a["divisible"], a["share"], b["share"], a["super_profit"]) == (150_000, 90_000, 60_000, 50_000)
    rows = spark.createDataFrame([(n, t, 1_000.0) for n in (12, 4) for t in ("beginning", "middle", "end")], "n int, timing string, amount double")
    months = {(r["n"], r["timing"]): (r["months"], r["interest"]) for r in reporting.instalment_drawings(rows, 6.0).collect()}
    assert [months[12, t][0] for t in ("beginning", "middle", "end")] == [6.5, 6.0, 5.5] and [months[4, t][0] for t in ("beginning", "middle", "end")] == [7.5, 6.0, 4.5]
    assert months[12, "beginning"][1] == 390 and months[4, "end"][1] == 90


def test_transfers_equation_and_income(spark):
    rows = spark.createDataFrame([(1, 500.0, 420.0, 450.0, True), (2, 500.0, 500.0, 470.0, False), (3, 500.0, 480.0, 600.0, False)], "i int, cost double, carrying double, fair double, to_current boolean")
    assert [(r["transfer"], r["loss"]) for r in reporting.transfers(rows).orderBy("i").collect()] == [(420, 0), (470, 30), (500, 0)]
    assert one(reporting.profit_equation(entries(spark, closing_assets=900_000, closing_liabilities=340_000, opening_assets=700_000, opening_liabilities=280_000, capital_in=50_000, drawings=90_000), "e"))["profit"] == 180_000
    got = one(reporting.income_methods(entries(spark, wages=2_500, rent=400, interest=300, profit=600, mixed=700, consumption=3_000, investment=800, government=1_200, exports=500, imports=400), "e"))
    assert (got["income"], got["product"], got["saving"]) == (4_500, 5_100, 1_500) and got["average_saving"] == pytest.approx(1 / 3, abs=1e-6)
    row = spark.createDataFrame([(100.0, 0.8, 100.0, 50.0)], "autonomous double, propensity double, investment double, more double")
    assert [one(reporting.equilibrium(row))[c] for c in ("income", "consumption", "added")] == pytest.approx([1_000, 900, 250])


def test_paper_cycle(spark):
    days = spark.createDataFrame([(1, dt.date(2026, 5, d), k) for d, k in enumerate(["revision3", "mock", "revision3", "revision3", "gap", "revision2"], 1)], "plan_id int, date date, kind string")
    papers = spark.createDataFrame([(1, "c", 3), (1, "a", 1), (1, "b", 2)], "plan_id int, paper string, number int")
    got = [(r["date"].day, r["slot"], r["paper"]) for r in plan.paper_cycle(days, papers).orderBy("date", "slot").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c"), (3, 1, "a"), (4, 0, "b"), (4, 1, "c")]


def test_groups_and_slugs(spark):
    members = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 1)], "m string, g int")
    every = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "m string")
    assert {tuple(r) for r in quality.not_exactly_one(members, "m", "g", every).collect()} == {("b", 2), ("d", 0)}
    sets = spark.createDataFrame([("s1", "a"), ("s1", "x"), ("s1", "x"), ("s2", None), ("s2", "d")], "set string, m string")
    assert {tuple(r) for r in quality.unresolved(sets, every, "m", "set").collect()} == {("s1", "x"), ("s2", None)}


def test_labels_and_topics(spark):
    days = [dt.date(2026, m, 9) for m in range(1, 13)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", scalars.human_label(F.col("d")).alias("label"), scalars.month_label(F.col("d")).alias("month"), scalars.human_date(scalars.human_label(F.col("d"))).alias("back")).orderBy("d").collect()
    assert [r["label"].split()[1] for r in rows] == "Jan Feb Mar Apr May June July Aug Sept Oct Nov Dec".split()
    assert [r["back"] for r in rows] == days and rows[8]["month"] == "September 2026"
    topics = [["Ch 4 · Leases · Lessee", "Leases · Lessor", "Hire · Buyer"], ["A · x", "B · y", "C", "A · z"], ["Ch 1", "", None], []]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(topics)], "i int, t array<string>").orderBy("i").select(scalars.topic_list(F.col("t"))).collect()]
    assert got == [["Lessee", "Lessor", "Buyer"], ["A", "B", "C"], [], []]


def test_adjusted_accounts(spark):
    balances = spark.createDataFrame([(1, "purchases", 1_000.0), (1, "sales", -2_000.0), (1, "debtors", 700.0)], "e int, account string, amount double")
    rows = [(1, "withdrawn", 125.0, 25.0, None), (1, "abnormal_loss", 250.0, 25.0, 150.0), (1, "abnormal_loss", 125.0, 25.0, 500.0), (1, "on_approval", 500.0, 25.0, None), (2, "samples", 10.0, 0.0, None)]
    got = {(r["e"], r["account"]): (r["before"], r["after"]) for r in reporting.adjusted_accounts(balances, spark.createDataFrame(rows, "e int, kind string, amount double, margin double, insured double"), "e").collect()}
    assert got == {
        (1, "purchases"): (1_000, 600), (1, "drawings"): (0, 100), (1, "insurer"): (0, 250), (1, "losses"): (0, 50), (1, "sales"): (-2_000, -1_500), (1, "debtors"): (700, 200), (1, "closing_stock"): (0, 400), (1, "trading"): (0, -400),
        (2, "purchases"): (0, -10), (2, "advertising"): (0, 10),
    }
    assert sum(after - before for before, after in got.values()) == 0


def test_funds(spark):
    rows = [(1, "prize", "opening", 500.0), (1, "prize", "income", 50.0), (1, "prize", "expense", 600.0), (1, "hall", "receipt", 900.0), (1, "hall", "expense", 100.0), (1, "hall", "asset", 300.0), (1, "lamp", "receipt", 80.0), (1, "lamp", "asset", 100.0)]
    got = {r["fund"]: (r["closing"], r["excess"], r["to_capital"]) for r in reporting.special_funds(spark.createDataFrame(rows, "e int, fund string, kind string, amount double"), "e").collect()}
    assert got == {"prize": (0, 50, 0), "hall": (500, 0, 300), "lamp": (0, 0, 80)}
    row = one(reporting.capital_fund(entries(spark, assets=9_000, debts=1_000, capitalised=500, income=3_000, expense=1_200, stock_open=200, paid=700, creditors_open=150, creditors_close=250, stock_close=300), "e"))
    assert (row["consumed"], row["surplus"], row["closing"]) == (700, 1_100, 9_600)


def test_published_indices(spark):
    sums = spark.createDataFrame([(1, 800, 1_600, 801, 1_641), (2, 200, 200, 225, 225)], "k int, s00 long, s01 long, s10 long, s11 long")
    a, b = reporting.published_indices(sums, "k").orderBy("k").collect()
    assert tuple(a)[1:] == (100.13, 102.56, round((100.125 * 102.5625) ** 0.5, 2)) and tuple(b)[1:] == (112.5, 112.5, 112.5)  # 100.125 and 102.5625 with halves up
