"""Rules on hand-built ledgers: one row a behaviour, with boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.operators import anomaly, reconstruct
from quillstone.operators import rules as R

COLS = "row_idx long, entry_id string, date date, account string, amount double, dr_cr string, entered_by string, approved_by string, vch_type string, leg_num int"


def day(n):
    return dt.date(2024, 4, n)


@pytest.fixture(scope="module")
def legs(spark):
    rows = [
        ("JV_1", day(1), "Misc Expense", 5000.0, "Dr", "U1", "U1"),
        ("JV_2", day(1), "Misc Expense", 5000.0, "Dr", "U1", "U2"),
        ("JV_3", day(1), "Misc Expense", 5000.0, "Dr", "", " "),
        ("JV_4", day(2), "Office Supplies", 20000.0, "Dr", None, None),
        ("JV_5", day(2), "Rent Expense", 30000.0, "Dr", None, None),
        ("JV_6", day(2), "Office Supplies", 20123.45, "Dr", None, None),
        ("Receipt_10", day(3), "Bank", 100000.0, "Cr", None, None),
        ("Receipt_11", day(3), "Bank", 100000.0, "Cr", None, None),
        ("Journal_20", day(4), "Sundry Debtors", 7000.0, "Dr", None, None),
        ("Journal_20", day(4), "Sundry Debtors", 7000.0, "Dr", None, None),
        ("Journal_21", day(5), "Cash", 15000.0, "Dr", None, None),
        ("Journal_22", day(5), "Cash", 15000.0, "Cr", None, None),
        *(("Sales_3%d" % i, day(6), "Sales", 150000.0, "Cr", None, None) for i in range(3)),
    ]
    seen = {}
    out = []
    for i, r in enumerate(rows):
        seen[r[0]] = seen.get(r[0], 0) + 1
        out.append((i, *r, "Journal", seen[r[0]]))
    return spark.createDataFrame(out, COLS)


def test_segregation(legs):
    assert [r.entry_id for r in R.segregation(legs).collect()] == ["JV_1"]


def test_round(legs):
    got = {r.entry_id: r.severity for r in R.round_amounts(legs).collect()}
    assert set(got) == {"JV_4", "Receipt_10", "Receipt_11", "Sales_30", "Sales_31", "Sales_32"} and set(got.values()) == {"LOW"}


def test_duplicates(legs):
    keys = [F.col("date"), F.col("account"), F.format_string("%.2f", "amount"), F.col("dr_cr")]
    got = {r.entry_id: r for r in R.duplicates(legs, keys).collect()}
    assert set(got) == {"JV_1", "JV_2", "JV_3", "Receipt_10", "Receipt_11", "Sales_30", "Sales_31", "Sales_32"}
    assert got["Receipt_10"].severity == "HIGH" and got["Sales_30"].severity == "CRITICAL"
    assert got["Sales_30"].reason.startswith("matches voucher(s) Sales_31, Sales_32 on ")


def test_converge(legs):
    keys = [F.col("date"), F.col("account"), F.format_string("%.2f", "amount"), F.col("dr_cr")]
    got = {r.entry_id: r for r in R.converge(legs, [R.segregation(legs), R.round_amounts(legs), R.duplicates(legs, keys)]).collect()}
    assert (got["Receipt_10"].signal_count, got["Receipt_10"].severity) == (2, "HIGH")
    assert [x.rule for x in got["JV_1"].reasons] == ["segregation_of_duties", "duplicate_transaction"]


@pytest.mark.parametrize("numbers,expected", [([1, 2, 3, 5, 6], [(4, 3, 5)]), (list(range(1, 11)), []), ([2], []), ([1, 1, 1, 2, 4], [(3, 2, 4)]), ([1000000000, 1000000007, 1000000014], [])])
def test_gaps(spark, numbers, expected):
    df = spark.createDataFrame([(n, f"e{i}", day(1), "J", i) for i, n in enumerate(numbers)], "number long, entry_id string, date date, vch_type string, row_idx long")
    assert [(r.missing, r.before, r.after) for r in R.sequence_gaps(df, ["vch_type"]).collect()] == expected


@pytest.mark.parametrize("amount,sev", [(9999.99, "LOW"), (10000.0, "MEDIUM"), (99999.99, "MEDIUM"), (100000.0, "HIGH"), (999999.99, "HIGH"), (1000000.0, "CRITICAL"), (-1000000.0, "CRITICAL")])
def test_amount_severity(spark, amount, sev):
    assert spark.range(1).select(X.amount_severity(F.lit(amount))).first()[0] == sev


@pytest.mark.parametrize("m,r,sev", [(3000, 10000, "CRITICAL"), (2999, 10000, "HIGH"), (1000, 10000, "HIGH"), (999, 10000, "MEDIUM"), (1, 10000, "MEDIUM"), (0, 10000, "NONE"), (0, 0, "NONE"), (500, 0, "CRITICAL")])
def test_percent_severity(spark, m, r, sev):
    assert spark.range(1).select(X.percent_severity(F.lit(m), F.lit(r))).first()[0] == sev


def test_scalars(spark):
    df = spark.createDataFrame([("12,00,395.21",), ("(1,001.00)",), ("1,001.00-",), ("-5",), ("-",), ("",), (None,), ("abc",)], "x string")
    assert [r[0] for r in df.select(X.indian_number("x")).collect()] == [1200395.21, -1001.0, -1001.0, -5.0, None, None, None, None]
    digits = spark.createDataFrame([(12345.0,), (987.65,), (-500.0,), (0.042,), (0.0,)], "x double")
    assert [r[0] for r in digits.select(X.first_digit("x")).collect()] == [1, 9, 5, 4, None]
    names = spark.createDataFrame([("Output CGST",), ("Input CGST",), ("State/UT Tax",), ("Integrated Tax 18%",), ("Surround Sound",), ("Round Off/Discount",)], "a string")
    assert [tuple(r) for r in names.select(X.tax_head("a"), X.is_rounding_account("a")).collect()] == [("cgst", False), (None, False), ("sgst", False), ("igst", False), (None, False), (None, True)]
    dates = spark.createDataFrame([("27-Aug-25",), ("5-Jan-26",), ("2024-04-01",)], "d string").select(X.any_date("d").alias("d"))
    assert [tuple(r) for r in dates.select(X.fiscal_year("d"), X.month_name("d")).collect()] == [("2025-26", "August"), ("2025-26", "January"), ("2024-25", "April")]
    no = spark.createDataFrame([("AB/24-25/507",), ("X",), (" 12 ",)], "n string")
    assert [tuple(r) for r in no.select(X.voucher_prefix("n"), X.voucher_number("n").cast("long")).collect()] == [("AB/24-25/", 507), (None, None), ("", 12)]


def test_sql_functions(spark):
    X.register_sql(spark)
    assert tuple(spark.sql("SELECT amount_severity(150000D), first_digit(-0.042D), percent_severity(500D, 0D)").first()) == ("HIGH", 4, "CRITICAL")


def test_benford(spark):
    counts = [3010, 1760, 1250, 970, 790, 670, 580, 510, 460]
    exact = spark.createDataFrame([(i * 100.0, n) for i, n in enumerate(counts, 1)], "amount double, n int").select("amount", F.explode(F.sequence(F.lit(1), "n")))
    r = R.benford(exact).first()
    assert not r.deviates and r.mad < 0.006
    r = R.benford(spark.range(500).select(F.lit(500.0).alias("amount"))).first()
    assert r.deviates and r.mad >= 0.015


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 10000.0), ("y", 500.0), ("z", 5.0)], "k string, v double")
    b = spark.createDataFrame([("x", 8500.0), ("y", 0.0), ("z", 4.0)], "k string, v double")
    got = {r.k: r.severity for r in R.reconcile(a, b, ["k"], ["v"], 10.0, reference="left").collect()}
    assert got == {"x": "HIGH", "y": "CRITICAL"}


def test_reconstruct(spark):
    text = """Office Supplies
Ledger Account
1-Apr-24 to 31-Mar-25
Page 1
Date Particulars Vch Type Vch No. Debit Credit Balance
1-Apr-24 To Opening Balance 1,000.00
2-Apr-24 By (as per details) Journal 7 500.00 1,500.00 Cr
Cash 300.00 Dr
200.00 Dr
Being stationery purchased
3-Apr-24 To Cash Payment 8 250.00 1,250.00 Cr
Carried Over 750.00"""
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(text.split("\n"))], "doc string, page int, line_no long, text string")
    got = reconstruct.occurrences(df).orderBy("line_no").collect()
    assert [r.kind for r in got] == ["state", "leg", "leg", "orphan", "narration", "leg", "narration", "state"]
    legs = {(r.entry_id, r.particulars, r.dr_cr): r.amount for r in reconstruct.merged(reconstruct.occurrences(df)).collect()}
    assert legs == {("Journal_7", "Office Supplies", "Cr"): 500.0, ("Journal_7", "Cash", "Dr"): 300.0, ("Payment_8", "Office Supplies", "Dr"): 250.0}


def test_anomaly(spark):
    df = spark.range(2000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entry_id"), F.lit(1).alias("leg_num"), F.lit("A").alias("account"), F.when(F.col("id") < 5, 9e7).otherwise(1000 + F.col("id") % 50).cast("decimal(18,2)").alias("amount"), F.lit(day(5)).alias("date"), F.lit("Dr").alias("dr_cr"), F.lit("J").alias("vch_type"))
    flags = anomaly.flags(anomaly.features(df)).collect()
    assert len(flags) == 100 and {r.entry_id for r in flags if r.severity == "high"} >= {f"e{i}" for i in range(5)}
    assert anomaly.flags(anomaly.features(df.limit(10))).count() == 0
