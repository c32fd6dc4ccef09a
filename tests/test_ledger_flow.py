"""One ledger from page lines to its report, ranks by ranges, reconciliations with one side missing."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstone.operators import layout, ordering, pipelines, reconstruct
from quillstone.operators import rules as R

LINES = "doc string, page int, line_no long, text string"
TITLES = "Date Particulars Vch Type Vch No. Debit Credit"
PERIOD = "1-Apr-24 to 31-Mar-25"


def lines(spark, *pages, doc="d"):
    return spark.createDataFrame([(doc, p, i, t) for p, page in enumerate(pages, 1) for i, t in enumerate(page)], LINES)


@pytest.mark.parametrize(
    "head,account",
    [
        (["ANONYMISED FIRM", "Rent", "Ledger Account", PERIOD], "Rent"),
        (["Cash Book", PERIOD], "Cash"),
        (["Axis Bank Book", PERIOD, "Page 3"], "Axis Bank"),
        (["ANONYMISED FIRM", f"Sales Ledger : {PERIOD} Page 4", "Account"], "Sales"),
        ([f"Hind Motors : {PERIOD} Page 4", "Ltd Book"], "Hind Motors Ltd"),
        ([f"Hind Motors : {PERIOD} Page 4", "and Sons Account", "CO."], "Hind Motors and Sons CO."),
        (["ANONYMISED FIRM", "P086", "L", PERIOD, "Page 1"], "P086"),
        (["ANONYMISED FIRM", "P086", "Ledg nt", PERIOD, "Page 1"], "P086"),
        (["Jammu", "E-Mail :", PERIOD, "Page 1"], None),
        (["ANONYMISED FIRM", PERIOD, "Page 1"], None),
    ],
)
def test_page_headers(spark, head, account):
    got = reconstruct.page_headers(lines(spark, [*head, TITLES, "x"])).collect()
    assert [(r.account, r.body_from) for r in got] == [(account, len(head) + 1)]


def test_pages_without_titles(spark):
    got = reconstruct.page_headers(lines(spark, ["Rent", "Ledger Account"])).collect()
    assert [(r.account, r.body_from) for r in got] == [(None, None)]


BOOK = [
    ["Rent", "Ledger Account", PERIOD, TITLES, "1-Apr-24 To Cash Payment 7 1,000.00", "2-Apr-24 To (as per details)", "Journal 8 500.00", "Bank 500.00 Cr", "Carried Over 1,500.00"],
    [TITLES, "Brought Forward 1,500.00", "3-Apr-24 To Journal9 20.00", "Cash 20.00 Cr", "what is this", "Carried Over 1,520.00"],
    ["Rent Expenses", "Ledger Account", PERIOD, TITLES, "Brought Forward 1,520.00", "4-Apr-24 By Cash Receipt 10 5.00", "Cash 5.00 Dr", "Closing Balance 1,515.00"],
    ["Cash", "Ledger Account", PERIOD, TITLES, "1-Apr-24 By Rent Payment 7 1,000.00"],
]


def test_reconstruct(spark):
    parts = reconstruct.reconstruct(lines(spark, *BOOK))
    assert {r.page: r.account for r in parts["headers"].collect()} == {1: "Rent", 2: "Rent", 3: "Rent", 4: "Cash"}
    legs = {(r.entry_id, r.dr_cr): (r.amount, r.source_pages, r.conflicts) for r in parts["legs"].collect()}
    assert legs["Payment_7", "Dr"][:2] == (Decimal("1000.00"), [1]) and legs["Payment_7", "Cr"][:2] == (Decimal("1000.00"), [4])
    assert legs["Journal_8", "Dr"][0] == legs["Journal_8", "Cr"][0] == Decimal("500.00")  # a wrapped header
    assert legs["Journal_9", "Dr"][0] == Decimal("20.00")  # blank particulars, the type run into the number
    assert [r.text for r in parts["unresolved"].collect()] == ["what is this"]
    assert sorted(r.particulars for r in parts["state_events"].collect()) == ["Brought Forward", "Brought Forward", "Carried Over", "Carried Over", "Closing Balance"]
    assert reconstruct.statistics(parts) == {"vouchers": 4, "unbalanced": 0, "legs": 8, "unresolved": 1, "headerless": 0}


def test_process_ledger(spark, tmp_path):
    out = pipelines.process_ledger(lines(spark, *BOOK), "book", str(tmp_path), known_unbalanced=2)
    assert (out["status"], out["confidence"], out["drifted"]) == ("ok", "low", True)
    assert spark.read.json(f"{tmp_path}/book_legs").count() == 8 and spark.read.json(f"{tmp_path}/book_unresolved").count() == 1
    assert out["report"]["dataset"] == {"total_legs": 8, "report_label": "book"}
    legs = {(r.entry_id, r.dr_cr): r for r in out["legs"].collect()}
    assert str(legs["Payment_7", "Dr"].date) == "2024-04-01" and legs["Payment_7", "Dr"].vch_no == "7"
    assert not pipelines.process_ledger(lines(spark, *BOOK), "book", known_unbalanced=0)["drifted"]
    empty = pipelines.process_ledger(lines(spark, ["nothing"]), "none")
    assert empty["status"] == "reconstruct failed" and empty["reason"] == "no vouchers found"


@pytest.mark.parametrize("edges", [[], [3.0], [0.0, 1.0, 2.0, 5.0, 99.0], [-1.0]])
def test_first_ranks(spark, edges):
    rows = [(i, float((i * 7) % 11)) for i in range(60)]
    got = ordering.first_ranks(spark.createDataFrame(rows, "id int, v double"), "v", ["id"], edges, 25)
    want = {i: n + 1 for n, (i, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))[:25])}
    assert {r.id: r["rank"] for r in got.collect()} == want
    assert ordering.first_ranks(spark.createDataFrame([], "id int, v double"), "v", ["id"], edges, 25).count() == 0


def test_one_sided(spark):
    a = spark.createDataFrame([("x", Decimal(100), Decimal(1)), ("y", Decimal(50), Decimal(2))], "k string, p decimal(18,2), q decimal(18,2)")
    b = spark.createDataFrame([("x", Decimal(60), Decimal(1)), ("z", Decimal(70), Decimal(0))], "k string, p decimal(18,2), q decimal(18,2)")
    got = {(r.k, r.check): (float(r.mismatch), r.severity) for r in R.reconcile(a, b, ["k"], ["p", "q"], 10.0, how="full").collect()}
    assert got == {("x", "p"): (40.0, "CRITICAL"), ("y", "p"): (50.0, "CRITICAL"), ("z", "p"): (-70.0, "CRITICAL")}
    got = [(r.k, r.check, r.mismatch, r.severity) for r in R.reconcile(a, b, ["k"], ["p", "q"], 10.0, how="left", missing="missing_filing").collect()]
    assert sorted(got, key=str) == [("x", "p", Decimal("40.00"), "CRITICAL"), ("y", "missing_filing", None, "CRITICAL")]


def test_hot_duplicate_key(spark):
    legs = spark.createDataFrame([(f"V{i:03d}", 1, "Rent", Decimal("20000.00"), "Dr") for i in range(300)] + [("W", 1, "Other", Decimal("5.00"), "Dr")], "entry_id string, leg_num int, account string, amount decimal(18,2), dr_cr string").withColumn("date", F.lit("2024-04-01").cast("date"))
    keys = [F.col("date"), F.col("account"), F.col("dr_cr"), F.round("amount", 2)]
    got = {r.entry_id: r for r in R.duplicates(legs, keys).collect()}
    assert len(got) == 300 and all(r.vouchers == 300 and r.severity == "HIGH" for r in got.values())
    assert got["V001"].reason == "matches voucher(s) V000, V002, V003 on 2024-04-01"
    assert {(r.first_id, r.vouchers) for r in R.related(legs, keys).collect()} == {("V000", 300)}


def test_balance_columns(spark):
    words = [("d", 1, 10.0, 20, 60, "Bank"), ("d", 1, 10.2, 65, 90, "of"), ("d", 1, 10.0, 200, 300, "1,000.00"), ("d", 1, 10.0, 330, 345, "Cr"), ("d", 1, 10.0, 430, 480, "7.00"), ("d", 1, 10.4, 500, 530, "8.00"), ("d", 1, 10.0, 535, 560, "9.00"), ("d", 1, 10.0, 562, 570, "Dr"), ("d", 1, 11.6, 20, 60, "Page"), ("d", 1, 40.0, 20, 50, "Page"), ("d", 1, 40.0, 55, 60, "2.00")]
    df = spark.createDataFrame([(d, p, t, float(a), float(b), x) for d, p, t, a, b, x in words], "doc string, page int, top double, x0 double, x1 double, text string")
    got = layout.trial_balance(df.where("text <> 'Page'")).where("account <> ''").collect()
    assert [(r.account, r.opening, r.opening_sign, r.debit, r.credit, r.closing, r.closing_sign) for r in got] == [("Bank of", 1000.0, None, 0.0, 7.0, 9.0, "Dr")]
    assert layout.numbered(df, grid=3.0).where("text = 'Page'").select("line").distinct().count() == 2


def test_sql_functions(spark):
    """The helpers in SQL say what the expressions say."""
    from quillstone.functions import exprs as X

    X.register_sql(spark)
    texts = ["1,23,456.78", "(500)", "( 5.5 )", "12-", "-12", "Rs 7", "Rs. 500", "", " ", "abc", "(1", "1.2.3", "Output CGST 9%", "Input SGST", "SGST Payable", "IGST", "A/24-25/017", "12", "x9y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = {"indian_number": X.indian_number("t"), "tax_head": X.tax_head("t"), "voucher_prefix": X.voucher_prefix("t"), "voucher_number": X.voucher_number("t")}
    for r in df.select("t", *(F.expr(f"{n}(t)").alias(n) for n in pairs), *(c.alias(f"{n}_x") for n, c in pairs.items())).collect():
        for n in pairs:
            assert r[n] == r[f"{n}_x"], (r.t, n)
