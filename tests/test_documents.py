"""Documents, cleaning, sinks, pairing, pipelines and streams on small inputs."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from quillstone.operators import cleaning, filings, layout, pairing, pipelines, sinks
from quillstone.sources import ledger, scan
from quillstone.streaming import ingest

GSTR1 = """Financial year 2025-26
Tax period April
ARN date 11/05/2025
Total 1 Net Value 900.00 1.00 2.00 2.00 0.00
- Non-GST 100.00
Total Liability (Outward supplies other than Reverse charge) 1,100.00 5.00 6.00 7.00 0.00"""


def test_gstr1(spark):
    df = spark.createDataFrame([("a", GSTR1), ("b", GSTR1.replace("- Non-GST 100.00", ""))], "doc string, text string")
    good, bad = filings.gstr1(df)
    r = good.first()
    assert (r.financial_year, r.period, float(r.taxable_value), float(r.cgst), r.arn_date) == ("2025-26", "April", 1000.0, 6.0, "11/05/2025")
    assert [(x.doc, x.missing) for x in bad.collect()] == [("b", "Table 8")]


def test_bundle(spark):
    pages = spark.createDataFrame([("d", 1, "cover"), ("d", 2, "Tax period April"), ("d", 3, "more"), ("d", 4, "Tax period May")], "doc string, page int, text string")
    assert [r.text for r in filings.month_blocks(pages, "gstr1").orderBy("block").collect()] == ["Tax period April\nmore", "Tax period May"]
    rows = spark.createDataFrame([("2025-26", "April", 0, 1.0), ("2025-26", "April", 1, 2.0)], "financial_year string, period string, src int, v double")
    assert [r.v for r in filings.first_of_period(rows, ["src"]).collect()] == [1.0]


def test_tds(spark):
    a = spark.createDataFrame([("f", i, t) for i, t in enumerate(["PART-I", "1 Firm A ABCD12345E 10.00 5.00 32018.00", "PART-II", "2 Firm B BBCD12345E 1.00 1.00 1.00"])], "doc string, line_no int, text string")
    b = spark.createDataFrame([("c", i, t) for i, t in enumerate(["ABCD12345E FIRM A 1100395 22018 194C BP", "ABCD12345E FIRM A 100000 10000 194R BP", "ZBCD12345E FIRM Z 1 7 194C BP"])], "doc string, line_no int, text string")
    got = {r.tan: (r.deductor_name, float(r.tds_reported_by_deductor), float(r.tds_claimed_in_itr_share)) for r in filings.tds_pairs(filings.deductors_26as(a), filings.claims_coi(b)).collect()}
    assert got == {"ABCD12345E": ("Firm A", 32018.0, 32018.0), "ZBCD12345E": ("FIRM Z", 0.0, 7.0)}


def test_trial_balance(spark):
    words = [("d", 1, 10.0, 20, 80, "Trial"), ("d", 1, 10.0, 85, 130, "Balance"), ("d", 1, 30.4, 20, 60, "Cash"), ("d", 1, 31.0, 200, 300, "1,000.00"), ("d", 1, 30.0, 305, 315, "Dr"), ("d", 1, 30.0, 350, 400, "50.00"), ("d", 1, 31.0, 500, 560, "950.00"), ("d", 1, 30.0, 565, 575, "Cr"), ("d", 1, 60.0, 20, 60, "Heading")]
    r = layout.trial_balance(spark.createDataFrame([(d, p, t, float(a), float(b), x) for d, p, t, a, b, x in words], "doc string, page int, top double, x0 double, x1 double, text string")).collect()
    assert len(r) == 1 and (r[0].account, r[0].opening, r[0].opening_sign, r[0].debit, r[0].credit, r[0].closing, r[0].closing_sign) == ("Cash", 1000.0, "Dr", 50.0, 0.0, 950.0, "Cr")


def test_columns(spark):
    bounds = layout.column_bounds([10, 11, 12, 100, 101, 200, 202, 10, 100])
    assert len(bounds) == 2 and 12 < bounds[0] < 100 < bounds[1] < 200
    words = [("d", 1, t, x, x + 5.0, f"w{i}") for t in (1.0, 20.0) for i, x in enumerate((10.0, 100.0, 200.0))]
    assert [r.cells for r in layout.in_columns(spark.createDataFrame(words, "doc string, page int, top double, x0 double, x1 double, text string")).orderBy("line").collect()] == [["w0", "w1", "w2"]] * 2
    rows = spark.createDataFrame([("d", 1, 0, ["1-Apr", "Rent of", "5.00"]), ("d", 1, 1, ["", "the shop", ""]), ("d", 1, 2, ["2-Apr", "x", "6.00"])], "doc string, page int, line int, cells array<string>")
    assert [r.cells for r in layout.continued(rows).orderBy("line").collect()] == [["1-Apr", "Rent of the shop", "5.00"], ["2-Apr", "x", "6.00"]]
    assert layout.fragment_groups([["Date", "Amt"], ["Date", "Amt"], ["A", "B"], ["column_1", "column_2"], ["x"]]) == [0, 0, 1, 1, 2]


def test_cleaning(spark):
    assert cleaning.unique_names(["a", " a ", "", None]) == ["a", "a_2", "column_3", "column_4"]
    df = spark.createDataFrame([(" x  y ", "N/A"), ("=cmd", "1"), ("----------", None), ("Page 4", None), ("name", "value")], "name string, value string")
    assert [tuple(r) for r in cleaning.clean(df).collect()] == [("x y", None), ("'=cmd", "1")]
    assert cleaning.quality(df).first().score == pytest.approx(0.8)


def test_pairing(spark):
    docs = spark.createDataFrame([("f1", "form_26as", "2025-26", 5), ("f0", "form_26as", "2024-25", 1), ("c1", "itr_computation", "2025-26", 2), ("c2", "itr_computation", "2025-26", 3), ("a0", "itr_acknowledgement", None, 9)], "filename string, doctype string, assessment_year string, modified long")
    r = pairing.tax_sources(docs).first()
    assert (r.form, r.computation, r.acknowledgement, r.status, r.missing) == ("f1", "c2", None, "incomplete", "acknowledgement")
    led = spark.sql("SELECT 'l' ledger_id, DATE'2024-05-01' lo, DATE'2024-06-01' hi UNION ALL SELECT 'm', DATE'1999-01-01', DATE'1999-02-01'")
    tb = spark.sql("SELECT 1 rank, DATE'2024-05-15' start, DATE'2025-03-31' end, 'late' filename UNION ALL SELECT 2, DATE'2024-04-01', DATE'2025-03-31', 'year'")
    assert {x.ledger_id: x.trial_balance for x in pairing.covering_balance(led, tb).collect()} == {"l": "year", "m": None}
    chosen = spark.createDataFrame([("c2",)], "filename string")
    assert {x.filename: x.usage for x in pairing.usage(docs, chosen).collect()} == {"f1": "not used", "f0": "not used", "c1": "superseded", "c2": "used", "a0": "not used"}


def test_ledger_csv(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text('entry_id,date,account,entry_type,amount,vch_type,vch_no,dr_cr,source_pages,resolved\nJ_1,4-Apr-24,"Cash, bank",Dr,7000.00,Journal,1,Dr,12;40,True\nJ_2,4-Apr-24,Cash,Cr,abc,Journal,2,Cr,,False\n')
    legs, bad = ledger.read_ledger(spark, str(p), "L")
    r = legs.first()
    assert (r.account, float(r.amount), str(r.date), r.source_pages, r.resolved, r.dr_cr) == ("Cash, bank", 7000.0, "2024-04-04", [12, 40], True, "Dr")
    assert [x.amount_raw for x in bad.collect()] == ["abc"]
    assert ledger.ledger_or_empty(spark, str(tmp_path / "none.csv"), "L").count() == 0
    assert ledger.read_any(spark, "x.pdf")[1] and ledger.read_any(spark, str(p))[0].count() == 2


def test_reports(tmp_path):
    sinks.write_json({"label": "b", "origin": "upload", "generated_at": "2"}, str(tmp_path / "b.json"))
    sinks.write_json({"label": "s", "generated_at": "1"}, str(tmp_path / "s.json"))
    (tmp_path / "broken.json").write_text("{")
    found = ledger.report_catalog(str(tmp_path))
    assert [x["report"]["label"] for x in found] == ["s", "b"] and ledger.newest(found)["report"]["label"] == "b"
    assert ledger.read_json(str(tmp_path / "none.json")) is None
    with pytest.raises(PermissionError):
        sinks.write_json({}, str(tmp_path / "data/raw/x.json"))
    assert sinks.save_upload(str(tmp_path), "../a.pdf", b"1")[1] == "saved" and sinks.save_upload(str(tmp_path), "a.pdf", b"2")[1] == "replaced"
    assert sinks.save_upload(str(tmp_path), "a.pdf", b"3", frozenset({"a.pdf"})) == (str(tmp_path / "a_2.pdf"), "saved_alongside")


def test_ledger_report(spark, tmp_path):
    legs = ledger.synthetic(spark, 300).withColumns({"leg_num": F.lit(1), "dr_cr": F.col("entry_type"), "vch_type": F.lit("Journal"), "vch_no": F.regexp_extract("entry_id", r"(\d+)", 1), "row_idx": F.monotonically_increasing_id(), "amount": F.col("amount").cast("decimal(18,2)")})
    report, tables = pipelines.ledger_report(legs, "FY")
    assert report["summary"]["total_legs_flagged"] == sum(report["summary"]["by_severity"].values()) > 0
    json.dumps(report, default=str)
    path = sinks.write_csv(tables["leg_flags"], str(tmp_path), "leg_flags", "FY 25")
    assert path.endswith("leg_flags_FY_25") and spark.read.csv(path, header=True).count() == report["summary"]["total_legs_flagged"]
    planted = {r.entry_id for r in legs.where("is_planted_issue = 'same_approver'").collect()}
    flagged = {r.entry_id for r in tables["leg_flags"].collect() if any(x.rule == "segregation_of_duties" for x in r.reasons)}
    assert planted <= flagged


def test_steps_and_jobs():
    def gone():
        raise FileNotFoundError("x")

    out = pipelines.run_steps([("a", lambda: 1), ("b", gone), ("c", lambda: 1 / 0), ("d", lambda: 2)])
    assert [v["status"] for v in out.values()] == ["ok", "skipped", "failed", "ok"]
    jobs, hold = pipelines.Jobs(), threading.Event()
    first = jobs.submit("x", "1", hold.wait)
    a, b = jobs.submit("scan", "k", lambda: 5), jobs.submit("scan", "k", lambda: 6)
    assert a == b != first
    hold.set()
    assert jobs.wait(a)["result"] == 5
    assert pipelines.confidence({"vouchers": 5, "legs": 10, "unresolved": 2, "unbalanced": 1})[0] == "low"
    assert pipelines.confidence({"vouchers": 500, "legs": 1000, "unresolved": 2, "unbalanced": 1}) == ("ok", [])


def test_scan(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.pdf").write_bytes(b"%PDF" + n.encode())
    files = scan.listing(spark, str(tmp_path))
    cache = files.where(F.col("path").endswith("a.pdf")).withColumn("doctype", F.lit("ledger"))
    assert scan.pending(files, cache).count() == 1 and scan.with_cache(files, cache).where("doctype is null").count() == 1 and scan.pruned(cache, files).count() == 1


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "2024-01-01 0%d:10:00" % (i % 3), "click", 1.0) for i in range(9)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.new_files(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double")
    ingest.into_table(ingest.distinct_once(stream, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    assert {r.n for r in ingest.rolled_up(spark.read.parquet(str(tmp_path / "out"))).collect()} == {3}


def test_page_accounts(spark):
    from quillstone.operators import reconstruct as C

    rows = [("d", 1, None, None, 10.0), ("d", 2, "Cash", 10.0, 20.0), ("d", 3, "Cash A/c", 20.0, 30.0), ("d", 4, None, None, 99.0), ("d", 5, "Bank", 30.0, None)]
    pages = spark.createDataFrame(rows, "doc string, page int, account string, brought double, carried double")
    assert [r.account for r in C.headed_pages(pages).orderBy("page").collect()] == ["Cash", "Cash", "Cash A/c", None, "Bank"]
    assert [tuple(r) for r in C.continuations(pages.where("account is not null")).collect()] == [("Cash A/c", "Cash")]
    chain = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a")], "later string, earlier string")
    assert {tuple(r) for r in C.settled(chain).collect()} == {("d", "a"), ("c", "a"), ("b", "a")}


def test_leg_merging(spark):
    from quillstone.operators import reconstruct as C

    legs = spark.createDataFrame([("v", "Hdfc", "Dr", 5.0, [1]), ("v", "Hdfc Bank", "Dr", 5.0, [2]), ("w", "Hdfc", "Dr", 5.0, [2]), ("w", "Hdfc Bank", "Dr", 5.0, [2]), ("x", "[redacted]", "Cr", 7.0, [3])], "entry_id string, particulars string, dr_cr string, amount double, source_pages array<int>")
    got = C.merge_aliases(legs, spark.createDataFrame([("Hdfc", "Hdfc Bank")], "short string, full string"))
    assert sorted((r.entry_id, r.particulars, tuple(r.source_pages)) for r in got.collect()) == [("v", "Hdfc Bank", (1, 2)), ("w", "Hdfc", (2,)), ("w", "Hdfc Bank", (2,)), ("x", "[redacted]", (3,))]
    loose = spark.createDataFrame([("x", "Cr", 7.0, 9), ("w", "Dr", 5.0, 9), ("z", "Dr", 1.0, 9)], "entry_id string, dr_cr string, amount double, page int")
    out, left = C.absorb(legs, loose, F.lit(True))
    assert sorted(r.entry_id for r in left.collect()) == ["w", "z"] and out.where("entry_id = 'x'").first().source_pages == [3, 9]
