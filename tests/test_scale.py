"""Plans whose tasks must not grow with one key, and steps that large ledgers once made slow."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import anomaly, reconstruct
from quillstone.operators import rules as R
from quillstone.plans import registry
from quillstone.sources import views

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Queries over all leg flags.
CONVERGED = ["g12_convergence", "e16_severity_counts", "e17_summary", "e24_leg_severity", "e25_voucher_severity", "e26_priority_findings", "e27_concentration", "f06_report_order", "f07_lexical_order", "b01_flag_export"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made_legs(spark, n=400):
    i = F.col("id")
    return spark.range(n).select(
        F.format_string("V%03d", (i / 3).cast("int")).alias("entry_id"), (i % 3 + 1).cast("int").alias("leg_num"), F.lit(dt.date(2024, 4, 1)).alias("date"), F.concat(F.lit("A"), (i % 7).cast("string")).alias("account"),
        (i % 11 * 1000 + 1).cast("decimal(18,2)").alias("amount"), F.lit("Dr").alias("dr_cr"), F.when(i % 10 == 0, "Payment").otherwise("Sales").alias("vch_type"),
    )


def test_few_voucher_types_do_not_deal_the_legs(spark):
    """Dealt by their type, a common type's legs all go to one task."""
    f = anomaly.features(made_legs(spark))
    assert "SortMergeJoin [vch_type" not in plan(f) and "BroadcastHashJoin [vch_type" in plan(f)
    assert {(r.vch_type, round(1 / r.vch_type_rarity)) for r in f.select("vch_type", "vch_type_rarity").distinct().collect()} == {("Sales", 360), ("Payment", 40)}


@needs_tables
@pytest.mark.parametrize("name", [*CONVERGED, "f12_first_amount_wins"])
def test_legs_are_not_dealt_again_by_voucher_id(spark, name):
    """Legs are put together by the voucher's number; dealing and grouping them by its id as well costs as much again."""
    assert "hashpartitioning(entry_id" not in plan(registry.QUERIES[name](spark, SF))


@needs_tables
@pytest.mark.parametrize("name", ["e16_severity_counts", "e25_voucher_severity", "e27_concentration", "f07_lexical_order"])
def test_counts_make_no_reasons(spark, name):
    assert "matches voucher" not in plan(registry.QUERIES[name](spark, SF))


@needs_tables
def test_large_joins_are_dealt_by_size(spark, monkeypatch):
    """A task of a join holds so many bytes of the files, however few partitions the session has."""
    li, o = (views.table(spark, SF, t) for t in ("lineitem", "orders"))
    assert views.dealt(li, o, "l_orderkey", "o_orderkey") == (li, o)
    want = sorted(map(tuple, registry.QUERIES["f12_first_amount_wins"](spark, SF).collect()))
    monkeypatch.setattr(views, "TASK_BYTES", 10_000)
    left, right = views.dealt(li, o, "l_orderkey", "o_orderkey")
    assert left.rdd.getNumPartitions() == right.rdd.getNumPartitions() >= 10
    assert sorted(map(tuple, registry.QUERIES["f12_first_amount_wins"](spark, SF).collect())) == want


@pytest.fixture(scope="module")
def marked(spark):
    """Keys of one, two and many vouchers, several legs of a voucher under one key, rounding, nulls in keys and persons."""
    day = [dt.date(2024, 4, 1), dt.date(2024, 4, 2), None]
    rows = []
    for v in range(60):
        for leg in range(1, 4):
            k = (v * 3 + leg) % 7
            account = ["Rent Expense", "Cash", "Round Off", None, "", "Sales", "Bank"][k]
            amount = [10_000, 150_000, 0, 7, 20_000, 1_000_000 + v % 40, None][(v + leg) % 7 if leg < 3 else k]
            rows.append((f"V{v:02d}", leg, day[k % 3], account, amount, "Dr" if k % 2 else "Cr", ["U1", " U1 ", "", None][v % 4], ["U1", "U2", ""][leg - 1]))
    rows += [(f"W{v}", leg, day[0], "Fees", 77, "Dr", None, None) for v in (1, 2) for leg in (1, 2)]
    return spark.createDataFrame(rows, "entry_id string, leg_num int, date date, account string, amount int, dr_cr string, entered_by string, approved_by string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def test_rules_together_as_one_by_one(spark, marked):
    """converge_rules against converge over the three rules, and vouchers of a key counted by hand."""
    keys = [F.col("date"), F.col("account"), F.col("dr_cr"), F.col("amount")]
    cols = ["entry_id", "leg_num", "date", "account", "amount", "reasons", "signal_count", "severity"]
    one = R.converge(marked, [R.segregation(marked), R.round_amounts(marked), R.duplicates(marked, keys)]).select(cols)
    got = R.converge_rules(marked, keys).select(cols)
    rows = lambda df: sorted(df.collect(), key=lambda r: (r.entry_id, r.leg_num))
    assert rows(got) == rows(one) and {r.signal_count for r in got.collect()} == {1, 2, 3}
    plain = R.converge_rules(marked, keys, told=False)
    assert "reasons" not in plain.columns and [r.severity for r in rows(plain)] == [r.severity for r in rows(one)]
    held = {}
    for r in marked.collect():
        if not (r.account == "Round Off" and r.amount is not None and abs(r.amount) < 1):
            held.setdefault((r.date, r.account or "", r.dr_cr, r.amount), set()).add((r.entry_id))
    dup = {(r.entry_id, r.leg_num): r.vouchers for r in R.duplicates(marked, keys).collect()}
    want = {(r.entry_id, r.leg_num): len(v) for r in marked.collect() if len(v := held.get((r.date, r.account or "", r.dr_cr, r.amount), ())) > 1 and not (r.account == "Round Off" and r.amount is not None and abs(r.amount) < 1)}
    assert dup == want and {2} < set(want.values())


@needs_tables
def test_pages_are_parsed_once_and_in_batches(spark):
    p = plan(registry.QUERIES["h10_state_machine"](spark, SF))
    assert p.count("MapInArrow") == 1 and "InPandas" not in p


def test_headed_pages_read_their_document_once(spark):
    """A frame up to the last page costs the square of a document's pages."""
    n = 3000
    pages = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"), F.when(F.col("id") % 1000 == 999, F.concat(F.lit("A"), F.col("id").cast("string"))).alias("account"), F.lit(5).cast("decimal(18,2)").alias("brought"), F.when(F.col("id") % 2 == 0, 5).cast("decimal(18,2)").alias("carried"))
    out = reconstruct.headed_pages(pages)
    assert "unboundedfollowing" not in plan(out).lower()
    got = {r.page: r.account for r in out.collect()}
    assert got == {i: f"A{i // 1000 * 1000 + 999}" if i % 2 == 0 or i % 1000 == 999 else None for i in range(n)}


def test_pages_that_batches_cut(spark):
    """Pages over several batches, with and without a told account and first line; one that nothing is told of."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        lines = [("d", p, i, t) for p in range(9) for i, t in enumerate(["Title", "2-Apr-24 By Journal %d 10.00" % p, *(["Cash 10.00 Dr"] * p)])]
        df = spark.createDataFrame(lines, "doc string, page int, line_no long, text string")
        told = spark.createDataFrame([("d", p, f"Book {p}", 1) for p in range(8)], "doc string, page int, account string, body_from int")
        plain = [(r.page, r.particulars, r.kind) for r in reconstruct.occurrences(df).orderBy("page", "line_no").collect()]
        assert plain == [(p, name, "leg") for p in range(9) for name in ["Title", *["Cash"] * p]]
        known = [(r.page, r.particulars, r.kind) for r in reconstruct.occurrences(df, told).orderBy("page", "line_no").collect()]
        assert known == [(p, name, "leg") for p in range(8) for name in [f"Book {p}", *["Cash"] * p]] + [(8, None, "unresolved"), (8, "(page account)", "leg"), *[(8, "Cash", "leg")] * 8]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
