"""Places where a query or an operator once did less than the whole job."""

import datetime as dt
import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.operators import pipelines, sinks
from quillstone.operators import rules as R
from quillstone.plans import registry

from .test_oracles import normal

KEYS = [7, 9, 99_998, 100_003, 1_000_000, 1_000_004, 1_350_000, 12_345_678, 12_345_680]


@pytest.mark.parametrize("name", ["g07_voucher_gaps", "e15_gap_series"])
def test_gaps_of_long_numbers(spark, tmp_path, name):
    """Order keys of seven digits and more, gaps across and wider than a range, a series of two numbers."""
    status = ["O"] * 5 + ["F"] * 2 + ["P"] * 2
    keys = KEYS[:7] + [2_000_000, 2_000_003]
    orders = pd.DataFrame({"o_orderkey": keys, "o_orderstatus": status, "o_orderdate": [dt.date(1995, 1, 1)] * len(keys)})
    con = duckdb.connect()
    for t, df in (("orders", orders), ("lineitem", pd.DataFrame({"l_orderkey": keys}))):
        df.to_parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(registry.SQL[name]).df()
    assert len(want) > 0 and normal(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(want)


def test_gaps_across_ranges(spark):
    df = spark.createDataFrame([(n, f"e{n}", dt.date(2024, 4, 1), "J", i) for i, n in enumerate(KEYS)], "number long, entry_id string, date date, vch_type string, row_idx long")
    got = R.sequence_gaps(df, ["vch_type"], cfg=R.Config(gap_digits=None)).groupBy("before", "before_id", "after", "after_id").agg(F.count("*").alias("n"), F.min("missing").alias("lo"), F.max("missing").alias("hi")).orderBy("before").collect()
    assert [tuple(r) for r in got] == [(a, f"e{a}", b, f"e{b}", b - a - 1, a + 1, b - 1) for a, b in zip(KEYS, KEYS[1:], strict=False) if b - a > 1]


def test_invoice_rounding_repeats(spark):
    """FIXTURES 1b, and rows without account or amount, which the exclusion must not drop."""
    twice = [("Round Off/Discount", 0.2), ("Round Off/Discount", 6000.0), ("Bank Charges", 0.5), *((n, 0.3) for n in ("Rounding Off", "Round off", "Rounded Off", "ROUNDING")), (None, 0.2), ("Round Off", None), ("Round Off", -1.0)]
    rows = [(f"e{2 * i + k}", 1, dt.date(2024, 4, 1), a, x, "Dr") for i, (a, x) in enumerate(twice) for k in (0, 1)]
    df = spark.createDataFrame(rows, "entry_id string, leg_num int, date date, account string, amount double, dr_cr string")
    got = {r.entry_id for r in R.duplicates(df, [F.col("date"), F.col("account"), F.col("amount"), F.col("dr_cr")]).collect()}
    assert got == {"e2", "e3", "e4", "e5", "e14", "e15", "e16", "e17", "e18", "e19"}


def test_report_holds_all_flags(spark, tmp_path):
    n = F.col("id")
    legs = spark.range(1142).select(F.format_string("JV_%d", n).alias("entry_id"), F.lit(1).alias("leg_num"), F.lit(dt.date(2024, 4, 1)).alias("date"), F.lit("Fees").alias("account"), (n * 17 + 10_001).cast("decimal(18,2)").alias("amount"), F.lit("Dr").alias("dr_cr"), F.lit("U1").alias("entered_by"), F.lit("U1").alias("approved_by"), F.lit("Journal").alias("vch_type"), n.cast("string").alias("vch_no"))
    report, _ = pipelines.ledger_report(legs, "FY")
    sinks.write_json(report, str(tmp_path / "report.json"))
    got = json.loads((tmp_path / "report.json").read_text())
    flags = got["ledger_leg_flags"]
    assert len(flags) == got["summary"]["total_legs_flagged"] == 1142 and len({f["entry_id"] for f in flags}) == 1142
    assert [f["signal_count"] for f in flags] == sorted((f["signal_count"] for f in flags), reverse=True) and flags[0]["reasons"][0]["rule"]
