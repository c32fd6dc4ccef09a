"""Cleaning, extraction, pairing, reports and sinks over the driver tables (A, B, C, D, E, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.operators import cleaning, filings
from quillstone.plans.registry import query
from quillstone.operators import rules as R
from quillstone.plans.aggregates import EXCLUSIONS, exclusions
from quillstone.plans.rules import CONVERGED, G5_CTE, benford_sql, converged
from quillstone.sources.views import LEGS, ledger_legs, table

D2 = "decimal(18,2)"
_P = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"


@query("c03_plain_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END::DOUBLE AS amount FROM orders")
def c03(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, "-").otherwise(F.format_number(F.col("o_totalprice").cast(D2), 2))
    return table(spark, d, "orders").select("o_orderkey", X.plain_amount(text).alias("amount"))


@query("c05_parse_dmy", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= DATE '2000-01-01'")
def c05(spark, d):
    o = table(spark, d, "orders").where("o_orderdate >= '2000-01-01'")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d-MMM-yy")).otherwise(F.date_format("o_orderdate", "d-MMM-yyyy"))
    return o.select("o_orderkey", X.any_date(text).alias("day"))


@query("c08_period_label", "SELECT o_orderkey, strftime(o_orderdate, '%B') || ' ' || (year(o_orderdate - INTERVAL 3 MONTH) || '-' || lpad(CAST((year(o_orderdate - INTERVAL 3 MONTH) + 1) % 100 AS VARCHAR), 2, '0')) AS label FROM orders")
def c08(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", X.month_name("o_orderdate"), X.fiscal_year("o_orderdate")).alias("label"))


@query("c17_rank_severity", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <= 0.01 THEN 'high' WHEN l_discount <= 0.03 THEN 'medium' WHEN l_discount <= 0.05 THEN 'low' END AS band FROM lineitem")
def c17(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.rank_severity("l_discount").alias("band"))


@query("c28_row_predicates", "SELECT o_orderkey, o_orderkey % 3 = 0 AS separator, o_orderkey % 3 = 1 AS page_marker FROM orders")
def c28(spark, d):
    k = F.col("o_orderkey") % 3
    line = F.when(k == 0, "-----=====").when(k == 1, "see Page 12").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", cleaning.is_separator(line).alias("separator"), cleaning.is_page_marker(line).alias("page_marker"))


@query("c29_clean_table", "SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 7 <> 0")
def c29(spark, d):
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select("c_custkey", F.when(k % 7 == 0, "Page 3").otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias("name"), F.when(k % 7 == 0, None).when(k % 5 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("segment"))
    return cleaning.clean(raw)


@query("c30_quality_score", "SELECT round(count(CASE WHEN c_custkey % 5 <> 0 THEN 1 END) * 1.0 / (2 * count(*)) + 0.5, 9)::DOUBLE AS score FROM customer")
def c30(spark, d):
    t = table(spark, d, "customer").select("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))
    return cleaning.quality(t).select(F.round(F.col("score").cast("double"), 9).alias("score"))


@query("c31_split_pipes", "SELECT s_suppkey, CAST(3 AS INTEGER) AS width, trim(s_name) AS first FROM supplier")
def c31(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.array(F.concat("s_name", F.lit(" | x | y")))).otherwise(F.array(F.col("s_name"))).alias("cells"))
    return cleaning.split_pipes(rows).select("s_suppkey", F.size("cells").alias("width"), F.trim(F.col("cells")[0]).alias("first"))


@query("c34_reason_parts", "SELECT o_orderkey, CAST(o_orderkey % 9 AS INTEGER) AS leg, 'SO_' || o_custkey AS related FROM orders")
def c34(spark, d):
    reason = F.format_string("matches voucher(s) SO_%d on 2024-04-01 (leg %d)", "o_custkey", F.col("o_orderkey") % 9)
    return table(spark, d, "orders").select("o_orderkey", F.regexp_extract(reason, r"\(leg (\d+)\)$", 1).cast("int").alias("leg"), F.regexp_extract(reason, r"matches voucher\(s\) (.+?) on ", 1).alias("related"))


@query("d10_center_columns", "SELECT p_partkey, CAST(CASE WHEN p_size + 5 < 20 THEN 0 WHEN p_size + 5 < 40 THEN 1 ELSE 2 END AS INTEGER) AS col FROM part")
def d10(spark, d):
    bounds = F.array(F.lit(20.0), F.lit(40.0))
    centre = F.col("p_size") + 5
    return table(spark, d, "part").select("p_partkey", F.size(F.filter(bounds, lambda b: centre >= b)).alias("col"))


@query("e28_segment_verdict", f"""WITH {benford_sql('lineitem JOIN orders ON l_orderkey = o_orderkey', 'l_extendedprice', 'o_orderstatus', 'TRUE', 'ty')}, {benford_sql('lineitem', 'l_extendedprice', 'l_suppkey', 'TRUE', 'ac')}, {EXCLUSIONS}
SELECT (SELECT count(*) FROM ty WHERE n >= 10) AS substantial, (SELECT count(*) FROM ty WHERE n >= 10 AND deviates) AS deviating, (SELECT count(*) FROM ac WHERE n >= 10) AS account_substantial, (SELECT count(*) FROM ac WHERE n >= 10 AND deviates) AS account_deviating,
  (SELECT deviates FROM xa) AND (SELECT deviates FROM xt) AS both_exclusions_deviate, (SELECT string_agg(o_orderstatus, ' and ' ORDER BY chi_square DESC, o_orderstatus) FROM (SELECT * FROM ty ORDER BY chi_square DESC, o_orderstatus LIMIT 2)) AS outliers""")
def e28(spark, d):
    """Whether deviation is broad: segments of ten legs or more that deviate, both runs with something left out, the two most extreme types."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    types = R.benford(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "l_extendedprice", ["o_orderstatus"])
    accounts = R.benford(li, "l_extendedprice", ["l_suppkey"])
    large = F.col("n") >= 10
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("chi_square")).alias("less"), "o_orderstatus"))), 1, 2)  # a row a voucher type
    a = types.agg(F.count_if(large).alias("substantial"), F.count_if(large & F.col("deviates")).alias("deviating"), F.array_join(F.transform(top, lambda x: x["o_orderstatus"]), " and ").alias("outliers"))
    b = accounts.agg(F.count_if(large).alias("account_substantial"), F.count_if(large & F.col("deviates")).alias("account_deviating"))
    c = exclusions(spark, d).agg(F.min("deviates").alias("both_exclusions_deviate"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).select("substantial", "deviating", "account_substantial", "account_deviating", "both_exclusions_deviate", "outliers")  # one row each


@query("e31_reconstruction_stats", f"WITH {LEGS} SELECT count(DISTINCT entry_id) AS vouchers, count(*) AS legs, min(date) AS first_date, max(date) AS last_date FROM legs WHERE vch_type <> 'Journal'")
def e31(spark, d):
    return ledger_legs(spark, d, numbered=False).where("vch_type <> 'Journal'").agg(F.count_distinct("entry_id").alias("vouchers"), F.count("*").alias("legs"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("e33_date_range", "SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders")
def e33(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))


@query("e37_work_split", "SELECT CASE WHEN l.doc_id IS NULL THEN 'needs action' ELSE 'processed' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def e37(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return j.groupBy(F.when(F.col("known"), "processed").otherwise("needs action").alias("status")).agg(F.count("*").alias("n"))


@query("h05_gstr3b_fields", f"SELECT o_orderkey, CAST({_P} AS DOUBLE) AS taxable, 10.0::DOUBLE AS cgst_payable, 6.5::DOUBLE AS cgst_paid FROM orders")
def h05(spark, d):
    p = F.col("o_totalprice").cast(D2).cast("string")
    row = lambda label: f"{label} 12.00 - 10.00 1.50 - 2.00 - 3.00\n"
    text = F.concat(F.lit("Year 2024-25\nPeriod April\nOutward taxable supplies (other than zero rated, nil rated and "), p, F.lit(" 1.00 2.00 3.00 4.00\nNon-GST outward supplies 5.00\n(A) Other than reverse charge\n" + row("Integrated") + row("Central") + row("State/UT") + "(B) Reverse charge"))
    good, _ = filings.gstr3b(table(spark, d, "orders").select("o_orderkey", text.alias("text")))
    return good.select("o_orderkey", F.col("taxable_value").cast("double").alias("taxable"), F.col("cgst_payable").cast("double").alias("cgst_payable"), F.col("cgst_paid_total").cast("double").alias("cgst_paid"))


@query("h07_deductors", "SELECT 'ABCD' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || 'E' AS tan, s_name AS deductor_name, 30.25::DOUBLE AS tds FROM supplier WHERE s_suppkey > 0")
def h07(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey > 0")
    row = F.format_string("%d %s ABCD%05dE 100.00 40.00 30.25", F.col("s_suppkey"), F.col("s_name"), F.col("s_suppkey"))
    lines = s.select(F.col("s_suppkey").alias("doc"), F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("PART-I - Details").alias("t")), F.struct(F.lit(2).alias("n"), row.alias("t")), F.struct(F.lit(3).alias("n"), F.lit("PART-II - Other").alias("t")), F.struct(F.lit(4).alias("n"), row.alias("t")))).alias("x"))
    got = filings.deductors_26as(lines.select("doc", F.col("x.n").alias("line_no"), F.col("x.t").alias("text")))
    return got.select("tan", "deductor_name", F.col("tds_reported_by_deductor").cast("double").alias("tds"))


@query("h12_fused_headers", "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0")
def h12(spark, d):
    text = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("To Cash Journal"), F.col("o_orderkey").cast("string"), F.lit(" 10.00"))).otherwise("To Cash Journal 7 10.00")
    return filings.fused_headers(table(spark, d, "orders").select("o_orderkey", text.alias("text"))).select("o_orderkey")


@query("h13_unparsed_sample", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 2 ORDER BY o_orderkey LIMIT 20")
def h13(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 2, "no amount").otherwise("Rs. 10.00 dr")
    return table(spark, d, "orders").where(X.line_status(text) == "unparsed").select("o_orderkey").orderBy("o_orderkey").limit(20)


@query("d07_tax_sources", "SELECT o_custkey, max_by(o_orderkey, o_orderdate) AS newest FROM (SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) GROUP BY 1")
def d07b(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return cleaning.newest_first(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("newest"))


@query("b01_flag_export", f"WITH {LEGS}, {G5_CTE}, {CONVERGED} SELECT entry_id, leg_num, severity, rules FROM conv")
def b01(spark, d):
    from quillstone.operators.sinks import flat

    f = converged(spark, d).withColumn("rules", F.transform("reasons", lambda x: x["rule"]))
    return flat(f, ["entry_id", "leg_num", "severity", "rules"])


@query("b10_final_columns", "SELECT c_custkey, c_name FROM customer")
def b10(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("blank"), F.lit(1).alias("__source_page"))
    return cleaning.final_columns(t)


@query("g12_sql_functions", "SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 1000000 THEN 'CRITICAL' WHEN abs(o_totalprice) >= 100000 THEN 'HIGH' WHEN abs(o_totalprice) >= 10000 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM orders")
def g12f(spark, d):
    X.register_sql(spark)
    return table(spark, d, "orders").select("o_orderkey", F.expr("amount_severity(o_totalprice)").alias("severity"))


@query("i01_ledger_report", f"WITH {LEGS} SELECT count(*) AS total_legs, (SELECT count(DISTINCT (entry_id, leg_num)) FROM legs WHERE entered_by = approved_by OR amount % 10000 = 0) AS flagged_without_duplicates FROM legs")
def i01(spark, d):
    legs = ledger_legs(spark, d)
    hit = R.segregation(legs).select("entry_id", "leg_num").union(R.round_amounts(legs).select("entry_id", "leg_num")).distinct().agg(F.count("*").alias("flagged_without_duplicates"))
    return legs.agg(F.count("*").alias("total_legs")).crossJoin(F.broadcast(hit))  # one row each


@query("a16_synthetic_ledger")
def a16(spark, d):
    from quillstone.sources.ledger import synthetic

    return synthetic(spark)


@query("s01_event_rollup", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s01(spark, d):
    """The streaming roll-up's plan over the events at rest."""
    from quillstone.streaming.ingest import rolled_up

    return rolled_up(table(spark, d, "events")).withColumn("total", F.round("total", 4))


