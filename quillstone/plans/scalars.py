"""Projections and filters over the driver tables (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.plans.registry import query
from quillstone.sources.views import FY, PERCENT, SEVERITY, table

_NUM = "CASE l_linenumber % 5 WHEN 0 THEN '(' || {p} || ')' WHEN 1 THEN {p} || '-' WHEN 2 THEN '-' || {p} WHEN 3 THEN '-' ELSE {p} END"


@query("c01_ledger_projection", "SELECT 'SO_' || l_orderkey AS entry_id, CAST(l_shipdate AS DATE) AS date, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, CASE WHEN l_linestatus = 'O' THEN 'Dr' ELSE 'Cr' END AS entry_type, '' AS vendor FROM lineitem")
def c01(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("SO_"), F.col("l_orderkey").cast("string")).alias("entry_id"), F.col("l_shipdate").cast("date").alias("date"), F.coalesce(F.col("l_extendedprice").cast("string").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).cast("double").alias("amount"), F.when(F.col("l_linestatus") == "O", "Dr").otherwise("Cr").alias("entry_type"), F.lit("").alias("vendor"))


@query("c02_indian_number", """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE l_linenumber % 5 WHEN 3 THEN NULL WHEN 4 THEN CAST(p AS DOUBLE) ELSE -CAST(p AS DOUBLE) END AS DOUBLE) AS value FROM t""")
def c02(spark, d):
    p = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    k = F.col("l_linenumber") % 5
    text = F.when(k == 0, F.concat(F.lit("("), p, F.lit(")"))).when(k == 1, F.concat(p, F.lit("-"))).when(k == 2, F.concat(F.lit("-"), p)).when(k == 3, "-").otherwise(p)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.indian_number(text).alias("value"))


@query("c04_normalize_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso FROM orders")
def c04(spark, d):
    k = F.col("o_orderkey") % 3
    day = F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "d-MMM-yyyy")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", X.any_date(text).alias("iso"))


@query("c06_fy_period", f"SELECT o_orderkey, {FY.format('o_orderdate')} AS fy, strftime(o_orderdate, '%B') AS period FROM orders")
def c06(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.fiscal_year("o_orderdate").alias("fy"), X.month_name("o_orderdate").alias("period"))


@query("c07_period_ordinal", "SELECT o_orderkey, CAST(year(o_orderdate - INTERVAL 3 MONTH) * 12 + (month(o_orderdate) + 8) % 12 AS INTEGER) AS period_ord FROM orders")
def c07(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.period_ordinal("o_orderdate").cast("int").alias("period_ord"))


@query("c09_range_label", """WITH r AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY o_custkey)
SELECT o_custkey, strftime(lo, '%d %b %Y') || ' to ' || strftime(hi, '%d %b %Y') AS label FROM r""")
def c09(spark, d):
    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("lo"), F.max(F.col("o_orderdate").cast("date")).alias("hi"))
    return r.select("o_custkey", X.range_label("lo", "hi").alias("label"))


@query("c10_first_digit", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(nullif(regexp_extract(CAST(l_extendedprice AS VARCHAR), '[1-9]', 0), '') AS INTEGER) AS digit FROM lineitem")
def c10(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.first_digit("l_extendedprice").alias("digit"))


@query("c11_round_number", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE (l_quantity * 1000) % 10000 = 0")
def c11(spark, d):
    return table(spark, d, "lineitem").where(X.is_round(F.col("l_quantity") * 1000)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("c12_amount_severity", f"SELECT l_orderkey, l_linenumber, l_partkey, {SEVERITY.format('l_extendedprice * 20')} AS severity FROM lineitem")
def c12(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.amount_severity(F.col("l_extendedprice") * 20).alias("severity"))


@query("c13_escalate", f"""WITH t AS (SELECT o_orderkey, {SEVERITY.format('o_totalprice')} AS sev FROM orders)
SELECT o_orderkey, CASE sev WHEN 'LOW' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM t""")
def c13(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.escalate(X.amount_severity("o_totalprice")).alias("severity"))


@query("c14_max_severity", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice >= 1000000 THEN 'CRITICAL' ELSE 'HIGH' END ELSE {SEVERITY.format('o_totalprice')} END AS severity FROM orders""")
def c14(spark, d):
    sevs = F.array(X.amount_severity("o_totalprice"), F.when(F.col("o_orderstatus") == "F", "HIGH").otherwise("LOW"))
    return table(spark, d, "orders").select("o_orderkey", X.worst(sevs).alias("severity"))


@query("c15_pct_severity", f"SELECT l_orderkey, l_linenumber, l_partkey, {PERCENT.format('(l_extendedprice * l_discount)', '(l_extendedprice * l_tax)')} AS severity FROM lineitem")
def c15(spark, d):
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.percent_severity(p * F.col("l_discount"), p * F.col("l_tax")).alias("severity"))


@query("c16_gap_severity", "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 10 THEN 'HIGH' WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM orders GROUP BY o_custkey")
def c16(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("severity", X.gap_severity("n"))


@query("c18_mad_band", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount / 5 < 0.006 THEN 'Close conformity' WHEN l_discount / 5 < 0.012 THEN 'Acceptable conformity' WHEN l_discount / 5 < 0.015 THEN 'Marginally acceptable' ELSE 'Nonconformity' END AS band FROM lineitem")
def c18(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.mad_band(F.col("l_discount") / 5).alias("band"))


_ACCOUNT = "CASE p_partkey % 6 WHEN 0 THEN 'Output CGST ' || p_brand WHEN 1 THEN 'SGST @9%' WHEN 2 THEN 'Integrated Tax' WHEN 3 THEN 'Input CGST' WHEN 4 THEN 'Rounding Off' ELSE p_name END"


def _account():
    k = F.col("p_partkey") % 6
    return F.when(k == 0, F.concat(F.lit("Output CGST "), F.col("p_brand"))).when(k == 1, "SGST @9%").when(k == 2, "Integrated Tax").when(k == 3, "Input CGST").when(k == 4, "Rounding Off").otherwise(F.col("p_name"))


@query("c19_tax_head", f"""WITH t AS (SELECT p_partkey, {_ACCOUNT} AS a FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(a, '{X.NOT_OUTPUT_TAX}') THEN NULL WHEN regexp_matches(a, '{X.CGST}') THEN 'cgst' WHEN regexp_matches(a, '{X.SGST}') THEN 'sgst' WHEN regexp_matches(a, '{X.IGST}') THEN 'igst' END AS head FROM t""")
def c19(spark, d):
    return table(spark, d, "part").select("p_partkey", X.tax_head(_account()).alias("head"))


@query("c20_rounding_account", f"SELECT p_partkey FROM part WHERE regexp_matches({_ACCOUNT}, '{X.ROUNDING}')")
def c20(spark, d):
    return table(spark, d, "part").where(X.is_rounding_account(_account())).select("p_partkey")


_TYPE = "CASE o_orderkey % 5 WHEN 0 THEN 'Sales GST' WHEN 1 THEN 'Debit Note' WHEN 2 THEN 'Journal' WHEN 3 THEN 'Purchase Sale' ELSE 'Receipt' END"


@query("c21_sales_type", f"""WITH t AS (SELECT o_orderkey, {_TYPE} AS v FROM orders)
SELECT o_orderkey, contains(lower(v), 'sale') AND NOT regexp_matches(v, '{X.NON_SALES}') AS is_sale, NOT regexp_matches(v, '{X.NON_SALES}') AS counts FROM t""")
def c21(spark, d):
    k = F.col("o_orderkey") % 5
    v = F.when(k == 0, "Sales GST").when(k == 1, "Debit Note").when(k == 2, "Journal").when(k == 3, "Purchase Sale").otherwise("Receipt")
    return table(spark, d, "orders").select("o_orderkey", X.is_sales_type(v).alias("is_sale"), X.counts_as_sale(v).alias("counts"))


@query("c22_split_voucher_no", """SELECT o_orderkey, o_orderstatus || '/24-25/' AS prefix, o_orderkey AS number FROM orders""")
def c22(spark, d):
    no = F.concat(F.col("o_orderstatus"), F.lit("/24-25/"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", X.voucher_prefix(no).alias("prefix"), X.voucher_number(no).cast("long").alias("number"))


@query("c23_direction_day", "SELECT o_orderkey, o_orderstatus = 'O' AS debit, CAST(day(o_orderdate) AS DOUBLE) AS day FROM orders")
def c23(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MMM-yy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", X.is_debit(F.when(F.col("o_orderstatus") == "O", "Debit").otherwise("Cr")).alias("debit"), X.day_of_month(text).alias("day"))


@query("c24_invoice_rounding", f"SELECT p_partkey FROM part WHERE regexp_matches({_ACCOUNT}, '{X.ROUNDING}') AND abs(p_retailprice / 1500) < 1")
def c24(spark, d):
    return table(spark, d, "part").where(X.invoice_rounding(_account(), F.col("p_retailprice") / 1500)).select("p_partkey")


@query("c32_line_parse", """WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'parsed' WHEN 1 THEN 'period_marker' WHEN 2 THEN 'unparsed' ELSE 'empty' END AS status, CASE k WHEN 0 THEN CAST(p AS DOUBLE) END AS amount, CASE k WHEN 0 THEN 'Dr' END AS direction,
  CASE k WHEN 0 THEN 'Paid cash' WHEN 1 THEN 'April 2024' WHEN 2 THEN 'no amount' ELSE '' END AS particulars FROM t""")
def c32(spark, d):
    k = F.col("o_orderkey") % 4
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    t = F.when(k == 0, F.concat(F.lit("Paid Rs. "), p, F.lit(" dr cash"))).when(k == 1, " April 2024 ").when(k == 2, "no amount").otherwise("  ")
    return table(spark, d, "orders").select("o_orderkey", X.parsed_line(t).alias("x")).select("o_orderkey", "x.status", "x.amount", "x.direction", "x.particulars")


@query("c33_display_rewrite", "SELECT o_orderkey, 'same as SO_' || o_custkey || ' on date; round amount' AS why FROM orders")
def c33(spark, d):
    one = F.concat(F.lit("matches voucher(s) SO_"), F.col("o_custkey").cast("string"), F.lit(" on date (leg 3)"))
    return table(spark, d, "orders").select("o_orderkey", X.plain_why(F.concat(one, F.lit("; round amount; "), one)).alias("why"))


@query("b09_csv_sanitise", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name ELSE p_name END AS cell FROM part")
def b09(spark, d):
    return table(spark, d, "part").select("p_partkey", X.csv_safe(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), F.col("p_name"))).otherwise(F.col("p_name"))).alias("cell"))


@query("c35_slug", "SELECT s_suppkey, regexp_replace(s_name || ' & Co.', '[^A-Za-z0-9._-]+', '_', 'g') AS slug FROM supplier")
def c35(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.slug(F.concat(F.col("s_name"), F.lit(" & Co."))).alias("slug"))
