"""Aggregations (E) over the ledger view and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.operators import rules as R
from quillstone.plans.registry import query
from quillstone.plans.rules import CONVERGED, G5_CTE, benford_sql, converged
from quillstone.sources.views import FY, LEGS, ledger_legs, table

D2 = "decimal(18,2)"


@query("e01_benford_chi2", f"WITH {benford_sql('orders', 'o_totalprice')} SELECT n, chi_square, deviates FROM bf")
def e01(spark, d):
    return R.benford(table(spark, d, "orders"), "o_totalprice").drop("mad")


@query("e02_mad", f"WITH {benford_sql('orders', 'o_totalprice', 'o_orderstatus')} SELECT o_orderstatus, mad, CASE WHEN mad < 0.006 THEN 'Close' WHEN mad < 0.012 THEN 'Acceptable' WHEN mad < 0.015 THEN 'Marginal' ELSE 'Nonconformity' END AS band FROM bf")
def e02(spark, d):
    return R.benford(table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"]).select("o_orderstatus", "mad", X.mad_band("mad", short=True).alias("band"))


@query("e03_digit_table", """WITH dg AS (SELECT CAST(nullif(regexp_extract(CAST(l_extendedprice AS VARCHAR), '[1-9]', 0), '') AS INTEGER) AS digit FROM lineitem),
ex AS (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS digit, unnest([30.1, 17.6, 12.5, 9.7, 7.9, 6.7, 5.8, 5.1, 4.6])::DOUBLE AS expected)
SELECT ex.digit, expected, round(100.0 * count(dg.digit) / (SELECT count(digit) FROM dg), 6) AS actual FROM ex LEFT JOIN dg USING (digit) GROUP BY 1, 2""")
def e03(spark, d):
    expected = spark.createDataFrame(list(enumerate(X.BENFORD_PERCENT, 1)), "digit int, expected double")
    n = table(spark, d, "lineitem").select(X.first_digit("l_extendedprice").alias("digit")).where("digit is not null").groupBy("digit").count()
    total = n.agg(F.sum("count").alias("total"))
    return expected.join(n, "digit", "left").crossJoin(F.broadcast(total)).select("digit", "expected", F.round(100.0 * F.coalesce("count", F.lit(0)) / F.col("total"), 6).alias("actual"))


@query("e04_benford_segments", f"""WITH {benford_sql('lineitem JOIN supplier ON l_suppkey = s_suppkey', 'l_extendedprice', 's_name')}, t AS (SELECT *, round(100.0 * n / sum(n) OVER (), 6) AS pct_of_total FROM bf)
SELECT s_name, n, chi_square, mad, pct_of_total FROM t ORDER BY n DESC, s_name LIMIT 15""")
def e04(spark, d):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    # group by the key first; the name joins onto one row a supplier
    by = R.benford(li, "l_extendedprice", ["l_suppkey"])
    total = li.agg(F.count(X.first_digit("l_extendedprice")).alias("total"))
    named = by.join(s, by.l_suppkey == s.s_suppkey).crossJoin(F.broadcast(total))
    return named.select("s_name", "n", "chi_square", "mad", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct_of_total")).orderBy(F.col("n").desc(), "s_name").limit(15)


#: What the two further runs leave out: accounts and a voucher type.
EXCLUDED_ACCOUNTS, EXCLUDED_TYPE = (1, 2, 3), "P"
_ACCOUNTS_OUT = f"l_suppkey NOT IN {EXCLUDED_ACCOUNTS}"
_TYPES_OUT = f"o_orderstatus <> '{EXCLUDED_TYPE}'"
EXCLUSIONS = benford_sql("lineitem", "l_extendedprice", "", _ACCOUNTS_OUT, "xa") + ", " + benford_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", "l_extendedprice", "", _TYPES_OUT, "xt")


def exclusions(spark, d):
    """First digits once without some accounts and once without a voucher type."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    no_type = li.join(o.where(_TYPES_OUT).select("o_orderkey"), li.l_orderkey == F.col("o_orderkey"), "left_semi")
    runs = {"without accounts": li.where(_ACCOUNTS_OUT), "without types": no_type}
    parts = [R.benford(df, "l_extendedprice").select(F.lit(name).alias("run"), "n", "chi_square", "mad", "deviates") for name, df in runs.items()]
    return parts[0].unionByName(parts[1])


@query("e05_exclusion_rerun", f"WITH {EXCLUSIONS} SELECT 'without accounts' AS run, n, chi_square, mad, deviates FROM xa UNION ALL SELECT 'without types', n, chi_square, mad, deviates FROM xt")
def e05(spark, d):
    return exclusions(spark, d)


@query("e06_dedup_benford", f"WITH u AS (SELECT DISTINCT l_suppkey, round(l_extendedprice, 0) AS a FROM lineitem), {benford_sql('u', 'a')} SELECT n, chi_square, deviates FROM bf")
def e06(spark, d):
    u = table(spark, d, "lineitem").select("l_suppkey", F.round("l_extendedprice", 0).alias("a")).dropDuplicates()
    return R.benford(u, "a").drop("mad")


@query("e07_top_pairs", "SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15")
def e07(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l_suppkey", "l_quantity").limit(15)


@query("e08_digit_contribution", """WITH n AS (SELECT CAST(nullif(regexp_extract(CAST(l_extendedprice AS VARCHAR), '[1-9]', 0), '') AS INTEGER) AS digit, count(*) AS c FROM lineitem GROUP BY 1),
ex AS (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS digit, unnest([30.1, 17.6, 12.5, 9.7, 7.9, 6.7, 5.8, 5.1, 4.6])::DOUBLE / 100 AS p), t AS (SELECT sum(c) AS total FROM n WHERE digit IS NOT NULL),
x AS (SELECT ex.digit, power(coalesce(c, 0) - total * p, 2) / (total * p) AS k FROM ex LEFT JOIN n USING (digit), t)
SELECT digit, round(k, 6) AS contribution, k = (SELECT max(k) FROM x) AS largest FROM x""")
def e08(spark, d):
    n = table(spark, d, "lineitem").groupBy(X.first_digit("l_extendedprice").alias("digit")).agg(F.count("*").alias("c")).where("digit is not null")
    expected = spark.createDataFrame([(i, p / 100) for i, p in enumerate(X.BENFORD_PERCENT, 1)], "digit int, p double")
    x = expected.join(n, "digit", "left").crossJoin(F.broadcast(n.agg(F.sum("c").alias("total")))).select("digit", (F.pow(F.coalesce("c", F.lit(0)) - F.col("total") * F.col("p"), 2) / (F.col("total") * F.col("p"))).alias("k"))
    return x.crossJoin(F.broadcast(x.agg(F.max("k").alias("top")))).select("digit", F.round("k", 6).alias("contribution"), (F.col("k") == F.col("top")).alias("largest"))


@query("e09_dr_cr_pivot", f"WITH {LEGS} SELECT account, sum(amount) FILTER (WHERE dr_cr = 'Dr')::DOUBLE AS debit, sum(amount) FILTER (WHERE dr_cr = 'Cr')::DOUBLE AS credit FROM legs GROUP BY account")
def e09(spark, d):
    legs = ledger_legs(spark, d, numbered=False)
    return legs.groupBy("account").agg(*(F.sum(F.when(F.col("dr_cr") == k, F.col("amount"))).cast("double").alias(n) for k, n in (("Dr", "debit"), ("Cr", "credit"))))


_VOUCHER = """v AS (SELECT l_orderkey, max(l_tax) > 0.01 AS taxed, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS tax FROM lineitem GROUP BY l_orderkey)"""


def _vouchers(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    v = li.groupBy("l_orderkey").agg((F.max("l_tax") > 0.01).alias("taxed"), F.sum(F.col("l_extendedprice").cast(D2)).alias("value"), F.sum(F.col("l_extendedprice").cast(D2) * F.col("l_tax").cast("decimal(4,2)")).alias("tax"))
    return v.join(o, v.l_orderkey == o.o_orderkey).withColumns({"fy": X.fiscal_year("o_orderdate"), "period": X.month_name("o_orderdate")})


@query("e10_monthly_taxable", f"WITH {_VOUCHER} SELECT {FY.format('o_orderdate')} AS fy, strftime(o_orderdate, '%B') AS period, CAST(sum(value) AS DOUBLE) AS taxable, CAST(sum(tax) AS DOUBLE) AS tax FROM v JOIN orders ON l_orderkey = o_orderkey WHERE taxed AND o_orderstatus <> 'P' GROUP BY 1, 2")
def e10(spark, d):
    return _vouchers(spark, d).where("taxed and o_orderstatus <> 'P'").groupBy("fy", "period").agg(F.sum("value").cast("double").alias("taxable"), F.sum("tax").cast("double").alias("tax"))


@query("e11_monthly_non_gst", f"WITH {_VOUCHER} SELECT {FY.format('o_orderdate')} AS fy, strftime(o_orderdate, '%B') AS period, CAST(sum(value) AS DOUBLE) AS non_gst FROM v JOIN orders ON l_orderkey = o_orderkey WHERE NOT taxed AND o_orderstatus <> 'P' GROUP BY 1, 2")
def e11(spark, d):
    return _vouchers(spark, d).where("not taxed and o_orderstatus <> 'P'").groupBy("fy", "period").agg(F.sum("value").cast("double").alias("non_gst"))


@query("e12_revenue_accounts", f"WITH {LEGS} SELECT string_agg(DISTINCT account, '; ' ORDER BY account) AS accounts FROM legs WHERE dr_cr = 'Cr' AND vch_type = 'Sales'")
def e12(spark, d):
    legs = ledger_legs(spark, d, numbered=False).where("dr_cr = 'Cr' and vch_type = 'Sales'")
    return legs.select("account").distinct().agg(F.array_join(F.sort_array(F.collect_set("account")), "; ").alias("accounts"))


@query("e13_unreadable_dates", "SELECT count(DISTINCT o_orderkey) AS vouchers FROM orders WHERE o_orderkey % 7 = 0")
def e13(spark, d):
    text = F.when(F.col("o_orderkey") % 7 == 0, "not a date").otherwise(F.date_format("o_orderdate", "d-MMM-yyyy"))
    return table(spark, d, "orders").agg(F.count_distinct(F.when(X.any_date(text).isNull(), F.col("o_orderkey"))).alias("vouchers"))


@query("e14_span", "SELECT CAST(min(year(o_orderdate - INTERVAL 3 MONTH) * 12 + (month(o_orderdate) + 8) % 12) AS INTEGER) AS lo, CAST(max(year(o_orderdate - INTERVAL 3 MONTH) * 12 + (month(o_orderdate) + 8) % 12) AS INTEGER) AS hi FROM orders")
def e14(spark, d):
    return table(spark, d, "orders").agg(F.min(X.period_ordinal("o_orderdate")).cast("int").alias("lo"), F.max(X.period_ordinal("o_orderdate")).cast("int").alias("hi"))


@query("e16_severity_counts", f"WITH {LEGS}, {G5_CTE}, {CONVERGED} SELECT s.severity, count(conv.severity) AS n FROM (SELECT unnest(['LOW','MEDIUM','HIGH','CRITICAL']) AS severity) s LEFT JOIN conv USING (severity) GROUP BY 1")
def e16(spark, d):
    four = spark.createDataFrame([(s,) for s in X.SEVERITIES[1:]], "severity string")
    return four.join(converged(spark, d, told=False).groupBy("severity").count(), "severity", "left").select("severity", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


@query("e17_summary", f"WITH {LEGS}, {G5_CTE}, {CONVERGED} SELECT count(*) AS flagged, count(*) FILTER (WHERE signal_count > 1) AS multi, count(*) FILTER (WHERE signal_count = 1) AS single FROM conv")
def e17(spark, d):
    return converged(spark, d, told=False).agg(F.count("*").alias("flagged"), F.count_if(F.col("signal_count") > 1).alias("multi"), F.count_if(F.col("signal_count") == 1).alias("single"))


@query("e18_account_zscore", f"WITH {LEGS} SELECT account, count(*) AS n, round(avg(ln(1 + CAST(amount AS DOUBLE))), 6) AS mu, round(stddev_pop(ln(1 + CAST(amount AS DOUBLE))), 6) AS sd FROM legs GROUP BY account")
def e18(spark, d):
    log = F.log1p(F.col("amount").cast("double"))
    return ledger_legs(spark, d, numbered=False).groupBy("account").agg(F.count("*").alias("n"), F.round(F.avg(log), 6).alias("mu"), F.round(F.stddev_pop(log), 6).alias("sd"))


@query("e19_type_rarity", f"WITH {LEGS} SELECT vch_type, round(1.0 / count(*), 12)::DOUBLE AS rarity FROM legs GROUP BY vch_type")
def e19(spark, d):
    return ledger_legs(spark, d, numbered=False).groupBy("vch_type").agg(F.round((1.0 / F.count("*")).cast("double"), 12).alias("rarity"))


@query("e20_totals", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS claimed, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS reported, count(DISTINCT l_suppkey) AS deductors FROM lineitem")
def e20(spark, d):
    m = F.col("l_extendedprice").cast(D2)
    return table(spark, d, "lineitem").agg(F.sum(F.when(F.col("l_returnflag") == "R", m)).cast("double").alias("claimed"), F.sum(F.when(F.col("l_returnflag") == "A", m)).cast("double").alias("reported"), F.count_distinct("l_suppkey").alias("deductors"))


@query("e21_accumulate_by_key", "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min_by(o_orderpriority, o_orderkey) AS first_name, max_by(o_orderpriority, o_orderkey) AS last_name FROM orders GROUP BY o_custkey")
def e21(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast(D2)).cast("double").alias("total"), F.min_by("o_orderpriority", "o_orderkey").alias("first_name"), F.max_by("o_orderpriority", "o_orderkey").alias("last_name"))


@query("e22_balance_summary", "WITH g AS (SELECT c_custkey, c_acctbal, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) SELECT count(*) FILTER (WHERE s IS NULL) AS unmatched, count(*) FILTER (WHERE abs(CAST(s AS DOUBLE) - c_acctbal) <= 1) AS clean, count(*) FILTER (WHERE abs(CAST(s AS DOUBLE) - c_acctbal) > 1) AS mismatched FROM g")
def e22(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast(D2)).cast("double").alias("s"))
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    gap = F.abs(F.col("s") - F.col("c_acctbal"))
    return j.agg(F.count_if(F.col("s").isNull()).alias("unmatched"), F.count_if(gap <= 1).alias("clean"), F.count_if(gap > 1).alias("mismatched"))


@query("e23_kpis", f"WITH {LEGS} SELECT count(*) AS legs, count(DISTINCT entry_id) AS vouchers, count(DISTINCT account) AS accounts, min(date) AS first_date, max(date) AS last_date FROM legs")
def e23(spark, d):
    return ledger_legs(spark, d, numbered=False).agg(F.count("*").alias("legs"), F.count_distinct("entry_id").alias("vouchers"), F.count_distinct("account").alias("accounts"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("e24_leg_severity", f"WITH {LEGS}, {G5_CTE}, {CONVERGED} SELECT severity, count(*) AS legs FROM conv GROUP BY severity")
def e24(spark, d):
    return converged(spark, d, told=False).groupBy("severity").agg(F.count("*").alias("legs"))


_BY_VOUCHER = """bv AS (SELECT entry_id, max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS rk, max(amount) AS amount, string_agg(DISTINCT account, ', ' ORDER BY account) AS accounts, min(date) AS date, count(*) AS leg_count FROM conv GROUP BY entry_id),
bc AS (SELECT entry_id, string_agg(DISTINCT rule, ', ' ORDER BY rule) AS checks FROM flags GROUP BY entry_id),
br AS (SELECT entry_id, string_agg(reason, '; ' ORDER BY first) AS reasons FROM (SELECT entry_id, reason, min(leg_num * 10 + ord) AS first FROM flags GROUP BY 1, 2) GROUP BY 1)"""


@query("e25_voucher_severity", f"WITH {LEGS}, {G5_CTE}, {CONVERGED}, {_BY_VOUCHER} SELECT rk AS severity_rank, count(*) AS vouchers FROM bv GROUP BY rk")
def e25(spark, d):
    return R.severest(converged(spark, d, told=False), "l_orderkey").groupBy(F.col("rank").alias("severity_rank")).agg(F.count("*").alias("vouchers"))


@query("e26_priority_findings", f"WITH {LEGS}, {G5_CTE}, {CONVERGED}, {_BY_VOUCHER} SELECT entry_id, CASE rk WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, CAST(amount AS DOUBLE) AS amount, accounts, checks, reasons, date, leg_count FROM bv JOIN bc USING (entry_id) JOIN br USING (entry_id) ORDER BY rk DESC, amount DESC, entry_id LIMIT 10")
def e26(spark, d):
    v = R.severest(converged(spark, d), "l_orderkey").orderBy(F.col("rank").desc(), F.col("amount").desc(), "entry_id").limit(10)
    return R.tell(v).select("entry_id", "severity", F.col("amount").cast("double").alias("amount"), "accounts", "checks", "reasons", "date", "leg_count")


@query("e27_concentration", f"WITH {LEGS}, {G5_CTE}, {CONVERGED}, {_BY_VOUCHER} SELECT a AS account, count(*) AS n FROM (SELECT unnest(string_split(accounts, ', ')) AS a FROM (SELECT * FROM bv ORDER BY rk DESC, amount DESC, entry_id LIMIT 100)) GROUP BY 1 HAVING count(*) > 1")
def e27(spark, d):
    v = R.severest(converged(spark, d, told=False), "l_orderkey").orderBy(F.col("rank").desc(), F.col("amount").desc(), "entry_id").limit(100)
    return v.select(F.array_join(F.array_sort("accounts"), ", ").alias("accounts")).select(F.explode(F.split("accounts", ", ")).alias("account")).groupBy("account").agg(F.count("*").alias("n")).where("n > 1")


@query("e30_voucher_balance", f"WITH {LEGS} SELECT entry_id, CAST(sum(CASE WHEN dr_cr = 'Dr' THEN amount ELSE -amount END) AS DOUBLE) AS difference, abs(sum(CASE WHEN dr_cr = 'Dr' THEN amount ELSE -amount END)) < 0.01 AS balanced FROM legs GROUP BY entry_id")
def e30(spark, d):
    legs = ledger_legs(spark, d, numbered=False)
    diff = F.sum(F.when(F.col("dr_cr") == "Dr", F.col("amount")).otherwise(-F.col("amount")))
    return legs.groupBy("entry_id").agg(diff.alias("x")).select("entry_id", F.col("x").cast("double").alias("difference"), (F.abs("x") < 0.01).alias("balanced"))


@query("e32_confidence", f"""WITH {LEGS}, b AS (SELECT entry_id, abs(sum(CASE WHEN dr_cr = 'Dr' THEN amount ELSE -amount END)) >= 0.01 AS off FROM legs GROUP BY entry_id), t AS (SELECT count(*) AS vouchers, count(*) FILTER (WHERE off) AS unbalanced FROM b)
SELECT vouchers, unbalanced, CASE WHEN vouchers < 20 OR 100.0 * unbalanced / vouchers > 1 THEN 'low' ELSE 'ok' END AS confidence FROM t""")
def e32(spark, d):
    legs = ledger_legs(spark, d, numbered=False)
    b = legs.groupBy("entry_id").agg((F.abs(F.sum(F.when(F.col("dr_cr") == "Dr", F.col("amount")).otherwise(-F.col("amount")))) >= 0.01).alias("off"))
    t = b.agg(F.count("*").alias("vouchers"), F.count_if("off").alias("unbalanced"))
    return t.withColumn("confidence", F.when((F.col("vouchers") < 20) | (100.0 * F.col("unbalanced") / F.col("vouchers") > 1), "low").otherwise("ok"))


@query("e34_recall", f"WITH {LEGS} SELECT count(*) FILTER (WHERE entered_by = approved_by) AS flagged, count(*) FILTER (WHERE entered_by = approved_by AND l_returnflag = 'R') AS true_positive, count(*) FILTER (WHERE l_returnflag = 'R') AS planted FROM legs")
def e34(spark, d):
    hit, planted = F.col("entered_by") == F.col("approved_by"), F.col("l_returnflag") == "R"
    return ledger_legs(spark, d, numbered=False).agg(F.count_if(hit).alias("flagged"), F.count_if(hit & planted).alias("true_positive"), F.count_if(planted).alias("planted"))


@query("e38_compared_range", "SELECT strftime(min(o_orderdate), '%B %Y') AS first, strftime(max(o_orderdate), '%B %Y') AS last FROM orders")
def e38(spark, d):
    label = F.date_format("o_orderdate", "MMMM yyyy")
    return table(spark, d, "orders").agg(F.min_by(label, "o_orderdate").alias("first"), F.max_by(label, "o_orderdate").alias("last"))
