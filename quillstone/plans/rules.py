"""The rule library (G) over the ledger view."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.operators import anomaly
from quillstone.operators import rules as R
from quillstone.plans.registry import query
from quillstone.sources.views import LEGS, PERCENT, SEVERITY, entry_of_order, ledger_legs, table


def dup_legs(spark, d):
    """Legs whose amounts are so few (thousands of the quantity) that some repeat."""
    return ledger_legs(spark, d).withColumn("amount", (F.col("l_quantity") * 1000).cast("decimal(18,2)"))


def dup_keys(amount=None):
    """Amounts of legs have two decimals already."""
    return [F.col("date"), F.col("account"), F.col("dr_cr"), F.col("amount") if amount is None else amount]


G1_SQL = f"SELECT entry_id, leg_num, 'segregation_of_duties' AS rule, 'entered and approved by ' || entered_by AS reason, {SEVERITY.format('amount')} AS severity FROM legs WHERE entered_by = approved_by"
G2_SQL = "SELECT entry_id, leg_num, 'round_number' AS rule, 'multiple of 10000' AS reason, 'LOW' AS severity FROM legs WHERE (l_quantity * 1000) % 10000 = 0"
def dup_sql(amount: str, bucket: str) -> str:
    sev = SEVERITY.format("amount")
    return f"""keyed AS (SELECT *, {bucket} AS bucket FROM (SELECT * REPLACE ({amount} AS amount) FROM legs)),
groups AS (SELECT date, account, dr_cr, bucket, list_sort(list(DISTINCT entry_id)) AS ids FROM keyed GROUP BY ALL HAVING count(DISTINCT entry_id) > 1),
dup AS (SELECT entry_id, leg_num, 'duplicate_transaction' AS rule,
  'matches voucher(s) ' || array_to_string(list_slice(list_filter(ids, lambda x: x <> entry_id), 1, 3), ', ') || ' on ' || CAST(date AS VARCHAR) AS reason,
  CASE WHEN len(ids) > 2 THEN CASE {sev} WHEN 'LOW' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END ELSE {sev} END AS severity, CAST(len(ids) AS INTEGER) AS vouchers, ids[1] AS first_id
  FROM keyed JOIN groups USING (date, account, dr_cr, bucket))"""


G5_CTE = dup_sql("CAST(l_quantity * 1000 AS DECIMAL(18,2))", "round(amount, 2)")
G5_ROUGH = dup_sql("amount", "round(amount / 10000, 0)")


@query("g01_segregation_of_duties", f"WITH {LEGS} {G1_SQL}")
def g01(spark, d):
    return R.segregation(ledger_legs(spark, d))


@query("g02_round_number", f"WITH {LEGS} {G2_SQL}")
def g02(spark, d):
    return R.round_amounts(ledger_legs(spark, d).withColumn("amount", F.col("l_quantity") * 1000))


_BENFORD_SUMS = " + ".join(f"power(n{i} - n * {p / 100!r}, 2) / (n * {p / 100!r})" for i, p in enumerate(X.BENFORD_PERCENT, 1))
_BENFORD_MAD = " + ".join(f"abs(n{i} / n - {p / 100!r})" for i, p in enumerate(X.BENFORD_PERCENT, 1))
_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE digit = {i}) AS DOUBLE) AS n{i}" for i in range(1, 10))
_DIGIT = "CAST(nullif(regexp_extract(CAST({} AS VARCHAR), '[1-9]', 0), '') AS INTEGER)"


def benford_sql(source: str, amount: str, by: str = "", where: str = "TRUE", name: str = "bf") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""dg_{name} AS (SELECT {keys}{_DIGIT.format(amount)} AS digit FROM {source} WHERE {where}),
cn_{name} AS (SELECT {keys}CAST(count(digit) AS DOUBLE) AS n, {_COUNTS} FROM dg_{name} {group}),
{name} AS (SELECT {keys}CAST(n AS BIGINT) AS n, round({_BENFORD_SUMS}, 6) AS chi_square, round(({_BENFORD_MAD}) / 9, 9) AS mad, ({_BENFORD_SUMS}) > 15.5 AS deviates FROM cn_{name} WHERE n > 0)"""


@query("g03_benford", f"WITH {benford_sql('lineitem', 'l_extendedprice')} SELECT *, CASE WHEN mad < 0.006 THEN 'Close conformity' WHEN mad < 0.012 THEN 'Acceptable conformity' WHEN mad < 0.015 THEN 'Marginally acceptable' ELSE 'Nonconformity' END AS band FROM bf")
def g03(spark, d):
    return R.benford(table(spark, d, "lineitem"), "l_extendedprice").withColumn("band", X.mad_band("mad"))


_SIDE = "SELECT s_name, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = '{}' GROUP BY s_name"


def _supplier_side(spark, d, flag):
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    sums = li.where(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    return sums.join(s, sums.l_suppkey == s.s_suppkey).groupBy("s_name").agg(F.sum("amount").cast("double").alias("amount"))


@query("g04_itr_26as", f"""WITH c AS ({_SIDE.format('R')}), r AS ({_SIDE.format('A')}),
j AS (SELECT s_name, coalesce(c.amount, 0) AS claimed, coalesce(r.amount, 0) AS reported FROM c FULL JOIN r USING (s_name))
SELECT s_name, claimed, reported, round(claimed - reported, 2) AS mismatch, {PERCENT.format('(claimed - reported)', 'claimed')} AS severity FROM j WHERE abs(claimed - reported) > 10.0""")
def g04(spark, d):
    flags = R.reconcile(_supplier_side(spark, d, "R"), _supplier_side(spark, d, "A"), ["s_name"], ["amount"], 10.0, reference="left", how="full")
    return flags.select("s_name", F.col("left_amount").alias("claimed"), F.col("right_amount").alias("reported"), F.round("mismatch", 2).alias("mismatch"), "severity")


@query("g05_duplicate_transactions", f"WITH {LEGS}, {G5_CTE} SELECT entry_id, leg_num, rule, reason, severity, vouchers FROM dup")
def g05(spark, d):
    return R.duplicates(dup_legs(spark, d), dup_keys())


@query("g05_escalation", f"WITH {LEGS}, {G5_ROUGH} SELECT entry_id, leg_num, rule, reason, severity, vouchers FROM dup")
def g05_rough(spark, d):
    """With amounts to the nearest 10,000 some keys have more than two vouchers."""
    return R.duplicates(ledger_legs(spark, d), dup_keys(F.round(F.col("amount") / 10000, 0)))


@query("g06_trial_balance", f"""WITH gl AS (SELECT o_custkey, o_orderpriority AS variant, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(28,2)) AS debit, CAST(sum(CASE WHEN o_orderstatus <> 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(28,2)) AS credit FROM orders GROUP BY 1, 2),
a AS (SELECT c_name AS account, CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS tb, sum(debit) AS debit, sum(credit) AS credit, coalesce(string_agg(variant, '; ' ORDER BY variant), '') AS variants_used, count(variant) = 0 AS unmatched FROM customer LEFT JOIN gl ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_acctbal),
j AS (SELECT account, unnest(CASE WHEN unmatched THEN ['unmatched'] ELSE ['debit', 'credit'] END) AS side, tb AS tb_amount, unnest(CASE WHEN unmatched THEN [NULL] ELSE [debit, credit] END) AS gl_amount, variants_used FROM a)
SELECT account, side, CAST(tb_amount AS DOUBLE) AS tb_amount, CAST(gl_amount AS DOUBLE) AS gl_amount, CAST(gl_amount - tb_amount AS DOUBLE) AS mismatch, CASE WHEN gl_amount IS NOT NULL THEN {PERCENT.format('(CAST(gl_amount - tb_amount AS DOUBLE))', 'CAST(tb_amount AS DOUBLE)')} END AS severity, variants_used FROM j WHERE gl_amount IS NULL OR abs(gl_amount - tb_amount) > 1.0""")
def g06(spark, d):
    o, cu = table(spark, d, "orders"), table(spark, d, "customer")
    m = F.col("o_totalprice").cast("decimal(18,2)")
    # an account's variants in the ledger are its priorities
    side = lambda hit: F.sum(F.when(hit, m).otherwise(F.lit(0)))
    gl = o.groupBy("o_custkey", F.col("o_orderpriority").alias("variant")).agg(side(F.col("o_orderstatus") == "O").alias("debit"), side(F.col("o_orderstatus") != "O").alias("credit"))
    gl = gl.groupBy("o_custkey").agg(F.sum("debit").cast("decimal(28,2)").alias("debit"), F.sum("credit").cast("decimal(28,2)").alias("credit"), F.array_join(F.sort_array(F.collect_list("variant")), "; ").alias("variants_used"))
    tb = cu.select("c_custkey", F.col("c_name").alias("account"), (F.col("c_acctbal").cast("decimal(18,2)") * 100).cast("decimal(28,2)").alias("tb"))
    j = tb.join(gl, tb.c_custkey == gl.o_custkey, "left")
    # both sides come from one join: unpivot it instead of joining again
    cell = lambda s, x: F.struct(F.lit(s).alias("side"), F.col("tb").alias("tb_amount"), x.alias("gl_amount"))
    none = F.lit(None).cast("decimal(28,2)")
    sides = F.when(F.col("o_custkey").isNull(), F.array(cell("unmatched", none))).otherwise(F.array(*(cell(s, F.col(s)) for s in ("debit", "credit"))))
    flat = j.select("account", F.coalesce("variants_used", F.lit("")).alias("variants_used"), F.explode(sides).alias("x")).select("account", "x.*", "variants_used")
    gap = F.col("gl_amount") - F.col("tb_amount")
    sev = F.when(F.col("gl_amount").isNotNull(), X.percent_severity(gap.cast("double"), F.col("tb_amount").cast("double")))
    return flat.where(F.col("gl_amount").isNull() | (F.abs(gap) > 1)).select("account", "side", F.col("tb_amount").cast("double").alias("tb_amount"), F.col("gl_amount").cast("double").alias("gl_amount"), gap.cast("double").alias("mismatch"), sev.alias("severity"), "variants_used")


_SERIES = """v AS (SELECT o_orderstatus AS vch_type, o_orderkey AS num, 'SO_' || o_orderkey AS entry_id FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey),
s AS (SELECT *, lead(num) OVER w AS nxt, lead(entry_id) OVER w AS after_id, count(*) OVER (PARTITION BY vch_type) AS group_size FROM v WINDOW w AS (PARTITION BY vch_type ORDER BY num)),
gaps AS (SELECT vch_type, unnest(range(num + 1, nxt)) AS missing, num AS before, entry_id AS before_id, nxt AS after, after_id, group_size FROM s WHERE nxt - num > 1)"""


def gaps(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    v = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    v = v.select(F.col("o_orderstatus").alias("vch_type"), F.col("o_orderkey").alias("number"), F.concat(F.lit("SO_"), F.col("o_orderkey").cast("string")).alias("entry_id"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("row_idx"))
    return R.sequence_gaps(v, ["vch_type"], cfg=R.Config(gap_least=1, gap_digits=None))


@query("g07_voucher_gaps", f"WITH {_SERIES} SELECT * FROM gaps")
def g07(spark, d):
    return gaps(spark, d)


@query("e15_gap_series", f"WITH {_SERIES} SELECT vch_type, count(*) AS missing_count, min(missing) AS first_missing, max(missing) AS last_missing, max(group_size) AS group_size, CASE WHEN count(*) >= 10 THEN 'HIGH' WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity, string_agg(CAST(missing AS VARCHAR), '; ' ORDER BY missing) AS missing_numbers FROM gaps GROUP BY vch_type")
def e15(spark, d):
    g = gaps(spark, d).groupBy("vch_type").agg(F.count("*").alias("missing_count"), F.min("missing").alias("first_missing"), F.max("missing").alias("last_missing"), F.max("group_size").alias("group_size"), F.sort_array(F.collect_list("missing")).alias("n"))
    return g.select("vch_type", "missing_count", "first_missing", "last_missing", "group_size", X.gap_severity("missing_count").alias("severity"), F.array_join(F.col("n").cast("array<string>"), "; ").alias("missing_numbers"))


#: Measures of a return, each as (orders, lines): what is summed, and where. The star tables have no tax heads, so statuses and flags stand for them.
MEASURES = {
    "taxable": (("o_totalprice * 1.00", "TRUE"), ("l_extendedprice * 1.00", "TRUE")),
    "igst": (("o_totalprice * 0.18", "o_orderstatus = 'O'"), ("l_extendedprice * l_tax", "l_returnflag = 'R'")),
    "cgst": (("o_totalprice * 0.09", "o_orderstatus = 'F'"), ("l_extendedprice * l_tax", "l_returnflag = 'A'")),
    "sgst": (("o_totalprice * 0.09", "o_orderstatus = 'F'"), ("l_extendedprice * l_tax", "l_returnflag = 'N'")),
    "cess": (("o_totalprice * 0.01", "o_orderstatus = 'P'"), ("l_extendedprice * l_discount", "l_linestatus = 'F'")),
    "non_gst": (("o_totalprice * 1.00", "o_orderpriority = '5-LOW'"), ("l_extendedprice * 1.00", "l_tax = 0")),
}
_MONEY = ("o_totalprice", "l_extendedprice", "l_tax", "l_discount")


def _measure(side: int, name: str) -> str:
    """SQL of a measure, in decimals; both engines read it."""
    what, where = MEASURES[name][side]
    for c in _MONEY:
        what = what.replace(c, f"CAST({c} AS DECIMAL(14,2))")
    return f"CAST(coalesce(sum(CASE WHEN {where} THEN CAST({what} AS DECIMAL(24,4)) END), 0) AS DECIMAL(28,4)) AS {name}"


_G1 = "a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, {} FROM orders GROUP BY 1), b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, {} FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)".format(*(", ".join(_measure(i, n) for n in MEASURES) for i in (0, 1)))


def monthly(spark, d):
    """(a: what the orders say of each month, b: what the lines say), all measures as decimals."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    month = F.trunc("o_orderdate", "month").alias("m")
    a = o.groupBy(month).agg(*(F.expr(_measure(0, n)) for n in MEASURES))
    b = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(month).agg(*(F.expr(_measure(1, n)) for n in MEASURES))
    return a, b


def unpivot_sql(left: str, right: str, join: str, measures: list[str]) -> str:
    """m, "check", l, r: the measures of two tables as rows."""
    both = ", ".join(f"coalesce({left}.{x}, 0)" for x in measures), ", ".join(f"coalesce({right}.{x}, 0)" for x in measures)
    return f"(SELECT m, unnest([{', '.join(repr(x) for x in measures)}]) AS \"check\", unnest([{both[0]}]) AS l, unnest([{both[1]}]) AS r FROM {left} {join} JOIN {right} USING (m))"


_GAP = "CAST(l - r AS DOUBLE)"
_BY_RIGHT, _BY_LEFT = PERCENT.format(_GAP, "CAST(r AS DOUBLE)"), PERCENT.format(_GAP, "CAST(l AS DOUBLE)")
#: Months of June have no second return, so that some filings are missing.
_FILED = "month(m) <> 6"


@query("g09_gstr1_vs_gstr3b", f"""WITH {_G1}, f AS (SELECT * FROM b WHERE {_FILED}), x AS {unpivot_sql('a', 'f', '', list(MEASURES))}
SELECT m AS period, "check", {_GAP} AS mismatch, {_BY_RIGHT} AS severity FROM x WHERE abs(l - r) > 10.0
UNION ALL SELECT m, 'missing_filing', NULL, 'CRITICAL' FROM a WHERE m NOT IN (SELECT m FROM f)""")
def g09(spark, d):
    a, b = monthly(spark, d)
    flags = R.reconcile(a, b.where(F.month("m") != 6), ["m"], list(MEASURES), 10.0, how="left", missing="missing_filing")
    return flags.select(F.col("m").alias("period"), "check", F.col("mismatch").cast("double").alias("mismatch"), "severity")


_HEADS = ("cgst", "sgst", "igst")
_PAID = "a AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, {} FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)".format(", ".join(_measure(1, h) for h in _HEADS))


@query("g10_payment_completeness", f"""WITH {_PAID}, b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, {", ".join(_measure(1, h) for h in _HEADS)} FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' GROUP BY 1)
SELECT m AS period, "check", {_GAP} AS mismatch, {_BY_LEFT} AS severity FROM {unpivot_sql('a', 'b', 'LEFT', list(_HEADS))} WHERE abs(l - r) > 10.0""")
def g10(spark, d):
    """What is payable a head and month against what of it is paid: one pass over the lines, both sums by condition."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    paid = lambda h: _measure(1, h).replace("CASE WHEN ", "CASE WHEN l_linestatus = 'F' AND ").replace(f"AS {h}", f"AS {h}_paid")
    p = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.trunc("o_orderdate", "month").alias("period")).agg(*(F.expr(_measure(1, h)) for h in _HEADS), *(F.expr(paid(h)) for h in _HEADS))
    flat = p.select("period", F.explode(F.array(*(F.struct(F.lit(h).alias("check"), F.col(h).alias("payable"), F.col(f"{h}_paid").alias("paid")) for h in _HEADS))).alias("x")).select("period", "x.*")
    gap = F.col("payable") - F.col("paid")
    return flat.where(F.abs(gap) > 10).select("period", "check", gap.cast("double").alias("mismatch"), X.percent_severity(gap.cast("double"), F.col("payable").cast("double")).alias("severity"))


_BOOKS = [m for m in MEASURES if m != "cess"]


@query("g11_ledger_vs_gstr1", f"""WITH {_G1}, f AS (SELECT * FROM a WHERE {_FILED}), span AS (SELECT min(m) AS lo, max(m) AS hi FROM f), x AS {unpivot_sql('b', 'f', '', _BOOKS)}
SELECT m AS period, "check", {_GAP} AS mismatch, replace({_BY_RIGHT}, 'NONE', 'MEDIUM') AS severity FROM x WHERE abs(l - r) > 10.0
UNION ALL SELECT m, 'missing_return', NULL, 'CRITICAL' FROM b, span WHERE m NOT IN (SELECT m FROM f) AND m BETWEEN lo AND hi""")
def g11(spark, d):
    a, b = monthly(spark, d)
    filed = a.where(F.month("m") != 6)
    span = filed.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))  # one row
    flags = R.reconcile(b, filed, ["m"], _BOOKS, 10.0, how="left", never_none=True, missing="missing_return").crossJoin(F.broadcast(span))
    inside = (F.col("check") != "missing_return") | F.col("m").between(F.col("lo"), F.col("hi"))
    return flags.where(inside).select(F.col("m").alias("period"), "check", F.col("mismatch").cast("double").alias("mismatch"), "severity")


CONVERGED = f"""flags AS (SELECT entry_id, leg_num, 0 AS ord, rule, reason, severity FROM ({G1_SQL}) UNION ALL SELECT entry_id, leg_num, 1, rule, reason, severity FROM ({G2_SQL}) UNION ALL SELECT entry_id, leg_num, 2, rule, reason, severity FROM dup),
per AS (SELECT entry_id, leg_num, string_agg(rule, '; ' ORDER BY ord) AS rules, CAST(count(*) AS INTEGER) AS signal_count, max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS rk FROM flags GROUP BY 1, 2),
conv AS (SELECT legs.entry_id, legs.leg_num, date, account, amount, rules, signal_count, CASE rk WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM per JOIN legs USING (entry_id, leg_num))"""


def converged(spark, d, told: bool = True):
    """Flags of the three leg rules together; told False where no reasons are asked for."""
    legs = ledger_legs(spark, d).withColumns({"round_amount": F.col("l_quantity") * 1000, "repeat_amount": (F.col("l_quantity") * 1000).cast("decimal(18,2)")})
    return R.converge_rules(legs, dup_keys(F.col("repeat_amount")), round_amount="round_amount", repeat_amount="repeat_amount", voucher="l_orderkey", named=entry_of_order(), told=told)


@query("g12_convergence", f"WITH {LEGS}, {G5_CTE}, {CONVERGED} SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM conv")
def g12(spark, d):
    f = converged(spark, d)
    return f.select("entry_id", "leg_num", "date", "account", F.col("amount").cast("double").alias("amount"), F.array_join(F.transform("reasons", lambda x: x["rule"]), "; ").alias("rules"), F.col("signal_count").cast("int").alias("signal_count"), "severity")


@query("g13_comparison_status", f"WITH {_G1} SELECT CASE WHEN na = 0 THEN 'no_gstr1' WHEN nb = 0 THEN 'no_gstr3b' WHEN n = 0 THEN 'no_overlap' ELSE 'ok' END AS status, n AS compared FROM (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a JOIN b USING (m)) AS n)")
def g13(spark, d):
    a, b = monthly(spark, d)
    j = a.select("m", F.lit(1).alias("x")).join(b.select("m", F.lit(1).alias("y")), "m", "full").agg(F.count("x").alias("na"), F.count("y").alias("nb"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"))
    return j.select(F.when(F.col("na") == 0, "no_gstr1").when(F.col("nb") == 0, "no_gstr3b").when(F.col("n") == 0, "no_overlap").otherwise("ok").alias("status"), F.col("n").alias("compared"))


FEATURES_SQL = f"""WITH {LEGS}, st AS (SELECT account, avg(ln(1 + CAST(amount AS DOUBLE))) AS mu, stddev_pop(ln(1 + CAST(amount AS DOUBLE))) AS sd FROM legs WHERE amount > 0 GROUP BY account),
ty AS (SELECT vch_type, count(*) AS n FROM legs GROUP BY vch_type)
SELECT entry_id, leg_num, round(ln(1 + CAST(amount AS DOUBLE)), 6) AS log_amount, round((ln(1 + CAST(amount AS DOUBLE)) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 5) AS account_zscore,
  CASE WHEN dr_cr = 'Dr' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_debit, CAST(day(date) AS DOUBLE) AS day_of_month, CASE WHEN amount % 10000 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_round_10k, round(1.0 / n, 12)::DOUBLE AS vch_type_rarity
FROM legs JOIN st USING (account) JOIN ty USING (vch_type) WHERE amount > 0"""


@query("g08_features", FEATURES_SQL)
def g08f(spark, d):
    f = anomaly.features(ledger_legs(spark, d))
    return f.select("entry_id", "leg_num", F.round("log_amount", 6).alias("log_amount"), F.round("account_zscore", 5).alias("account_zscore"), "is_debit", "day_of_month", "is_round_10k", F.round("vch_type_rarity", 12).alias("vch_type_rarity"))


@query("g08_isolation_forest")
def g08(spark, d):
    return anomaly.flags(anomaly.features(ledger_legs(spark, d)))


@query("g08_severity_counts", "SELECT severity, CAST(hi - lo AS BIGINT) AS flags FROM (SELECT CAST(floor(count(*) * 0.05) AS BIGINT) AS n5, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_extendedprice > 0), LATERAL (VALUES ('high', 0, CAST(floor(n * 0.01) AS BIGINT)), ('medium', CAST(floor(n * 0.01) AS BIGINT), CAST(floor(n * 0.03) AS BIGINT)), ('low', CAST(floor(n * 0.03) AS BIGINT), n5)) t(severity, lo, hi)")
def g08_counts(spark, d):
    """How many legs each band of ranks holds; no model decides that, so SQL knows it."""
    return anomaly.severity_counts(anomaly.flags(anomaly.features(ledger_legs(spark, d))))
