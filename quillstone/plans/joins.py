"""Joins (D) over the star tables and the document tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import rules as R
from quillstone.plans.registry import query
from quillstone.plans.rules import _G1, G5_CTE, dup_keys, dup_legs, monthly
from quillstone.sources.views import LEGS, ledger_legs, table

D2 = "decimal(18,2)"


@query("d01_return_left_join", "WITH r AS (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS last_total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey, last_total, last_total IS NULL AS missing_filing FROM customer LEFT JOIN r ON c_custkey = o_custkey")
def d01(spark, d):
    r = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last_total"))
    return table(spark, d, "customer").join(r, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_total", F.col("last_total").isNull().alias("missing_filing"))


@query("d02_pairing", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' ELSE 'compared' END AS pairing FROM a FULL JOIN b ON a.k = b.k")
def d02(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    # one pass: which sides hold a key
    g = li.groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.col("l_returnflag") == "R").alias("a"), F.max(F.col("l_returnflag") == "A").alias("b"))
    return g.select("k", F.when(F.col("a") & F.col("b"), "compared").when(F.col("a"), "only_left").otherwise("only_right").alias("pairing"))


@query("d03_span_coverage", f"WITH {_G1}, f AS (SELECT * FROM a WHERE month(m) NOT IN (1, 6)), span AS (SELECT min(m) AS lo, max(m) AS hi FROM f) SELECT CAST(b.m AS DATE) AS period, CASE WHEN f.m IS NOT NULL THEN 'compared' WHEN b.m BETWEEN lo AND hi THEN 'missing_inside_span' ELSE 'not_covered' END AS coverage FROM b LEFT JOIN f ON b.m = f.m, span")
def d03(spark, d):
    a, b = monthly(spark, d)
    f = a.where(~F.month("m").isin(1, 6)).select("m", F.lit(True).alias("filed"))
    span = f.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))  # one row
    j = b.join(f, "m", "left").crossJoin(F.broadcast(span))
    return j.select(F.col("m").alias("period"), F.when(F.col("filed"), "compared").when(F.col("m").between(F.col("lo"), F.col("hi")), "missing_inside_span").otherwise("not_covered").alias("coverage"))


@query("d05_alias_rollup", "WITH al AS (SELECT n_name AS account, s_name AS variant FROM nation JOIN supplier ON n_nationkey = s_nationkey), g AS (SELECT s_name, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) SELECT account, CAST(sum(amount) AS DOUBLE) AS amount, string_agg(variant, '; ' ORDER BY variant) FILTER (WHERE amount IS NOT NULL) AS variants_used FROM al LEFT JOIN g ON variant = s_name GROUP BY account")
def d05(spark, d):
    s, n, li = (table(spark, d, t) for t in ("supplier", "nation", "lineitem"))
    g = li.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(D2)).alias("amount"))
    j = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("s_suppkey") == F.col("l_suppkey"), "left")  # nations: 25 rows
    return j.groupBy(F.col("n_name").alias("account")).agg(F.sum("amount").cast("double").alias("amount"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("amount").isNotNull(), F.col("s_name")))), "; ").alias("variants_used"))


@query("d06_full_outer_tan", "WITH a AS (SELECT l_suppkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.v, 0) AS DOUBLE) AS reported, CAST(coalesce(b.v, 0) AS DOUBLE) AS claimed FROM a FULL JOIN b ON a.k = b.k")
def d06(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda flag, n: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast(D2)).alias(n))
    j = side("R", "reported").join(side("A", "claimed"), "k", "full")
    return j.select("k", F.coalesce("reported", F.lit(0)).cast("double").alias("reported"), F.coalesce("claimed", F.lit(0)).cast("double").alias("claimed"))


@query("d07_latest_same_year_pairing", "WITH x AS (SELECT o_custkey, o_orderstatus, year(o_orderdate) AS y, max(o_orderkey) AS k FROM orders GROUP BY 1, 2, 3) SELECT f.o_custkey, f.y AS year, f.k AS form, o.k AS computation, CASE WHEN o.k IS NULL THEN 'incomplete' ELSE 'ok' END AS status FROM x f LEFT JOIN x o ON o.o_custkey = f.o_custkey AND o.y = f.y AND o.o_orderstatus = 'O' WHERE f.o_orderstatus = 'F'")
def d07(spark, d):
    o = table(spark, d, "orders")
    x = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("form"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("computation"))
    return x.where("form is not null").select("o_custkey", F.col("year").cast("long").alias("year"), "form", "computation", F.when(F.col("computation").isNull(), "incomplete").otherwise("ok").alias("status"))


@query("d08_interval_containment", "WITH s AS (SELECT user_id, CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events GROUP BY 1), p AS (SELECT unnest(range(0, 3)) AS idx, unnest([DATE '2024-01-01', DATE '2020-01-01', DATE '1990-01-01']) AS a, unnest([DATE '2024-06-30', DATE '2025-12-31', DATE '2100-01-01']) AS b) SELECT user_id, CAST(min(idx) AS INTEGER) AS period FROM s JOIN p ON lo >= a AND hi <= b GROUP BY user_id")
def d08(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").cast("date").alias("lo"), F.max("ts").cast("date").alias("hi"))
    periods = [("2024-01-01", "2024-06-30"), ("2020-01-01", "2025-12-31"), ("1990-01-01", "2100-01-01")]
    inside = [F.when((F.col("lo") >= F.lit(a).cast("date")) & (F.col("hi") <= F.lit(b).cast("date")), i) for i, (a, b) in enumerate(periods)]
    return s.select("user_id", F.coalesce(*inside).alias("period"))


@query("d09_bucket_range_join", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, max(p_partkey) AS last_key, count(*) AS n FROM part GROUP BY 1")
def d09(spark, d):
    bucket = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, d, "part").groupBy(bucket.alias("bucket")).agg(F.max("p_partkey").alias("last_key"), F.count("*").alias("n"))


@query("d11_drilldown", f"WITH {LEGS} SELECT a.entry_id, b.leg_num, b.account, CAST(b.amount AS DOUBLE) AS amount FROM (SELECT DISTINCT entry_id FROM legs WHERE entered_by = approved_by) a JOIN legs b USING (entry_id)")
def d11(spark, d):
    legs = ledger_legs(spark, d)
    flagged = legs.where("entered_by = approved_by").select("entry_id").distinct()
    return legs.join(flagged, "entry_id", "left_semi").select("entry_id", "leg_num", "account", F.col("amount").cast("double").alias("amount"))


@query("d12_related_expand", f"WITH {LEGS}, {G5_CTE} SELECT DISTINCT entry_id, first_id, vouchers FROM dup")
def d12(spark, d):
    return R.related(dup_legs(spark, d), dup_keys())


@query("d14_disjoint_array_merge", "WITH a AS (SELECT l_partkey AS k, list(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, list(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT a.k, CAST(len(a.s) + len(b.s) AS INTEGER) AS pages FROM a JOIN b USING (k) WHERE NOT list_has_any(a.s, b.s)")
def d14(spark, d):
    li = table(spark, d, "lineitem")
    g = li.groupBy(F.col("l_partkey").alias("k")).agg(*(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_suppkey"))).alias(n) for f, n in (("R", "a"), ("A", "b"))))
    return g.where((F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b")).select("k", (F.size("a") + F.size("b")).alias("pages"))


@query("d15_unique_candidate", "SELECT l_orderkey, min(l_linenumber) AS line FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1")
def d15(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("d16_orphan_absorb", "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(n, 0) = 1 AS absorbed FROM lineitem LEFT JOIN c USING (l_orderkey) WHERE l_returnflag = 'A'")
def d16(spark, d):
    li = table(spark, d, "lineitem")
    n = F.count_if(F.col("l_returnflag") == "R").over(Window.partitionBy("l_orderkey"))  # a voucher has few legs
    return li.withColumn("n", n).where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("n") == 1).alias("absorbed"))


@query("d17_next_nonnull", "SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase FROM events")
def d17(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("next_purchase"))


@query("d18_continuation_alias", "WITH t AS (SELECT o_custkey, o_orderpriority AS earlier, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM orders) SELECT o_custkey, later, min(earlier) AS earlier FROM t WHERE later <> earlier GROUP BY 1, 2 HAVING count(DISTINCT earlier) = 1")
def d18(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("earlier"), F.lead("o_orderpriority").over(w).alias("later")).where("later <> earlier")
    return t.groupBy("o_custkey", "later").agg(F.min("earlier").alias("earlier"), F.max("earlier").alias("x")).where("earlier = x").drop("x")


@query("d19_document_usage", "WITH u AS (SELECT source, max(doc_id) AS newest FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN quality IS NULL THEN 'not used' WHEN doc_id = newest THEN 'used' ELSE 'superseded' END AS usage FROM documents JOIN u USING (source) LEFT JOIN labels USING (doc_id)")
def d19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    newest = docs.groupBy("source").agg(F.max("doc_id").alias("newest"))
    j = docs.join(newest, "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("quality").isNull(), "not used").when(F.col("doc_id") == F.col("newest"), "used").otherwise("superseded").alias("usage"))


@query("d20_document_library", "SELECT d.doc_id, n_chars, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def d20(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "n_chars", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("a11_cached_scan", "SELECT d.doc_id, (l.doc_id IS NULL) AS needs_classifying FROM documents d LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)")
def a11(spark, d):
    from quillstone.sources.scan import with_cache

    listing = table(spark, d, "documents").select("doc_id", "n_chars")
    cache = table(spark, d, "labels").join(listing, "doc_id").select("doc_id", "n_chars", F.lit("known").alias("doctype"))
    return with_cache(listing, cache, ["doc_id", "n_chars"]).select("doc_id", F.col("doctype").isNull().alias("needs_classifying"))


@query("a12_pending_count", "SELECT count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a12(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("pending"))


@query("i09_voucher_detail", f"WITH {LEGS} SELECT leg_num, account, CAST(amount AS DOUBLE) AS amount, dr_cr FROM legs WHERE entry_id = (SELECT 'SO_' || min(l_orderkey) FROM lineitem)")
def i09(spark, d):
    legs = ledger_legs(spark, d)
    first = table(spark, d, "lineitem").agg(F.min("l_orderkey").alias("l_orderkey"))  # one row
    return legs.join(F.broadcast(first), "l_orderkey").select("leg_num", "account", F.col("amount").cast("double").alias("amount"), "dr_cr")


@query("c35_rule_options", "SELECT DISTINCT o_orderpriority AS rule FROM orders ORDER BY 1")
def rule_options(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("rule")).distinct().orderBy("rule")

