"""Windows, orderings and set-like operators (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.plans.registry import query
from quillstone.plans.rules import CONVERGED, G5_CTE, converged
from quillstone.sources.views import LEG_ORDER, LEGS, ledger_legs, table


@query("f02_leg_numbers", f"WITH {LEGS} SELECT entry_id, leg_num, l_partkey, l_suppkey FROM legs")
def f02(spark, d):
    return ledger_legs(spark, d).select("entry_id", "leg_num", "l_partkey", "l_suppkey")


@query("f03_first_sighting", "SELECT o_custkey, min(o_orderkey) AS first_key, min_by(CAST(o_orderdate AS DATE), o_orderkey) AS first_date FROM orders GROUP BY o_custkey")
def f03(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.min_by(F.col("o_orderdate").cast("date"), "o_orderkey").alias("first_date"))


@query("f05_rank_bands", "WITH t AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rk, (SELECT count(*) FROM orders) AS n FROM orders) SELECT o_orderkey, rk::INTEGER AS rk, CASE WHEN rk / n <= 0.01 THEN 'high' WHEN rk / n <= 0.03 THEN 'medium' ELSE 'low' END AS band FROM t WHERE rk <= floor(n * 0.05)")
def f05(spark, d):
    from quillstone.functions.exprs import rank_severity
    from quillstone.operators.ordering import first_ranks, spread

    o = table(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("less"))
    n = o.count()
    top = first_ranks(o, "less", ["o_orderkey"], spread(o, "less", 0.05), int(n * 0.05), "rk")
    return top.select("o_orderkey", "rk").withColumn("band", rank_severity(F.col("rk") / n))


@query("f06_report_order", f"WITH {LEGS}, {G5_CTE}, {CONVERGED} SELECT entry_id, leg_num, signal_count, severity FROM conv ORDER BY signal_count DESC, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END DESC, entry_id, leg_num")
def f06(spark, d):
    from quillstone.functions.exprs import rank_of

    f = converged(spark, d, told=False)
    return f.select("entry_id", "leg_num", F.col("signal_count").cast("int").alias("signal_count"), "severity").orderBy(F.col("signal_count").desc(), rank_of("severity").desc(), "entry_id", "leg_num")


@query("f07_lexical_order", f"WITH {LEGS}, {G5_CTE}, {CONVERGED} SELECT entry_id, leg_num, severity FROM conv WHERE severity IN ('MEDIUM', 'HIGH') ORDER BY severity DESC, signal_count DESC, entry_id, leg_num")
def f07(spark, d):
    return converged(spark, d, told=False).where(F.col("severity").isin("MEDIUM", "HIGH")).orderBy(F.col("severity").desc(), F.col("signal_count").desc(), "entry_id", "leg_num").select("entry_id", "leg_num", "severity")


@query("f09_newest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def f09(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"))


@query("f10_first_wins_dedup", "SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def f10(spark, d):
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"))
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(first.alias("m")).select("l_partkey", "l_suppkey", F.col("m.l_orderkey").alias("l_orderkey"))


@query("f11_date_aware_identity", f"WITH {LEGS}, t AS (SELECT entry_id, leg_num, l_shipdate, first_value(CAST(l_shipdate AS DATE)) OVER (PARTITION BY entry_id ORDER BY leg_num) AS f FROM legs) SELECT entry_id, leg_num, CASE WHEN CAST(l_shipdate AS DATE) = f THEN entry_id ELSE entry_id || '_' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS identity FROM t")
def f11(spark, d):
    w = Window.partitionBy("entry_id").orderBy("leg_num")
    day = F.col("l_shipdate").cast("date")
    t = ledger_legs(spark, d).withColumn("f", F.first(day).over(w))
    return t.select("entry_id", "leg_num", F.when(day.isNull() | (day == F.col("f")), F.col("entry_id")).otherwise(F.concat("entry_id", F.lit("_"), day.cast("string"))).alias("identity"))


@query("f12_first_amount_wins", f"WITH {LEGS}, t AS (SELECT account, dr_cr, first_value(amount) OVER (PARTITION BY entry_id, account, dr_cr ORDER BY leg_num) AS f, entry_id, amount FROM legs) SELECT entry_id, account, dr_cr, CAST(max(f) AS DOUBLE) AS amount, count(*) FILTER (WHERE amount = f) AS merged, count(*) FILTER (WHERE amount <> f) AS conflicts FROM t GROUP BY 1, 2, 3")
def f12(spark, d):
    """Legs meet by their voucher's number, by which they are dealt already, and are sorted once."""
    w = Window.partitionBy("l_orderkey", "account", "dr_cr").orderBy(*LEG_ORDER)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = ledger_legs(spark, d, numbered=False).withColumns({"f": F.first("amount").over(whole), "place": F.row_number().over(w)})
    t = t.withColumns({"merged": F.count_if(F.col("amount") == F.col("f")).over(whole), "conflicts": F.count_if(F.col("amount") != F.col("f")).over(whole)})
    return t.where("place = 1").select("entry_id", "account", "dr_cr", F.col("f").cast("double").alias("amount"), "merged", "conflicts")


@query("f13_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM events")
def f13(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("event_type") == "click"
    return table(spark, d, "events").select("event_id", F.last(F.when(hit, F.col("event_id")), ignorenulls=True).over(w).alias("carried"), F.sum(F.when(hit, 1).otherwise(0)).over(w).alias("block"))


@query("f14_redundant_prune", f"WITH {LEGS} SELECT a.entry_id, a.leg_num FROM legs a WHERE a.leg_num = 1 AND NOT EXISTS (SELECT 1 FROM legs b WHERE b.entry_id = a.entry_id AND b.leg_num > 1 AND b.dr_cr = a.dr_cr AND b.l_quantity = a.l_quantity)")
def f14(spark, d):
    legs = ledger_legs(spark, d)
    b = legs.where("leg_num > 1").select("entry_id", "dr_cr", "l_quantity")
    return legs.where("leg_num = 1").join(b, ["entry_id", "dr_cr", "l_quantity"], "left_anti").select("entry_id", "leg_num")


@query("f15_block_segmentation", "WITH t AS (SELECT user_id, event_id, event_type, ts, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM events) SELECT user_id, CAST(block AS BIGINT) AS block, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM t WHERE block > 0 GROUP BY 1, 2")
def f15(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "events").withColumn("block", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w)).where("block > 0")
    path = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return t.groupBy("user_id", "block").agg(F.array_join(F.transform(path, lambda x: x["event_type"]), ">").alias("path"))


@query("f16_section_scope", "WITH t AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role) AS inside FROM conversations) SELECT conv_id, turn, role FROM t WHERE inside = 1")
def f16(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    t = table(spark, d, "conversations").withColumn("inside", F.max(F.when(F.col("role") == "system", 1).otherwise(0)).over(w))
    return t.where("inside = 1").select("conv_id", "turn", "role")


@query("f20_set_ops", "SELECT 'both' AS part, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'only_customer', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def f20(spark, d):
    cu, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    one = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return one(cu.join(o, "k", "left_semi"), "both").unionByName(one(cu.join(o, "k", "left_anti"), "only_customer"))


@query("f21_union_sources", "SELECT source, count(*) AS n FROM (SELECT 'order' AS source FROM orders UNION ALL SELECT 'line' FROM lineitem) GROUP BY source")
def f21(spark, d):
    o = table(spark, d, "orders").select(F.lit("order").alias("source"), "o_orderkey")
    li = table(spark, d, "lineitem").select(F.lit("line").alias("source"), "l_orderkey")
    return o.unionByName(li, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


@query("f22_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def f22(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("f23_period_orders", "SELECT string_agg(DISTINCT strftime(o_orderdate, '%Y-%m'), ',' ORDER BY strftime(o_orderdate, '%Y-%m')) AS periods FROM orders")
def f23(spark, d):
    p = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("p")).distinct()
    return p.agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("periods"))


@query("f24_label_disambiguation", "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) > 1 THEN c_mktsegment || c_nationkey || ' -- ' || c_name ELSE c_mktsegment || c_nationkey END AS label FROM customer")
def f24(spark, d):
    cu = table(spark, d, "customer").withColumn("label", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")))
    many = cu.groupBy("label").count().where("count > 1").select("label", F.lit(True).alias("many"))
    return cu.join(many, "label", "left").select("c_custkey", F.when(F.col("many"), F.concat_ws(" -- ", "label", "c_name")).otherwise(F.col("label")).alias("label"))
