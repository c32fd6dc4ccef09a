"""Ledger-shaped views over the star-schema tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files that one task joins.
TASK_BYTES = 16 << 20


def dealt(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a join dealt by its key into as many partitions as their files ask for, where the session has fewer: what a task sorts and holds does not grow with the tables."""
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (left, right))
    n = -(-size // TASK_BYTES)
    if n <= int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return left, right
    return left.repartition(n, left_key), right.repartition(n, right_key)


LEG_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def entry_of_order():
    """A voucher's id from its number."""
    return F.concat(F.lit("SO_"), F.col("l_orderkey").cast("string"))


def ledger_legs(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """One row a leg: vouchers are orders, accounts are suppliers. Leg numbers cost a shuffle by voucher, so ask for them only where needed."""
    li, o, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    li, o = dealt(li, o, "l_orderkey", "o_orderkey")
    legs = li.join(o.select("o_orderkey", "o_orderdate", "o_orderstatus"), li.l_orderkey == F.col("o_orderkey")).join(s.select("s_suppkey", "s_name"), li.l_suppkey == F.col("s_suppkey"))
    cols = [
        entry_of_order().alias("entry_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("s_name").alias("account"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.when(F.col("l_linestatus") == "O", "Dr").otherwise("Cr").alias("dr_cr"),
        F.when(F.col("o_orderstatus") == "F", "Sales GST").when(F.col("o_orderstatus") == "O", "Sales").otherwise("Journal").alias("vch_type"),
        F.col("l_orderkey").cast("string").alias("vch_no"),
        F.concat(F.lit("U"), (F.col("l_suppkey") % 5).cast("string")).alias("entered_by"),
        F.concat(F.lit("U"), (F.col("l_partkey") % 5).cast("string")).alias("approved_by"),
        "l_orderkey", "l_quantity", "l_tax", "l_returnflag", "l_shipdate", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice",
    ]
    if numbered:
        legs = legs.withColumn("leg_num", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LEG_ORDER)))
        cols.append("leg_num")
    return legs.select(*cols)


LEGS = """legs AS (
  SELECT 'SO_' || CAST(l_orderkey AS VARCHAR) AS entry_id, CAST(o_orderdate AS DATE) AS date, s_name AS account,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_linestatus = 'O' THEN 'Dr' ELSE 'Cr' END AS dr_cr,
    CASE WHEN o_orderstatus = 'F' THEN 'Sales GST' WHEN o_orderstatus = 'O' THEN 'Sales' ELSE 'Journal' END AS vch_type,
    CAST(l_orderkey AS VARCHAR) AS vch_no, 'U' || CAST(l_suppkey % 5 AS VARCHAR) AS entered_by, 'U' || CAST(l_partkey % 5 AS VARCHAR) AS approved_by,
    l_orderkey, l_quantity, l_tax, l_returnflag, l_shipdate, l_suppkey, l_partkey, l_linenumber, l_extendedprice,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS leg_num
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
)"""

SEVERITY = "CASE WHEN abs({0}) >= 1000000 THEN 'CRITICAL' WHEN abs({0}) >= 100000 THEN 'HIGH' WHEN abs({0}) >= 10000 THEN 'MEDIUM' ELSE 'LOW' END"
PERCENT = "CASE WHEN {1} = 0 THEN CASE WHEN {0} <> 0 THEN 'CRITICAL' ELSE 'NONE' END WHEN abs({0} / {1}) * 100 >= 30 THEN 'CRITICAL' WHEN abs({0} / {1}) * 100 >= 10 THEN 'HIGH' WHEN abs({0} / {1}) * 100 > 0 THEN 'MEDIUM' ELSE 'NONE' END"
FY = "(year({0} - INTERVAL 3 MONTH) || '-' || lpad(CAST((year({0} - INTERVAL 3 MONTH) + 1) % 100 AS VARCHAR), 2, '0'))"
