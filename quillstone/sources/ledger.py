"""Ledger files: typed legs with a quarantine, report catalogues, a synthetic generator."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import exprs as X

REAL = ["entry_id", "date", "timestamp", "account", "vendor", "entry_type", "amount", "entered_by", "approved_by", "narration", "vch_type", "vch_no", "dr_cr", "resolved", "source_pages", "corroboration_count", "entry_balanced"]
LEGS = "ledger_id string, row_idx long, entry_id string, date_raw string, date date, account string, vendor string, entry_type string, dr_cr string, amount_raw string, amount decimal(18,2), entered_by string, approved_by string, narration string, vch_type string, vch_no string, resolved boolean, source_pages array<int>, corroboration_count int, entry_balanced boolean"


def read_ledger(spark: SparkSession, path: str, ledger_id: str) -> tuple[DataFrame, DataFrame]:
    """(legs, quarantine) of a ledger CSV in either dialect; rows whose amount cannot be read are quarantined, not counted as 0."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    have = set(raw.columns)
    col = lambda c: F.trim(F.col(f"`{c}`")) if c in have else F.lit(None).cast("string")
    amount = col("amount")
    side = F.coalesce(X.blank_to_null(col("dr_cr")), X.blank_to_null(col("entry_type")))
    legs = raw.select(
        F.lit(ledger_id).alias("ledger_id"), F.monotonically_increasing_id().alias("row_idx"), col("entry_id").alias("entry_id"), col("date").alias("date_raw"), X.any_date(col("date")).alias("date"),
        F.coalesce(col("account"), F.lit("")).alias("account"), col("vendor").alias("vendor"), col("entry_type").alias("entry_type"), F.when(X.is_debit(side), "Dr").when(side.isNotNull(), "Cr").alias("dr_cr"),
        amount.alias("amount_raw"), F.when(amount.rlike(r"^[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$"), amount.try_cast("decimal(18,2)")).alias("amount"),
        X.blank_to_null(col("entered_by")).alias("entered_by"), X.blank_to_null(col("approved_by")).alias("approved_by"), col("narration").alias("narration"), col("vch_type").alias("vch_type"), col("vch_no").alias("vch_no"),
        (col("resolved") == "True").alias("resolved"), F.transform(F.filter(F.split(col("source_pages"), ";"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int")).alias("source_pages"),
        col("corroboration_count").try_cast("int").alias("corroboration_count"), (col("entry_balanced") == "True").alias("entry_balanced"),
    )
    return legs.where("amount is not null"), legs.where("amount is null")


def ledger_or_empty(spark: SparkSession, path: str, ledger_id: str) -> DataFrame:
    return read_ledger(spark, path, ledger_id)[0] if os.path.exists(path) else spark.createDataFrame([], LEGS)


def read_json(path: str, wait: float = 0.25):
    """A report, or None if it is missing or still broken after one retry."""
    for again in (True, False):
        try:
            return json.loads(Path(path).read_text())
        except FileNotFoundError:
            return None
        except ValueError:
            if again:
                time.sleep(wait)
    return None


def report_catalog(folder: str, pattern: str = "*.json") -> list[dict]:
    """Readable reports of a folder: samples first, then uploads by label."""
    found = [{"path": str(p), "report": r} for p in sorted(Path(folder).glob(pattern)) if (r := read_json(str(p))) is not None]
    key = lambda x: (x["report"].get("origin", "sample") != "sample", str(x["report"].get("label", "")).lower())
    return sorted(found, key=key)


def newest(reports: list[dict]) -> dict | None:
    return max(reports, key=lambda x: str(x["report"].get("generated_at", "")), default=None)


READERS = {"csv": lambda spark, p: spark.read.csv(p, header=True, multiLine=True, escape='"'), "json": lambda spark, p: spark.read.option("multiLine", True).json(p), "parquet": lambda spark, p: spark.read.parquet(p)}


def read_any(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """(table, error) by the path's extension; Excel sheets need an optional library."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind in ("xls", "xlsx"):
            import pandas as pd

            sheets = pd.read_excel(path, sheet_name=None, dtype=str)
            frames = [spark.createDataFrame(f.assign(__sheet=n)) for n, f in sheets.items()]
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f, allowMissingColumns=True)
            return out, None
        return READERS[kind](spark, path), None
    except KeyError:
        return None, f"no reader for .{kind}"
    except Exception as e:
        return None, str(e)


def synthetic(spark: SparkSession, n: int = 1200, seed: int = 42, share: float = 0.06) -> DataFrame:
    """A ledger with planted issues of four kinds: round amounts, one approver, odd hours, duplicate pairs."""
    pick = lambda xs, s: F.element_at(F.array(*map(F.lit, xs)), (F.floor(F.rand(s) * len(xs)) + 1).cast("int"))
    users = [f"user{i}" for i in range(5)]
    base = spark.range(n).select(
        F.format_string("JE%05d", F.col("id") + 1).alias("entry_id"), F.date_add(F.lit("2024-04-01").cast("date"), F.floor(F.rand(seed) * 365).cast("int")).alias("date"), pick([f"Account {i}" for i in range(12)], seed + 1).alias("account"),
        pick(["Debit", "Credit"], seed + 2).alias("entry_type"), F.round(F.exp(F.log(F.lit(500.0)) + F.rand(seed + 3) * F.log(F.lit(400.0))), 2).alias("amount"), pick(users, seed + 4).alias("entered_by"), F.lit("").alias("narration"),
        F.floor(F.rand(seed + 5) * 9 + 9).cast("int").alias("hour"), F.when(F.rand(seed + 6) < share, pick(["round_number", "same_approver", "off_hours", "duplicate_source"], seed + 7)).otherwise("").alias("is_planted_issue"),
    )
    issue = F.col("is_planted_issue")
    out = base.withColumns({
        "amount": F.when(issue == "round_number", F.ceil(F.col("amount") / 10000) * 10000.0).otherwise(F.col("amount")),
        "approved_by": F.when(issue == "same_approver", F.col("entered_by")).otherwise(F.concat(F.lit("approver"), (F.length("account") % 3).cast("string"))),
        "hour": F.when(issue == "off_hours", 2).otherwise(F.col("hour")),
    })
    copies = out.where(issue == "duplicate_source").withColumns({"entry_id": F.concat("entry_id", F.lit("D")), "is_planted_issue": F.lit("duplicate_copy")})
    return out.unionByName(copies)


def synthetic_26as(legs: DataFrame, claimed_accounts: list[str], seed: int = 42, wrong: float = 0.15) -> DataFrame:
    """Withholding by account from a ledger, with a share of entries that differ."""
    s = legs.where(F.col("account").isin(*claimed_accounts)).groupBy("account").agg(F.round(F.sum("amount") * 0.1, 2).alias("claimed"))
    bad = F.rand(seed) < wrong
    return s.withColumns({"mismatch": bad, "reported": F.when(bad, F.round(F.col("claimed") * 0.8, 2)).otherwise(F.col("claimed"))})
