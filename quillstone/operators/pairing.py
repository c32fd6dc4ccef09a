"""Which documents belong together: tax sources of one year, trial balances that cover a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.cleaning import newest_first

ROLES = {"form_26as": "form", "itr_computation": "computation", "itr_acknowledgement": "acknowledgement"}


def tax_sources(docs: DataFrame) -> DataFrame:
    """The newest 26AS with the newest computation and acknowledgement of the same assessment year.

    docs: filename, doctype, assessment_year, modified. An unknown year pairs with nothing.
    """
    best = newest_first(docs.where(F.col("doctype").isin(*ROLES)), ["doctype", "assessment_year"], "modified", "filename")
    form = newest_first(best.where("doctype = 'form_26as'").withColumn("one_", F.lit(1)), ["one_"], "modified", "filename").select(F.col("filename").alias("form"), "assessment_year")
    out = form
    for kind in ("itr_computation", "itr_acknowledgement"):
        out = out.join(best.where(F.col("doctype") == kind).select("assessment_year", F.col("filename").alias(ROLES[kind])), "assessment_year", "left")
    missing = F.concat_ws(", ", *(F.when(F.col(r).isNull(), F.lit(r)) for r in ROLES.values()))
    return out.select("form", "computation", "acknowledgement", "assessment_year", missing.alias("missing"), F.when(missing == "", "ok").otherwise("incomplete").alias("status"))


def covering_balance(ledgers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each ledger (ledger_id, lo, hi) the first candidate (rank, start, end, filename) whose period holds it.

    Joined by the year in which a ledger begins, which is one of the candidate's years; then by range.
    """
    years = candidates.withColumn("year_", F.explode(F.sequence(F.year("start"), F.year("end"))))
    begun = ledgers.withColumn("year_", F.year("lo"))
    j = begun.join(years, (begun.year_ == years.year_) & (F.col("lo") >= F.col("start")) & (F.col("hi") <= F.col("end")), "left")
    return j.groupBy("ledger_id").agg(F.min_by("filename", "rank").alias("trial_balance"))


def usage(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """used, superseded (a newer one of its type is used) or not used."""
    by_type = chosen.join(docs.select("filename", "doctype"), "filename").select("doctype", F.lit(True).alias("has_")).distinct()
    return docs.join(chosen.select("filename", F.lit(True).alias("used_")), "filename", "left").join(by_type, "doctype", "left").withColumn("usage", F.when(F.col("used_"), "used").when(F.col("has_"), "superseded").otherwise("not used")).drop("used_", "has_")
