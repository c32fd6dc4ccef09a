"""Fields of filed returns from their text, as regular expressions over one text column.

A text that lacks a required line is not guessed at: it goes to the
unresolved side with the name of what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed forms of the returns.
AMOUNT = r"([\d,]+\.\d{2})"
DASH = r"([\d,]+\.\d{2}|-)"
SEP = r"(?:\s+|[A-Za-z])"
FIVE = r"\s+".join([AMOUNT] * 5)
GSTR1_FIVE = {
    "b2cs": (r"Total\s+1\s+Net Value\s+" + FIVE, ["b2cs_taxable_value", "b2cs_igst", "b2cs_cgst", "b2cs_sgst", "b2cs_cess"]),
    "total liability": (r"Total Liability \(Outward supplies other than Reverse charge\)\s+" + FIVE, ["total_liability_value", "total_liability_igst", "total_liability_cgst", "total_liability_sgst", "total_liability_cess"]),
}
GSTR3B_TAXABLE = r"Outward taxable supplies \(other than zero rated, nil rated and\s*" + FIVE
PAYMENT = SEP.join(["", AMOUNT, DASH, AMOUNT, DASH, DASH, DASH, DASH, AMOUNT])
SECTION_A = r"(?s)\(A\) Other than reverse charge(.*?)\(B\) Reverse charge"
HEADS = {"cgst": "Central", "sgst": "State/UT", "igst": "Integrated"}
TAN_ROW = r"^(\d+)\s+(.+?)\s+([A-Z]{4}\d{5}[A-Z])\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s*$"
CLAIM_ROW = r"^([A-Z]{4}\d{5}[A-Z])\s+(.+?)\s+(\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s+\S+\s+\S+\s*$"
MONTH_MARKS = {"gstr1": r"Tax period\s+\w+", "gstr3b": r"Year\s+\d{4}-\d{2}"}


def amount(x: Column) -> Column:
    """Amount token to a number; '-' and blank count as 0."""
    t = F.trim(x)
    return F.when(t.isin("-", ""), F.lit(0).cast("decimal(18,2)")).otherwise(F.regexp_replace(t, ",", "").try_cast("decimal(18,2)"))


def field(text, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def _missing(df: DataFrame, required: dict[str, str]) -> Column:
    return F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(name)) for c, name in required.items()))


def gstr1(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, unresolved) of GSTR-1 texts; taxable value is the total liability less non-GST supplies."""
    out = texts.withColumns({"financial_year": field(text, r"Financial year\s+(\d{4}-\d{2})"), "period": field(text, r"Tax period\s+(\w+)"), "arn_date": F.coalesce(field(text, r"ARN date\s+(\d{2}/\d{2}/\d{4})"), F.lit("")), "non_gst_value": amount(field(text, r"-\s*Non-GST\s+" + AMOUNT))})
    for pattern, names in GSTR1_FIVE.values():
        out = out.withColumns({n: amount(field(text, pattern, i)) for i, n in enumerate(names, 1)})
    out = out.withColumn("missing", _missing(out, {"financial_year": "header", "period": "header", "b2cs_taxable_value": "Table 7", "non_gst_value": "Table 8", "total_liability_value": "Total Liability"}))
    good = out.where("missing = ''").withColumns({"taxable_value": F.col("total_liability_value") - F.col("non_gst_value"), **{h: F.col(f"total_liability_{h}") for h in ("igst", "cgst", "sgst", "cess")}})
    return good.drop(text, "missing"), out.where("missing <> ''").select(*[c for c in texts.columns if c != text], "missing")


def gstr3b(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, unresolved) of GSTR-3B texts: outward supplies, and for each head the net payable and what ITC and cash paid."""
    out = texts.withColumns({"financial_year": field(text, r"Year\s+(\d{4}-\d{2})"), "period": field(text, r"Period\s+(\w+)"), "arn_date": F.coalesce(field(text, r"Date of ARN\s+(\d{2}/\d{2}/\d{4})"), F.lit("")), "non_gst_value": amount(field(text, r"Non-GST outward supplies\s+" + AMOUNT)), "section_": field(text, SECTION_A)})
    out = out.withColumns({n: amount(field(text, GSTR3B_TAXABLE, i)) for i, n in enumerate(["taxable_value", "igst", "cgst", "sgst", "cess"], 1)})
    for head, label in HEADS.items():
        row = label + PAYMENT
        paid = [amount(field("section_", row, g)) for g in range(4, 9)]
        out = out.withColumns({f"{head}_payable": amount(field("section_", row, 3)), f"{head}_paid_total": sum(paid[1:], paid[0])})
    out = out.withColumn("missing", _missing(out, {"financial_year": "header", "period": "header", "taxable_value": "Table 3.1(a)", "non_gst_value": "Table 3.1(e)", **{f"{h}_payable": f"{h} payment row" for h in HEADS}}))
    return out.where("missing = ''").drop(text, "section_", "missing"), out.where("missing <> ''").select(*[c for c in texts.columns if c != text], "missing")


def month_blocks(pages: DataFrame, kind: str) -> DataFrame:
    """Pages (doc, page, text) of a bundle to one text a month: a page with the marker begins a block."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("text").rlike(MONTH_MARKS[kind])
    blocks = pages.withColumn("block", F.sum(hit.cast("int")).over(w)).where("block > 0")
    text = F.array_sort(F.collect_list(F.struct("page", "text")))
    return blocks.groupBy("doc", "block").agg(F.array_join(F.transform(text, lambda x: x["text"]), "\n").alias("text"))


def first_of_period(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row a (financial year, period): the first in order, bundles before single months."""
    w = Window.partitionBy("financial_year", "period").orderBy(*order)
    return rows.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def deductors_26as(lines: DataFrame) -> DataFrame:
    """tan, deductor_name, tds_reported_by_deductor from lines (doc, line_no, text) between PART-I and PART-II; the last row of a TAN wins."""
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    t = F.trim("text")
    inside = lines.withColumns({"one": F.max(t.startswith("PART-I").cast("int")).over(w), "two": F.max(t.startswith("PART-II").cast("int")).over(w)}).where("one = 1 and two = 0")
    rows = inside.where(t.rlike(TAN_ROW)).select("doc", "line_no", field(t, TAN_ROW, 3).alias("tan"), F.trim(field(t, TAN_ROW, 2)).alias("deductor_name"), amount(field(t, TAN_ROW, 6)).alias("tds"))
    return rows.groupBy("doc", "tan").agg(F.max_by("deductor_name", "line_no").alias("deductor_name"), F.max_by("tds", "line_no").alias("tds_reported_by_deductor"))


def claims_coi(lines: DataFrame) -> DataFrame:
    """tan, deductor_name (first), tds_claimed_in_itr_share (sum over a TAN's rows)."""
    t = F.trim("text")
    rows = lines.where(t.rlike(CLAIM_ROW)).select("doc", "line_no", F.upper(field(t, CLAIM_ROW, 1)).alias("tan"), F.trim(field(t, CLAIM_ROW, 2)).alias("deductor_name"), field(t, CLAIM_ROW, 4).cast("decimal(18,2)").alias("tds"))
    return rows.groupBy("doc", "tan").agg(F.min_by("deductor_name", "line_no").alias("deductor_name"), F.sum("tds").alias("tds_claimed_in_itr_share"))


def tds_pairs(reported: DataFrame, claimed: DataFrame) -> DataFrame:
    """Both sides by TAN; a missing side is 0.00, the 26AS name wins."""
    a = reported.select("tan", F.col("deductor_name").alias("a_name"), "tds_reported_by_deductor")
    b = claimed.select("tan", F.col("deductor_name").alias("b_name"), "tds_claimed_in_itr_share")
    zero = F.lit(0).cast("decimal(18,2)")
    return a.join(b, "tan", "full").select(F.coalesce("a_name", "b_name", "tan").alias("deductor_name"), "tan", F.coalesce("tds_reported_by_deductor", zero).alias("tds_reported_by_deductor"), F.coalesce("tds_claimed_in_itr_share", zero).alias("tds_claimed_in_itr_share"))


def itr_summary(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select("*", amount(field(text, r"Total Income\s+1A\s+([\d,]+)")).alias("total_income"), amount(field(text, r"Taxes Paid\s+7\s+([\d,]+)")).alias("taxes_paid"))


def fused_headers(lines: DataFrame) -> DataFrame:
    """Lines that hold two dates or a voucher type run into its number."""
    return lines.where(F.col("text").rlike(r"\d{1,2}-[A-Z][a-z]{2}-\d{2}.*\d{1,2}-[A-Z][a-z]{2}-\d{2}") | F.col("text").rlike(r"(Journal|Payment|Receipt|Sales|Purchase)\d"))
