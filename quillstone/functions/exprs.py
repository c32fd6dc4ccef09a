"""Column expressions for ledgers and filings; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values of the rules: thresholds, word lists and patterns.
SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
NULL_TOKENS = ["", "-", "--", "NA", "N/A", "nan", "None"]
NOT_OUTPUT_TAX = r"(?i)input|payable|receivable|claim|credit|itc|reverse|rcm|late\s*fee|interest|penalt|refund|paid|reversal"
CGST = r"(?i)\bcgst\b|\bcentral\s*tax\b"
SGST = r"(?i)\bsgst\b|\butgst\b|\bstate(?:/ut)?\s*tax\b"
IGST = r"(?i)\bigst\b|\bintegrated\s*tax\b"
NON_SALES = r"(?i)^\s*journal\s*$|purchase|debit\s*note|payment|contra"
ROUNDING = r"(?i)round(?:ing|ed)?[\s\-/]*off|rounding"
LINE_AMOUNT = r"(?i)(?:Rs\.?\s*)?((?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d+)?)\s*(Dr|Cr)\b"
MONTH_LINE = r"(?i)^(January|February|March|Apri[l;]?|May|June|July|August|September|October|November|December)(\s+\d{4})?$"
BENFORD_PERCENT = [30.1, 17.6, 12.5, 9.7, 7.9, 6.7, 5.8, 5.1, 4.6]


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x) -> Column:
    return F.nullif(F.trim(c(x)), F.lit(""))


def let(x, f) -> Column:
    """f of x with x computed once: repeated use would copy its expression each time."""
    return F.transform(F.array(c(x)), f)[0]


def indian_number(x) -> Column:
    """Signed number from an accounting string; null where it is none."""

    def cut(s, hit, start, end):
        return F.struct(F.when(hit, F.trim(F.substring(s, F.lit(1 + start), F.length(s) - start - end))).otherwise(s).alias("s"), hit.alias("neg"))

    bracket = lambda s: cut(s, s.startswith("(") & s.endswith(")"), 1, 1)
    tail = lambda a: F.struct(let(a["s"], lambda s: cut(s, s.endswith("-"), 0, 1)).alias("x"), a["neg"].alias("neg"))
    head = lambda a: F.struct(let(a["x"]["s"], lambda s: cut(s, s.startswith("-"), 1, 0)).alias("x"), (a["neg"] | a["x"]["neg"]).alias("neg"))

    def number(a):
        # "Rs. 500" keeps the full stop of its abbreviation and is no number
        value = let(F.regexp_replace(a["x"]["s"], r"[^0-9.]", ""), lambda t: F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double")))
        return F.when(a["neg"] | a["x"]["neg"], -value).otherwise(value)

    return let(F.trim(c(x)), lambda s: F.when(~s.isin(NULL_TOKENS), let(let(let(bracket(s), tail), head), number)))


def plain_amount(x) -> Column:
    """Comma-separated amount; blank, '-' and unreadable count as 0."""
    return F.coalesce(F.regexp_replace(F.trim(c(x)), ",", "").try_cast("double"), F.lit(0.0))


def any_date(x) -> Column:
    """Date from d-Mon-yy, d-Mon-yyyy, yyyy-MM-dd or dd/MM/yyyy."""
    s = F.trim(c(x))
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in ("d-MMM-yy", "d-MMM-yyyy", "yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy"))).cast("date")


def fiscal_year(d) -> Column:
    """April to March, as 2025-26."""
    y = F.year(F.add_months(c(d), -3))
    return F.format_string("%d-%02d", y, F.pmod(y + 1, F.lit(100)))


def month_name(d) -> Column:
    return F.date_format(c(d), "MMMM")


def period_ordinal(d) -> Column:
    return F.year(F.add_months(c(d), -3)) * 12 + F.pmod(F.month(c(d)) - 4, F.lit(12))


def range_label(lo, hi) -> Column:
    lo, hi = c(lo), c(hi)
    whole = (F.month(lo) == 4) & (F.dayofmonth(lo) == 1) & (F.month(hi) == 3) & (F.dayofmonth(hi) == 31) & (F.year(hi) == F.year(lo) + 1)
    return F.when(lo.isNull() | hi.isNull(), "Unknown period").when(whole, F.concat(F.lit("FY"), fiscal_year(lo))).otherwise(F.concat(F.date_format(lo, "dd MMM yyyy"), F.lit(" to "), F.date_format(hi, "dd MMM yyyy")))


def first_digit(x) -> Column:
    return F.nullif(F.regexp_extract(F.abs(c(x)).cast("string"), "[1-9]", 0), F.lit("")).cast("int")


def is_round(x, multiple: int = 10000) -> Column:
    return c(x) % multiple == 0


def amount_severity(x) -> Column:
    a = F.abs(c(x))
    return F.when(a >= 1_000_000, "CRITICAL").when(a >= 100_000, "HIGH").when(a >= 10_000, "MEDIUM").otherwise("LOW")


def rank_of(sev) -> Column:
    """0 for NONE to 4 for CRITICAL."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c(sev)).cast("int") - 1


def severity_of(rank) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (c(rank) + 1).cast("int"))


def escalate(sev, steps=1) -> Column:
    return severity_of(F.least(rank_of(sev) + steps, F.lit(4)))


def worst(sevs) -> Column:
    """The largest severity of an array, LOW if it is empty."""
    return severity_of(F.coalesce(F.array_max(F.transform(c(sevs), rank_of)), F.lit(1)))


def percent_severity(mismatch, reference) -> Column:
    m, r = c(mismatch).cast("double"), c(reference).cast("double")
    pct = F.abs(F.try_divide(m, r)) * 100
    return F.when(r == 0, F.when(m != 0, "CRITICAL").otherwise("NONE")).when(pct >= 30, "CRITICAL").when(pct >= 10, "HIGH").when(pct > 0, "MEDIUM").otherwise("NONE")


def gap_severity(n) -> Column:
    return F.when(c(n) >= 10, "HIGH").when(c(n) >= 5, "MEDIUM").otherwise("LOW")


def rank_severity(fraction) -> Column:
    f = c(fraction)
    return F.when(f <= 0.01, "high").when(f <= 0.03, "medium").when(f <= 0.05, "low")


def mad_band(mad, short: bool = False) -> Column:
    names = ["Close", "Acceptable", "Marginal", "Nonconformity"] if short else ["Close conformity", "Acceptable conformity", "Marginally acceptable", "Nonconformity"]
    m = c(mad)
    return F.when(m < 0.006, names[0]).when(m < 0.012, names[1]).when(m < 0.015, names[2]).when(m.isNotNull(), names[3])


def tax_head(account) -> Column:
    a = c(account)
    return F.when(a.rlike(NOT_OUTPUT_TAX), F.lit(None)).when(a.rlike(CGST), "cgst").when(a.rlike(SGST), "sgst").when(a.rlike(IGST), "igst")


def is_rounding_account(account) -> Column:
    return c(account).rlike(ROUNDING)


def counts_as_sale(vch_type) -> Column:
    return ~c(vch_type).rlike(NON_SALES)


def is_sales_type(vch_type) -> Column:
    return F.lower(c(vch_type)).contains("sale") & counts_as_sale(vch_type)


def invoice_rounding(account, amount) -> Column:
    return is_rounding_account(account) & (F.abs(c(amount)) < 1)


def voucher_prefix(no) -> Column:
    s = F.trim(c(no))
    return F.when(s.rlike(r"\d$"), F.regexp_extract(s, r"^(.*?)(\d+)$", 1))


def voucher_number(no) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c(no)), r"^(.*?)(\d+)$", 2), F.lit("")).try_cast("decimal(38,0)")


def is_debit(dr_cr) -> Column:
    return F.lower(F.trim(c(dr_cr))).startswith("d")


def day_of_month(text) -> Column:
    p = F.split(F.trim(c(text)), "-")
    two = F.try_element_at(p, F.lit(1))
    three = F.try_element_at(p, F.lit(3))
    return F.when((F.size(p) > 1) & two.rlike(r"^\d{1,2}$"), two.cast("double")).when((F.size(p) == 3) & three.rlike(r"^\d+$"), three.cast("double")).otherwise(F.lit(15.0))


def parsed_line(text) -> Column:
    """struct of status, amount, direction and particulars of a day-book line."""

    def parts(t):
        status = F.when(t == "", "empty").when(t.rlike(MONTH_LINE), "period_marker").when(t.rlike(LINE_AMOUNT), "parsed").otherwise("unparsed")
        return let(status, lambda s: F.struct(
            s.alias("status"),
            F.when(s == "parsed", indian_number(F.regexp_extract(t, LINE_AMOUNT, 1))).alias("amount"),
            F.when(s == "parsed", F.initcap(F.regexp_extract(t, LINE_AMOUNT, 2))).alias("direction"),
            F.when(s == "parsed", let(F.split(t, LINE_AMOUNT, 2), lambda p: F.trim(F.concat_ws(" ", F.trim(p[0]), F.trim(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))))))).otherwise(t).alias("particulars"),
        ))

    return let(F.trim(F.coalesce(c(text), F.lit(""))), parts)


def line_status(text) -> Column:
    return parsed_line(text)["status"]


def csv_safe(x) -> Column:
    return F.when(c(x).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c(x))).otherwise(c(x))


def slug(x) -> Column:
    return F.regexp_replace(c(x), "[^A-Za-z0-9._-]+", "_")


def plain_reason(x) -> Column:
    """A reason without its leg suffix and with its rule code spelled out."""
    return F.regexp_replace(F.regexp_replace(c(x), r"\s*\(leg \d+\)$", ""), r"^matches voucher\(s\) (.+?) on ", "same as $1 on ")


def plain_why(x) -> Column:
    return F.array_join(F.array_distinct(F.transform(F.split(c(x), "; "), plain_reason)), "; ")


#: SQL-visible helpers; they are inlined like any expression.
SQL_FUNCTIONS = {
    "amount_severity": "(x DOUBLE) RETURNS STRING RETURN CASE WHEN abs(x) >= 1000000 THEN 'CRITICAL' WHEN abs(x) >= 100000 THEN 'HIGH' WHEN abs(x) >= 10000 THEN 'MEDIUM' ELSE 'LOW' END",
    "first_digit": "(x DOUBLE) RETURNS INT RETURN CAST(nullif(regexp_extract(CAST(abs(x) AS STRING), '[1-9]', 0), '') AS INT)",
    "percent_severity": "(m DOUBLE, r DOUBLE) RETURNS STRING RETURN CASE WHEN r = 0 THEN CASE WHEN m <> 0 THEN 'CRITICAL' ELSE 'NONE' END WHEN abs(try_divide(m, r)) * 100 >= 30 THEN 'CRITICAL' WHEN abs(try_divide(m, r)) * 100 >= 10 THEN 'HIGH' WHEN abs(try_divide(m, r)) * 100 > 0 THEN 'MEDIUM' ELSE 'NONE' END",
    "tax_head": f"(account STRING) RETURNS STRING RETURN CASE WHEN account RLIKE r'{NOT_OUTPUT_TAX}' THEN NULL WHEN account RLIKE r'{CGST}' THEN 'cgst' WHEN account RLIKE r'{SGST}' THEN 'sgst' WHEN account RLIKE r'{IGST}' THEN 'igst' END",
    "voucher_prefix": r"(no STRING) RETURNS STRING RETURN CASE WHEN trim(no) RLIKE r'\d$' THEN regexp_extract(trim(no), r'^(.*?)(\d+)$', 1) END",
    "voucher_number": r"(no STRING) RETURNS DECIMAL(38,0) RETURN try_cast(nullif(regexp_extract(trim(no), r'^(.*?)(\d+)$', 2), '') AS DECIMAL(38,0))",
    "indian_number": r"(x STRING) RETURNS DOUBLE RETURN CASE WHEN regexp_replace(x, r'[^0-9.]', '') RLIKE r'^[0-9]+(\.[0-9]+)?$' THEN CASE WHEN trim(x) RLIKE r'(?s)^\(.*\)$|^-|-$' THEN -1 ELSE 1 END * try_cast(regexp_replace(x, r'[^0-9.]', '') AS DOUBLE) END",
}


def register_sql(spark: SparkSession) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
