"""Document classification, field extraction and line parsing (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import reconstruct
from quillstone.plans.registry import query
from quillstone.sources.scan import page_lines
from quillstone.sources.views import table

#: Marks of a page-one text in the order in which they are tried.
DOCTYPES = [
    ("itr_acknowledgement", "INDIAN INCOME TAX RETURN ACKNOWLEDGEMENT"),
    ("gstr1", "FORM GSTR-1"),
    ("gstr3b", "Form GSTR-3B"),
]
FORM_26AS = r"(?s)Annual Tax Statement.*Financial Year\s+\d{4}-\d{2}.*?Assessment Year\s+\d{4}-\d{2}"


def doctype(text, ledger):
    """The type of a document from its first page; ledger: whether its pages have ledger headers."""
    out = F.when(ledger, "ledger")
    for name, mark in DOCTYPES:
        out = out.when(text.contains(mark), name)
    out = out.when(text.rlike(FORM_26AS), "form_26as").when(text.rlike(r"(?m)^\s*Trial Balance"), "trial_balance")
    out = out.when(text.contains("Asstt. Year") & (text.contains("Residential Status") | text.contains("Due Date of Filing")), "itr_computation")
    return out.otherwise("unknown")


_CASES = ["FORM GSTR-1 of ", "Form GSTR-3B ", "\nTrial Balance ", "Asstt. Year Residential Status ", "Annual Tax Statement Financial Year 2024-25 and Assessment Year 2025-26 ", "INDIAN INCOME TAX RETURN ACKNOWLEDGEMENT ", "Date Particulars Vch Type ", ""]


@query("h01_ledger_detector", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') >= 1 AND avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) >= 0.4 AS is_ledger FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page FROM events) WHERE page <= 5 GROUP BY user_id")
def h01(spark, d):
    from pyspark.sql import Window

    pages = table(spark, d, "events").withColumn("page", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("page <= 5")
    hit = F.col("event_type") == "click"
    return pages.groupBy("user_id").agg(((F.count_if(hit) >= 1) & (F.avg(hit.cast("double")) >= 0.4)).alias("is_ledger"))


_TYPES = ["gstr1", "gstr3b", "trial_balance", "itr_computation", "form_26as", "itr_acknowledgement", "ledger", "unknown"]


@query("h02_doctype_case", "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END AS doctype FROM documents")
def h02(spark, d):
    k = F.col("doc_id") % 8
    text = F.concat(F.element_at(F.array(*map(F.lit, _CASES)), (k + 1).cast("int")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", doctype(text, text.startswith("Date Particulars Vch Type")).alias("doctype"))


@query("h03_assessment_year", "SELECT doc_id, '20' || lpad(CAST(doc_id % 60 + 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 60 + 11 AS VARCHAR), 2, '0') AS year FROM documents")
def h03(spark, d):
    k = F.col("doc_id") % 60
    head = F.format_string("Assessment Year  20%02d-%02d of ", k + 10, k + 11)
    return table(spark, d, "documents").select("doc_id", F.regexp_extract(F.concat(head, "text"), r"Assessment Year\s+(\d{4}-\d{2})", 1).alias("year"))


@query("h04_field_extraction", "SELECT o_orderkey, '2024-25' AS fy, 'April' AS period, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS total, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE - 100.5 AS taxable FROM orders")
def h04(spark, d):
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.concat(F.lit("Financial year 2024-25\nTax period April\n- Non-GST 100.50\nTotal Liability "), p, F.lit(" 0.00"))
    total = F.regexp_extract(text, r"Total Liability\s+([\d,]+\.\d{2})", 1).cast("double")
    non_gst = F.regexp_extract(text, r"-\s*Non-GST\s+([\d,]+\.\d{2})", 1).cast("double")
    return table(spark, d, "orders").select("o_orderkey", F.regexp_extract(text, r"Financial year\s+(\d{4}-\d{2})", 1).alias("fy"), F.regexp_extract(text, r"Tax period\s+(\w+)", 1).alias("period"), total.alias("total"), (total - non_gst).alias("taxable"))


@query("a05_page_lines", r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc, CAST(line_no AS INTEGER) AS line_no, trim(line) AS text FROM l WHERE trim(line) <> ''""")
def a05(spark, d):
    return page_lines(table(spark, d, "documents"))


@query("a15_profile", "SELECT count(*) AS rows, avg(CASE WHEN regexp_matches(CAST(l_quantity AS VARCHAR), '^[0-9.,()-]+$') THEN 1.0 ELSE 0.0 END) > 0.5 AS quantity_numeric, avg(CASE WHEN regexp_matches(l_returnflag, '^[0-9.,()-]+$') THEN 1.0 ELSE 0.0 END) > 0.5 AS flag_numeric FROM lineitem")
def a15(spark, d):
    numeric = lambda c: F.avg(F.col(c).cast("string").rlike(r"^[0-9.,()\-]+$").cast("double")) > 0.5
    return table(spark, d, "lineitem").agg(F.count("*").alias("rows"), numeric("l_quantity").alias("quantity_numeric"), numeric("l_returnflag").alias("flag_numeric"))


#: Vouchers of a made page.
PAGE = 250


@query("h10_state_machine", f"""WITH v AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, total FROM v JOIN orders ON l_orderkey = o_orderkey)
SELECT 'Journal_' || o_orderkey AS entry_id, unnest(['Account ' || CAST(o_orderkey // {PAGE} AS VARCHAR), 'Cash']) AS particulars, unnest(['Dr', 'Cr']) AS dr_cr, CAST(total AS DOUBLE) AS amount, CAST(o_orderkey // {PAGE} AS VARCHAR) AS pages, 1 AS corroborated, 0 AS conflicts FROM o""")
def h10(spark, d):
    """Ledger pages of a bounded size made of each order's lines, with headers, parsed into vouchers."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    amount = F.format_number(F.col("total"), 2)
    day = F.date_format("o_orderdate", "d-MMM-yy")
    v = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    page = F.floor(F.col("o_orderkey") / PAGE).cast("int")
    lines = v.select(F.lit("ledger").alias("doc"), page.alias("page"), (F.col("o_orderkey") * 2 + 10).alias("line_no"), F.explode(F.array(
        F.struct(F.lit(0).alias("i"), F.concat(day, F.lit(" To (as per details) Journal "), F.col("o_orderkey").cast("string"), F.lit(" "), amount).alias("text")),
        F.struct(F.lit(1).alias("i"), F.concat(F.lit("Cash "), amount, F.lit(" Cr")).alias("text")))).alias("x"))
    lines = lines.select("doc", "page", (F.col("line_no") + F.col("x.i")).alias("line_no"), F.col("x.text").alias("text"))
    heads = o.select(F.lit("ledger").alias("doc"), page.alias("page")).distinct()
    heads = heads.select("doc", "page", F.posexplode(F.array(F.concat(F.lit("Account "), F.col("page").cast("string")), F.lit("Ledger Account"), F.lit("1-Apr-24 to 31-Mar-25"), F.lit("Date Particulars Vch Type Vch No. Debit Credit"))).alias("line_no", "text"))
    pages = heads.select("doc", "page", F.col("line_no").cast("long").alias("line_no"), "text").unionByName(lines)
    legs = reconstruct.reconstruct(pages)["legs"]
    return legs.select("entry_id", "particulars", "dr_cr", F.col("amount").cast("double").alias("amount"), F.array_join(F.col("source_pages").cast("array<string>"), ";").alias("pages"), F.col("corroboration_count").cast("int").alias("corroborated"), F.col("conflicts").cast("int").alias("conflicts"))
