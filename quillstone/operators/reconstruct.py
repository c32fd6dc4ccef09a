"""Vouchers from ledger page lines.

The account of a page is found by array expressions over its header lines.
State never crosses a page, so pages are parsed one by one in mapInArrow, many
to a batch as a group of its own costs more than its lines; merging occurrences into vouchers is windows and groupings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.anomaly import kept

# Fixed forms of ledger lines.
DAY = r"\d{1,2}-[A-Z][a-z]{2}-\d{2,4}"
TYPES = r"Journal|Payment|Receipt|Contra|Sales GST|Sales Cash|Sales|Purchase GST|Purchase|Debit Note|Credit Note"
AMOUNT = r"[\d,]+\.\d{2}"
#: The particulars may be blank, and the type may run into a number that begins with a digit.
HEADER = re.compile(rf"^(?:(?P<date>{DAY})\s+)?(?P<side>To|By)\s+(?:(?P<name>.+?)\s+)?(?P<type>{TYPES})(?:\s+|(?=\d))(?P<no>[A-Za-z0-9_\-]+(?:\s?/[A-Za-z0-9_\-]+)*)\s+(?P<amount>{AMOUNT})(?:\s.*)?$")
#: What may be the first half of a header that goes on in the next line.
BEGUN = re.compile(rf"^(?:{DAY}\s+)?(?:To|By)\s+\S")
LEG = re.compile(rf"^(?P<name>.+?)\s+(?P<amount>{AMOUNT})\s+(?P<dir>Dr|Cr)$")
ORPHAN = re.compile(rf"^(?P<amount>{AMOUNT})\s+(?P<dir>Dr|Cr)$")
STATE = re.compile(rf"^(?:(?P<date>{DAY})\s+)?(?:(?:To|By)\s+)?(?P<kind>Opening Balance|Closing Balance|Brought Forward|Carried Over)\s+(?P<amount>{AMOUNT}).*$")
NOISE = re.compile(r"^(Page \d+|Ledger Account|Date Particulars.*|\d{1,2}-\w{3}-\d{2} to .*)$")
NARRATION = re.compile(r"^(Being|Paid|Towards|Amount|Ch\.? ?No)\b", re.I)

OCCURRENCES = "doc string, page int, line_no long, kind string, voucher int, date string, vch_type string, vch_no string, particulars string, dr_cr string, amount decimal(18,2), text string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "decimal(18,2)": pa.decimal128(18, 2)}
_FOUND = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in OCCURRENCES.split(", "))])


def _whole_lines(rows: list[tuple]) -> list[tuple]:
    """Lines with a header that is wrapped put together with the line that it goes on in."""
    out, skip = [], False
    for here, after in zip(rows, [*rows[1:], None], strict=True):
        if skip:
            skip = False
            continue
        text = here[3].strip()
        if after is not None and BEGUN.match(text) and not HEADER.match(text) and not STATE.match(text) and HEADER.match(f"{text} {after[3].strip()}"):
            text, skip = f"{text} {after[3].strip()}", True
        out.append((*here[:3], text))
    return out


def parse_page(rows: list[tuple], account: str | None = None, told: bool = False) -> list[tuple]:
    """One row a leg, orphan, narration, state event or unresolved line of a page's lines (doc, page, line_no, text) in their order; account names the page's account, which is the first line that is nothing else unless told."""
    out, voucher, active, day = [], 0, None, None
    for doc, page, no, text in _whole_lines(rows):

        def put(kind, particulars=None, dr_cr=None, amount=None, date=None):
            date, kind_of, number_of = active or (date, None, None)  # noqa: B023
            out.append((doc, page, no, kind, voucher if active else None, date, kind_of, number_of, particulars, dr_cr, amount, text))  # noqa: B023

        number = lambda m: Decimal(m["amount"].replace(",", ""))
        if not text or NOISE.match(text):
            active = None
        elif m := STATE.match(text):
            active = None
            day = m["date"] or day
            put("state", particulars=m["kind"], amount=number(m), date=day)
        elif m := HEADER.match(text):
            day = m["date"] or day
            voucher += 1
            active = (day, m["type"], m["no"])
            put("leg", particulars=account or "(page account)", dr_cr="Dr" if m["side"] == "To" else "Cr", amount=number(m))
            if m["name"] and m["name"] != "(as per details)":
                put("narration", particulars=m["name"])
        elif active and (m := ORPHAN.match(text)):
            put("orphan", dr_cr=m["dir"], amount=number(m))
        elif active and (m := LEG.match(text)):
            put("leg", particulars=m["name"], dr_cr=m["dir"], amount=number(m))
        elif active and NARRATION.match(text):
            put("narration")
        elif account is None and not out and not told:
            account = text
        else:
            put("unresolved")
    return out


def parse_pages(batches: Iterable[pa.RecordBatch], told: bool) -> Iterator[pa.RecordBatch]:
    """Pages in a row, each with its lines in their order, parsed one by one; a row with told true names its page's account and the first line to read instead of being a line."""

    def pages():
        held, key = [], None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[:2] != key:
                    yield held
                    held = []
                held.append(r)
                key = r[:2]
        if held:
            yield held

    def batch(out):
        cols = list(zip(*out, strict=True)) or [()] * len(_FOUND)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FOUND, strict=True)], schema=_FOUND)

    out = []
    for page in pages():
        named = next((r for r in page if r[4]), None)
        account, start = (named[3], named[5]) if named else (None, None)
        out += parse_page([r[:4] for r in page if not r[4] and (start is None or r[2] >= start)], account, told)
        if len(out) >= 10_000:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def occurrences(page_lines: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """page_lines: doc, page, line_no, text. accounts (doc, page, account, body_from) names the pages' accounts and where their headers end; else a page's first line that is nothing else is its account."""
    told = accounts is not None
    rows = page_lines.select("doc", "page", "line_no", "text", F.lit(False).alias("told"), F.lit(None).cast("long").alias("body_from"))
    if told:  # beside the lines, so that these are shuffled once
        rows = rows.unionByName(accounts.select("doc", "page", F.lit(None).cast("long").alias("line_no"), F.col("account").alias("text"), F.lit(True).alias("told"), F.col("body_from").cast("long").alias("body_from")))
    rows = rows.repartition("doc", "page").sortWithinPartitions("doc", "page", "line_no")
    return rows.mapInArrow(lambda batches: parse_pages(batches, told), OCCURRENCES)


def merged(found: DataFrame) -> DataFrame:
    """Legs of vouchers: occurrences of one type, number and date are one voucher; the first amount of a leg wins, equal ones corroborate it."""
    legs = found.where("kind = 'leg'").withColumn("base", F.concat_ws("_", "vch_type", "vch_no"))
    place = F.struct("page", "line_no")
    # a window, not a join: found would be parsed again for its other side
    of_base = Window.partitionBy("doc", "base").orderBy("page", "line_no")
    named = legs.withColumn("first_date", F.first("date").over(of_base)).withColumn("entry_id", F.when(F.col("date").isNull() | (F.col("date") == F.col("first_date")), F.col("base")).otherwise(F.concat_ws("_", "base", "date")))
    w = Window.partitionBy("doc", "entry_id", "particulars", "dr_cr").orderBy("page", "line_no")
    won = named.withColumn("first_amount", F.first("amount").over(w))
    same = F.col("amount") == F.col("first_amount")
    return won.groupBy("doc", "entry_id", "particulars", "dr_cr").agg(F.min_by("date", place).alias("first_date"), F.max("first_amount").alias("amount"), F.array_sort(F.collect_list(F.when(same, F.col("page")))).alias("source_pages"), F.count_if(same).alias("corroboration_count"), F.count_if(~same).alias("conflicts"))


def balances(legs: DataFrame) -> DataFrame:
    """Whether debits and credits of a voucher agree to a hundredth."""
    d = F.sum(F.when(F.col("dr_cr") == "Dr", F.col("amount")).otherwise(-F.col("amount")))
    return legs.groupBy("entry_id").agg((F.abs(d) < 0.01).alias("balanced"))


# ---------------------------------------------------------------- accounts of pages
# Fixed forms of page headers.
_COLUMNS = "Date Particulars"
_MARKER = "Ledger Account"
_PERIOD = r"\d{1,2}-[A-Za-z]{3}-\d{2,4}\s+to\s+\d{1,2}-[A-Za-z]{3}-\d{2,4}"
_TITLED = rf"^(.+?)\s+(?:Ledger\s*:|:)\s+{_PERIOD}\s+Page\s+\d+$"
_TAILS = ("CO.", "A/C", "LTD.")
#: Letters of the marker in their order, any of them lost.
_GARBLED = "^" + "".join(f"{x}?" for x in _MARKER.replace(" ", "")) + "$"


def page_headers(page_lines: DataFrame, preamble: tuple[str, ...] = ("ANONYMISED FIRM",)) -> DataFrame:
    """doc, page, account, body_from: the account that a page's header names, and the first line after the column titles.

    Three layouts are known: a name before the marker line (or "<name> Book"
    before the period); a name with the period and page number in one line and
    the rest of it in the next; and a name alone before lines of the period and
    the page number, where exactly one line is left besides the preamble,
    single letters and a garbled marker. Anything else is null, never a guess.
    """
    at = F.min(F.when(F.col("text").contains(_COLUMNS), F.col("line_no")))
    pages = page_lines.withColumn("text", F.trim("text")).where("text <> ''").groupBy("doc", "page").agg(at.alias("titles"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("all"))
    head = F.transform(F.filter("all", lambda x: x["line_no"] < F.col("titles")), lambda x: x["text"])
    pages = pages.select("doc", "page", "titles", F.when(F.col("titles").isNotNull(), head).alias("h"))

    def line(i):
        return F.get("h", i)

    def first(test, name):
        """name(text, place) of the first header line that passes."""
        numbered = F.transform("h", lambda x, i: F.when(test(x, i), F.struct(F.lit(True).alias("hit"), name(x, i).alias("name"))))
        return F.get(F.filter(numbered, lambda x: x["hit"]), F.lit(0))["name"]

    marked = first(lambda x, i: ((x == _MARKER) & (i > 0)) | (x.endswith(" Book") & line(i + 1).rlike(rf"^{DAY}")), lambda x, i: F.when(x == _MARKER, line(i - 1)).otherwise(F.trim(F.regexp_replace(x, " Book$", ""))))

    def titled(x, i):
        rest = F.when(line(i + 1).isin("Book", "Account"), F.lit(None)).otherwise(F.trim(F.regexp_replace(line(i + 1), r"(?<=.)\s+(Account|Book)$", "")))
        return F.concat_ws(" ", F.trim(F.regexp_extract(x, _TITLED, 1)), rest, F.when(line(i + 2).isin(*_TAILS), line(i + 2)))

    split = first(lambda x, i: x.rlike(_TITLED) & line(i + 1).isNotNull(), titled)

    def alone(x, i):
        names = F.filter(F.slice("h", 1, i), lambda n: ~n.isin(*preamble) & ~n.rlike("^[A-Z]$"))
        despaced = F.regexp_replace(F.get(names, F.lit(1)), " ", "")
        fits = (F.size(names) == 1) | ((F.size(names) == 2) & (F.length(despaced) >= 2) & despaced.rlike(_GARBLED))
        return F.when(fits, F.get(names, F.lit(0)))

    bare = first(lambda x, i: x.rlike(rf"^{_PERIOD}$") & line(i + 1).rlike(r"^Page\s+\d+$"), alone)
    return pages.select("doc", "page", F.coalesce(marked, split, bare).alias("account"), (F.col("titles") + 1).alias("body_from"))


def page_balances(page_lines: DataFrame) -> DataFrame:
    """doc, page, brought, carried: what a page brings forward and carries over."""
    said = page_lines.withColumn("text", F.trim("text")).where(F.col("text").rlike(STATE.pattern.replace("?P<", "?<")))
    kind, amount = F.regexp_extract("text", r"(Brought Forward|Carried Over)", 1), F.regexp_replace(F.regexp_extract("text", rf"({AMOUNT})", 1), ",", "").cast("decimal(18,2)")
    return said.groupBy("doc", "page").agg(F.min_by(F.when(kind == "Brought Forward", amount), F.when(kind == "Brought Forward", F.col("line_no"))).alias("brought"), F.max_by(F.when(kind == "Carried Over", amount), F.when(kind == "Carried Over", F.col("line_no"))).alias("carried"))


def headed_pages(pages: DataFrame) -> DataFrame:
    """pages (doc, page, account, brought, carried) with account filled in on pages without a header.

    Such a page takes the account of the next headed page if what it carries
    over is what that page brings forward; otherwise it stays null.
    """
    # from the last page backwards: a frame that ends at the last page is read anew for each page
    ahead = Window.partitionBy("doc").orderBy(F.col("page").desc()).rowsBetween(Window.unboundedPreceding, -1)
    headed = F.when(F.col("account").isNotNull(), F.struct("account", "brought"))
    nxt = F.last(headed, ignorenulls=True).over(ahead)
    out = pages.withColumn("next_", nxt)
    fits = F.col("carried").isNotNull() & F.col("carried").eqNullSafe(F.col("next_.brought"))
    return out.withColumn("account", F.coalesce("account", F.when(fits, F.col("next_.account")))).drop("next_")


def continuations(pages: DataFrame) -> DataFrame:
    """(later, earlier) names of one account: adjacent pages of different names whose balances meet, where that names one account only."""
    w = Window.partitionBy("doc").orderBy("page")
    pair = pages.withColumns({"later": F.lead("account").over(w), "brings": F.lead("brought").over(w), "follows": F.lead("page").over(w)})
    pair = pair.where((F.col("follows") == F.col("page") + 1) & F.col("carried").isNotNull() & F.col("carried").eqNullSafe(F.col("brings")) & (F.col("later") != F.col("account")))
    return pair.groupBy("later").agg(F.min("account").alias("earlier"), F.max("account").alias("other")).where("earlier = other").select("later", "earlier")


def settled(aliases: DataFrame, rounds: int = 10) -> DataFrame:
    """Chains of aliases followed to their ends, doubling the step each round; what still turns in a circle is dropped."""
    now = aliases
    for _ in range(rounds):
        nxt = now.select(F.col("later").alias("earlier"), F.col("earlier").alias("end"))
        now = now.join(nxt, "earlier", "left").select("later", F.coalesce("end", "earlier").alias("earlier")).where("later <> earlier")
        if not now.join(now.select(F.col("later").alias("earlier")), "earlier", "left_semi").limit(1).count():
            break
    return now


# ---------------------------------------------------------------- legs of one voucher
def merge_aliases(legs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Legs (entry_id, particulars, dr_cr, amount, source_pages) where a leg under a short name joins the one under its full name on other pages.

    aliases: short, full. Both must agree in voucher, side and amount, lie on
    disjoint pages, and the short leg must have one such partner only.
    """
    key = ["entry_id", "dr_cr", "amount"]
    short = legs.join(aliases, F.col("particulars") == F.col("short")).select(*key, F.col("particulars").alias("short_"), F.col("source_pages").alias("pages_"), F.col("full").alias("particulars"))
    pair = legs.join(short, [*key, "particulars"]).where(~F.arrays_overlap("source_pages", "pages_"))
    alone = pair.groupBy(*key, "short_").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    pair = pair.join(alone, [*key, "short_"])
    gone = pair.select(*key, F.col("short_").alias("particulars")).distinct()
    more = pair.groupBy(*key, "particulars").agg(F.flatten(F.collect_list("pages_")).alias("more_"))
    kept = legs.join(gone, [*key, "particulars"], "left_anti").join(more, [*key, "particulars"], "left")
    return kept.withColumn("source_pages", F.array_sort(F.concat("source_pages", F.coalesce("more_", F.expr("cast(array() as array<int>)"))))).drop("more_")


def absorb(legs: DataFrame, loose: DataFrame, into) -> tuple[DataFrame, DataFrame]:
    """(legs, loose rows that are left): each loose row (entry_id, dr_cr, amount, page) whose voucher has exactly one leg of the same side and amount satisfying `into` gives it its page; none or several: it stays."""
    key = ["entry_id", "dr_cr", "amount"]
    target = legs.where(into).groupBy(*key).agg(F.count("*").alias("n"), F.min("particulars").alias("particulars")).where("n = 1").drop("n")
    hit = loose.join(target, key)
    more = hit.groupBy(*key, "particulars").agg(F.collect_list("page").alias("more_"))
    out = legs.join(more, [*key, "particulars"], "left").withColumn("source_pages", F.array_sort(F.concat("source_pages", F.coalesce("more_", F.expr("cast(array() as array<int>)"))))).drop("more_")
    return out, loose.join(target, key, "left_anti")


# ---------------------------------------------------------------- one ledger from lines to legs
def reconstruct(page_lines: DataFrame) -> dict[str, DataFrame]:
    """legs, unresolved, state_events and headers of ledgers, from their page lines.

    Headers name the accounts; a page without one takes that of the next headed
    page if balances meet; names of one account are folded into the earlier;
    then pages are parsed and occurrences merged.
    """
    headers = page_headers(page_lines)
    known = kept(headed_pages(headers.join(page_balances(page_lines), ["doc", "page"], "left")))  # a row a page
    same = settled(continuations(known))
    named = known.join(same.withColumnRenamed("later", "account"), "account", "left").withColumn("account", F.coalesce("earlier", "account")).select("doc", "page", "account", "body_from")
    found = occurrences(page_lines, named)
    return {"legs": merged(found), "unresolved": found.where("kind in ('unresolved', 'orphan')"), "state_events": found.where("kind = 'state'"), "headers": named}


def statistics(parts: dict[str, DataFrame]) -> dict[str, int]:
    """Counts of vouchers, legs, unresolved lines, vouchers that do not balance and pages without an account: four numbers and one, whatever the ledger's size."""
    held = balances(parts["legs"])
    one = held.agg(F.count("*").alias("vouchers"), F.count_if(~F.col("balanced")).alias("unbalanced")).first()
    return {"vouchers": one.vouchers, "unbalanced": one.unbalanced, "legs": parts["legs"].count(), "unresolved": parts["unresolved"].count(), "headerless": parts["headers"].where("account is null").count()}
