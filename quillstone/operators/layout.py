"""Geometry of words on pages: lines, columns, trial-balance rows, continuation rows.

Lines of words are found page by page (a fold, in applyInPandas, or a grid, in an expression); what a line's
words say is then a matter of columns, windows and grouped aggregates.
"""

from __future__ import annotations

import re
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed columns of a trial balance, by the right edge of an amount.
COLUMNS = [("opening", 150, 320), ("debit", 320, 410), ("credit", 410, 490), ("closing", 490, 600)]
_AMOUNT = re.compile(r"^[\d,]+\.\d{2}$")
_TITLE = re.compile(r"^(Opening Transactions Closing|Balance Debit Credit Balance|Trial Balance.*|Page .*|\d{1,2}-[A-Za-z]{3}-\d{2,4} to \d{1,2}-[A-Za-z]{3}-\d{2,4})$")
BALANCE = "doc string, page int, account string, opening double, opening_sign string, debit double, credit double, closing double, closing_sign string"


def lines_of(words: pd.DataFrame, slack: int = 2) -> list[pd.DataFrame]:
    """Words grouped into lines: a line takes words whose rounded top is within slack of its first."""
    words = words.assign(t=words["top"].round()).sort_values(["t", "x0"])
    out: list[list] = []
    anchor = None
    for row in words.itertuples(index=False):
        if anchor is None or abs(anchor - row.t) > slack:
            out.append([])
            anchor = row.t
        out[-1].append(row)
    return [pd.DataFrame(r).sort_values("x0") for r in out]


def numbered(words: DataFrame, slack: int = 2, grid: float | None = None) -> DataFrame:
    """words with line: by tops within slack of a line's first, or by the nearest multiple of grid."""
    if grid:
        return words.withColumn("line", F.round(F.col("top") / grid).cast("long"))

    def page(w: pd.DataFrame) -> pd.DataFrame:
        at, lines, start = w["top"].round(), {}, None
        for t in sorted(at.unique()):
            start = t if start is None or t - start > slack else start
            lines[t] = int(start)
        return w.assign(line=at.map(lines))

    return words.groupBy("doc", "page").applyInPandas(page, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in words.schema), "line long"]))


def trial_balance(words: DataFrame, slack: int = 2, grid: float | None = None) -> DataFrame:
    """The rows of a trial balance from words (doc, page, top, x0, x1, text).

    An amount belongs to the column whose span holds its right edge, the last of a column counting; a sign beside
    an outer amount is that column's. The account is what stands before a line's first amount.
    """
    line = ["doc", "page", "line"]
    order = Window.partitionBy(*line).orderBy("x0", "x1", "text")
    sign = F.col("text").isin("Dr", "Cr")
    w = numbered(words, slack, grid).withColumns({"value": F.when(F.col("text").rlike(_AMOUNT.pattern), F.regexp_replace("text", ",", "").cast("double")), "beside": F.lead(F.when(sign, F.struct("x0", "text"))).over(order)})
    w = w.withColumns({
        "column": F.coalesce(*(F.when(F.col("value").isNotNull() & (F.col("x1") >= lo) & (F.col("x1") < hi), name) for name, lo, hi in COLUMNS)),
        "sign": F.when(F.col("beside.x0") - F.col("x1") < 15, F.col("beside.text")),
        "said": F.struct("x0", "x1", "text"),
    })
    last = lambda name: F.max_by(F.struct("value", "sign"), F.when(F.col("column") == name, F.struct("x0", "x1")))
    rows = w.groupBy(*line).agg(
        F.sort_array(F.collect_list("said")).alias("all"), F.sort_array(F.collect_list(F.when(~sign & F.col("value").isNull(), F.col("said")))).alias("words"),
        F.min(F.when(F.col("value").isNotNull(), F.col("said"))).alias("first"), *(last(name).alias(name) for name, _, _ in COLUMNS),
    )
    texts = lambda parts: F.array_join(F.transform(parts, lambda x: x["text"]), " ")
    rows = rows.where(F.col("first").isNotNull() & ~texts(F.col("all")).rlike(_TITLE.pattern))
    cells = {"account": texts(F.filter("words", lambda x: x < F.col("first")))}
    for name, _, _ in COLUMNS:
        cells[name] = F.coalesce(F.col(f"{name}.value"), F.lit(0.0))
        cells[f"{name}_sign"] = F.col(f"{name}.sign")
    return rows.select(*("doc", "page"), *(cells[c].alias(c) for c in (f.split()[0] for f in BALANCE.split(", ")[2:])))


def column_bounds(x0: list[float], cluster: float = 12, least_gap: float = 18, widest: int = 20, apart: float = 5) -> list[float]:
    """Boundaries between columns from the left edges of words: clusters of near edges, wide gaps between them, midpoints."""
    xs = sorted(x0)
    if not xs:
        return []
    groups = [[xs[0]]]
    for x in xs[1:]:
        (groups[-1].append(x) if x - groups[-1][-1] <= cluster else groups.append([x]))
    anchors = [median(g) for g in groups]
    gaps = [(b - a, (a + b) / 2) for a, b in zip(anchors, anchors[1:], strict=False)]
    if not gaps:
        return []
    wide = max(least_gap, 2.5 * median(g for g, _ in gaps)) if len(gaps) > 2 else least_gap
    chosen = sorted(m for _, m in sorted((g for g in gaps if g[0] >= wide), reverse=True)[:widest])
    out: list[float] = []
    for m in chosen:
        if not out or m - out[-1] >= apart:
            out.append(m)
    return out


def in_columns(words: DataFrame) -> DataFrame:
    """doc, page, line, cells: the text of each line by inferred column (by a word's centre; the last column takes the rest)."""

    def page(w: pd.DataFrame) -> pd.DataFrame:
        bounds = column_bounds(w["x0"].tolist())
        rows = []
        for i, line in enumerate(lines_of(w)):
            cells = [[] for _ in range(len(bounds) + 1)]
            for x in line.itertuples(index=False):
                cells[sum((x.x0 + x.x1) / 2 >= b for b in bounds)].append(x.text)
            rows.append({"doc": w["doc"].iloc[0], "page": int(w["page"].iloc[0]), "line": i, "cells": [" ".join(c) for c in cells]})
        return pd.DataFrame(rows, columns=["doc", "page", "line", "cells"])

    return words.groupBy("doc", "page").applyInPandas(page, "doc string, page int, line int, cells array<string>")


def continued(rows: DataFrame) -> DataFrame:
    """Rows (doc, page, line, cells) with continuation lines merged into the row before: a line without its first cell and without amounts goes on with the merged row."""

    def page(r: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in r.sort_values("line").itertuples(index=False):
            cells = list(row.cells)
            goes_on = out and len(out[-1]["cells"]) == len(cells) and not cells[0] and any(cells) and not any(_AMOUNT.match(c) for c in cells)
            if goes_on:
                out[-1]["cells"] = [f"{a} {b}".strip() for a, b in zip(out[-1]["cells"], cells, strict=True)]
            else:
                out.append({"doc": row.doc, "page": row.page, "line": row.line, "cells": cells})
        return pd.DataFrame(out, columns=["doc", "page", "line", "cells"])

    return rows.groupBy("doc", "page").applyInPandas(page, "doc string, page int, line int, cells array<string>")


def fragment_groups(headers: list[list[str]], least: float = 0.5) -> list[int]:
    """Group number of each table fragment: the newest group of equal width whose header is similar enough; a header of generic names joins the newest of its width."""
    groups: list[list[str]] = []
    out = []
    for h in headers:
        generic = all(re.fullmatch(r"(?i)(column|col|unnamed)[ _:]*\d*", x or "column") for x in h)
        found = None
        for g in range(len(groups) - 1, -1, -1):
            if len(groups[g]) == len(h):
                alike = sum(a.strip().lower() == b.strip().lower() for a, b in zip(groups[g], h, strict=True)) / max(len(h), 1)
                if generic or alike >= least:
                    found = g
                    break
        if found is None:
            groups.append(h)
            found = len(groups) - 1
        out.append(found)
    return out
