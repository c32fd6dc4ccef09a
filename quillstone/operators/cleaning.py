"""Cleaning of extracted tables: headers, separator rows, null tokens, quality gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.exprs import NULL_TOKENS, csv_safe

PROVENANCE = ["__source_page", "__table_index"]
TABLE_GATE, TEXT_GATE = 0.15, 0.1


def unique_names(names: list[str]) -> list[str]:
    """Trimmed header names, numbered where blank or repeated."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names, 1):
        n = re.sub(r"\s+", " ", n or "").strip() or f"column_{i}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def normal(x: Column) -> Column:
    """White space squeezed; null tokens to null."""
    t = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(~t.isin(NULL_TOKENS), t)


def numeric_share(cells: Column) -> Column:
    full = F.filter(cells, lambda c: c.isNotNull() & (c != ""))
    hits = F.filter(full, lambda c: c.rlike(r"^[\d,.()\-\s]+$"))
    return F.try_divide(F.size(hits), F.size(full))


def is_header(cells: Column) -> Column:
    return F.coalesce(numeric_share(cells) < 0.3, F.lit(False))


def is_separator(line: Column) -> Column:
    t = F.trim(line)
    return (t == "") | ((F.length(t) >= 5) & t.rlike(r"^[-=_|.\s]+$"))


def is_page_marker(line: Column) -> Column:
    return line.rlike(r"(?i)\bpage\s+\d+")


def split_pipes(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Cells split at '|' and flattened, padded with nulls to the widest row."""
    flat = rows.withColumn(cells, F.flatten(F.transform(cells, lambda c: F.transform(F.split(c, r"\|"), lambda x: F.trim(x)))))
    width = flat.agg(F.coalesce(F.max(F.size(cells)), F.lit(0)).alias("width"))  # one row
    return flat.crossJoin(F.broadcast(width)).withColumn(cells, F.concat(cells, F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.size(cells)))).drop("width")


def clean(df: DataFrame) -> DataFrame:
    """Text cells normal and safe for spreadsheets; rows that are empty, separators, page markers or the header again are dropped."""
    data = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in PROVENANCE]
    out = df.withColumns({c: normal(F.col(f"`{c}`")) for c in data})
    line = F.concat_ws(" ", *(F.col(f"`{c}`") for c in data))
    header = F.lit(True)
    for c in data:
        header = header & F.coalesce(F.lower(F.col(f"`{c}`")) == c.lower(), F.lit(False))
    return out.where(~is_separator(line) & ~is_page_marker(line) & ~header).withColumns({c: csv_safe(F.col(f"`{c}`")) for c in data})


def quality(df: DataFrame) -> DataFrame:
    """score: share of cells that are not null."""
    data = [c for c in df.columns if c not in PROVENANCE]
    filled = sum((F.count(F.col(f"`{c}`")) for c in data), F.lit(0))
    return df.agg(F.try_divide(filled, F.count(F.lit(1)) * len(data)).alias("score"))


def final_columns(df: DataFrame) -> DataFrame:
    """Without provenance, empty rows and columns that are null everywhere."""
    data = [c for c in df.columns if c not in PROVENANCE]
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(data))).first()
    kept = [c for i, c in enumerate(data) if counts[i]]
    return df.select(*(F.col(f"`{c}`") for c in kept)).dropna("all")


def newest_first(df: DataFrame, keys: list[str], modified: str, name: str) -> DataFrame:
    """One row a key: the newest, ties to the larger name."""
    w = Window.partitionBy(*keys).orderBy(F.col(modified).desc(), F.col(name).desc())
    return df.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")
