"""Ranks of the first rows of a large table, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the first rows are cut into; each is ranked by itself.
RANGES = 64


def first_ranks(df: DataFrame, by: str, ties: list[str], edges: list[float], most: int, rank: str = "rank") -> DataFrame:
    """The `most` first rows by (by, ties) ascending, with their rank.

    edges cut the values of `by` into ranges, whose rows are counted in one
    pass; a row's rank is the count of the ranges before its own and its number
    in that one. Edges may lie anywhere: they spread the work and nothing else.
    """
    edges = sorted(set(edges))
    place = F.lit(0)
    for e in edges:
        place = place + (F.col(by) > F.lit(e)).cast("int")
    placed = df.withColumn("range_", place)
    sizes = sorted((r["range_"], r["n"]) for r in placed.groupBy("range_").agg(F.count("*").alias("n")).collect())  # a row a range
    before, start = 0, {}
    for i, n in sizes:
        if before < most:
            start[i] = before
        before += n
    if not start:
        return df.limit(0).withColumn(rank, F.lit(0))
    last = max(start)
    kept = placed if last >= len(edges) else placed.where(F.col(by) <= F.lit(edges[last]))
    offset = F.create_map(*(F.lit(x) for pair in start.items() for x in pair))[F.col("range_")]
    number = F.row_number().over(Window.partitionBy("range_").orderBy(by, *ties))
    return kept.withColumn(rank, (offset + number).cast("int")).where(F.col(rank) <= most).drop("range_")


def spread(df: DataFrame, by: str, share: float, ranges: int = RANGES) -> list[float]:
    """About evenly spaced edges over the least share of the values of `by`."""
    at = [share * 1.2 * (i + 1) / ranges for i in range(ranges)]
    return [e for e in (df.agg(F.percentile_approx(by, F.array(*(F.lit(min(x, 1.0)) for x in at)), 10_000)).first()[0] or [])]
