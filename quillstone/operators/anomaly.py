"""Isolation-forest ranking of ledger legs.

Features are DataFrame expressions; account statistics are grouped and joined
back, not windowed, so a dominant account is pre-aggregated; the few counts of
voucher types are broadcast. Trees are grown
on the driver from one bounded sample (TREES x SAMPLE rows at most) and scored
with mapInArrow. The sample's scores say which rows can be among the first and
cut them into ranges, so that all are scored once and none ranks in a window
over more than a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.operators.ordering import RANGES, first_ranks

TREES, SAMPLE, POOL, SEED, LEAST_ROWS = 200, 256, 20_000, 42, 30
NAMES = ["log_amount", "account_zscore", "is_debit", "day_of_month", "is_round_10k", "vch_type_rarity"]


def features(legs: DataFrame) -> DataFrame:
    """legs of positive amounts with the features; vch_type_rarity only where the ledger has vch_type."""
    log = F.log1p(F.col("amount").cast("double"))
    stats = legs.where("amount > 0").groupBy("account").agg(F.avg(log).alias("mu"), F.stddev_pop(log).alias("sd"))
    out = legs.where("amount > 0").join(stats, "account").withColumns({
        "log_amount": log,
        "account_zscore": (log - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0),
        "is_debit": X.is_debit("dr_cr").cast("double"),
        "day_of_month": F.coalesce(F.dayofmonth("date").cast("double"), F.lit(15.0)),
        "is_round_10k": X.is_round("amount").cast("double"),
    }).drop("mu", "sd")
    if "vch_type" in legs.columns:
        rarity = legs.groupBy("vch_type").agg((1.0 / F.count("*")).cast("double").alias("vch_type_rarity"))
        # a ledger has few types, so a shuffle by them would give one task a type's legs
        out = out.join(F.broadcast(rarity), "vch_type")
    return out


class Forest:
    def __init__(self, x: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(SAMPLE, len(x))
        depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], depth, rng) for _ in range(TREES)]

    @staticmethod
    def _average(n) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def _grow(self, x, depth, rng):
        """Arrays of feature, cut, left child, right child and path length to add at leaves."""
        nodes = []

        def grow(rows, level):
            at = len(nodes)
            nodes.append(None)
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
            if level >= depth or len(rows) <= 1 or not len(spread):
                nodes[at] = (-1, 0.0, 0, 0, level + self._average(len(rows)))
                return at
            f = int(rng.choice(spread))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = grow(rows[rows[:, f] < cut], level + 1)
            right = grow(rows[rows[:, f] >= cut], level + 1)
            nodes[at] = (f, cut, left, right, 0.0)
            return at

        grow(x, 0)
        cols = list(zip(*nodes, strict=True))
        return [np.array(c) for c in cols]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Lower is more anomalous."""
        total = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), int)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                n = at[live]
                at[live] = np.where(x[live, feature[n]] < cut[n], left[n], right[n])
                live = live[feature[at[live]] >= 0]
            total += path[at]
        return -np.exp2(-total / len(self.trees) / self._average(self.size))


def kept(df: DataFrame) -> DataFrame:
    """df computed once: in the shared checkpoint folder where the session has one, else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def flags(rows: DataFrame, share: float = 0.05) -> DataFrame:
    """The most anomalous share with severity bands; none below LEAST_ROWS rows."""
    names = [n for n in NAMES if n in rows.columns]
    pool = rows.select(*names, F.xxhash64("entry_id", "leg_num").alias("h")).orderBy("h").limit(POOL).drop("h").toPandas()
    keep = ["entry_id", "leg_num", "account", "amount", "date", "dr_cr"]
    kind = "entry_id string, leg_num int, account string, amount decimal(18,2), date date, dr_cr string, score double"
    if len(pool) < LEAST_ROWS:
        return rows.select(*keep).limit(0).withColumns({"severity": F.lit(""), "anomaly_score": F.lit(0.0), "anomaly_rank_pct": F.lit(0.0)})
    forest = Forest(pool.to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.asarray(b.column(n)) for n in names], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(forest.score(x))], names=[*keep, "score"])

    scored = rows.select(*keep, *names).mapInArrow(run, kind)
    edges = np.quantile(forest.score(pool.to_numpy(float)), np.linspace(0, min(1.0, 1.5 * share), RANGES + 1)[1:]).tolist()
    n = rows.count()
    first = kept(scored.where(F.col("score") <= edges[-1]))
    if first.count() < int(n * share):  # the sample misled
        first = scored
    top = first_ranks(first, "score", ["entry_id", "leg_num"], edges, int(n * share)).withColumn("fraction", F.col("rank") / n)
    return top.select(*keep, X.rank_severity("fraction").alias("severity"), F.round("score", 6).alias("anomaly_score"), F.round(F.col("fraction") * 100, 2).alias("anomaly_rank_pct"))


def severity_counts(found: DataFrame) -> DataFrame:
    """severity, flags: all three bands, most severe first."""
    bands = found.sparkSession.createDataFrame([(i, s) for i, s in enumerate(("high", "medium", "low"))], "ord int, severity string")
    counts = found.groupBy("severity").agg(F.count("*").alias("flags"))
    return bands.join(counts, "severity", "left").orderBy("ord").select("severity", F.coalesce("flags", F.lit(0)).cast("long").alias("flags"))


def table_order(found: DataFrame) -> DataFrame:
    """Flags as a table shows them: the most anomalous first."""
    return found.orderBy("anomaly_rank_pct", "entry_id", "leg_num")
