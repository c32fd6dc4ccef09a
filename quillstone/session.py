"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

HOME = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, HOME])
    return spark


def builder(name: str = "quillstone") -> SparkSession.Builder:
    """Settings that the plans assume: UTC, adaptive plans and skewed joins split at run time."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
