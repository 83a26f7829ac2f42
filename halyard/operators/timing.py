"""Timed trials of a table's computation, with a check that every trial gave the same rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.sources.tables import content_digest


def trials(make, repeats: int = 3, warmups: int = 1, queries: int = 1) -> list[tuple[int, float, float, str]]:
    """(trial, seconds, queries a second, digest of the rows), after warm-ups that do not count."""
    out = []
    for trial in range(-warmups, repeats):
        began = time.perf_counter()
        digest = content_digest(make())
        seconds = time.perf_counter() - began
        if trial >= 0:
            out.append((trial, seconds, queries / seconds, digest))
    return out


def summary(spark: SparkSession, rows: list[tuple[int, float, float, str]]) -> DataFrame:
    """One row: trials, least, median and largest seconds, median rate, and trials whose rows differ
    from the first one's."""
    table = spark.createDataFrame(rows, "trial int, seconds double, qps double, digest string")
    return table.agg(
        F.count(F.lit(1)).alias("trials"), F.min("seconds").alias("least_seconds"), F.median("seconds").alias("median_seconds"), F.max("seconds").alias("most_seconds"), F.median("qps").alias("qps"),
        F.sum((F.col("digest") != F.lit(rows[0][3])).cast("bigint")).alias("repeat_mismatches"),
    )
