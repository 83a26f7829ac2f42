"""A global order as numbers, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.session import written


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """The rows with their place (from 0) in the order, which must be total.

    Rows are range-partitioned and sorted; a row's place is its place in the partition plus the
    sizes of the partitions before it.  The sizes are one row per partition."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.select("*", *[k.alias(f"_key{i}") for i, k in enumerate(keys)])
    columns = [f"_key{i}" for i in range(len(keys))]
    placed = named.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()).drop(*columns)
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_part").agg(F.max("_at").alias("last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them in the (total) order.

    Sums run within range partitions and start from the totals of the partitions before; those are
    one row per partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return summed.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")
