"""Effort: oracle budgets, crossings, budget curves and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.scalars import INFINITE, log2_ratio


def oracle(sweep: DataFrame, target: float, keys: list[str]) -> DataFrame:
    """Per key and query the smallest budget whose recall reaches the target, and its effort; none:
    budget null, effort infinite, censored."""
    good = F.when(F.col("recall") >= target - 1e-12, F.struct("budget", "dist_exact"))
    best = sweep.groupBy(*keys, "query_id").agg(F.min(good).alias("best"))
    return best.select(*keys, "query_id", F.col("best.budget").cast("double").alias("oracle_budget"), F.coalesce(F.col("best.dist_exact").cast("double"), F.lit(INFINITE)).alias("oracle_dist"), F.col("best").isNull().alias("censored"))


def effort_at_oracle(best: DataFrame, sweep: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Another effort column at the oracle budget; infinite where censored."""
    there = sweep.select(*keys, "query_id", F.col("budget").cast("double").alias("oracle_budget"), F.col(column).cast("double").alias("value"))
    return best.join(there, [*keys, "query_id", "oracle_budget"], "left").withColumn(f"oracle_{column}", F.when(F.col("censored"), INFINITE).otherwise(F.col("value"))).drop("value")


def budget_curve(sweep: DataFrame, keys: list[str], target: float) -> DataFrame:
    """Mean and median effort, mean recall and the failed share per key and budget."""
    failed = F.when(F.col("recall") < target - 1e-12, 1.0).otherwise(0.0)
    return sweep.groupBy(*keys, "budget").agg(F.avg("recall").alias("mean_recall"), F.avg("dist_exact").alias("mean_dist"), F.expr("percentile(dist_exact, 0.5)").alias("median_dist"), F.avg(failed).alias("failed_fraction"), F.count(F.lit(1)).alias("n"))


def ratio_to_unfiltered(best: DataFrame, keys: list[str], s_col: str = "s_achieved") -> DataFrame:
    """Oracle effort over the same query's effort at s = 1 (same method and correlation)."""
    at_one = best.where(F.col(s_col) == 1.0).select(*keys, "query_id", F.col("oracle_dist").alias("dist_at_one"))
    return best.join(at_one, [*keys, "query_id"]).withColumn("log2_ratio", log2_ratio(F.col("oracle_dist"), F.col("dist_at_one")))


def crossing(curve: DataFrame, keys: list[str], x: str, y: str, target: float) -> DataFrame:
    """The first adjacent pair of points (by x) between which recall y rises to the target, and the
    effort there by linear interpolation in recall."""
    order = Window.partitionBy(*keys).orderBy(x)
    pairs = curve.select(*keys, F.col(x).alias("x_hi"), F.col(y).alias("y_hi"), F.col("effort").alias("e_hi"), F.lag(x).over(order).alias("x_lo"), F.lag(y).over(order).alias("y_lo"), F.lag("effort").over(order).alias("e_lo"))
    found = pairs.where((F.col("y_lo") <= target) & (F.col("y_hi") >= target) & F.col("x_lo").isNotNull())
    first = found.groupBy(*keys).agg(F.min_by(F.struct("x_lo", "x_hi", "y_lo", "y_hi", "e_lo", "e_hi"), "x_hi").alias("p"))
    p = lambda n: F.col(f"p.{n}")
    flat = p("y_hi") == p("y_lo")
    part = F.when(flat, 0.0).otherwise((target - p("y_lo")) / F.when(flat, 1.0).otherwise(p("y_hi") - p("y_lo")))
    return first.select(*keys, p("x_lo").alias("x_lo"), p("x_hi").alias("x_hi"), (p("e_lo") + part * (p("e_hi") - p("e_lo"))).alias("effort"))


def rate_at_recall(points: DataFrame, keys: list[str], recall: str, rate: str, target: float) -> DataFrame:
    """The rate at a recall, log-interpolated between the neighbouring points by recall."""
    order = Window.partitionBy(*keys).orderBy(recall, rate)
    pairs = points.select(*keys, F.col(recall).alias("r1"), F.col(rate).alias("q1"), F.lag(recall).over(order).alias("r0"), F.lag(rate).over(order).alias("q0"))
    found = pairs.where((F.col("r0") <= target) & (F.col("r1") >= target) & (F.col("r1") > F.col("r0")))
    first = found.groupBy(*keys).agg(F.min_by(F.struct("r0", "r1", "q0", "q1"), "r1").alias("p"))
    part = (target - F.col("p.r0")) / (F.col("p.r1") - F.col("p.r0"))
    return first.select(*keys, F.pow(F.lit(10.0), F.log10("p.q0") + part * (F.log10("p.q1") - F.log10("p.q0"))).alias("rate"))


def relative_gap(ours: Column, theirs: Column) -> Column:
    return (ours - theirs) / theirs


def pivoted(best: DataFrame, index: list[str], column: str, values: list[str], value: str = "oracle_dist") -> DataFrame:
    """One column per method (or level): the values are given, so no extra job looks for them."""
    return best.groupBy(*index).pivot(column, values).agg(F.min(value))


def grouping_summary(best: DataFrame, keys: list[str], subgroup: str) -> DataFrame:
    """Median effort and censored share for each subgroup and for all together."""
    names = ", ".join(keys)
    sets = f"GROUPING SETS (({names}, {subgroup}), ({names}))"
    best.createOrReplaceTempView("halyard_oracle")
    return best.sparkSession.sql(f"SELECT {names}, coalesce({subgroup}, 'both') AS {subgroup}, percentile(oracle_dist, 0.5) AS median_dist, avg(CASE WHEN censored THEN 1.0D ELSE 0.0D END) AS censored_share, count(*) AS n FROM halyard_oracle GROUP BY {names}, {subgroup} {sets}")


def not_dominated(d_low: Column, f_low: Column, d_high: Column, f_high: Column) -> Column:
    """False only if the low-selectivity point is no worse in both distance and failures."""
    return ~((d_low <= d_high) & (f_low <= f_high))
