"""Consistency checks of sweeps.  Each returns one row with counts of violations, 0 if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _count(condition) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def completeness(sweep: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, duplicate rows by key, expected cells that are missing, and numbers that are not finite."""
    counts = sweep.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    duplicates = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    missing = expected.select(*keys).distinct().join(counts, keys, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    numbers = [f.name for f in sweep.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in numbers]
    odd = sweep.agg(_count(reduce(lambda a, b: a | b, bad) if bad else F.lit(False)).alias("not_finite"))
    return duplicates.join(F.broadcast(missing)).join(F.broadcast(odd))


def one_value(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.count_distinct(column) != 1).cast("bigint").alias("violations"))


def violations(sweep: DataFrame, columns: list[str]) -> DataFrame:
    return sweep.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns])


def accounting(sweep: DataFrame) -> DataFrame:
    """PRE costs the passing rows, ACORN one more than its native count for every graph it searched
    (searches, one if there is no such column), POST its native count; and where a second counter was
    kept (dist_audit), all of them cost what it says."""
    method = F.col("method")
    entries = F.col("searches") if "searches" in sweep.columns else F.lit(1)
    audit = [_count(F.col("dist_exact") != F.col("dist_audit")).alias("audit")] if "dist_audit" in sweep.columns else []
    return sweep.agg(
        _count((method == "pre") & (F.col("dist_exact") != F.col("threshold"))).alias("pre"),
        _count((method == "acorn") & (F.col("dist_exact") != F.col("dist_native") + entries)).alias("acorn"),
        _count((method == "post") & (F.col("dist_exact") != F.col("dist_native"))).alias("post"),
        *audit,
    )


def monotone(sweep: DataFrame, keys: list[str], recall_slack: float = 0.002, dist_slack: float = 1e-9) -> DataFrame:
    """Mean recall and effort must not fall with the budget."""
    means = sweep.groupBy(*keys, "budget").agg(F.avg("recall").alias("recall"), F.avg("dist_exact").alias("dist"))
    order = Window.partitionBy(*keys).orderBy("budget")
    steps = means.select((F.col("recall") - F.lag("recall").over(order)).alias("up"), (F.col("dist") - F.lag("dist").over(order)).alias("more"))
    return steps.agg(_count(F.col("up") < -recall_slack).alias("recall_falls"), _count(F.col("more") < -dist_slack).alias("effort_falls"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks (as many times)."""
    columns = a.columns
    counted = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    per = counted.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return per.agg(F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)).cast("bigint").alias("only_first"), F.coalesce(F.sum(F.when(F.col("_n") < 0, -F.col("_n"))), F.lit(0)).cast("bigint").alias("only_second"))


def inert_budgets(sweep: DataFrame, keys: list[str], k: int, columns: list[str]) -> DataFrame:
    """Budgets up to ceil(k / s - 1e-9) cannot change a POST search: all their rows must be equal."""
    inert = sweep.where(F.col("budget") <= F.ceil(k / F.col("s_achieved") - 1e-9))
    per = inert.groupBy(*keys, "query_id").agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c) for c in columns])
    return per.agg(F.count(F.lit(1)).alias("cells"), _count(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in columns])).alias("differing"))


def unfiltered_identity(sweep: DataFrame, columns: list[str]) -> DataFrame:
    """At s = 1 both correlations filter nothing, so their rows must be equal."""
    at_one = sweep.where(F.col("s_achieved") == 1.0)
    return same_rows(at_one.where("correlation = 'random'").select(*columns), at_one.where("correlation = 'clustered'").select(*columns))


def decomposition_identity(rows: DataFrame, slack: float = 1e-9) -> DataFrame:
    """L = U + N wherever no hit was unreachable."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), _count((F.col("found_unreachable") == 0) & (F.abs(F.col("L") - F.col("U") - F.col("N")) > slack)).alias("broken"), F.coalesce(F.sum("found_unreachable"), F.lit(0)).cast("bigint").alias("unsound"))


def swap_rejection(conditions: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered pairs of different conditions whose identities would let one pass for the other."""
    same = conditions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n = conditions.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("pairs"))
    return n.join(F.broadcast(same.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).cast("bigint").alias("accepted"))))


def repeatable(make, *columns: str) -> bool:
    """Whether a table built twice has equal content."""
    from halyard.sources.tables import content_digest

    return content_digest(make(), *columns) == content_digest(make(), *columns)


def scan_integrity(rows: DataFrame, scan: DataFrame, keys: list[str], columns: list[str], extra: str = "n_scanned") -> DataFrame:
    """Whether a table with one more column belongs to the rows: rows of both, rows without a partner,
    and partners that differ, column by column."""
    other = scan.select(*keys, extra, *[F.col(c).alias(f"{c}_scan") for c in columns])
    joined = rows.select(*keys, *columns).join(other, keys, "left")
    differ = [_count(F.col(extra).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"{c}_scan"))).alias(f"{c}_mismatch") for c in columns]
    return joined.agg(F.count(F.lit(1)).alias("rows"), _count(F.col(extra).isNull()).alias("unmatched"), *differ).join(F.broadcast(scan.agg(F.count(F.lit(1)).alias("scan_rows"))))


def low_selectivity_cells(oracle: DataFrame, s_low: float, s_high: float, effort: str = "oracle_dist", second: str | None = None, slack: float = 1e-9) -> DataFrame:
    """Per method and correlation the median effort at a low and a high selectivity.  Without a second
    measure the low one must cost more; with one it must not be at least as good in both."""
    at = lambda c, s: F.expr(f"percentile({c}, 0.5) FILTER (WHERE abs(s_achieved - {s}) <= {slack} + 1e-5 * {s})")
    cells = oracle.groupBy("method", "correlation").agg(*[at(c, s).alias(f"{name}_{end}") for c, name in ((effort, "d"), (second, "f")) if c for s, end in ((s_low, "low"), (s_high, "high"))])
    from halyard.operators.effort import not_dominated

    passed = not_dominated(F.col("d_low"), F.col("f_low"), F.col("d_high"), F.col("f_high")) if second else F.col("d_low") > F.col("d_high")
    return cells.withColumn("passed", passed)


def same_answers(a: DataFrame, b: DataFrame, effort: str = "dist_native") -> DataFrame:
    """Two runs over the same queries: answers that one has and the other lacks, and the difference of
    their whole effort, which must be nothing each."""
    total = lambda df, name: df.select("query_id", effort).distinct().agg(F.coalesce(F.sum(effort), F.lit(0)).alias(name))
    answers = same_rows(a.select("query_id", "rank", "neighbor_id"), b.select("query_id", "rank", "neighbor_id"))
    spent = total(a, "spent_a").join(F.broadcast(total(b, "spent_b"))).select((F.col("spent_a") - F.col("spent_b")).alias("effort_difference"))
    return answers.join(F.broadcast(spent))
