"""Recall, density, homophily, decomposition of recall loss, and sweep scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.operators.ranks import global_rank


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: distinct common ids / k.  Padding (-1) never matches; k = 0 gives 0."""
    if k == 0:
        return found.select("query_id").distinct().withColumn("recall", F.lit(0.0))
    a = found.where("neighbor_id >= 0").select("query_id", "neighbor_id").distinct()
    b = truth.where("neighbor_id >= 0").select("query_id", "neighbor_id").distinct()
    hits = a.join(b, ["query_id", "neighbor_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    every = found.select("query_id").unionByName(truth.select("query_id")).distinct()
    return every.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("recall"))


def recall_of_lists(found: Column, truth: Column, k: int) -> Column:
    keep = lambda c: F.array_distinct(F.filter(c, lambda x: x >= 0))
    return F.lit(0.0) if k == 0 else F.size(F.array_intersect(keep(found), keep(truth))) / F.lit(float(k))


def local_density(neighbours: DataFrame, passing: DataFrame, k: int) -> DataFrame:
    """query_id, local_density: the share of its k nearest (unfiltered) that pass."""
    ok = passing.select(F.col("vec_id").alias("neighbor_id"), F.lit(1.0).alias("ok"))
    near = neighbours.where(F.col("rank") <= k).join(ok, "neighbor_id", "left")
    return near.groupBy("query_id").agg((F.sum(F.coalesce("ok", F.lit(0.0))) / F.lit(float(k))).alias("local_density"))


def zero_fraction(density: DataFrame) -> DataFrame:
    """The share of queries without a passing neighbour."""
    return density.agg(F.avg(F.when(F.col("local_density") == 0, 1.0).otherwise(0.0)).alias("zero_fraction"))


def homophily(edges: DataFrame, passing: DataFrame, k: int, sample: DataFrame | None = None) -> DataFrame:
    """One row: over passing rows (of the sample), the mean share of their first k others that pass;
    0 if none passes.  ``edges`` (src, pos, dst) may hold the row itself, which is skipped."""
    own = passing.select(F.col("vec_id").alias("src"))
    if sample is not None:
        own = own.join(sample.select(F.col("vec_id").alias("src")), "src", "left_semi")
    place = Window.partitionBy("src").orderBy("pos")
    others = edges.where("src <> dst").withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    ok = passing.select(F.col("vec_id").alias("dst"), F.lit(1.0).alias("ok"))
    share = others.join(own, "src", "left_semi").join(ok, "dst", "left").groupBy("src").agg((F.sum(F.coalesce("ok", F.lit(0.0))) / F.lit(float(k))).alias("share"))
    return share.agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("homophily"))


def chance_corrected(observed: Column, chance: Column) -> Column:
    """(observed - chance) / (1 - chance); null if chance is 1."""
    return F.when(chance != 1, (observed - chance) / F.when(chance != 1, 1 - chance))


def empirical_p(null: DataFrame, value_col: str, observed: float) -> DataFrame:
    """(1 + draws at least / at most as extreme) / (draws + 1)."""
    n = F.count(F.lit(1)) + 1
    return null.agg(((1 + F.sum((F.col(value_col) >= observed).cast("int"))) / n).alias("p_upper"), ((1 + F.sum((F.col(value_col) <= observed).cast("int"))) / n).alias("p_lower"))


def density_summary(density: DataFrame, s: float, k: int) -> DataFrame:
    """Mean, population variance, binomial variance, dispersion index, shares of 0 and 1."""
    x = F.col("local_density")
    made = density.agg(F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.avg(F.when(x == 0, 1.0).otherwise(0.0)).alias("share_zero"), F.avg(F.when(x == 1, 1.0).otherwise(0.0)).alias("share_one"))
    expected = s * (1 - s) / k
    return made.withColumn("binomial_variance", F.lit(expected)).withColumn("dispersion", F.when(F.lit(expected > 0), F.col("variance") / F.lit(expected if expected > 0 else 1.0)))


def null_moments(null: DataFrame, value_col: str) -> DataFrame:
    return null.agg(F.avg(value_col).alias("mean"), F.stddev_samp(value_col).alias("sd"))


def _at_place(df: DataFrame, value_col: str, keys: list[str], place, name: str) -> DataFrame:
    """The value of each group at place(n) of its n values in ascending order, found by global ranks:
    range partitions spread a large group over tasks."""
    ranked = global_rank(df.select(*keys, value_col), [*keys, value_col], "_place")
    groups = ranked.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = groups.select(*[F.col(k).alias(f"_of_{k}") for k in keys], (F.col("_first") + place(F.col("_n"))).alias("_wanted"))
    same = F.col("_place") == F.col("_wanted")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return ranked.join(own, same).select(*keys, F.col(value_col).alias(name))


def lower_quantile(df: DataFrame, value_col: str, p: float, keys: list[str]) -> DataFrame:
    """The value at place floor(p (n - 1)) of each group, without interpolation."""
    return _at_place(df, value_col, keys, lambda n: F.floor(F.lit(p) * (n - 1)), "quantile")


def upper_median(df: DataFrame, value_col: str, keys: list[str]) -> DataFrame:
    return _at_place(df, value_col, keys, lambda n: F.floor(n / 2), "median")


def attribute_sanity(base: DataFrame, queries: DataFrame, attr: str) -> DataFrame:
    """Attribute value counts with the number of queries that ask for the value, and their selectivity."""
    counts = base.groupBy(attr).agg(F.count(F.lit(1)).alias("n_base"))
    asked = queries.groupBy(attr).agg(F.count(F.lit(1)).alias("n_queries"))
    n = base.agg(F.count(F.lit(1)).alias("n"))
    return counts.join(asked, attr, "left").join(F.broadcast(n)).select(attr, "n_base", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), (F.col("n_base") / F.col("n")).alias("selectivity"))


def decompose(targets: DataFrame, k: int) -> DataFrame:
    """targets: query_id, target, hit, reachable.  Per query the recall loss L, its unreachable part U,
    the part N that was reachable and not found, and how many hits were unreachable (0 if the rules
    are sound; then L = U + N)."""
    valid = F.col("target") >= 0
    hit, reach = valid & F.col("hit"), valid & F.col("reachable")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return targets.groupBy("query_id").agg(
        (count(~hit) / F.lit(float(k))).alias("L"),
        (count(~reach) / F.lit(float(k))).alias("U"),
        (count(reach & ~hit) / F.lit(float(k))).alias("N"),
        count(hit & ~reach).alias("found_unreachable"),
        (count(hit) / F.lit(float(k))).alias("recall"),
    )


def hit_targets(truth: DataFrame, found: DataFrame, reached: DataFrame) -> DataFrame:
    """The input of ``decompose`` from ground truth, results and reachability, all by query."""
    hits = found.where("neighbor_id >= 0").select("query_id", F.col("neighbor_id").alias("target"), F.lit(True).alias("hit")).distinct()
    reach = reached.select("query_id", "target", "reachable").distinct()
    base = truth.select("query_id", F.col("neighbor_id").alias("target"))
    return base.join(hits, ["query_id", "target"], "left").join(reach, ["query_id", "target"], "left").select("query_id", "target", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("reachable", F.lit(False)).alias("reachable"))


def decomposition_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    made = rows.groupBy(*keys).agg(F.avg("L").alias("L"), F.avg("U").alias("U"), F.avg("N").alias("N"), F.avg("recall").alias("recall"), F.sum("found_unreachable").alias("found_unreachable"), F.count(F.lit(1)).alias("queries"))
    return made.withColumn("u_share", F.when(F.col("L") > 0, F.col("U") / F.when(F.col("L") > 0, F.col("L"))))


def score_rows(found: DataFrame, truth: DataFrame, passing: DataFrame, k: int, relative: float = 1e-3) -> DataFrame:
    """Per query: valid ids, ids that fail the filter, distances that differ from the true ones, and
    whether the truth is tied at rank k (it must hold k + 1 ranks for that)."""
    ok = passing.select(F.col("vec_id").alias("neighbor_id"), F.lit(1).alias("ok"))
    real = truth.select("query_id", "neighbor_id", F.col("distance").alias("true_distance"))
    rows = found.where("neighbor_id >= 0").join(ok, "neighbor_id", "left").join(real, ["query_id", "neighbor_id"], "left")
    differs = F.abs(F.col("distance") - F.col("true_distance")) > relative * F.greatest(F.lit(1.0), F.col("true_distance"))
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_valid"), F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("filter_violations"), F.sum(F.coalesce(differs, F.lit(False)).cast("int")).alias("distance_mismatches"))
    edge = truth.where(F.col("rank").isin(k, k + 1)).groupBy("query_id").agg(((F.count(F.lit(1)) == 2) & (F.min("distance") == F.max("distance"))).cast("int").alias("gt_tie_at_k"))
    return per.join(edge, "query_id", "left")


def tally(scored: DataFrame) -> DataFrame:
    """One row over all queries of a run."""
    return scored.agg(
        F.count(F.lit(1)).alias("queries"), F.min("recall").alias("recall_min"), F.avg("recall").alias("recall_mean"), F.max("rounds").alias("rounds_max"), F.sum("filter_violations").alias("filter_violations"), F.sum("distance_mismatches").alias("distance_mismatches")
    )


def structure_record(neighbours: DataFrame, edges: DataFrame, base: DataFrame, passing: DataFrame, cluster_col: str, k_local: int, k_graph: int) -> DataFrame:
    """One row for a condition: mean density and its dispersion, share of queries without a passing
    neighbour, chance-corrected homophily, and clusters that pass in part."""
    counts = base.join(passing.select("vec_id", F.lit(1).alias("ok")), "vec_id", "left").groupBy(cluster_col).agg(F.sum(F.coalesce("ok", F.lit(0))).alias("inside"), F.count(F.lit(1)).alias("size"))
    row = counts.agg((F.sum("inside") / F.sum("size")).alias("s"), F.sum(((F.col("inside") > 0) & (F.col("inside") < F.col("size"))).cast("int")).alias("partial_clusters")).first()
    density = local_density(neighbours, passing, k_local)
    out = density_summary(density, row.s, k_local).join(F.broadcast(zero_fraction(density))).join(F.broadcast(homophily(edges, passing, k_graph)))
    return out.withColumn("kappa", chance_corrected(F.col("homophily"), F.lit(row.s))).withColumn("s_achieved", F.lit(row.s)).withColumn("partial_clusters", F.lit(row.partial_clusters))
