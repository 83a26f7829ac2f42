"""Attributes and predicates of controlled selectivity.

A condition is a threshold on a rank attribute, so its mask is the predicate rank < threshold and is
never materialised; masks of one attribute are nested by construction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import random as draws
from halyard.functions.scalars import condition_name
from halyard.operators.ranks import global_rank


def uniform_attribute(spark: SparkSession, n: int, low: int, high: int, seed: int) -> DataFrame:
    """vec_id, attr: the seeded generator's own sequence (drawn on the driver; it is one stream)."""
    return spark.createDataFrame(list(enumerate(draws.uniform_ints(n, low, high, seed))), "vec_id bigint, attr int")


def hashed_attribute(ids: DataFrame, low: int, high: int, seed: int, id_col: str = "vec_id") -> DataFrame:
    """The same distribution from a hash of the id: distributed, and equal in any SQL engine."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col))), 1, 12), 16, 10).cast("bigint")
    return ids.withColumn("attr", (F.lit(low) + F.pmod(number, F.lit(high - low + 1))).cast("int"))


def md5_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col)))


def random_ranks(ids: DataFrame, seed: int, id_col: str = "vec_id") -> DataFrame:
    """A seeded random permutation as column rank."""
    return global_rank(ids, [md5_key(id_col, seed), F.col(id_col)])


def permutation_ranks(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """The seeded generator's own permutation."""
    return spark.createDataFrame(list(enumerate(draws.seeded_permutation(n, seed))), "vec_id bigint, rank bigint")


def clustered_ranks(rows: DataFrame, cluster_col: str, seed: int, id_col: str = "vec_id") -> DataFrame:
    """Whole clusters one after another in seeded order, members in seeded order (seed + 1): a prefix
    of the ranks is some clusters and part of one more."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(cluster_col)))
    return global_rank(rows, [place, F.col(cluster_col), md5_key(id_col, seed + 1), F.col(id_col)])


def kmeans_clusters(vectors: DataFrame, k: int, seed: int, iterations: int = 25, column: str = "embedding") -> DataFrame:
    """vec_id, cluster by Spark ML's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("vec_id", array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(data)
    return model.transform(data).select("vec_id", F.col("prediction").alias("cluster"))


def selectivity_levels(low: float, high: float, count: int) -> list[float]:
    """Log-spaced levels; the last is exactly ``high``."""
    if not 0 < low <= high <= 1 or count < 1:
        raise ValueError("levels need 0 < low <= high <= 1")
    if count == 1:
        return [high]
    a, b = math.log10(low), math.log10(high)
    return [10 ** (a + (b - a) * i / (count - 1)) for i in range(count - 1)] + [high]


def threshold(s: float, n: int) -> int:
    """How many rows pass at selectivity s: rounded half up, at most n; an error if none would."""
    if not 0 < s <= 1:
        raise ValueError(f"selectivity {s} is not in (0, 1]")
    t = min(math.floor(s * n + 0.5), n)
    if t == 0:
        raise ValueError(f"no row of {n} passes at {s}")
    return t


def conditions(spark: SparkSession, n: int, levels: list[float], correlations: list[str]) -> DataFrame:
    """One row per correlation and level: name, threshold and achieved selectivity."""
    rows = [(c, float(s), threshold(s, n)) for c in correlations for s in levels]
    made = spark.createDataFrame(rows, "correlation string, s_requested double, threshold bigint")
    return made.select(condition_name(F.col("correlation"), F.col("s_requested")).alias("condition"), "correlation", "s_requested", "threshold", (F.col("threshold") / F.lit(float(n))).alias("s_achieved"))


def fragmentation_grid(spark: SparkSession, levels: dict[str, int], realizations: int, selectivities: list[float], n: int) -> DataFrame:
    """Level x realization x selectivity, with the cluster count of the level and a seed for each
    (level, realization)."""
    rows = [(name, k, r, 1000 * (i + 1) + r, float(s), threshold(s, n)) for i, (name, k) in enumerate(levels.items()) for r in range(realizations) for s in selectivities]
    grid = spark.createDataFrame(rows, "level string, num_clusters int, realization int, seed bigint, s_requested double, threshold bigint")
    return grid.withColumn("condition", F.format_string("%s_r%d_s%.4f", "level", "realization", "s_requested"))


def passing(ranked: DataFrame, t: int) -> DataFrame:
    """The rows that pass: a pushed-down comparison, never a mask."""
    return ranked.where(F.col("rank") < t)


def integrity(ranked: DataFrame, grid: DataFrame) -> DataFrame:
    """Per condition: rows that pass against the threshold, achieved selectivity, its error bound and
    whether the mask lies in the next larger one."""
    n = ranked.count()
    joined = grid.join(ranked, ranked["rank"] < grid["threshold"])  # a range join of a short grid
    counted = joined.groupBy("condition", "s_requested", "threshold").agg(F.count(F.lit(1)).alias("n_pass"), F.max("rank").alias("last"))
    return counted.select("condition", "s_requested", "threshold", "n_pass", (F.col("n_pass") == F.col("threshold")).alias("exact"), (F.abs(F.col("n_pass") / n - F.col("s_requested")) <= 0.5 / n + 1e-12).alias("within_half"), (F.col("last") < F.col("threshold")).alias("nested"))


def cluster_coverage(ranked: DataFrame, cluster_col: str, t: int) -> DataFrame:
    """One row: clusters spanned by the passing rows, clusters that pass whole, and in part."""
    per = ranked.groupBy(cluster_col).agg(F.sum((F.col("rank") < t).cast("int")).alias("inside"), F.count(F.lit(1)).alias("size"))
    return per.agg(F.sum((F.col("inside") > 0).cast("int")).cast("bigint").alias("spanned"), F.sum((F.col("inside") == F.col("size")).cast("int")).cast("bigint").alias("whole"), F.sum(((F.col("inside") > 0) & (F.col("inside") < F.col("size"))).cast("int")).cast("bigint").alias("partial"))


def query_subset(queries: DataFrame, first: int | None = None, sample: int | None = None, seed: int = 0, id_col: str = "query_id") -> DataFrame:
    """All queries, those with the smallest ids, or a seeded sample."""
    if first is not None:
        return queries.where(F.col(id_col) < first)
    if sample is not None:
        return queries.orderBy(md5_key(id_col, seed), id_col).limit(sample)
    return queries


def split_queries(ids: DataFrame, seed: int, n_train: int, folds: int, id_col: str = "query_id") -> DataFrame:
    """is_train and a fold number by seeded order."""
    ranked = global_rank(ids, [md5_key(id_col, seed), F.col(id_col)], "place")
    return ranked.select("*", (F.col("place") < n_train).alias("is_train"), F.pmod("place", F.lit(folds)).cast("int").alias("fold")).drop("place")


def budget_grid(dense: tuple[int, int, int], sparse: tuple[int, int, int]) -> list[int]:
    """The union of two (first, last, step) ranges, ascending."""
    return sorted({b for first, last, step in (dense, sparse) for b in range(first, last + 1, step)})


def block_order(blocks: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """The blocks of a sweep with their place in a seeded order."""
    return global_rank(blocks, [F.md5(F.concat_ws(":", F.lit(seed), *keys)), *[F.col(k) for k in keys]], "place")


def unit_column(id_col: str, seed: int) -> Column:
    """The deterministic unit hash of an id, vectorised."""
    import pandas as pd

    return F.pandas_udf(lambda ids: pd.Series(draws.unit_hash(ids.to_numpy(), seed)), "double")(F.col(id_col))


def null_draws(ids: DataFrame, draws_wanted: int, s: float, seed: int, id_col: str = "vec_id") -> DataFrame:
    """(draw, vec_id): independent random attributes of selectivity about s, from hashes; one row per
    passing id and draw."""
    drawn = ids.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws_wanted))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", id_col)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    return drawn.where(u < s).select("draw", id_col)


def grid_problems(grid: DataFrame, attributes: DataFrame) -> DataFrame:
    """attributes: level, realization, cluster_hash, attribute_hash.  Levels whose realizations do not
    share one clustering, attributes that are not unique, and conditions without an attribute."""
    levels = attributes.groupBy("level").agg(F.count_distinct("cluster_hash").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).cast("bigint").alias("several_clusterings"))
    repeated = attributes.groupBy("attribute_hash").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).cast("bigint").alias("repeated_attributes"))
    missing = grid.join(attributes, ["level", "realization"], "left_anti").agg(F.count(F.lit(1)).alias("without_attribute"))
    return levels.join(F.broadcast(repeated)).join(F.broadcast(missing))
