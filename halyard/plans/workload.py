"""The workload of the registered queries: whole ``embeddings`` as base, every vector whose id is
divisible by 50 as a query, md5-ranked attributes that any SQL engine can repeat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import conditions, effort, nearest, overfetch
from halyard.session import read_table, written

K = 10
SEED = 20261010
GRAPH_DEGREE = 8
BUDGETS = (10, 20, 40, 80, 160, 320)
SELECTIVITIES = (0.1585, 1.0)
METHODS = ("pre", "post")


@dataclass
class Workload:
    base: DataFrame
    queries: DataFrame
    n: int


def load(spark: SparkSession, sf_dir: str) -> Workload:
    base = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    queries = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return Workload(base, queries, base.count())


def ranked(w: Workload, correlation: str = "random") -> DataFrame:
    return conditions.random_ranks(w.base, SEED) if correlation == "random" else conditions.clustered_ranks(w.base, "label", SEED)


def edges(w: Workload) -> DataFrame:
    return written(nearest.knn_edges(w.base, GRAPH_DEGREE))


def grid(spark: SparkSession, w: Workload) -> DataFrame:
    return conditions.conditions(spark, w.n, list(SELECTIVITIES), ["random", "clustered"])


def sweep(spark: SparkSession, w: Workload) -> DataFrame:
    """One row per condition, method, budget and query: recall and effort of searches in exact order
    that look at the first ``budget`` rows (post) or at the passing rows only (pre)."""
    conds = grid(spark, w).orderBy("condition").collect()  # four conditions
    both = ranked(w).withColumnRenamed("rank", "random").join(ranked(w, "clustered").select("vec_id", F.col("rank").alias("clustered")), "vec_id")
    places = overfetch.places_under(both, w.queries, K, [F.col(c.correlation) < c.threshold for c in conds])
    places = places.groupBy("condition_index", "query_id").agg(F.collect_list("place").alias("places"))  # K numbers
    named = spark.createDataFrame([(i, c.condition, c.correlation, c.s_achieved, c.threshold) for i, c in enumerate(conds)], "condition_index int, condition string, correlation string, s_achieved double, threshold bigint")
    cells = w.queries.select("query_id").withColumn("condition_index", F.explode(F.sequence(F.lit(0), F.lit(len(conds) - 1))))
    rows = cells.join(places, ["condition_index", "query_id"], "left").join(F.broadcast(named), "condition_index")
    within = F.size(F.filter(F.coalesce("places", F.array().cast("array<bigint>")), lambda p: p <= F.col("budget")))
    post = rows.withColumn("method", F.lit("post")).withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS)))).withColumn("recall", within / F.lit(float(K))).withColumn("dist_exact", F.least("budget", F.lit(w.n)).cast("bigint"))
    pre = rows.withColumn("method", F.lit("pre")).withColumn("budget", F.lit(0)).withColumn("recall", F.least(F.lit(1.0), F.col("threshold") / F.lit(float(K)))).withColumn("dist_exact", F.col("threshold"))
    out = pre.unionByName(post).withColumn("dist_native", F.col("dist_exact"))
    return written(out.select("condition", "correlation", "s_achieved", "threshold", "method", "budget", "query_id", "recall", "dist_exact", "dist_native"))


def oracles(sweeps: DataFrame, target: float = 0.9) -> DataFrame:
    return effort.oracle(sweeps, target, ["condition", "correlation", "s_achieved", "method"])
