"""Filter after search: fetch more than k in distance order, keep what passes, fetch more if needed.

The order is exact.  A query's passing neighbours come from one search among the passing rows, and
their places in the order of all rows from one pass that counts, per task, the rows before each; so
no list of all rows is ever formed for a query.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.vectors import distances_between, matrix
from halyard.operators.nearest import STEP_CELLS, best, nearest, query_blocks
from halyard.session import written


def fetch_size(k: int, s: float, round_number: int, n: int, alpha: float = 1.0, growth: float = 2.0) -> int:
    """min(n, max(k, ceil(ceil(alpha k / s) growth^(round - 1))))."""
    if k < 1 or round_number < 1 or alpha <= 0 or growth < 1 or not 0 < s <= 1:
        raise ValueError("fetch size needs k >= 1, round >= 1, alpha > 0, growth >= 1 and s in (0, 1]")
    return min(n, max(k, math.ceil(math.ceil(alpha * k / s) * growth ** (round_number - 1))))


def schedule(k: int, s: float, n: int, max_rounds: int, alpha: float = 1.0, growth: float = 2.0) -> list[int]:
    """The fetch sizes of all rounds up to the one that fetches everything."""
    if max_rounds < 1 or (growth <= 1 and max_rounds > 1):
        raise ValueError("several rounds need a growth above 1")
    out = []
    for r in range(1, max_rounds + 1):
        out.append(fetch_size(k, s, r, n, alpha, growth))
        if out[-1] == n:
            break
    return out


def _search_under(block, k: int, conditions: int):
    """The k nearest of each query under each of several predicates; distances are computed once."""

    def of_partition(batches):
        q_ids, q_vectors, _ = block.value
        kept = [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)] for _ in range(conditions)]
        for batch in batches:
            step = max(1, STEP_CELLS // max(1, len(q_ids)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy()
                d = distances_between(q_vectors, matrix(part.column(1)))
                passes = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), conditions).astype(bool)
                for c in range(conditions):
                    rows = np.flatnonzero(passes[:, c])
                    q, j = np.divmod(np.arange(len(q_ids) * len(rows)), max(1, len(rows)))
                    found = [np.concatenate(x) for x in zip(kept[c], (q, d[:, rows].ravel(), ids[rows][j]))]
                    keep = best(*found, k)
                    kept[c] = [x[keep] for x in found]
        for c, (q, dist, i) in enumerate(kept):
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), c, np.int32)), pa.array(q_ids[q]), pa.array(i), pa.array(dist)], ["condition_index", "query_id", "neighbor_id", "distance"])

    return of_partition


def _count_under(block, found):
    def of_partition(batches):
        q_ids, q_vectors, _ = block.value
        d_of, i_of = found.value  # (conditions, queries, k), padded with infinity
        total = np.zeros(d_of.shape, np.int64)
        for batch in batches:
            step = max(1, STEP_CELLS // max(1, len(q_ids)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(0).to_numpy()
                d = distances_between(q_vectors, matrix(part.column(1)))
                for c, j in np.ndindex(d_of.shape[0], d_of.shape[2]):
                    limit, tie = d_of[c, :, j, None], i_of[c, :, j, None]
                    total[c, :, j] += ((d < limit) | ((d == limit) & (ids[None, :] <= tie))).sum(axis=1)
        c, q, j = np.nonzero(np.isfinite(d_of))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(q_ids[q]), pa.array((j + 1).astype(np.int32)), pa.array(total[c, q, j])], ["condition_index", "query_id", "rank", "place"])

    return of_partition


def places_under(base: DataFrame, queries: DataFrame, k: int, predicates: list) -> DataFrame:
    """``passing_places`` for several predicates at once: condition_index, query_id, rank, neighbor_id,
    distance, place.  Two passes over the base serve all of them."""
    spark = base.sparkSession
    own = written(base.select("vec_id", "embedding", F.array(*[F.coalesce(p, F.lit(False)) for p in predicates]).alias("passes")))
    order = Window.partitionBy("condition_index", "query_id").orderBy("distance", "neighbor_id")
    near, counts = [], []
    for block in query_blocks(queries, None):
        ids = block.value[0]
        row = {int(q): r for r, q in enumerate(ids.tolist())}
        found = own.mapInArrow(_search_under(block, k, len(predicates)), "condition_index int, query_id bigint, neighbor_id bigint, distance double")
        found = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        d, i = np.full((len(predicates), len(ids), k), np.inf), np.full((len(predicates), len(ids), k), -1)
        for r in found.collect():  # conditions x a block of queries x k rows
            d[r.condition_index, row[r.query_id], r["rank"] - 1], i[r.condition_index, row[r.query_id], r["rank"] - 1] = r.distance, r.neighbor_id
        near.append(found)
        part = own.select("vec_id", "embedding").mapInArrow(_count_under(block, spark.sparkContext.broadcast((d, i))), "condition_index int, query_id bigint, rank int, place bigint")
        counts.append(part.groupBy("condition_index", "query_id", "rank").agg(F.sum("place").alias("place")))
    keys = ["condition_index", "query_id", "rank"]
    return reduce(DataFrame.unionByName, near).join(reduce(DataFrame.unionByName, counts), keys)


def passing_places(base: DataFrame, queries: DataFrame, k: int, predicate) -> DataFrame:
    """query_id, rank, neighbor_id, distance of the k nearest passing rows, and place: the position
    of each (from 1) in the order of all rows."""
    return places_under(base, queries, k, [predicate]).drop("condition_index")


def postfilter_effort(base: DataFrame, queries: DataFrame, k: int, predicate, s: float, max_rounds: int = 8, alpha: float = 1.0, growth: float = 2.0) -> DataFrame:
    """query_id, rounds, last_fetch, n_kept, filter_checks of the search in exact order.  s = 0 is
    answered without search: no rounds, nothing kept."""
    if s == 0:
        return queries.select("query_id", F.lit(0).alias("rounds"), F.lit(0).cast("bigint").alias("last_fetch"), F.lit(0).cast("bigint").alias("n_kept"), F.lit(0).cast("bigint").alias("filter_checks"))
    n = base.count()
    sizes = schedule(k, s, n, max_rounds, alpha, growth)
    places = passing_places(base, queries, k, predicate).groupBy("query_id").agg(F.sort_array(F.collect_list("place")).alias("places"))  # k numbers
    rows = queries.select("query_id").join(places, "query_id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<bigint>")))
    kth = F.when(F.size("places") >= k, F.element_at(F.col("places"), F.lit(k) if k else F.lit(1)))
    rounds = F.lit(len(sizes))
    for r in range(len(sizes), 0, -1):
        rounds = F.when(kth <= sizes[r - 1], r).otherwise(rounds)
    before = F.array(*[F.lit(sum(sizes[:r])).cast("bigint") for r in range(len(sizes))])
    out = rows.withColumn("rounds", rounds).withColumn("last_fetch", F.element_at(F.array(*[F.lit(x).cast("bigint") for x in sizes]), F.col("rounds")))
    kept = F.size(F.filter("places", lambda p: p <= F.col("last_fetch"))).cast("bigint")
    checks = F.element_at(before, F.col("rounds")) + F.when(kth <= F.col("last_fetch"), kth).otherwise(F.col("last_fetch"))
    return out.select("query_id", "rounds", "last_fetch", kept.alias("n_kept"), checks.alias("filter_checks"))


def postfilter(base: DataFrame, queries: DataFrame, k: int, predicate, s: float, max_rounds: int = 8, alpha: float = 1.0, growth: float = 2.0) -> DataFrame:
    """The neighbours that the search returns: passing ones within the last fetch."""
    sizes = schedule(k, s, base.count(), max_rounds, alpha, growth)
    places = passing_places(base, queries, k, predicate)
    return places.where(F.col("place") <= sizes[-1]).select("query_id", "rank", "neighbor_id", "distance")


def postfilter_index(search, passing: DataFrame, queries: DataFrame, k: int, s: float, n: int, max_rounds: int = 8, alpha: float = 1.0, growth: float = 2.0) -> DataFrame:
    """Over-fetch over any unfiltered index.  ``search(queries, fetch)`` gives query_id, rank,
    neighbor_id, distance and the query's dist_native; ``passing`` the rows (vec_id) that pass.  Each
    round searches afresh for the queries that have not k passing results yet, and its effort adds up.

    query_id, rank, neighbor_id, distance, rounds, last_fetch, filter_checks, dist_native; a query
    without any result has one row with null rank."""
    if s == 0:
        none = F.lit(None)
        return queries.select("query_id", none.cast("int").alias("rank"), none.cast("bigint").alias("neighbor_id"), none.cast("double").alias("distance"), F.lit(0).alias("rounds"), *[F.lit(0).cast("bigint").alias(c) for c in ("last_fetch", "filter_checks", "dist_native")])
    ok = passing.select(F.col("vec_id").alias("neighbor_id"), F.lit(1).alias("ok"))
    walk = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most a fetch
    waiting, spent, answers = queries, [], []
    sizes = schedule(k, s, n, max_rounds, alpha, growth)
    for number, fetch in enumerate(sizes, 1):
        found = search(waiting, fetch).join(ok, "neighbor_id", "left").withColumn("nth", F.sum(F.coalesce("ok", F.lit(0))).over(walk))
        found = written(found.select("query_id", F.col("rank").alias("place"), "neighbor_id", "distance", "dist_native", "ok", "nth"))
        checks = F.coalesce(F.min(F.when(F.col("nth") >= k, F.col("place"))), F.count(F.lit(1)))
        per = found.groupBy("query_id").agg(F.max("nth").alias("passed"), checks.cast("bigint").alias("filter_checks"), F.max("dist_native").alias("dist_native"))
        per = written(waiting.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("filter_checks", F.lit(0)).alias("filter_checks"), F.coalesce("dist_native", F.lit(0)).alias("dist_native"), F.lit(number).alias("round"), F.lit(fetch).cast("bigint").alias("fetch")))
        spent.append(per)
        over = per if number == len(sizes) else per.where(F.col("passed") >= k)
        kept = found.where((F.col("ok") == 1) & (F.col("nth") <= k)).join(over.select("query_id"), "query_id", "left_semi")
        answers.append(kept.select("query_id", F.col("nth").cast("int").alias("rank"), "neighbor_id", "distance"))
        if number < len(sizes):
            waiting = waiting.join(per.where(F.col("passed") < k).select("query_id"), "query_id", "left_semi")
            if waiting.isEmpty():
                break
    effort = reduce(DataFrame.unionByName, spent).groupBy("query_id").agg(F.max("round").alias("rounds"), F.max("fetch").alias("last_fetch"), F.sum("filter_checks").alias("filter_checks"), F.sum("dist_native").alias("dist_native"))
    return effort.join(reduce(DataFrame.unionByName, answers), "query_id", "left").select("query_id", "rank", "neighbor_id", "distance", "rounds", "last_fetch", "filter_checks", "dist_native")
