"""Registered consistency checks.  Each is run on tables that are as they should be and on damaged ones,
so a check that finds nothing anywhere is seen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators import checks, conditions, graph_search, metrics, nearest, overfetch, reachability, timing
from halyard.plans import catalog, workload
from halyard.plans.registry import query
from halyard.plans.registry import with_parts as _with
from halyard.plans.workload import BUDGETS, K
from halyard.session import written
from halyard.sources import tables

_KEYS = ["condition", "method", "budget", "query_id"]
#: List sizes of the measured graph searches.
EFS = (20, 60)


def _named(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("table"), *df.columns)


def _both(right: DataFrame, damaged: DataFrame) -> DataFrame:
    return _named("as it is", right).unionByName(_named("damaged", damaged))


# ---- completeness, order, identity of the exact sweep


def _expected(spark: SparkSession, w: workload.Workload) -> DataFrame:
    """The cells a sweep must have: from the grid, not from the sweep."""
    cells = workload.grid(spark, w).select("condition").join(F.broadcast(w.queries.select("query_id")))
    budgets = F.explode(F.array(F.struct(F.lit("pre").alias("method"), F.lit(0).alias("budget")), *[F.struct(F.lit("post").alias("method"), F.lit(b).alias("budget")) for b in BUDGETS]))
    return cells.withColumn("c", budgets).select("condition", "query_id", "c.method", "c.budget")


@query(
    _with(*catalog._SWEEP)
    + f""", cells AS (SELECT (SELECT count(*) FROM conds) * (SELECT count(*) FROM q) * {len(BUDGETS) + 1} AS n, (SELECT count(*) FROM conds) AS c)
SELECT 'as it is' AS "table", n::BIGINT AS rows, 0::BIGINT AS duplicates, 0::BIGINT AS missing, 0::BIGINT AS not_finite FROM cells
UNION ALL SELECT 'damaged', (n - c + c)::BIGINT, c::BIGINT, c::BIGINT, c::BIGINT FROM cells"""
)
def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage: a budget of one query gone, a method of another twice, a number that is none."""
    w = workload.load(spark, sf_dir)
    s, expected = workload.sweep(spark, w), _expected(spark, w)
    bad = s.where("NOT (query_id = 100 AND budget = 40)").unionByName(s.where("method = 'pre' AND query_id = 0"))
    bad = bad.withColumn("recall", F.when((F.col("query_id") == 50) & (F.col("budget") == 320), F.lit(float("nan"))).otherwise(F.col("recall")))
    return _both(checks.completeness(s, expected, _KEYS), checks.completeness(bad, expected, _KEYS))


_STEPS = "SELECT condition, method, budget, avg(recall) AS r, avg(dist) AS d FROM ({rows}) GROUP BY ALL"
_FALLS = "(SELECT sum((r - lag_r < -0.002)::INTEGER)::BIGINT AS a, sum((d - lag_d < -1e-9)::INTEGER)::BIGINT AS b FROM (SELECT r, d, lag(r) OVER w AS lag_r, lag(d) OVER w AS lag_d FROM ({steps}) WINDOW w AS (PARTITION BY condition, method ORDER BY budget)))"
_WORSE = "SELECT condition, method, budget, CASE WHEN budget = 80 AND correlation = 'random' THEN 0 ELSE recall END AS recall, CASE WHEN budget = 160 THEN 1 ELSE dist_exact END AS dist FROM sweep"


@query(_with(*catalog._SWEEP) + f""" SELECT 'as it is' AS "table", a AS recall_falls, b AS effort_falls FROM {_FALLS.format(steps=_STEPS.format(rows='SELECT condition, method, budget, recall, dist_exact AS dist FROM sweep'))}
UNION ALL SELECT 'damaged', a, b FROM {_FALLS.format(steps=_STEPS.format(rows=_WORSE))}""")
def monotone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = workload.sweep(spark, workload.load(spark, sf_dir))
    bad = s.withColumn("recall", F.when((F.col("budget") == 80) & (F.col("correlation") == "random"), 0.0).otherwise(F.col("recall")))
    bad = bad.withColumn("dist_exact", F.when(F.col("budget") == 160, 1).otherwise(F.col("dist_exact")))
    return _both(checks.monotone(s, ["condition", "method"]), checks.monotone(bad, ["condition", "method"]))


@query(_with(*catalog._SWEEP) + """, changed AS (SELECT count(*) AS n FROM sweep WHERE correlation = 'clustered' AND s_achieved = 1 AND query_id = 50)
SELECT 'as it is' AS "table", 0::BIGINT AS only_first, 0::BIGINT AS only_second FROM changed UNION ALL SELECT 'damaged', n, n FROM changed""")
def unfiltered_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, columns = workload.sweep(spark, workload.load(spark, sf_dir)), ["method", "budget", "query_id", "recall", "dist_exact"]
    bad = s.withColumn("dist_exact", F.col("dist_exact") + F.when((F.col("correlation") == "clustered") & (F.col("query_id") == 50), 1).otherwise(0))
    return _both(checks.unfiltered_identity(s, columns), checks.unfiltered_identity(bad, columns))


_CONDS = catalog._SWEEP[6]


@query(_with(catalog._N, _CONDS) + """, p AS (SELECT count(*) * (count(*) - 1) AS pairs FROM conds)
SELECT 'whole identity' AS identity, pairs::BIGINT AS pairs, (SELECT coalesce(sum(c * (c - 1)), 0) FROM (SELECT count(*) AS c FROM conds GROUP BY correlation, threshold))::BIGINT AS accepted FROM p
UNION ALL SELECT 'threshold alone', pairs::BIGINT, (SELECT coalesce(sum(c * (c - 1)), 0) FROM (SELECT count(*) AS c FROM conds GROUP BY threshold))::BIGINT FROM p""")
def swap_rejection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of one condition must not pass for another's; by the threshold alone they would."""
    grid = workload.grid(spark, workload.load(spark, sf_dir))
    one = checks.swap_rejection(grid, ["correlation", "threshold"]).withColumn("identity", F.lit("whole identity"))
    return one.unionByName(checks.swap_rejection(grid, ["threshold"]).withColumn("identity", F.lit("threshold alone")))


_INERT = f"""eff AS (SELECT c.condition, c.s_achieved, b::INTEGER AS budget, query_id, greatest(b, least(n, greatest({K}, ceil({K} / c.s_achieved)))) AS size FROM conds c, q, n, (VALUES {', '.join(f'({b})' for b in BUDGETS)}) AS budgets(b)),
res AS (SELECT e.*, (SELECT count(*) FROM places WHERE places.condition = e.condition AND places.query_id = e.query_id AND place <= size) AS kept FROM eff e)"""
_INERT_CELLS = "SELECT count(*) AS cells, coalesce(sum((a > 1 OR k > 1)::INTEGER), 0)::BIGINT AS differing FROM (SELECT condition, query_id, count(DISTINCT size) AS a, count(DISTINCT kept) AS k FROM res WHERE budget <= ceil({k} / s_achieved - 1e-9) GROUP BY ALL)"


@query(_with(*catalog._SWEEP[:-1], _INERT) + f" SELECT 'k' AS bound, * FROM ({_INERT_CELLS.format(k=K)}) UNION ALL SELECT '8 k', * FROM ({_INERT_CELLS.format(k=8 * K)})")
def inert_budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list shorter than the first fetch changes nothing; one beyond it does, so a bound eight times
    too high must be caught."""
    w = workload.load(spark, sf_dir)
    s = workload.sweep(spark, w).where("method = 'post'").select("condition", "s_achieved", "query_id").distinct()
    conds = workload.grid(spark, w).orderBy("condition").collect()  # four conditions
    both = workload.ranked(w).withColumnRenamed("rank", "random").join(workload.ranked(w, "clustered").select("vec_id", F.col("rank").alias("clustered")), "vec_id")
    places = overfetch.places_under(both, w.queries, K, [F.col(c.correlation) < c.threshold for c in conds])
    names = spark.createDataFrame([(i, c.condition, overfetch.fetch_size(K, c.s_achieved, 1, w.n)) for i, c in enumerate(conds)], "condition_index int, condition string, fetch bigint")
    rows = s.join(F.broadcast(names), "condition").withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS)))).withColumn("size", F.greatest("budget", "fetch"))
    near = places.select("condition_index", "query_id", "place")
    kept = rows.join(near, ["condition_index", "query_id"], "left").groupBy("condition", "s_achieved", "query_id", "budget", "size").agg(F.sum(F.when(F.col("place") <= F.col("size"), 1).otherwise(0)).alias("kept"))
    return reduce(DataFrame.unionByName, [checks.inert_budgets(kept, ["condition"], k, ["size", "kept"]).select(F.lit(name).alias("bound"), "cells", "differing") for name, k in (("k", K), ("8 k", 8 * K))])


# ---- measured searches


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that really ran, with their own counters: before filtering over the passing rows,
    a graph under the predicate, and over-fetch from an unfiltered graph."""
    w = workload.load(spark, sf_dir)
    hnsw = written(graph_search.build_index(w.base, "hnsw", m=12, ef=40))
    acorn = written(graph_search.build_index(w.base, "acorn", m=8, gamma=4, m_beta=16))
    ranks = written(workload.ranked(w))
    out = []
    for c in workload.grid(spark, w).where("correlation = 'random'").collect():  # two conditions
        base, ok = ranks.select("vec_id", "embedding", "rank"), F.col("rank") < c.threshold
        truth = written(nearest.nearest(base.where(ok), w.queries, K))
        spent = base.agg(F.sum(ok.cast("bigint")).alias("dist_exact"))
        pre = truth.join(F.broadcast(spent)).select(F.lit("pre").alias("method"), F.lit(0).alias("budget"), "query_id", "rank", "neighbor_id", "distance", "dist_exact", F.col("dist_exact").alias("dist_native"), F.col("dist_exact").alias("dist_audit"), F.lit(0).cast("bigint").alias("n_scanned"), F.lit(1).cast("bigint").alias("searches"))
        out.append(pre.withColumn("condition", F.lit(c.condition)).withColumn("threshold", F.lit(c.threshold)))
        for ef in EFS:
            found = graph_search.search_index(base, acorn, w.queries, K, ef, "acorn", ok, m=8, gamma=4, m_beta=16, traced=True).drop("seed0", "shard", "seed")
            out.append(found.select(F.lit("acorn").alias("method"), F.lit(ef).alias("budget"), F.lit(c.condition).alias("condition"), F.lit(c.threshold).alias("threshold"), *found.columns))

            def search(queries: DataFrame, fetch: int, ef: int = ef) -> DataFrame:
                return graph_search.search_index(w.base, hnsw, queries, fetch, max(ef, fetch), "hnsw", m=12)

            post = overfetch.postfilter_index(search, base.where(ok), w.queries, K, c.s_achieved, w.n, max_rounds=3).where("rank IS NOT NULL")
            out.append(post.select(F.lit("post").alias("method"), F.lit(ef).alias("budget"), F.lit(c.condition).alias("condition"), F.lit(c.threshold).alias("threshold"), "query_id", "rank", "neighbor_id", "distance", F.col("dist_native").alias("dist_exact"), "dist_native", F.col("dist_native").alias("dist_audit"), F.lit(0).cast("bigint").alias("n_scanned"), F.lit(1).cast("bigint").alias("searches")))
    return written(reduce(DataFrame.unionByName, out))


_ZEROS = "0::BIGINT AS pre, 0::BIGINT AS acorn, 0::BIGINT AS post, 0::BIGINT AS audit"


@query(_with(catalog._Q) + f""", one AS (SELECT count(*) AS n FROM q WHERE query_id = 50)
SELECT 'as it is' AS "table", {_ZEROS} FROM one UNION ALL SELECT 'damaged', 2 * n, 4 * n, 4 * n, 10 * n FROM one""")
def accounting_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two conditions; damage: one query's exact effort is one too high everywhere."""
    runs = measured(spark, sf_dir).drop("rank", "neighbor_id", "distance").distinct()
    bad = runs.withColumn("dist_exact", F.col("dist_exact") + (F.col("query_id") == 50).cast("int"))
    return _both(checks.accounting(runs), checks.accounting(bad))


@query(_with(catalog._Q) + f" SELECT method, budget::INTEGER AS budget, (SELECT count(*) FROM q) * 2 AS queries, 0::BIGINT AS filter_violations, 0::BIGINT AS distance_mismatches FROM (VALUES ('pre', 0), ('acorn', {EFS[0]}), ('acorn', {EFS[1]}), ('post', {EFS[0]}), ('post', {EFS[1]})) AS m(method, budget)")
def search_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever a search returns passes the filter at its true distance."""
    w = workload.load(spark, sf_dir)
    runs = measured(spark, sf_dir)
    everything = nearest.nearest(w.base, w.queries, w.n).withColumn("rank", F.col("rank"))  # all distances of the queries
    ranks = workload.ranked(w)
    out = []
    for c in workload.grid(spark, w).where("correlation = 'random'").collect():  # two conditions
        for method, budget in (("pre", 0), *[(m, ef) for m in ("acorn", "post") for ef in EFS]):
            own = runs.where((F.col("condition") == c.condition) & (F.col("method") == method) & (F.col("budget") == budget))
            out.append(metrics.score_rows(own, everything, ranks.where(F.col("rank") < c.threshold), K).select(F.lit(method).alias("method"), F.lit(budget).alias("budget"), "filter_violations", "distance_mismatches"))
    return reduce(DataFrame.unionByName, out).groupBy("method", "budget").agg(F.count(F.lit(1)).alias("queries"), F.sum("filter_violations").alias("filter_violations"), F.sum("distance_mismatches").alias("distance_mismatches"))


@query(_with(catalog._Q) + f""", one AS (SELECT count(*) FILTER (query_id = 50) AS n, count(*) AS m FROM q)
SELECT 'as it is' AS "table", (4 * m)::BIGINT AS rows, 0::BIGINT AS unmatched, 0::BIGINT AS dist_exact_mismatch, 0::BIGINT AS dist_native_mismatch, (4 * m)::BIGINT AS scan_rows FROM one
UNION ALL SELECT 'damaged', 4 * m, 4 * n, 0, 4 * (m - n), 4 * (m - n) FROM one""")
def scan_integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan counts joined back to the runs they belong to; damage: a query is missing, and native
    counts of all others are off."""
    runs = measured(spark, sf_dir).where("method = 'acorn'").select("condition", "budget", "query_id", "dist_exact", "dist_native", "n_scanned").distinct()
    keys, columns = ["condition", "budget", "query_id"], ["dist_exact", "dist_native"]
    bad = runs.where("query_id <> 50").withColumn("dist_native", F.col("dist_native") + 1)
    return _both(checks.scan_integrity(runs.drop("n_scanned"), runs, keys, columns), checks.scan_integrity(runs.drop("n_scanned"), bad, keys, columns))


@query("""SELECT kind, 0::BIGINT AS only_first, 0::BIGINT AS only_second, 0::BIGINT AS effort_difference FROM (VALUES ('again'), ('in two parts')) AS k(kind)""")
def repeated_search_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search again, and with its queries in two parts: same answers, same whole effort."""
    w = workload.load(spark, sf_dir)
    index = written(graph_search.build_index(w.base, "acorn", m=8, gamma=4, m_beta=16))
    run = lambda queries: graph_search.search_index(w.base, index, queries, K, 40, "acorn", F.col("label") < 4, m=8, gamma=4, m_beta=16)
    first = written(run(w.queries))
    parts = run(w.queries.where("query_id % 100 = 0")).unionByName(run(w.queries.where("query_id % 100 <> 0")))
    return checks.same_answers(first, run(w.queries)).withColumn("kind", F.lit("again")).unionByName(checks.same_answers(first, parts).withColumn("kind", F.lit("in two parts")))


@query("SELECT what, true AS same FROM (VALUES ('random ranks'), ('clustered ranks'), ('neighbour lists'), ('hnsw'), ('acorn'), ('sample')) AS w(what)")
def determinism_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is generated twice is equal."""
    w = workload.load(spark, sf_dir)
    made = {
        "random ranks": lambda: workload.ranked(w).select("vec_id", "rank"),
        "clustered ranks": lambda: workload.ranked(w, "clustered").select("vec_id", "rank"),
        "neighbour lists": lambda: nearest.knn_edges(w.base, 4),
        "hnsw": lambda: graph_search.build_index(w.base, "hnsw", m=8, ef=20),
        "acorn": lambda: graph_search.build_index(w.base, "acorn", m=8, gamma=2, m_beta=8),
        "sample": lambda: conditions.query_subset(w.queries.select("query_id"), sample=5, seed=3),
    }
    return spark.createDataFrame([(name, checks.repeatable(make)) for name, make in made.items()], "what string, same boolean")


@query("SELECT 4::BIGINT AS trials, 0::BIGINT AS repeat_mismatches, true AS timed, true AS ordered")
def timing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed trials of a search: each gives the first one's answers; the median lies between the ends."""
    w = workload.load(spark, sf_dir)
    trials = timing.trials(lambda: nearest.nearest(w.base, w.queries, K), repeats=4, queries=w.queries.count())
    row = timing.summary(spark, trials).first()
    return spark.createDataFrame([(row.trials, row.repeat_mismatches, row.median_seconds > 0 and row.qps > 0, row.least_seconds <= row.median_seconds <= row.most_seconds)], "trials bigint, repeat_mismatches bigint, timed boolean, ordered boolean")


_CELL = "SELECT method, correlation, median(oracle_dist) FILTER (abs(s_achieved - {low}) < 1e-3) AS d_low, median(oracle_dist) FILTER (s_achieved = 1) AS d_high, median(coalesce(b, 1e9)::DOUBLE) FILTER (abs(s_achieved - {low}) < 1e-3) AS f_low, median(coalesce(b, 1e9)::DOUBLE) FILTER (s_achieved = 1) AS f_high FROM best WHERE method = 'post' GROUP BY ALL"


@query(_with(*catalog._SWEEP, catalog._ORACLE_CTE) + f", cells AS ({_CELL.format(low='(SELECT min(s_achieved) FROM conds)')}) SELECT 'effort' AS rule, correlation, d_low, d_high, d_low > d_high AS passed FROM cells UNION ALL SELECT 'effort and budget', correlation, d_low, d_high, NOT (d_low <= d_high AND f_low <= f_high) FROM cells")
def low_selectivity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searching under a narrow filter costs more than under none: by the median oracle effort, and in
    the later form by effort and budget together."""
    w = workload.load(spark, sf_dir)
    best = workload.oracles(workload.sweep(spark, w)).where("method = 'post'").withColumn("budget_or_none", F.coalesce("oracle_budget", F.lit(1e9)))
    low = best.agg(F.min("s_achieved")).first()[0]
    one = checks.low_selectivity_cells(best, low, 1.0).select(F.lit("effort").alias("rule"), "correlation", "d_low", "d_high", "passed")
    two = checks.low_selectivity_cells(best, low, 1.0, second="budget_or_none").select(F.lit("effort and budget").alias("rule"), "correlation", "d_low", "d_high", "passed")
    return one.unionByName(two)


# ---- counts


@query(_with(*catalog._SWEEP) + " SELECT 0::BIGINT AS several_hashes, (SELECT count(DISTINCT condition || method) FROM sweep) AS sweeps, (SELECT count(*) * 2 FROM conds) AS expected")
def sweep_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query table for all rows, and a sweep for each condition and method."""
    w = workload.load(spark, sf_dir)
    s = workload.sweep(spark, w)
    digest = tables.content_digest(w.queries, "query_id", "embedding")
    one = checks.one_value(s.withColumn("query_hash", F.lit(digest)), "query_hash").withColumnRenamed("violations", "several_hashes")
    made = s.agg(F.count_distinct("condition", "method").alias("sweeps"))
    return one.join(F.broadcast(made)).join(F.broadcast(workload.grid(spark, w).agg((F.count(F.lit(1)) * len(workload.METHODS)).alias("expected"))))


@query(_with(catalog._SELF, catalog._EDGES, catalog._PASS, catalog._GRAPH_STEPS, catalog._Q, catalog._CLOSURE, catalog._PAIRS, catalog._ORDERED, catalog._TARGETS, catalog._REACHED) + f""", hits AS (SELECT g.*, EXISTS (SELECT 1 FROM o WHERE o.query_id = g.query_id AND o.vec_id = g.target AND place <= 20) AS hit FROM got g),
per AS (SELECT query_id, sum((NOT hit)::INTEGER) AS l, sum((NOT reachable)::INTEGER) AS u, sum((reachable AND NOT hit)::INTEGER) AS n, sum((hit AND NOT reachable)::INTEGER) AS f FROM hits GROUP BY query_id)
SELECT count(*) AS rows, sum((f = 0 AND l <> u + n)::INTEGER)::BIGINT AS broken, sum(f)::BIGINT AS unsound FROM per""")
def decomposition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L = U + N wherever the results are sound; exact results need not be, so some are counted."""
    w = workload.load(spark, sf_dir)
    reached = catalog._reached(w)
    truth = reached.select("query_id", F.col("target").alias("neighbor_id"))
    return checks.decomposition_identity(metrics.decompose(metrics.hit_targets(truth, nearest.nearest(w.base, w.queries, 20), reached), K))


@query(_with(catalog._SELF, catalog._EDGES, catalog._PASS, catalog._GRAPH_STEPS, catalog._Q, catalog._CLOSURE, catalog._PAIRS, catalog._TARGETS) + " SELECT seed, neighbor_id, query_id FROM (SELECT query_id AS seed, target AS neighbor_id, query_id FROM targets) AS t WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.seed = t.seed AND node = t.neighbor_id)")
def soundness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact answers that the traversal rules cannot reach, which a graph search could not return."""
    w = workload.load(spark, sf_dir)
    truth = nearest.nearest(w.base.where("label < 4"), w.queries, K).select("query_id", F.col("query_id").alias("seed"), "neighbor_id")
    return reachability.unreached(truth, catalog._steps(w))


@query(_with(catalog._SELF, catalog._EDGES, catalog._PASS, catalog._GRAPH_STEPS, catalog._INDUCED, catalog._ALL, catalog._STRONG, catalog._Q, catalog._PAIRS, catalog._TARGETS) + """, sizes AS (SELECT component, count(*) AS n FROM comp GROUP BY component), seed AS (SELECT min(component) AS s FROM sizes WHERE n = (SELECT max(n) FROM sizes))
SELECT t.query_id, s AS seed, sum(CASE WHEN t.target = s OR EXISTS (SELECT 1 FROM full_reach f WHERE f.a = s AND f.b = t.target) THEN 1::BIGINT << (rank - 1) ELSE 0 END)::BIGINT AS bits, count(*) AS n_targets FROM targets t, seed GROUP BY t.query_id, s""")
def reach_from_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What over-fetch can reach: all queries start from a member of the largest strong component."""
    w = workload.load(spark, sf_dir)
    nodes, steps = catalog._passing(w), reachability.induced(catalog._steps(w), catalog._passing(w))
    sizes = reachability.strong_components(nodes, steps).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    seed = sizes.agg(F.min(F.struct((-F.col("n")).alias("less"), "component")).component.alias("seed"))
    truth = nearest.nearest(w.base.where("label < 4"), w.queries, K)
    targets = truth.join(F.broadcast(seed)).select("query_id", "seed", "rank", F.col("neighbor_id").alias("target"))
    reached = reachability.reach_targets(catalog._steps(w), nodes, targets)
    return reachability.target_bits(reached).join(F.broadcast(seed))


@query(_with(catalog._Q) + " SELECT count(*) AS queries, true AS all_seeded, true AS sound FROM q")
def acorn_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level-0 seed of each graph search under the predicate, one per query and shard, and whether
    all that a search returned can be reached from its seed over the shard's own links by the rule
    that the search follows."""
    w = workload.load(spark, sf_dir)
    index = written(graph_search.build_index(w.base, "acorn", m=8, gamma=4, m_beta=16))
    found = written(graph_search.search_index(w.base, index, w.queries, K, 40, "acorn", F.col("label") < 4, m=8, gamma=4, m_beta=16, traced=True))
    pairs = found.select("query_id", F.col("shard").cast("int").alias("shard"), "seed", F.col("neighbor_id").alias("node"))
    links = index.where("level = 0").select("shard", "src", "pos", "dst")
    lost = reachability.reached_in_parts(links, catalog._passing(w), pairs, "shard", gamma=4, m_beta=16).where(~F.col("reached")).count()
    seeds = found.groupBy("query_id").agg((F.count("seed") == F.count(F.lit(1))).alias("seeded"))
    return seeds.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.bool_and("seeded"), F.lit(True)).alias("all_seeded"), F.lit(lost == 0).alias("sound"))
