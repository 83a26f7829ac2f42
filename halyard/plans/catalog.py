"""All registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import scalars, vectors
from halyard.operators import checks, conditions, effort, graph_search, metrics, nearest, overfetch, policy, reachability, statistics
from halyard.plans import workload
from halyard.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from halyard.plans.registry import with_parts as _with
from halyard.plans.workload import K, SEED
from halyard.session import written

# ---- pieces of SQL, shared by the queries' SQL
_Q = "q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 50 = 0)"
_D = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_PAIRS = f"p AS (SELECT query_id, ql, vec_id, label, {_D.format(a='qe', b='embedding')} AS d FROM q, embeddings)"
_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS place FROM p)"
_RANKS = f"r AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('{SEED}:' || vec_id), vec_id) - 1 AS rank FROM embeddings)"
_CLUSTERED = f"rc AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('{SEED}:' || label), label, md5('{SEED + 1}:' || vec_id), vec_id) - 1 AS rank FROM embeddings)"
_N = "n AS (SELECT count(*) AS n FROM embeddings)"
_SELF = f"s2 AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_D.format(a='a.embedding', b='b.embedding')} AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"
_EDGES = f"edges AS (SELECT src, pos, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) - 1 AS pos FROM s2) WHERE pos < {workload.GRAPH_DEGREE})"
_PASS = "ok AS (SELECT vec_id FROM embeddings WHERE label < 4)"


def _threshold(s: float) -> str:
    return f"(SELECT least(floor({s} * n + 0.5), n) FROM n)"


def _passing(w: workload.Workload) -> DataFrame:
    return w.base.where("label < 4").select("vec_id")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- exact search


@query(_with(_Q, _PAIRS, _ORDERED) + f" SELECT query_id, place::INTEGER AS rank, vec_id AS neighbor_id, round(d, 6) AS distance FROM o WHERE place <= {K}")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return _rounded(nearest.nearest(w.base, w.queries, K), "distance")


@query(_with(_Q, _PAIRS) + f" SELECT query_id, rank::INTEGER AS rank, vec_id AS neighbor_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p WHERE label = ql) WHERE rank <= {K}")
def knn_filtered_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return _rounded(nearest.nearest(w.base, w.queries, K, attr="label"), "distance")


@query(_with(_Q, _PAIRS, _RANKS, _N) + f" SELECT query_id, k::INTEGER AS rank, vec_id AS neighbor_id, round(d, 6) AS distance FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS k FROM p JOIN r USING (vec_id) WHERE r.rank < {_threshold(0.1)}) WHERE k <= {K}")
def knn_filtered_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    passing = conditions.passing(workload.ranked(w), conditions.threshold(0.1, w.n))
    return _rounded(nearest.nearest(passing, w.queries, K), "distance")


@query(_with(_SELF, _EDGES) + " SELECT src, pos::INTEGER AS pos, dst FROM edges")
def base_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.knn_edges(workload.load(spark, sf_dir).base, workload.GRAPH_DEGREE)


@query(_with(_Q, _PAIRS) + f""", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS k FROM p WHERE label = 3)
SELECT c.query_id, c.i::INTEGER AS rank, coalesce(t.vec_id, -1) AS neighbor_id, round(coalesce(t.d, 'inf'::DOUBLE), 6) AS distance FROM (SELECT query_id, unnest(generate_series(1, 200)) AS i FROM q) AS c LEFT JOIN t ON t.query_id = c.query_id AND t.k = c.i""")
def knn_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return _rounded(nearest.padded(nearest.nearest(w.base.where("label = 3"), w.queries, 200), w.queries, 200), "distance")


@query(_with(_Q, _PAIRS) + f" SELECT query_id, rank::INTEGER AS rank, vec_id AS neighbor_id, (SELECT count(*) FROM embeddings) AS filter_checks, (SELECT count(*) FROM embeddings WHERE label < 4) AS dist_exact FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p WHERE label < 4) WHERE rank <= {K}")
def prefilter_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return nearest.prefilter(w.base, w.queries, K, F.col("label") < 4).select("query_id", "rank", "neighbor_id", "filter_checks", "dist_exact")


@query(_with(_N) + f" SELECT s::DOUBLE AS s, r::INTEGER AS round, least(n, greatest({K}, ceil(ceil({K} / s::DOUBLE) * pow(2, r - 1))))::BIGINT AS fetch_size FROM n, (VALUES (0.05), (0.1), (0.3), (0.5), (1.0)) AS levels(s), generate_series(1, 6) AS rounds(r)")
def postfilter_fetch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = workload.load(spark, sf_dir).n
    return spark.createDataFrame([(s, r, overfetch.fetch_size(K, s, r, n)) for s in (0.05, 0.1, 0.3, 0.5, 1.0) for r in range(1, 7)], "s double, round int, fetch_size bigint")


@query(_with(_Q, _PAIRS, _ORDERED, _RANKS, _N) + f""", t AS (SELECT {_threshold(0.1)} AS t),
f AS (SELECT i AS r, least(n, greatest({K}, ceil(ceil({K} / (t / n::DOUBLE)) * pow(2, i - 1))))::BIGINT AS fetch_size FROM n, t, generate_series(1, 8) AS g(i)),
good AS (SELECT query_id, place, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM o JOIN r USING (vec_id), t WHERE r.rank < t),
kth AS (SELECT q.query_id, max(place) FILTER (k = {K}) AS kth FROM q LEFT JOIN good USING (query_id) GROUP BY q.query_id),
last AS (SELECT query_id, any_value(kth) AS kth, coalesce(min(f.r) FILTER (kth <= fetch_size), min(f.r) FILTER (fetch_size = n), 8) AS rounds FROM kth, f, n GROUP BY query_id),
done AS (SELECT last.*, f.fetch_size AS last_fetch, (SELECT coalesce(sum(g.fetch_size), 0) FROM f AS g WHERE g.r < last.rounds) AS earlier FROM last JOIN f ON f.r = last.rounds)
SELECT query_id, rounds::INTEGER AS rounds, last_fetch, (SELECT count(*) FROM good WHERE good.query_id = done.query_id AND place <= last_fetch AND k <= {K})::BIGINT AS n_kept, (earlier + CASE WHEN kth <= last_fetch THEN kth ELSE last_fetch END)::BIGINT AS filter_checks FROM done""")
def postfilter_exact_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    t = conditions.threshold(0.1, w.n)
    return overfetch.postfilter_effort(workload.ranked(w), w.queries, K, F.col("rank") < t, t / w.n)


@query(_with(_Q, _PAIRS, _ORDERED, _RANKS, _N) + f", a AS (SELECT query_id, vec_id AS neighbor_id FROM o WHERE place <= 20), b AS (SELECT query_id, vec_id AS neighbor_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM o JOIN r USING (vec_id) WHERE r.rank < {_threshold(0.5)}) SELECT q.query_id, round(count(a.neighbor_id) / {float(K)}, 6) AS recall FROM q LEFT JOIN b ON b.query_id = q.query_id AND k <= {K} LEFT JOIN a ON a.query_id = b.query_id AND a.neighbor_id = b.neighbor_id GROUP BY q.query_id")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    probe = nearest.nearest(w.base, w.queries, 20)
    truth = nearest.nearest(conditions.passing(workload.ranked(w), conditions.threshold(0.5, w.n)), w.queries, K)
    return _rounded(metrics.recall_at_k(probe, truth, K), "recall")


@query("SELECT 'identical' AS agreement, count(*) AS n FROM embeddings WHERE vec_id % 50 = 0")
def neighbour_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    a = nearest.nearest(w.base, w.queries, K)
    lists = w.base.select("vec_id", F.col("embedding").alias("v"))
    b = nearest.nearest(w.base, w.queries, K, block=3).join(w.queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(lists, F.col("neighbor_id") == F.col("vec_id"))
    b = b.select("query_id", "rank", "neighbor_id", vectors.squared_l2(F.col("q"), F.col("v")).alias("distance"))
    return nearest.compare_neighbours(a, b).groupBy("agreement").agg(F.count(F.lit(1)).alias("n"))


# ---- predicates


@query(_with(_N) + """, l AS (SELECT i, CASE WHEN i = 5 THEN 1.0::DOUBLE ELSE pow(10.0::DOUBLE, log10(0.05) + (0 - log10(0.05)) * i / 5) END AS s FROM generate_series(0, 5) AS g(i))
SELECT c || '_s' || printf('%.4f', s) AS condition, c AS correlation, round(s, 9) AS s_requested, least(floor(s * n + 0.5), n)::BIGINT AS threshold, least(floor(s * n + 0.5), n) / n::DOUBLE AS s_achieved FROM l, n, (VALUES ('random'), ('clustered')) AS names(c)""")
def conditions_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return conditions.conditions(spark, w.n, conditions.selectivity_levels(0.05, 1.0, 6), ["random", "clustered"]).withColumn("s_requested", F.round("s_requested", 9))


@query(_with(_RANKS, _N) + """ SELECT 'random_s' || printf('%.4f', s) AS condition, t AS threshold, count(*) AS n_pass, count(*) = t AS exact, max(rank) < t AS nested FROM (SELECT s, least(floor(s * n + 0.5), n)::BIGINT AS t FROM n, (VALUES (0.1), (0.25), (0.5), (1.0)) AS l(s)), r WHERE rank < t GROUP BY s, t""")
def nested_selectivity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    grid = conditions.conditions(spark, w.n, [0.1, 0.25, 0.5, 1.0], ["random"])
    return conditions.integrity(workload.ranked(w), grid).select("condition", "threshold", "n_pass", "exact", "nested")


@query(_with(_CLUSTERED, _N) + f", per AS (SELECT label, sum((rank < {_threshold(0.25)})::INTEGER) AS inside, count(*) AS size FROM rc GROUP BY label) SELECT sum((inside > 0)::INTEGER)::BIGINT AS spanned, sum((inside = size)::INTEGER)::BIGINT AS whole, sum((inside > 0 AND inside < size)::INTEGER)::BIGINT AS partial FROM per")
def cluster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return conditions.cluster_coverage(workload.ranked(w, "clustered"), "label", conditions.threshold(0.25, w.n))


@query("SELECT vec_id, (1 + ('0x' || substr(md5('7:' || vec_id), 1, 12))::BIGINT % 12)::INTEGER AS attr FROM embeddings")
def hashed_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.hashed_attribute(workload.load(spark, sf_dir).base.select("vec_id"), 1, 12, 7)


@query(_with(_Q) + ", a AS (SELECT label, count(*) AS n_base FROM embeddings GROUP BY label), b AS (SELECT ql AS label, count(*) AS n_queries FROM q GROUP BY ql) SELECT label, n_base, coalesce(n_queries, 0) AS n_queries, n_base / (SELECT count(*) FROM embeddings)::DOUBLE AS selectivity FROM a LEFT JOIN b USING (label)")
def attribute_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return metrics.attribute_sanity(w.base, w.queries, "label")


# ---- structure

_NEAR = "near AS (SELECT o.query_id, o.vec_id, o.label, place FROM o WHERE place <= 50)"
_DENSITY = "dens AS (SELECT query_id, sum((label < 4)::INTEGER) / 50.0::DOUBLE AS local_density FROM near GROUP BY query_id)"


def _density(w: workload.Workload) -> DataFrame:
    return metrics.local_density(nearest.nearest(w.base, w.queries, 50), _passing(w), 50)


@query(_with(_Q, _PAIRS, _ORDERED, _NEAR, _DENSITY) + " SELECT query_id, round(local_density, 6) AS local_density FROM dens")
def local_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_density(workload.load(spark, sf_dir)), "local_density")


@query(_with(_Q, _PAIRS, _ORDERED, _NEAR, _DENSITY) + " SELECT round(avg((local_density = 0)::INTEGER), 6) AS zero_fraction FROM dens")
def zero_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.zero_fraction(_density(workload.load(spark, sf_dir))), "zero_fraction")


@query(_with(_Q, _PAIRS, _ORDERED, _NEAR, _DENSITY) + " SELECT round(avg(local_density), 6) AS mean, round(var_pop(local_density), 9) AS variance, round(0.4 * 0.6 / 50::DOUBLE, 9) AS binomial_variance, round(var_pop(local_density) / (0.4 * 0.6 / 50::DOUBLE), 6) AS dispersion FROM dens")
def density_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.density_summary(_density(workload.load(spark, sf_dir)), 0.4, 50)
    return d.select(F.round("mean", 6).alias("mean"), F.round("variance", 9).alias("variance"), F.round("binomial_variance", 9).alias("binomial_variance"), F.round("dispersion", 6).alias("dispersion"))


_SHARE = "share AS (SELECT src, sum((dst IN (SELECT vec_id FROM ok))::INTEGER) / 8.0::DOUBLE AS share FROM edges WHERE src IN (SELECT vec_id FROM ok) GROUP BY src)"


@query(_with(_SELF, _EDGES, _PASS, _SHARE) + " SELECT round(coalesce(avg(share), 0), 6) AS homophily FROM share")
def homophily(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return _rounded(metrics.homophily(workload.edges(w), _passing(w), 8), "homophily")


@query(_with(_SELF, _EDGES, _PASS, _SHARE) + ", h AS (SELECT avg(share) AS h, (SELECT count(*) FROM ok) / (SELECT count(*) FROM embeddings)::DOUBLE AS c FROM share) SELECT round((h - c) / (1 - c), 6) AS kappa FROM h")
def chance_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    chance = _passing(w).count() / w.n
    return metrics.homophily(workload.edges(w), _passing(w), 8).select(F.round(metrics.chance_corrected(F.col("homophily"), F.lit(chance)), 6).alias("kappa"))


_DRAWN = "('0x' || substr(md5('null ' || draw || ':' || {id}), 1, 8))::BIGINT < 1717986918"


@query(_with(_SELF, _EDGES, _PASS, _SHARE) + f""", g AS (SELECT unnest(generate_series(1, 39)) AS draw),
c AS (SELECT g.draw, src, sum(({_DRAWN.format(id='dst')})::INTEGER) / 8.0::DOUBLE AS share FROM edges, g WHERE {_DRAWN.format(id='src')} GROUP BY g.draw, src),
nulls AS (SELECT draw, avg(share) AS h FROM c GROUP BY draw)
SELECT (1 + sum((h >= (SELECT avg(share) FROM share))::INTEGER)) / 40.0::DOUBLE AS p_upper, (1 + sum((h <= (SELECT avg(share) FROM share))::INTEGER)) / 40.0::DOUBLE AS p_lower FROM nulls""")
def empirical_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homophily of label < 4 against 39 random attributes of selectivity 0.4."""
    w = workload.load(spark, sf_dir)
    links = workload.edges(w)
    observed = metrics.homophily(links, _passing(w), 8).first()[0]
    drawn = lambda c: F.conv(F.substring(F.md5(F.concat(F.lit("null "), F.col("draw"), F.lit(":"), F.col(c))), 1, 8), 16, 10).cast("bigint") < 1717986918
    each = links.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(39)))).where(drawn("src"))
    share = each.groupBy("draw", "src").agg((F.sum(drawn("dst").cast("int")) / 8.0).alias("share"))
    null = share.groupBy("draw").agg(F.avg("share").alias("h"))
    return metrics.empirical_p(null, "h", observed)


@query(_with("c AS (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)", "cc AS (SELECT list(m ORDER BY i) AS c FROM c)", _Q) + f" SELECT query_id, round(sqrt({_D.format(a='qe', b='c')}), 6) AS centroid_dist FROM q, cc")
def centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    centre = vectors.centroid(w.base, "embedding").first()[0]
    return w.queries.select("query_id", F.round(vectors.l2(F.col("embedding"), F.array(*map(F.lit, centre))), 6).alias("centroid_dist"))


_PROBE = "pr AS (SELECT query_id, list(sqrt(d) ORDER BY place) AS ds FROM o WHERE place BETWEEN 2 AND 21 GROUP BY query_id)"


def _probe(w: workload.Workload) -> DataFrame:
    near = nearest.nearest(w.base, w.queries, 21).where("rank > 1")
    return near.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.sqrt("distance").alias("d")))), lambda s: s.d).alias("ds"))


@query(_with(_Q, _PAIRS, _ORDERED, _PROBE) + " SELECT query_id, round(CASE WHEN ds[20] = 0 THEN 1 ELSE ds[1] / ds[20] END, 6) AS score_concentration FROM pr")
def score_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(workload.load(spark, sf_dir)).select("query_id", F.round(vectors.score_concentration(F.col("ds"), 20), 6).alias("score_concentration"))


@query(_with(_Q, _PAIRS, _ORDERED, _PROBE) + " SELECT query_id, CASE WHEN list_min(ds) = 0 THEN 0 ELSE round(-19 / list_sum(list_transform(ds, lambda x: ln(x / ds[20]))), 6) END AS lid FROM pr")
def lid_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(workload.load(spark, sf_dir)).select("query_id", F.round(vectors.local_intrinsic_dimension(F.col("ds"), 20), 6).alias("lid"))


@query(_with(_Q, _PAIRS, _ORDERED) + " SELECT query_id, round(avg((label < 4)::INTEGER), 6) AS rho_hat FROM o WHERE place <= 20 GROUP BY query_id")
def passing_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    found = metrics.local_density(nearest.nearest(w.base, w.queries, 20), _passing(w), 20)
    return found.select("query_id", F.round("local_density", 6).alias("rho_hat"))


# ---- graph

_GRAPH_STEPS = "st AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND dst IN (SELECT vec_id FROM ok))"
_SEM = "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src{where}) WHERE src <> dst AND dst IN (SELECT vec_id FROM ok)"


@query(_with(_SELF, _EDGES, _PASS, _GRAPH_STEPS) + " SELECT src, dst FROM st")
def succ_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return reachability.successors(workload.edges(w), _passing(w), reachability.GRAPH)


@query(_with(_SELF, _EDGES, _PASS) + " " + _SEM.format(where=""))
def succ_sem_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return reachability.successors(workload.edges(w), _passing(w), reachability.SEM, gamma=1)


@query(_with(_SELF, _EDGES, _PASS) + " " + _SEM.format(where=" AND a.pos >= 4"))
def succ_sem_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return reachability.successors(workload.edges(w), _passing(w), reachability.SEM, gamma=4, m_beta=4)


@query(_with(_SELF, _EDGES) + " SELECT DISTINCT src, dst FROM edges")
def succ_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return reachability.successors(workload.edges(w), _passing(w), reachability.UNFILTERED)


#: One scan, entry after entry, in a row that carries what was counted and seen.
_CAP = """pl AS (SELECT src, list(dst ORDER BY pos) AS l FROM edges WHERE dst IN (SELECT vec_id FROM ok) GROUP BY src),
arr AS (SELECT e.src, list(e.dst ORDER BY e.pos) AS vs, list(e.dst IN (SELECT vec_id FROM ok) ORDER BY e.pos) AS oks, list(coalesce(pl.l, []) ORDER BY e.pos) AS ls FROM edges e LEFT JOIN pl ON pl.src = e.dst GROUP BY e.src),
sc(src, p, found, opening, vis, fin) AS (SELECT src, 1, 0::BIGINT, true, [src], false FROM arr
  UNION ALL SELECT src, p + 1, (found1 + CASE WHEN grow THEN coalesce(cut, len(l)) ELSE 0 END)::BIGINT, opening AND NOT (grow AND cut IS NOT NULL),
    CASE WHEN grow THEN list_concat(vis1, list_transform(list_filter(fresh_at, lambda j: j <= coalesce(cut, len(l))), lambda j: l[j])) ELSE vis1 END, fin1
  FROM (SELECT *, list_min(list_filter(fresh_at, lambda j: found1 + j >= {twice_m})) AS cut
  FROM (SELECT *, fresh AND NOT fin1 AND opening AND p - 1 >= {m_beta} AS grow, list_filter(generate_series(1, len(l)), lambda j: NOT list_contains(vis1, l[j]) AND list_position(l, l[j]) = j) AS fresh_at
  FROM (SELECT *, CASE WHEN fresh AND okv THEN list_append(vis, v) ELSE vis END AS vis1, fresh AND okv AND found1 >= {twice_m} AS fin1
  FROM (SELECT *, found + okv::INTEGER AS found1, NOT list_contains(vis, v) AS fresh
  FROM (SELECT sc.*, vs[p] AS v, oks[p] AS okv, ls[p] AS l FROM sc JOIN arr USING (src) WHERE p <= len(vs) AND NOT fin))))))"""


@query(_with(_SELF, _EDGES, _PASS, _CAP.format(m_beta=4, twice_m=8)) + " SELECT src, unnest(arg_max(vis, p)[2:]) AS dst FROM sc GROUP BY src")
def succ_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return reachability.successors(workload.edges(w), _passing(w), reachability.CAP, gamma=4, m_beta=4, m=4)


_CLOSURE = "reach AS (SELECT query_id AS seed, query_id AS node FROM q UNION SELECT seed, st.dst FROM reach JOIN st ON st.src = reach.node)"


def _steps(w: workload.Workload) -> DataFrame:
    return reachability.successors(workload.edges(w), _passing(w), reachability.GRAPH)


@query(_with(_SELF, _EDGES, _PASS, _GRAPH_STEPS, _Q, _CLOSURE) + " SELECT seed, node FROM reach")
def reach_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    return reachability.closure(_steps(w), w.queries.select(F.col("query_id").alias("seed")))


_TARGETS = f"targets AS (SELECT query_id, rank, vec_id AS target FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p WHERE label < 4) WHERE rank <= {K})"
_REACHED = "got AS (SELECT t.*, t.query_id = t.target OR EXISTS (SELECT 1 FROM reach WHERE seed = t.query_id AND node = t.target) AS reachable FROM targets t)"


def _reached(w: workload.Workload) -> DataFrame:
    truth = nearest.nearest(w.base.where("label < 4"), w.queries, K)
    targets = truth.select("query_id", F.col("query_id").alias("seed"), "rank", F.col("neighbor_id").alias("target"))
    return written(reachability.reach_targets(_steps(w), _passing(w), targets))  # read more than once


@query(_with(_SELF, _EDGES, _PASS, _GRAPH_STEPS, _Q, _CLOSURE, _PAIRS, _TARGETS, _REACHED) + " SELECT query_id, sum(CASE WHEN reachable THEN 1::BIGINT << (rank - 1) ELSE 0 END)::BIGINT AS bits, count(*) AS n_targets FROM got GROUP BY query_id")
def reach_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reachability.target_bits(_reached(workload.load(spark, sf_dir)))


@query(_with(_SELF, _EDGES, _PASS, _GRAPH_STEPS, _Q, _CLOSURE, _PAIRS, _ORDERED, _TARGETS, _REACHED) + f""", hits AS (SELECT g.*, EXISTS (SELECT 1 FROM o WHERE o.query_id = g.query_id AND o.vec_id = g.target AND place <= 20) AS hit FROM got g)
SELECT query_id, round(sum((NOT hit)::INTEGER) / {float(K)}, 6) AS L, round(sum((NOT reachable)::INTEGER) / {float(K)}, 6) AS U, round(sum((reachable AND NOT hit)::INTEGER) / {float(K)}, 6) AS N, sum((hit AND NOT reachable)::INTEGER)::BIGINT AS found_unreachable, round(sum(hit::INTEGER) / {float(K)}, 6) AS recall FROM hits GROUP BY query_id""")
def decompose_un(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    reached = _reached(w)
    found = nearest.nearest(w.base, w.queries, 20)
    truth = reached.select("query_id", F.col("target").alias("neighbor_id"))
    return _rounded(metrics.decompose(metrics.hit_targets(truth, found, reached), K), "L", "U", "N", "recall")


_INDUCED = "ind AS (SELECT src, dst FROM st WHERE src IN (SELECT vec_id FROM ok))"
_ALL = "full_reach AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT a, ind.dst FROM full_reach JOIN ind ON ind.src = b)"


@query(_with(_SELF, _EDGES, _PASS, _GRAPH_STEPS, _INDUCED, _ALL) + " SELECT max(y.a) AS component, count(*) AS size FROM (SELECT x.a AS node, max(x.b) AS component FROM full_reach x JOIN full_reach z ON z.a = x.b AND z.b = x.a GROUP BY x.a) AS c JOIN (SELECT vec_id AS a FROM ok) AS y ON y.a = c.component GROUP BY c.component")
def scc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    steps = reachability.induced(_steps(w), _passing(w))
    return reachability.strong_components(_passing(w), steps).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query(_with(_SELF, _EDGES, _PASS, _GRAPH_STEPS, _INDUCED, "both_ways AS (SELECT src, dst FROM ind UNION SELECT dst, src FROM ind)", "weak AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT a, both_ways.dst FROM weak JOIN both_ways ON both_ways.src = b)") + " SELECT component, count(*) AS size FROM (SELECT a, min(b) AS component FROM weak GROUP BY a) GROUP BY component")
def wcc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    steps = reachability.induced(_steps(w), _passing(w))
    return reachability.weak_components(_passing(w), steps).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


_STRONG = "comp AS (SELECT x.a AS node, max(x.b) AS component FROM full_reach x JOIN full_reach z ON z.a = x.b AND z.b = x.a GROUP BY x.a)"
_WEAK = ("both_ways AS (SELECT src, dst FROM ind UNION SELECT dst, src FROM ind)", "weak AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT a, both_ways.dst FROM weak JOIN both_ways ON both_ways.src = b)", "wcomp AS (SELECT a, min(b) AS component FROM weak GROUP BY a)")


@query(_with(_SELF, _EDGES, _PASS, _GRAPH_STEPS, _INDUCED, _ALL, _STRONG) + " SELECT DISTINCT p.component AS src, q.component AS dst FROM ind JOIN comp p ON p.node = ind.src JOIN comp q ON q.node = ind.dst WHERE p.component <> q.component")
def condensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    steps = reachability.induced(_steps(w), _passing(w))
    return reachability.condensation(steps, reachability.strong_components(_passing(w), steps))


@query(_with(_SELF, _EDGES, _PASS, _GRAPH_STEPS, _INDUCED, _ALL, _STRONG, *_WEAK) + """, s AS (SELECT component, count(*) AS n FROM comp GROUP BY component), v AS (SELECT component, count(*) AS n FROM wcomp GROUP BY component)
SELECT (SELECT count(*) FROM ok) AS nodes, (SELECT count(*) FROM ind) AS edges, (SELECT count(*) FROM s) AS sccs, (SELECT max(n) FROM s) AS largest_scc, (SELECT min(component) FROM s WHERE n = (SELECT max(n) FROM s)) AS largest_member, (SELECT count(*) FROM v) AS wccs, (SELECT max(n) FROM v) AS largest_wcc""")
def component_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    nodes, steps = _passing(w), reachability.induced(_steps(w), _passing(w))
    return reachability.component_statistics(nodes, steps, reachability.strong_components(nodes, steps), reachability.weak_components(nodes, steps))


@query(_with(_SELF, _EDGES, _PASS, _SHARE, _Q, _PAIRS, _ORDERED, _NEAR, _DENSITY) + """, c AS (SELECT (SELECT count(*) FROM ok) / count(*)::DOUBLE AS s FROM embeddings)
SELECT round(s, 9) AS s_achieved, round((SELECT avg(local_density) FROM dens), 6) AS mean, round((SELECT avg((local_density = 0)::INTEGER) FROM dens), 6) AS zero_fraction, round(((SELECT avg(share) FROM share) - s) / (1 - s), 6) AS kappa, 0::BIGINT AS partial_clusters FROM c""")
def structure_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    row = metrics.structure_record(nearest.nearest(w.base, w.queries, 50), workload.edges(w), w.base, _passing(w), "label", 50, 8)
    return row.select(F.round("s_achieved", 9).alias("s_achieved"), F.round("mean", 6).alias("mean"), F.round("zero_fraction", 6).alias("zero_fraction"), F.round("kappa", 6).alias("kappa"), F.col("partial_clusters").cast("bigint").alias("partial_clusters"))


# ---- approximate search (rows only: no SQL walks a graph best-first)


@query()
def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    index = written(graph_search.build_index(w.base, "hnsw", m=12, ef=40))
    return _rounded(graph_search.search_index(w.base, index, w.queries, K, 40, "hnsw", m=12), "distance")


@query()
def acorn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload.load(spark, sf_dir)
    index = written(graph_search.build_index(w.base, "acorn", m=8, gamma=4, m_beta=16))
    return _rounded(graph_search.search_index(w.base, index, w.queries, K, 40, "acorn", F.col("label") < 4, m=8, gamma=4, m_beta=16), "distance")


@query()
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.index_statistics(graph_search.build_index(workload.load(spark, sf_dir).base, "acorn", m=8, gamma=4, m_beta=16))


# ---- sweeps and effort

_SWEEP = (
    _Q, _PAIRS, _ORDERED, _RANKS, _CLUSTERED, _N,
    f"""conds AS (SELECT c || '_s' || printf('%.4f', s) AS condition, c AS correlation, t AS threshold, t / n::DOUBLE AS s_achieved FROM (SELECT c, s, n, least(floor(s * n + 0.5), n)::BIGINT AS t FROM n, (VALUES {', '.join(f'({s})' for s in workload.SELECTIVITIES)}) AS l(s), (VALUES ('random'), ('clustered')) AS x(c)))""",
    "ranks AS (SELECT 'random' AS correlation, vec_id, rank FROM r UNION ALL SELECT 'clustered', vec_id, rank FROM rc)",
    f"places AS (SELECT * FROM (SELECT c.condition, o.query_id, place, row_number() OVER (PARTITION BY c.condition, o.query_id ORDER BY place) AS k FROM conds c JOIN ranks USING (correlation) JOIN o USING (vec_id) WHERE ranks.rank < threshold) WHERE k <= {K})",
    f"""sweep AS (SELECT c.condition, correlation, s_achieved, threshold, 'post' AS method, b::INTEGER AS budget, q.query_id, (SELECT count(*) FROM places WHERE places.condition = c.condition AND places.query_id = q.query_id AND place <= b) / {float(K)}::DOUBLE AS recall, least(b, n)::BIGINT AS dist_exact FROM conds c, q, n, (VALUES {', '.join(f'({b})' for b in workload.BUDGETS)}) AS budgets(b)
UNION ALL SELECT condition, correlation, s_achieved, threshold, 'pre', 0, query_id, least(1.0, threshold / {float(K)}::DOUBLE), threshold FROM conds, q)""",
)
_ORACLE_CTE = "best AS (SELECT condition, correlation, s_achieved, method, query_id, min(budget) FILTER (recall >= 0.9 - 1e-12) AS b, coalesce(min_by(dist_exact, budget) FILTER (recall >= 0.9 - 1e-12)::DOUBLE, 'inf'::DOUBLE) AS oracle_dist FROM sweep GROUP BY ALL)"


@query(_with(*_SWEEP) + " SELECT condition, method, budget, query_id, round(recall, 6) AS recall, dist_exact FROM sweep")
def sweep_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = workload.sweep(spark, workload.load(spark, sf_dir))
    return _rounded(s.select("condition", "method", "budget", "query_id", "recall", "dist_exact"), "recall")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.sweep(spark, workload.load(spark, sf_dir))


@query(_with(*_SWEEP, _ORACLE_CTE) + " SELECT condition, method, query_id, b::DOUBLE AS oracle_budget, oracle_dist, b IS NULL AS censored FROM best")
def oracle_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.oracles(_sweep(spark, sf_dir)).select("condition", "method", "query_id", "oracle_budget", "oracle_dist", "censored")


@query(_with(*_SWEEP) + " SELECT condition, method, budget, round(avg(recall), 6) AS mean_recall, avg(dist_exact) AS mean_dist, median(dist_exact)::DOUBLE AS median_dist, round(avg((recall < 0.9 - 1e-12)::INTEGER), 6) AS failed_fraction, count(*) AS n FROM sweep GROUP BY ALL")
def budget_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(effort.budget_curve(_sweep(spark, sf_dir), ["condition", "method"], 0.9), "mean_recall", "failed_fraction")


_RATIO = "CASE WHEN {a} = 'inf' AND {b} = 'inf' THEN 0 WHEN {a} = 'inf' THEN 'inf'::DOUBLE WHEN {b} = 'inf' THEN '-inf'::DOUBLE ELSE round(log2({a} / {b}), 6) END"


@query(_with(*_SWEEP, _ORACLE_CTE) + f" SELECT a.condition, a.method, a.query_id, {_RATIO.format(a='a.oracle_dist', b='z.oracle_dist')} AS log2_ratio FROM best a JOIN best z ON z.s_achieved = 1 AND z.method = a.method AND z.correlation = a.correlation AND z.query_id = a.query_id")
def effort_ratio_to_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = effort.ratio_to_unfiltered(workload.oracles(_sweep(spark, sf_dir)), ["method", "correlation"])
    return _rounded(out.select("condition", "method", "query_id", "log2_ratio"), "log2_ratio")


_WIDE = "wide AS (SELECT condition, correlation, query_id, max(oracle_dist) FILTER (method = 'pre') AS pre, max(oracle_dist) FILTER (method = 'post') AS post FROM best GROUP BY ALL)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effort.pivoted(workload.oracles(_sweep(spark, sf_dir)), ["condition", "correlation", "query_id"], "method", list(workload.METHODS))


@query(_with(*_SWEEP, _ORACLE_CTE, _WIDE) + f" SELECT condition, query_id, {_RATIO.format(a='pre', b='post')} AS log2_ratio FROM wide")
def paired_log2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_wide(spark, sf_dir).select("condition", "query_id", scalars.log2_ratio(F.col("pre"), F.col("post")).alias("log2_ratio")), "log2_ratio")


@query(_with(*_SWEEP, _ORACLE_CTE, _WIDE) + " SELECT condition, sum((pre < post)::INTEGER)::BIGINT AS less, sum((pre > post)::INTEGER)::BIGINT AS greater, sum((pre = post)::INTEGER)::BIGINT AS ties FROM wide GROUP BY condition")
def sign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sign_counts(_wide(spark, sf_dir), "pre", "post", ["condition"])


@query()
def paired_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.paired_comparison(_wide(spark, sf_dir), [("pre", "post")], ["condition"], resamples=200)


@query(_with(*_SWEEP, _ORACLE_CTE) + " SELECT method, coalesce(correlation, 'both') AS correlation, median(oracle_dist) AS median_dist, avg((b IS NULL)::INTEGER)::DOUBLE AS censored_share, count(*) AS n FROM best GROUP BY GROUPING SETS ((method, correlation), (method))")
def effort_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effort.grouping_summary(workload.oracles(_sweep(spark, sf_dir)), ["method"], "correlation")


@query(_with(*_SWEEP) + """, m AS (SELECT condition, budget, avg(recall) AS y, avg(dist_exact) AS e FROM sweep WHERE method = 'post' GROUP BY ALL),
l AS (SELECT condition, budget AS x_hi, y AS y_hi, e AS e_hi, lag(budget) OVER w AS x_lo, lag(y) OVER w AS y_lo, lag(e) OVER w AS e_lo FROM m WINDOW w AS (PARTITION BY condition ORDER BY budget)),
f AS (SELECT condition, min_by(struct_pack(x_lo, x_hi, y_lo, y_hi, e_lo, e_hi), x_hi) AS p FROM l WHERE x_lo IS NOT NULL AND y_lo <= 0.5 AND y_hi >= 0.5 GROUP BY condition)
SELECT condition, p.x_lo AS x_lo, p.x_hi AS x_hi, round(p.e_lo + CASE WHEN p.y_hi = p.y_lo THEN 0 ELSE (0.5 - p.y_lo) / (p.y_hi - p.y_lo) END * (p.e_hi - p.e_lo), 6) AS effort FROM f""")
def recall_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = effort.budget_curve(_sweep(spark, sf_dir).where("method = 'post'"), ["condition"], 0.9)
    curve = curve.select("condition", F.col("budget"), F.col("mean_recall").alias("recall"), F.col("mean_dist").alias("effort"))
    return _rounded(effort.crossing(curve, ["condition"], "budget", "recall", 0.5), "effort")


# ---- statistics


@query("""WITH a AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS ry FROM a)
SELECT label, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY label""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = workload.load(spark, sf_dir).base.select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return _rounded(statistics.spearman(d, "x", "y", ["label"]), "rho")


@query("""WITH a AS (SELECT label, count(*) / 10000.0::DOUBLE AS p FROM embeddings GROUP BY label),
s AS (SELECT label, p, (count(*) OVER () - row_number() OVER (ORDER BY p, label) + 1) * p AS q, row_number() OVER (ORDER BY p, label) AS i FROM a)
SELECT p, round(least(1.0, max(q) OVER (ORDER BY i)), 6) AS p_holm FROM s""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = workload.load(spark, sf_dir).base.groupBy("label").agg((F.count(F.lit(1)) / 10000.0).alias("p"))
    return _rounded(statistics.holm(d, "p", []).select("p", "p_holm"), "p_holm")


@query("""WITH a AS (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings),
k AS (SELECT label, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r, count(*) OVER () AS n FROM a),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM a GROUP BY x)),
g AS (SELECT label, sum(r) AS s, count(*) AS m, any_value(n)::DOUBLE AS n FROM k GROUP BY label)
SELECT round((12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1)) / (1 - (SELECT ties FROM t) / (any_value(n) ^ 3 - any_value(n))), 6) AS h, (count(*) - 1)::BIGINT AS df FROM g""")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = workload.load(spark, sf_dir).base.select("label", F.col("embedding")[0].cast("double").alias("x"))
    return _rounded(statistics.kruskal_wallis(d, [], "label", "x").select("h", "df"), "h")


@query("SELECT label, round(any_value(x), 6) AS quantile FROM (SELECT label, embedding[1]::DOUBLE AS x, row_number() OVER (PARTITION BY label ORDER BY embedding[1]) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE i = floor(0.9 * (n - 1)) GROUP BY label")
def lower_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = workload.load(spark, sf_dir).base.select("label", F.col("embedding")[0].cast("double").alias("x"))
    return _rounded(metrics.lower_quantile(d, "x", 0.9, ["label"]), "quantile")


@query("SELECT label, round(any_value(x), 6) AS median FROM (SELECT label, embedding[1]::DOUBLE AS x, row_number() OVER (PARTITION BY label ORDER BY embedding[1]) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) WHERE i = n // 2 GROUP BY label")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = workload.load(spark, sf_dir).base.select("label", F.col("embedding")[0].cast("double").alias("x"))
    return _rounded(metrics.upper_median(d, "x", ["label"]), "median")


# ---- policies

_POLICY = "pol AS (SELECT condition, query_id, budget, recall, dist_exact AS cost, recall >= 0.9 - 1e-12 AS success, max(recall) OVER (PARTITION BY condition, query_id ORDER BY budget) AS p FROM sweep WHERE method = 'post')"


def _policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post-search budgets with the recall itself as the probability of success."""
    s = _sweep(spark, sf_dir).where("method = 'post'")
    index = F.array_position(F.array(*map(F.lit, workload.BUDGETS)), F.col("budget")).cast("int") - 1
    rows = s.select("condition", "query_id", index.alias("budget_index"), F.col("dist_exact").cast("double").alias("cost"), (F.col("recall") >= 0.9 - 1e-12).cast("int").alias("success"), F.col("recall").alias("p"))
    return policy.monotone(rows)


_PICKED = f"""pk AS (SELECT tau, condition, query_id, list(cost ORDER BY budget)[i] AS cost, list(success ORDER BY budget)[i] AS success FROM (SELECT *, least(sum((p < tau)::INTEGER) OVER (PARTITION BY tau, condition, query_id) + 1, {len(workload.BUDGETS)})::BIGINT AS i FROM pol, (SELECT unnest(generate_series(0, 20)) * 0.05::DOUBLE AS tau)) GROUP BY tau, condition, query_id, i)"""


@query(_with(*_SWEEP, _POLICY, _PICKED) + " SELECT round(tau, 6) AS tau, round(avg(cost), 6) AS mean_cost, round(avg(success::INTEGER), 6) AS mean_success FROM pk GROUP BY tau")
def tau_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(policy.tau_curve(policy.by_pair(_policy_rows(spark, sf_dir)), 0.05), "tau", "mean_cost", "mean_success")


_UNIT = "('0x' || substr(md5('unit:' || query_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _unit(column: str):
    return F.conv(F.substring(F.md5(F.concat(F.lit("unit:"), F.col(column))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


@query(_with(*_SWEEP, _POLICY) + f""", m AS (SELECT row_number() OVER (ORDER BY budget) - 1 AS b, budget, avg(success::INTEGER) AS mean, sum(success::INTEGER) AS wins, count(*) AS n FROM pol GROUP BY budget),
hi AS (SELECT coalesce(min(b) FILTER (mean >= 0.7), max(b)) AS hi, bool_or(mean >= 0.7) AS any_ok FROM m),
g AS (SELECT query_id, {_UNIT} AS u, sum(CASE WHEN m.b = hi.hi THEN success::INTEGER WHEN m.b = hi.hi - 1 THEN -success::INTEGER ELSE 0 END) AS gain FROM pol JOIN m USING (budget), hi GROUP BY query_id),
c AS (SELECT u, coalesce(sum(gain) OVER (ORDER BY u, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT CASE WHEN hi = 0 OR NOT any_ok THEN hi ELSE hi - 1 END::INTEGER AS low, hi::INTEGER AS high, round(CASE WHEN hi = 0 THEN 0 WHEN NOT any_ok THEN 1 ELSE coalesce((SELECT min(u) FROM c WHERE before >= (SELECT 0.7 * n - wins FROM m WHERE b = hi - 1) - 1e-9), 1) END, 6) AS lambda FROM hi""")
def b1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high, lam = policy.calibrate_mixture(_policy_rows(spark, sf_dir).withColumn("u", _unit("query_id")), 0.7)
    return spark.createDataFrame([(low, high, round(lam, 6))], "low int, high int, lambda double")


@query(_with(*_SWEEP, _ORACLE_CTE, _POLICY) + """, ch AS (SELECT pol.*, best.oracle_dist FROM pol JOIN best USING (condition, query_id) WHERE best.method = 'post' AND pol.budget = 80)
SELECT round(avg((oracle_dist < 'inf' AND NOT success)::INTEGER), 6) AS avoidable_failures, round(avg(cost - oracle_dist) FILTER (oracle_dist < 'inf' AND success), 6) AS overspend, round(avg(oracle_dist - cost) FILTER (oracle_dist < 'inf' AND NOT success), 6) AS underspend, round(avg((oracle_dist = 'inf')::INTEGER), 6) AS censored FROM ch""")
def regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sweep(spark, sf_dir)
    best = workload.oracles(s).where("method = 'post'").select("condition", "query_id", F.col("oracle_dist").alias("oracle_cost"))
    chosen = s.where("method = 'post' AND budget = 80").select("condition", "query_id", F.col("dist_exact").alias("cost"), (F.col("recall") >= 0.9 - 1e-12).alias("success"))
    return _rounded(policy.regret(chosen.join(best, ["condition", "query_id"])), "avoidable_failures", "overspend", "underspend", "censored")


@query()
def router_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of both families, calibrated and compared on held-out folds."""
    w = workload.load(spark, sf_dir)
    rows = _policy_rows(spark, sf_dir).drop("p")
    near = _probe(w).select("query_id", vectors.score_concentration(F.col("ds"), 20).alias("score_concentration"), vectors.local_intrinsic_dimension(F.col("ds"), 20).alias("lid"))
    s = workload.grid(spark, w).select("condition", "s_achieved")
    folds = conditions.split_queries(w.queries.select("query_id"), SEED, 0, 2).select("query_id", "fold")
    rows = rows.join(near, "query_id").join(s, "condition").join(folds, "query_id").persist()
    features = ["s_achieved", "score_concentration", "lid"]
    found = []
    for family in ("logistic", "tree"):
        p = policy.out_of_fold(rows, 2, lambda train, family=family: policy.fit_success(train, features, len(workload.BUDGETS), family))
        tau, cost = policy.calibrate_tau(policy.by_pair(p), 0.5, 0.05)
        found.append((family, tau, cost))
    return spark.createDataFrame(found, "family string, tau double, mean_cost double")
