import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.operators import conditions, graph_search, nearest, overfetch
from halyard.operators.ranks import global_rank


def _vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], a) for i, (v, a) in enumerate(rows)], "vec_id long, embedding array<float>, label int")


def _queries(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], a) for i, (v, a) in enumerate(rows)], "query_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def toy(spark):
    draw = np.random.default_rng(11)
    points = draw.integers(0, 4, (400, 5))  # many ties
    base = _vectors(spark, [(p, int(i % 7)) for i, p in enumerate(points)]).persist()
    queries = _queries(spark, [(p, int(i % 7)) for i, p in enumerate(draw.integers(0, 4, (25, 5)))]).persist()
    return base, queries, points, np.array([q.embedding for q in queries.orderBy("query_id").collect()])


def test_ties_go_to_the_smaller_id(spark):
    base = _vectors(spark, [([x], 0) for x in (5, 1, 1, 0, 1, 2)])
    found = nearest.nearest(base, _queries(spark, [([1], 0)]), 3).orderBy("rank").collect()
    assert [r.neighbor_id for r in found] == [1, 2, 4] and all(r.distance == 0 for r in found)


def test_padding(spark):
    base = _vectors(spark, [([x], a) for x, a in zip(range(5), (1, 2, 1, 2, 2))])
    q = _queries(spark, [([0], 1)])
    rows = nearest.padded(nearest.nearest(base, q, 3, attr="label"), q, 3).orderBy("rank").collect()
    assert [(r.neighbor_id, r.distance) for r in rows] == [(0, 0.0), (2, 4.0), (-1, math.inf)]


@pytest.mark.parametrize("block", [nearest.QUERY_BLOCK, 4])
def test_nearest_against_brute_force(toy, block):
    base, queries, points, q = toy
    d = ((q[:, None] - points[None]) ** 2).sum(2)
    for attr in (None, "label"):
        got = {}
        for r in nearest.nearest(base.repartition(5), queries, 6, attr, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
        for i in range(len(q)):
            allowed = [j for j in range(400) if attr is None or j % 7 == i % 7]
            assert got[i] == sorted((float(d[i, j]), j) for j in allowed)[:6]


def test_empty_tables(spark, toy):
    base, queries, *_ = toy
    assert nearest.nearest(base.where("false"), queries, 3).count() == 0
    assert nearest.nearest(base, queries.where("false"), 3).count() == 0


def test_fetch_sizes():
    assert [overfetch.fetch_size(10, 0.1, r, 10_000) for r in (1, 2, 3)] == [100, 200, 400]
    assert overfetch.fetch_size(10, 0.1, 3, 250) == 250 and overfetch.fetch_size(10, 1.0, 1, 1000) == 10
    assert overfetch.fetch_size(10, 0.3, 1, 1000) == 34 and overfetch.fetch_size(10, 1.0, 1, 1000, alpha=0.5) == 10
    for bad in ((0, 0.1, 1, 9), (1, 0.0, 1, 9), (1, 1.5, 1, 9), (1, 0.5, 0, 9)):
        with pytest.raises(ValueError):
            overfetch.fetch_size(*bad)
    with pytest.raises(ValueError):
        overfetch.schedule(10, 0.5, 100, 3, growth=1.0)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 50), st.floats(0.001, 1), st.integers(1, 6), st.integers(1, 5000))
def test_fetch_size_grows_and_is_bounded(k, s, r, n):
    a, b = overfetch.fetch_size(k, s, r, n), overfetch.fetch_size(k, s, r + 1, n)
    assert min(k, n) <= a <= b <= n


def test_overfetch_against_a_walk(toy):
    base, queries, points, q = toy
    d = ((q[:, None] - points[None]) ** 2).sum(2)
    k, s = 4, 1 / 7
    got = {r.query_id: r for r in overfetch.postfilter_effort(base, queries, k, F.col("label") == 3, s, max_rounds=3).collect()}
    sizes = overfetch.schedule(k, s, 400, 3)
    for i in range(len(q)):
        order = sorted(range(400), key=lambda j: (d[i, j], j))
        checks = 0
        for r, size in enumerate(sizes, 1):
            kept = 0
            for j in order[:size]:
                checks += 1
                kept += j % 7 == 3
                if kept == k:
                    break
            if kept == k:
                break
        assert (got[i].rounds, got[i].last_fetch, got[i].n_kept, got[i].filter_checks) == (r, size, kept, checks)
    none = overfetch.postfilter_effort(base, queries, k, F.lit(False), 0).collect()
    assert all((r.rounds, r.last_fetch, r.n_kept, r.filter_checks) == (0, 0, 0, 0) for r in none)
    assert overfetch.postfilter(base, queries, k, F.col("label") == 3, s).where("rank = 1").count() == len(q)


def test_prefilter_and_agreement(toy):
    base, queries, *_ = toy
    rows = nearest.prefilter(base, queries, 5, F.col("label") == 2)
    assert rows.where("filter_checks = 400 and dist_exact = 57").count() == 125
    a = nearest.nearest(base, queries, 5)
    assert {r.agreement for r in nearest.compare_neighbours(a, a).collect()} == {"identical"}
    other = a.withColumn("neighbor_id", F.when(F.col("query_id") == 0, -5).otherwise(F.col("neighbor_id")))
    assert {r.query_id: r.agreement for r in nearest.compare_neighbours(a, other).collect()}[0] == "ties"
    wrong = a.withColumn("neighbor_id", F.lit(-5)).withColumn("distance", F.col("distance") + 1)
    assert {r.agreement for r in nearest.compare_neighbours(a, wrong).collect()} == {"mismatch"}


def test_global_rank(spark):
    df = spark.range(1000).repartition(7).withColumn("x", F.col("id") % 10)
    got = global_rank(df, ["x", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1000)) and [(r.x, r.id) for r in got] == sorted((i % 10, i) for i in range(1000))


def test_levels_and_thresholds(spark):
    levels = conditions.selectivity_levels(0.01, 1, 6)
    assert levels[0] == 0.01 and abs(levels[2] - 10**-1.2) < 1e-12 and levels[-1] == 1
    for s, n in ((0.0, 10), (1.5, 10), (math.nan, 10), (0.01, 10)):
        with pytest.raises(ValueError):
            conditions.threshold(s, n)
    assert conditions.threshold(0.25, 10) == 3 and conditions.threshold(1.0, 7) == 7
    grid = conditions.fragmentation_grid(spark, {"C10": 10, "C100": 100}, 2, [0.1, 1.0], 100)
    assert grid.count() == 8 and grid.select("condition").distinct().count() == 8


def test_rank_attributes(spark, toy):
    base, *_ = toy
    ranks = conditions.random_ranks(base, 5).persist()
    assert sorted(r["rank"] for r in ranks.collect()) == list(range(400))
    grid = conditions.conditions(spark, 400, [0.1, 0.5, 1.0], ["random"])
    assert conditions.integrity(ranks, grid).where("exact and within_half and nested").count() == 3
    cover = conditions.cluster_coverage(conditions.clustered_ranks(base, "label", 5), "label", 200).first()
    assert cover.partial <= 1 and cover.spanned - cover.whole == cover.partial
    clusters = conditions.kmeans_clusters(base, 4, 7)
    assert clusters.select("cluster").distinct().count() == 4
    folds = conditions.split_queries(base.select(F.col("vec_id").alias("query_id")), 3, 300, 4)
    assert folds.where("is_train").count() == 300 and folds.groupBy("fold").count().where("count = 100").count() == 4
    assert conditions.uniform_attribute(spark, 8, 1, 12, 20261003).orderBy("vec_id").select("attr").rdd.flatMap(list).collect() == [12, 8, 6, 7, 1, 7, 7, 6]
    q = base.select(F.col("vec_id").alias("query_id"))
    assert conditions.query_subset(q, first=5).count() == 5 and conditions.query_subset(q, sample=9).count() == 9


@pytest.mark.parametrize("kind", ["hnsw", "acorn"])
@pytest.mark.parametrize("shard_rows", [graph_search.SHARD_ROWS, 150])
def test_graph_search(spark, kind, shard_rows):
    draw = np.random.default_rng(2)
    base = _vectors(spark, [(p, i % 3) for i, p in enumerate(draw.standard_normal((400, 6)))]).persist()
    queries = _queries(spark, [(p, 0) for p in draw.standard_normal((10, 6))]).persist()
    predicate = None if kind == "hnsw" else F.col("label") == 1
    options = dict(m=8, gamma=4, m_beta=16, shard_rows=shard_rows)
    index = graph_search.build_index(base, kind, ef=60, **options).persist()
    found = graph_search.search_index(base, index, queries, 5, 400, kind, predicate, **options).persist()
    truth = nearest.nearest(base if predicate is None else base.where(predicate), queries, 5)
    agreement = nearest.compare_neighbours(found.select("query_id", "rank", "neighbor_id", "distance"), truth, 1e-6)
    assert agreement.where("agreement <> 'mismatch'").count() >= 9  # a wide beam finds (nearly) all
    assert found.where("dist_exact < 5").count() == 0
    if kind == "acorn":
        assert found.join(base, found.neighbor_id == base.vec_id).where("label <> 1").count() == 0
        assert found.where("dist_exact < dist_native + 1").count() == 0 and found.where("n_scanned = 0").count() == 0
    else:
        assert found.where("dist_exact <> dist_native").count() == 0
    statistics = {r.level: r for r in graph_search.index_statistics(index).collect()}
    assert statistics[0].nodes == 400 and graph_search.level0_edges(index).select("src").distinct().count() == 400


def test_single_row_index(spark):
    base = _vectors(spark, [([1, 2], 0)])
    queries = _queries(spark, [([1, 2], 0)])
    index = graph_search.build_index(base)
    assert index.count() == 0 and graph_search.search_index(base, index, queries, 3, 10).first().neighbor_id == 0


def test_saved_index(spark, tmp_path):
    base = _vectors(spark, [([i, i * i], 0) for i in range(30)])
    index = graph_search.build_index(base, m=4)
    graph_search.save_index(index, str(tmp_path), {"kind": "hnsw", "m": 4}, 30)
    again = graph_search.load_index(spark, str(tmp_path), {"kind": "hnsw", "m": 4}, 30)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.collect()))
    for parameters, rows in (({"kind": "acorn", "m": 4}, 30), ({"kind": "hnsw", "m": 4}, 31)):
        with pytest.raises(ValueError):
            graph_search.load_index(spark, str(tmp_path), parameters, rows)


def test_running_total(spark):
    from halyard.operators.ranks import running_total

    df = spark.range(200).repartition(5).withColumn("v", F.col("id") % 7)
    got = [r.before for r in running_total(df, ["id"], "v", "before").orderBy("id").collect()]
    assert got == [sum(i % 7 for i in range(j)) for j in range(200)]


def test_grids_and_draws(spark):
    assert conditions.budget_grid((10, 30, 10), (20, 100, 40)) == [10, 20, 30, 60, 100]
    ids = spark.range(2000).withColumnRenamed("id", "vec_id")
    n = conditions.null_draws(ids, 5, 0.3, 1).groupBy("draw").count().collect()
    assert len(n) == 5 and all(abs(r["count"] - 600) < 100 for r in n)
    u = [r.u for r in ids.select(conditions.unit_column("vec_id", 3).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 2000 - 0.5) < 0.05
    grid = conditions.fragmentation_grid(spark, {"a": 5}, 2, [1.0], 10)
    attributes = spark.createDataFrame([("a", 0, "c1", "h1"), ("a", 1, "c2", "h1")], "level string, realization int, cluster_hash string, attribute_hash string")
    assert tuple(conditions.grid_problems(grid, attributes).first()) == (1, 1, 0)


@pytest.mark.parametrize("block_rows", [4_000, 25])
def test_knn_edges_by_cells(spark, block_rows):
    draw = np.random.default_rng(8)
    x = np.round(np.concatenate([draw.normal(c, 0.3, (40, 3)) for c in (0.0, 4.0, 9.0)]), 2).astype(np.float32)
    x[7] = x[3]
    base = spark.createDataFrame([(i * 3, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in nearest.knn_edges(base, 5, block_rows=block_rows).select("src", "pos", "dst").collect())
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(-1)
    expected = []
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:5]
        expected += [(3 * i, pos, 3 * j) for pos, (_, j) in enumerate(order)]
    assert got == sorted(expected)
    assert nearest.knn_edges(base.limit(1), 5).count() == 0


def test_postfilter_over_an_index(spark):
    draw = np.random.default_rng(9)
    x = draw.standard_normal((300, 4)).astype(np.float32)
    base = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    queries = base.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "query_id")
    passing = base.where("vec_id % 10 = 0").select("vec_id")

    def search(q, fetch):
        return nearest.nearest(base, q, fetch).withColumn("dist_native", F.lit(300).cast("bigint"))

    got = overfetch.postfilter_index(search, passing, queries, 3, 0.1, 300, max_rounds=6)
    truth = nearest.nearest(base.join(passing, "vec_id", "left_semi"), queries, 3)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "neighbor_id").collect()) == sorted(tuple(r) for r in truth.select("query_id", "rank", "neighbor_id").collect())
    rows = {r.query_id: r for r in got.collect()}
    exact = {r.query_id: r for r in overfetch.postfilter_effort(base, queries, 3, F.col("vec_id") % 10 == 0, 0.1, max_rounds=6).collect()}
    for q, r in rows.items():
        assert (r.rounds, r.last_fetch, r.filter_checks, r.dist_native) == (exact[q].rounds, exact[q].last_fetch, exact[q].filter_checks, 300 * r.rounds)
    assert overfetch.postfilter_index(search, passing, queries, 3, 0.0, 300).where("rank IS NULL").count() == queries.count()


def test_second_counter_agrees(spark):
    draw = np.random.default_rng(10)
    base = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(draw.standard_normal((120, 4)).astype(np.float32))], "vec_id long, embedding array<float>")
    queries = base.where("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id")
    for kind, more, predicate in (("hnsw", {"m": 6}, None), ("acorn", {"m": 4, "gamma": 2, "m_beta": 4}, F.col("vec_id") % 2 == 0)):
        index = graph_search.build_index(base, kind, **more)
        rows = graph_search.search_index(base, index, queries, 4, 10, kind, predicate, **more).collect()
        assert rows and all(r.dist_audit == r.dist_exact == r.dist_native + (kind == "acorn") for r in rows)
