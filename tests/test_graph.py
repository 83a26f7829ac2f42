import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halyard.operators import reachability as R

HAND = {0: [1, 2, 3], 1: [4], 2: [5], 3: [6, 7]}
MASK = [1, 0, 0, 0, 1, 1, 1, 0]


def _tables(spark, lists, mask):
    edges = spark.createDataFrame([(u, p, v) for u, vs in lists.items() for p, v in enumerate(vs)], "src long, pos int, dst long")
    return edges, spark.createDataFrame([(i,) for i, ok in enumerate(mask) if ok], "vec_id long")


def _of(df, u):
    return {r.dst for r in df.where(F.col("src") == u).collect()}


def test_hand_graph(spark):
    edges, passing = _tables(spark, HAND, MASK)
    assert _of(R.successors(edges, passing, R.GRAPH), 0) == set()
    assert _of(R.successors(edges, passing, R.SEM, gamma=1), 0) == {4, 5, 6}
    assert _of(R.successors(edges, passing, R.SEM, gamma=4, m_beta=2), 0) == {6}
    assert _of(R.successors(edges, passing, R.UNFILTERED), 0) == {1, 2, 3}
    assert _of(R.successors(edges, passing, R.CAP, gamma=1, m_beta=2, m=1), 0) == {4, 5, 6}
    with pytest.raises(ValueError):
        R.successors(edges, passing, "other")


def test_capped_scan(spark):
    edges, passing = _tables(spark, {0: [1, 2, 3, 4]}, [1] * 5)
    assert _of(R.successors(edges, passing, R.CAP, gamma=4, m_beta=10, m=1), 0) == {1, 2}
    assert _of(R.successors(edges, passing, R.SEM, gamma=4, m_beta=10), 0) == {1, 2, 3, 4}
    edges, passing = _tables(spark, {0: [0, 1, 1]}, [1, 1])
    assert _of(R.successors(edges, passing, R.CAP, gamma=4, m_beta=10, m=4), 0) == {1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 11), max_size=6), min_size=12, max_size=12), st.lists(st.booleans(), min_size=12, max_size=12), st.sampled_from([1, 4]), st.integers(0, 4), st.integers(1, 4))
def test_capped_scan_stays_within_the_rules(lists, mask, gamma, m_beta, m):
    for u in range(12):
        inner = {v: [w for w in lists[v] if mask[w]] for v in range(12)}
        found = R.capped_scan(u, [(v, mask[v]) for v in lists[u]], inner, gamma, m_beta, m)
        allowed = {v for v in lists[u] if mask[v]}
        for pos, v in enumerate(lists[u]):
            if gamma == 1 or pos >= m_beta:
                allowed.update(inner[v])
        assert len(found) == len(set(found)) and set(found) <= allowed - {u}


def _random_graph(n, degree, seed):
    draw = random.Random(seed)
    return {u: [draw.randrange(n) for _ in range(degree)] for u in range(n)}


def _search(lists, seed):
    seen, todo = {seed}, [seed]
    while todo:
        for v in lists.get(todo.pop(), []):
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


def test_closure_components_and_targets(spark):
    lists = _random_graph(60, 2, 4)
    mask = [i % 4 != 1 for i in range(60)]
    edges, passing = _tables(spark, lists, mask)
    steps = R.successors(edges, passing, R.GRAPH).persist()
    own = {u: [v for v in vs if mask[v] and v != u] for u, vs in lists.items()}
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "seed long")  # 1 fails the filter
    got = R.closure(steps, seeds)
    for s in (1, 2, 3):
        assert {r.node for r in got.where(F.col("seed") == s).collect()} == _search(own, s)
    targets = spark.createDataFrame([(0, 1, 1, 1), (0, 1, 2, 5), (0, 1, 3, 2), (1, 2, 1, -1)], "query_id long, seed long, rank int, target long")
    reached = R.reach_targets(steps, passing, targets)
    hit = {(r.query_id, r["rank"]): r.reachable for r in reached.collect()}
    assert hit == {(0, 1): True, (0, 2): False, (0, 3): 2 in _search(own, 1), (1, 1): False}
    bits = {r.query_id: r.bits for r in R.target_bits(reached).collect()}
    assert bits == {0: 1 + 4 * hit[0, 3], 1: 0}
    inner = R.induced(steps, passing).persist()
    nodes = [i for i in range(60) if mask[i]]
    mine = {u: [v for v in own[u]] for u in nodes}
    strong = {r.node: r.component for r in R.strong_components(passing, inner).collect()}
    reach = {u: _search(mine, u) for u in nodes}
    assert strong == {u: max(v for v in reach[u] if u in reach[v]) for u in nodes}
    both = {u: set(mine[u]) for u in nodes}
    for u in nodes:
        for v in mine[u]:
            both[v].add(u)
    weak = {r.node: r.component for r in R.weak_components(passing, inner).collect()}
    assert weak == {u: min(_search(both, u)) for u in nodes}
    s = spark.createDataFrame(list(strong.items()), "node long, component long")
    w = spark.createDataFrame(list(weak.items()), "node long, component long")
    row = R.component_statistics(passing, inner, s, w).first()
    assert (row.nodes, row.sccs, row.wccs) == (len(nodes), len(set(strong.values())), len(set(weak.values())))
    dag = R.condensation(inner, s).collect()
    assert all(r.src != r.dst for r in dag) and len(dag) == len({(r.src, r.dst) for r in dag})
    returned = spark.createDataFrame([(0, 2, 2), (0, 5, 2)], "query_id long, neighbor_id long, seed long")
    assert R.unsound(returned, got).count() == sum(x not in _search(own, 2) for x in (2, 5))


def _plain_scan(u, entries, lists, gamma, m_beta, m):
    """The rules of a capped scan, one entry at a time."""
    seen, counted, opening, out = {u}, 0, True, []
    for pos, (v, passes) in enumerate(entries):
        counted += passes
        if v in seen:
            continue
        if passes:
            seen.add(v)
            out.append(v)
            if counted >= 2 * m:
                break
        if gamma != 1 and not (opening and pos >= m_beta):
            continue
        for w in lists[v]:
            counted += 1
            if w not in seen:
                seen.add(w)
                out.append(w)
                if counted >= 2 * m:
                    opening = False
                    break
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 11), max_size=6), min_size=12, max_size=12), st.lists(st.booleans(), min_size=12, max_size=12), st.sampled_from([1, 4]), st.integers(0, 4), st.integers(1, 4))
def test_capped_scans_side_by_side(lists, mask, gamma, m_beta, m):
    inner = {v: [w for w in lists[v] if mask[w]] for v in range(12)}
    entries = [[(v, mask[v]) for v in lists[u]] for u in range(12)]
    flat = [e for row in entries for e in row]
    size = np.cumsum([0, *map(len, entries)])
    which, found = R.capped_scans(
        np.arange(12), size, np.array([v for v, _ in flat], np.int64), np.array([p for _, p in flat], bool), np.cumsum([0, *(len(inner[v]) for v, _ in flat)]), np.array([w for v, _ in flat for w in inner[v]], np.int64), gamma, m_beta, m
    )
    for u in range(12):
        assert found[which == u].tolist() == _plain_scan(u, entries[u], inner, gamma, m_beta, m)


@pytest.mark.parametrize("limit", [R.BROADCAST_EDGES, 0])
def test_closures_and_components_in_memory_and_in_joins(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "BROADCAST_EDGES", limit)
    draw = random.Random(3)
    pairs = sorted({(draw.randrange(14), draw.randrange(14)) for _ in range(16)})
    steps = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(15)], "vec_id long")
    after = {u: {v for a, v in pairs if a == u} for u in range(15)}

    def reach(u):
        seen, todo = {u}, [u]
        while todo:
            for v in after[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        return seen

    every = {u: reach(u) for u in range(15)}
    got = R.closure(steps, spark.createDataFrame([(0,), (3,), (14,), (99,)], "seed long")).collect()
    assert {(r.seed, r.node) for r in got} == {(u, v) for u in (0, 3, 14) for v in every[u]} | {(99, 99)}
    strong = {r.node: r.component for r in R.strong_components(nodes, steps).collect()}
    assert strong == {u: max(v for v in every[u] if u in every[v]) for u in range(15)}
    weak = {r.node: r.component for r in R.weak_components(nodes, steps).collect()}
    group = {u: {u} for u in range(15)}
    for a, b in pairs:
        joined = group[a] | group[b]
        for x in joined:
            group[x] = joined
    assert weak == {u: min(group[u]) for u in range(15)}


@pytest.mark.parametrize("limit", [R.BROADCAST_EDGES, 0])
def test_pairs_in_memory_and_in_joins(spark, monkeypatch, limit):
    """More seeds than bits of a word, by both ways, and no table of all that is reached."""
    monkeypatch.setattr(R, "BROADCAST_EDGES", limit)
    monkeypatch.setattr(R, "closure", None)
    lists = _random_graph(150, 2, 7)
    steps = spark.createDataFrame([(u, v) for u, vs in lists.items() for v in vs], "src long, dst long")
    every = {u: _search(lists, u) for u in range(150)} | {999: {999}}
    pairs = [(u, v, n) for u in [*range(130), 999] for n, v in enumerate([0, 77, 149, 999, u])]
    got = R.reached_pairs(steps, spark.createDataFrame(pairs, "seed long, node long, n int")).collect()
    assert {(r.seed, r.node, r.n, r.reached) for r in got} == {(u, v, n, v in every[u]) for u, v, n in pairs} and len(got) == len(pairs)
    returned = spark.createDataFrame([(0, v, u) for u, v, _ in pairs], "query_id long, neighbor_id long, seed long")
    assert sorted(map(tuple, R.unreached(returned, steps).collect())) == sorted((u, v, 0) for u, v, _ in pairs if v not in every[u])
    passing = spark.createDataFrame([(i,) for i in range(0, 150, 2)], "vec_id long")
    targets = spark.createDataFrame([(u, u, 1, v) for u, v, _ in pairs], "query_id long, seed long, rank int, target long")
    reached = R.reach_targets(steps, passing, targets).collect()
    assert {(r.seed, r.target, r.reachable) for r in reached} == {(u, v, u == v or (v in every[u] and v % 2 == 0)) for u, v, _ in pairs}


@pytest.mark.parametrize("gamma", [1, 4])
def test_parts_follow_the_rule_sem(spark, gamma):
    lists = _random_graph(60, 4, 5)
    mask = [i % 3 != 1 for i in range(60)]
    edges, passing = _tables(spark, lists, mask)
    steps = R.successors(edges, passing, R.SEM, gamma=gamma, m_beta=2)
    pairs = spark.createDataFrame([(0, u, v) for u in range(60) for v in range(60)], "part int, seed long, node long")
    plain = {(r.seed, r.node): r.reached for r in R.reached_pairs(steps, pairs).collect()}
    got = R.reached_in_parts(edges.withColumn("part", F.lit(0)), passing, pairs, "part", gamma, 2).collect()
    assert {(r.seed, r.node): r.reached for r in got} == plain and len(set(plain.values())) == 2
