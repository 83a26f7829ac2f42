import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators import checks, effort, metrics, policy, statistics

INF = math.inf


def _df(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def _lists(spark, rows):
    return _df(spark, "query_id long, rank int, neighbor_id long", [(q, i + 1, x) for q, ids in enumerate(rows) for i, x in enumerate(ids)])


def test_recall(spark):
    found = _lists(spark, [[5, 3, 0, 2], [5, 5, 5, 5], [-1, -1], [1, 2, 99]])
    truth = _lists(spark, [[5, 3, 9, 1], [5, 5, 5, 5], [-1, -1], [1, 2, 3]])
    assert [r.recall for r in metrics.recall_at_k(found, truth, 4).orderBy("query_id").collect()] == [0.5, 0.25, 0, 0.5]
    assert {r.recall for r in metrics.recall_at_k(found, truth, 0).collect()} == {0}
    x = spark.range(1).select(metrics.recall_of_lists(F.array(*map(F.lit, [1, 2, 99])), F.array(*map(F.lit, [1, 2, 3])), 3).alias("r"))
    assert abs(x.first().r - 2 / 3) < 1e-12


def _passing(spark, mask):
    return _df(spark, "vec_id long", [(i,) for i, ok in enumerate(mask) if ok])


def test_density_and_zero_fraction(spark):
    near = _lists(spark, [[0, 1, 2, 3], [4, 5, 6, 7]])
    passing = _passing(spark, [1, 0, 1, 0, 0, 0, 0, 1])
    d = lambda k: [r.local_density for r in metrics.local_density(near, passing, k).orderBy("query_id").collect()]
    assert d(4) == [0.5, 0.25] and d(2) == [0.5, 0]
    near = _lists(spark, [[0, 1, 2], [3, 4, 5], [1, 3, 5]])
    only = _passing(spark, [0, 0, 1])
    z = lambda k: metrics.zero_fraction(metrics.local_density(near, only, k)).first()[0]
    assert abs(z(3) - 2 / 3) < 1e-12 and z(2) == 1
    row = metrics.density_summary(metrics.local_density(near, only, 3), 0.5, 3).first()
    assert abs(row.mean - 1 / 9) < 1e-12 and abs(row.binomial_variance - 1 / 12) < 1e-12 and abs(row.share_zero - 2 / 3) < 1e-12


def test_homophily(spark):
    rows = [(0, [0, 1, 2]), (1, [1, 0, 3]), (2, [2, 3, 0]), (3, [3, 2, 1])]
    edges = _df(spark, "src long, pos int, dst long", [(u, p, v) for u, vs in rows for p, v in enumerate(vs)])
    h = lambda mask, k=2, sample=None: metrics.homophily(edges, _passing(spark, mask), k, sample).first()[0]
    assert h([1, 1, 0, 0]) == 0.5 and h([0, 0, 0, 0]) == 0 and h([1, 1, 1, 1]) == 1
    assert h([1, 1, 0, 1], 2, _df(spark, "vec_id long", [(1,), (3,)])) == 0.75


def test_chance_and_p_values(spark):
    for a, b, c in ((0.1, 0.1, 0), (1, 0.4, 1), (0.55, 0.1, 0.5)):
        assert abs(spark.range(1).select(metrics.chance_corrected(F.lit(a), F.lit(b)).alias("x")).first().x - c) < 1e-12
    null = _df(spark, "v double", [(1.0,), (2.0,), (3.0,), (4.0,)])
    p = lambda x: tuple(metrics.empirical_p(null, "v", x).first())
    assert p(5)[0] == 1 / 5 and p(4)[0] == 2 / 5 and p(0)[0] == 1 and p(0)[1] == 1 / 5 and p(1)[1] == 2 / 5
    row = metrics.null_moments(null, "v").first()
    assert row["mean"] == 2.5 and abs(row.sd - 1.2909944487) < 1e-9


def test_quantiles(spark):
    d = _df(spark, "g int, v double", [(0, float(i)) for i in range(10)])
    assert metrics.lower_quantile(d, "v", 0.95, ["g"]).first()["quantile"] == 8 and metrics.upper_median(d, "v", ["g"]).first()["median"] == 5


def test_decomposition(spark):
    targets = [(0, t, t == 1, t in (1, 2)) for t in (1, 2, 3, 4)] + [(1, t, True, True) for t in (5, 6, 7, 8)] + [(2, -1, True, True)] * 4
    rows = metrics.decompose(_df(spark, "query_id long, target long, hit boolean, reachable boolean", targets), 4)
    got = {r.query_id: (r.L, r.U, r.N) for r in rows.collect()}
    assert got == {0: (0.75, 0.5, 0.25), 1: (0, 0, 0), 2: (1, 1, 0)}
    assert checks.decomposition_identity(rows).first().broken == 0
    s = metrics.decomposition_summary(rows.withColumn("m", F.lit("x")), ["m"]).first()
    assert abs(s.L - 1.75 / 3) < 1e-12 and abs(s.u_share - 1.5 / 1.75) < 1e-12


def test_scoring_rows(spark):
    found = _df(spark, "query_id long, rank int, neighbor_id long, distance double", [(0, 1, 1, 1.0), (0, 2, 9, 2.0), (0, 3, -1, INF)])
    truth = _df(spark, "query_id long, rank int, neighbor_id long, distance double", [(0, 1, 1, 1.5), (0, 2, 2, 2.0), (0, 3, 3, 2.0)])
    row = metrics.score_rows(found, truth, _passing(spark, [1, 1, 1]), 2).first()
    assert (row.n_valid, row.filter_violations, row.distance_mismatches, row.gt_tie_at_k) == (2, 1, 1, 1)


def _sweep(spark):
    rows = []
    for c, s in (("random", 0.5), ("random", 1.0)):
        for q in range(3):
            for b, r in ((10, 0.8), (20, 0.9), (40, 1.0)):
                rows.append((c, s, "acorn", q, b, r if q else 0.5, 20 + b + q))
    return _df(spark, "correlation string, s_achieved double, method string, query_id long, budget int, recall double, dist_exact long", rows)


def test_oracle(spark):
    best = effort.oracle(_sweep(spark), 0.9, ["correlation", "s_achieved", "method"])
    rows = {(r.s_achieved, r.query_id): r for r in best.collect()}
    assert (rows[0.5, 1].oracle_budget, rows[0.5, 1].oracle_dist, rows[0.5, 1].censored) == (20, 41, False)
    assert (rows[0.5, 0].oracle_budget, rows[0.5, 0].oracle_dist, rows[0.5, 0].censored) == (None, INF, True)
    at = effort.effort_at_oracle(best, _sweep(spark), ["correlation", "s_achieved", "method"], "dist_exact")
    assert {r.oracle_dist_exact for r in at.where("query_id = 2").collect()} == {42}
    ratio = effort.ratio_to_unfiltered(best, ["correlation", "method"])
    assert {r.log2_ratio for r in ratio.collect()} == {0}
    summary = {r.correlation: r for r in effort.grouping_summary(best, ["method"], "correlation").collect()}
    assert set(summary) == {"random", "both"} and abs(summary["both"].censored_share - 1 / 3) < 1e-12


def test_crossing_and_rate(spark):
    curve = _df(spark, "m string, efs int, recall double, effort double", [("a", 10, 0.70, 400.0), ("a", 20, 0.78, 500.0), ("a", 30, 0.86, 700.0)])
    row = effort.crossing(curve, ["m"], "efs", "recall", 0.8).first()
    assert (row.x_lo, row.x_hi) == (20, 30) and abs(row.effort - 550) < 1e-9
    points = _df(spark, "m string, r double, q double", [("a", 0.8, 1e5), ("a", 1.0, 1e3)])
    assert abs(effort.rate_at_recall(points, ["m"], "r", "q", 0.9).first().rate - 1e4) < 1e-6


def test_not_dominated(spark):
    cases = [(1, 1, 2, 2), (2, 2, 1, 1), (1, 3, 2, 2), (3, 1, 2, 2), (2, 2, 2, 2)]
    got = [r.x for r in _df(spark, "a int, b int, c int, d int", cases).select(effort.not_dominated(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()]
    assert got == [False, True, True, True, False]


def test_signs_holm_spearman(spark):
    d = _df(spark, "g int, a double, b double", [(0, 1.0, 2.0), (0, 2.0, 2.0), (0, 3.0, 4.0), (0, INF, 1.0), (0, 5.0, INF)])
    row = statistics.sign_test(statistics.sign_counts(d, "a", "b", ["g"])).first()
    assert (row.less, row.greater, row.ties) == (3, 1, 1) and abs(row.p - 0.625) < 1e-12
    p = _df(spark, "i int, p double", list(enumerate([0.01, 0.04, 0.03, 0.5])))
    assert [round(r.p_holm, 12) for r in statistics.holm(p, "p", []).orderBy("i").collect()] == [0.04, 0.09, 0.09, 0.5]
    s = _df(spark, "g int, x double, y double", [(0, float(i), float(i * i)) for i in range(6)] + [(1, 1.0, float(i)) for i in range(6)] + [(2, 1.0, 1.0), (2, 2.0, 2.0)])
    assert {r.g: r.rho for r in statistics.spearman(s, "x", "y", ["g"]).collect()} == {0: 1.0, 1: None, 2: None}


def test_rank_tests(spark):
    d = np.array([1.0, -2.0, 3.0, 4.0, 5.0, -0.5, 0.0, 2.0])
    got = statistics.wilcoxon_groups(_df(spark, "g int, d double", [(0, float(x)) for x in d] + [(1, 0.0)]), ["g"], "d")
    rows = {r.g: r.p for r in got.collect()}
    assert abs(rows[0] - statistics.wilcoxon(d)) < 1e-12 and rows[1] == 1 and 0.05 < rows[0] < 0.2
    k = _df(spark, "m string, g int, v double", [("a", i % 3, float(i % 3 * 10 + i)) for i in range(30)] + [("b", i % 2, 1.0) for i in range(8)])
    rows = {r.m: r for r in statistics.kruskal_wallis(k, ["m"], "g", "v").collect()}
    assert rows["a"].p < 0.01 and rows["a"].df == 2 and rows["b"].p == 1


def test_intervals(spark):
    d = _df(spark, "g int, v double", [(0, x) for x in (1.0, 2.0, 3.0, 4.0, 5.0)] + [(1, 1.0)])
    rows = {r.g: r for r in statistics.t_interval(d, ["g"], "v").collect()}
    assert abs(rows[0].high - (3 + 2.776445105 * math.sqrt(2.5 / 5))) < 1e-6 and rows[1].low is None
    b = {r.g: r for r in statistics.bootstrap_groups(d, ["g"], "v", resamples=400).collect()}
    assert b[0].low < 3 < b[0].high and b[1].low == b[1].high == 1
    again = {r.g: r for r in statistics.bootstrap_groups(d.repartition(3), ["g"], "v", resamples=400).collect()}
    assert b == again
    m = _df(spark, "g int, i long, v double", [(0, i, float(i)) for i in range(50)])
    means = [r["mean"] for r in statistics.poisson_bootstrap(m, ["g"], "i", "v", 50).collect()]
    assert len(means) == 50 and abs(np.mean(means) - 24.5) < 2


def test_judgement_and_calibration(spark):
    null = _df(spark, "level string, value double", [("a", float(i)) for i in range(99)])
    seen = _df(spark, "level string, correlation string, value double", [("a", "random", 50.0), ("a", "clustered", 200.0), ("a", "clustered", 5.0)])
    got = {(r.correlation, r.value): r.accepted for r in statistics.null_judgement(seen, null, ["level"], 0.05, 1).collect()}
    assert got == {("random", 50.0): True, ("clustered", 200.0): True, ("clustered", 5.0): False}
    m = _df(spark, "clusters int, level string, kappa double, dispersion double", [(10, "x", 0.5, 4.0), (20, "x", 0.495, 4.0), (40, "x", 0.3, 4.0), (80, "x", 0.6, 1.0)])
    assert [r.clusters for r in statistics.calibrate_clusters(m, 0.2).where("chosen").collect()] == [20]
    wide = _df(spark, "c string, a double, b double", [("x", float(i), float(2 * i)) for i in range(1, 20)])
    row = statistics.paired_comparison(wide, [("a", "b")], ["c"], resamples=100).first()
    assert row.estimate == -1 and row.significant


def test_decide(spark):
    p = _df(spark, "p array<double>", [([0.1, 0.6, 0.6],), ([0.1, 0.2, 0.9],), ([0.5, 0.6, 0.7],)])
    assert [r.i for r in p.select(policy.decide(F.col("p"), 0.5).alias("i")).collect()] == [1, 2, 0]


def _pairs(spark, rows):
    return _df(spark, "condition string, query_id long, p array<double>, cost array<double>, success array<int>", rows)


def test_tau(spark):
    pairs = _pairs(spark, [("c", 0, [0.2, 1.0], [10.0, 100.0], [0, 1]), ("c", 1, [0.9, 1.0], [10.0, 100.0], [1, 1])])
    tau, cost = policy.calibrate_tau(pairs, 1.0, 0.1)
    assert cost == 55 and 0.2 < tau <= 0.31
    assert policy.calibrate_tau(pairs, 0.5, 0.1)[1] == 10
    never = _pairs(spark, [("c", 0, [0.2, 0.9], [10.0, 100.0], [0, 0])])
    assert policy.calibrate_tau(never, 0.5, 0.1) == (INF, 100)


def test_mixture(spark):
    rows = [(q, c, b, int(b == 1 or q >= 3)) for q in range(4) for c in range(2) for b in range(2)]
    d = _df(spark, "query_id long, c int, budget_index int, success int", rows).withColumn("u", F.col("query_id") / 5.0 + 0.1)
    low, high, lam = policy.calibrate_mixture(d, 0.75)
    assert (low, high) == (0, 1) and abs(lam - 0.5) < 1e-12
    got = policy.assign_mixture(d.select("query_id", "u").distinct(), low, high, lam).orderBy("query_id").collect()
    assert [r.budget_index for r in got] == [1, 1, 0, 0]
    assert policy.calibrate_mixture(d, 0.25)[:2] == (0, 0) and policy.calibrate_mixture(d.where("query_id < 0 or budget_index >= 0").withColumn("success", F.lit(0)), 0.5)[1] == 1


def test_regret(spark):
    rows = [(5.0, 1, 2.0), (2.0, 1, 1.0), (1.0, 0, 3.0), (9.0, 0, INF)]
    d = _df(spark, "cost double, success int, oracle_cost double", rows)
    r = policy.regret(d).first()
    assert (r.avoidable_failures, r.overspend, r.underspend, r.censored) == (0.25, 2.0, 2.0, 0.25)
    got = [x[0] for x in d.select(policy.pair_regret(F.col("cost"), F.col("success"), F.col("oracle_cost"))).collect()]
    assert abs(got[0] - math.log2(2.5)) < 1e-12 and got[1] == 1 and got[2] == INF and got[3] is None


def test_policy_learns_a_separable_rule(spark):
    rows = [("c", q, b, [10.0, 100.0][b], int(b == 1 or q % 2 == 0), float(q % 2)) for q in range(60) for b in range(2)]
    d = _df(spark, "condition string, query_id long, budget_index int, cost double, success int, lid double", rows)
    with pytest.raises(ValueError):
        policy.check_features(["lid", "success"])
    for family in ("logistic", "tree"):
        predicted = policy.fit_success(d, ["lid"], 2, family)(d)
        pairs = policy.by_pair(predicted).persist()
        tau, cost = policy.calibrate_tau(pairs, 0.999, 0.05)
        assert cost == 55 and 0 < tau < 1
    out = {r.policy: r for r in policy.evaluate(pairs, {"cheap": F.lit(0), "router": policy.decide(F.col("p"), tau)}).collect()}
    assert out["cheap"].mean_success == 0.5 and out["router"].mean_success == 1
    assert policy.select_policy({"a": predicted, "b": predicted}, 0.999, 0.05)[0] == "a"
    per = _df(spark, "query_id long, cost double, base_cost double, success double, base_success double", [(q, 50.0 + q % 3, 100.0, 1.0, 1.0) for q in range(40)])
    assert policy.gate(per, 0.1, 0.05, -0.01, 100)["passed"] and not policy.gate(per, 0.9, 0.05, -0.01, 100)["passed"]


def test_checks(spark):
    s = _sweep(spark).withColumn("dist_native", F.col("dist_exact") - 1).withColumn("threshold", F.lit(5))
    keys = ["correlation", "s_achieved", "method", "budget", "query_id"]
    row = checks.completeness(s.unionByName(s.limit(1)).where("not (query_id = 2 and budget = 40)"), s, keys).first()
    assert row.missing == 2 and row.duplicates == 1 and row.not_finite == 0
    assert tuple(checks.accounting(s).first()) == (0, 0, 0)
    assert checks.accounting(s.withColumn("dist_native", F.col("dist_exact"))).first().acorn == 18
    assert tuple(checks.monotone(s, ["s_achieved"]).first()) == (0, 0)
    assert checks.monotone(s.withColumn("recall", 1 - F.col("recall")), ["s_achieved"]).first().recall_falls > 0
    a = _df(spark, "x int", [(1,), (1,), (2,)])
    assert tuple(checks.same_rows(a, _df(spark, "x int", [(1,), (3,)])).first()) == (2, 1)
    assert checks.inert_budgets(s, ["correlation", "s_achieved"], 10, ["threshold"]).first().differing == 0
    assert checks.inert_budgets(s, ["correlation", "s_achieved"], 10, ["dist_exact"]).first().differing > 0
    assert checks.one_value(a, "x").first()[0] == 1 and checks.violations(a, ["x"]).first()[0] == 4
    ids = _df(spark, "c int, h string", [(1, "a"), (2, "b"), (3, "a")])
    assert tuple(checks.swap_rejection(ids, ["h"]).first()) == (6, 2)
    assert checks.repeatable(lambda: spark.range(10))


def test_structure_record_and_criteria(spark):
    near = _lists(spark, [[0, 1, 2, 3], [4, 5, 6, 7]])
    edges = _df(spark, "src long, pos int, dst long", [(u, p, (u + p + 1) % 8) for u in range(8) for p in range(3)])
    base = _df(spark, "vec_id long, cluster int", [(i, i // 4) for i in range(8)])
    row = metrics.structure_record(near, edges, base, _passing(spark, [1, 1, 1, 0, 0, 0, 0, 0]), "cluster", 4, 2).first()
    assert (row["mean"], row.zero_fraction, row.partial_clusters, row.s_achieved, row.homophily) == (0.375, 0.5, 1, 0.375, 0.5)
    s = _df(spark, "correlation string, s double, k int, queries int, density_mean double, dispersion double, homophily double", [("random", 0.1, 100, 50, 0.1, 1.0, 0.1), ("clustered", 0.1, 100, 50, 0.1, 9.0, 0.7)])
    assert statistics.correlation_criteria(s).where("accepted").count() == 2
    assert statistics.correlation_criteria(s.withColumn("dispersion", F.lit(2.5))).where("accepted").count() == 0


def test_bootstrap_spearman(spark):
    d = _df(spark, "m string, q long, x double, y double", [("a", q, float(q + c), float(q * 2 - c)) for q in range(30) for c in range(2)] + [("b", q, 1.0, float(q)) for q in range(5)])
    rows = {r.m: r for r in statistics.bootstrap_spearman(d, ["m"], "q", "x", "y", 60).collect()}
    assert 0.9 < rows["a"].low <= rows["a"].high <= 1 and rows["a"].rho > 0.9 and rows["b"].rho is None


def test_signed_rank_is_exact_for_small_samples():
    """Known two-sided values: n = 5 all positive 1/16; n = 8 with rank sum 5 is 10/128."""
    assert statistics.wilcoxon(np.array([1.0, 2, 3, 4, 5])) == 2 / 32
    assert abs(statistics.signed_rank_p(8, 5.0) - 2 * 10 / 256) < 1e-12
    assert statistics.wilcoxon(np.zeros(4)) == 1.0
    ties = statistics.wilcoxon(np.array([1.0, 1, -1, 2, 3, 4]))
    assert ties != statistics.signed_rank_p(6, 19.0)  # ties go by the normal approximation


def test_trend_and_predictors(spark):
    rows = [("a", q, s, 1 - s + 0.01 * (q % 3)) for q in range(12) for s in (0.1, 0.5, 1.0)] + [("b", q, s, 0.0) for q in range(12) for s in (0.1, 0.5, 1.0)]
    df = _df(spark, "m string, q int, s double, u double", rows)
    got = {r.m: r for r in statistics.selectivity_trend(df, ["m"], "s", "u", [0.1, 0.5, 1.0]).collect()}
    assert got["a"].rho < -0.9 and got["a"].p < 1e-6 and abs(got["a"].u_1 - 0.51) < 1e-9
    assert got["b"].rho is None and got["b"].p is None and got["b"].u_0 == 0
    found = {r.measure: r for r in statistics.bootstrap_predictors(df.where("m = 'a'").withColumn("noise", (F.col("q") * 7 % 5).cast("double")), ["m"], "q", "u", ["s", "noise"], resamples=60).collect()}
    assert found["rho_s"].value < -0.9 and found["abs_rho_s_minus_noise"].low > 0
