"""Tests and intervals.  Counts, ranks and moments are aggregated in Spark; the closed forms that
follow are evaluated on the few aggregated numbers.  Bootstraps run per group in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import special
from halyard.operators.ranks import running_total

#: Resamples drawn at a time, which bounds a group's memory.
BOOTSTRAP_STEP = 250


def bootstrap_interval(values: np.ndarray, statistic, resamples: int = 1000, ci: float = 0.95, seed: int = 0) -> tuple[float, float]:
    draw, found = np.random.default_rng(seed), []
    for at in range(0, resamples, BOOTSTRAP_STEP):
        found.append(statistic(values[draw.integers(0, len(values), (min(BOOTSTRAP_STEP, resamples - at), len(values)))], axis=1))
    low, high = np.percentile(np.concatenate(found), [50 * (1 - ci), 50 * (1 + ci)], method="linear")
    return float(low), float(high)


def bootstrap_groups(df: DataFrame, keys: list[str], value_col: str, median: bool = False, resamples: int = 1000, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """keys, estimate, low, high: percentile intervals of the mean (or median) of each group."""
    statistic = np.median if median else np.mean

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(pdf[value_col].to_numpy(float))  # the result must not depend on row order
        low, high = bootstrap_interval(values, statistic, resamples, ci, seed)
        return pdf[keys].head(1).assign(estimate=float(statistic(values)), low=low, high=high)

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", estimate double, low double, high double"
    return df.select(*keys, value_col).groupBy(*keys).applyInPandas(one, schema)


def poisson_bootstrap(df: DataFrame, keys: list[str], id_col: str, value_col: str, resamples: int = 200, seed: int = 0) -> DataFrame:
    """keys, resample, mean: each row counts in each resample with a Poisson(1) weight inverted from a
    hash, so groups of any size are resampled where their rows are, and any engine can repeat it."""
    digits = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col), F.col("resample")))
    u = F.conv(F.substring(digits, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    cdf = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
    weight = F.size(F.filter(F.array(*[F.lit(float(x)) for x in cdf]), lambda c: c <= F.col("u")))
    drawn = df.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("u", u).withColumn("w", weight)
    total = F.sum("w")
    return drawn.groupBy(*keys, "resample").agg(F.when(total > 0, F.sum(F.col("w") * F.col(value_col)) / F.when(total > 0, total)).alias("mean"))


def poisson_interval(df: DataFrame, keys: list[str], id_col: str, value_col: str, resamples: int = 200, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """keys, estimate, low, high: the mean with a percentile interval of ``poisson_bootstrap``."""
    drawn = poisson_bootstrap(df, keys, id_col, value_col, resamples, seed)
    ends = drawn.groupBy(*keys).agg(*[F.expr(f"percentile(mean, {p})").alias(name) for p, name in ((0.5 * (1 - ci), "low"), (0.5 * (1 + ci), "high"))])
    return df.groupBy(*keys).agg(F.avg(value_col).alias("estimate")).join(ends, keys)


def _rank_table(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Average rank of each distinct value, from counts: only distinct values are ordered."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        return running_total(counts, [column], "n", "_before").withColumn("rank", F.col("_before") + (F.col("n") + 1) / 2.0).drop("_before")
    order = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("rank", F.coalesce(F.sum("n").over(order), F.lit(0)) + (F.col("n") + 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """keys, n, rho: Pearson correlation of average ranks; null for a constant side or n < 3."""
    rx = _rank_table(df, x, keys).select(*keys, x, F.col("rank").alias("rx"))
    ry = _rank_table(df, y, keys).select(*keys, y, F.col("rank").alias("ry"))
    both = df.join(rx, [*keys, x]).join(ry, [*keys, y])
    moments = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.covar_pop("rx", "ry").alias("cov"))
    usable = (F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0)
    return moments.select(*keys, "n", F.when(usable, F.col("cov") / F.when(usable, F.col("sx") * F.col("sy"))).alias("rho"))


def bootstrap_spearman(df: DataFrame, keys: list[str], cluster: str, x: str, y: str, resamples: int = 500, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """keys, rho, low, high: rank correlation with an interval from resampling whole clusters (queries)."""

    def rho(a: np.ndarray, b: np.ndarray) -> float:
        ra, rb = pd.Series(a).rank().to_numpy(), pd.Series(b).rank().to_numpy()
        return float(np.corrcoef(ra, rb)[0, 1]) if len(a) >= 3 and ra.std() > 0 and rb.std() > 0 else float("nan")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([cluster, x, y], kind="stable")
        members = [g.index.to_numpy() for _, g in pdf.reset_index(drop=True).groupby(cluster)]
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        draw = np.random.default_rng(seed)
        found = [rho(a[i], b[i]) for i in (np.concatenate([members[j] for j in draw.integers(0, len(members), len(members))]) for _ in range(resamples))]
        found = [f for f in found if f == f]
        low, high = np.percentile(found, [50 * (1 - ci), 50 * (1 + ci)]) if found else (None, None)
        value = rho(a, b)
        return pdf[keys].head(1).assign(rho=value if value == value else None, low=low, high=high)

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", rho double, low double, high double"
    return df.select(*keys, cluster, x, y).groupBy(*keys).applyInPandas(one, schema)


def sign_counts(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return df.groupBy(*keys).agg(count(F.col(a) < F.col(b))("less"), count(F.col(a) > F.col(b))("greater"), count(F.col(a) == F.col(b))("ties"))


def sign_test(counts: DataFrame) -> DataFrame:
    """Adds the exact two-sided p; ties are dropped."""
    p = F.pandas_udf(lambda less, greater: pd.Series([special.binomial_two_sided(int(a), int(b)) for a, b in zip(less, greater)]), "double")
    return counts.withColumn("p", p("less", "greater"))


def holm(df: DataFrame, p: str, keys: list[str], out: str = "p_holm") -> DataFrame:
    """Holm-adjusted p: running maximum of (m - rank) p in ascending order, at most 1."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    order = own.orderBy(p)
    scaled = df.withColumn("_q", (F.count(F.lit(1)).over(own) - F.row_number().over(order) + 1) * F.col(p))
    return scaled.withColumn(out, F.least(F.lit(1.0), F.max("_q").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_q")


#: Up to so many differences without zeros and ties the signed-rank test is exact.
EXACT_RANKS = 50


def signed_rank_p(n: int, plus: float, ties: float = 0.0, zeros: int = 0) -> float:
    """Two-sided p from the number of differences that are not zero and their positive rank sum:
    exact for small samples without ties and zeros, else by the normal approximation with tie
    correction; 1 without differences."""
    if n == 0:
        return 1.0
    least = min(plus, n * (n + 1) / 2 - plus)
    if n <= EXACT_RANKS and not ties and not zeros:
        ways = np.ones(1)  # how many subsets of the ranks so far have each sum
        for rank in range(1, n + 1):
            ways = np.concatenate([ways, np.zeros(rank)]) + np.concatenate([np.zeros(rank), ways])
        return min(1.0, 2 * float(ways[: int(least) + 1].sum()) / 2.0**n)
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, 2 * special.normal_tail(abs(least - n * (n + 1) / 4) / math.sqrt(spread))) if spread > 0 else 1.0


def wilcoxon(differences: np.ndarray) -> float:
    """Two-sided signed-rank p of a sample; zeros dropped; 1 if all are zero."""
    d = differences[differences != 0]
    if not len(d):
        return 1.0
    _, inverse, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    return signed_rank_p(len(d), float(rank[d > 0].sum()), float((count**3 - count).sum()), len(differences) - len(d))


def wilcoxon_groups(df: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """keys, n, p from aggregated ranks of the absolute differences."""
    used = df.where(F.col(difference) != 0).withColumn("_abs", F.abs(difference))
    ranks = _rank_table(used, "_abs", keys)
    ties = ranks.groupBy(*keys).agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    signed = used.join(ranks.select(*keys, "_abs", "rank"), [*keys, "_abs"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("rank")).otherwise(0.0)).alias("plus"))
    zeros = df.groupBy(*keys).agg(F.sum(F.when(F.col(difference) == 0, 1).otherwise(0)).alias("zeros"))
    moments = zeros.join(signed.join(ties, keys), keys, "left").na.fill(0.0, ["plus", "ties"]).withColumn("n", F.coalesce("n", F.lit(0)))
    p = F.pandas_udf(lambda n, plus, ties, zeros: pd.Series([signed_rank_p(int(m), w, t, int(z)) for m, w, t, z in zip(n, plus, ties, zeros)], dtype="float64"), "double")
    return moments.select(*keys, "n", p("n", "plus", "ties", "zeros").alias("p"))


def spearman_p(n: Column, rho: Column) -> Column:
    """Two-sided p of a rank correlation by Student's t."""

    def tail(size, r):
        out = []
        for m, x in zip(size, r):
            if x != x or m < 3:
                out.append(None)
            else:
                out.append(0.0 if abs(x) >= 1 else 2 * special.student_cdf(-abs(x) * math.sqrt((m - 2) / (1 - x * x)), m - 2))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(tail, "double")(n, rho)


def selectivity_trend(df: DataFrame, keys: list[str], s: str, u: str, levels: list[float]) -> DataFrame:
    """keys, the mean of u at each selectivity (u_0, u_1, ...), and its rank correlation with s and the
    p of that, null where u is constant."""
    means = df.groupBy(*keys).agg(*[F.avg(F.when(F.abs(F.col(s) - x) <= 1e-9, F.col(u))).alias(f"u_{i}") for i, x in enumerate(levels)])
    return means.join(spearman(df, s, u, keys), keys, "left").withColumn("p", spearman_p(F.col("n"), F.col("rho")))


def bootstrap_predictors(df: DataFrame, keys: list[str], cluster: str, y: str, predictors: list[str], resamples: int = 500, ci: float = 0.95, seed: int = 0) -> DataFrame:
    """Rank correlations of y with each predictor, and for each pair of predictors the difference of
    the absolute ones, with intervals from resampling whole clusters: keys, measure, value, low, high.
    A group is a test set's pairs of one condition set, of bounded size."""
    pairs = [(a, b) for i, a in enumerate(predictors) for b in predictors[i + 1 :]]

    def measures(ranked: np.ndarray) -> np.ndarray:
        flat = ranked.std(axis=1) == 0
        with np.errstate(invalid="ignore", divide="ignore"):
            rho = np.corrcoef(ranked)[0, 1:] if ranked.shape[1] >= 3 else np.full(len(predictors), np.nan)
        rho = np.where(flat[0] | flat[1:], np.nan, rho)
        at = {p: abs(r) for p, r in zip(predictors, rho)}
        return np.concatenate([rho, [at[a] - at[b] for a, b in pairs]])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([cluster, y, *predictors], kind="stable").reset_index(drop=True)
        members = [g.index.to_numpy() for _, g in pdf.groupby(cluster)]
        values = pdf[[y, *predictors]].to_numpy(float)
        ranks = lambda rows: pd.DataFrame(values[rows]).rank().to_numpy().T
        draw = np.random.default_rng(seed)
        found = np.array([measures(ranks(np.concatenate([members[j] for j in draw.integers(0, len(members), len(members))]))) for _ in range(resamples)])
        low, high = (np.array([np.percentile(c[~np.isnan(c)], q) if (~np.isnan(c)).any() else np.nan for c in found.T]) for q in (50 * (1 - ci), 50 * (1 + ci)))
        names = [*[f"rho_{p}" for p in predictors], *[f"abs_rho_{a}_minus_{b}" for a, b in pairs]]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "measure": names, "value": measures(ranks(np.arange(len(values)))), "low": low, "high": high})[[*keys, "measure", "value", "low", "high"]]

    schema = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + "measure string, value double, low double, high double"
    return df.select(*keys, cluster, y, *predictors).groupBy(*keys).applyInPandas(one, schema)


def kruskal_wallis(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """keys, h, df, p: rank sums of the groups with tie correction; p = 1 if all values are equal."""
    ranks = _rank_table(df, value, keys)
    n_all = ranks.groupBy(*keys).agg(F.sum("n").cast("double").alias("n_all"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    sums = df.join(ranks.select(*keys, value, "rank"), [*keys, value]).groupBy(*keys, group).agg(F.sum("rank").alias("_sum"), F.count(F.lit(1)).alias("_size"))
    q = F.sum(F.col("_sum") * F.col("_sum") / F.col("_size")).alias("q")
    h = sums.groupBy(*keys).agg(q, (F.count(F.lit(1)) - 1).alias("df"))
    h = h.join(n_all, keys) if keys else h.join(F.broadcast(n_all))
    n = F.col("n_all")
    correction = 1 - F.col("ties") / F.when(n > 1, n * n * n - n).otherwise(1.0)
    value_h = F.when(correction > 0, (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.when(correction > 0, correction))
    p = F.pandas_udf(lambda x, d: pd.Series([1.0 if a != a else special.chi_square_tail(a, int(b)) for a, b in zip(x, d)]), "double")
    return h.withColumn("h", value_h).select(*keys, "h", "df", p(F.col("h"), F.col("df")).alias("p"))


def t_interval(df: DataFrame, keys: list[str], value: str, ci: float = 0.95) -> DataFrame:
    """keys, n, mean, low, high by Student's t; null bounds for n < 2."""
    moments = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    quantile = F.pandas_udf(lambda n: pd.Series([special.student_quantile(0.5 + ci / 2, m - 1) if m >= 2 else None for m in n], dtype="float64"), "double")
    half = quantile("n") * F.col("sd") / F.sqrt("n")
    return moments.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def null_judgement(observed: DataFrame, null: DataFrame, keys: list[str], family_alpha: float, tests: int) -> DataFrame:
    """Each observed (keys, correlation, value) against its null draws (keys, value): a random attribute
    must not be extreme on either side, a clustered one must be extreme above (Bonferroni)."""
    alpha = family_alpha / tests
    joined = observed.join(null.withColumnRenamed("value", "drawn"), keys)
    p = joined.groupBy(*keys, "correlation", "value").agg(((1 + F.sum((F.col("drawn") >= F.col("value")).cast("int"))) / (F.count(F.lit(1)) + 1)).alias("p_upper"), ((1 + F.sum((F.col("drawn") <= F.col("value")).cast("int"))) / (F.count(F.lit(1)) + 1)).alias("p_lower"))
    good = F.when(F.col("correlation") == "random", (F.col("p_upper") > alpha / 2) & (F.col("p_lower") > alpha / 2)).otherwise(F.col("p_upper") <= alpha)
    return p.withColumn("accepted", good)


def paired_comparison(wide: DataFrame, pairs: list[tuple[str, str]], keys: list[str], alpha: float = 0.05, resamples: int = 1000) -> DataFrame:
    """For pairs of methods (columns of effort, infinite if censored): sign test, median log2 ratio with
    its bootstrap interval, Holm over all rows."""
    from halyard.functions.scalars import log2_ratio

    long = None
    for a, b in pairs:
        part = wide.select(*keys, F.lit(f"{a}/{b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b"))
        long = part if long is None else long.unionByName(part)
    long = long.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("ratio", log2_ratio(F.col("a"), F.col("b")))
    signs = sign_test(sign_counts(long, "a", "b", [*keys, "pair"]))
    middle = bootstrap_groups(long, [*keys, "pair"], "ratio", median=True, resamples=resamples)
    out = holm(signs.join(middle, [*keys, "pair"]), "p", [])
    return out.withColumn("significant", F.col("p_holm") < alpha)


def calibrate_clusters(measures: DataFrame, kappa_min: float, d_min: float = 3.0, slack: float = 0.01) -> DataFrame:
    """measures: clusters, level, kappa, dispersion.  Eligible: kappa and dispersion suffice at every level;
    chosen: the largest count whose least kappa is within ``slack`` of the best."""
    per = measures.groupBy("clusters").agg(F.min("kappa").alias("least_kappa"), F.min(((F.col("kappa") >= kappa_min) & (F.col("dispersion") >= d_min)).cast("int")).alias("ok"))
    eligible = F.col("ok") == 1
    best = Window.partitionBy(F.lit(1))  # one row per cluster count
    near = eligible & (F.col("least_kappa") >= F.max(F.when(eligible, F.col("least_kappa"))).over(best) - slack)
    chosen = F.col("clusters") == F.max(F.when(F.col("near"), F.col("clusters"))).over(best)
    return per.withColumn("near", near).select("clusters", "least_kappa", eligible.alias("eligible"), F.coalesce(chosen, F.lit(False)).alias("chosen"))


def correlation_criteria(structure: DataFrame) -> DataFrame:
    """structure: correlation, s, k, queries, density_mean, dispersion, homophily.  The first form of the
    test of attributes, kept for the record: a random attribute disperses like chance (index 0.5 to 2)
    around s (within four standard errors) without homophily; a clustered one disperses at least
    three times and at least twice as much as the random one at the same s."""
    random = structure.where("correlation = 'random'").select("s", "k", F.col("dispersion").alias("random_dispersion"), F.col("homophily").alias("random_homophily"))
    both = structure.join(random, ["s", "k"])
    error = F.sqrt(F.col("s") * (1 - F.col("s")) / (F.col("k") * F.col("queries")))
    ok_random = F.col("dispersion").between(0.5, 2) & (F.abs(F.col("density_mean") - F.col("s")) <= 4 * error)
    ok_clustered = (F.col("dispersion") >= 3) & (F.col("dispersion") >= 2 * F.col("random_dispersion")) & (F.col("homophily") > F.col("random_homophily"))
    return both.withColumn("accepted", F.when(F.col("correlation") == "random", ok_random).otherwise(ok_clustered))
