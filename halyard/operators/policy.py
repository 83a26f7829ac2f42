"""Budget policies: which search budget to spend on a query.

Long form throughout: (condition, query_id, budget_index, cost, success).  A condition and query
form a pair; budgets are few and their number fixes the width of a window or an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.operators.ranks import running_total

FEATURES = ("s_achieved", "rho_hat", "score_concentration", "lid", "centroid_dist")


def check_features(columns: list[str], allowed: tuple[str, ...] = FEATURES) -> list[str]:
    """Only features known before a search may train a policy."""
    extra = sorted(set(columns) - set(allowed))
    if extra:
        raise ValueError(f"not known before the search: {extra}")
    return list(columns)




def fit_success(train: DataFrame, features: list[str], budgets: int, family: str = "logistic", c: float = 1.0, depth: int = 3):
    """A model of success per budget: logistic regression, a tree, or a constant if one class is all
    there is.  Returns a function from rows to (keys, budget_index, p)."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    gather = VectorAssembler(inputCols=check_features(features), outputCol="raw_features")
    models = []
    for b in range(budgets):
        rows = gather.transform(train.where(F.col("budget_index") == b).withColumn("label", F.col("success").cast("double")))
        n, wins = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
        if not n or wins in (0, n):
            models.append((None, float(bool(n and wins))))
            continue
        scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True).fit(rows)
        kind = LogisticRegression(regParam=1.0 / (c * n), maxIter=200) if family == "logistic" else DecisionTreeClassifier(maxDepth=depth, seed=0)
        models.append((scale, kind.fit(scale.transform(rows))))

    def predict(rows: DataFrame) -> DataFrame:
        out = None
        for b, (scale, model) in enumerate(models):
            own = rows.where(F.col("budget_index") == b)
            if scale is None:
                part = own.withColumn("p", F.lit(model))
            else:
                part = model.transform(scale.transform(gather.transform(own))).withColumn("p", vector_to_array("probability")[1])
            part = part.select("condition", "query_id", "budget_index", "cost", "success", "p")
            out = part if out is None else out.unionByName(part)
        return monotone(out)

    return predict


def monotone(predicted: DataFrame) -> DataFrame:
    """Probabilities that never fall with the budget."""
    up = Window.partitionBy("condition", "query_id").orderBy("budget_index").rowsBetween(Window.unboundedPreceding, 0)
    return predicted.withColumn("p", F.max("p").over(up))


def out_of_fold(rows: DataFrame, folds: int, fit) -> DataFrame:
    """Predictions for each fold (column fold, by query) by a model of the others."""
    out = None
    for f in range(folds):
        part = fit(rows.where(F.col("fold") != f))(rows.where(F.col("fold") == f))
        out = part if out is None else out.unionByName(part)
    return out


def decide(probabilities: Column, tau: float | Column) -> Column:
    """Index of the cheapest budget whose (monotone) probability reaches tau; the last if none does."""
    return F.least(F.size(F.filter(probabilities, lambda p: p < tau)), F.size(probabilities) - 1)


def by_pair(predicted: DataFrame) -> DataFrame:
    """One row per pair with arrays over the budgets (p, cost, success)."""
    packed = predicted.groupBy("condition", "query_id").agg(F.sort_array(F.collect_list(F.struct("budget_index", "p", "cost", "success"))).alias("b"))
    return packed.select("condition", "query_id", F.col("b.p").alias("p"), F.col("b.cost").alias("cost"), F.col("b.success").alias("success"))


def tau_curve(pairs: DataFrame, step: float = 0.01, probe_cost: float = 0.0) -> DataFrame:
    """tau, mean cost and mean success on the grid 0, step, ..., 1."""
    count = int(round(1 / step))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: i * F.lit(step)))
    chosen = pairs.withColumn("tau", grid).withColumn("i", decide(F.col("p"), F.col("tau")))
    return chosen.groupBy("tau").agg(F.avg(F.element_at("cost", F.col("i") + 1) + probe_cost).alias("mean_cost"), F.avg(F.element_at("success", F.col("i") + 1).cast("double")).alias("mean_success"))


def calibrate_tau(pairs: DataFrame, target: float, step: float = 0.01, probe_cost: float = 0.0) -> tuple[float, float]:
    """(tau, mean cost): the cheapest feasible tau, the first of those that cost the same to nine
    decimals; (infinite, cost of the largest budget) if none is feasible."""
    feasible = tau_curve(pairs, step, probe_cost).where(F.col("mean_success") >= target - 1e-12)
    row = feasible.agg(F.min_by(F.struct("tau", "mean_cost"), F.struct(F.round("mean_cost", 9), "tau")).alias("best")).first()
    if row.best is not None:
        return row.best.tau, row.best.mean_cost
    return float("inf"), pairs.agg(F.avg(F.element_at("cost", -1) + probe_cost)).first()[0]


def calibrate_mixture(rows: DataFrame, target: float, unit: str = "u") -> tuple[int, int, float]:
    """(low budget, high budget, lambda): the fixed mixture of two neighbouring budgets that reaches the
    target over the queries in hash order; rows: query_id, budget_index, success, unit hash."""
    per = rows.groupBy("budget_index").agg(F.avg(F.col("success").cast("double")).alias("mean"), F.sum(F.col("success").cast("double")).alias("wins"), F.count(F.lit(1)).alias("n")).orderBy("budget_index").collect()  # one row per budget
    high = next((r.budget_index for r in per if r["mean"] >= target), per[-1].budget_index)
    if high == per[0].budget_index or all(r["mean"] < target for r in per):
        return high, high, 0.0 if high == per[0].budget_index else 1.0
    low = high - 1
    base = next(r for r in per if r.budget_index == low)
    gain = F.sum(F.when(F.col("budget_index") == high, F.col("success").cast("double")).when(F.col("budget_index") == low, -F.col("success").cast("double")).otherwise(0.0))
    gains = rows.groupBy("query_id", unit).agg(gain.alias("gain"))
    run = running_total(gains, [unit, "query_id"], "gain", "before")
    met = run.where(F.col("before") >= target * base.n - base.wins - 1e-9).agg(F.min(unit)).first()[0]
    return low, high, 1.0 if met is None else met


def assign_mixture(queries: DataFrame, low: int, high: int, lam: float, unit: str = "u") -> DataFrame:
    return queries.withColumn("budget_index", F.when(F.col(unit) < lam, high).otherwise(low))


def regret(chosen: DataFrame) -> DataFrame:
    """chosen: cost, success, oracle_cost (infinite if no budget succeeds).  Shares and sums of avoidable
    failures, overspending on successes and spending on hopeless pairs."""
    possible = F.col("oracle_cost") < float("inf")
    won = F.col("success").cast("boolean")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return chosen.agg(
        share(possible & ~won).alias("avoidable_failures"),
        F.avg(F.when(possible & won, F.col("cost") - F.col("oracle_cost"))).alias("overspend"),
        F.avg(F.when(possible & ~won, F.col("oracle_cost") - F.col("cost"))).alias("underspend"),
        share(~possible).alias("censored"),
    )


def pair_regret(cost: Column, success: Column, oracle_cost: Column) -> Column:
    """log2(cost / oracle cost); infinite for an avoidable failure, null for a censored pair."""
    return F.when(oracle_cost == float("inf"), F.lit(None).cast("double")).when(~success.cast("boolean"), F.lit(float("inf"))).otherwise(F.log2(cost / oracle_cost))


def gate(per_query: DataFrame, min_saving: float, alpha: float, min_delta: float, resamples: int = 1000, seed: int = 0) -> dict:
    """per_query: query_id, cost, base_cost, success, base_success (sums or means by query).  The verdict
    rests on bootstrap intervals over queries and a signed-rank test of the cost difference.  One row
    per query of a test set reaches the driver."""
    import numpy as np

    from halyard.operators.statistics import wilcoxon

    rows = per_query.orderBy("query_id").toPandas()
    cost, base = rows["cost"].to_numpy(float), rows["base_cost"].to_numpy(float)
    delta = rows["success"].to_numpy(float) - rows["base_success"].to_numpy(float)
    draw, savings, deltas = np.random.default_rng(seed), [], []
    for _ in range(resamples):
        i = draw.integers(0, len(rows), len(rows))
        savings.append(1 - cost[i].sum() / base[i].sum())
        deltas.append(delta[i].mean())
    saving, p = 1 - cost.sum() / base.sum(), wilcoxon(cost - base)
    low, high = np.percentile(savings, [2.5, 97.5])
    d_low, d_high = np.percentile(deltas, [2.5, 97.5])
    return {"saving": saving, "saving_low": low, "saving_high": high, "delta": delta.mean(), "delta_low": d_low, "delta_high": d_high, "p": p, "passed": bool(saving >= min_saving and low > 0 and p < alpha and d_low >= min_delta)}


def select_policy(candidates: dict[str, DataFrame], target: float, step: float = 0.01) -> tuple[str, float, float]:
    """The family whose calibrated out-of-fold cost is least: (name, tau, cost)."""
    found = [(*calibrate_tau(by_pair(rows), target, step), name) for name, rows in candidates.items()]
    tau, cost, name = min(found, key=lambda x: (x[1], x[2]))
    return name, tau, cost


def evaluate(pairs: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """Mean cost and success of policies given as index columns over ``by_pair`` rows."""
    out = None
    for name, index in policies.items():
        part = pairs.agg(F.lit(name).alias("policy"), F.avg(F.element_at("cost", index + 1)).alias("mean_cost"), F.avg(F.element_at("success", index + 1).cast("double")).alias("mean_success"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_conditions(pairs: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """The same per condition: condition, policy, mean_cost, mean_success, pairs."""
    out = None
    for name, index in policies.items():
        part = pairs.groupBy("condition").agg(F.lit(name).alias("policy"), F.avg(F.element_at("cost", index + 1)).alias("mean_cost"), F.avg(F.element_at("success", index + 1).cast("double")).alias("mean_success"), F.count(F.lit(1)).alias("pairs"))
        out = part if out is None else out.unionByName(part)
    return out


def fixed_curve(pairs: DataFrame) -> DataFrame:
    """What every budget alone would give: budget_index, mean_cost, mean_success."""
    each = pairs.select(F.posexplode(F.arrays_zip("cost", "success")).alias("budget_index", "at"))
    return each.groupBy("budget_index").agg(F.avg("at.cost").alias("mean_cost"), F.avg(F.col("at.success").cast("double")).alias("mean_success"))
