"""Weight paths, labels and routing between candidates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import once
from .rolling import ratio
from .sequential import scan


@dataclass(frozen=True)
class Costs:
    cost_bps: float = 5.0
    cash_daily_return: float = 0.0
    gamma_risk: float = 1.0
    lambda_turnover: float = 0.0
    eta_drawdown: float = 0.0
    cash_hurdle_daily: float = 0.0
    default_candidate: str = "equal_blend"


def weight_path(weights: DataFrame, returns: DataFrame, calendar: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Daily returns, turnover, cost and utility of each candidate's weights (candidate_id, date, instrument,
    target_weight; duplicates are averaged). Dates of the calendar without weights are cash. Unknown forward returns
    count as zero.

    Only a candidate's changes are stored: a position's row on the day after it was last held carries the exit, so
    the product of calendar, instruments and candidates is never built.
    """
    weights = once(weights)
    days = once(calendar.select("date").distinct().withColumn("code", F.row_number().over(Window.orderBy("date"))))  # a row a day
    held = weights.groupBy("candidate_id", "date", "instrument").agg(F.avg("target_weight").alias("w")).join(days, "date")
    one = Window.partitionBy("candidate_id", "instrument").orderBy("code")
    held = held.withColumn("pw", F.when(F.lag("code").over(one) == F.col("code") - 1, F.lag("w").over(one)).otherwise(0.0)).withColumn("next", F.lead("code").over(one))
    held = held.join(returns.select("date", "instrument", "forward_return"), ["date", "instrument"], "left")
    entered = held.select("candidate_id", "code", (F.col("w") * F.coalesce("forward_return", F.lit(0.0))).alias("g"), F.abs(F.col("w") - F.col("pw")).alias("t"), F.abs("w").alias("a"), (F.col("forward_return").isNull() & (F.col("w") != 0)).cast("long").alias("m"))
    left = held.filter("next IS NULL OR next > code + 1").select("candidate_id", (F.col("code") + 1).alias("code"), F.lit(0.0).alias("g"), F.abs("w").alias("t"), F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("m"))
    by = entered.unionByName(left).groupBy("candidate_id", "code").agg(F.sum("g").alias("g"), F.sum("t").alias("t"), F.sum("a").alias("a"), F.sum("m").alias("m"))
    # candidates times days is the size of the result: each candidate gets a sequence of codes, and these their dates
    grid = weights.select("candidate_id").distinct().withColumn("code", F.explode(F.sequence(F.lit(1), F.lit(days.count()))))
    d = grid.join(by, ["candidate_id", "code"], "left").join(days, "code").na.fill(0.0, ["g", "t", "a"]).na.fill(0, ["m"])
    d = d.withColumn("cost_estimate", F.col("t") * (costs.cost_bps / 1e4))
    d = d.withColumn("net_return", F.when(F.col("a") > 0, F.col("g")).otherwise(costs.cash_daily_return) - F.col("cost_estimate"))
    w = Window.partitionBy("candidate_id").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__c", F.sum(F.log1p(F.greatest("net_return", F.lit(-0.99)))).over(w))
    d = d.withColumn("drawdown", F.max("__c").over(w) - F.col("__c"))
    rise = F.greatest(F.lit(0.0), F.col("drawdown") - F.coalesce(F.lag("drawdown").over(Window.partitionBy("candidate_id").orderBy("code")), F.lit(0.0)))
    d = d.withColumn("drawdown_increment", rise).withColumn("risk_penalty", 0.5 * costs.gamma_risk * F.col("net_return") * F.col("net_return"))
    u = F.col("net_return") - F.col("risk_penalty") - costs.lambda_turnover * F.col("t") - costs.eta_drawdown * F.col("drawdown_increment") - costs.cash_hurdle_daily
    return d.select("candidate_id", "date", F.col("g").alias("gross_return"), "cost_estimate", "net_return", F.col("t").alias("turnover"), "drawdown", "drawdown_increment", "risk_penalty", u.alias("net_utility"), F.col("m").alias("missing_forward_count"))


def portfolio_labels(weights: DataFrame, returns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Weight paths of all candidates and cash, with the utility above that of the default candidate."""
    weights = once(weights)
    calendar = once(weights.select("date").distinct())
    paths = once(weight_path(weights, returns, calendar, costs))
    net = costs.cash_daily_return
    zero = F.lit(0.0)
    cash = calendar.select(F.lit("cash").alias("candidate_id"), "date", F.lit(net).alias("gross_return"), zero.alias("cost_estimate"), F.lit(net).alias("net_return"), zero.alias("turnover"), zero.alias("drawdown"), zero.alias("drawdown_increment"), F.lit(0.5 * costs.gamma_risk * net**2).alias("risk_penalty"), F.lit(net - 0.5 * costs.gamma_risk * net**2 - costs.cash_hurdle_daily).alias("net_utility"), F.lit(0).cast("long").alias("missing_forward_count"))
    labels = paths.unionByName(cash)
    default = labels.filter(F.col("candidate_id") == costs.default_candidate).select("date", F.col("net_utility").alias("__d"))
    return labels.join(default, "date", "left").withColumn("delta_utility_vs_default", F.col("net_utility") - F.col("__d")).drop("__d", "missing_forward_count")


def simulate_candidates(weights: DataFrame, returns: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """The output panel of each candidate: returns, turnover, cost, drawdown, gross exposure, cash."""
    weights = once(weights)
    path = weight_path(weights, returns, weights.select("date").distinct(), Costs(cost_bps=cost_bps))
    gross = weights.groupBy("candidate_id", "date").agg(F.sum(F.abs("target_weight")).alias("gross_exposure"))
    return path.join(gross, ["candidate_id", "date"], "left").select(F.col("candidate_id").alias("model_id"), "date", "gross_return", "net_return", "turnover", F.col("cost_estimate").alias("cost"), "drawdown", F.coalesce("gross_exposure", F.lit(0.0)).alias("gross_exposure"), (1 - F.least(F.lit(1.0), F.coalesce("gross_exposure", F.lit(0.0)))).alias("cash_weight"))


def economics(outputs: DataFrame, keys: list[str], year: float = 252.0) -> DataFrame:
    """cum_log, sharpe (population deviation), max_drawdown_pct of equity, mean_turnover, n_days."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = outputs.withColumn("__c", F.sum(F.log1p(F.greatest("net_return", F.lit(-0.99)))).over(w)).withColumn("__m", F.max("__c").over(w))
    return d.groupBy(*keys).agg(F.max_by("__c", "date").alias("cum_log"), (ratio(F.avg("net_return"), F.stddev_pop("net_return")) * year**0.5).alias("sharpe"), (100 * F.max(1 - F.exp(F.col("__c") - F.greatest("__m", F.lit(0.0))))).alias("max_drawdown_pct"), F.avg("turnover").alias("mean_turnover"), F.count("*").alias("n_days"))


def viability(outputs: DataFrame, baseline: str) -> DataFrame:
    """Economics of each model, and what it has over the baseline."""
    e = economics(outputs, ["model_id"])
    b = e.filter(F.col("model_id") == baseline).select(F.col("cum_log").alias("__c"), F.col("sharpe").alias("__s"))
    return e.crossJoin(F.broadcast(b)).withColumn("delta_cum_log", F.col("cum_log") - F.col("__c")).withColumn("delta_sharpe", F.col("sharpe") - F.col("__s")).drop("__c", "__s")  # one row


def cost_sensitivity(outputs: DataFrame, folds: DataFrame, bps: list[float]) -> DataFrame:
    """Sharpe and summed net return of each model and fold (date, fold) at each cost."""
    d = outputs.join(folds, "date").withColumn("bps", F.explode(F.array(*[F.lit(float(x)) for x in bps]))).withColumn("r", F.col("gross_return") - F.col("turnover") * F.col("bps") / 1e4)
    return d.groupBy("model_id", "fold", "bps").agg((ratio(F.avg("r"), F.stddev_pop("r")) * 252**0.5).alias("sharpe"), F.sum("r").alias("net"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], metrics: dict[str, float]) -> DataFrame:
    """Whether two tables agree within a tolerance per metric; a row that one side lacks does not."""
    right = b.select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics])
    both = a.select(*keys, *metrics).join(right, keys, "full_outer")
    ok = F.lit(True)
    for m, tol in metrics.items():
        ok &= F.coalesce(F.abs(F.col(m) - F.col(f"__{m}")) <= tol, F.lit(False))
    return both.select(*keys, *[(F.col(m) - F.col(f"__{m}")).alias(f"delta_{m}") for m in metrics], ok.alias("within"))


# routing ------------------------------------------------------------------------------------------------------------


def equal_weight_decisions(labels: DataFrame, gate: str = "equal_weight_blend") -> DataFrame:
    """Equal JSON weights of all candidates of each date."""
    ids = F.sort_array(F.collect_set("candidate_id"))
    d = labels.groupBy("date").agg(ids.alias("ids"))
    return d.select("date", F.lit(gate).alias("gate_id"), F.to_json(F.map_from_arrays("ids", F.transform("ids", lambda x: F.lit(1.0) / F.size("ids")))).alias("model_weights_json"))


def validation_weights(labels: DataFrame, utility: str = "net_utility") -> DataFrame:
    """Softmax over candidates of the exponential of their mean training utility (exponentiated twice, on purpose)."""
    m = labels.filter("split = 'train'").groupBy("candidate_id").agg(F.exp(F.avg(utility)).alias("e"))
    top = m.agg(F.max("e").alias("top"))
    m = m.crossJoin(F.broadcast(top)).withColumn("x", F.exp(F.col("e") - F.col("top")))  # one row
    total = m.agg(F.sum("x").alias("total"))
    return m.crossJoin(F.broadcast(total)).select("candidate_id", (F.col("x") / F.col("total")).alias("weight"))  # one row


def regime_lookup(labels: DataFrame, regimes: DataFrame, default: str, utility: str = "net_utility") -> DataFrame:
    """Per date the candidate with the best mean training utility in that date's regime, else the default."""
    means = labels.filter("split = 'train'").join(regimes, "date").groupBy("regime", "candidate_id").agg(F.avg(utility).alias("u"))
    best = means.groupBy("regime").agg(F.min_by("candidate_id", F.struct(-F.col("u"), F.col("candidate_id"))).alias("best"))
    days = labels.select("date").distinct().join(regimes, "date", "left").join(best, "regime", "left")
    return days.select("date", F.coalesce("best", F.lit(default)).alias("selected_candidate_id"))


def recent_winner(labels: DataFrame, recent: str, default: str) -> DataFrame:
    """Per date the candidate with the largest lagged recent utility; ties by name."""
    best = labels.groupBy("date").agg(F.min_by("candidate_id", F.when(F.col(recent).isNotNull(), F.struct(-F.col(recent), F.col("candidate_id")))).alias("best"))
    return best.select("date", F.coalesce("best", F.lit(default)).alias("selected_candidate_id"))


def oracle_diagnostic(labels: DataFrame, utility: str = "net_utility") -> DataFrame:
    """Ex-post best candidate: a diagnostic that looks ahead, flagged as such."""
    return recent_winner(labels, utility, "none").withColumn("uses_future", F.lit(True))


def mixture_decisions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Even blend of two gates' weights (date, candidate_id, weight)."""
    return a.unionByName(b).groupBy("date", "candidate_id").agg((F.sum("weight") / 2).alias("weight"))


@dataclass(frozen=True)
class Router:
    uncertainty_k: float = 0.5
    cost_buffer: float = 0.0
    switch_margin: float = 0.0
    default_candidate: str = "equal_blend"
    temperature: float = 1.0
    rho: float = 0.2


def train_ridge_selector(df: DataFrame, features: list[str], target: str = "delta_utility_vs_default", alpha: float = 1.0) -> DataFrame:
    """One standardised ridge per candidate on training rows, solved from sums of products (one aggregation, no row
    leaves its partition before it is summed): candidate_id, coefficients, intercept, residual_std."""
    train = df.filter("split = 'train'").dropna(subset=[*features, target])
    k = len(features)
    aggs = [F.count("*").cast("double").alias("n"), F.avg(target).alias("my"), F.var_pop(target).alias("vy")]
    aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(features)] + [F.covar_pop(c, target).alias(f"c{i}") for i, c in enumerate(features)]
    aggs += [F.covar_pop(a, b).alias(f"s{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.to_dict("records"):
            s = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
            sd = np.sqrt(np.maximum(np.diag(s), 0))
            sd[sd == 0] = 1.0
            c = np.array([r[f"c{i}"] for i in range(k)], float)
            x = s / np.outer(sd, sd)
            beta = np.linalg.solve(x * r["n"] + alpha * np.eye(k), c / sd * r["n"]) / sd
            res = max(0.0, r["vy"] - 2 * beta @ c + beta @ s @ beta)
            out.append((r["candidate_id"], beta.tolist(), float(r["my"] - beta @ np.array([r[f"m{i}"] for i in range(k)])), float(np.sqrt(res))))
        return pd.DataFrame(out, columns=["candidate_id", "coefficients", "intercept", "residual_std"])

    sums = train.groupBy("candidate_id").agg(*aggs)
    return sums.mapInPandas(lambda it: (solve(p) for p in it), "candidate_id string, coefficients array<double>, intercept double, residual_std double")


def predict_deltas(df: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    x = sum((F.col("coefficients")[i] * F.col(c) for i, c in enumerate(features)), F.col("intercept"))
    return df.join(models, "candidate_id").withColumn("predicted_delta_utility", x).drop("coefficients", "intercept")


def route(predictions: DataFrame, router: Router = Router()) -> DataFrame:
    """Date by date: the best candidate if it clears k * residual_std + buffer, else the default; a change of candidate
    also needs the margin. Candidates of a date are gathered first (a few a date), then one pass runs over the dates."""
    days = predictions.groupBy("date").agg(F.min_by(F.struct("candidate_id", "predicted_delta_utility", "residual_std"), F.struct(-F.col("predicted_delta_utility"), F.col("candidate_id"))).alias("b"), F.to_json(F.map_from_entries(F.collect_list(F.struct("candidate_id", "predicted_delta_utility")))).alias("all"))
    days = days.select(F.lit(0).alias("one"), "date", F.col("b.candidate_id").alias("best"), F.col("b.predicted_delta_utility").alias("delta"), (router.uncertainty_k * F.col("b.residual_std") + router.cost_buffer).alias("buffer"), "all")

    def apply(p: pd.DataFrame) -> pd.DataFrame:
        import json

        p, now, out = p.sort_values("date", ignore_index=True), router.default_candidate, []
        for r in p.itertuples():
            if not r.delta > r.buffer:
                chosen, action = router.default_candidate, "abstain_default"
            else:
                chosen, action = r.best, "route"
                if chosen != now and r.delta - json.loads(r.all).get(now, 0.0) <= router.switch_margin:
                    chosen, action = now, "hold_inertia"
            out.append((r.date, chosen, action, r.delta, r.buffer, now))
            now = chosen
        return pd.DataFrame(out, columns=["date", "chosen_candidate_id", "action", "predicted_delta", "decision_buffer", "previous_candidate_id"])

    # a row a date: the sequence over dates has no key to split by
    kind = dict(predictions.dtypes)["date"]
    return days.groupBy("one").applyInPandas(apply, f"date {kind}, chosen_candidate_id string, action string, predicted_delta double, decision_buffer double, previous_candidate_id string")


def softmax_allocation(predictions: DataFrame, router: Router = Router()) -> DataFrame:
    """Softmax weights of the candidates (default and cash at 0), smoothed over dates: date, candidate_id, allocation."""
    ids = [r[0] for r in predictions.select("candidate_id").distinct().collect()]
    fixed = sorted({*ids, router.default_candidate, "cash"})
    grid = predictions.select("date").distinct().withColumn("candidate_id", F.explode(F.array(*[F.lit(x) for x in fixed])))
    p = predictions.select("date", "candidate_id", F.col("predicted_delta_utility").alias("v"))
    v = F.when(F.col("candidate_id") == router.default_candidate, 0.0).when((F.col("candidate_id") == "cash") & F.lit("cash" not in ids), 0.0).otherwise(F.col("v"))
    d = grid.join(p, ["date", "candidate_id"], "left").withColumn("v", v)
    day = Window.partitionBy("date")
    d = d.withColumn("e", F.coalesce(F.exp(router.temperature * (F.col("v") - F.max("v").over(day))), F.lit(0.0))).withColumn("s", F.col("e") / F.sum("e").over(day))
    rho = router.rho if router.rho > 0 else 1.0

    def smooth(p: pd.DataFrame) -> dict[str, np.ndarray]:
        x = p["s"].to_numpy(float)
        out = x.copy()
        for i in range(1, len(x)):
            out[i] = (1 - rho) * out[i - 1] + rho * x[i]
        return {"a": out}

    d = scan(d.select("date", "candidate_id", "s"), ["candidate_id"], ["date"], ["a"], smooth)
    return d.select("date", "candidate_id", (F.col("a") / F.sum("a").over(day)).alias("allocation"))


def policy_state(labels: DataFrame, keys: str = "candidate_id", utility: str = "net_utility", days: int = 20) -> DataFrame:
    """Per candidate and date the mean utility of the ``days`` rows before."""
    w = Window.partitionBy(keys).orderBy("date").rowsBetween(-days, -1)
    return labels.withColumn(f"cand_mean_utility_{days}", F.avg(utility).over(w))
