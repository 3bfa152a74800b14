"""Statistical validity: moments, deflated Sharpe ratios, overfitting, bootstrap, tests of series.

Moments, correlations and ranks are aggregations. Tests that need a regression per series run in one grouped pass; the
distribution functions that they need are written here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, normal_pdf, normal_ppf
from .rolling import average_rank, ratio

EULER = 0.5772156649
YEAR = 252


def moments(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """n, mean, std (sample), skew and excess kurtosis (population), sharpe a year."""
    s = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"))
    return s.withColumn("sharpe", ratio(F.col("mean"), F.col("std")) * math.sqrt(YEAR))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, n_trials: int = 1, benchmark: float = 0.0, year: int = YEAR) -> dict:
    """The z-value of an annual Sharpe ratio above what the best of ``n_trials`` is expected to show; PASS if its
    p-value is at most 5 %."""
    expected = benchmark
    if n_trials > 1:
        z = normal_ppf(1 - 1 / n_trials)
        expected = (1 - EULER) * z + EULER * normal_pdf(z)
    s = sharpe / math.sqrt(year)
    var = (1 + 0.5 * s * s - skew * s + kurtosis / 4 * s * s) / n
    if var <= 0:
        raise ValueError("the variance of the Sharpe ratio is not positive")
    dsr = (sharpe - expected) / math.sqrt(var * year)
    p = 1 - normal_cdf(dsr)
    return {"sharpe_ratio": round(sharpe, 6), "dsr": round(dsr, 6), "p_value": round(p, 6), "gate_result": "PASS" if p <= 0.05 else "FAIL"}


def min_track_record(sharpe: float, n: int, skew: float, kurtosis: float, confidence: float = 0.95, benchmark: float = 0.0, year: int = YEAR) -> dict:
    """Years of returns that are needed to tell the Sharpe ratio from the benchmark."""
    s, b = sharpe / math.sqrt(year), benchmark / math.sqrt(year)
    if s <= b:
        return {"min_trl_years": math.inf, "actual_years": n / year, "gate_result": "WARN"}
    need = 1 + (1 - skew * s + (kurtosis + 2) / 4 * s * s) * (normal_ppf(confidence) / (s - b)) ** 2
    return {"min_trl_years": need / year, "actual_years": n / year, "gate_result": "PASS" if n >= need else "WARN"}


def validity(df: DataFrame, x: str, keys: list[str], n_trials: int = 1) -> DataFrame:
    """Moments, deflated Sharpe ratio and minimum track record of each key, and the worst gate. One row a key."""
    m = moments(df, x, keys).filter("n >= 3 AND std > 0")

    def apply(batches):
        for p in batches:
            rows = []
            for r in p.to_dict("records"):
                a = (r["sharpe"], int(r["n"]), r["skew"], r["kurtosis"])
                d, t = deflated_sharpe(*a, n_trials=n_trials), min_track_record(*a)
                worst = "FAIL" if d["gate_result"] == "FAIL" else t["gate_result"]
                rows.append((*(r[k] for k in keys), int(r["n"]), d["sharpe_ratio"], d["dsr"], d["p_value"], d["gate_result"], round(t["min_trl_years"], 6), t["gate_result"], worst))
            yield pd.DataFrame(rows, columns=[*keys, "n", "sharpe", "dsr", "p_value", "dsr_gate", "min_trl_years", "trl_gate", "gate"])

    kinds = dict(m.dtypes)
    return m.mapInPandas(apply, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, sharpe double, dsr double, p_value double, dsr_gate string, min_trl_years double, trl_gate string, gate string")


def bootstrap_sharpe(df: DataFrame, x: str, order: str, keys: list[str], n_resamples: int = 1000, block: int | None = None, seed: int = 42) -> DataFrame:
    """Block-bootstrap interval of the Sharpe ratio of each key's series; blocks of the cube root of its length."""

    def apply(p: pd.DataFrame) -> pd.DataFrame:
        v = p.sort_values(order)[x].dropna().to_numpy(float)
        n = len(v)
        head = {k: p[k].iloc[0] for k in keys}
        if n < 10:
            return pd.DataFrame([{**head, "n": n, "sharpe": None, "lo95": None, "hi95": None, "lo99": None, "hi99": None, "gate": "FAIL"}])
        size = block or math.ceil(n ** (1 / 3))
        rng = np.random.default_rng(seed)
        stats = np.empty(n_resamples)
        k = -(-n // size)
        for i in range(0, n_resamples, 100):
            m = min(100, n_resamples - i)
            starts = rng.integers(0, n - size + 1, (m, k))
            s = v[(starts[:, :, None] + np.arange(size)).reshape(m, -1)[:, :n]]
            sd, mean = s.std(axis=1, ddof=1), s.mean(axis=1)
            stats[i : i + m] = np.divide(mean, sd, out=np.zeros(m), where=sd > 0) * math.sqrt(YEAR)
        lo95, hi95, lo99, hi99 = np.quantile(stats, [0.025, 0.975, 0.005, 0.995])
        sd = v.std(ddof=1)
        return pd.DataFrame([{**head, "n": n, "sharpe": v.mean() / sd * math.sqrt(YEAR) if sd > 0 else 0.0, "lo95": lo95, "hi95": hi95, "lo99": lo99, "hi99": hi99, "gate": "PASS" if lo95 > 0 else "FAIL"}])

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(apply, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, sharpe double, lo95 double, hi95 double, lo99 double, hi99 double, gate string")


def overfitting(records: DataFrame, path: str = "path", trial: str = "trial", inside: str = "is_score", outside: str = "oos_score", higher: bool = True) -> DataFrame:
    """Probability of backtest overfitting: on each path the best trial inside is ranked outside; pbo is the share of
    paths where its relative rank is below one half. Ties inside go to the first trial."""
    sign = 1 if higher else -1
    r = records.withColumn("__o", sign * F.col(outside))
    r = average_rank(r, "__o", [path], "__rank").withColumn("__n", F.count("*").over(Window.partitionBy(path)))
    best = r.groupBy(path).agg(F.min_by(F.struct(F.col("__rank"), F.col("__n")), F.struct(-sign * F.col(inside), F.col(trial))).alias("b"))
    rel = best.select(path, (F.col("b.__rank") / (F.col("b.__n") + 1)).alias("relative_rank"))
    return rel.agg(F.count("*").alias("n_paths"), F.avg((F.col("relative_rank") < 0.5).cast("double")).alias("pbo"), F.avg("relative_rank").alias("mean_rank"))


def path_pairs(records: DataFrame, path: str = "path") -> DataFrame:
    """Per path the lists of trials with their scores, by trial."""
    return records.groupBy(path).agg(F.sort_array(F.collect_list(F.struct("trial", "is_score", "oos_score"))).alias("trials"))


def walk_forward_surface(outputs: DataFrame, candidate: str = "model_id", fold: str = "fold", net: str = "net_return") -> DataFrame:
    """Per candidate and fold the Sharpe of the fold (outside) and of all other folds (inside), from sums per fold, so
    nothing is joined with itself row by row."""
    s = outputs.groupBy(candidate, fold).agg(F.count(net).cast("double").alias("n"), F.sum(net).alias("s"), F.sum(F.col(net) * F.col(net)).alias("q"))
    w = Window.partitionBy(candidate)
    sharpe = lambda n, s, q: F.when(n > 1, ratio(s / n, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))) * math.sqrt(YEAR))
    rest = [F.sum(c).over(w) - F.col(c) for c in ("n", "s", "q")]
    d = s.withColumns(dict(zip(("rn", "rs", "rq"), rest)))
    return d.select(F.col(fold).alias("path"), F.col(candidate).alias("trial"), sharpe(F.col("rn"), F.col("rs"), F.col("rq")).alias("is_score"), sharpe(F.col("n"), F.col("s"), F.col("q")).alias("oos_score"))


def harvey_t(sharpe, n, year: int = YEAR):
    return sharpe * F.sqrt(n / F.lit(float(year)))


def crisis_report(returns: DataFrame, windows: list[tuple[str, str, str]], ret: str, date: str = "date") -> DataFrame:
    """n, mean and Sharpe inside each named window of dates (closed) and outside all of them."""
    name = None
    for label, a, z in windows:
        cond = F.col(date).between(F.lit(a).cast("date"), F.lit(z).cast("date"))
        name = F.when(cond, label) if name is None else name.when(cond, label)
    d = returns.withColumn("window", F.coalesce(name, F.lit("outside")) if name is not None else F.lit("outside"))
    return d.groupBy("window").agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), (ratio(F.avg(ret), F.stddev_samp(ret)) * math.sqrt(YEAR)).alias("sharpe"))


def ljung_box(df: DataFrame, x: str, keys: list[str], order: list[str], lags: int = 10) -> DataFrame:
    """n and Q statistic of each series over ``lags`` autocorrelations; windows and one aggregation."""
    d = df.filter(F.col(x).isNotNull()).withColumn("__d", F.col(x) - F.avg(x).over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy(*order)
    d = d.select(*keys, "__d", *[F.lag("__d", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)])
    g = d.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("v"), *[F.sum(F.col("__d") * F.col(f"__l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    r = lambda k: ratio(F.coalesce(F.col(f"c{k}"), F.lit(0.0)), F.col("v"))
    q = sum((F.when(F.col("n") > k, r(k) * r(k) / (F.col("n") - k)).otherwise(0.0) for k in range(1, lags + 1)), F.lit(0.0))
    return g.select(*keys, F.col("n").cast("long").alias("n"), (F.col("n") * (F.col("n") + 2) * q).alias("q_stat"))


# distribution functions ----------------------------------------------------------------------------------------------


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(1000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def f_sf(x: float, a: float, b: float) -> float:
    return 1.0 if x <= 0 else beta_regularised(b / 2, a / 2, b / (b + a * x))


# tests of one series or of a pair -------------------------------------------------------------------------------------

#: Fixed: MacKinnon's response surface for the unit-root test with a constant: limits, and polynomials of the statistic
#: for small and for large p-values.
ADF_MAX, ADF_MIN, ADF_STAR = 2.74, -18.83, -1.61
ADF_SMALL = [2.1659, 1.4412, 0.038269]
ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
#: Fixed: critical values of the stationarity test around a constant and their levels.
KPSS_VALUES, KPSS_LEVELS = [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]
#: Fixed: 95 % critical values of the trace and of the largest eigenvalue, by the number of remaining series.
TRACE_95 = [3.8415, 15.4943, 29.7961, 47.8545, 69.8189]
EIGEN_95 = [3.8415, 14.2639, 21.1314, 27.5858, 33.8777]


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = e @ e / max(1, len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(s2 * np.linalg.pinv(x.T @ x))), float(e @ e)


def adf(x: np.ndarray, max_lag: int | None = None) -> dict:
    """Augmented Dickey-Fuller with a constant; the number of lags by AIC over the same rows."""
    d = np.diff(x)
    n = len(x)
    max_lag = max_lag if max_lag is not None else max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3))

    def fit(k: int, first: int):
        y = d[first:]
        cols = [x[first:-1], *[d[first - i : len(d) - i] for i in range(1, k + 1)], np.ones(len(y))]
        return y, np.column_stack(cols)

    def aic(k: int) -> float:
        y, z = fit(k, max_lag)
        _, _, rss = _ols(y, z)
        return len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * z.shape[1]

    k = min(range(max_lag + 1), key=aic)
    y, z = fit(k, k)
    beta, se, _ = _ols(y, z)
    t = float(beta[0] / se[0]) if se[0] > 0 else 0.0
    poly = ADF_SMALL if t <= ADF_STAR else ADF_LARGE
    p = 1.0 if t > ADF_MAX else 0.0 if t < ADF_MIN else normal_cdf(sum(c * t**i for i, c in enumerate(poly)))
    return {"statistic": t, "p_value": p, "lags": k}


def kpss(x: np.ndarray) -> dict:
    """Stationarity around a constant; the bandwidth from the data; p-values between 1 % and 10 % by interpolation."""
    n = len(x)
    e = x - x.mean()
    cov = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cov + 1):
        c = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0, n - 1)
    s = e @ e
    for i in range(1, lags + 1):
        s += 2 * (e[i:] @ e[: n - i]) * (1 - i / (lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / (s / n)) if s > 0 else 0.0
    return {"statistic": stat, "p_value": float(np.interp(stat, KPSS_VALUES, KPSS_LEVELS)), "lags": lags}


def ljung_box_test(x: np.ndarray, lags: int | None = None) -> dict:
    n = len(x)
    lags = lags or max(1, min(10, n // 5))
    e = x - x.mean()
    v = e @ e
    q = n * (n + 2) * sum((e[k:] @ e[:-k] / v) ** 2 / (n - k) for k in range(1, lags + 1)) if v > 0 else 0.0
    return {"statistic": float(q), "p_value": chi2_sf(q, lags), "lags": lags}


def granger(y: np.ndarray, x: np.ndarray, max_lag: int = 5) -> dict:
    """Whether the past of ``x`` helps to predict ``y``: the smallest p-value of the F tests with 1 to ``max_lag`` lags."""
    best = None
    for k in range(1, max_lag + 1):
        own = np.column_stack([y[k - i : len(y) - i] for i in range(1, k + 1)] + [np.ones(len(y) - k)])
        both = np.column_stack([own, *[x[k - i : len(x) - i] for i in range(1, k + 1)]])
        dof = len(own) - both.shape[1]
        if dof < 1:
            break
        a, b = _ols(y[k:], own)[2], _ols(y[k:], both)[2]
        f = (a - b) / k / (b / dof) if b > 0 else 0.0
        p = f_sf(f, k, dof)
        if best is None or p < best["p_value"]:
            best = {"statistic": float(f), "p_value": p, "lags": k}
    return best or {"statistic": 0.0, "p_value": 1.0, "lags": 0}


def johansen(x: np.ndarray, k: int = 1) -> dict:
    """Trace and largest-eigenvalue statistics with a constant; the rank is the number of traces over their 95 % value."""
    x = x - x.mean(axis=0)
    d = np.diff(x, axis=0)
    z = np.column_stack([d[k - i : len(d) - i] for i in range(1, k + 1)]) if k else np.zeros((len(d), 0))
    y, lagged = d[k:], x[k:-1]
    center = lambda m: m - m.mean(axis=0)
    y, lagged, z = center(y), center(lagged), center(z)
    res = lambda m: m - z @ np.linalg.lstsq(z, m, rcond=None)[0] if z.shape[1] else m
    r0, r1 = res(y), res(lagged)
    n = len(y)
    s00, s11, s01 = r0.T @ r0 / n, r1.T @ r1 / n, r0.T @ r1 / n
    lam = np.sort(np.linalg.eigvals(np.linalg.pinv(s11) @ s01.T @ np.linalg.pinv(s00) @ s01).real)[::-1]
    lam = np.clip(lam, 0, 1 - 1e-12)
    trace = [-n * np.log(1 - lam[i:]).sum() for i in range(len(lam))]
    rank = 0
    for i, t in enumerate(trace):
        if t <= TRACE_95[len(lam) - i - 1]:
            break
        rank += 1
    return {"statistic": float(trace[0]), "max_eigen": float(-n * np.log(1 - lam[0])), "rank": rank, "p_value": 0.05 if rank else 1.0, "lags": k}


TESTS: dict[str, tuple[int, Callable]] = {"adf": (1, adf), "kpss": (1, kpss), "ljung_box": (1, ljung_box_test), "granger": (2, granger), "johansen": (2, lambda a, b: johansen(np.column_stack([a, b])))}


def register_test(name: str, n_series: int, f: Callable) -> None:
    TESTS[name] = (n_series, f)


def run_tests(df: DataFrame, names: list[str], columns: list[str], keys: list[str], order: list[str], least: int = 20) -> DataFrame:
    """Runs tests on each key's series (the first column, or the first two): keys, test, statistic, p_value, lags,
    error. A test that fails says so in ``error``; the others go on."""

    def apply(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order).dropna(subset=columns)
        rows = []
        for name in names:
            n, f = TESTS[name]
            row = {**{k: p[k].iloc[0] for k in keys}, "test": name, "n": len(p), "statistic": None, "p_value": None, "lags": None, "error": None} if len(p) else None
            if row is None:
                continue
            if len(p) < least:
                row["error"] = f"{len(p)} rows, {least} are needed"
            else:
                try:
                    found = f(*[p[c].to_numpy(float) for c in columns[:n]])
                    row |= {k: found[k] for k in ("statistic", "p_value", "lags")}
                except Exception as e:
                    row["error"] = str(e)
            rows.append(row)
        return pd.DataFrame(rows, columns=[*keys, "test", "n", "statistic", "p_value", "lags", "error"]).astype({"lags": "Int64"})

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(apply, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", test string, n long, statistic double, p_value double, lags long, error string")


def mean_shift(df: DataFrame, x: str, keys: list[str], order: list[str], windows: dict[str, tuple[int, float]] | None = None) -> DataFrame:
    """Drift on trailing windows: z of the window's mean against the earlier rows of the series; any window over its
    limit makes ``drift``. Windows: name to (rows, limit)."""
    windows = windows or {"short": (20, 2.5), "medium": (60, 2.5), "long": (200, 3.75)}
    d = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])))
    aggs = []
    for k, (n, _) in windows.items():
        late, early = F.when(F.col("__i") <= n, F.col(x)), F.when(F.col("__i") > n, F.col(x))
        aggs.append((F.abs(F.avg(late) - F.avg(early)) / F.nullif(F.stddev_samp(early) / F.sqrt(F.count(late)), F.lit(0.0))).alias(f"z_{k}"))
    g = d.groupBy(*keys).agg(*aggs)
    any_ = F.lit(False)
    for k, (_, limit) in windows.items():
        any_ |= F.coalesce(F.col(f"z_{k}") > limit, F.lit(False))
    return g.withColumn("drift", any_)


def embedding_coherence(df: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """Mean cosine within and across labels, and their ratio. Means over all pairs follow from sums of unit vectors:
    the sum of all cosines of a set is the squared length of its vector sum, so no pair is formed."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    d = df.select(key, F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double") / norm).alias("u")).filter(F.size("u") > 0)
    parts = d.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    whole = parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("all2"), F.max("n").alias("n"))
    own = parts.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("n").alias("n")).agg(F.sum("s2").alias("in2"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("n").alias("m"))
    both = whole.crossJoin(own)  # one row each
    within = ratio(F.col("in2") - F.col("m"), F.col("nn") - F.col("m"))
    cross = ratio(F.col("all2") - F.col("in2"), F.col("n") * F.col("n") - F.col("nn"))
    return both.select(within.alias("within_cosine"), cross.alias("cross_cosine")).withColumn("coherence_ratio", F.when(F.abs("cross_cosine") > 1e-12, F.col("within_cosine") / F.col("cross_cosine")))
