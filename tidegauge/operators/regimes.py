"""Regime labels from trends, volatility and change points."""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..streaming.pipelines import Incremental
from .rolling import trailing
from .sequential import bocpd, scan


def trend_regime(ret: str, w: WindowSpec, n: int = 20, eps: float = 0.01) -> Column:
    """hi, lo or flat by the sum of log returns over ``n`` rows."""
    t = F.sum(F.log1p(F.greatest(ret, F.lit(-0.999999)))).over(trailing(w, n))
    return F.when(t > eps, "hi").when(t < -eps, "lo").otherwise("flat")


def annual_log_volatility(ret: str, w: WindowSpec, n: int = 20, year: float = 252.0) -> Column:
    return F.log(F.greatest(F.sqrt(year / n * F.sum(F.col(ret) * F.col(ret)).over(trailing(w, n))), F.lit(1e-12)))


def expanding_quantiles(x: np.ndarray, quantiles: list[float]) -> np.ndarray:
    """Linear quantiles of the known values so far, by row and quantile; each value is put into its place once."""
    out, known = np.full((len(x), len(quantiles)), np.nan), []
    for i, v in enumerate(x):
        if not np.isnan(v):
            insort(known, v)
        if known:
            for j, q in enumerate(quantiles):
                at = q * (len(known) - 1)
                lo, hi = known[math.floor(at)], known[math.ceil(at)]
                out[i, j] = lo + (hi - lo) * (at - math.floor(at))
    return out


def volatility_regimes(df: DataFrame, log_vol: str, keys: list[str], order: list[str], out: str = "vol") -> DataFrame:
    """Adds lo, med or hi by linear terciles of the series so far; null where the volatility is unknown."""

    def kernel(p):
        q = expanding_quantiles(p[log_vol].to_numpy(float), [1.0 / 3, 2.0 / 3])
        return {"__lo": q[:, 0], "__hi": q[:, 1]}

    d = scan(df, keys, order, ["__lo", "__hi"], kernel)
    x = F.col(log_vol)
    return d.withColumn(out, F.when(x <= F.col("__lo"), "lo").when(x <= F.col("__hi"), "med").when(x.isNotNull(), "hi")).drop("__lo", "__hi")


def change_state(change: str, transition: str, high: float = 0.5, mid: float = 0.25) -> Column:
    """changepoint, transition or stable."""
    return F.when(F.col(change) >= high, "changepoint").when(F.col(transition) >= mid, "transition").otherwise("stable")


def regime_class(trend: str, vol: str, crisis: Column | None = None) -> Column:
    """The first that fits: crisis, high_vol, bear, bull, sideways."""
    out = F.when(crisis, "crisis") if crisis is not None else F.when(F.lit(False), "crisis")
    return out.when(F.col(vol) == "hi", "high_vol").when(F.col(trend) == "lo", "bear").when(F.col(trend) == "hi", "bull").otherwise("sideways")


class ChangePoints(Incremental):
    """Change points of a stream: state is the window of the last values, from which the posterior is computed anew, so
    a restart needs nothing else."""

    def __init__(self, window: int = 200, hazard: float = 1 / 100):
        self.window, self.hazard, self.outputs = window, hazard, ["change_probability", "run_length"]

    def start(self) -> list[float]:
        return []

    def step(self, state, x):
        state.append(x)
        del state[: max(0, len(state) - self.window)]
        found = bocpd(np.array(state), self.hazard, self.window)
        return [float(found["change_probability"][-1]), float(found["run_length"][-1])]
