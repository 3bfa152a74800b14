"""Recursive operators: what each row adds depends on the result of the row before.

All kernels that a plan asks for run in one pass over each series (``scan``), so a plan pays one shuffle and one Arrow
transfer however many of them it has. A series is one group; different series run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Kernel = Callable[[pd.DataFrame], dict[str, np.ndarray]]


def ema(x: np.ndarray, span: float | None = None, alpha: float | None = None) -> np.ndarray:
    """Starts at the first known value; a gap keeps the value before it."""
    a = 2 / (span + 1) if alpha is None else alpha
    out, e = np.full(len(x), np.nan), np.nan
    for i, v in enumerate(x):
        if np.isfinite(v):
            e = v if np.isnan(e) else a * v + (1 - a) * e
        out[i] = e
    return out


def wilder_rsi(x: np.ndarray, n: int = 14) -> np.ndarray:
    """Averages with weight 1/n that start at the first difference; 1e-12 keeps the quotient finite."""
    out, gain, loss = np.full(len(x), np.nan), np.nan, np.nan
    for i in range(1, len(x)):
        d = x[i] - x[i - 1]
        if np.isfinite(d):
            u, v = max(d, 0.0), max(-d, 0.0)
            gain, loss = (u, v) if np.isnan(gain) else (gain + (u - gain) / n, loss + (v - loss) / n)
        out[i] = 100 - 100 / (1 + gain / (loss + 1e-12)) if np.isfinite(gain) else np.nan
    return out


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, np.ndarray]:
    f, s = ema(x, fast), ema(x, slow)
    line = f - s
    sig = ema(line, signal)
    return {"ema_fast": f, "ema_slow": s, "macd": line, "macd_signal": sig, "macd_hist": line - sig}


def true_range(h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    tr = h - lo
    if len(c) > 1:
        tr[1:] = np.maximum(tr[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(lo[1:] - c[:-1])))
    return tr


def wilder_atr(h: np.ndarray, lo: np.ndarray, c: np.ndarray, n: int = 14) -> np.ndarray:
    return ema(true_range(h.copy(), lo, c), alpha=1 / n)


def adx(h: np.ndarray, lo: np.ndarray, c: np.ndarray, n: int = 14) -> dict[str, np.ndarray]:
    """ADX and its direction lines; a move counts for the larger side only."""
    up, down = np.diff(h, prepend=np.nan), -np.diff(lo, prepend=np.nan)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    atr = wilder_atr(h, lo, c, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, m = 100 * ema(plus, alpha=1 / n) / atr, 100 * ema(minus, alpha=1 / n) / atr
        dx = 100 * np.abs(p - m) / (p + m)
    return {"adx": ema(np.where(np.isfinite(dx), dx, np.nan), alpha=1 / n), "dmp": p, "dmn": m}


def kalman_residual(y: np.ndarray, x: np.ndarray, process_noise: float = 1e-4, obs_noise: float = 1e-2) -> np.ndarray:
    """What a regression with coefficients that walk at random did not expect of each value, given those before. The
    coefficients start at 0 with unit variance; rows with an unknown value have no residual and change nothing."""
    if process_noise <= 0 or obs_noise <= 0:
        raise ValueError("noises must be positive")
    n, k = x.shape
    out, beta, p = np.full(n, np.nan), np.zeros(k), np.eye(k)
    for i in range(n):
        if np.isfinite(y[i]) and np.isfinite(x[i]).all():
            p = p + process_noise * np.eye(k)
            out[i] = y[i] - x[i] @ beta
            gain = p @ x[i] / (x[i] @ p @ x[i] + obs_noise)
            beta = beta + gain * out[i]
            p = p - np.outer(gain, x[i] @ p)
    return out


def pairs_position(z: np.ndarray, valid: np.ndarray, entry: float = 2.0, exit_: float = 0.5, max_hold: int = 20) -> np.ndarray:
    """-1, 0 or 1: against the spread from |z| >= entry (where ``valid``), out at |z| <= exit or after ``max_hold``
    rows. An unknown z holds what there is."""
    out, now, held = np.zeros(len(z)), 0.0, 0
    for i, v in enumerate(z):
        if now and np.isfinite(v):
            held += 1
            if abs(v) <= exit_ or held >= max_hold:
                now, held = 0.0, 0
        elif now:
            held += 1
        elif np.isfinite(v) and abs(v) >= entry and valid[i]:
            now, held = (-1.0 if v > 0 else 1.0), 0
        out[i] = now
    return out


def turnover_clamp(target: np.ndarray, most: float = 0.5) -> np.ndarray:
    """Positions that move at most ``most`` a row towards the target, within -1 and 1."""
    out, now = np.zeros(len(target)), 0.0
    for i, v in enumerate(target):
        if np.isfinite(v):
            now = min(1.0, max(-1.0, now + min(most, max(-most, v - now))))
        out[i] = now
    return out


def route_with_inertia(best: np.ndarray, best_value: np.ndarray, values: list[dict], hurdle: np.ndarray, margin: float, default: str) -> list[str]:
    """The choice of each step: abstain under the hurdle; leave the previous choice only for one that is better by
    ``margin``."""
    out, now = [], default
    for b, v, all_, h in zip(best, best_value, values, hurdle):
        if not np.isfinite(v) or v <= h:
            now = default
        elif now == default or now not in all_ or v > all_[now] + margin:
            now = b
        out.append(now)
    return out


def average_cost(qty: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Average price of what is held; buys re-weight it, sells leave it, a flat position has 0."""
    out, held, avg = np.zeros(len(qty)), 0.0, 0.0
    for i, (q, p) in enumerate(zip(qty, price)):
        if q > 0:
            avg = (avg * held + q * p) / (held + q) if held + q else 0.0
        held += q
        if abs(held) < 1e-12:
            held, avg = 0.0, 0.0
        out[i] = avg
    return out


def kalman_smooth(x: np.ndarray, process: float = 1e-2, noise: float = 1.0) -> np.ndarray:
    """Local-level smoother (forward filter, backward pass); gaps get the smoothed level."""
    n = len(x)
    known = np.flatnonzero(np.isfinite(x))
    if not len(known):
        return np.full(n, np.nan)
    m, p = np.empty(n), np.empty(n)
    level, var = x[known[0]], noise
    for i, v in enumerate(x):
        var += process if i else 0.0
        if np.isfinite(v):
            k = var / (var + noise)
            level, var = level + k * (v - level), (1 - k) * var
        m[i], p[i] = level, var
    for i in range(n - 2, -1, -1):
        m[i] += p[i] / (p[i] + process) * (m[i + 1] - m[i])
    return m


def residual_ols_many(y: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """The last row's residual of a regression with intercept over each ``n`` rows."""
    out = np.full(len(y), np.nan)
    a = np.column_stack([np.ones(len(y)), x])
    for i in range(n - 1, len(y)):
        rows, ys = a[i - n + 1 : i + 1], y[i - n + 1 : i + 1]
        if np.isfinite(rows).all() and np.isfinite(ys).all():
            out[i] = ys[-1] - rows[-1] @ np.linalg.lstsq(rows, ys, rcond=None)[0]
    return out


def bocpd(x: np.ndarray, hazard: float = 1 / 100, longest: int = 512, prior: tuple[float, float, float, float] = (0.0, 1.0, 1.0, 1.0), transition: int = 5) -> dict[str, np.ndarray]:
    """Bayesian change points with a normal-inverse-gamma prior (mean, kappa, alpha, beta): probability of a change,
    expected run length, mass on run lengths up to ``transition``. A new run is weighed by the prior's predictive. Of
    ``longest`` run lengths the last holds all longer ones, by their summed mass and statistics."""
    from math import lgamma

    m0, k0, a0, b0 = prior
    logp = np.array([0.0])
    m, k, a, b = (np.array([v]) for v in (m0, k0, a0, b0))
    of_alpha = lambda a: lgamma(a + 0.5) - lgamma(a) - 0.5 * np.log(2 * a * np.pi)
    runs = np.arange(longest + 1)
    known = np.array([of_alpha(a0 + n / 2) for n in range(min(longest, len(x)) + 1)])
    first = b0 * (k0 + 1) / (a0 * k0)
    change, length, early = (np.full(len(x), np.nan) for _ in range(3))
    for i, v in enumerate(x):
        if not np.isfinite(v):
            continue
        s2 = b * (k + 1) / (a * k)
        gammas = known[np.minimum(runs[1 : len(a) + 1], len(a) - 1)]  # the longest run is as old as the one before it
        if len(a) == longest:
            gammas[-1] = of_alpha(a[-1])
        like = gammas - 0.5 * np.log(s2) - (a + 0.5) * np.log1p((v - m) ** 2 / (2 * a * s2))
        new = known[0] - 0.5 * np.log(first) - (a0 + 0.5) * np.log1p((v - m0) ** 2 / (2 * a0 * first))
        logp = np.concatenate(([new + np.log(hazard) + np.logaddexp.reduce(logp)], logp + like + np.log1p(-hazard)))
        m, k, a, b = (np.concatenate(([v0], vs)) for v0, vs in ((m0, m), (k0, k), (a0, a), (b0, b)))
        m, k, a, b = (k * m + v) / (k + 1), k + 1, a + 0.5, b + k * (v - m) ** 2 / (2 * (k + 1))
        if len(logp) > longest:
            at = longest - 1
            n = 2 * (a[at:] - a0)
            total, squares = (k[at:] * m[at:] - k0 * m0).sum(), (2 * (b[at:] - b0) - k0 * m0**2 + k[at:] * m[at:] ** 2).sum()
            kn = k0 + n.sum()
            mn = (k0 * m0 + total) / kn
            tail = (mn, kn, a0 + n.sum() / 2, b0 + 0.5 * (squares + k0 * m0**2 - kn * mn**2))
            m, k, a, b = (np.append(vs[:at], v1) for vs, v1 in zip((m, k, a, b), tail))
            logp = np.append(logp[:at], np.logaddexp.reduce(logp[at:]))
        logp = logp - np.logaddexp.reduce(logp)
        p = np.exp(logp)
        change[i], length[i], early[i] = p[0], p @ runs[: len(p)], p[: transition + 1].sum()
    return {"change_probability": change, "run_length": length, "transition_probability": early}


def scan(df: DataFrame, keys: list[str], order: list[str], outputs: list[str], kernel: Kernel) -> DataFrame:
    """Runs ``kernel`` on each series in order; it returns the named columns of doubles. NaN becomes null."""
    keep = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in outputs]])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        found = kernel(pdf)
        for c in outputs:
            v = np.asarray(found[c], float)
            pdf[c] = pd.Series(v).where(np.isfinite(v), None).astype(object) if not np.isfinite(v).all() else v
        return pdf[[*keep, *outputs]]

    return df.groupBy(*keys).applyInPandas(apply, schema)
