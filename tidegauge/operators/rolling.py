"""Window operators. Each takes the keys of its series: what comes before the first row of a series is null, never a
row of another series. Columns of one window specification belong into one ``select``, so that Spark sorts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str], order: list[str]) -> WindowSpec:
    if not keys:
        raise ValueError("a series needs keys")
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(w: WindowSpec, n: int, skip: int = 0) -> WindowSpec:
    """The ``n`` rows that end ``skip`` rows before the current one."""
    return w.rowsBetween(-(n - 1) - skip, -skip)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is zero."""
    return F.try_divide(a, b)


def enough(value: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(frame) >= least, value)


def pct_change(x, w: WindowSpec, periods: int = 1) -> Column:
    return ratio(_c(x), F.lag(_c(x), periods).over(w)) - 1


def log_return(x, w: WindowSpec, periods: int = 1) -> Column:
    return F.log(ratio(_c(x), F.lag(_c(x), periods).over(w)))


def rolling_mean(x, w: WindowSpec, n: int, least: int | None = None) -> Column:
    f = trailing(w, n)
    return enough(F.avg(_c(x)).over(f), _c(x), f, least or n)


def rolling_sum(x, w: WindowSpec, n: int, least: int | None = None) -> Column:
    f = trailing(w, n)
    return enough(F.sum(_c(x)).over(f), _c(x), f, least or n)


def rolling_std(x, w: WindowSpec, n: int, least: int | None = None, ddof: int = 0) -> Column:
    f = trailing(w, n)
    return enough((F.stddev_pop if ddof == 0 else F.stddev_samp)(_c(x)).over(f), _c(x), f, least or n)


def rolling_min(x, w: WindowSpec, n: int, least: int = 1) -> Column:
    f = trailing(w, n)
    return enough(F.min(_c(x)).over(f), _c(x), f, least)


def rolling_max(x, w: WindowSpec, n: int, least: int = 1) -> Column:
    f = trailing(w, n)
    return enough(F.max(_c(x)).over(f), _c(x), f, least)


def rolling_zscore(x, w: WindowSpec, n: int, least: int | None = None, ddof: int = 0) -> Column:
    """Null where the deviation is zero."""
    return ratio(_c(x) - rolling_mean(x, w, n, least), rolling_std(x, w, n, least, ddof))


def bollinger(x, w: WindowSpec, n: int = 20, width: float = 2.0, ddof: int = 0) -> dict[str, Column]:
    mid, sd = rolling_mean(x, w, n), rolling_std(x, w, n, ddof=ddof)
    return {"mid": mid, "std": sd, "upper": mid + width * sd, "lower": mid - width * sd}


def rsi_simple(df: DataFrame, x: str, keys: list[str], order: list[str], n: int = 14, out: str = "rsi", least: int | None = None) -> DataFrame:
    """RSI from plain means of gains and losses; without losses 100 (or null without gains, too)."""
    w = series(keys, order)
    d = df.withColumn("__d", F.col(x) - F.lag(x).over(w))
    f = trailing(w, n)
    gain, loss = F.avg(F.greatest("__d", F.lit(0.0))).over(f), F.avg(F.greatest(-F.col("__d"), F.lit(0.0))).over(f)
    value = F.when((loss == 0) & (gain == 0), None).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))
    return d.withColumn(out, enough(value, F.col("__d"), f, least or n)).drop("__d")


def true_range(high: str, low: str, close: str, w: WindowSpec) -> Column:
    before = F.lag(close).over(w)
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def atr_mean(df: DataFrame, keys: list[str], order: list[str], n: int = 14, high="high", low="low", close="close", out="atr") -> DataFrame:
    w = series(keys, order)
    return df.withColumn("__tr", true_range(high, low, close, w)).withColumn(out, F.avg("__tr").over(trailing(w, n))).drop("__tr")


def obv(df: DataFrame, keys: list[str], order: list[str], price="close", volume="volume", out="obv") -> DataFrame:
    """Running volume, signed by the price's direction, from 0."""
    w = series(keys, order)
    signed = df.withColumn("__s", F.coalesce(F.signum(F.col(price) - F.lag(price).over(w)), F.lit(0.0)) * F.col(volume))
    return signed.withColumn(out, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def session_vwap(df: DataFrame, keys: list[str], order: list[str], session: str, price="close", volume="volume", out="vwap") -> DataFrame:
    """Volume-weighted mean price since the session value last changed (a value that returns starts a new session)."""
    w = series(keys, order)
    runs = df.withColumn("__new", F.when(F.col(session).eqNullSafe(F.lag(session).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = runs.withColumn("__run", F.sum("__new").over(w))
    within = series([*keys, "__run"], order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn(out, ratio(F.sum(F.col(price) * F.col(volume)).over(within), F.sum(volume).over(within))).drop("__new", "__run")


def cumulative_vwap(w: WindowSpec, high="high", low="low", close="close", volume="volume") -> Column:
    f = w.rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col(high) + F.col(low) + F.col(close)) / 3
    return ratio(F.sum(typical * F.col(volume)).over(f), F.sum(volume).over(f))


def lags(columns: list[str], n: int, w: WindowSpec) -> dict[str, Column]:
    return {f"{c}_lag{i}": F.lag(c, i).over(w) for c in columns for i in range(1, n + 1)}


def pairs_beta(a, b, w: WindowSpec, n: int = 60) -> Column:
    """Slope of ``a`` on ``b`` over the last ``n`` rows, all of which must be there."""
    f = trailing(w, n)
    both = F.when(_c(a).isNotNull() & _c(b).isNotNull(), 1)
    return F.when((F.count(both).over(f) >= n) & (F.var_pop(F.when(both.isNotNull(), _c(b))).over(f) > 0), F.regr_slope(_c(a), _c(b)).over(f))


def pairs_spread(a, b, beta) -> Column:
    return _c(a) - _c(beta) * _c(b)


def half_life(df: DataFrame, x: str, keys: list[str], order: list[str], n: int = 60, out: str = "half_life") -> DataFrame:
    """Half-life of mean reversion from the slope on the previous value over ``n`` pairs; kept between 1 and 252."""
    w = series(keys, order)
    d = df.withColumn("__l", F.lag(x).over(w))
    f = trailing(w, n)
    phi = F.when((F.count(F.when(F.col("__l").isNotNull() & F.col(x).isNotNull(), 1)).over(f) >= n) & (F.var_pop(F.when(F.col(x).isNotNull(), F.col("__l"))).over(f) > 0), F.regr_slope(F.col(x), F.col("__l")).over(f))
    d = d.withColumn("__phi", phi)
    value = F.when((F.col("__phi") > 0) & (F.col("__phi") < 1), -F.log(F.lit(2.0)) / F.log("__phi"))
    return d.withColumn("__h", value).withColumn(out, F.when(F.col("__h").between(1, 252), F.col("__h"))).drop("__l", "__phi", "__h")


def xsec_rank(df: DataFrame, x: str, date: str, asset: str, window: int, skip: int = 21, out: str = "mom_rank") -> DataFrame:
    """Per date the average percent rank of each asset's sum of ``x`` over ``window`` rows, ``skip`` rows back; null on
    dates with a single asset."""
    f = trailing(series([asset], [date]), window, skip)
    d = df.withColumn("__m", F.when(F.count(x).over(f) >= window, F.sum(x).over(f)))
    return average_rank(d, "__m", [date], out, percent=True, least=2).drop("__m")


def average_rank(df: DataFrame, x: str, keys: list[str], out: str, percent: bool = False, least: int = 1) -> DataFrame:
    """Ranks from 1 within the keys, equal values sharing the mean of their ranks; null for null. Rank and cumulative
    share come from one order, so peers are never gathered."""
    some, p = F.col(x).isNotNull(), Window.partitionBy(*keys)
    w = p.orderBy(F.col(x).asc_nulls_last())
    n, last = F.count(x).over(p), F.round(F.cume_dist().over(w) * F.count(F.lit(1)).over(p))
    rank = (F.rank().over(w) + last) / 2
    return df.withColumn(out, F.when(some & (n >= least), rank / n if percent else rank))


def vol_scale(signal, vol, target: float = 0.15, cap: float = 2.0, year: int = 252) -> Column:
    """Signal times min(target / annual volatility, cap); an unknown or zero volatility takes the cap."""
    scale = F.least(ratio(F.lit(target), _c(vol) * (year**0.5)), F.lit(cap))
    return F.when(_c(vol) > 0, scale).otherwise(cap) * _c(signal)


def residual_ols(y: str, factors: list[str], w: WindowSpec, n: int) -> Column:
    """The current row's residual of a regression with intercept over the last ``n`` complete rows. For one or two
    factors the normal equations are solved in closed form, so any number of series runs without Python."""
    f = trailing(w, n)
    whole = F.count(F.when(sum((F.col(x).isNull().cast("int") for x in [y, *factors]), F.lit(0)) == 0, 1)).over(f) >= n
    mean = lambda c: F.avg(c).over(f)
    cov = lambda a, b: F.covar_pop(a, b).over(f)
    if len(factors) == 1:
        x = factors[0]
        beta = ratio(cov(y, x), cov(x, x))
        fitted = mean(y) + beta * (F.col(x) - mean(x))
    elif len(factors) == 2:
        a, b = factors
        det = cov(a, a) * cov(b, b) - cov(a, b) * cov(a, b)
        ba, bb = ratio(cov(y, a) * cov(b, b) - cov(y, b) * cov(a, b), det), ratio(cov(y, b) * cov(a, a) - cov(y, a) * cov(a, b), det)
        fitted = mean(y) + ba * (F.col(a) - mean(a)) + bb * (F.col(b) - mean(b))
    else:
        raise ValueError("use operators.sequential.residual_ols_many for more than two factors")
    return F.when(whole, F.col(y) - fitted)


def zscore_group(x, keys: list[str]) -> Column:
    """(x - mean) / population deviation over the keys' rows; 0 where the deviation is 0."""
    p = Window.partitionBy(*keys)
    sd = F.stddev_pop(_c(x)).over(p)
    return F.when(sd == 0, 0.0).otherwise((_c(x) - F.avg(_c(x)).over(p)) / sd)


def robust_scale(df: DataFrame, columns: list[str], keys: list[str], quantiles: tuple[float, float] = (0.25, 0.75), center: bool = True, scale: bool = True, eps: float = 1e-12) -> DataFrame:
    """(x - median) / (upper - lower quantile + eps) per keys, with linear quantiles, as ``<x>_robust``."""
    lo, hi = quantiles
    stats = df.groupBy(*keys).agg(*[F.percentile(c, F.array(F.lit(lo), F.lit(0.5), F.lit(hi))).alias(f"__{c}") for c in columns])
    out = df.join(stats, keys)
    for c in columns:
        q = F.col(f"__{c}")
        out = out.withColumn(f"{c}_robust", (F.col(c) - (q[1] if center else 0.0)) / ((q[2] - q[0] + eps) if scale else 1.0)).drop(f"__{c}")
    return out


def forward_return(x, w: WindowSpec, horizon: int, log: bool = False) -> Column:
    r = ratio(F.lead(_c(x), horizon).over(w), _c(x))
    return F.log(r) if log else r - 1


def sign_label(x, w: WindowSpec, horizon: int) -> Column:
    return F.signum(forward_return(x, w, horizon, log=True))


def excess_return_label(x, benchmark, w: WindowSpec, horizon: int) -> Column:
    return forward_return(x, w, horizon, log=True) - forward_return(benchmark, w, horizon, log=True)


def event_window(flag, w: WindowSpec, days: int) -> Column:
    """Whether a row within ``days`` rows on either side is flagged."""
    return F.coalesce(F.max(F.when(_c(flag), 1).otherwise(0)).over(w.rowsBetween(-days, days)) == 1, F.lit(False))


def sequence_windows(df: DataFrame, features: list[str], target: str, keys: list[str], order: list[str], length: int, out: str = "features") -> DataFrame:
    """Rows that have ``length`` rows before them, with these rows' features as an array of arrays and the target."""
    f = series(keys, order).rowsBetween(-length, -1)
    d = df.select(*keys, *order, target, F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(f).alias(out))
    return d.filter(F.size(out) == length)


def time_bucket(ts, seconds: int) -> Column:
    t = _c(ts).cast("timestamp")
    return F.timestamp_seconds(F.floor(F.unix_timestamp(t) / seconds) * seconds)


def drawdown(x, w: WindowSpec, n: int | None = None, least: int = 1) -> Column:
    """Value over the highest value so far (or of ``n`` rows), less 1."""
    f = trailing(w, n) if n else w.rowsBetween(Window.unboundedPreceding, 0)
    return enough(ratio(_c(x), F.max(_c(x)).over(f)) - 1, _c(x), f, least)


def industry_score(df: DataFrame, ret: str, sector: str, asset: str, date: str, window: int = 63, out: str = "industry_score") -> DataFrame:
    """Per date the mean over a sector's assets of their summed returns of ``window`` rows, less the mean over all
    assets; null where no asset of the sector has so many."""
    f = trailing(series([asset], [date]), window)
    d = df.withColumn("__m", F.when(F.count(ret).over(f) >= window, F.sum(ret).over(f)))
    by = d.groupBy(date, sector).agg(F.sum("__m").alias("__s"), F.count("__m").alias("__n"))  # a row a date and sector
    all_ = by.groupBy(date).agg((F.sum("__s") / F.sum("__n")).alias("__all"))
    score = by.join(all_, date).select(F.col(date).alias("__d"), F.col(sector).alias("__k"), (ratio(F.col("__s"), F.col("__n")) - F.col("__all")).alias(out))
    return d.join(score, (F.col(date) == F.col("__d")) & F.col(sector).eqNullSafe(F.col("__k")), "left").drop("__m", "__d", "__k")


def lag_outcome(x, w: WindowSpec, horizon: int) -> Column:
    """A diagnostic of outcomes, known only ``horizon`` rows later (at least one)."""
    return F.lag(_c(x), max(1, int(horizon))).over(w)


def timeframe_drift(df: DataFrame, x: str, keys: list[str], order: list[str], windows: dict[str, int] | None = None, sensitivity: float = 2.5, every: int = 1, out: str = "drift") -> DataFrame:
    """Drift over several trailing windows, seen anew every ``every`` rows: the mean of a full window lies at least
    ``sensitivity`` (for the longest window one and a half times that) of the deviations of the time before away from
    the mean of the time before. Adds ``<out>_<window>`` and ``out``, whether any does; false while unknown."""
    windows = windows or {"short": 20, "medium": 60, "long": 200}
    w, longest = series(keys, order), max(windows.values())
    d = df.withColumns({f"__{k}_{n}": c for n, size in windows.items() for k, c in (("m", rolling_mean(x, w, size)), ("s", rolling_std(x, w, size)))})
    flags = {f"{out}_{n}": F.coalesce(ratio(F.abs(F.col(f"__m_{n}") - F.lag(f"__m_{n}", every).over(w)), F.lag(f"__s_{n}", every).over(w) + 2e-12) >= sensitivity * (1.5 if size == longest else 1.0), F.lit(False)) for n, size in windows.items()}
    d = d.withColumns(flags).drop(*[f"__{k}_{n}" for k in "ms" for n in windows])
    any_ = F.lit(False)
    for c in flags:
        any_ |= F.col(c)
    return d.withColumn(out, any_)
