"""Queries of rolling, recursive and cross-sectional operators over daily bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import rolling as R
from ..operators import sequential as S
from ..sources.adapters import bars
from .base import BARS, INDICATORS, query

KEYS, ORDER = ["instrument"], ["date"]


def _r(**columns):
    """Rounded; the offset keeps exact halves from being rounded either way."""
    return [F.round(c + F.lit(1.3e-9), 7).alias(n) for n, c in columns.items()]


def _over(n: int, x: str = "close") -> str:
    return f"(PARTITION BY instrument ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "(PARTITION BY instrument ORDER BY date)"


@query("flagship_sma_crossover", f"""WITH {BARS},
r AS (SELECT *, close / lag(close) OVER {W} - 1 AS ret, CASE WHEN count(close) OVER {_over(5)} >= 5 THEN avg(close) OVER {_over(5)} END AS fast,
  CASE WHEN count(close) OVER {_over(20)} >= 20 THEN avg(close) OVER {_over(20)} END AS slow FROM bars),
s AS (SELECT *, CASE WHEN fast > slow THEN 1 ELSE -1 END AS signal FROM r),
t AS (SELECT *, lag(signal) OVER {W} * ret AS sret, lag(signal) OVER {W} AS before FROM s),
e AS (SELECT *, sum(ln(greatest(1 + sret, 1e-9))) OVER {W} AS lognav FROM t),
g AS (SELECT *, greatest(max(lognav) OVER {W}, 0) AS top FROM e)
SELECT instrument, count(*) AS n_bars, round(avg(sret) / stddev_samp(sret) * sqrt(252), 7) AS sharpe, round(sum(ln(greatest(1 + sret, 1e-9))), 7) AS log_return,
  round(min(exp(lognav - top) - 1), 7) AS max_drawdown, round(avg(CASE WHEN sret > 0 THEN 1.0 WHEN sret IS NOT NULL THEN 0.0 END), 7) AS win_rate,
  count(CASE WHEN signal <> before THEN 1 END) AS n_flips FROM g GROUP BY instrument""")
def flagship_sma_crossover(spark, d):
    """Resample to bars, returns, two means, crossover signal (warm-up rows count as -1), lagged returns, metrics."""
    w = R.series(KEYS, ORDER)
    b = bars(spark, d).select("instrument", "date", R.pct_change("close", w).alias("ret"), R.rolling_mean("close", w, 5).alias("fast"), R.rolling_mean("close", w, 20).alias("slow"))
    b = b.withColumn("signal", F.when(F.col("fast") > F.col("slow"), 1).otherwise(-1))
    b = b.withColumn("before", F.lag("signal").over(w)).withColumn("sret", F.col("before") * F.col("ret"))
    step = F.log(F.greatest(1 + F.col("sret"), F.lit(1e-9)))
    b = b.withColumn("step", step).withColumn("lognav", F.sum("step").over(w)).withColumn("top", F.greatest(F.max("lognav").over(w), F.lit(0.0)))
    return b.groupBy("instrument").agg(
        F.count("*").alias("n_bars"), F.round(F.try_divide(F.avg("sret"), F.stddev_samp("sret")) * F.sqrt(F.lit(252.0)), 7).alias("sharpe"), F.round(F.sum("step"), 7).alias("log_return"),
        F.round(F.min(F.exp(F.col("lognav") - F.col("top")) - 1), 7).alias("max_drawdown"), F.round(F.avg(F.when(F.col("sret") > 0, 1.0).when(F.col("sret").isNotNull(), 0.0)), 7).alias("win_rate"),
        F.count(F.when(F.col("signal") != F.col("before"), 1)).alias("n_flips"),
    )


@query("rolling_moments", f"""WITH {BARS} SELECT instrument, date,
  round(close / lag(close) OVER {W} - 1 + 1.3e-9, 7) AS returns, round(ln(close / lag(close) OVER {W}) + 1.3e-9, 7) AS log_return,
  round(CASE WHEN count(close) OVER {_over(20)} >= 20 THEN avg(close) OVER {_over(20)} END + 1.3e-9, 7) AS sma_20,
  round(CASE WHEN count(close) OVER {_over(10)} >= 10 THEN stddev_pop(close) OVER {_over(10)} END + 1.3e-9, 7) AS std_10,
  round(CASE WHEN count(close) OVER {_over(10)} >= 2 THEN stddev_samp(close) OVER {_over(10)} END + 1.3e-9, 7) AS std_10_sample,
  round(CASE WHEN count(close) OVER {_over(10)} >= 10 THEN sum(volume) OVER {_over(10)} END + 1.3e-9, 7) AS volume_10,
  round(min(close) OVER {_over(10)} + 1.3e-9, 7) AS min_10, round(max(close) OVER {_over(10)} + 1.3e-9, 7) AS max_10,
  round(CASE WHEN count(close) OVER {_over(10)} >= 10 THEN (close - avg(close) OVER {_over(10)}) / nullif(stddev_pop(close) OVER {_over(10)}, 0) END + 1.3e-9, 7) AS zscore_10,
  round(close / max(close) OVER {_over(60)} - 1 + 1.3e-9, 7) AS drawdown_60
FROM bars""")
def rolling_moments(spark, d):
    w = R.series(KEYS, ORDER)
    return bars(spark, d).select("instrument", "date", *_r(
        returns=R.pct_change("close", w), log_return=R.log_return("close", w), sma_20=R.rolling_mean("close", w, 20), std_10=R.rolling_std("close", w, 10), std_10_sample=R.rolling_std("close", w, 10, 2, ddof=1),
        volume_10=R.rolling_sum("volume", w, 10), min_10=R.rolling_min("close", w, 10), max_10=R.rolling_max("close", w, 10), zscore_10=R.rolling_zscore("close", w, 10), drawdown_60=R.drawdown("close", w, 60)))


@query("bollinger_bands", f"""WITH {BARS}, b AS (SELECT instrument, date, close, count(close) OVER {_over(20)} AS n, avg(close) OVER {_over(20)} AS m, stddev_pop(close) OVER {_over(20)} AS s0, stddev_samp(close) OVER {_over(20)} AS s1 FROM bars)
SELECT instrument, date, round(CASE WHEN n >= 20 THEN m END + 1.3e-9, 7) AS mid, round(CASE WHEN n >= 20 THEN s0 END + 1.3e-9, 7) AS std, round(CASE WHEN n >= 20 THEN m + 2 * s0 END + 1.3e-9, 7) AS upper, round(CASE WHEN n >= 20 THEN m - 2 * s0 END + 1.3e-9, 7) AS lower,
  round(CASE WHEN n >= 20 THEN m + 2 * s1 END + 1.3e-9, 7) AS upper_sample, round(CASE WHEN n >= 20 THEN m - 2 * s1 END + 1.3e-9, 7) AS lower_sample FROM b""")
def bollinger_bands(spark, d):
    w = R.series(KEYS, ORDER)
    sample = R.bollinger("close", w, ddof=1)
    return bars(spark, d).select("instrument", "date", *_r(**R.bollinger("close", w), upper_sample=sample["upper"], lower_sample=sample["lower"]))


@query("rsi_simple", f"""WITH {BARS}, x AS (SELECT instrument, date, close - lag(close) OVER {W} AS d FROM bars),
g AS (SELECT *, count(d) OVER {_over(14)} AS n, avg(greatest(d, 0)) OVER {_over(14)} AS up, avg(greatest(-d, 0)) OVER {_over(14)} AS down FROM (SELECT instrument, date, d FROM x))
SELECT instrument, date, round(CASE WHEN n >= 14 THEN CASE WHEN down = 0 AND up = 0 THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END + 1.3e-9, 7) AS rsi,
  round(CASE WHEN n >= 1 THEN CASE WHEN down = 0 AND up = 0 THEN NULL WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END + 1.3e-9, 7) AS rsi_cleaning FROM g""".replace("greatest(d, 0)", "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END").replace("greatest(-d, 0)", "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END"))
def rsi_simple(spark, d):
    b = bars(spark, d).select("instrument", "date", "close").withColumn("close0", F.col("close"))
    w = R.series(KEYS, ORDER)
    b = b.withColumn("d", F.col("close") - F.lag("close").over(w))
    f = R.trailing(w, 14)
    up, down = F.avg(F.when(F.col("d") > 0, F.col("d")).when(F.col("d").isNotNull(), 0.0)).over(f), F.avg(F.when(F.col("d") < 0, -F.col("d")).when(F.col("d").isNotNull(), 0.0)).over(f)
    b = b.select("*", up.alias("up"), down.alias("down"), F.count("d").over(f).alias("n"))
    value = F.when((F.col("down") == 0) & (F.col("up") == 0), None).when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + R.ratio(F.col("up"), F.col("down"))))
    return b.select("instrument", "date", *_r(rsi=F.when(F.col("n") >= 14, value), rsi_cleaning=F.when(F.col("n") >= 1, value)))


@query("volume_indicators", f"""WITH {BARS}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER {W}), 0) * volume AS sv, (high + low + close) / 3 AS tp, extract(month FROM date) AS month,
  greatest(high - low, coalesce(abs(high - lag(close) OVER {W}), 0), coalesce(abs(low - lag(close) OVER {W}), 0)) AS tr FROM bars),
m AS (SELECT *, CASE WHEN month IS DISTINCT FROM lag(month) OVER {W} THEN 1 ELSE 0 END AS fresh FROM s), q AS (SELECT *, sum(fresh) OVER {W} AS run FROM m)
SELECT instrument, date, round(sum(sv) OVER {W} + 1.3e-9, 7) AS obv, round(sum(close * volume) OVER (PARTITION BY instrument, run ORDER BY date) / sum(volume) OVER (PARTITION BY instrument, run ORDER BY date) + 1.3e-9, 7) AS vwap_month,
  round(sum(tp * volume) OVER {W} / sum(volume) OVER {W} + 1.3e-9, 7) AS vwap, round(avg(tr) OVER {_over(14)} + 1.3e-9, 7) AS atr FROM q""")
def volume_indicators(spark, d):
    w = R.series(KEYS, ORDER)
    b = bars(spark, d).withColumn("month", F.month("date"))
    b = R.atr_mean(R.session_vwap(R.obv(b, KEYS, ORDER), KEYS, ORDER, "month", out="vwap_month"), KEYS, ORDER)
    return b.select("instrument", "date", *_r(obv=F.col("obv"), vwap_month=F.col("vwap_month"), vwap=R.cumulative_vwap(w), atr=F.col("atr")))


@query("lags_and_labels", f"""WITH {BARS}, m AS (SELECT date, avg(close) AS market FROM bars GROUP BY date), j AS (SELECT * FROM bars JOIN m USING (date))
SELECT instrument, date, round(lag(close, 1) OVER {W} + 1.3e-9, 7) AS close_lag1, round(lag(close, 2) OVER {W} + 1.3e-9, 7) AS close_lag2, round(ln(lead(close, 5) OVER {W} / close) + 1.3e-9, 7) AS forward_log, round(lead(close, 5) OVER {W} / close - 1 + 1.3e-9, 7) AS forward,
  round(sign(ln(lead(close, 5) OVER {W} / close)) + 1.3e-9, 7) AS label, round(ln(lead(close, 5) OVER {W} / close) - ln(lead(market, 5) OVER {W} / market) + 1.3e-9, 7) AS excess FROM j""")
def lags_and_labels(spark, d):
    w = R.series(KEYS, ORDER)
    b = bars(spark, d)
    b = b.join(b.groupBy("date").agg(F.avg("close").alias("market")), "date")
    return b.select("instrument", "date", *_r(**R.lags(["close"], 2, w), forward_log=R.forward_return("close", w, 5, log=True), forward=R.forward_return("close", w, 5), label=R.sign_label("close", w, 5), excess=R.excess_return_label("close", "market", w, 5)))


PAIR = f"""{BARS}, p AS (SELECT a.instrument, a.date, a.close AS a, b.close AS b FROM bars a JOIN bars b ON b.instrument = a.instrument % 2 + 1 AND b.date = a.date WHERE a.instrument > 2)"""


@query("pairs_beta_spread", f"""WITH {PAIR}, x AS (SELECT *, count(*) OVER {_over(30)} AS n, regr_slope(a, b) OVER {_over(30)} AS s, var_pop(b) OVER {_over(30)} AS v FROM p), y AS (SELECT *, CASE WHEN n >= 30 AND v > 0 THEN s END AS beta FROM x)
SELECT instrument, date, round(beta, 5) AS beta, round(a - beta * b, 5) AS spread FROM y""")
def pairs_beta_spread(spark, d):
    b = bars(spark, d)
    p = b.filter("instrument > 2").select("instrument", "date", F.col("close").alias("a")).join(b.filter("instrument <= 2").select(F.col("instrument").alias("leg"), "date", F.col("close").alias("b")), "date").filter("leg = instrument % 2 + 1")
    p = p.withColumn("beta", R.pairs_beta("a", "b", R.series(KEYS, ORDER), 30))
    return p.select("instrument", "date", F.round("beta", 5).alias("beta"), F.round(R.pairs_spread("a", "b", "beta"), 5).alias("spread"))


@query("half_life", f"""WITH {BARS}, l AS (SELECT instrument, date, close AS x, lag(close) OVER {W} AS y FROM bars),
f AS (SELECT *, count(CASE WHEN y IS NOT NULL THEN 1 END) OVER {_over(60)} AS n, regr_slope(x, y) OVER {_over(60)} AS phi FROM l), h AS (SELECT instrument, date, CASE WHEN n >= 60 AND phi > 0 AND phi < 1 THEN -ln(2) / ln(phi) END AS h FROM f)
SELECT instrument, date, round(CASE WHEN h BETWEEN 1 AND 252 THEN h END, 5) AS half_life FROM h""")
def half_life(spark, d):
    return R.half_life(bars(spark, d).select("instrument", "date", "close"), "close", KEYS, ORDER).select("instrument", "date", F.round("half_life", 5).alias("half_life"))


@query("momentum_xsec_rank", f"""WITH {BARS}, r AS (SELECT instrument, date, ln(close / lag(close) OVER {W}) AS ret FROM bars),
m AS (SELECT *, CASE WHEN count(ret) OVER f >= 10 THEN sum(ret) OVER f END AS mom FROM r WINDOW f AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING)),
k AS (SELECT *, round(mom, 9) AS key FROM m),
q AS (SELECT *, count(key) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY key NULLS LAST) + (count(*) OVER (PARTITION BY date, key) - 1) / 2 AS rk FROM k)
SELECT instrument, date, round(CASE WHEN key IS NOT NULL AND n >= 2 THEN rk / n END, 7) AS mom_rank FROM q""")
def momentum_xsec_rank(spark, d):
    w = R.series(KEYS, ORDER)
    b = bars(spark, d).select("instrument", "date", R.log_return("close", w).alias("ret"))
    f = R.trailing(w, 10, 5)
    b = b.withColumn("mom", F.round(F.when(F.count("ret").over(f) >= 10, F.sum("ret").over(f)), 9))
    return R.average_rank(b, "mom", ["date"], "mom_rank", percent=True, least=2).select("instrument", "date", F.round("mom_rank", 7).alias("mom_rank"))


@query("vol_scale_and_residual", f"""WITH {BARS}, m AS (SELECT date, avg(close) AS market FROM bars GROUP BY date), r AS (SELECT instrument, date, ln(close / lag(close) OVER {W}) AS ret, ln(market / lag(market) OVER {W}) AS mret FROM bars JOIN m USING (date)),
x AS (SELECT *, CASE WHEN count(ret) OVER {_over(20)} >= 20 THEN stddev_samp(ret) OVER {_over(20)} END AS vol, count(CASE WHEN ret IS NOT NULL AND mret IS NOT NULL THEN 1 END) OVER {_over(20)} AS n,
  avg(ret) OVER {_over(20)} AS my, avg(mret) OVER {_over(20)} AS mx, covar_pop(ret, mret) OVER {_over(20)} AS cxy, covar_pop(mret, mret) OVER {_over(20)} AS cxx FROM r)
SELECT instrument, date, round(CASE WHEN vol > 0 THEN least(0.15 / (vol * sqrt(252)), 2.0) ELSE 2.0 END * ret + 1.3e-9, 7) AS scaled, round(CASE WHEN n >= 20 THEN ret - (my + cxy / nullif(cxx, 0) * (mret - mx)) END + 1.3e-9, 7) AS residual FROM x""")
def vol_scale_and_residual(spark, d):
    w = R.series(KEYS, ORDER)
    b = bars(spark, d)
    b = b.join(b.groupBy("date").agg(F.avg("close").alias("market")), "date").select("instrument", "date", R.log_return("close", w).alias("ret"), R.log_return("market", w).alias("mret"))
    b = b.withColumn("vol", R.rolling_std("ret", w, 20, ddof=1)).withColumn("residual", R.residual_ols("ret", ["mret"], w, 20))
    return b.select("instrument", "date", *_r(scaled=R.vol_scale("ret", "vol"), residual=F.col("residual")))


@query("scaling_by_group", f"""WITH {BARS}, q AS (SELECT instrument, quantile_cont(close, 0.25) AS a, quantile_cont(close, 0.5) AS m, quantile_cont(close, 0.75) AS z, avg(close) AS mean, stddev_pop(close) AS sd FROM bars GROUP BY instrument)
SELECT instrument, date, round((close - m) / (z - a + 1e-12) + 1.3e-9, 7) AS close_robust, round(CASE WHEN sd = 0 THEN 0 ELSE (close - mean) / sd END + 1.3e-9, 7) AS close_z FROM bars JOIN q USING (instrument)""")
def scaling_by_group(spark, d):
    b = R.robust_scale(bars(spark, d), ["close"], KEYS)
    return b.select("instrument", "date", *_r(close_robust=F.col("close_robust"), close_z=R.zscore_group("close", KEYS)))


@query("event_window_flags", f"""WITH {BARS}, r AS (SELECT instrument, date, coalesce(abs(close / lag(close) OVER {W} - 1) > 1, false) AS extreme FROM bars)
SELECT instrument, date, extreme, coalesce(bool_or(extreme) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), false) AS near_extreme FROM r""")
def event_window_flags(spark, d):
    w = R.series(KEYS, ORDER)
    b = bars(spark, d).select("instrument", "date", F.coalesce(F.abs(R.pct_change("close", w)) > 1, F.lit(False)).alias("extreme"))
    return b.select("instrument", "date", "extreme", R.event_window("extreme", w, 2).alias("near_extreme"))


@query("sequence_windows", f"""WITH {BARS}, s AS (SELECT instrument, date, close, list(close) OVER f AS c, list(volume) OVER f AS v FROM bars WINDOW f AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT instrument, date, round(close + 1.3e-9, 7) AS close, round(c[1] + 1.3e-9, 7) AS first_close, round(c[5] + 1.3e-9, 7) AS last_close, round(v[3] + 1.3e-9, 7) AS mid_volume FROM s WHERE len(c) = 5""")
def sequence_windows(spark, d):
    s = R.sequence_windows(bars(spark, d), ["close", "volume"], "close", KEYS, ORDER, 5)
    return s.select("instrument", "date", *_r(close=F.col("close"), first_close=F.expr("features[0][0]"), last_close=F.expr("features[4][0]"), mid_volume=F.expr("features[2][1]")))


# recursive operators ------------------------------------------------------------------------------------------------

FEW = f"{BARS}, n AS (SELECT *, row_number() OVER {W} AS i, lag(close) OVER {W} AS before FROM bars)"


@query("recursive_indicators", f"""WITH RECURSIVE {FEW}, t AS (SELECT *, close - before AS d, greatest(high - low, coalesce(abs(high - before), 0), coalesce(abs(low - before), 0)) AS tr FROM n),
e AS (
  SELECT instrument, i, date, close AS f, close AS s, 0.0::DOUBLE AS g, NULL::DOUBLE AS up, NULL::DOUBLE AS down, tr AS atr FROM t WHERE i = 1
  UNION ALL
  SELECT t.instrument, t.i, t.date, 2.0 / 13 * t.close + (1 - 2.0 / 13) * e.f, 2.0 / 27 * t.close + (1 - 2.0 / 27) * e.s,
    0.2::DOUBLE * ((2.0 / 13 * t.close + (1 - 2.0 / 13) * e.f) - (2.0 / 27 * t.close + (1 - 2.0 / 27) * e.s)) + 0.8::DOUBLE * e.g,
    CASE WHEN e.up IS NULL THEN greatest(t.d, 0) ELSE e.up + (greatest(t.d, 0) - e.up) / 14 END, CASE WHEN e.down IS NULL THEN greatest(-t.d, 0) ELSE e.down + (greatest(-t.d, 0) - e.down) / 14 END, t.tr / 14 + e.atr * 13 / 14
  FROM e JOIN t ON t.instrument = e.instrument AND t.i = e.i + 1)
SELECT instrument, date, round(f, 5) AS ema_12, round(f - s, 5) AS macd, round(g, 5) AS macd_signal, round(f - s - g, 5) AS macd_hist, round(100 - 100 / (1 + up / (down + 1e-12)), 5) AS rsi, round(atr, 5) AS atr FROM e""".replace("2.0 / 13", "(2.0::DOUBLE / 13)").replace("2.0 / 27", "(2.0::DOUBLE / 27)"))
def recursive_indicators(spark, d):
    """EMA, MACD, RSI and ATR of each instrument in one pass over its series."""

    def kernel(p):
        h, lo, c = (p[x].to_numpy(float) for x in ("high", "low", "close"))
        m = S.macd(c)
        return {"ema_12": m["ema_fast"], **{k: m[k] for k in ("macd", "macd_signal", "macd_hist")}, "rsi": S.wilder_rsi(c), "atr": S.wilder_atr(h, lo, c)}

    names = ["ema_12", "macd", "macd_signal", "macd_hist", "rsi", "atr"]
    out = S.scan(bars(spark, d).select("instrument", "date", "high", "low", "close"), KEYS, ORDER, names, kernel)
    return out.select("instrument", "date", *[F.round(c, 5).alias(c) for c in names])


@query("adx_keltner", f"WITH RECURSIVE {INDICATORS} SELECT instrument, date, round(adx, 7) AS adx, round(CASE WHEN atr > 0 THEN 100 * pl / atr END, 7) AS dmp, round(CASE WHEN atr > 0 THEN 100 * mi / atr END, 7) AS dmn, round(4 * atr20 / e20, 7) AS keltner_width FROM ind")
def adx_keltner(spark, d):
    def kernel(p):
        h, lo, c = (p[x].to_numpy(float) for x in ("high", "low", "close"))
        mid, atr = S.ema(c, 20), S.wilder_atr(h, lo, c, 20)
        return {**S.adx(h, lo, c), "keltner_width": np.divide(4 * atr, mid)}

    names = ["adx", "dmp", "dmn", "keltner_width"]
    return S.scan(bars(spark, d).select("instrument", "date", "high", "low", "close"), KEYS, ORDER, names, kernel).select("instrument", "date", *[F.round(c, 7).alias(c) for c in names])


@query("pairs_position", f"""WITH RECURSIVE {BARS}, z AS (SELECT instrument, date, row_number() OVER {W} AS i, CASE WHEN count(close) OVER {_over(20)} >= 20 THEN round((close - avg(close) OVER {_over(20)}) / nullif(stddev_pop(close) OVER {_over(20)}, 0), 9) END AS z FROM bars),
p AS (SELECT instrument, date, i, CASE WHEN abs(z) >= 1.5 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END AS pos, 0 AS held FROM z WHERE i = 1
  UNION ALL SELECT z.instrument, z.date, z.i,
    CASE WHEN p.pos <> 0 AND z.z IS NOT NULL THEN CASE WHEN abs(z.z) <= 0.5 OR p.held + 1 >= 10 THEN 0 ELSE p.pos END WHEN p.pos <> 0 THEN p.pos WHEN abs(z.z) >= 1.5 THEN CASE WHEN z.z > 0 THEN -1 ELSE 1 END ELSE 0 END,
    CASE WHEN p.pos <> 0 AND z.z IS NOT NULL THEN CASE WHEN abs(z.z) <= 0.5 OR p.held + 1 >= 10 THEN 0 ELSE p.held + 1 END WHEN p.pos <> 0 THEN p.held + 1 ELSE 0 END
  FROM p JOIN z ON z.instrument = p.instrument AND z.i = p.i + 1),
c AS (SELECT instrument, date, i, pos, pos::DOUBLE * 0 + least(0.5, greatest(-0.5, pos)) AS w FROM p WHERE i = 1 UNION ALL SELECT p.instrument, p.date, p.i, p.pos, least(1, greatest(-1, c.w + least(0.5, greatest(-0.5, p.pos - c.w)))) FROM c JOIN p ON p.instrument = c.instrument AND p.i = c.i + 1)
SELECT instrument, date, pos::DOUBLE AS position, round(w::DOUBLE, 7) AS clamped FROM c""")
def pairs_position(spark, d):
    """Position state machine with entry, exit and holding limit, and its turnover-limited path."""
    z = bars(spark, d).select("instrument", "date", F.round(R.rolling_zscore("close", R.series(KEYS, ORDER), 20), 9).alias("z"))

    def kernel(p):
        pos = S.pairs_position(p["z"].to_numpy(float), np.ones(len(p), bool), 1.5, 0.5, 10)
        return {"position": pos, "clamped": S.turnover_clamp(pos, 0.5)}

    out = S.scan(z, KEYS, ORDER, ["position", "clamped"], kernel)
    return out.select("instrument", "date", "position", F.round("clamped", 7).alias("clamped"))


@query("bocpd")
def bocpd(spark, d):
    w = R.series(KEYS, ORDER)
    r = bars(spark, d).select("instrument", "date", R.log_return("close", w).alias("x"))
    return S.scan(r, KEYS, ORDER, ["change_probability", "run_length"], lambda p: S.bocpd(p["x"].to_numpy(float))).select("instrument", "date", F.round("change_probability", 7).alias("change_probability"), F.round("run_length", 4).alias("run_length"))
