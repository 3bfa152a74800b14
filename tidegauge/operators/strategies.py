"""Signals, sizing, blending, and trade intents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import ratio, rolling_mean, rolling_std, series
from .sequential import scan, turnover_clamp


def _clip(x: Column, c: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(c)), F.lit(-c)))


def threshold_intents(predictions: DataFrame, strategy_id: str, source: str, threshold: float = 0.0, interval: str = "1d", lineage: dict[str, str] | None = None) -> DataFrame:
    """Long over the threshold, short under its negative, else flat; a prediction that is no finite number is flat and
    not eligible."""
    x = F.col("prediction")
    known = x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))
    direction = F.when(known & (x > threshold), "long").when(known & (x < -threshold), "short").otherwise("flat")
    extra = [c for c in ("fold_id", "split", "model_id") if c in predictions.columns]
    return predictions.select(
        F.concat_ws(":", F.lit(strategy_id), F.col("date").cast("string"), "instrument").alias("intent_id"), F.lit(strategy_id).alias("strategy_id"), "date", "instrument", F.lit(interval).alias("interval"), *extra,
        direction.alias("direction"), F.when(known, x).alias("score"), known.alias("eligible"), F.lit(False).alias("abstain"), F.lit(source).alias("source_product_id"),
        F.create_map(*[F.lit(v) for kv in sorted((lineage or {"source": source}).items()) for v in kv]).alias("lineage"),
    )


def production_intents(predictions: DataFrame, strategy_id: str, source: str, top_k: int, threshold: float = 0.0) -> DataFrame:
    """The top-k predictions of each date, fold and split as intents by their absolute value, zeros dropped; no short
    can arise here (the signed operator is ``threshold_intents``)."""
    w = Window.partitionBy("date", "fold_id", "split").orderBy(F.desc("prediction"), "instrument")
    top = predictions.filter("prediction IS NOT NULL").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= top_k).drop("__n")
    return threshold_intents(top.withColumn("prediction", F.abs("prediction")).filter("prediction <> 0"), strategy_id, source, threshold)


def rsi_signal(rsi: str, upper: float = 70.0, lower: float = 30.0, linear: bool = False, keys: list[str] | None = None) -> Column:
    """1 at or under ``lower``, -1 at or over ``upper``, else 0 or linear between; with ``keys``, a series with an
    unknown value has no signal at all."""
    x = F.col(rsi)
    mid = (upper + lower) / 2
    inside = (mid - x) / ((upper - lower) / 2) if linear else F.lit(0.0)
    s = F.when(x <= lower, 1.0).when(x >= upper, -1.0).when(x.isNotNull(), inside).otherwise(0.0)
    return F.when(F.max(x.isNull().cast("int")).over(Window.partitionBy(*keys)) == 1, 0.0).otherwise(s) if keys else s


def macd_signal(hist: str, line: str, signal: str, use_histogram: bool = True) -> Column:
    return F.coalesce(_clip(F.tanh(hist)) if use_histogram else F.signum(F.col(line) - F.col(signal)), F.lit(0.0))


def bollinger_signal(x: str, mid: str, std: str, width: float = 2.0, mode: str = "reversion") -> Column:
    z = ratio(F.col(x) - F.col(mid), F.col(std) * width)
    if mode == "reversion":
        return F.coalesce(-_clip(_clip(z, 1.5)), F.lit(0.0))
    return F.when(z > 0.8, 1.0).when(z < -0.8, -1.0).otherwise(0.0)


def mean_reversion_signal(z: str, entry: float = 2.0) -> Column:
    return F.coalesce(-F.tanh(F.col(z) / entry), F.lit(0.0))


def crossover_signal(fast: str, slow: str) -> Column:
    """1 if the fast mean is above, else -1 (unknown, too)."""
    return F.when(F.col(fast) > F.col(slow), 1.0).otherwise(-1.0)


def ensemble(signals: list[str], weights: list[float] | None = None, method: str = "weighted") -> Column:
    """The weighted mean within -1 and 1, or the sign of the sum of signs."""
    if method == "majority":
        return F.signum(sum((F.signum(F.coalesce(F.col(s), F.lit(0.0))) for s in signals), F.lit(0.0)))
    w = weights or [1.0] * len(signals)
    return _clip(sum((F.coalesce(F.col(s), F.lit(0.0)) * x for s, x in zip(signals, w)), F.lit(0.0)) / sum(abs(x) for x in w))


def adaptive_ensemble(df: DataFrame, signals: list[str], ret: str, keys: list[str], order: list[str], window: int = 50, out: str = "signal") -> DataFrame:
    """Signals weighted by their hit rates over the last ``window`` rows (known before the current row)."""
    w = series(keys, order)
    d = df
    for s in signals:
        d = d.withColumn(f"__h_{s}", (F.signum(F.lag(s).over(w)) == F.signum(F.col(ret))).cast("double"))
    f = w.rowsBetween(-window, -1)
    for s in signals:
        d = d.withColumn(f"__w_{s}", F.coalesce(F.avg(f"__h_{s}").over(f), F.lit(0.5)))
    total = sum((F.col(f"__w_{s}") for s in signals), F.lit(0.0))
    mixed = ratio(sum((F.col(f"__w_{s}") * F.coalesce(F.col(s), F.lit(0.0)) for s in signals), F.lit(0.0)), total)
    return d.withColumn(out, F.coalesce(_clip(mixed), F.lit(0.0))).drop(*[f"__{k}_{s}" for k in "hw" for s in signals])


def linear_size(x: str, scale: float = 1.0, clip: float = 1.0) -> Column:
    return _clip(F.col(x), clip) * scale


def limit_turnover(df: DataFrame, x: str, keys: list[str], order: list[str], most: float = 0.5, out: str = "position") -> DataFrame:
    return scan(df.withColumn("__x", F.col(x).cast("double")), keys, order, [out], lambda p: {out: turnover_clamp(p["__x"].to_numpy(float), most)}).drop("__x")


def blend(signals: DataFrame, weights: dict[str, float], cap: float = 1.0) -> DataFrame:
    """Strategies (strategy_id, date, instrument, signal) by weights normalised to one; the sum of absolute weights of a
    date is at most ``cap``."""
    total = sum(abs(v) for v in weights.values())
    w = F.create_map(*[F.lit(v) for kv in sorted(weights.items()) for v in kv])
    d = signals.filter(F.col("strategy_id").isin(list(weights))).groupBy("date", "instrument").agg(F.sum(F.col("signal") * w[F.col("strategy_id")] / total).alias("weight"))
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("date"))
    return d.withColumn("weight", F.when(gross > cap, F.col("weight") * cap / gross).otherwise(F.col("weight")))


def backtest(weights: DataFrame, prices: DataFrame, leverage: float = 1.0, cost_bps: float = 0.0) -> DataFrame:
    """Daily return and value of weights (date, instrument, weight) that earn the next day's return: weights are capped
    at the leverage, lagged by a row, and pay for changes (the first is free)."""
    w = series(["instrument"], ["date"])
    gross = F.sum(F.abs("weight")).over(Window.partitionBy("date"))
    own = weights.withColumn("weight", F.when(gross > leverage, F.col("weight") * leverage / gross).otherwise(F.col("weight")))
    d = prices.join(own, ["date", "instrument"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    d = d.withColumns({"__r": ratio(F.col("close"), F.lag("close").over(w)) - 1, "__w": F.lag("weight").over(w), "__t": F.abs(F.col("weight") - F.lag("weight").over(w))})
    by = d.groupBy("date").agg(F.sum(F.coalesce(F.col("__w") * F.col("__r"), F.lit(0.0))).alias("gross"), F.sum(F.coalesce("__t", F.lit(0.0))).alias("turnover"))
    by = by.withColumn("ret", F.col("gross") - F.col("turnover") * cost_bps / 1e4)
    return by.withColumn("nav", F.product(1 + F.col("ret")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))  # a row a date


def momentum(df: DataFrame, variant: str, price: str, keys: list[str], order: list[str], window: int = 252, skip: int = 21, out: str = "signal") -> DataFrame:
    """xsec: centred rank of trailing returns per date; tsmom: sign of the own trailing return; dual: the rank where the
    own return agrees in sign."""
    from .rolling import xsec_rank

    w = series(keys, order)
    d = df.withColumn("__ret", F.log(ratio(F.col(price), F.lag(price).over(w))))
    own = F.signum(F.sum("__ret").over(w.rowsBetween(-(window - 1) - skip, -skip)))
    if variant == "tsmom":
        return d.withColumn(out, F.coalesce(own, F.lit(0.0))).drop("__ret")
    d = xsec_rank(d.withColumn("__own", own), "__ret", order[0], keys[0], window, skip, "__rank")
    rank = F.coalesce(2 * F.col("__rank") - 1, F.lit(0.0))
    value = {"xsec": rank, "dual": F.when(F.signum(rank) == F.col("__own"), rank).otherwise(0.0)}[variant]
    return d.withColumn(out, value).drop("__ret", "__own", "__rank")


def zscore_columns(x: str, keys: list[str], order: list[str], n: int = 20) -> dict[str, Column]:
    w = series(keys, order)
    return {"mid": rolling_mean(x, w, n), "std": rolling_std(x, w, n), "z": ratio(F.col(x) - rolling_mean(x, w, n), rolling_std(x, w, n))}


def champion_challenger(evaluate: Callable[[dict], float], champion: dict, challenger: dict, margin: float = 0.01) -> dict:
    """Backtests both parameter sets; the challenger takes over from a score of (1 + margin) times the champion's on."""
    a, b = evaluate(champion), evaluate(challenger)
    promoted = b >= a * (1 + margin) if a >= 0 else b >= a * (1 - margin)
    return {"champion_score": a, "challenger_score": b, "promoted": promoted, "params": challenger if promoted else champion}


def pairs_table(df: DataFrame, a: str, b: str, date: str = "date", price: str = "close", instrument: str = "instrument") -> DataFrame:
    """The prices of two instruments side by side on the dates both have."""
    one = lambda k, n: df.filter(F.col(instrument) == k).select(date, F.col(price).alias(n))
    return one(a, "a").join(one(b, "b"), date)


def as_frame(spark, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(rows))
