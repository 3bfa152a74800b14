"""Scalar functions: text, time, anonymisation, hashes, sketches, JSON, mathematics."""

from __future__ import annotations

import hashlib
import hmac
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed opening hours of the fallback calendar (New York time, Monday to Friday).
OPEN_MINUTE, CLOSE_MINUTE = 9 * 60 + 30, 16 * 60


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# text


def clean_ascii(x) -> Column:
    return F.regexp_replace(_c(x), r"[^\x00-\x7F]", "")


def lexicon_sentiment(x, lexicon: dict[str, float]) -> Column:
    """Sum of the weights of the words, which are compared in lower case."""
    if not lexicon:
        return F.lit(0.0)
    table = F.create_map(*[y for k, v in sorted(lexicon.items()) for y in (F.lit(k), F.lit(float(v)))])
    return F.aggregate(F.split(F.lower(_c(x)), r"\s+"), F.lit(0.0), lambda a, w: a + F.coalesce(table[w], F.lit(0.0)))


def mask(x, mark: str = "*") -> Column:
    return F.regexp_replace(_c(x), r"(?s).", mark)


def salted_hash(x, salt: str, algorithm: str = "sha256") -> Column:
    text = F.concat(F.lit(salt), _c(x).cast("string"))
    return F.sha2(text, 256) if algorithm == "sha256" else F.md5(text)


def hash_hex(x) -> Column:
    """64-bit hash as 16 hex digits."""
    return F.lower(F.lpad(F.hex(F.xxhash64(_c(x))), 16, "0"))


def laplace_noise(x, epsilon: float, seed: int) -> Column:
    """Value plus Laplace noise of scale 1 / epsilon; one draw per row."""
    u = F.rand(seed) - 0.5
    return F.transform(F.array(u), lambda v: _c(x) - F.signum(v) * F.log(F.greatest(1 - 2 * F.abs(v), F.lit(1e-300))) / epsilon)[0]


# time


def attach_zone(x, zone: str) -> Column:
    """A naive local time of a zone as an instant (the clock reading stays, it isn't converted)."""
    return F.to_utc_timestamp(_c(x).cast("timestamp_ntz"), zone)


def calendar_columns(x, holidays: dict[str, list[str]]) -> dict[str, Column]:
    """ISO weekday from 1 (Monday), and membership in each country's list of days."""
    day = F.date_format(_c(x), "yyyy-MM-dd")
    return {"day_of_week": F.weekday(_c(x)) + 1, **{f"is_holiday_{k.lower()}": day.isin(v) if v else F.lit(False) for k, v in holidays.items()}}


def market_open(ts, zone: str = "America/New_York") -> Column:
    t = F.from_utc_timestamp(_c(ts), zone)
    minute = F.hour(t) * 60 + F.minute(t)
    return (F.weekday(t) < 5) & (minute >= OPEN_MINUTE) & (minute < CLOSE_MINUTE)


def next_open(ts, zone: str = "America/New_York") -> Column:
    """The next opening, in the zone's local time: today's if it is still ahead, else that of the next weekday."""
    t = F.from_utc_timestamp(_c(ts), zone)
    ahead = (F.hour(t) * 60 + F.minute(t) < OPEN_MINUTE) & (F.weekday(t) < 5)
    skip = F.when(ahead, 0).when(F.weekday(t) == 4, 3).when(F.weekday(t) == 5, 2).otherwise(1)
    return (F.date_add(F.to_date(t), skip).cast("timestamp_ntz") + F.make_interval(mins=F.lit(OPEN_MINUTE))).cast("timestamp_ntz")


def calendar_features(x, session: tuple[int, int] = (9, 16)) -> dict[str, Column]:
    t = _c(x)
    return {"hour_in_session": F.hour(t).between(session[0], session[1] - 1), "weekday": F.weekday(t), "month": F.month(t), "quarter": F.quarter(t), "month_start": F.to_date(F.date_trunc("month", t))}


def trading_dates(spark, start: str, end: str) -> DataFrame:
    """Mondays to Fridays, both ends included."""
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS date").filter("weekday(date) < 5")


# hashes and sketches


def frame_hash(df: DataFrame) -> DataFrame:
    """n_rows and a hash of all rows that depends neither on their order nor on that of the columns."""
    h = F.xxhash64(*[F.lit(x) if isinstance(x, str) else x for c in sorted(df.columns) for x in (c, F.col(f"`{c}`"))])
    return df.agg(F.count("*").alias("n_rows"), F.hex(F.bit_xor(h)).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 32))).alias("sum"))


def canonical_json_hash(columns: list[str]) -> Column:
    """SHA-256 of a JSON object with sorted keys; for flat columns of text, whole numbers and booleans."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def derive_seed(key: bytes, *path: str) -> int:
    """A seed for a place in a tree of names, by HMAC-SHA-256."""
    return int.from_bytes(hmac.new(key, "/".join(path).encode(), hashlib.sha256).digest()[:8], "big")


def minhash(tokens, n: int = 128) -> Column:
    """The smallest of ``n`` keyed hashes over a set of tokens; null for an empty set."""
    t = _c(tokens)
    return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_min(F.transform(t, lambda x: F.xxhash64(i, x)))))


def minhash_likeness(a, b) -> Column:
    same = F.filter(F.zip_with(_c(a), _c(b), lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(_c(a))


def vector_sketch(vector, width: int, bits: int = 128, seed: int = 0) -> Column:
    """Signs of ``bits`` random hyperplanes as two longs (array), from Arrow batches by one matrix product."""

    def apply(batches: pd.Series) -> pd.Series:
        planes = np.random.default_rng(seed).standard_normal((width, bits))
        out = []
        for v in batches:
            if v is None or len(v) != width:
                out.append(None)
                continue
            signs = (np.asarray(v, float) @ planes) > 0
            out.append(np.packbits(signs, bitorder="little").view(np.int64).tolist())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(apply, "array<long>")(_c(vector))


def hamming(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def rolling_boundaries(text, window: int = 16, mask_bits: int = 6) -> Column:
    """Content-defined chunk ends: places where the hash of the last ``window`` characters has ``mask_bits`` zero bits."""
    t = _c(text)
    return F.when(F.length(t) >= window, F.filter(F.sequence(F.lit(window), F.length(t)), lambda i: F.pmod(F.xxhash64(F.substring(t, i - window + 1, F.lit(window))), F.lit(1 << mask_bits)) == 0)).otherwise(F.array().cast("array<int>"))


# JSON and maps


def parse_weights(x) -> Column:
    return F.map_filter(F.from_json(_c(x), "map<string,double>"), lambda k, v: v > 0)


def abstain_probability(deltas, temperature: float = 1.0, hurdle: float = 0.0) -> Column:
    """1 without a value over the hurdle, else 1 / (1 + sum of exp of the scaled values)."""
    d = F.filter(_c(deltas), lambda x: x.isNotNull())
    total = F.aggregate(F.transform(d, lambda x: F.exp(F.greatest(F.least(x / temperature, F.lit(20.0)), F.lit(-20.0)))), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(d) == 0) | (F.array_max(d) <= hurdle), 1.0).otherwise(1 / (1 + total))


def exposure_scale(volatility, disagreement, base: float = 1.0, penalty: float = 0.25) -> Column:
    v = F.when(_c(volatility) == "high", 0.5).when(_c(volatility) == "mid", 0.75).otherwise(1.0)
    x = base * v * F.greatest(F.lit(0.1), 1 - penalty * F.least(_c(disagreement), F.lit(1.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalize_weights(weights, max_gross: float = 1.0, allow_short: bool = False) -> Column:
    """A map of weights without cash, not negative unless allowed, scaled down to the largest gross weight."""
    w = F.map_filter(_c(weights), lambda k, v: (k != "cash") & v.isNotNull())
    w = w if allow_short else F.transform_values(w, lambda k, v: F.greatest(v, F.lit(0.0)))
    gross = F.aggregate(F.map_values(w), F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.transform_values(w, lambda k, v: F.when(gross > max_gross, v * max_gross / gross).otherwise(v))


# mathematics on the driver


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_pdf(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_ppf(p: float) -> float:
    """By Newton steps on the distribution function, from the standard library's value."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def expected_improvement(mu: float, sigma: float, best: float, xi: float = 0.01) -> float:
    if sigma <= 0:
        return 0.0
    z = (mu - best - xi) / sigma
    return (mu - best - xi) * normal_cdf(z) + sigma * normal_pdf(z)


def tuning_deflated_sharpe(sharpe: float, n_trials: int, n_obs: int, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    """Probability that a Sharpe ratio exceeds what the best of ``n_trials`` shows by chance."""
    if n_obs < 2:
        return 0.0
    spread = math.sqrt(max(1e-12, (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2) / (n_obs - 1)))
    if n_trials > 1:
        g = 0.5772156649015329
        hurdle = spread * ((1 - g) * normal_ppf(1 - 1 / n_trials) + g * normal_ppf(1 - 1 / (n_trials * math.e)))
    else:
        hurdle = 0.0
    return normal_cdf((sharpe - hurdle) / spread)


def chunk_windows(df: DataFrame, ts: str, every: str) -> DataFrame:
    """Rows with the start of the n-day or n-week chunk they belong to (``5D``, ``2W``)."""
    n, unit = int(every[:-1] or 1), every[-1].upper()
    if unit not in "DW":
        raise ValueError(f"unit {unit} is not D or W")
    return df.withColumn("chunk", F.window(F.col(ts).cast("timestamp"), f"{n * (7 if unit == 'W' else 1)} days")["start"])


def date_codes(df: DataFrame, date: str = "date", out: str = "date_code") -> DataFrame:
    """0-based ordinals of the distinct dates, which alone are ordered globally."""
    codes = df.select(date).distinct().withColumn(out, F.row_number().over(Window.orderBy(date)) - 1)
    return df.join(codes, date)
