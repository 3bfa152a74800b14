"""The registry of queries, and the SQL that oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Daily bars from line items; the same definition as ``tidegauge.sources.adapters.bars``.
BARS = """ticks AS (
  SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_extendedprice AS value,
    row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS tie FROM lineitem),
bars AS (
  SELECT instrument, date, arg_min(price, tie) AS open, max(price) AS high, min(price) AS low, arg_max(price, tie) AS close,
    sum(volume) AS volume, round(sum(value), 2) AS dollar_volume FROM ticks GROUP BY ALL)"""

#: Three signal models over the bars, as ``tidegauge.sources.adapters.predictions``.
PREDICTIONS = BARS + """,
lagged AS (SELECT *, lag(close, 1) OVER w AS c1, lag(close, 5) OVER w AS c5, lag(volume, 1) OVER w AS v1, lead(close, 1) OVER w AS next_close,
    row_number() OVER w AS nth FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date)),
scored AS (SELECT instrument, date, next_close / close - 1 AS forward_return, ln(close / c1) AS momentum, -ln(close / c5) AS reversal, ln(volume / v1) AS volume_trend FROM lagged WHERE nth > 5 AND next_close IS NOT NULL),
dates AS (SELECT date, ntile(3) OVER (ORDER BY date) - 1 AS fold FROM (SELECT DISTINCT date FROM scored)),
predictions AS (
  SELECT m.model_id, CAST(s.instrument AS VARCHAR) AS instrument, s.date, 'fold_' || d.fold AS fold_id, CASE WHEN d.fold = 2 THEN 'test' ELSE 'train' END AS split,
    round(m.prediction, 8) AS prediction, round(s.forward_return, 8) AS forward_return
  FROM scored s JOIN dates d USING (date), LATERAL (VALUES ('momentum', s.momentum), ('reversal', s.reversal), ('volume', s.volume_trend)) m(model_id, prediction))"""

#: The recursive indicators of each series, row by row; begins a ``WITH RECURSIVE``.
INDICATORS = BARS + """, ind_n AS (SELECT *, row_number() OVER w AS i, close - lag(close) OVER w AS d, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY date)),
ind_t AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus FROM ind_n),
ind AS (SELECT instrument, i, date, close, close AS e12, close AS e26, 0.0::DOUBLE AS g, close AS e20, close AS e50, NULL::DOUBLE AS gain, NULL::DOUBLE AS loss, tr AS atr, tr AS atr20, 0.0::DOUBLE AS pl, 0.0::DOUBLE AS mi, NULL::DOUBLE AS adx FROM ind_t WHERE i = 1
  UNION ALL SELECT t.instrument, t.i, t.date, t.close, e.e12 + 2.0::DOUBLE / 13 * (t.close - e.e12), e.e26 + 2.0::DOUBLE / 27 * (t.close - e.e26), 0.2::DOUBLE * ((e.e12 + 2.0::DOUBLE / 13 * (t.close - e.e12)) - (e.e26 + 2.0::DOUBLE / 27 * (t.close - e.e26))) + 0.8::DOUBLE * e.g,
    e.e20 + 2.0::DOUBLE / 21 * (t.close - e.e20), e.e50 + 2.0::DOUBLE / 51 * (t.close - e.e50), CASE WHEN e.gain IS NULL THEN greatest(t.d, 0) ELSE e.gain + (greatest(t.d, 0) - e.gain) / 14 END, CASE WHEN e.loss IS NULL THEN greatest(-t.d, 0) ELSE e.loss + (greatest(-t.d, 0) - e.loss) / 14 END,
    e.atr + (t.tr - e.atr) / 14, e.atr20 + (t.tr - e.atr20) / 20, e.pl + (t.plus - e.pl) / 14, e.mi + (t.minus - e.mi) / 14,
    CASE WHEN e.atr + (t.tr - e.atr) / 14 > 0 AND e.pl + (t.plus - e.pl) / 14 + e.mi + (t.minus - e.mi) / 14 > 0 THEN coalesce(e.adx * 13 / 14, 100 * abs(e.pl + (t.plus - e.pl) / 14 - e.mi - (t.minus - e.mi) / 14) / (e.pl + (t.plus - e.pl) / 14 + e.mi + (t.minus - e.mi) / 14) * 13 / 14) + 100 * abs(e.pl + (t.plus - e.pl) / 14 - e.mi - (t.minus - e.mi) / 14) / (e.pl + (t.plus - e.pl) / 14 + e.mi + (t.minus - e.mi) / 14) / 14 ELSE e.adx END
  FROM ind e JOIN ind_t t ON t.instrument = e.instrument AND t.i = e.i + 1)"""


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with its SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
