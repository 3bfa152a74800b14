"""Queries of streams, sinks and readers: what is written or streamed is read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import readers
from ..sources.adapters import bars, table
from ..sources.shared import shared_folder
from ..streaming import pipelines as P
from .base import BARS, query
from .relational import TIE, _six


def _events(spark, d):
    """The events as a stream; a pattern, since a stream's path is else taken for a folder."""
    return P.file_stream(spark, f"{d}/event[s].parquet", spark.read.parquet(f"{d}/events.parquet").schema)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"


@query("stream_bars", """WITH b AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, count(*) AS n FROM events GROUP BY 1, 2)
SELECT * FROM b WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_bars(spark, d):
    """Hourly bars by event time, given as soon as the watermark has passed them."""
    e = _events(spark, d).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = P.drain(P.event_time_bars(e, ["event_type"], "ts", "value", "1 hour", "10 minutes"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "n")


def _stateful(spark, d, kernel):
    return P.drain(P.stateful(_events(spark, d).select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", kernel))


@query("stream_rsi", f"""WITH x AS (SELECT user_id, event_id, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, count(dv) OVER f AS n, avg(greatest(dv, 0)) OVER f AS gain, avg(greatest(-dv, 0)) OVER f AS loss FROM x WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, round(CASE WHEN n < 14 THEN NULL WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END + {TIE}, 6) AS rsi FROM g""")
def stream_rsi(spark, d):
    return _six(_stateful(spark, d, P.IncrementalRSI(14)), "user_id", "event_id", rsi="rsi")


@query("stream_macd", f"""WITH RECURSIVE x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
m AS (SELECT user_id, event_id, i, value AS f, value AS s, 0.0::DOUBLE AS g FROM x WHERE i = 1
  UNION ALL SELECT x.user_id, x.event_id, x.i, m.f + 2.0::DOUBLE / 13 * (x.value - m.f), m.s + 2.0::DOUBLE / 27 * (x.value - m.s), m.g + 0.2::DOUBLE * ((m.f + 2.0::DOUBLE / 13 * (x.value - m.f)) - (m.s + 2.0::DOUBLE / 27 * (x.value - m.s)) - m.g) FROM m JOIN x ON x.user_id = m.user_id AND x.i = m.i + 1)
SELECT user_id, event_id, round(f - s + {TIE}, 6) AS macd, round(g + {TIE}, 6) AS macd_signal FROM m""")
def stream_macd(spark, d):
    return _six(_stateful(spark, d, P.IncrementalMACD()), "user_id", "event_id", macd="macd", macd_signal="macd_signal")


@query("stream_buffer", f"SELECT user_id, event_id, round(avg(value) OVER w + {TIE}, 6) AS buffer_mean, count(*) OVER w::DOUBLE AS buffer_size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)".replace("count(*) OVER w::DOUBLE", "CAST(count(*) OVER w AS DOUBLE)"))
def stream_buffer(spark, d):
    return _six(_stateful(spark, d, P.RingBuffer(20)), "user_id", "event_id", "buffer_size", buffer_mean="buffer_mean")


@query("stream_anomalies")
def stream_anomalies(spark, d):
    return _stateful(spark, d, P.StreamingForest(200, 50))


@query("stream_cleaning", "SELECT event_id, user_id, upper(event_type) AS event_type, value * 2 AS value FROM events WHERE value > 1")
def stream_cleaning(spark, d):
    """Steps and a check over micro-batches, whose sink appends to a table."""
    path = _folder(spark)
    check = P.validate_batches(lambda b: ["no value"] if b.filter("value IS NULL").limit(1).count() else [])
    steps = [lambda b: check(b, 0), lambda b: b.filter("value > 1"), lambda b: b.select("event_id", "user_id", F.upper("event_type").alias("event_type"), (F.col("value") * 2).alias("value"))]
    P.run_steps(_events(spark, d), steps, lambda b, n: b.write.mode("append").parquet(f"{path}/data"), f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/data")


@query("stream_sessions", "WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k) SELECT * FROM g WHERE \"end\" <= (SELECT max(ts) FROM events)")
def stream_sessions(spark, d):
    """Sessions of each user that have ended by the last event."""
    e = _events(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "0 seconds")
    out = P.drain(P.sessions(e, ["user_id"], "ts", "6 hours"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# sinks and readers ----------------------------------------------------------------------------------------------------

OHLCV = "instrument, date, open, high, low, close, volume"


@query("panel_sink", f"WITH {BARS} SELECT {OHLCV}, year(date) AS year FROM bars")
def panel_sink(spark, d):
    """A panel written by year, with its manifest, and read back."""
    path = _folder(spark)
    b = bars(spark, d).select(*OHLCV.split(", "), F.year("date").cast("long").alias("year"))
    manifest = readers.write_panel(b, path, ["year"])
    readers.write_manifest(spark, manifest, f"{path}_manifest")
    back = spark.read.parquet(path)
    assert back.count() == manifest["rows"]
    return back.withColumn("year", F.col("year").cast("long"))


@query("hive_panel", f"WITH {BARS} SELECT {OHLCV} FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-06-30'")
def hive_panel(spark, d):
    """A panel by year and month, of which a range of dates is read; other folders are not."""
    path = _folder(spark)
    b = bars(spark, d).select(*OHLCV.split(", "), F.year("date").alias("year"), F.month("date").alias("month"))
    readers.write_panel(b, path, ["year", "month"])
    return readers.hive_panel(spark, path, start="1996-03-01", end="1997-06-30").select(*OHLCV.split(", "))


@query("indicator_product", f"WITH {BARS} SELECT instrument, date, close, volume > 25 AS busy FROM bars")
def indicator_product(spark, d):
    """Features with the supervision columns of their keys, as a product with its manifest."""
    path = _folder(spark)
    b = bars(spark, d)
    readers.materialize_indicators(b.select("instrument", "date", "close"), b.select("instrument", "date", (F.col("volume") > 25).alias("busy")), ["instrument", "date"], path)
    return spark.read.parquet(path)


@query("portfolio_products", "SELECT 'orders' AS product, count(*) AS n FROM orders UNION ALL SELECT 'region', count(*) FROM region")
def portfolio_products(spark, d):
    path = _folder(spark)
    found = readers.write_products(spark, path, {k: table(spark, d, k) for k in ("orders", "region")})
    rows = [spark.read.parquet(f"{path}/{k}").agg(F.count("*").alias("n")).select(F.lit(k).alias("product"), "n") for k in found]
    return rows[0].unionByName(rows[1])


@query("plan_cache", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def plan_cache(spark, d):
    """A plan's result, written on the first call and read on the second."""
    cache = readers.PersistentCache(spark, _folder(spark))
    plan = lambda: table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    cache.get_or_compute(plan())
    return cache.get_or_compute(plan())


def _files(spark, d, kind: str) -> str:
    path = f"{_folder(spark)}.{kind}"
    b = bars(spark, d).select(F.col("instrument").cast("string").alias("symbol"), F.date_format("date", "yyyy-MM-dd").alias("Date"), "close")
    {"csv": lambda w: w.option("header", True).csv(path), "jsonl": lambda w: w.json(path), "parquet": lambda w: w.parquet(path)}[kind](b.write)
    return path


@query("file_source", f"WITH {BARS} SELECT k.kind, CAST(instrument AS VARCHAR) AS symbol, CAST(date AS TIMESTAMP) AS timestamp, date AS valid_time, round(close + {TIE}, 6) AS close FROM bars, (VALUES ('csv'), ('jsonl'), ('parquet')) k(kind) WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def file_source(spark, d):
    """A history by each kind of file: time column found, interval kept, times stamped."""
    out = None
    for kind in ("csv", "jsonl", "parquet"):
        f = readers.file_source(spark, _files(spark, d, kind), start="1995-01-01", end="1996-12-31")
        one = _six(f.withColumn("kind", F.lit(kind)), "kind", F.col("symbol").cast("string").alias("symbol"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "valid_time", close="close")
        out = one if out is None else out.unionByName(one)
    return out


@query("split_records", "SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS execution_date, 1.0::DOUBLE AS split_from, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 2.0::DOUBLE END AS split_to, NULL::DOUBLE AS historical_adjustment_factor FROM orders")
def split_records(spark, d):
    """Loose records with a fixed list of columns; what fits no type is null, what lacks too."""
    loose = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("execution_date"), F.lit("1").alias("split_from"), F.when(F.col("o_orderstatus") == "F", "two").otherwise("2").alias("split_to"))
    return readers.normalize_splits(loose)


@query("dividend_records", "SELECT CAST(o_custkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS ex_dividend_date, o_totalprice AS cash_amount, 0.5::DOUBLE AS historical_adjustment_factor FROM orders")
def dividend_records(spark, d):
    loose = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").alias("ex_dividend_date"), F.col("o_totalprice").cast("string").alias("cash_amount"), F.lit(0.5).alias("historical_adjustment_factor"))
    return readers.normalize_dividends(loose)


@query("many_symbols", f"WITH {BARS} SELECT instrument, date, close FROM bars WHERE instrument IN (1, 3, 5)")
def many_symbols(spark, d):
    """The history of some symbols, which the caller names."""
    return readers.many_symbols(bars(spark, d), [1, 3, 5], "instrument").select("instrument", "date", "close")


