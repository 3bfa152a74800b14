"""Sources and sinks. Every source is a named function that gives a lazy DataFrame; paths are opened by Spark alone."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import infer_ticker_column, nan_to_null, parse_time

SOURCES: dict[str, Callable[..., DataFrame]] = {}
#: Fixed columns of the corporate-action records.
SPLIT_COLUMNS = {"ticker": "string", "execution_date": "date", "split_from": "double", "split_to": "double", "historical_adjustment_factor": "double"}
DIVIDEND_COLUMNS = {"ticker": "string", "ex_dividend_date": "date", "cash_amount": "double", "historical_adjustment_factor": "double"}


class SourceError(ValueError):
    pass


def register_source(name: str):
    def add(f):
        SOURCES[name] = f
        return f

    return add


def read_path(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By suffix: csv, jsonl/ndjson (each also gzipped), parquet/pq."""
    name = path.lower().rstrip("/").removesuffix(".gz")
    kind = name.rsplit(".", 1)[-1]
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if kind in ("jsonl", "ndjson", "json"):
        return reader.json(path)
    if kind in ("parquet", "pq"):
        return reader.parquet(path)
    raise SourceError(f"unsupported file extension: {path}")


@register_source("file")
def file_source(spark: SparkSession, path: str, symbol: str | None = None, start: str | None = None, end: str | None = None, kind: str | None = None) -> DataFrame:
    """History from a file: the time column is found by name (any case) and parsed, the symbol added if there is none,
    rows filtered by symbol and closed interval, and stamped with valid_time and knowledge_time where these lack. Rows
    have no order: windows and sinks that need one ask for it."""
    df = read_path(spark, path) if kind is None else read_path(spark, path) if kind != "arrow" else read_arrow(spark, path)
    low = {c.lower(): c for c in reversed(df.columns)}
    ts = next((low[x] for x in ("timestamp", "date", "time") if x in low), None)
    if ts is None:
        raise SourceError("no column timestamp, date or time")
    df = df.withColumnRenamed(ts, "timestamp")
    kinds = dict(df.dtypes)
    df = df.withColumn("timestamp", parse_time("timestamp") if kinds["timestamp"] == "string" else F.col("timestamp").cast("timestamp"))
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol).cast("string"))
    elif symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    if start:
        df = df.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    for c in ("valid_time", "knowledge_time"):
        if c not in df.columns:
            df = df.withColumn(c, F.to_date("timestamp"))
    return nan_to_null(df)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file, fetched by Spark as bytes and decoded on the executors; one file a row."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.first()
    if first is None:
        raise SourceError(f"no file {path}")
    schema = pa.ipc.open_file(pa.BufferReader(bytes(first["content"]))).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    def decode(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                yield from pa.ipc.open_file(pa.BufferReader(content)).read_all().to_batches()

    return files.mapInArrow(decode, from_arrow_schema(schema))


@register_source("hive_panel")
def hive_panel(spark: SparkSession, root: str, symbol: str = "*", start: str | None = None, end: str | None = None, float32: bool = False) -> DataFrame:
    """A panel partitioned by year and month; the date range prunes partitions."""
    df = spark.read.parquet(root)
    if symbol != "*":
        df = df.filter(F.col(infer_ticker_column(df) or "instrument") == symbol)
    for bound, op in ((start, ">="), (end, "<=")):
        if bound:
            y, m, d = map(int, bound.split("-"))
            if {"year", "month"} <= set(df.columns):
                df = df.filter(F.expr(f"year * 100 + month {op} {y * 100 + m}")).filter(F.expr(f"year {op} {y}"))
            df = df.filter(F.expr(f"date {op} DATE '{y:04d}-{m:02d}-{d:02d}'"))
    if float32:
        df = df.withColumns({c: F.col(c).cast("float") for c, k in df.dtypes if k == "double"})
    return df


def read_day_files(spark: SparkSession, path: str, knowledge_time: str) -> DataFrame:
    """Gzipped daily csv files named by date: adds symbol, date, valid_time and knowledge_time."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    day = F.to_date(F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})\.csv", 1))
    df = df.withColumnRenamed("ticker", "symbol") if "ticker" in df.columns else df
    return df.withColumn("date", day).withColumn("valid_time", day).withColumn("knowledge_time", F.lit(knowledge_time).cast("timestamp"))


def normalize_records(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A fixed list of columns of loose records; what doesn't fit a type is null, what lacks too."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS {k})").alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items()])


def normalize_splits(df: DataFrame) -> DataFrame:
    return normalize_records(df, SPLIT_COLUMNS)


def normalize_dividends(df: DataFrame) -> DataFrame:
    return normalize_records(df, DIVIDEND_COLUMNS)


@register_source("composite")
def composite(frames: list[DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """All sources that can be read, with the sorted columns that they share; types are widened."""
    good = []
    for f in frames:
        try:
            good.append(f() if callable(f) else f)
        except Exception:  # a source that fails is left out, that is what this source is for
            continue
    if not good:
        raise SourceError("no source could be read")
    common = sorted(set.intersection(*[set(g.columns) for g in good]))
    return reduce(lambda a, b: a.unionByName(b), [g.select(*common) for g in good])


@register_source("failover")
def failover(frames: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first source that gives a row's worth of data without an error."""
    errors = []
    for f in frames:
        try:
            df = f()
            df.limit(1).collect()
            return df
        except Exception as e:
            errors.append(str(e)[:200])
    raise SourceError("; ".join(errors) or "no sources")


def many_symbols(df: DataFrame, symbols: list, column: str = "symbol") -> DataFrame:
    return df.filter(F.col(column).isin(symbols))


def unite_fetched(found: dict[str, DataFrame | Exception], column: str = "ticker") -> DataFrame:
    """Frames by ticker as one, with the ticker as a column; entries that are exceptions are skipped."""
    good = {k: v for k, v in found.items() if not isinstance(v, Exception)}
    if not good:
        raise SourceError("nothing usable was fetched")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [v if column in v.columns else v.withColumn(column, F.lit(k)) for k, v in good.items()])


def append_store(chunks: list[DataFrame]) -> DataFrame:
    """A bitemporal store is the union of its chunks, each of which must have symbol, valid_time and knowledge_time."""
    for c in chunks:
        if missing := {"symbol", "valid_time", "knowledge_time"} - set(c.columns):
            raise SourceError(f"chunk without {sorted(missing)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chunks)


class RemoteSource:
    """Contract of sources behind a network: a function of (symbol, start, end) that gives rows, one request a symbol,
    made on the executors. Nothing here opens a connection by itself."""

    def __init__(self, fetch: Callable[[str, str, str], pd.DataFrame], schema: str):
        self.fetch, self.schema = fetch, schema

    def read(self, spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame:
        fetch = self.fetch
        asked = spark.createDataFrame([(s,) for s in symbols], "symbol string").repartition(max(1, len(symbols)), "symbol")
        return asked.mapInPandas(lambda it: (fetch(s, start, end).assign(symbol=s) for p in it for s in p["symbol"]), self.schema)


for _name in ("alpha_vantage", "coingecko", "fred", "ibkr", "influxdb", "quandl", "yahoo", "satellite", "weather", "social_sentiment"):
    SOURCES[_name] = RemoteSource


# generated data -------------------------------------------------------------------------------------------------------


def generate_ohlcv(spark: SparkSession, n_rows: int = 252, start_price: float = 100.0, daily_vol: float = 0.01, start: str = "2020-01-01", seed: int = 42) -> DataFrame:
    """A deterministic walk: a linear congruential generator drives the prices, which are rounded to six places."""
    x, price, rows, day = seed & 0xFFFFFFFF, start_price, [], date.fromisoformat(start)

    def draw() -> float:
        nonlocal x
        x = (1664525 * x + 1013904223) & 0xFFFFFFFF
        return x / 2**32

    for i in range(n_rows):
        o = price
        price = max(0.01, price * (1 + daily_vol * (2 * draw() - 1)))
        hi, lo = max(o, price) * (1 + daily_vol * draw() / 2), min(o, price) * (1 - daily_vol * draw() / 2)
        rows.append((day + timedelta(days=i), *(round(v, 6) for v in (o, hi, lo, price)), int(100_000 + 900_000 * draw())))
    return spark.createDataFrame(rows, "date date, open double, high double, low double, close double, volume long")


def synthetic_panel(spark: SparkSession, seed: int = 42, n_tickers: int = 40, n_days: int = 180, regime_length: int = 40) -> DataFrame:
    """Tickers by days under two regimes that alternate; a small fixture made on the driver."""
    rng, rows, first = np.random.default_rng(seed), [], date(2020, 1, 1)
    drift = rng.normal(0, 0.0005, n_tickers)
    price = np.full(n_tickers, 100.0)
    for d in range(n_days):
        calm = (d // regime_length) % 2 == 0
        price = price * np.exp(drift * (1 if calm else -1) + rng.normal(0, 0.01 if calm else 0.025, n_tickers))
        rows += [((first + timedelta(days=d)).isoformat(), f"T{i:03d}", "1d", float(p)) for i, p in enumerate(price)]
    return spark.createDataFrame(rows, "date string, instrument string, interval string, adj_close double")


# sinks ----------------------------------------------------------------------------------------------------------------


def write_panel(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", **options) -> dict:
    """Writes Parquet and returns its manifest (rows, columns, a hash of the content that ignores the order of rows)."""
    from ..functions.scalars import frame_hash

    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    row = frame_hash(df.sparkSession.read.parquet(path)).first()
    return {"path": path, "rows": row["n_rows"], "hash": row["xor"], "columns": {c: k for c, k in df.dtypes}}


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    """JSON beside the data, through Spark's file system."""
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def materialize_indicators(df: DataFrame, supervision: DataFrame, keys: list[str], path: str) -> dict:
    """The indicator product: features with the supervision columns of their keys, as Parquet and manifest."""
    from ..operators.joins import left_join_first

    own = [c for c in supervision.columns if c not in keys]
    manifest = write_panel(left_join_first(df, supervision, keys, own), path)
    write_manifest(df.sparkSession, manifest, f"{path}_manifest")
    return manifest


def write_products(spark: SparkSession, run_dir: str, products: dict[str, DataFrame]) -> dict:
    return {name: write_panel(df, f"{run_dir}/{name}") for name, df in products.items()}


class PersistentCache:
    """Frames by key under a folder; a key's versions follow each other, the last one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, key: str) -> bool:
        fs, p = self._fs(f"{self.root}/{key}/_SUCCESS")
        return fs.exists(p)

    def save(self, key: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{key}")
        return self.load(key)

    def load(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{key}")

    def invalidate(self, key: str) -> None:
        fs, p = self._fs(f"{self.root}/{key}")
        fs.delete(p, True)

    def get_or_compute(self, df: DataFrame) -> DataFrame:
        """Keyed by the plan and by names, sizes and times of its input files, so an equal plan over the same files is
        read and not run again."""
        conf = self.spark.conf
        before = conf.get("spark.sql.debug.maxToStringFields")
        conf.set("spark.sql.debug.maxToStringFields", str(1 << 20))
        try:
            parts = [df._jdf.queryExecution().analyzed().canonicalized().toString(), str(df.semanticHash()), df.schema.json()]
        finally:
            conf.set("spark.sql.debug.maxToStringFields", before)
        for path in sorted(df.inputFiles()):
            fs, p = self._fs(path)
            status = fs.getFileStatus(p)
            parts += [path, str(status.getLen()), str(status.getModificationTime())]
        key = "plan_" + hashlib.sha256("\n".join(parts).encode()).hexdigest()
        return self.load(key) if self.exists(key) else self.save(key, df)
