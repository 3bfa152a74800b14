"""Streams: file sources, micro-batch cleaning, stateful indicators, event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_folder


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def run_steps(stream: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = None, buffer: int = 1):
    """Starts a query that applies the steps to each micro-batch. The checkpoint makes a restart go on where it stopped.
    With ``buffer`` the steps see so many batches at once only if the source makes them so: Spark has no half batches."""

    def each(batch: DataFrame, number: int) -> None:
        for s in steps:
            batch = s(batch)
        sink(batch, number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def validate_batches(check: Callable[[DataFrame], list[str]], strict: bool = True, rate: float = 1.0) -> Callable[[DataFrame, int], DataFrame]:
    """A step that checks every floor(1 / rate)-th batch."""
    every = max(1, int(1 / rate)) if rate > 0 else 0

    def step(batch: DataFrame, number: int) -> DataFrame:
        if every and number % every == 0 and (found := check(batch)) and strict:
            raise ValueError("; ".join(found))
        return batch

    return step


class Incremental:
    """A kernel with state of fixed size for each key: ``start()`` gives the state, ``step(state, row)`` its outputs."""

    outputs: list[str]

    def start(self) -> list[float]:
        raise NotImplementedError

    def step(self, state: list[float], x: float) -> list[float | None]:
        raise NotImplementedError


class IncrementalRSI(Incremental):
    """Means over the last ``n`` differences; null until there are so many; 100 without losses."""

    def __init__(self, n: int = 14):
        self.n, self.outputs = n, ["rsi"]

    def start(self) -> list[float]:
        return []  # the last value, then the differences

    def step(self, state, x):
        if state:
            state.append(x - state[0])
            del state[1 : max(1, len(state) - self.n)]
            state[0] = x
        else:
            state.append(x)
        d = np.array(state[1:])
        if len(d) < self.n:
            return [None]
        gain, loss = np.maximum(d, 0).mean(), np.maximum(-d, 0).mean()
        return [100.0 if loss == 0 else float(100 - 100 / (1 + gain / loss))]


class IncrementalMACD(Incremental):
    """Both means start at the first value, the signal line at 0."""

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.a = [2 / (n + 1) for n in (fast, slow, signal)]
        self.outputs = ["macd", "macd_signal"]

    def start(self) -> list[float]:
        return []

    def step(self, state, x):
        if not state:
            state += [x, x, 0.0]
        else:
            state[0] += self.a[0] * (x - state[0])
            state[1] += self.a[1] * (x - state[1])
        line = state[0] - state[1]
        state[2] += self.a[2] * (line - state[2])
        return [line, state[2]]


class RingBuffer(Incremental):
    """The mean and number of the last ``capacity`` values."""

    def __init__(self, capacity: int):
        self.n, self.outputs = capacity, ["buffer_mean", "buffer_size"]

    def start(self) -> list[float]:
        return []

    def step(self, state, x):
        state.append(x)
        del state[: max(0, len(state) - self.n)]
        return [float(np.mean(state)), float(len(state))]


class StreamingForest(Incremental):
    """Isolation score against a forest over the last ``window`` values, fitted anew every ``refit`` values; rows pass
    with no score until the first fit. The state is the window and a counter; the forest is rebuilt from it."""

    def __init__(self, window: int = 1000, refit: int = 100, seed: int = 42):
        self.window, self.refit, self.seed, self.outputs, self.fitted = window, refit, seed, ["anomaly_score"], {}

    def start(self) -> list[float]:
        return [0.0]

    def step(self, state, x):
        from ..operators.cleaning import IsolationForest

        state[0] += 1
        state.append(x)
        del state[1 : max(1, len(state) - self.window)]
        if state[0] < self.refit:
            return [None]
        version = int(state[0] // self.refit)
        key = (version, len(state))
        if state[0] % self.refit == 0 or not self.fitted or next(iter(self.fitted))[0] != version:
            self.fitted = {key: IsolationForest(trees=20, seed=self.seed).fit(np.array(state[1:])[:, None])}
        return [float(next(iter(self.fitted.values())).score(np.array([[x]]))[0])]


def stateful(stream: DataFrame, keys: list[str], order: str, value: str, kernel: Incremental) -> DataFrame:
    """Each row with the kernel's outputs; state per key lives in the state store. Rows of a key within a batch are
    taken by ``order``."""
    fields = [f for f in stream.schema.fields if f.name in (*keys, order, value)]
    out = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in kernel.outputs]])

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = list(state.get[0]) if state.exists else kernel.start()
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")[[f.name for f in fields]]
        found = [kernel.step(own, float(v)) for v in rows[value]]
        state.update((own,))
        for i, c in enumerate(kernel.outputs):
            rows[c] = [f[i] for f in found]
        yield rows

    return stream.groupBy(*keys).applyInPandasWithState(apply, out, "s array<double>", "append", GroupStateTimeout.NoTimeout)


def event_time_bars(stream: DataFrame, keys: list[str], ts: str, value: str, every: str, late: str) -> DataFrame:
    """OHLC bars by event time; rows later than the watermark are left out. A window is given once it can't change."""
    at = F.struct(ts, value)
    d = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, every).alias("w"))
    d = d.agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("n"))
    return d.select(*keys, F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """Sessions of each key: start, end, number of rows; for streams give a watermark first."""
    d = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return d.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a bounded stream gives, run to its end in micro-batches and written to the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
