"""From a configuration to materialised features, and from a strategy to a report, as one lazy plan each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import frame_hash
from ..operators import aggregates, filters, rolling, stats
from ..operators.columns import normalize_market_columns
from ..sources import readers
from .graph import Plan, compile_plan, run_cleaning
from ..sources.shared import once


@dataclass(frozen=True)
class Config:
    """``source``: a path, or a name of a registered source with its arguments; ``cleaning``: steps with parameters;
    ``plan``: features; ``contract``: what the source must hold; ``output``: where the product goes."""

    source: str | tuple[str, dict]
    keys: list[str]
    order: list[str]
    cleaning: list[tuple[str, dict]] = field(default_factory=list)
    plan: Plan | None = None
    contract: filters.FrameContract = filters.FrameContract()
    normalize: bool = False
    output: str | None = None


def merge(base: dict, over: dict) -> dict:
    """Deep merge of two configurations; the second wins."""
    return {**base, **{k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def fetch(spark: SparkSession, source: str | tuple[str, dict]) -> DataFrame:
    if isinstance(source, str):
        return readers.read_path(spark, source)
    name, args = source
    if name not in readers.SOURCES:
        raise readers.SourceError(f"no source {name}")
    return readers.SOURCES[name](**args) if name in ("composite", "failover") else readers.SOURCES[name](spark, **args)


def run_dataprep(spark: SparkSession, config: Config) -> tuple[DataFrame, dict]:
    """Fetches, checks, cleans, adds features and, with an output, writes Parquet and its manifest."""
    raw = config.contract.check(fetch(spark, config.source))
    df = normalize_market_columns(raw) if config.normalize else raw
    with_series = [(n, {"keys": config.keys, **({"order": config.order} if n in ("missing", "outliers", "denoise") else {}), **p}) for n, p in config.cleaning]
    df = run_cleaning(df, with_series)
    df = compile_plan(df, config.plan) if config.plan else df
    if not config.output:
        return df, {"columns": df.columns}
    manifest = readers.write_panel(df, config.output) | {"source_hash": frame_hash(raw).first()["xor"], "steps": [n for n, _ in config.cleaning]}
    readers.write_manifest(spark, manifest, f"{config.output}_manifest")
    return spark.read.parquet(config.output), manifest


def run_backtest(df: DataFrame, keys: list[str], order: str, price: str = "close", fast: int = 5, slow: int = 20, point_in_time: bool = True, n_trials: int = 1) -> tuple[DataFrame, DataFrame]:
    """Crossover of two means: performance per series, and the statistical report of its returns. Input that is not
    stamped with when it was known is refused unless ``point_in_time`` is off."""
    if point_in_time and "knowledge_time" not in df.columns:
        raise filters.QualityError("the input has no knowledge_time")
    seen = df.filter("knowledge_time <= valid_time OR valid_time IS NULL") if point_in_time and "valid_time" in df.columns else df
    w = rolling.series(keys, [order])
    s = seen.select(*keys, order, rolling.pct_change(price, w).alias("ret"), F.when(rolling.rolling_mean(price, w, fast) > rolling.rolling_mean(price, w, slow), 1).otherwise(-1).alias("signal"))
    s = s.withColumn("strategy_return", F.lag("signal").over(w) * F.col("ret"))
    return aggregates.performance(s, "strategy_return", order, keys, "signal"), stats.validity(s, "strategy_return", keys, n_trials)


def stage_checkpoint(df: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """An intermediate frame, written so that later stages start from it: a table under ``root``, else a reliable
    checkpoint in the folder that the cluster names."""
    if root:
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{label}")
        return df.sparkSession.read.parquet(f"{root.rstrip('/')}/{label}")
    return once(df)
