"""Predicates and gates on data quality. Checks of names and types look at the schema and start no job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLCV = ["open", "high", "low", "close", "volume"]
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
#: Fixed name parts that reveal what is only known afterwards.
LEAKAGE_PATTERNS = ("forward_", "future_", "label", "target", "oracle", "utility", "delta_vs", "realized_return", "next_")


class QualityError(ValueError):
    """A frame does not keep its contract."""


def regulatory_filter(df: DataFrame, restricted: list, least_volume: float, symbol: str = "symbol", volume: str = "volume") -> DataFrame:
    """Rows of no restricted symbol with enough volume; a null symbol is dropped."""
    return df.filter((~F.col(symbol).isin(restricted) if restricted else F.col(symbol).isNotNull()) & (F.col(volume) >= least_volume))


def valid_price_volume(price: str = "raw_close", volume: str = "raw_volume", adjusted: str = "adj_close") -> Column:
    return (F.col(price) > 0) & (F.col(volume) > 0) & (F.col(adjusted) > 0)


def exclude_instruments(df: DataFrame, excluded: list, column: str = "instrument") -> DataFrame:
    return df.filter(~F.col(column).isin(excluded)) if excluded else df


def hygiene_label(label: str, adjusted: str, raw: str, ret: str, least: float = 1e-6, ratio: tuple[float, float] = (0.01, 100.0), most: float = 1.0) -> Column:
    """The label, or null where prices or returns are implausible or unknown."""
    q = F.try_divide(F.col(adjusted), F.col(raw))
    good = (F.col(adjusted) > least) & q.between(*ratio) & (F.abs(F.col(label)) <= most) & (F.abs(F.col(ret)) <= most)
    return F.when(F.coalesce(good, F.lit(False)), F.col(label))


def validate_frame(df: DataFrame, ohlcv: bool = False, strict: bool = True) -> list[str]:
    """Problems of a frame: no rows, OHLCV columns missing, negative prices. Strict raises."""
    problems = [f"missing column {c}" for c in OHLCV if ohlcv and c not in df.columns]
    prices = [c for c in OHLCV[:4] if c in df.columns]
    row = df.agg(F.count("*").alias("n"), *[F.coalesce(F.max(F.when(F.col(c) < 0, 1)), F.lit(0)).alias(c) for c in prices]).first()
    problems += ["no rows"] * (row["n"] == 0) + [f"negative {c}" for c in prices if row[c]]
    if problems and strict:
        raise QualityError("; ".join(problems))
    return problems


@dataclass(frozen=True)
class FrameContract:
    """Columns a step takes or gives, with their types (None: any); ``strict``: optional ones too must have theirs;
    ``unknown_ok``: others may be there."""

    required: dict[str, str | None] = field(default_factory=dict)
    optional: dict[str, str | None] = field(default_factory=dict)
    unknown_ok: bool = True

    def problems(self, df: DataFrame) -> list[str]:
        own = dict(df.dtypes)
        out = [f"missing column {c}" for c in self.required if c not in own]
        out += [f"{c} is {own[c]}, not {k}" for c, k in {**self.optional, **self.required}.items() if c in own and k is not None and own[c] != k]
        if not self.unknown_ok:
            out += [f"unknown column {c}" for c in own if c not in self.required and c not in self.optional]
        return out

    def check(self, df: DataFrame) -> DataFrame:
        if found := self.problems(df):
            raise QualityError("; ".join(found))
        return df


def validate_ohlcv(df: DataFrame) -> list[str]:
    own = {c.lower(): k for c, k in df.dtypes}
    return [f"missing column {c}" for c in OHLCV if c not in own] + [f"{c} is not numeric" for c in OHLCV if c in own and not own[c].startswith(NUMERIC)]


def validate_for_training(df: DataFrame, target: str, features: list[str]) -> list[str]:
    """Missing columns, and columns that are not numeric or hold nothing."""
    own = dict(df.dtypes)
    out = [f"missing column {c}" for c in [target, *features] if c not in own] + [f"{c} is not numeric" for c in features if c in own and not own[c].startswith(NUMERIC)]
    have = [c for c in [target, *features] if c in own]
    row = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in have]).first()
    return out + ["no rows"] * (row["__n"] == 0) + [f"{c} is empty" for c in have if row["__n"] and not row[c]]


def ks_drift(df: DataFrame, reference: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test per column: column, statistic, p_value, drift. Counts of equal values are
    aggregated first; a column's distinct values are ordered by range, not in one task."""
    parts = [(df, 1), (reference, 0)]
    long = None
    for frame, side in parts:
        stacked = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.column", "s.x", F.lit(side).alias("side")).filter("x IS NOT NULL")
        long = stacked if long is None else long.unionByName(stacked)
    values = long.groupBy("column", "x").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"))
    w = Window.partitionBy("column").orderBy("x")
    whole = Window.partitionBy("column")
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(whole) - F.sum("b").over(w) / F.sum("b").over(whole))
    found = values.select("column", "a", "b", gap.alias("gap")).groupBy("column").agg(F.max("gap").alias("statistic"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    z = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m"))) * F.col("statistic")
    p = 2 * sum(((-1) ** (k - 1) * F.exp(-2.0 * k * k * z * z) for k in range(1, 101)), F.lit(0.0))
    found = found.withColumn("p_value", F.when(z < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))
    return found.select("column", "statistic", "p_value", (F.col("p_value") < threshold).alias("drift"))


def validate_file(path: str, kind: str | None = None, max_bytes: int = 100 * 1024 * 1024, spark=None) -> None:
    """The format must be csv, parquet or json and the file within the limit; the size is asked of the file system
    that the path names."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "parquet", "json"):
        raise QualityError(f"format {kind} is not supported")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    if size > max_bytes:
        raise QualityError(f"{path} has {size} bytes, more than {max_bytes}")


def forbid_columns(df: DataFrame, personal: list[str]) -> DataFrame:
    found = [c for c in df.columns if c in personal]
    if found:
        raise QualityError(f"personal data in columns {found}")
    return df


def forbidden_features(columns: list[str], patterns: tuple[str, ...] = LEAKAGE_PATTERNS) -> list[str]:
    return [c for c in columns if any(p in c.lower() for p in patterns)]


def classify_columns(df: DataFrame, identity: list[str], split: list[str], target: list[str], blocked: tuple[str, ...] = LEAKAGE_PATTERNS, coverage: float = 0.05) -> dict[str, str]:
    """What each column may be used for, by the first rule that fits; statistics of all columns in one aggregation."""
    out, numeric = {}, []
    for c, k in df.dtypes:
        if c in identity:
            out[c] = "identity"
        elif c in split:
            out[c] = "split"
        elif "oracle" in c:
            out[c] = "oracle"
        elif c in target:
            out[c] = "target"
        elif any(p in c.lower() for p in blocked):
            out[c] = "blocked_name"
        elif not k.startswith(NUMERIC):
            out[c] = "non_numeric"
        else:
            numeric.append(c)
    if numeric:
        row = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(f"n_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]).first()
        for c in numeric:
            out[c] = "low_coverage" if not row["__n"] or row[f"n_{c}"] < coverage * row["__n"] else "constant" if not row[f"s_{c}"] else "eligible"
    return out


def unique_grain(df: DataFrame, keys: list[str], context: str = "frame") -> DataFrame:
    """Raises if a key occurs twice; stops at the first it finds."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise QualityError(f"{context}: {twice[0].asDict()} occurs more than once")
    return df


def grain_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_keys, n_duplicates."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def duplicate_sample(df: DataFrame, keys: list[str], limit: int = 500) -> DataFrame:
    """The first rows, by keys, of those whose keys occur more than once."""
    twice = df.groupBy(*keys).count().filter("count > 1").drop("count")
    return df.join(twice, keys, "left_semi").orderBy(*keys, *[c for c in df.columns if c not in keys]).limit(limit)


def leakage_report(train: DataFrame, test: DataFrame, time: str, keys: list[str], purge_days: int = 0, embargo_days: int = 0) -> DataFrame:
    """shared_keys, train_end, test_start, and whether the order and the gap hold."""
    shared = train.select(*keys).distinct().join(test.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("shared_keys"))
    a = train.agg(F.max(time).alias("train_end"))
    b = test.agg(F.min(time).alias("test_start"))
    out = shared.crossJoin(a).crossJoin(b)  # one row each
    gap = F.datediff("test_start", "train_end")
    return out.select("shared_keys", "train_end", "test_start", (gap > 0).alias("ordered"), (gap > max(purge_days, embargo_days)).alias("gap_kept"), ((F.col("shared_keys") == 0) & (gap > max(purge_days, embargo_days))).alias("clean"))
