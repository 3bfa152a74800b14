"""Projections, casts and column transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .ordering import codes

#: Fixed names: cast targets and the Spark type that holds them (unsigned ones need the next wider signed type).
NUMERIC = {"float32": "float", "float64": "double", "int16": "smallint", "int32": "int", "int64": "bigint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)"}
UNSIGNED_MAX = {"uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
#: Fixed: signed types from narrow to wide, with the bound that their values stay below.
SIGNED_BOUND = {"smallint": 2**15, "int": 2**31, "bigint": 2**63}
FLOAT32_MAX = 3.4028234663852886e38
#: Fixed names that market columns come under.
MARKET_ALIASES = {"date": "timestamp", "datetime": "timestamp", "time": "timestamp", "close": "price", "last": "price", "value": "price"}
TICKER_NAMES = ["ticker", "symbol", "instrument", "asset", "security", "ric", "isin"]
DAILY = ["1d", "d", "1day", "day", "daily"]


def _need(df: DataFrame, names) -> None:
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    _need(df, names)
    return df.withColumnsRenamed(names)


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Strict: a value that cannot be cast ends the query (ANSI mode)."""
    _need(df, kinds)
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def cast_numeric(df: DataFrame, columns: list[str], kind: str = "float32", widen: bool = False) -> DataFrame:
    """Casts to a named numeric type; an unknown name means float32. Unsigned types take 0 up to their maximum only;
    other values become null. A value that a signed type cannot hold ends the query (ANSI mode).

    With ``widen`` a cast of numbers to integers (not uint64) neither ends the query nor makes nulls: each column takes
    the narrowest signed type, from the one that holds ``kind`` on, that holds all its values, and stays as it is if
    none does. For that its least and greatest value are read first, in one pass and as one row."""
    _need(df, columns)
    target = NUMERIC.get(kind, "float")
    if widen and target in SIGNED_BOUND:
        numbers = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, NumericType)]
        kinds = _holding(df, numbers, target) if numbers else {}
        df, columns = df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if k}), [c for c in columns if c not in kinds]
    if kind in UNSIGNED_MAX:
        within = lambda c: F.col(c).cast("decimal(38,0)").between(0, F.lit(UNSIGNED_MAX[kind]).cast("decimal(38,0)"))
        return df.withColumns({c: F.when(within(c), F.col(c).cast(target)) for c in columns})
    return df.withColumns({c: F.col(c).cast(target) for c in columns})


def _holding(df: DataFrame, columns: list[str], target: str) -> dict[str, str | None]:
    """The narrowest signed type, from ``target`` on, that holds all values of a column less their fractions, or None
    (also for NaN, which counts as greatest)."""
    ends = df.agg(*[x(c) for c in columns for x in (F.min, F.max)]).first()
    kinds = list(SIGNED_BOUND)[list(SIGNED_BOUND).index(target) :]
    holds = lambda k, low, high: low is None or (-SIGNED_BOUND[k] - 1 < low and high < SIGNED_BOUND[k])
    return {c: next((k for k in kinds if holds(k, low, high)), None) for c, low, high in zip(columns, ends[::2], ends[1::2])}


def promote_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<c>_code``, the 0-based rank of each distinct value; null has no code. The column itself stays a string:
    dictionaries are the file format's business."""
    for c in columns:
        df = df.join(codes(df, c, f"{c}_code"), c, "left")
    return df


def normalize_market_columns(df: DataFrame) -> DataFrame:
    """Renames the usual names (any case) of time and price, the first that occurs, and parses times, leaving null
    what is none."""
    low = {c.lower(): c for c in reversed(df.columns)}
    renames = {}
    for alias, name in MARKET_ALIASES.items():
        if alias in low and name not in low and name not in renames.values():
            renames[low[alias]] = name
    df = df.withColumnsRenamed(renames)
    if dict(df.dtypes).get("timestamp") == "string":
        df = df.withColumn("timestamp", parse_time("timestamp"))
    return df


def parse_time(name: str) -> Column:
    """The first of three formats that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.col(name), F.lit(f)) for f in ("MM/dd/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")])


def ensure_datetime(df: DataFrame, name: str = "date") -> DataFrame:
    """A timestamp column; a value that is none ends the query."""
    _need(df, [name])
    kind = dict(df.dtypes)[name]
    return df if kind.startswith(("timestamp", "date")) else df.withColumn(name, F.to_timestamp(name))


def infer_ticker_column(df: DataFrame) -> str | None:
    low = {c.lower(): c for c in reversed(df.columns)}
    return next((low[x] for x in TICKER_NAMES if x in low), None)


def normalize_keys(df: DataFrame, interval: str = "1d") -> DataFrame:
    """date as ISO text, instrument as text, the names of the daily interval as ``interval``; a missing or null
    interval becomes ``interval``."""
    df = df.withColumn("date", F.date_format(F.col("date").cast("timestamp"), "yyyy-MM-dd")).withColumn("instrument", F.col("instrument").cast("string"))
    own = F.col("interval").cast("string") if "interval" in df.columns else F.lit(None).cast("string")
    clean = F.lower(F.trim(own))
    return df.withColumn("interval", F.when(clean.isin(DAILY) | own.isNull() | (clean == ""), interval).otherwise(own))


def narrow_float32(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clips doubles to the range of float32, then narrows."""
    lim = F.lit(FLOAT32_MAX)
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), lim), -lim)).cast("float") for c in columns})


def select_feature_columns(df: DataFrame, whitelist: list[str] | None = None) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(("state_", "cand_", "macro_")) and (whitelist is None or c in whitelist))


def normalize(df: DataFrame, column: str, mean: float | None = None, std: float | None = None) -> DataFrame:
    """``<c>_norm`` = (x - mean) / sample deviation, over all rows where not given. The statistics are one row, joined
    back by broadcast."""
    if mean is None or std is None:
        row = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
        df = df.crossJoin(F.broadcast(row))  # one row
        m, s = (F.lit(mean) if mean is not None else F.col("__m")), (F.lit(std) if std is not None else F.col("__s"))
        return df.withColumn(f"{column}_norm", F.try_divide(F.col(column) - m, s)).drop("__m", "__s")
    return df.withColumn(f"{column}_norm", F.try_divide(F.col(column) - F.lit(mean), F.lit(std)))


def log_transform(df: DataFrame, column: str, base: float = 10.0, eps: float = 1e-12) -> DataFrame:
    return df.withColumn(f"{column}_log", F.log(base, F.when(F.col(column).isNotNull(), F.greatest(F.col(column), F.lit(eps)))))


def minmax_scale(df: DataFrame, column: str, low: float | None = None, high: float | None = None, eps: float = 1e-12) -> DataFrame:
    row = df.agg(F.min(column).cast("double").alias("__a"), F.max(column).cast("double").alias("__z"))
    a, z = (F.lit(low) if low is not None else F.col("__a")), (F.lit(high) if high is not None else F.col("__z"))
    width = F.when(z - a != 0, z - a).otherwise(eps)
    return df.crossJoin(F.broadcast(row)).withColumn(f"{column}_scaled", (F.col(column) - a) / width).drop("__a", "__z")  # one row


def safe_div(a: str, b: str, eps: float = 1e-12, additive: bool = False) -> Column:
    """a / max(b, eps), or a / (b + eps)."""
    divisor = F.col(b) + eps if additive else F.when(F.col(b).isNotNull(), F.greatest(F.col(b), F.lit(eps)))
    return F.try_divide(F.col(a), divisor)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all float columns become null, as every source does on ingest."""
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, k in df.dtypes if k in ("float", "double")})
