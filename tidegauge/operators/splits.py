"""Plans of training and test rows over time.

Row positions are counted from the numbers of rows per time, and these by ranges of times, so no task orders the whole
frame. Fold bounds are few literals; each row finds its folds by itself.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_total


def positions(df: DataFrame, time: str, tie: list[str], out: str = "pos") -> DataFrame:
    """0-based place of each row in the order of time and ``tie``."""
    counts = df.groupBy(time).agg(F.count("*").alias("__n"))
    before = running_total(counts, [], time, "__n", "__b")
    within = F.row_number().over(Window.partitionBy(time).orderBy(*tie))
    return df.withColumn("__w", within).join(before.drop("__n"), time).withColumn(out, F.coalesce("__b", F.lit(0)) + F.col("__w") - 1).drop("__w", "__b")


def _times_at(df: DataFrame, time: str, places: list[int]) -> dict[int, object]:
    return {r["pos"]: r[time] for r in df.filter(F.col("pos").isin(places)).select("pos", time).collect()}


def _assign(df: DataFrame, rules: list[tuple[int, str, str]]) -> DataFrame:
    """A row for each (fold, role) whose condition (SQL) holds."""
    found = F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(f).alias("fold"), F.lit(r).alias("role"))) for f, r, c in rules]), lambda x: x.isNotNull())
    return df.withColumn("__f", F.explode(found)).select(*df.columns, "__f.fold", "__f.role")


def _lit(t) -> str:
    return f"TIMESTAMP_NTZ '{t}'" if isinstance(t, datetime) else f"DATE '{t}'"


def walk_forward(df: DataFrame, time: str, tie: list[str], n_splits: int = 5, test_size: int = 252, min_train: int = 504, purge_days: int = 5) -> DataFrame:
    """Expanding training rows, test blocks of fixed size from the end; training ends ``purge_days`` before the test.
    One row per row and fold it belongs to, with ``fold`` and ``role``."""
    p = positions(df, time, tie)
    n = df.count()
    if n < min_train + n_splits * test_size:
        raise ValueError(f"{n} rows, at least {min_train + n_splits * test_size} are needed")
    starts = [n - (n_splits - f) * test_size for f in range(n_splits)]
    at = _times_at(p, time, starts)
    rules = []
    for f, s in enumerate(starts):
        limit = f" AND {time} <= {_lit(at[s] - timedelta(days=purge_days))}" if purge_days > 0 else ""
        rules += [(f, "train", f"pos < {s}{limit}"), (f, "test", f"pos >= {s} AND pos < {s + test_size}")]
    return _assign(p, rules)


def purged_kfold(df: DataFrame, time: str, tie: list[str], n_splits: int = 5, purge_days: int = 5, embargo_days: int = 3) -> DataFrame:
    """Contiguous folds (the last takes what is left over); training leaves out the time from ``purge_days`` before to
    ``embargo_days`` after the test."""
    p = positions(df, time, tie)
    n = df.count()
    size = n // n_splits
    if size < 1:
        raise ValueError(f"{n} rows for {n_splits} folds")
    ends = [(f * size, (f + 1) * size if f < n_splits - 1 else n) for f in range(n_splits)]
    at = _times_at(p, time, [x for a, z in ends for x in (a, z - 1)])
    rules = []
    for f, (a, z) in enumerate(ends):
        lo, hi = _lit(at[a] - timedelta(days=purge_days)), _lit(at[z - 1] + timedelta(days=embargo_days))
        rules += [(f, "train", f"(pos < {a} OR pos >= {z}) AND ({time} < {lo} OR {time} > {hi})"), (f, "test", f"pos >= {a} AND pos < {z}")]
    return _assign(p, rules)


def cpcv(df: DataFrame, time: str, tie: list[str], n_groups: int = 6, n_test: int = 2, purge: int = 0, embargo: int = 0) -> DataFrame:
    """All combinations of test groups. Rows near training groups go from the test side (``purge`` before one, ``embargo``
    after one); training rows stay as they are."""
    p = positions(df, time, tie)
    n = df.count()
    cuts = [n * i // n_groups for i in range(n_groups + 1)]
    rules = []
    for f, test in enumerate(combinations(range(n_groups), n_test)):
        inside = " OR ".join(f"pos >= {cuts[g]} AND pos < {cuts[g + 1]}" for g in test)
        kept = " OR ".join(f"pos >= {cuts[g] + (embargo if g and g - 1 not in test else 0)} AND pos < {cuts[g + 1] - (purge if g + 1 < n_groups and g + 1 not in test else 0)}" for g in test)
        rules += [(f, "train", f"NOT ({inside})"), (f, "test", kept)]
    return _assign(p, rules)


def forward_cpcv(df: DataFrame, time: str, tie: list[str], n_splits: int, n_test: int, embargo: int) -> DataFrame:
    """Combinations of test folds whose training ends ``embargo`` rows before the first test row (rows beyond
    n_splits whole folds are left out)."""
    p = positions(df, time, tie)
    size = df.count() // n_splits
    rules = []
    for f, test in enumerate(combinations(range(n_splits), n_test)):
        inside = " OR ".join(f"pos >= {g * size} AND pos < {(g + 1) * size}" for g in test)
        rules += [(f, "train", f"NOT ({inside}) AND pos < {min(test) * size - embargo}"), (f, "test", inside)]
    return _assign(p, rules)


def purged_forward(df: DataFrame, time: str, tie: list[str], n_splits: int, embargo: int) -> DataFrame:
    """Equal folds in order of time; training is all rows before the test less an embargo."""
    p = positions(df, time, tie)
    size = df.count() // n_splits
    return _assign(p, [x for f in range(n_splits) for x in ((f, "train", f"pos < {f * size - embargo}"), (f, "test", f"pos >= {f * size} AND pos < {(f + 1) * size}"))])


def n_combinations(n_groups: int, n_test: int) -> int:
    return comb(n_groups, n_test)


def walk_forward_dates(df: DataFrame, date: str = "date", n_folds: int = 3, horizon: int = 0) -> DataFrame:
    """Fold bounds on ordinals of the distinct dates: fold, train_end, test_start, test_end (half open), horizon dates
    purged. One row a fold."""
    n = df.select(date).distinct().count()
    folds = max(1, n - 1) if n < n_folds + 1 else n_folds
    size = max(1, n // (folds + 1))
    rows = [(f"fold_{i}", max(0, size * (i + 1) - horizon), size * (i + 1), min(size * (i + 2), n)) for i in range(folds if n > 1 else 0) if size * (i + 1) < n]
    return df.sparkSession.createDataFrame(rows, "fold string, train_end long, test_start long, test_end long")


def walk_forward_calendar(start: datetime, end: datetime, n_splits: int, embargo: timedelta) -> list[dict]:
    """Equal slices of time: training grows, the test follows after the embargo, clipped at the end."""
    width, out = (end - start) / n_splits, []
    for i in range(n_splits):
        a = start + width * (i + 1) + embargo
        z = min(a + width, end)
        if a >= z:
            break
        out.append({"fold": i, "train_start": start, "train_end": start + width * (i + 1), "test_start": a, "test_end": z})
    return out


def regime_splits(df: DataFrame, time: str, segments: list[tuple[str, str, str]]) -> DataFrame:
    """Rows with the regime of the first half-open segment (regime, start, end) that holds them."""
    out = None
    for regime, a, z in segments:
        cond = (F.col(time) >= F.lit(a).cast("timestamp")) & (F.col(time) < F.lit(z).cast("timestamp"))
        out = F.when(cond, regime) if out is None else out.when(cond, regime)
    return df.withColumn("regime", out).filter("regime IS NOT NULL")


def project_regime(folds: DataFrame, segments: DataFrame) -> DataFrame:
    """Per fold (fold, start, end) the regime (regime, start, end) with the largest overlap in total, else unknown;
    ``segments`` must be a small table built on the driver."""
    s = F.broadcast(segments.select("regime", F.col("start").alias("s"), F.col("end").alias("e")))
    seconds = F.greatest(F.unix_timestamp(F.least("end", "e").cast("timestamp")) - F.unix_timestamp(F.greatest("start", "s").cast("timestamp")), F.lit(0))
    both = folds.join(s, (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left").groupBy("fold", "regime").agg(F.sum(seconds).alias("overlap"))
    best = both.groupBy("fold").agg(F.max_by("regime", F.struct(F.coalesce("overlap", F.lit(0)), "regime")).alias("regime"))
    return best.select("fold", F.coalesce("regime", F.lit("unknown")).alias("regime"))


def backtest_split(df: DataFrame, ratio: float = 0.7) -> DataFrame:
    """A constant column with the first row of the test part."""
    row = df.agg(F.floor(F.count("*") * ratio).cast("long").alias("bt_split_idx"))
    return df.crossJoin(F.broadcast(row))  # one row


def manifest(assigned: DataFrame, time: str) -> str:
    """JSON of each fold's bounds and counts."""
    rows = assigned.groupBy("fold", "role").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).orderBy("fold", "role").collect()
    return json.dumps([{**r.asDict(), "start": str(r["start"]), "end": str(r["end"])} for r in rows])
