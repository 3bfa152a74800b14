"""Joins: folds of equi-joins, as-of, range and membership joins. Equi-joins leave the strategy to the optimizer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOW = {"semi": "left_semi", "anti": "left_anti", "full": "full_outer", "outer": "full_outer"}


def join_sources(df: DataFrame, sources: dict[str, DataFrame], steps: list[dict]) -> DataFrame:
    """Joins named sources one after the other: ``{"source", "on", "how", "suffix"}``. Columns that clash get the
    suffix on the right side."""

    def step(left: DataFrame, s: dict) -> DataFrame:
        if s["source"] not in sources:
            raise KeyError(f"source {s['source']} is not registered")
        on, how, right = s.get("on", []), s.get("how", "left"), sources[s["source"]]
        clash = {c: c + s.get("suffix", "_right") for c in right.columns if c in left.columns and c not in on}
        right = right.withColumnsRenamed(clash)
        return left.crossJoin(right) if how == "cross" else left.join(right, on, HOW.get(how, how))

    return reduce(step, steps, df)


def left_join_actions(panel: DataFrame, actions: DataFrame, prefix: str, event_date: str, columns: list[str], symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Actions of the same symbol and date, prefixed; several actions on a day give several rows."""
    right = actions.select(F.col(symbol), F.col(event_date).alias(date), *[F.col(c).alias(prefix + c) for c in columns])
    return panel.join(right, [symbol, date], "left")


def left_join_first(df: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join with one row per key on the right, the first by its columns, so no row of ``df`` is doubled."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*columns))
    return df.join(right.select(*keys, *columns).withColumn("__n", nth).filter("__n = 1").drop("__n"), keys, "left")


def merge_sources(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left merge of all sources onto the first; a column that is there already gets the source's name as prefix, and
    ``provenance`` lists the sources that had a row."""
    out, names = None, list(sources)
    for name in names:
        part = sources[name]
        if out is None:
            out = part.withColumn(f"__has_{name}", F.lit(True))
            continue
        part = part.withColumnsRenamed({c: f"{name}_{c}" for c in part.columns if c in out.columns and c not in keys}).withColumn(f"__has_{name}", F.lit(True))
        out = out.join(part, keys, "left")
    marks = F.filter(F.array(*[F.when(F.col(f"__has_{n}"), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return out.withColumn("provenance", F.array_join(marks, ",")).drop(*[f"__has_{n}" for n in names])


def collision_delta(left: DataFrame, right: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """n_shared, max_delta of a column that both sides have."""
    both = left.select(*keys, F.col(column).alias("__a")).join(right.select(*keys, F.col(column).alias("__b")), keys)
    return both.agg(F.count("*").alias("n_shared"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_delta"))


@dataclass(frozen=True)
class FieldPolicy:
    """How an as-of query fills a field: the latest known value within ``ttl_days``, or only that of the anchor row."""

    ttl_days: int = 30
    forward: bool = True
    fail_on_missing: bool = False


def policy_for(field: str, policies: dict[str, FieldPolicy]) -> FieldPolicy:
    """Exact name, then ``namespace.*``, then glob, then ``default``."""
    from fnmatch import fnmatch

    if field in policies:
        return policies[field]
    if "." in field and (name := field.split(".")[0] + ".*") in policies:
        return policies[name]
    return next((p for k, p in policies.items() if "*" in k and fnmatch(field, k)), policies.get("default", FieldPolicy()))


def as_of(store: DataFrame, when, fields: list[str], policies: dict[str, FieldPolicy] | None = None, symbol: str = "symbol") -> DataFrame:
    """What was known at ``when`` (a date): one row a symbol with the anchor's valid_time, knowledge_time = ``when`` and
    the fields. Rows are visible if valid and known by then; the anchor is the latest by (valid, knowledge). One
    aggregation, with partial results before the shuffle."""
    t = F.lit(when).cast("date")
    seen = store.filter((F.col("valid_time") <= t) & (F.col("knowledge_time") <= t))
    at = F.struct("valid_time", "knowledge_time")
    aggregates = [F.max(at).alias("__anchor")]
    for f in fields:
        aggregates += [F.max_by(F.struct(F.col(f).alias("v"), F.col("knowledge_time").alias("k")), at).alias(f"__last_{f}"), F.max_by(F.struct(F.col(f).alias("v"), F.col("knowledge_time").alias("k")), F.when(F.col(f).isNotNull(), at)).alias(f"__known_{f}")]
    rows = seen.groupBy(symbol).agg(*aggregates)
    out = [F.col(symbol), F.col("__anchor.valid_time").alias("valid_time"), t.alias("knowledge_time")]
    for f in fields:
        p = policy_for(f, policies or {})
        x = F.col(f"__known_{f}") if p.forward else F.col(f"__last_{f}")
        value = F.when(F.datediff(t, x["k"]) <= p.ttl_days, x["v"])
        if p.fail_on_missing:
            value = F.coalesce(value, F.raise_error(F.concat(F.lit(f"{f} is missing for "), F.col(symbol).cast("string"))).cast(dict(store.dtypes)[f]))
        out.append(value.alias(f))
    return rows.select(*out)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, values: list[str], ttl_days: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its keys that is not later. Both sides are united, ordered once per
    key, and the last right value is carried forward, so rows are never multiplied."""
    a = left.withColumns({"__side": F.lit(1), "__t": F.col(time), "__v": F.lit(None).cast(right.select(F.struct(right_time, *values).alias("x")).schema["x"].dataType)})
    b = right.select(*keys, F.lit(0).alias("__side"), F.col(right_time).alias("__t"), F.struct(right_time, *values).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    fresh = F.lit(True) if ttl_days is None else F.datediff("__t", F.col("__v")[right_time]) <= ttl_days
    return out.select(*left.columns, F.when(fresh, F.col("__v")[right_time]).alias(f"{right_time}_matched"), *[F.when(fresh, F.col("__v")[v]).alias(v) for v in values])


def as_of_wide(store: DataFrame, dates: DataFrame, symbols: list, field: str, ttl_days: int = 30, symbol: str = "symbol") -> DataFrame:
    """One row a date of ``dates`` (column date) with ``<symbol>_<field>`` for each of a list of symbols."""
    own = store.filter(F.col(symbol).isin(symbols) & F.col(field).isNotNull())
    known = own.select(symbol, F.greatest("valid_time", "knowledge_time").alias("seen"), "valid_time", "knowledge_time", field)
    grid = dates.select("date", F.explode(F.array(*[F.lit(s) for s in symbols])).alias(symbol))
    # the best row seen so far is a running maximum over the order of becoming visible
    rows = known.select(symbol, F.col("seen").alias("__t"), F.lit(0).alias("__side"), F.struct("valid_time", "knowledge_time", F.col(field).alias("v")).alias("__x")).unionByName(grid.select(symbol, F.col("date").alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__x")))
    w = Window.partitionBy(symbol).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__x", F.max("__x").over(w)).filter("__side = 1")
    value = F.when(F.datediff("__t", F.col("__x.knowledge_time")) <= ttl_days, F.col("__x.v"))
    wide = rows.select(F.col("__t").alias("date"), F.concat(F.col(symbol).cast("string"), F.lit(f"_{field}")).alias("name"), value.alias("value"))
    return wide.groupBy("date").pivot("name", [f"{s}_{field}" for s in symbols]).agg(F.first("value", ignorenulls=True))


def members_as_of(events: DataFrame, when, symbol: str = "symbol", date: str = "date", kind: str = "event") -> DataFrame:
    """Symbols listed at a date by the latest event up to it; on the same day a delisting wins."""
    last = events.filter(F.col(date) <= F.lit(when).cast("date")).groupBy(symbol).agg(F.max_by(kind, F.struct(F.col(date), (F.col(kind) == "delist").cast("int"))).alias("last"))
    return last.filter("last = 'list'").select(symbol)


def future_action_factor(bars: DataFrame, actions: DataFrame, factor: str = "factor", symbol: str = "symbol", date: str = "date", event_date: str = "event_date", out: str = "cumulative_factor") -> DataFrame:
    """For each bar the product of the factors of its symbol's later actions. Bars and actions are united and the
    product runs backwards in time, instead of joining every bar with every action."""
    own = [c for c in bars.columns if c not in (symbol, date)]
    rows = bars.select(symbol, F.col(date).alias("__t"), F.lit(1).alias("__side"), F.lit(1.0).alias("__f"), F.struct(*own).alias("__row"))
    acts = actions.select(symbol, F.col(event_date).alias("__t"), F.lit(0).alias("__side"), F.coalesce(F.col(factor).cast("double"), F.lit(1.0)).alias("__f"), F.lit(None).alias("__row"))
    # strictly later: going back in time, a day's bars come before its actions
    w = Window.partitionBy(symbol).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(acts).withColumn(out, F.product("__f").over(w)).filter("__side = 1")
    return both.select(symbol, F.col("__t").alias(date), *[F.col("__row")[c].alias(c) for c in own], out)


def same_day_flag(bars: DataFrame, actions: DataFrame, name: str, symbol: str = "symbol", date: str = "date", event_date: str = "event_date") -> DataFrame:
    days = actions.select(symbol, F.col(event_date).alias(date)).distinct().withColumn(name, F.lit(True))
    return bars.join(days, [symbol, date], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def residuals(predictions: DataFrame, panel: DataFrame, target: str, keys: list[str]) -> DataFrame:
    return predictions.join(panel.select(*keys, F.col(target).alias("realised")), keys).withColumn("residual", F.col("prediction") - F.col("realised"))


def policy_splits(df: DataFrame) -> DataFrame:
    """If all rows say test, the last fold is test and the others train."""
    row = df.agg(F.max("fold_id").alias("__last"), F.coalesce(F.min((F.col("split") == "test").cast("int")), F.lit(0)).alias("__all"))
    return df.crossJoin(F.broadcast(row)).withColumn("split", F.when(F.col("__all") == 1, F.when(F.col("fold_id") == F.col("__last"), "test").otherwise("train")).otherwise(F.col("split"))).drop("__last", "__all")  # one row


def in_ranges(df: DataFrame, at: Column | str, ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with each of a few half-open ranges they lie in; ``ranges`` must be a small table built on the driver."""
    at = F.col(at) if isinstance(at, str) else at
    return df.join(F.broadcast(ranges), (at >= ranges[start]) & (at < ranges[end]))
