"""Aggregations: bars, performance measures, information coefficients, model diversity, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering
from .rolling import average_rank, ratio

YEAR = 252.0
#: Fixed: the functions that a resampling step may name.
RESAMPLE = {"first": F.min_by, "last": F.max_by, "max": lambda c, t: F.max(c), "min": lambda c, t: F.min(c), "sum": lambda c, t: F.sum(c)}


def resample(df: DataFrame, every: str, keys: list[str], ts: str = "ts", tie: str | None = None, how: dict[str, str] | None = None) -> DataFrame:
    """Bars of a fixed width by keys and window start; rows with a null are dropped. ``tie`` orders equal times."""
    how = how or {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    order = F.struct(ts, tie) if tie else F.col(ts)
    out = df.groupBy(*keys, F.window(ts, every).alias("__w")).agg(*[RESAMPLE[f](F.col(c), order).alias(c) for c, f in how.items()])
    return out.select(*keys, F.col("__w.start").alias(ts), *how).dropna()


def performance(df: DataFrame, ret: str, order: str, keys: list[str], signal: str | None = None, ddof: int = 1, year: float = YEAR) -> DataFrame:
    """n, total_return, sharpe, max_drawdown_fraction, win_rate and, with a signal, n_flips of each key's returns."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__nav", F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(f))
    d = d.withColumn("__top", F.greatest(F.max("__nav").over(f), F.lit(1.0)))
    flips = [F.count(F.when(F.col("__prev") != F.col(signal), 1)).alias("n_flips")] if signal else []
    d = d.withColumn("__prev", F.lag(signal).over(w)) if signal else d
    sd = (F.stddev_samp if ddof else F.stddev_pop)(ret)
    return d.groupBy(*keys).agg(
        F.count(ret).alias("n"), (F.max_by("__nav", order) - 1).alias("total_return"), (ratio(F.avg(ret), sd) * year**0.5).alias("sharpe"),
        F.min(ratio(F.col("__nav"), F.col("__top")) - 1).alias("max_drawdown_fraction"), F.avg(F.when(F.col(ret).isNotNull(), (F.col(ret) > 0).cast("double"))).alias("win_rate"), *flips,
    )


def summarize_utility(df: DataFrame, value: str, order: str, keys: list[str], turnover: str | None = None, year: float = YEAR, top: int = 5) -> DataFrame:
    """n, sum and mean utility, Sharpe, max drawdown in log units, mean turnover, share of the best days."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    best = Window.partitionBy(*keys).orderBy(F.desc(value), order)
    d = df.withColumn("__cum", F.sum(value).over(w)).withColumn("__nth", F.row_number().over(best))
    d = d.withColumn("__top", F.greatest(F.max("__cum").over(w), F.lit(0.0)))
    gain = F.greatest(F.col(value), F.lit(0.0))
    return d.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(value).alias("sum_utility"), F.avg(value).alias("mean_utility"), (ratio(F.avg(value), F.stddev_samp(value)) * year**0.5).alias("sharpe"),
        F.max(F.col("__top") - F.col("__cum")).alias("max_drawdown_log"), *([F.avg(turnover).alias("mean_turnover")] if turnover else []),
        F.coalesce(ratio(F.sum(F.when(F.col("__nth") <= top, gain)), F.sum(gain)), F.lit(0.0)).alias("top_share"),
    )


def sum_by_labels(df: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Sums by each label alone, by all of them together and overall, in one pass of grouping sets."""
    sets = [[F.col(x)] for x in labels] + [[F.col(x) for x in labels], []]
    return df.groupingSets(sets, *[F.col(x) for x in labels]).agg(F.sum(value).alias("total"), F.grouping_id().alias("level"))


def top_share(df: DataFrame, instrument: str, value: str, k: int, keys: list[str]) -> DataFrame:
    """Share of the k instruments with the largest absolute sums in the sum of absolute sums."""
    sums = df.groupBy(*keys, instrument).agg(F.abs(F.sum(value)).alias("s"))
    w = Window.partitionBy(*keys).orderBy(F.desc("s"), instrument)
    return sums.withColumn("nth", F.row_number().over(w)).groupBy(*keys).agg(F.coalesce(ratio(F.sum(F.when(F.col("nth") <= k, F.col("s"))), F.sum("s")), F.lit(0.0)).alias("top_share"))


def guarded_corr(x, y, least: int = 3) -> Column:
    """Pearson correlation, 0 with fewer than ``least`` pairs or without variance."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when((F.count(a) >= least) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0), ratio(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))).otherwise(0.0)


def information_coefficients(df: DataFrame, signal: str, target: str, keys: list[str], date: str = "date", least: int = 3) -> DataFrame:
    """Mean over dates of the Spearman correlation of signal and target: mean_ic, n_dates. Dates with fewer pairs or a
    constant side are left out."""
    d = df.filter(F.col(signal).isNotNull() & F.col(target).isNotNull())
    d = average_rank(average_rank(d, signal, [*keys, date], "__a"), target, [*keys, date], "__b")
    by = d.groupBy(*keys, date).agg(F.count("*").alias("n"), F.var_pop("__a").alias("va"), F.var_pop("__b").alias("vb"), F.covar_pop("__a", "__b").alias("c"))
    by = by.filter((F.col("n") >= least) & (F.col("va") > 0) & (F.col("vb") > 0)).withColumn("ic", F.col("c") / F.sqrt(F.col("va") * F.col("vb")))
    return by.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n_dates"))


def indicator_diagnostics(df: DataFrame, indicators: list[str], label: str, date: str = "date", instrument: str = "instrument", split: str = "split") -> DataFrame:
    """Per indicator: orientation (sign of the correlation on train and validation rows), Pearson correlation, hit rate,
    mean oriented utility on train and on test, coverage."""
    long = df.select(date, instrument, split, label, F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("x")) for c in indicators])).alias("s")).select(date, instrument, split, label, "s.*")
    fit = F.col(split).isin("train", "validation")
    both = F.col("x").isNotNull() & F.col(label).isNotNull()
    stats = long.groupBy("indicator").agg(
        guarded_corr(F.when(fit, F.col("x")), F.col(label)).alias("fit_corr"), guarded_corr("x", label).alias("corr"),
        F.avg(F.when(both, (F.signum("x") == F.signum(label)).cast("double"))).alias("hit"), F.avg(F.when(both & fit, F.signum("x") * F.col(label))).alias("u_fit"),
        F.avg(F.when(both & (F.col(split) == "test"), F.signum("x") * F.col(label))).alias("u_test"), F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"),
    )
    o = F.when(F.col("fit_corr") < 0, -1).otherwise(1)
    return stats.select("indicator", o.alias("orientation"), (o * F.col("corr")).alias("ic"), F.when(o < 0, 1 - F.col("hit")).otherwise(F.col("hit")).alias("hit_rate"), (o * F.col("u_fit")).alias("train_utility"), (o * F.col("u_test")).alias("test_utility"), "coverage")


def prune_redundant(df: DataFrame, indicators: list[str], scores: dict[str, float], threshold: float) -> list[str]:
    """Indicators that stay when of each pair over the threshold the lower-scoring one goes; pairs by falling score.
    All correlations come from one aggregation; their number is that of indicator pairs."""
    pairs = [(a, b) for i, a in enumerate(indicators) for b in indicators[i + 1 :]]
    row = df.agg(*[guarded_corr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    kept: list[str] = []
    for c in sorted(indicators, key=lambda c: (-scores.get(c, 0.0), c)):
        if all(abs(row[f"{a}|{b}"]) <= threshold for a, b in pairs if {a, b} <= {c, *kept} and c in (a, b)):
            kept.append(c)
    return [c for c in indicators if c in kept]


def wide_predictions(df: DataFrame, keys: list[str], model: str = "model_id", value: str = "prediction", models: list | None = None) -> DataFrame:
    return df.groupBy(*keys).pivot(model, models).agg(F.avg(value))


def _pairs(df: DataFrame, keys: list[str], model: str, values: list[str]) -> DataFrame:
    """For each pair of models (``model_a`` before ``model_b``) that share keys, their values as ``<v>_a`` and ``<v>_b``.
    A key's models, not its rows, are paired, in the one row that they are gathered into."""
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(model).alias("m"), *[F.col(v).alias(v) for v in values])).alias("__r"))
    of = lambda x, y: F.struct(x["m"].alias("model_a"), y["m"].alias("model_b"), *[z[v].alias(f"{v}_{s}") for z, s in ((x, "a"), (y, "b")) for v in values])
    pairs = F.flatten(F.transform("__r", lambda x: F.transform(F.filter("__r", lambda y: x["m"] < y["m"]), lambda y: of(x, y))))
    return rows.select(*keys, F.explode(pairs).alias("__p")).select(*keys, "__p.*")


def model_pairs(df: DataFrame, keys: list[str], model: str = "model_id", value: str = "prediction") -> DataFrame:
    """n and correlations of each pair of models over shared keys."""
    return _pairs(df, keys, model, [value]).groupBy("model_a", "model_b").agg(F.count("*").alias("n"), guarded_corr(f"{value}_a", f"{value}_b").alias("corr"))


def top_k_overlap(df: DataFrame, k: int, date: str = "date", instrument: str = "instrument", model: str = "model_id", value: str = "prediction") -> DataFrame:
    """Mean over dates of the Jaccard likeness of two models' top-k instruments."""
    w = Window.partitionBy(model, date).orderBy(F.desc(value), instrument)
    top = df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).groupBy(date, model).agg(F.collect_set(instrument).alias("s"))
    return _pairs(top, [date], model, ["s"]).groupBy("model_a", "model_b").agg(F.avg(F.size(F.array_intersect("s_a", "s_b")) / F.size(F.array_union("s_a", "s_b"))).alias("overlap"))


def pooled_rank_correlation(df: DataFrame, signal: str, target: str, keys: list[str]) -> DataFrame:
    """Spearman correlation over all rows of the keys; ranks come from counts of distinct values."""
    d = df.filter(F.col(signal).isNotNull() & F.col(target).isNotNull())
    d = ordering.average_ranks(ordering.average_ranks(d, signal, keys, "__a"), target, keys, "__b")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), guarded_corr("__a", "__b").alias("rank_corr"))


def per_date_diversity(df: DataFrame, k: int, date: str = "date", instrument: str = "instrument", model: str = "model_id", value: str = "prediction") -> DataFrame:
    """Per date the mean over model pairs of Pearson and rank correlation and of the likeness of their top k."""
    d = average_rank(df, value, [date, model], "__r")
    w = Window.partitionBy(date, model).orderBy(F.desc(value), instrument)
    d = d.withColumn("__t", F.row_number().over(w) <= k)
    both = _pairs(d, [date, instrument], model, [value, "__r", "__t"])
    common, any_ = F.count(F.when(F.col("__t_a") & F.col("__t_b"), 1)), F.count(F.when(F.col("__t_a") | F.col("__t_b"), 1))
    pairs = both.groupBy(date, "model_a", "model_b").agg(guarded_corr(f"{value}_a", f"{value}_b").alias("c"), guarded_corr("__r_a", "__r_b").alias("s"), ratio(common.cast("double"), any_.cast("double")).alias("o"))
    return pairs.groupBy(date).agg(F.avg("c").alias("mean_corr"), F.avg("s").alias("mean_rank_corr"), F.avg("o").alias("mean_overlap"))


def redundant_pairs(pairs: DataFrame, corr: float = 0.99, rank: float = 0.99, overlap: float = 0.95) -> DataFrame:
    return pairs.filter((F.abs("corr") >= corr) | (F.abs("rank_corr") >= rank) | (F.col("overlap") >= overlap))


def clusters(models: list[str], pairs: list[tuple[str, str, float]], threshold: float) -> list[list[str]]:
    """Connected groups of models over the threshold; a few tens of models, on the driver."""
    parent = {m: m for m in models}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, v in pairs:
        if abs(v) >= threshold:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    groups: dict[str, list[str]] = {}
    for m in models:
        groups.setdefault(find(m), []).append(m)
    return [sorted(g) for _, g in sorted(groups.items())]


def regime_by_target(df: DataFrame, target: str, date: str = "date", cut: float = 1e-4) -> DataFrame:
    """down, flat or up by the date's mean target; bins close on the right."""
    m = F.avg(target)
    return df.groupBy(date).agg(m.alias("mean_target")).withColumn("regime", F.when(F.col("mean_target") <= -cut, "down").when(F.col("mean_target") <= cut, "flat").when(F.col("mean_target") > cut, "up"))


def cross_section_state(df: DataFrame, ret: str, instrument: str = "instrument", date: str = "date") -> DataFrame:
    """Per date over the previous row's returns: median, breadth above 0, population deviation, count."""
    d = df.withColumn("__r", F.lag(ret).over(Window.partitionBy(instrument).orderBy(date))).filter("__r IS NOT NULL")
    return d.groupBy(date).agg(F.percentile("__r", F.lit(0.5)).alias("median_return"), F.avg((F.col("__r") > 0).cast("double")).alias("breadth"), F.stddev_pop("__r").alias("dispersion"), F.count("*").alias("n"))


QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def quantile_summary(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Exact linear quantiles, extremes and moments by keys."""
    d = df.groupBy(*keys).agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("n"))
    q = ordering.exact_quantiles(df, column, keys, list(QUANTILES.values()))
    d = d.join(q, keys, "left")
    return d.select(*keys, "n", "min", *[F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)], "max", "mean", "std")


def prediction_sanity(df: DataFrame, target: str, keys: list[str], prediction: str = "prediction", extreme: float = 1.0, implausible: float = 1.0) -> DataFrame:
    """Bounded-memory statistics of predictions per model and fold, with sketch quantiles and calibration slope."""
    both = F.col(prediction).isNotNull() & F.col(target).isNotNull()
    return df.groupBy(*keys).agg(
        F.count(prediction).alias("n"), F.avg(prediction).alias("mean"), F.stddev_pop(prediction).alias("std"), F.count(F.when(F.abs(prediction) > extreme, 1)).alias("n_extreme"),
        F.percentile_approx(prediction, 0.5, 10_000).alias("median_sketch"), ratio(F.covar_pop(F.when(both, F.col(prediction)), F.when(both, F.col(target))), F.var_pop(F.when(both, F.col(prediction)))).alias("calibration_slope"),
    ).withColumn("implausible", F.col("std") > implausible)


def fold_target_audit(df: DataFrame, target: str, fold: str = "fold_id", limits: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """By fold n, extremes, exact median and the numbers of targets beyond each limit."""
    d = df.groupBy(fold).agg(F.count(target).alias("n"), F.min(target).alias("min"), F.max(target).alias("max"), *[F.count(F.when(F.abs(target) > x, 1)).alias(f"n_over_{str(x).replace('.', '_')}") for x in limits])
    return d.join(ordering.exact_quantiles(df, target, [fold], [0.5]), fold, "left").withColumn("median", F.col("q")[0]).drop("q")


def train_range_audit(df: DataFrame, target: str, fold: str = "fold_id", split: str = "split", prediction: str = "prediction") -> DataFrame:
    """Per model and test fold the share of predictions outside the range of the training targets."""
    train = df.filter(F.col(split) == "train").agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    test = df.filter(F.col(split) == "test").crossJoin(F.broadcast(train))  # one row
    return test.groupBy("model_id", fold).agg(F.avg(((F.col(prediction) < F.col("lo")) | (F.col(prediction) > F.col("hi"))).cast("double")).alias("share_outside"), F.count("*").alias("n"))


def source_coverage(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """n_rows and n_features of each source."""
    out = None
    for name, df in sources.items():
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("source"), "n_rows", F.lit(len([c for c in df.columns if c not in keys])).alias("n_features"))
        out = row if out is None else out.unionByName(row)
    return out


def turnover_ratio(df: DataFrame, position: str, keys: list[str], date: str = "date") -> DataFrame:
    """Mean over dates of the sum of changes over the sum of absolute positions; dates without positions are left out."""
    d = df.withColumn("__d", F.abs(F.col(position) - F.coalesce(F.lag(position).over(Window.partitionBy(*keys).orderBy(date)), F.lit(0.0))))
    by = d.groupBy(date).agg(F.sum("__d").alias("moved"), F.sum(F.abs(position)).alias("gross"))
    return by.agg(F.avg(ratio(F.col("moved"), F.col("gross"))).alias("turnover_ratio"))


def calmar(df: DataFrame, ret: str, order: str, keys: list[str], year: float = YEAR) -> DataFrame:
    """Annualised compound return over the absolute largest drawdown, null without one."""
    p = performance(df, ret, order, keys)
    yearly = F.pow(F.greatest(1 + F.col("total_return"), F.lit(0.0)), F.lit(year) / F.col("n")) - 1
    return p.select(*keys, ratio(yearly, F.abs("max_drawdown_fraction")).alias("calmar"))


def pareto_front(df: DataFrame, scores: list[str], key: str) -> DataFrame:
    """Rows that no other row dominates (at least as good in all scores, better in one). Rows with an unknown score are
    left out."""
    front = ordering.pareto(df, scores).withColumnsRenamed({s: f"__{s}" for s in scores})
    return df.join(front, [F.col(s).cast("double") == F.col(f"__{s}") for s in scores], "left_semi").select(key, *scores)
