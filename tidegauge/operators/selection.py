"""Top-k, deduplication and deterministic samples. Every order is total, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _weight(n: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.lit(1.0) / n)


def positions_from_predictions(df: DataFrame, top_k: int = 20, cap: float = 0.1) -> DataFrame:
    """Per date, fold, split and model the top-k instruments with equal capped weights, and an ``equal_blend`` of all
    instruments that any model chose. Of equal predictions the first instrument wins."""
    keys = ["date", "fold_id", "split"]
    w = Window.partitionBy(*keys, "model_id").orderBy(F.desc("prediction"), "instrument")
    top = df.filter("prediction IS NOT NULL").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top_k)
    top = top.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "model_id")))
    # what a date's models chose, at most top_k rows a model, is put into one row, from which the blend follows, too
    chosen = top.groupBy(*keys).agg(F.collect_list(F.struct(F.col("model_id").alias("candidate_id"), "instrument", "n")).alias("own"))
    chosen = chosen.withColumn("pool", F.array_distinct(F.col("own.instrument")))
    blend = F.transform("pool", lambda i: F.struct(F.lit("equal_blend").alias("candidate_id"), i.alias("instrument"), F.size("pool").cast("long").alias("n")))
    rows = chosen.select(*keys, F.explode(F.concat("own", blend)).alias("r"))
    return rows.select(*keys, "r.candidate_id", "r.instrument", _weight(F.col("r.n"), cap).alias("target_weight"))


def positions_from_intents(df: DataFrame, fold_id: str, split: str, top_k: int = 20, cap: float = 0.1) -> DataFrame:
    """Eligible, decided intents by falling absolute score, short ones with negative weight."""
    use = df.filter(F.coalesce("eligible", F.lit(False)) & ~F.coalesce("abstain", F.lit(False)) & (F.col("direction") != "flat"))
    w = Window.partitionBy("date", "strategy_id").orderBy(F.desc(F.abs("score")), "instrument")
    top = use.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top_k)
    n = F.count("*").over(Window.partitionBy("date", "strategy_id"))
    sign = F.when(F.col("direction") == "short", -1.0).otherwise(1.0)
    return top.select("date", F.col("strategy_id").alias("candidate_id"), "instrument", (sign * _weight(n, cap)).alias("target_weight"), F.lit(fold_id).alias("fold_id"), F.lit(split).alias("split"))


def top_k(df: DataFrame, k: int, keys: list[str], by: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), tie)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def dedupe_by_flags(df: DataFrame, keys: list[str], flags: list[str], tie: list[str]) -> DataFrame:
    """The first row per key: unflagged before flagged, then by ``tie``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(f).asc_nulls_first() for f in flags], *tie)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def fullest_row(df: DataFrame, keys: list[str], features: list[str], tie: list[str]) -> DataFrame:
    """The row per key with the most known features."""
    known = sum((F.col(c).isNotNull().cast("int") for c in features), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(F.desc(known), *tie)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def hash_rank(seed: int | str, *keys: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def sample_rows(df: DataFrame, most: int, seed: int | str, keys: list[str]) -> DataFrame:
    """A uniform sample of at most ``most`` rows, the same for the same seed whatever the partitions."""
    return df.withColumn("__h", hash_rank(seed, *keys)).orderBy("__h", *keys).limit(most).drop("__h")


def stratified_keys(df: DataFrame, strata: list[str], keys: list[str], most: int, seed: int | str) -> DataFrame:
    """A sample of keys with a share of ``most`` for each stratum by its size, one at least."""
    d = df.select(*strata, *keys).distinct()
    total = d.agg(F.count("*").alias("__total"))
    w = Window.partitionBy(*strata).orderBy(hash_rank(seed, *strata, *keys), *keys)
    sizes = d.groupBy(*strata).agg(F.count("*").alias("__size"))
    d = d.withColumn("__n", F.row_number().over(w)).join(sizes, strata).crossJoin(F.broadcast(total))  # one row
    return d.filter(F.col("__n") <= F.greatest(F.lit(1), F.floor(F.lit(most) * F.col("__size") / F.col("__total")))).select(*strata, *keys)


def selected_instruments(df: DataFrame, most: int, seed: int | str, instrument: str = "instrument") -> DataFrame:
    chosen = sample_rows(df.select(instrument).distinct(), most, seed, [instrument])
    return df.join(chosen, instrument, "left_semi")


def append_default_blend(positions: DataFrame, cap: float = 0.1) -> DataFrame:
    """Positions and, per date, fold and split, the equal blend of all instruments in them."""
    keys = ["date", "fold_id", "split"]
    pool = positions.select(*keys, "instrument").distinct().withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return positions.unionByName(pool.select(*keys, F.lit("equal_blend").alias("candidate_id"), "instrument", _weight(F.col("n"), cap).alias("target_weight")))


def routed_positions(decisions: DataFrame, positions: DataFrame) -> DataFrame:
    """The positions of the candidate chosen for each date."""
    return positions.join(decisions.select("date", F.col("selected_candidate_id").alias("candidate_id")), ["date", "candidate_id"])


def weighted_positions(decisions: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions blended by the JSON weights of each date, normalised to sum to one."""
    shares = decisions.select("date", F.map_filter(F.from_json("model_weights_json", "map<string,double>"), lambda k, v: v > 0).alias("w"))
    total = F.aggregate(F.map_values("w"), F.lit(0.0), lambda a, x: a + x)
    shares = shares.select("date", total.alias("total"), F.explode("w").alias("candidate_id", "weight")).select("date", "candidate_id", (F.col("weight") / F.col("total")).alias("share"))
    return positions.join(shares, ["date", "candidate_id"]).groupBy("date", "instrument").agg(F.sum(F.col("share") * F.col("target_weight")).alias("target_weight"))
