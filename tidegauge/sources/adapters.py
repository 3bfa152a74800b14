"""Panels over the star-schema tables: ticks, daily bars, model predictions, and bitemporal facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item, with a total order of the ticks of a day."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("value"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("tie"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily open, high, low, close, volume and traded value of each instrument."""
    return ticks(spark, sf_dir).groupBy("instrument", "date").agg(
        F.min_by("price", "tie").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tie").alias("close"),
        F.sum("volume").alias("volume"), F.round(F.sum("value"), 2).alias("dollar_volume"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long panel of three simple models with the return that follows; three folds in order of time. The bars are
    made once and checkpointed: their dates and all that reads the panel start from there."""
    w = Window.partitionBy("instrument").orderBy("date")
    b = bars(spark, sf_dir).select("*", F.lag("close", 1).over(w).alias("c1"), F.lag("close", 5).over(w).alias("c5"), F.lag("volume", 1).over(w).alias("v1"), F.lead("close", 1).over(w).alias("next_close"), F.row_number().over(w).alias("nth"))
    b = once(b.filter("nth > 5 AND next_close IS NOT NULL").select("instrument", "date", "close", "volume", "c1", "c5", "v1", "next_close"))
    dates = b.select("date").distinct().select("date", (F.ntile(3).over(Window.orderBy("date")) - 1).alias("fold"))  # a row a day
    models = F.array(
        F.struct(F.lit("momentum").alias("model_id"), F.log(F.col("close") / F.col("c1")).alias("prediction")),
        F.struct(F.lit("reversal").alias("model_id"), (-F.log(F.col("close") / F.col("c5"))).alias("prediction")),
        F.struct(F.lit("volume").alias("model_id"), F.log(F.col("volume") / F.col("v1")).alias("prediction")),
    )
    return b.join(dates, "date").select("instrument", "date", "fold", (F.col("next_close") / F.col("close") - 1).alias("forward_return"), F.explode(models).alias("m")).select(
        "m.model_id", F.col("instrument").cast("string").alias("instrument"), "date", F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("fold_id"),
        F.when(F.col("fold") == 2, "test").otherwise("train").alias("split"), F.round("m.prediction", 8).alias("prediction"), F.round("forward_return", 8).alias("forward_return"),
    )


def bitemporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values known once their last line has been shipped: symbol, valid_time, knowledge_time, close, volume."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("shipped"), F.sum("l_quantity").alias("volume"))
    orders = table(spark, sf_dir, "orders").join(lines, F.expr("o_orderkey = l_orderkey"))
    rows = orders.select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("valid_time"), F.greatest(F.to_date("o_orderdate"), "shipped").alias("knowledge_time"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("close"), "volume", "o_orderkey")
    one = Window.partitionBy("symbol", "valid_time", "knowledge_time").orderBy("o_orderkey")
    return rows.withColumn("nth", F.row_number().over(one)).filter("nth = 1").drop("nth", "o_orderkey")
