"""Sharding by rendezvous hashing.

A record's key draws a number for every shard; the shard with the smallest ``-ln(u) / weight`` takes the record. A new
shard only takes records that draw best for it and moves no others. The places within a shard are counted by hash
buckets of the keys, so no task sees a whole shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint

#: Hash buckets that the places of a shard are counted by.
BUCKETS = 1024


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of key and shard."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key; a shard of weight 0 gets nothing. Of equal draws the lowest shard wins."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    costs = [F.struct((-F.log(draw(key, i)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def shard_records(df: DataFrame, weights: list[float], key_col: str = "doc_id", text_col: str = "text", grown: list[float] | None = None) -> DataFrame:
    """One row per input row: the key, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``shard``, ``slot``
    (its place in the shard, without gaps from 0) and ``grown_shard`` (the shard under the weights ``grown``).

    Defined cases: a null key has the key text ``null`` and so one shard; null text as empty text; rows with the same
    key share a shard and are placed by checksum and size, fully equal rows in any order; an empty table gives an
    empty table.
    """
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("null"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{key_col}`").alias("key"), key.alias("name"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"))
    rows = rows.select("key", "size", "crc", rendezvous(F.col("name"), weights).alias("shard"), rendezvous(F.col("name"), grown or weights).alias("grown"), (F.conv(F.substring(F.md5("name"), 1, 6), 16, 10).cast("int") % BUCKETS).alias("bucket"))
    rows = shared_checkpoint(rows)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most BUCKETS rows a shard
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "crc", "size"))
    placed = rows.withColumn("nth", within).join(F.broadcast(first), ["shard", "bucket"])
    return placed.select(F.col("key").alias(key_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.col("grown").alias("grown_shard"))
