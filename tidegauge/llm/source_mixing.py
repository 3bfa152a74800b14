"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent between 0 (all sources alike) and 1 (as they are) and
normalised. The exponent is bisected until the weights meet a target entropy or a repetition limit. The weights become
token budgets, and each source fills its budget with passes over its blocks of documents: whole passes first, then a
last pass over the blocks in a permuted order, cut at the document that would exceed the budget.

Blocks are hash buckets of the documents, so many a source that a block has about ``BLOCK_ROWS`` documents of the largest
source at most; all that is gathered about a source has a row for each block, and only the documents of the blocks in
which budgets end are ranked. Documents themselves never move.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, shared_checkpoint

#: Totals of at most so many sources are bisected on the driver; of more, by aggregations in Spark.
SOURCES_ON_DRIVER = 65_536
#: Documents that a block aims at, of a table that is one source.
BLOCK_ROWS = 50_000
#: A table of at most so many blocks is broadcast; a larger one is joined by a shuffle.
BLOCKS_BROADCAST = 100_000


@dataclass(frozen=True)
class Target:
    """``repetition_limit``: no source may be passed over more often than so many times as often as the source that
    is passed over least; or ``entropy`` (nats) that the weights must reach, which then decides alone. ``budget``:
    tokens of the mixture; None: as many as it takes for every document to be in it at least once. ``blocks``: the
    least number of blocks; larger tables have more, always a power of two times it."""

    repetition_limit: float = 2.0
    entropy: float | None = None
    budget: int | None = None
    blocks: int = 256
    steps: int = 48


def tokens_column(text: Column) -> Column:
    """Words of the text and one for its end."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long") + 1


def bisect_exponent(measure, target: Target) -> float:
    """The largest exponent that meets an entropy, or the smallest that keeps to a repetition limit. ``measure(e)``: entropy of the weights and the ratio of the largest
    to the smallest number of passes; the former falls with the exponent, the latter too. If no exponent meets an
    entropy, 0."""

    def met(e: float) -> bool:
        entropy, ratio = measure(e)
        return entropy >= target.entropy if target.entropy is not None else ratio <= target.repetition_limit

    if target.entropy is None:  # the smallest exponent that keeps to the limit
        low, high = 0.0, 1.0
        if met(0.0):
            return 0.0
        for _ in range(target.steps):
            mid = (low + high) / 2
            low, high = (low, mid) if met(mid) else (mid, high)
        return high
    low, high = 0.0, 1.0
    if met(1.0):
        return 1.0
    for _ in range(target.steps):
        mid = (low + high) / 2
        low, high = (mid, high) if met(mid) else (low, mid)
    return low


def block_count(rows: int, target: Target) -> int:
    """The number of blocks for a table of so many rows; a block's number is read from 24 bits."""
    n = target.blocks
    while n * BLOCK_ROWS < rows and n < 1 << 23:
        n *= 2
    return n


def solve(totals: DataFrame, target: Target) -> tuple[float, float, int]:
    """Exponent, sum of the powers, and budget. ``totals``: src, total (positive)."""
    n = totals.count()
    if not n:
        return 1.0, 1.0, 0
    if n <= SOURCES_ON_DRIVER:
        t = np.array(sorted(r["total"] for r in totals.select("total").collect()), float)
        largest, smallest = t[-1], t[0]

        def powers(e: float) -> tuple[float, float]:
            p = t**e
            return math.fsum(p), math.fsum(p * np.log(t))
    else:
        largest, smallest = totals.agg(F.max("total"), F.min("total")).first()

        def powers(e: float) -> tuple[float, float]:
            p = F.pow(F.col("total").cast("double"), F.lit(e))
            return tuple(totals.agg(F.sum(p), F.sum(p * F.log("total"))).first())

    def measure(e: float) -> tuple[float, float]:
        s, sl = powers(e)
        return math.log(s) - e * sl / s, (largest / smallest) ** (1 - e)

    e = bisect_exponent(measure, target)
    s = powers(e)[0]
    return e, s, target.budget if target.budget is not None else math.floor(s * float(largest) ** (1 - e) + 0.5)


def mix_sources(df: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", target: Target = Target()) -> DataFrame:
    """The rows of ``df``, each as often as the mixture has it, with ``mix_pass`` (from 1), ``mix_block``,
    ``mix_rank`` (the block's place in that pass's permutation, from 1), ``mix_tokens``, ``mix_weight`` and
    ``mix_exponent``. Reading by pass, rank and id gives the mixture in its order.

    Defined cases: rows with a null source form a source of their own; null and empty texts count one token;
    repeated rows fall into the same block and are taken or left together; an empty table gives an empty table.
    """
    own = [f"`{c}`" for c in df.columns]
    src = F.when(F.col(f"`{source_col}`").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(f"`{source_col}`").cast("string")))
    row = F.struct(*own).alias("row") if own else F.struct(F.lit(None))
    keyed = df.select(row, src.alias("src"), tokens_column(F.col(f"`{text_col}`")).alias("tokens"), F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("h"))
    keyed = keyed.withColumn("block", (F.conv(F.substring("h", 1, 6), 16, 10).cast("int") % block_count(df.count(), target)))
    blocks = shared_checkpoint(keyed.groupBy("src", "block").agg(F.sum("tokens").alias("size")))
    totals = shared_checkpoint(blocks.groupBy("src").agg(F.sum("size").alias("total")))
    exponent, powers, budget = solve(totals, target)

    weight = F.pow(F.col("total").cast("double"), F.lit(exponent)) / powers
    plan = totals.withColumn("weight", weight).withColumn("share", F.floor(F.col("weight") * budget + 0.5).cast("long"))
    plan = plan.withColumn("whole", F.expr("share div total").cast("int")).withColumn("part", F.expr("share % total"))
    # the order of the blocks in the last pass, up to the block that the budget ends in
    ranked = blocks.join(plan, "src").withColumn("key", F.md5(F.concat_ws(":", "src", (F.col("whole") + 1).cast("string"), "block")))
    by = Window.partitionBy("src").orderBy("key")
    ranked = ranked.withColumn("upto", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("room", F.col("part") - F.col("upto") + F.col("size"))
    ranked = shared_checkpoint(ranked.select("src", "block", "size", "weight", "whole", "room"))
    cut = ranked.filter("room > 0 AND room < size").select("src", "block", "room")
    docs = keyed.select("src", "block", "tokens", "h").join(F.broadcast(cut) if cut.count() <= BLOCKS_BROADCAST else cut, ["src", "block"])
    docs = docs.withColumn("upto", F.sum("tokens").over(Window.partitionBy("src", "block").orderBy("h")))  # equal rows are peers
    last = docs.filter("upto <= room").groupBy("src", "block").agg(F.max("h").alias("last"))
    table = shared_checkpoint(ranked.join(last, ["src", "block"], "left").select("src", "block", "weight", "whole", F.expr("CASE WHEN room >= size THEN 'g' WHEN room > 0 THEN coalesce(last, '') ELSE '' END").alias("last")))
    # the place of a block in any pass's permutation
    passes = table.withColumn("mix_pass", F.explode(F.expr("sequence(1, whole + 1)")))
    passes = passes.withColumn("mix_rank", F.row_number().over(Window.partitionBy("src", "mix_pass").orderBy(F.md5(F.concat_ws(":", "src", F.col("mix_pass").cast("string"), "block")))))
    table = passes.groupBy("src", "block").agg(F.first("weight").alias("mix_weight"), F.first("whole").alias("whole"), F.first("last").alias("last"), F.sort_array(F.collect_list(F.struct("mix_pass", "mix_rank"))).alias("in"))
    table = shared_checkpoint(table)
    joined = keyed.join(F.broadcast(table) if table.count() <= BLOCKS_BROADCAST else table, ["src", "block"])
    taken = joined.withColumn("in", F.explode(F.expr("filter(in, x -> x.mix_pass <= whole OR h <= last)")))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in df.columns], "in.mix_pass", F.col("block").alias("mix_block"), "in.mix_rank", F.col("tokens").alias("mix_tokens"), "mix_weight", F.lit(exponent).alias("mix_exponent"))
