"""Frames that are used more than once, written to the folder that all machines share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset, a folder under the warehouse
    if all runs on this machine; elsewhere executors would not see each other's files, so it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints")
    return sc.getCheckpointDir()


def once(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from a reliable checkpoint by all that follows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
