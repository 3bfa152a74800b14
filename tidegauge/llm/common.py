"""Helpers shared by the text operators.

All operators read only the columns they name and leave other columns of their input alone, so extra columns may
have any name. Null texts count as empty texts unless an operator's docstring says otherwise.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the columns of the table ``documents``, in order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Fixed: a word is a longest run of characters other than these six (space, tab, line feed, vertical tab, form feed,
#: carriage return). ``bytes.split()`` splits at the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so what is expensive runs once and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class SharedTable:
    """A table written to the shared folder, which can be deleted when nothing reads it any more."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def delete(self) -> None:
        sc = self.df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that no model learns from; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for the ids that models may learn from; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
