"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import cut, prepare, table  # noqa: F401


class Scratch:
    """Tables that an operator writes into the shared folder, rereads, and removes when they have served.

    They cut lineage as checkpoints do and survive lost executors. Dropping one also lets Spark remove the shuffle
    files that only its plan held.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in names:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}"), True)
        gc.collect()
        self.spark._jvm.System.gc()


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(col):
    """Unsigned CRC-32 of an id written as decimal text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sliced(batches, rows: int = 256):
    """The batches in slices of few rows, so that what is made of the texts stays small."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.iloc[k : k + rows]


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
