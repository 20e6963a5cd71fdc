"""Tables written between the rounds of an iteration.

Rounds are cut by Parquet tables in the cluster's shared folder
(``spark.checkpoint.dir``), so lineage stays short and lost executors cost nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def plain_unions(spark: SparkSession) -> None:
    """Unions of equally partitioned children are zipped by Spark 4.1 even after adaptive
    execution has given the children different partition counts, which fails; turn that off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stages:
    """Writes tables under one fresh folder and reads them back."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        plain_unions(spark)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def laid_out(self, df: DataFrame, *keys: str) -> DataFrame:
        """A written table that is kept dealt by ``keys`` in the executors' storage, so that the
        rounds joining by them move only the other side; lost blocks are read again."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.write(df).repartition(parts, *keys).persist()
