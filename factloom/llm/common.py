"""Scratch tables in the cluster's shared folder and small reading helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    A session without that setting gets a temporary folder only if everything runs in one
    process (a local master, as in tests); on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        master = conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def plain_unions(spark: SparkSession):
    """Spark 4.1 zips unions of equally partitioned children, which fails when adaptive execution
    has given them different partition counts; it is off while a table is planned and written."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: list[tuple[str, str]] = []

    def few(self) -> int:
        """Partitions for a table that is small beside the documents (an eighth of the shuffle's)."""
        return max(16, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)

    def write(self, df: DataFrame, name: str = "t", parts: int | None = None) -> DataFrame:
        """Write ``df`` once and return a reader of the written table.

        ``parts`` is for tables far smaller than the documents: where a shuffle has more
        partitions than that, the rows are dealt over so many files (the plan above keeps its tasks).
        """
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        deal = parts and parts < int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with plain_unions(self.spark):
            (df.repartition(parts) if deal else df).write.parquet(path)
        self._paths.append((name, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the written tables of these names, which no later plan reads; without names, all."""
        jvm = self.spark.sparkContext._jvm  # noqa: SLF001
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        for _, path in [x for x in self._paths if not names or x[0] in names]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self._paths = [x for x in self._paths if names and x[0] not in names]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_fold(doc_id: str, folds: int):
    """crc32 of the id's decimal text modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
