"""Intermediate tables in the folder that every executor shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost
executor then costs its running tasks only, and later jobs read column
statistics and small files instead of repeating the work before.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only for local runs without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL["root"]


class Scratch:
    """A folder of named tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, str] = {}
        atexit.register(self._at_exit)

    def table(self, name: str, frame: DataFrame) -> DataFrame:
        """Write the frame and read it back with the same schema."""
        path = f"{self.path}/{name}"
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def bucketed(self, name: str, frame: DataFrame, buckets: int, key: str) -> DataFrame:
        """Write the frame dealt by a key; grouping what is read back by it needs no shuffle."""
        table = f"tessera_{uuid.uuid4().hex}"
        self.tables[name] = table
        dealt = frame.repartition(buckets, key).write.bucketBy(buckets, key).option("compression", "zstd")
        dealt.option("path", f"{self.path}/{name}").mode("overwrite").saveAsTable(table)
        return self.spark.table(table)

    def forget(self, name: str) -> None:
        """Delete one table that nothing reads any more."""
        self._delete(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no lazy result still reads, and let Spark free old shuffle files."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            self._delete(f"{self.path}/{name}")
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.path)
            except Exception:  # the JVM has gone already
                return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
