"""Where intermediate tables go, and the size limits that decide between strategies."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A model (codebook or component table) with at most this many doubles may be held by the driver
# and by every task: 80 MB. Larger models take the paths that never gather them.
MODEL_CELLS = 10_000_000

# A join key can only be hot when the whole input has more rows than one task handles with ease.
ROWS_PER_TASK = 5_000_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables, taken from ``spark.checkpoint.dir``.

    Local sessions (tests) without the setting get a fresh temporary folder. A cluster session
    without it is an error: a machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="tagweave-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table; cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class TwoSlots:
    """Two table locations that a loop writes in turn, so that it never holds more than two states."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = new_path(spark, label)
        self.paths = [f"{base}/even", f"{base}/odd"]

    def write(self, df: DataFrame, step: int) -> DataFrame:
        path = self.paths[step % 2]
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def spread_scan(scan: DataFrame) -> DataFrame:
    """Spread a scan of few, unsplittable files over all cores, for work that costs far more than moving rows.

    Inputs that already come in enough parts, as large ones do, are left as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
