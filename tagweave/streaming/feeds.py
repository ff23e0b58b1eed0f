"""Models that learn from a stream, one micro-batch at a time.

Every micro-batch writes the model as version ``v=<batch id>`` and starts from version
``batch id - 1``; a batch that is delivered again therefore gives the same version again. Only the newest
versions stay. The trigger is a parameter: by default a stream drains what lies there and ends; with
``{"processingTime": "1 minute"}`` it goes on learning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagweave.operators.codebook import hartigan_partial_fit
from tagweave.operators.quantize import with_half_norms
from tagweave.plans import factors
from tagweave.plans.factors import PMFParams
from tagweave.plans.online import pmf_partial_fit
from tagweave.session import new_path, remove_path, stage, work_dir
from tagweave.streaming.keyed import whole_rows

# Versions of a model that stay.
KEEP = 3


def version_path(model_dir: str, version: int) -> str:
    return f"{model_dir}/v={version}"


def _folder(spark: SparkSession, path: str):
    """A folder and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, model_dir: str) -> list[int]:
    """The finished versions, oldest first, from the names of their folders."""
    place, files = _folder(spark, model_dir)
    names = [status.getPath().getName() for status in files.listStatus(place)]
    numbers = sorted(int(name[2:]) for name in names if name.startswith("v=") and name[2:].isdigit())
    return [n for n in numbers if files.exists(_folder(spark, f"{version_path(model_dir, n)}/_SUCCESS")[0])]


def latest(spark: SparkSession, model_dir: str) -> DataFrame:
    """The newest model version; only its folder is read."""
    return spark.read.parquet(version_path(model_dir, versions(spark, model_dir)[-1]))


def prune(spark: SparkSession, model_dir: str, keep: int = KEEP) -> None:
    """Delete all but the newest ``keep`` versions; a batch that is delivered again needs the one before it."""
    for n in versions(spark, model_dir)[: -max(2, keep)]:
        place, files = _folder(spark, version_path(model_dir, n))
        files.delete(place, True)


def _start(stream: DataFrame, learn: Callable[[DataFrame, int], None], checkpoint: str | None,
           trigger: dict | None) -> StreamingQuery:
    spark = stream.sparkSession
    work_dir(spark)
    location = checkpoint or new_path(spark, "stream")
    return (
        stream.writeStream.foreachBatch(learn)
        .option("checkpointLocation", location)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def learn_counts(batch: DataFrame, batch_id: int, model_dir: str, cols: DataFrame, scale: float,
                 params: PMFParams) -> None:
    """One micro-batch of counts ``(i, d, x)``: step number ``batch_id + 1`` of the factorization."""
    spark = batch.sparkSession
    counts = stage(batch.groupBy("i", "d").agg(F.sum("x").alias("x")).where("x <> 0"), "feed")
    if batch_id == 0:
        beta = factors.init_factors(cols, "d", "beta", params)
    else:
        beta = spark.read.parquet(version_path(model_dir, batch_id - 1))
    rows = counts.select("i").distinct()
    if not counts.isEmpty():
        rho = factors.learning_rate(params, batch_id + 1)
        beta, _ = pmf_partial_fit(counts, rows, beta, scale, rho, params)
    beta.write.mode("overwrite").parquet(version_path(model_dir, batch_id))
    remove_path(spark, counts.staged_path)
    prune(spark, model_dir)


def stream_pmf(stream: DataFrame, model_dir: str, cols: DataFrame, est_total: int, params: PMFParams,
               checkpoint: str | None = None, trigger: dict | None = None, whole: bool = False,
               forget_after: int | None = None) -> StreamingQuery:
    """Stochastic factorization of a stream of counts ``(i, d, x)``.

    A micro-batch learns from the counts in it; with ``whole`` from all counts so far of the rows in it, which keyed state
    holds (``forget_after``: milliseconds after which a count that got no more is cleared).
    """
    scale = float(est_total) / params.batch_size
    if whole:
        stream = whole_rows(stream, forget_after)

    def learn(batch: DataFrame, batch_id: int) -> None:
        learn_counts(batch, batch_id, model_dir, cols, scale, params)

    return _start(stream, learn, checkpoint, trigger)


def learn_points(batch: DataFrame, batch_id: int, model_dir: str, k: int) -> None:
    """One micro-batch of points ``(point_id, vec)``."""
    spark = batch.sparkSession
    points = stage(batch, "feed")
    before = None if batch_id == 0 else spark.read.parquet(version_path(model_dir, batch_id - 1))
    if points.isEmpty():
        if before is None:
            raise ValueError("the first micro-batch has no points")
        codebook = before
    else:
        codebook = with_half_norms(hartigan_partial_fit(points, before, k))
    codebook.write.mode("overwrite").parquet(version_path(model_dir, batch_id))
    remove_path(spark, points.staged_path)
    prune(spark, model_dir)


def stream_codebook(stream: DataFrame, model_dir: str, k: int, checkpoint: str | None = None,
                    trigger: dict | None = None) -> StreamingQuery:
    """Online codebook learning from a stream of points."""

    def learn(batch: DataFrame, batch_id: int) -> None:
        learn_points(batch, batch_id, model_dir, k)

    return _start(stream, learn, checkpoint, trigger)
