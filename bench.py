"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query runs once on the
smallest data as a warm-up where that is there, then once on the data folder; all columns are consumed.
"""

from __future__ import annotations

import dataclasses
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from tagweave.catalog import tables as t
from tagweave.catalog.queries import QUERIES
from tagweave.operators import codebook, quantize
from tagweave.plans import online, pmf

CPUS = os.environ.get("BENCH_CPUS", "8")
FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SMALLEST = os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.001")

NAMES = [
    "load_tracks", "ragged_slice", "hartigan_fit", "vq_encode_hard", "vq_histogram", "normalize_tags",
    "build_tag_vocab", "bag_of_tags", "count_matrix", "update_theta", "pmf_fit", "score_tags",
    "recommend_groups", "online_pmf_fit", "precision_recall_at_k", "tag_auc",
]


def pmf_fit_50(spark: SparkSession, folder: str) -> DataFrame:
    """A model of practical width: 50 components, 5 iterations."""
    settings = dataclasses.replace(t.MODEL, n_components=50, max_iter=5)
    return pmf.pmf_fit(*t.purchase_counts(spark, folder), settings).theta


def online_pmf_fit_50(spark: SparkSession, folder: str) -> DataFrame:
    """50 components, one pass in 4 mini-batches."""
    cells, rows, cols = t.purchase_counts(spark, folder)
    settings = dataclasses.replace(t.MODEL, n_components=50, max_iter=2, n_pass=1, batch_size=-(-rows.count() // 4))
    return online.online_pmf_fit(cells, rows, cols, settings).beta


def vq_codebook_512(spark: SparkSession, folder: str) -> DataFrame:
    """Learn 512 codewords in one pass and encode with 4 codes per point."""
    points = t.points(spark, folder)
    book = codebook.hartigan_fit(points, 512, max_iter=1, n_batches=2)
    return quantize.vq_encode_soft(points, book, 4)


EXTRA = {f.__name__: f for f in (pmf_fit_50, online_pmf_fit_50, vq_codebook_512)}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or [*NAMES, *EXTRA]
    times = {}
    for name in chosen:
        fn = EXTRA.get(name) or QUERIES[name]
        for folder in [SMALLEST] * os.path.isdir(SMALLEST) + [FOLDER]:
            began = time.perf_counter()
            fn(spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
