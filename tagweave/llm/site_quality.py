"""Quality of documents from their text and from where they lie, by hierarchical empirical Bayes.

A logistic classifier on a document's counts gives the evidence of its text. The mean evidence of a host, and of a path
on it, is shrunk toward what lies above: paths toward their host, hosts toward all documents, the less there is of them
the more. How much is estimated from the spread between groups beyond what their sizes explain (moments of the
group means). The path's posterior mean, without the document's own share, replaces the global rate as the prior of its
documents. Everything but the classifier is grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import blocks, small_batches, stage
from tagweave.llm.labelled import sample_labelled
from tagweave.llm.text_stats import N_FEATURES, Texts, measure, one_hot

#: Labelled documents of each class that train at most.
SAMPLE = 1500
ROUNDS, DECAY = 40, 1.0
THRESHOLD = 0.5
#: Rows of site posteriors up to which they are broadcast; beyond, the join shuffles.
SMALL = 100_000
#: Evidence is kept this far from certainty.
LEAST = 1e-4
#: Documents' worth of a prior where groups do not differ beyond chance.
STRONG = 1e6


def features(found: Texts) -> np.ndarray:
    """Of each text the shares of words in lines of each bin, and shares and logarithms of its counts."""
    n = len(found.n_words)
    bins = one_hot(found.line_bins)
    shares = np.zeros((n, N_FEATURES))
    for k in range(bins.shape[1]):
        np.add.at(shares, (found.line_text, bins[:, k]), found.line_words)
    words = np.maximum(1, found.n_words)
    counts = [
        np.log1p(found.n_words) / 10, found.word_chars / words / 10, found.n_symbols / words, found.n_repeat_words / words,
        np.minimum(1, found.n_dup_lines / words), found.n_words < 50, np.ones(n),
    ]
    return np.concatenate([shares / words[:, None], np.stack(counts, axis=1)], axis=1)


def fit(texts: list[str], good: list[int]) -> np.ndarray:
    """Weights of a logistic classifier by Newton steps, with both classes counting alike."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    rows = [features(measure(block.column("text"))) for block in blocks([batch], "text")]
    if not rows or len(set(good)) < 2:
        return np.zeros(N_FEATURES + 7)
    x, y = np.concatenate(rows), np.array(good, float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - DECAY * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + DECAY * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _evidence(shared):
    """shared: a broadcast of the classifier's weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            logit = features(measure(block.column("text"))) @ shared.value
            p = np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))), LEAST, 1 - LEAST)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("doc_id", "host", "path")), pa.array(p)], ["doc_id", "host", "path", "p"])

    return run


def _strength(groups: DataFrame, above: list[str]) -> float:
    """How many documents' worth the level above counts: from the spread of the groups' means around the mean of their own
    group of the level above (columns ``above``), beyond what the spread between single documents explains.

    Groups of one document say nothing of the spread within and are left out; without any spread beyond chance the prior is
    strong. In a group above with N documents, parts of n documents with variance v: the sum of n (mean - Mean)^2 is expected
    to be that of (1 - n / N) v, plus the variance between parts times N - (sum of n^2) / N.
    """
    v = F.greatest(F.col("squares") - F.col("total") * F.col("total") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1)
    parts = groups.where("n > 1").withColumn("v", v)
    sums = {"n": "n", "total": "total", "n2": "n * n", "spread": "total * total / n", "v": "v", "nv": "n * v"}
    sums = parts.groupBy(*above).agg(*[F.sum(F.expr(e)).alias(f"s_{name}") for name, e in sums.items()])
    room = F.col("s_n") - F.col("s_n2") / F.col("s_n")
    mean = F.col("s_total") / F.col("s_n")
    beyond = F.col("s_spread") - F.col("s_total") * mean - (F.col("s_v") - F.col("s_nv") / F.col("s_n"))
    row = sums.where("s_n > 0").agg(F.sum(room * mean * (1 - mean)).alias("most"), F.sum(beyond).alias("beyond")).first()
    if row.most is None or row.beyond <= 0:
        return STRONG
    return float(np.clip(row.most / row.beyond - 1, 1.0, STRONG))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, evidence, host_rate, path_rate, score, kept`` of every row of ``docs``.

    ``host`` and ``path`` name the columns of the site and of the part of it; null counts as a value of its own. ``labels``
    are ``doc_id, quality``. ``path_rate`` leaves the document itself out, so a document that is alone on its site gets
    the rate of the level above. Null and empty texts are scored like texts without words; equal rows score alike; null
    ids stay; other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    weights = spark.sparkContext.broadcast(_train(docs, labels, sample))
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    scored = stage(chosen.mapInArrow(_evidence(weights), "doc_id long, host string, path string, p double"), "evidence")
    sums = [F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = stage(scored.groupBy("host", "path").agg(*sums), "paths")
    more = [F.sum(c).alias(c) for c in ("n", "total", "squares")]
    hosts = stage(paths.groupBy("host").agg(*more), "hosts")
    whole = hosts.agg(*more).first()
    mean = min(max((whole.total or 0.5) / (whole.n or 1), LEAST), 1 - LEAST)
    k_host = _strength(hosts, [])
    k_path = _strength(paths, ["host"])
    above = hosts.select(F.col("host").alias("a_host"), F.col("n").alias("h_n"), F.col("total").alias("h_total"))
    site = paths.join(above, F.col("host").eqNullSafe(F.col("a_host"))).select(
        F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "total", "h_n", "h_total"
    )
    site = stage(site, "sites")
    here = F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path"))
    joined = scored.join(site.hint("broadcast") if site.count() <= SMALL else site, here)  # by checked size; else a shuffle
    host_rate = (F.col("h_total") - F.col("p") + k_host * mean) / (F.col("h_n") - 1 + k_host)
    path_rate = (F.col("total") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    out = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    logit = _logit(F.col("p")) + _logit(F.col("path_rate")) - F.lit(float(np.log(mean / (1 - mean))))
    out = out.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", F.col("p").alias("evidence"), "host_rate", "path_rate", "score", (F.col("score") >= THRESHOLD).alias("kept"))


def _train(docs: DataFrame, labels: DataFrame, sample: int) -> np.ndarray:
    rows = sample_labelled(docs, labels, "quality", sample)
    return fit([text for text, *_ in rows], [good for _, good, _ in rows])
