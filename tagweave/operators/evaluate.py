"""Ranking quality of tag scores, per tag.

Scores are ``(item, tag, score)``, truth is ``(item, tag)`` for the true pairs; judged rows are
``(tag, score, hit)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.ordering import running


def topk_tags(scores: DataFrame, k: int, item: str = "item", tag: str = "tag") -> DataFrame:
    """The k best tags of every item, ties by the lowest tag; each task drops all but k first."""
    best = Window.partitionBy(item).orderBy(F.desc("score"), tag)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def precision_recall_at_k(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per tag: hits, precision, recall and F1 of predicted ``(item, tag)`` pairs."""
    p = predicted.select("item", "tag").withColumn("p", F.lit(1))
    t = truth.select("item", "tag").withColumn("t", F.lit(1))
    both = p.join(t, ["item", "tag"], "full")
    sums = both.groupBy("tag").agg(
        F.count("p").alias("n_predicted"),
        F.count("t").alias("n_true"),
        F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("n_hits"),
    )
    return (
        sums.withColumn("precision", F.try_divide("n_hits", "n_predicted"))
        .withColumn("recall", F.try_divide("n_hits", "n_true"))
        .withColumn("f1", F.try_divide(2 * F.col("n_hits"), F.col("n_predicted") + F.col("n_true")))
    )


def judge(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Every scored pair with ``hit`` 0 or 1."""
    flags = truth.select("item", "tag").distinct().withColumn("hit", F.lit(1))
    return scores.join(flags, ["item", "tag"], "left").select("tag", "score", F.coalesce("hit", F.lit(0)).alias("hit"))


def _by_score(judged: DataFrame) -> DataFrame:
    """Counts per tag and distinct score: equal scores are one step of the ranking."""
    return judged.groupBy("tag", "score").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


def tag_auc(judged: DataFrame) -> DataFrame:
    """Area under the ROC curve per tag, by rank sums with average ranks for ties; null if all or none hit."""
    steps = running(_by_score(judged), ["tag"], ["score"], sums={"upto": "n"}, label="auc")
    mean_rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    sums = steps.groupBy("tag").agg(
        F.sum("hits").alias("n_pos"),
        F.sum(F.col("n") - F.col("hits")).alias("n_neg"),
        F.sum(F.col("hits") * mean_rank).alias("rank_sum"),
    )
    above = F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    auc = F.try_divide(above, F.col("n_pos").cast("double") * F.col("n_neg"))
    return sums.select("tag", "n_pos", "n_neg", auc.alias("auc"))


def average_precision(judged: DataFrame) -> DataFrame:
    """Average precision per tag: gains in recall weighted by the precision at each distinct score."""
    steps = running(
        _by_score(judged), ["tag"], [F.desc("score")], sums={"seen": "n", "found": "hits"}, label="precision"
    )
    sums = steps.groupBy("tag").agg(
        F.sum("hits").alias("n_pos"), F.sum(F.col("hits") * F.col("found") / F.col("seen")).alias("weighted")
    )
    return sums.select("tag", "n_pos", F.try_divide("weighted", "n_pos").alias("ap"))


def mean_average_precision(judged: DataFrame) -> DataFrame:
    return average_precision(judged).agg(F.avg("ap").alias("mean_ap"))
