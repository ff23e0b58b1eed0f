"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that train at most.
SAMPLE_BYTES = 64 << 20


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, each: int, salt: str | None = None, usable: Column | None = None,
                  max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``l_id, text, y, weight`` of about ``each`` documents of either class ``y`` at most, chosen by hash.

    The weight makes up for the share of its class that was chosen. The class is 1 where ``label`` is above zero. Null labels
    and ids are ignored; a document with several labels has the largest, an id with several rows its least text, so
    there are no more texts than ids chosen. They are taken by hash until there are ``max_bytes`` of them. ``usable`` may
    leave out labels by ``l_id``. The labels chosen are bounded by ``each``, so they are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id"))
    known = known.agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    if usable is not None:
        known = known.where(usable)
    sizes = {row.y: row.n for row in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    shares = [min(1.0, each / sizes.get(c, 1)) for c in (0, 1)]
    rank = F.pmod(F.xxhash64(F.lit(salt or label), "l_id"), F.lit(1_000_000))
    chosen = known.where(rank < F.when(F.col("y") == 1, shares[1]).otherwise(shares[0]) * 1_000_000)
    given = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    picked = given.join(F.broadcast(chosen), "l_id").groupBy("l_id", "y").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("l_id"), "l_id"))
    weight = F.when(F.col("y") == 1, max(shares) / shares[1]).otherwise(max(shares) / shares[0])
    return picked.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).select("l_id", "text", "y", weight.alias("weight"))


def sample_labelled(*args, **settings) -> list[tuple[str, int, float]]:
    """``(text, class, weight)`` of ``labelled_rows``, in a fixed order."""
    rows = labelled_rows(*args, **settings).orderBy("l_id").select("text", "y", "weight").collect()
    return [(r.text, r.y, r.weight) for r in rows]
