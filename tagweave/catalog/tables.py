"""How the given tables stand in for song archives, segment vectors, tags and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.mathx import hash_order, uniform_of
from tagweave.functions.ordering import global_rank
from tagweave.operators import codebook, counts, ragged, tags
from tagweave.plans.factors import PMFParams
from tagweave.session import spread_scan, stage

K = 4
MODEL = PMFParams(n_components=K, max_iter=3, tol=-1e9, smoothness=100.0, random_state=0)
SEEDS = 8
ATOMS = 32
VOCABULARY = 200


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment vectors, with the track they belong to."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").alias("track"),
    )


def seed_codebook(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The first k distinct vectors as a codebook; code j counts as having j + 1 points."""
    seeds = codebook.codebook_seed(points(spark, sf_dir), k)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    return seeds.select(
        "code", F.col("vec").alias("center"), (F.col("code") + 1.0).alias("size"), (0.5 * squares).alias("half_norm")
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events (customer, product group)."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws("|", "p_brand", "p_type").alias("label")
    )
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select("o_custkey", "label")


def purchase_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The count matrix with its dimensions: counts (i, d, x), rows (i), cols (d, label)."""
    cells = stage(counts.count_matrix(purchases(spark, sf_dir), "o_custkey", "label"), "cells")
    cols = stage(counts.number_labels(cells.withColumnRenamed("d", "name"), "name"), "cols")
    numbered = cells.withColumnRenamed("d", "label").join(cols, "label").select("i", "d", "x")
    rows = counts.row_ids(read(spark, sf_dir, "customer"), "c_custkey")
    return numbered, rows, cols


def order_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ragged array per order: offsets (song_idx, start) and flat prices (pos, value)."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    lengths = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    every = orders.join(lengths, "l_orderkey", "left").select(
        F.col("l_orderkey").alias("song_idx"), F.coalesce("n", F.lit(0)).alias("n")
    )
    flat = global_rank(lines, ["l_orderkey", "l_linenumber", "l_extendedprice"], "pos", "flat")
    return ragged.offsets_of(every, "song_idx", "n"), flat.select("pos", F.col("l_extendedprice").alias("value"))


def track_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ragged 2-D array per track: offsets (song_idx, start) and flat vectors (pos, value)."""
    segments = points(spark, sf_dir)
    lengths = segments.groupBy(F.col("track").cast("bigint").alias("song_idx")).agg(F.count("*").alias("n"))
    flat = global_rank(segments, ["track", "point_id"], "pos", "flat")
    return ragged.offsets_of(lengths, "song_idx", "n"), flat.select("pos", F.col("vec").alias("value"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tags.words_of(spread_scan(texts), "doc_id")


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a tag of that document, counted in normal form and listed by tag."""
    return tags.list_tags_of_texts(read(spark, sf_dir, "documents"), "doc_id")


def document_vocabulary(document_tag_counts: DataFrame) -> DataFrame:
    return tags.encode_tag_ids(tags.build_tag_vocab(document_tag_counts, VOCABULARY))


def label_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True (item, tag) pairs from the labels."""
    labels = read(spark, sf_dir, "labels")
    named = F.filter(
        F.array(
            F.when(F.col("quality") == 1, F.lit("quality")),
            F.when(F.col("toxic") == 1, F.lit("toxic")),
            F.when(F.col("toxic") == 0, F.lit("clean")),
        ),
        lambda t: t.isNotNull(),
    )
    return labels.select(F.col("doc_id").alias("item"), F.explode(named).alias("tag")).distinct()


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores (item, tag, score) of the labelled documents: by length, and by a hash of the id."""
    labelled = read(spark, sf_dir, "labels").select("doc_id").distinct()
    documents = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labelled, "doc_id")

    def luck(tag):
        # coarse on purpose, so that scores tie
        return F.floor(uniform_of(hash_order(tag, F.col("doc_id"))) * 50).cast("double") / 10.0

    scored = F.array(
        F.struct(F.lit("quality").alias("tag"), (F.col("n_chars") / 1000.0).alias("score")),
        F.struct(F.lit("toxic").alias("tag"), luck("toxic").alias("score")),
        F.struct(F.lit("clean").alias("tag"), luck("clean").alias("score")),
    )
    return documents.select(F.col("doc_id").alias("item"), F.inline(scored))
