"""Every operator as a query over the given tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.catalog import tables as t
from tagweave.functions.mathx import clean_round
from tagweave.operators import codebook, counts, evaluate, quantize, ragged, shards, tags
from tagweave.plans import factors, online, pmf, scores
from tagweave.session import new_path, stage
from tagweave.sources import tracks
from tagweave.streaming import feeds

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(column: str, digits: int = 6):
    return clean_round(F.col(column), digits).alias(column)


def long(factor_table: DataFrame, key: str, columns: list[str], digits: int = 6) -> DataFrame:
    """Factor arrays as one row per id and component."""
    cells = factor_table.select(key, F.posexplode(F.arrays_zip(*columns)).alias("k", "z"))
    return cells.select(key, "k", *[clean_round(F.col(f"z.{c}"), digits).alias(c) for c in columns])


# Sources, getters, ragged arrays


@query
def load_tracks(spark: SparkSession, sf: str) -> DataFrame:
    metadata = t.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("song_idx"), F.col("o_custkey").alias("artist_key"),
        F.col("o_totalprice").alias("hotttnesss"),
    )
    analysis = t.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("artist_key"), F.col("c_name").alias("artist_name"),
        F.col("c_nationkey").alias("place_key"),
    )
    musicbrainz = t.read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("place_key"), F.col("n_name").alias("location")
    )
    joined = tracks.load_tracks(metadata, analysis, musicbrainz, on=("artist_key", "place_key"))
    return joined.select("song_idx", "artist_name", "location", "hotttnesss")


def document_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return t.read(spark, sf, "documents").withColumnRenamed("doc_id", "song_idx")


@query
def count_songs(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.count_songs(document_tracks(spark, sf))


@query
def project_track_scalars(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.project_track_scalars(document_tracks(spark, sf), ["lang", "source", "n_chars"])


@query
def select_song_at(spark: SparkSession, sf: str) -> DataFrame:
    song = tracks.select_song_at(document_tracks(spark, sf), 0)
    return tracks.project_track_scalars(song, ["lang", "source", "n_chars"])


@query
def ragged_slice(spark: SparkSession, sf: str) -> DataFrame:
    songs = ragged.ragged_slice(*t.order_lines(spark, sf))
    cents = F.transform("value", lambda v: F.round(v * 100).cast("bigint").cast("string"))
    return songs.select("song_idx", F.size("value").alias("n"), F.array_join(cents, ",").alias("cents"))


@query
def ragged_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of every track in pieces of 16, each an array of arrays."""
    pieces = ragged.ragged_chunks(*t.track_segments(spark, sf), size=16)
    first = F.transform("value", lambda v: v[0])
    total = F.aggregate(first, F.lit(0.0), lambda s, v: s + v)
    return pieces.select("song_idx", "chunk", F.size("value").alias("n"), clean_round(total, 4).alias("total"))


@query
def ragged_slice_2d(spark: SparkSession, sf: str) -> DataFrame:
    """A track may own any share of the segments, so they are digested as rows and never gathered."""
    offsets, flat = t.track_segments(spark, sf)
    weighted = F.transform("value", lambda v, p: v * (p + 1) * (F.col("j") + 1))
    rows = ragged.slice_long(offsets, flat).select(
        "song_idx", F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v).alias("part")
    )
    songs = rows.groupBy("song_idx").agg(F.count("*").alias("n"), F.sum("part").alias("digest"))
    filled = offsets.select("song_idx").join(songs, "song_idx", "left")
    return filled.select(
        "song_idx", F.coalesce("n", F.lit(0)).alias("n"), clean_round(F.coalesce("digest", F.lit(0.0)), 4).alias("digest")
    )


@query
def explode_segments(spark: SparkSession, sf: str) -> DataFrame:
    return ragged.explode_segments(t.points(spark, sf), "point_id", "vec")


@query
def zip_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.split("text", tags.TEXT_SEPARATORS)
    songs = t.read(spark, sf, "documents").select("doc_id", terms.alias("term"))
    songs = songs.withColumn("weight", F.transform("term", F.length))
    zipped = ragged.zip_terms(songs, "doc_id", ["term", "weight"])
    return zipped.groupBy("term").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def codes_of_tracks(spark: SparkSession, sf: str) -> DataFrame:
    encoded = quantize.vq_encode_hard(t.points(spark, sf), t.seed_codebook(spark, sf, t.ATOMS))
    return quantize.vq_histogram(encoded)


@query
def write_tracks(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "saved-tracks")
    tracks.write_tracks(load_tracks(spark, sf), path, ["location"])
    return tracks.scan_saved(spark, path).select("song_idx", "artist_name", "location", "hotttnesss")


@query
def write_codes(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "saved-codes")
    tracks.write_codes(codes_of_tracks(spark, sf), path)
    return tracks.scan_saved(spark, path)


@query
def write_bags(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "saved-bags")
    tracks.write_bags(bag_of_tags(spark, sf), path)
    return tracks.scan_saved(spark, path)


@query
def scan_saved(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "saved-codes")
    tracks.write_codes(codes_of_tracks(spark, sf), path, ["track"])
    with tracks.held(spark, path) as held:
        return stage(held.groupBy("code").agg(F.sum("n").alias("n")), "code-counts")


# Codebooks and vector quantization


def book_rows(book: DataFrame) -> DataFrame:
    cells = book.select("code", "size", F.posexplode("center").alias("dim", "value"))
    return cells.select("code", "dim", rounded("value"), "size")


@query
def codebook_seed(spark: SparkSession, sf: str) -> DataFrame:
    seeds = codebook.codebook_seed(t.points(spark, sf), t.SEEDS)
    return seeds.select("code", "point_id", clean_round(F.element_at("vec", 1)).alias("first_value"))


@query
def hartigan_assign(spark: SparkSession, sf: str) -> DataFrame:
    assigned = codebook.hartigan_assign(t.points(spark, sf), t.seed_codebook(spark, sf, t.SEEDS))
    return assigned.select("point_id", "code", rounded("cost"))


@query
def hartigan_partial_fit(spark: SparkSession, sf: str) -> DataFrame:
    return book_rows(codebook.hartigan_partial_fit(t.points(spark, sf), None, t.SEEDS))


@query
def hartigan_fit(spark: SparkSession, sf: str) -> DataFrame:
    return book_rows(codebook.hartigan_fit(t.points(spark, sf), t.SEEDS, max_iter=2, n_batches=2))


@query
def hartigan_fit_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return book_rows(codebook.hartigan_fit(t.points(spark, sf), t.SEEDS, max_iter=2, n_batches=2, shuffle=False))


@query
def hartigan_repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a codebook learned from points whose ids repeat: every point counts."""
    points = t.points(spark, sf).withColumn("point_id", F.col("track").cast("bigint"))
    book = codebook.hartigan_partial_fit(points, None, t.SEEDS)
    return book.agg(F.sum("size").alias("n_points"), F.count("*").alias("n_codes"))


@query
def kmeans_codebook(spark: SparkSession, sf: str) -> DataFrame:
    return book_rows(codebook.kmeans_codebook(t.points(spark, sf), t.SEEDS, max_iter=3, rounds=2, refine=2))


@query
def hartigan_sharded(spark: SparkSession, sf: str) -> DataFrame:
    """One batch learned block by block: the limit of what is held whole is set below the size of the codebook."""
    points = t.points(spark, sf)
    width = codebook.vector_width(points)
    block = -(-t.ATOMS // 3)
    book = shards.learn_batch(points, None, t.ATOMS, width, block, ["point_id"], codebook.balanced_costs)
    return book_rows(book.frame())


@query
def minibatch_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return book_rows(codebook.minibatch_kmeans(t.points(spark, sf), t.SEEDS, max_iter=2, n_batches=2))


@query
def vq_fit_default(spark: SparkSession, sf: str) -> DataFrame:
    book = quantize.vq_partial_fit(t.points(spark, sf), None, n_atoms=t.ATOMS)
    return book.select("code", "size", rounded("half_norm"))


@query
def vq_fit(spark: SparkSession, sf: str) -> DataFrame:
    book = quantize.vq_fit(t.points(spark, sf), lambda p: codebook.hartigan_partial_fit(p, None, t.ATOMS))
    return book.select("code", "size", rounded("half_norm"))


@query
def vq_partial_fit(spark: SparkSession, sf: str) -> DataFrame:
    split = codebook.batch_of(t.points(spark, sf), 2, "0:0")
    book = None
    for n in range(2):
        batch = split.where(F.col("batch") == n)
        book = quantize.vq_partial_fit(
            batch, book, lambda p, c: codebook.hartigan_partial_fit(p, c, t.SEEDS, ["_order", "point_id"])
        )
    return book.select("code", "size", rounded("half_norm"))


@query
def vq_encode_hard(spark: SparkSession, sf: str) -> DataFrame:
    return quantize.vq_encode_hard(t.points(spark, sf).drop("track"), t.seed_codebook(spark, sf, t.ATOMS))


@query
def vq_encode_soft(spark: SparkSession, sf: str) -> DataFrame:
    return quantize.vq_encode_soft(t.points(spark, sf).drop("track"), t.seed_codebook(spark, sf, t.ATOMS), 3)


@query
def vq_indicator_sparse(spark: SparkSession, sf: str) -> DataFrame:
    book = t.seed_codebook(spark, sf, t.ATOMS)
    return quantize.vq_indicator_sparse(t.points(spark, sf).drop("track"), book, 2)


@query
def vq_indicator_dense(spark: SparkSession, sf: str) -> DataFrame:
    book = t.seed_codebook(spark, sf, t.ATOMS)
    dense = quantize.vq_indicator_dense(t.points(spark, sf).drop("track"), book, 2)
    bits = F.transform("indicator", lambda v: F.when(v, F.lit("1")).otherwise(F.lit("0")))
    return dense.select("point_id", F.array_join(bits, "").alias("bits"))


@query
def vq_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return codes_of_tracks(spark, sf)


# Tags and counts


@query
def normalize_tags(spark: SparkSession, sf: str) -> DataFrame:
    raw = t.document_words(spark, sf).select("raw").distinct()
    return raw.select("raw", tags.normalize_tag(F.col("raw")).alias("tag"))


@query
def build_tag_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return tags.build_tag_vocab(stage(t.document_tags(spark, sf), "tags"), t.VOCABULARY)


@query
def encode_tag_ids(spark: SparkSession, sf: str) -> DataFrame:
    return t.document_vocabulary(stage(t.document_tags(spark, sf), "tags"))


def staged_document_tags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    document_tags = stage(t.document_tags(spark, sf), "tags")
    return document_tags, stage(t.document_vocabulary(document_tags), "vocabulary")


@query
def bag_of_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tags.bag_of_tags(*staged_document_tags(spark, sf))


@query
def tags_in_vocab(spark: SparkSession, sf: str) -> DataFrame:
    known = tags.tags_in_vocab(*staged_document_tags(spark, sf))
    return known.groupBy("track").agg(F.count("*").alias("n_tags"), F.sum("n").alias("n"))


@query
def tags_out_of_vocab(spark: SparkSession, sf: str) -> DataFrame:
    unknown = tags.tags_out_of_vocab(*staged_document_tags(spark, sf))
    return unknown.groupBy("track").agg(F.count("*").alias("n_tags"), F.sum("n").alias("n"))


@query
def count_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return counts.count_matrix(t.purchases(spark, sf), "o_custkey", "label")


@query
def joint_matrix(spark: SparkSession, sf: str) -> DataFrame:
    vectors = t.points(spark, sf).withColumn("track", F.col("point_id"))
    encoded = quantize.vq_encode_soft(vectors, t.seed_codebook(spark, sf, t.ATOMS), 3)
    return counts.joint_matrix(quantize.vq_histogram(encoded), bag_of_tags(spark, sf), t.ATOMS)


# Batch factorization


@query
def init_factors(spark: SparkSession, sf: str) -> DataFrame:
    rows = counts.row_ids(t.read(spark, sf, "customer"), "c_custkey")
    return long(factors.init_factors(rows, "i", "theta", t.MODEL), "i", ["g", "r"])


def start(spark: SparkSession, sf: str):
    """The staged count matrix with freshly drawn weights and components."""
    cells, rows, cols = t.purchase_counts(spark, sf)
    cells, cols = stage(cells, "cells"), stage(cols.select("d"), "cols")
    theta = stage(factors.init_factors(rows, "i", "theta", t.MODEL), "theta")
    beta = stage(factors.init_factors(cols, "d", "beta", t.MODEL), "beta")
    return cells, rows, cols, theta, beta


def one_theta_step(spark: SparkSession, sf: str):
    cells, rows, cols, theta, beta = start(spark, sf)
    c = factors.scale_c(theta, t.K).first()[0]
    theta = stage(factors.update_theta(cells, rows, theta, beta, c, t.MODEL), "theta")
    return cells, rows, cols, theta, beta


@query
def set_components(spark: SparkSession, sf: str) -> DataFrame:
    _, _, cols = t.purchase_counts(spark, sf)
    drawn = factors.init_shapes_rates(cols.select("d"), "d", "beta", t.MODEL)
    return long(factors.set_components(drawn, max_d=75), "d", ["e", "el"])


@query
def gamma_expectations(spark: SparkSession, sf: str) -> DataFrame:
    cells, _, _ = t.purchase_counts(spark, sf)
    totals = cells.groupBy("i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    tables = totals.select("i", F.array(F.col("x") + 0.1).alias("g"), F.array(F.col("n") + 0.5).alias("r"))
    return long(factors.gamma_expectations(tables), "i", ["e", "el"])


@query
def rate_at_nonzeros(spark: SparkSession, sf: str) -> DataFrame:
    cells, _, _, theta, beta = start(spark, sf)
    return factors.rate_at_nonzeros(cells, theta, beta, t.MODEL).select("i", "d", "x", rounded("rate"))


@query
def update_theta(spark: SparkSession, sf: str) -> DataFrame:
    return long(one_theta_step(spark, sf)[3], "i", ["g", "r", "e", "el"])


@query
def update_beta(spark: SparkSession, sf: str) -> DataFrame:
    cells, _, cols, theta, beta = one_theta_step(spark, sf)
    return long(factors.update_beta(cells, cols, theta, beta, t.MODEL), "d", ["g", "r", "e", "el"])


@query
def scale_c(spark: SparkSession, sf: str) -> DataFrame:
    return factors.scale_c(one_theta_step(spark, sf)[3], t.K).select(rounded("c"))


@query
def gamma_term(spark: SparkSession, sf: str) -> DataFrame:
    theta = one_theta_step(spark, sf)[3]
    return factors.gamma_term(theta, t.MODEL.a, t.MODEL.a).select(rounded("term", 3))


@query
def elbo(spark: SparkSession, sf: str) -> DataFrame:
    cells, _, cols, theta, beta = one_theta_step(spark, sf)
    beta = stage(factors.update_beta(cells, cols, theta, beta, t.MODEL), "beta")
    c = factors.scale_c(theta, t.K).first()[0]
    bound = factors.elbo(cells, theta, beta, c, t.MODEL)
    return spark.createDataFrame([(float(bound),)], "bound double").select(rounded("bound", 3))


def bound_rows(spark: SparkSession, bounds: list[float]) -> DataFrame:
    rows = [(n, float(b)) for n, b in enumerate(bounds)]
    return spark.createDataFrame(rows, "step int, bound double").select("step", rounded("bound", 3))


@query
def pmf_fit(spark: SparkSession, sf: str) -> DataFrame:
    return long(pmf.pmf_fit(*t.purchase_counts(spark, sf), t.MODEL).beta, "d", ["g", "r", "e"])


@query
def pmf_fit_weights(spark: SparkSession, sf: str) -> DataFrame:
    return long(pmf.pmf_fit(*t.purchase_counts(spark, sf), t.MODEL).theta, "i", ["g", "r", "e"])


@query
def pmf_fit_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return bound_rows(spark, pmf.pmf_fit(*t.purchase_counts(spark, sf), t.MODEL).bounds)


@query
def pmf_fit_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    """The fit with the columns in three blocks, which meet the weights by joins one after the other."""
    cells, rows, cols = t.purchase_counts(spark, sf)
    third = -(-cols.count() // 3)
    return long(pmf.pmf_fit(cells, rows, cols, t.MODEL, block=third).beta, "d", ["g", "r", "e"])


@query
def pmf_transform(spark: SparkSession, sf: str) -> DataFrame:
    cells, rows, cols = t.purchase_counts(spark, sf)
    beta = factors.init_factors(cols, "d", "beta", t.MODEL)
    folded = pmf.pmf_transform(cells, rows, beta, dataclasses.replace(t.MODEL, max_iter=2))
    return long(folded, "i", ["e"])


@query
def score_tags(spark: SparkSession, sf: str) -> DataFrame:
    _, _, _, theta, beta = start(spark, sf)
    return scores.score_tags(theta, beta).select("i", "d", rounded("score"))


@query
def score_tags_top(spark: SparkSession, sf: str) -> DataFrame:
    _, _, _, theta, beta = start(spark, sf)
    return scores.score_tags(theta, beta, top=5).select("i", "d", rounded("score"))


@query
def score_tags_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The best columns found in blocks of falling norm, each a fifth of all."""
    _, _, cols, theta, beta = start(spark, sf)
    return scores.score_tags(theta, beta, top=5, block=-(-cols.count() // 5)).select("i", "d", rounded("score"))


@query
def recommend_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: fit customers x product groups, then the three best groups of every customer."""
    cells, rows, cols = t.purchase_counts(spark, sf)
    cols = stage(cols, "cols")
    model = pmf.pmf_fit(cells, rows, cols, t.MODEL)
    best = scores.score_tags(model.theta, model.beta, top=3)
    return best.join(cols, "d").select("i", "label", rounded("score"))


# Stochastic factorization and streams


def halves(rows: DataFrame):
    """Settings for one pass over two batches."""
    size = -(-rows.count() // 2)
    return dataclasses.replace(t.MODEL, batch_size=size, n_pass=1, max_iter=1)


@query
def minibatch_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = counts.row_ids(t.read(spark, sf, "customer"), "c_custkey")
    return online.minibatch_split(rows, dataclasses.replace(t.MODEL, batch_size=100)).select("i", "batch")


def first_step(spark: SparkSession, sf: str):
    cells, rows, cols, _, beta = start(spark, sf)
    settings = halves(rows)
    batch = online.minibatch_split(rows, settings).where("batch = 0").select("i")
    batch = stage(batch, "batch")
    own = cells.join(batch, "i", "left_semi")
    scale = rows.count() / settings.batch_size
    return online.pmf_partial_fit(own, batch, beta, scale, factors.learning_rate(settings, 1), settings)


@query
def pmf_partial_fit(spark: SparkSession, sf: str) -> DataFrame:
    return long(first_step(spark, sf)[0], "d", ["g", "r", "e"])


@query
def stochastic_elbo(spark: SparkSession, sf: str) -> DataFrame:
    return bound_rows(spark, [first_step(spark, sf)[1]])


def online_model(spark: SparkSession, sf: str) -> online.OnlineModel:
    cells, rows, cols = t.purchase_counts(spark, sf)
    return online.online_pmf_fit(cells, rows, cols, halves(rows))


@query
def online_pmf_fit(spark: SparkSession, sf: str) -> DataFrame:
    return long(online_model(spark, sf).beta, "d", ["g", "r", "e"])


@query
def online_pmf_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return online_model(spark, sf).history_frame().select("pass", "batch", rounded("bound", 3))


def feed(rows: DataFrame, key: str, label: str) -> tuple[str, int]:
    """Write a table as the files of a stream, fifth by fifth; returns the folder and the files per fifth."""
    spark = rows.sparkSession
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 5)
    path = new_path(spark, label)
    for n in range(5):
        fifth = rows.where(F.pmod(key, F.lit(5)) == n)
        fifth.repartition(files).write.mode("append").parquet(path)
    return path, files


def listen(spark: SparkSession, path: str, files: int, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def learned_from_events(spark: SparkSession, sf: str, whole: bool) -> DataFrame:
    events = t.read(spark, sf, "events").select("event_id", "user_id", "event_type")
    cols = stage(counts.number_labels(events, "event_type"), "cols")
    named = events.join(cols.withColumnRenamed("label", "event_type"), "event_type")
    cells = named.select("event_id", F.col("user_id").alias("i"), "d", F.lit(1.0).alias("x"))
    path, files = feed(cells, "event_id", "events")
    users = events.select("user_id").distinct().count()
    settings = dataclasses.replace(t.MODEL, batch_size=-(-users // 2), max_iter=2)
    model_dir = new_path(spark, "stream-model")
    stream = listen(spark, path, files, "i bigint, d int, x double")
    feeds.stream_pmf(stream, model_dir, cols, users, settings, whole=whole).awaitTermination()
    return long(feeds.latest(spark, model_dir), "d", ["g", "r", "e"])


@query
def stream_pmf(spark: SparkSession, sf: str) -> DataFrame:
    return learned_from_events(spark, sf, whole=False)


@query
def stream_pmf_whole_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events come in pieces; keyed state makes whole rows of them."""
    return learned_from_events(spark, sf, whole=True)


@query
def stream_codebook(spark: SparkSession, sf: str) -> DataFrame:
    path, files = feed(t.points(spark, sf).drop("track"), "point_id", "segments")
    model_dir = new_path(spark, "stream-codebook")
    stream = listen(spark, path, files, "point_id bigint, vec array<double>")
    feeds.stream_codebook(stream, model_dir, t.SEEDS).awaitTermination()
    return book_rows(feeds.latest(spark, model_dir))


# Evaluation


@query
def topk_tags(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.topk_tags(t.label_scores(spark, sf), 2)


@query
def precision_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    predicted = evaluate.topk_tags(t.label_scores(spark, sf), 2)
    judged = evaluate.precision_recall_at_k(predicted, t.label_truth(spark, sf))
    return judged.select(
        "tag", "n_predicted", "n_true", "n_hits", rounded("precision"), rounded("recall"), rounded("f1")
    )


@query
def tag_auc(spark: SparkSession, sf: str) -> DataFrame:
    judged = evaluate.judge(t.label_scores(spark, sf), t.label_truth(spark, sf))
    return evaluate.tag_auc(judged).select("tag", "n_pos", "n_neg", rounded("auc"))


@query
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    judged = evaluate.judge(t.label_scores(spark, sf), t.label_truth(spark, sf))
    return evaluate.average_precision(judged).select("tag", "n_pos", rounded("ap"))


@query
def mean_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    judged = evaluate.judge(t.label_scores(spark, sf), t.label_truth(spark, sf))
    return evaluate.mean_average_precision(judged).select(rounded("mean_ap"))
