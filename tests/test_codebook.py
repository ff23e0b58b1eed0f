import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.operators import codebook, quantize

TINY = [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [4.0, 0.0]), (3, [0.0, 1.0]), (4, [5.0, 0.0]), (5, [4.0, 1.0])]


def points(spark, rows=TINY):
    return spark.createDataFrame([(i, [float(v) for v in vec]) for i, vec in rows], "point_id long, vec array<double>")


def centers(book):
    rows = book.orderBy("code").collect()
    return np.array([r.center for r in rows]), np.array([r["size"] for r in rows])


def sequential(vectors, k, c=None, n=None):
    """The point-at-a-time rule, one point after the other."""
    c = np.zeros((k, len(vectors[0]))) if c is None else c.copy()
    n = np.zeros(k) if n is None else n.copy()
    for x in vectors:
        cost = n / (1 + n) * ((x - c) ** 2).sum(axis=1)
        j = int(np.argmin(cost))
        c[j] = (n[j] * c[j] + x) / (n[j] + 1)
        n[j] += 1
    return c, n


def test_seeds_are_the_first_distinct_vectors(spark):
    seeds = codebook.codebook_seed(points(spark), 3).orderBy("code").collect()
    assert [r.point_id for r in seeds] == [0, 2, 3]


def test_many_copies_cannot_hide_the_seeds(spark):
    rows = [(i, [1.0, 1.0]) for i in range(100)] + [(100 + i, [float(i), 0.0]) for i in range(3)]
    seeds = codebook.codebook_seed(points(spark, rows), 4).orderBy("code").collect()
    assert [r.point_id for r in seeds] == [0, 100, 101, 102]


def test_fewer_distinct_points_than_codes(spark):
    assert codebook.codebook_seed(points(spark), 50).count() == 5
    _, sizes = centers(codebook.hartigan_partial_fit(points(spark), None, 50))
    assert sizes.sum() == len(TINY)


def test_batches_of_one_point_follow_the_sequential_rule(spark):
    rng = np.random.default_rng(3)
    rows = [(n, v.tolist()) for n, v in enumerate(rng.normal(size=(9, 2)))]
    book = None
    for row in rows:
        book = codebook.hartigan_partial_fit(points(spark, [row]), book, 3)
    c, n = sequential([np.array(v) for _, v in rows], 3)
    got_c, got_n = centers(book)
    np.testing.assert_allclose(got_c, c, rtol=1e-12)
    np.testing.assert_array_equal(got_n, n)


def test_batch_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    got_c, got_n = centers(codebook.hartigan_partial_fit(points(spark, list(enumerate(x.tolist()))).repartition(5), None, 4))
    c, n = x[:4].copy(), np.ones(4)
    cost = (n / (1 + n))[None, :] * ((x[4:, None, :] - c[None]) ** 2).sum(axis=2)
    near = cost.argmin(axis=1)
    for j in range(4):
        own = x[4:][near == j]
        c[j] = (c[j] + own.sum(axis=0)) / (1 + len(own))
        n[j] += len(own)
    np.testing.assert_allclose(got_c, c, rtol=1e-12)
    np.testing.assert_array_equal(got_n, n)


@pytest.mark.parametrize("n_batches", [2, 6])
def test_fit_counts_every_point_in_every_pass(spark, n_batches):
    rng = np.random.default_rng(5)
    df = points(spark, list(enumerate(rng.normal(size=(40, 3)).tolist())))
    book = codebook.hartigan_fit(df, 3, max_iter=2, n_batches=n_batches)
    assert centers(book)[1].sum() == 2 * 40
    again = codebook.hartigan_fit(df.repartition(3), 3, max_iter=2, n_batches=n_batches)
    np.testing.assert_allclose(centers(book)[0], centers(again)[0], rtol=1e-9)


def test_assign_breaks_ties_by_the_lowest_code(spark):
    book = spark.createDataFrame(
        [(0, [1.0, 0.0], 1.0, 0.5), (1, [-1.0, 0.0], 1.0, 0.5)], codebook.CODEBOOK
    )
    assert codebook.hartigan_assign(points(spark, [(0, [0.0, 0.0])]), book).first().code == 0


@pytest.mark.parametrize(("clusterer", "passes"), [(lambda p: codebook.kmeans_codebook(p, 2), 1), (None, 10)])
def test_codebook_fits_the_quantizer(spark, clusterer, passes):
    """Full k-means counts every point once; the default, mini-batch k-means, in each of its passes."""
    book = quantize.vq_fit(points(spark), clusterer, n_atoms=2)
    got_c, sizes = centers(book)
    assert sizes.sum() == passes * len(TINY)
    halves = [r.half_norm for r in book.orderBy("code").collect()]
    np.testing.assert_allclose(halves, 0.5 * (got_c**2).sum(axis=1))
    assert quantize.vq_encode_hard(points(spark), book).select("code").distinct().count() == 2


def test_codes_are_the_nearest_centers_whatever_the_block_size(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(50, 4)), rng.normal(size=(9, 4))
    df = points(spark, list(enumerate(x.tolist())))
    book = codebook.Codebook(c, np.ones(9)).frame(spark)
    order = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argsort(axis=1)
    for limit in (10_000_000, 8):
        monkeypatch.setattr(quantize, "MODEL_CELLS", limit)
        hard = {r.point_id: r.code for r in quantize.vq_encode_hard(df, book).collect()}
        assert hard == {n: order[n, 0] for n in range(50)}
        soft = quantize.vq_encode_soft(df, book, 3).collect()
        assert {(r.point_id, r["rank"]): r.code for r in soft} == {
            (n, q + 1): order[n, q] for n in range(50) for q in range(3)
        }


def test_indicators_and_histogram_agree(spark):
    book = codebook.Codebook(np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 1.0]]), np.ones(3)).frame(spark)
    sparse = quantize.vq_indicator_sparse(points(spark), book, 2)
    dense = quantize.vq_indicator_dense(points(spark), book, 2)
    cells = {(r.point_id, r.code) for r in sparse.collect()}
    assert {(r.point_id, j) for r in dense.collect() for j, hit in enumerate(r.indicator) if hit} == cells
    encoded = quantize.vq_encode_soft(points(spark).withColumn("track", F.col("point_id") % 2), book, 2)
    histogram = quantize.vq_histogram(encoded)
    assert histogram.agg(F.sum("n")).first()[0] == 2 * len(TINY)


def test_more_quantizers_than_codes(spark):
    book = codebook.Codebook(np.array([[0.0, 0.0], [4.0, 0.0]]), np.ones(2)).frame(spark)
    assert quantize.vq_indicator_sparse(points(spark), book, 5).count() == 2 * len(TINY)


@pytest.mark.parametrize("ids", [[0, 1, 1, 1], [0, None, None, 2], [7, 7, 7, 7]])
@pytest.mark.parametrize("learn", [codebook.hartigan_partial_fit, codebook.minibatch_kmeans_partial_fit])
def test_every_point_counts_whatever_its_id(spark, ids, learn):
    rows = [(i, [float(n), 1.0]) for n, i in enumerate(ids)]
    book = learn(spark.createDataFrame(rows, "point_id long, vec array<double>"), None, 2)
    got_c, sizes = centers(book)
    assert sizes.sum() == 4
    np.testing.assert_allclose((got_c * sizes[:, None]).sum(axis=0), [6.0, 4.0])


def test_passes_in_order_of_ids_have_equal_batches(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(21, 2))
    df = points(spark, list(enumerate(x.tolist()))).repartition(4)
    c, n = sequential(x, 3)
    got_c, got_n = centers(codebook.hartigan_fit(df, 3, max_iter=1, n_batches=21, shuffle=False))
    np.testing.assert_allclose(got_c, c, rtol=1e-12)
    np.testing.assert_array_equal(got_n, n)


@pytest.mark.parametrize("bad", [[1.0], [1.0, 2.0, 3.0], [1.0, float("nan")], [1.0, None]])
def test_vectors_of_another_shape_are_errors(spark, bad):
    book = codebook.Codebook(np.array([[0.0, 0.0], [4.0, 0.0]]), np.ones(2)).frame(spark)
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "point_id long, vec array<double>")
    for run in (quantize.vq_encode_hard, codebook.hartigan_assign):
        with pytest.raises(Exception, match="a vector has"):
            run(rows, book).collect()


def test_points_without_a_vector_are_left_out(spark):
    book = codebook.Codebook(np.array([[0.0, 0.0], [4.0, 0.0]]), np.ones(2)).frame(spark)
    rows = spark.createDataFrame([(0, None), (1, [4.0, 0.0])], "point_id long, vec array<double>")
    assert [r.code for r in quantize.vq_encode_hard(rows, book).collect()] == [1]
    assert centers(codebook.hartigan_partial_fit(rows, None, 1))[1].sum() == 1


def test_lowest_orders_alike_for_any_number():
    from tagweave.functions.vectors import lowest

    values = np.array([[3.0, np.nan, 1.0, 1.0, 2.0] + [9.0] * 20])
    for n in (1, 2, 5, 17, 25):
        assert lowest(values, n)[0].tolist()[:5] == [2, 3, 4, 0, 5][:n]


def blobs(n=240, width=5, k=12, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(k, width))[rng.integers(0, k, n)] * 4 + rng.normal(size=(n, width))
    x[5] = x[3]
    x[60:90] = x[7]  # a third of a batch is one vector
    return x


@pytest.mark.parametrize("shuffle", [True, False])
@pytest.mark.parametrize("learn", [codebook.hartigan_fit, codebook.minibatch_kmeans])
def test_sharded_codebooks_equal_whole_ones(spark, monkeypatch, learn, shuffle):
    """30 codes of 5 values with a limit of 100: two blocks."""
    df = points(spark, list(enumerate(blobs().tolist()))).repartition(5)
    whole = learn(df, 30, max_iter=1, n_batches=2, shuffle=shuffle)
    monkeypatch.setattr(codebook, "MODEL_CELLS", 100)
    parts = learn(df, 30, max_iter=1, n_batches=2, shuffle=shuffle)
    np.testing.assert_allclose(centers(parts)[0], centers(whole)[0], rtol=1e-9)
    np.testing.assert_array_equal(centers(parts)[1], centers(whole)[1])
    assert parts.schema["center"].dataType == whole.schema["center"].dataType


def test_sharded_seeds_assignment_and_incremental_batches(spark, monkeypatch):
    rows = list(enumerate(blobs().tolist()))
    df = points(spark, rows).repartition(5)
    seeds = codebook.codebook_seed(df, 30).orderBy("code").collect()
    book = codebook.hartigan_partial_fit(points(spark, rows[:20]), None, 30)
    grown = codebook.hartigan_partial_fit(points(spark, rows[20:]), book, 30)
    assigned = sorted((r.point_id, r.code) for r in codebook.hartigan_assign(df, grown).collect())
    monkeypatch.setattr(codebook, "MODEL_CELLS", 100)
    assert [(r.point_id, r.vec) for r in codebook.codebook_seed(df, 30).orderBy("code").collect()] == [(r.point_id, r.vec) for r in seeds]
    again = codebook.hartigan_partial_fit(points(spark, rows[:20]), None, 30)
    again = codebook.hartigan_partial_fit(points(spark, rows[20:]), again, 30)
    np.testing.assert_allclose(centers(again)[0], centers(grown)[0], rtol=1e-9)
    assert sorted((r.point_id, r.code) for r in codebook.hartigan_assign(df, again).collect()) == assigned


def test_a_sharded_book_needs_points(spark, monkeypatch):
    monkeypatch.setattr(codebook, "MODEL_CELLS", 1)
    empty = points(spark).where("point_id < 0")
    with pytest.raises(ValueError, match="no points"):
        codebook.hartigan_partial_fit(empty, None, 3)


def test_oversampled_seeds_do_not_hang_on_partitions_or_copies(spark):
    x = blobs(400)
    df = points(spark, list(enumerate(x.tolist())))
    one = codebook.kmeans_codebook(df.repartition(1), 8, max_iter=4)
    other = codebook.kmeans_codebook(df.repartition(7), 8, max_iter=4)
    np.testing.assert_allclose(centers(one)[0], centers(other)[0], rtol=1e-9)
    np.testing.assert_array_equal(centers(one)[1], centers(other)[1])
    assert centers(one)[1].sum() == 400
    spread = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert spread(centers(one)[0]) < 0.8 * spread(x[:8])
    copies = points(spark, [(n, [1.0, 2.0]) for n in range(50)] + [(99, [3.0, 4.0])])
    few = codebook.kmeans_codebook(copies, 5)
    assert sorted(zip(centers(few)[0].tolist(), centers(few)[1].tolist())) == [([1.0, 2.0], 50.0), ([3.0, 4.0], 1.0)]
    with pytest.raises(ValueError, match="no points"):
        codebook.kmeans_codebook(copies.where("point_id < 0"), 5)


def test_reclustering_prefers_heavy_and_far_candidates():
    spots = np.array([[0.0, 0.0], [0.1, 0.0], [10.0, 0.0], [0.0, 6.0]])
    got = codebook.reclustered(spots, np.array([50.0, 40.0, 1.0, 9.0]), 3, 0)
    np.testing.assert_array_equal(got, spots[[0, 3, 2]])
    moved = codebook.reclustered(spots, np.array([50.0, 40.0, 1.0, 9.0]), 3, 1)
    np.testing.assert_allclose(moved[0], [4 / 90, 0.0])
