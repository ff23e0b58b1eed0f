import numpy as np
import pytest
from pyspark.sql import functions as F
from twin import arrays

from tagweave import session
from tagweave.operators import codebook
from tagweave.plans import factors, online
from tagweave.plans.factors import PMFParams
from tagweave.streaming import feeds, keyed

PARAMS = PMFParams(n_components=2, max_iter=2, tol=-1e9, random_state=1, batch_size=10)


def test_stream_equals_batch_calls_and_replay_changes_nothing(spark, tmp_path):
    rng = np.random.default_rng(2)
    cols = spark.range(4).select(F.col("id").cast("int").alias("d")).cache()
    parts = []
    for n in range(3):
        rows = [(int(i), int(d), 1.0) for i, d in zip(rng.integers(0, 12, 30), rng.integers(0, 4, 30))]
        part = spark.createDataFrame(rows, "i long, d int, x double")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        parts.append(part)
    stream = spark.readStream.schema("i long, d int, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    model = f"{tmp_path}/model"
    feeds.stream_pmf(stream, model, cols, 30, PARAMS).awaitTermination()

    beta = factors.init_factors(cols, "d", "beta", PARAMS)
    for n, part in enumerate(parts):
        matrix = part.groupBy("i", "d").agg(F.sum("x").alias("x"))
        rho = factors.learning_rate(PARAMS, n + 1)
        beta, _ = online.pmf_partial_fit(matrix, matrix.select("i").distinct(), beta, 3.0, rho, PARAMS)
    got = feeds.latest(spark, model)
    np.testing.assert_allclose(arrays(got, "d", "g"), arrays(beta, "d", "g"), rtol=1e-9)

    feeds.learn_counts(parts[2], 2, model, cols, 3.0, PARAMS)
    again = feeds.latest(spark, model)
    np.testing.assert_allclose(arrays(again, "d", "g"), arrays(beta, "d", "g"), rtol=1e-9)

    feeds.learn_counts(parts[2].where("i < 0"), 3, model, cols, 3.0, PARAMS)
    np.testing.assert_array_equal(arrays(feeds.latest(spark, model), "d", "g"), arrays(again, "d", "g"))


def test_stream_codebook_equals_partial_fits(spark, tmp_path):
    rng = np.random.default_rng(3)
    book = None
    for n in range(3):
        rows = [(100 * n + j, v) for j, v in enumerate(rng.normal(size=(20, 3)).tolist())]
        part = spark.createDataFrame(rows, "point_id long, vec array<double>")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        book = codebook.hartigan_partial_fit(part, book, 4)
    stream = spark.readStream.schema("point_id long, vec array<double>").option("maxFilesPerTrigger", 1)
    model = f"{tmp_path}/model"
    feeds.stream_codebook(stream.parquet(f"{tmp_path}/in"), model, 4).awaitTermination()
    got = feeds.latest(spark, model)
    np.testing.assert_allclose(arrays(got, "code", "center"), arrays(book, "code", "center"), rtol=1e-12)
    np.testing.assert_array_equal(arrays(got, "code", "size"), arrays(book, "code", "size"))
    assert got.agg(F.sum("size")).first()[0] == 60


def test_a_first_batch_without_points_is_an_error(spark, tmp_path):
    empty = spark.createDataFrame([], "point_id long, vec array<double>")
    with pytest.raises(ValueError):
        feeds.learn_points(empty, 0, str(tmp_path), 2)


def test_only_the_newest_versions_stay(spark, tmp_path):
    rng = np.random.default_rng(6)
    for n in range(5):
        rows = [(10 * n + j, v) for j, v in enumerate(rng.normal(size=(10, 2)).tolist())]
        feeds.learn_points(spark.createDataFrame(rows, "point_id long, vec array<double>"), n, str(tmp_path), 2)
    assert feeds.versions(spark, str(tmp_path)) == [2, 3, 4]
    assert feeds.latest(spark, str(tmp_path)).agg(F.sum("size")).first()[0] == 50


def test_a_stream_goes_on_with_another_trigger(spark, tmp_path):
    rows = [(j, [float(j), 0.0]) for j in range(8)]
    spark.createDataFrame(rows, "point_id long, vec array<double>").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("point_id long, vec array<double>").parquet(f"{tmp_path}/in")
    query = feeds.stream_codebook(stream, f"{tmp_path}/model", 2, trigger={"processingTime": "1 second"})
    query.processAllAvailable()
    assert query.isActive and feeds.latest(spark, f"{tmp_path}/model").agg(F.sum("size")).first()[0] == 8
    query.stop()


def test_rows_in_pieces_add_up_in_keyed_state(spark, tmp_path):
    """A row's counts come in three micro-batches; the stream equals batch calls with the counts so far of the rows touched."""
    rng = np.random.default_rng(5)
    cols = spark.range(4).select(F.col("id").cast("int").alias("d")).cache()
    beta = factors.init_factors(cols, "d", "beta", PARAMS)
    so_far = {}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("i long, d int, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    model, place = f"{tmp_path}/model", f"{tmp_path}/state"
    for n in range(3):
        rows = [(int(i), int(d), 1.0) for i, d in zip(rng.integers(0, 9, 20), rng.integers(0, 4, 20))]
        spark.createDataFrame(rows, "i long, d int, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # started anew for every piece: the state is read back from its checkpoint
        feeds.stream_pmf(stream, model, cols, 30, PARAMS, checkpoint=place, whole=True).awaitTermination()
        for i, d, x in rows:
            so_far[i, d] = so_far.get((i, d), 0.0) + x
        touched = {i for i, *_ in rows}
        matrix = spark.createDataFrame([(i, d, x) for (i, d), x in so_far.items() if i in touched], "i long, d int, x double")
        rho = factors.learning_rate(PARAMS, n + 1)
        beta, _ = online.pmf_partial_fit(matrix, matrix.select("i").distinct(), beta, 3.0, rho, PARAMS)
    before = arrays(feeds.latest(spark, model), "d", "g")
    np.testing.assert_allclose(before, arrays(beta, "d", "g"), rtol=1e-9)
    feeds.stream_pmf(stream, model, cols, 30, PARAMS, checkpoint=place, whole=True).awaitTermination()  # nothing new
    np.testing.assert_array_equal(arrays(feeds.latest(spark, model), "d", "g"), before)


def test_micro_batches_leave_no_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "work_dir", lambda _: str(tmp_path / "work"))
    cols = spark.range(4).select(F.col("id").cast("int").alias("d")).cache()
    rng = np.random.default_rng(7)
    left = []
    for n in range(5):
        rows = [(int(i), int(d), 1.0) for i, d in zip(rng.integers(0, 12, 30), rng.integers(0, 4, 30))]
        feeds.learn_counts(spark.createDataFrame(rows, "i long, d int, x double"), n, f"{tmp_path}/model", cols, 3.0, PARAMS)
        vectors = [(j, v) for j, v in enumerate(rng.normal(size=(10, 2)).tolist())]
        feeds.learn_points(spark.createDataFrame(vectors, "point_id long, vec array<double>"), n, f"{tmp_path}/book", 2)
        left.append(len(list((tmp_path / "work").iterdir())))
    assert len(set(left)) == 1 and left[0] == 0, left


class Held:
    """A state value that counts the calls on it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema, ttl):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def test_a_row_costs_two_calls_on_its_state_however_many_cells_it_has():
    held = Held()
    counts = keyed.RowCounts(None)
    counts.init(held)
    list(counts.handleInputRows((7,), iter([(7, d, 1.0) for d in range(50)]), Clock(0)))
    got = list(counts.handleInputRows((7,), iter([(7, 3, 2.0), (7, 60, None), (7, None, 1.0), (7, 3, float("nan"))]), Clock(1)))
    assert held.calls == 4
    assert {r.d: r.x for r in got} == {**dict.fromkeys(range(50), 1.0), 3: 3.0, 60: 0.0} and {r.i for r in got} == {7}


def test_a_count_that_got_no_more_is_cleared_alone():
    held = Held()
    counts = keyed.RowCounts(100)
    counts.init(held)
    list(counts.handleInputRows((7,), iter([(7, 0, 1.0), (7, 1, 1.0)]), Clock(0)))
    assert [tuple(r) for r in counts.handleInputRows((7,), iter([(7, 1, 1.0)]), Clock(60))] == [(7, 0, 1.0), (7, 1, 2.0)]
    assert [tuple(r) for r in counts.handleInputRows((7,), iter([(7, 2, 5.0)]), Clock(130))] == [(7, 1, 2.0), (7, 2, 5.0)]
