import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F
from twin import Twin, arrays, expectations

from tagweave import session
from tagweave.functions import ordering
from tagweave.operators import counts
from tagweave.plans import factors, grid, online, pmf, scores
from tagweave.plans.components import Beta, Columns
from tagweave.plans.grid import Bucketed
from tagweave.plans.factors import PMFParams
from tagweave.session import stage

PARAMS = PMFParams(n_components=3, max_iter=4, tol=-1e9, random_state=3)


@pytest.fixture(scope="module")
def data(spark):
    """A 20 x 15 matrix with one empty row, one empty column, and a duplicated cell in its events."""
    x = np.random.default_rng(1).poisson(0.7, (20, 15)).astype(float)
    x[3], x[:, 7] = 0, 0
    x[0, 0] = 5
    cells = [(int(i), int(d), float(x[i, d])) for i, d in zip(*np.nonzero(x)) if (i, d) != (0, 0)]
    events = spark.createDataFrame([*cells, (0, 0, 2.0), (0, 0, 3.0)], "i long, d int, x double").repartition(5)
    matrix = stage(counts.count_matrix(events, "i", "d", F.col("x")), "matrix")
    rows = spark.range(20).withColumnRenamed("id", "i")
    cols = spark.range(15).select(F.col("id").cast("int").alias("d"))
    return x, matrix, rows, cols


@pytest.mark.parametrize(("block", "steps"), [(None, 4), (4, 3)])
def test_fit_equals_the_dense_updates(data, block, steps):
    x, matrix, rows, cols = data
    params = dataclasses.replace(PARAMS, max_iter=steps)
    twin = Twin(x, rows, cols, params)
    bounds = twin.fit()
    model = pmf.pmf_fit(matrix, rows, cols, params, block)
    np.testing.assert_allclose(arrays(model.theta, "i", "g"), twin.g, rtol=1e-9)
    np.testing.assert_allclose(arrays(model.theta, "i", "r"), twin.r, rtol=1e-9)
    np.testing.assert_allclose(arrays(model.beta, "d", "g").T, twin.gb, rtol=1e-9)
    np.testing.assert_allclose(arrays(model.beta, "d", "r").T, twin.rb, rtol=1e-9)
    assert model.c == pytest.approx(twin.c, rel=1e-9)
    np.testing.assert_allclose(model.bounds, bounds, rtol=1e-9)
    assert all(b > a for a, b in zip(bounds, bounds[1:]))


@pytest.mark.parametrize(("block", "tol"), [(None, 0.5), (None, 0.02), (6, 0.5)])
def test_stops_like_the_dense_loop(data, block, tol):
    x, matrix, rows, cols = data
    params = dataclasses.replace(PARAMS, tol=tol, max_iter=12)
    twin = Twin(x, rows, cols, params)
    bounds = twin.fit()
    assert 2 <= len(bounds) < 12
    model = pmf.pmf_fit(matrix, rows, cols, params, block)
    np.testing.assert_allclose(model.bounds, bounds, rtol=1e-9)
    np.testing.assert_allclose(arrays(model.theta, "i", "g"), twin.g, rtol=1e-9)
    np.testing.assert_allclose(arrays(model.beta, "d", "g").T, twin.gb, rtol=1e-9)


def test_stop_rule():
    assert not grid.stopped(-5.0, -np.inf, 1e-3)
    assert grid.stopped(-6.0, -5.0, 1e-3)
    assert grid.stopped(-5.0, -5.0, 1e-3)
    assert not grid.stopped(-4.0, -5.0, 1e-3)


def test_shares_add_up_to_the_counts(data):
    x, matrix, rows, cols = data
    theta = pmf.pmf_fit(matrix, rows, cols, PARAMS).theta
    np.testing.assert_allclose((arrays(theta, "i", "g") - PARAMS.a).sum(axis=1), x.sum(axis=1), atol=1e-9)
    assert (arrays(theta, "i", "g")[3] == PARAMS.a).all()


@pytest.mark.parametrize(("block", "attr"), [(None, "e"), (None, "el"), (4, "e")])
def test_fold_in(data, block, attr):
    x, matrix, rows, cols = data
    params = dataclasses.replace(PARAMS, max_iter=2)
    beta = stage(factors.init_factors(cols, "d", "beta", params), "beta")
    twin = Twin(x, rows, cols, params)
    twin.start()
    twin.loop(x, learn_beta=False)
    folded = pmf.pmf_transform(matrix, rows, beta, params, attr, block)
    e, el = expectations(twin.g, twin.r)
    np.testing.assert_allclose(arrays(folded, "i", attr), {"e": e, "el": el}[attr], rtol=1e-9)


def test_fold_in_errors(data):
    _, matrix, rows, cols = data
    beta = factors.init_factors(cols.where("d < 9"), "d", "beta", PARAMS)
    with pytest.raises(ValueError):
        pmf.pmf_transform(matrix, rows, None, PARAMS)
    with pytest.raises(ValueError, match="dimensions"):
        pmf.pmf_transform(matrix, rows, beta, PARAMS)
    with pytest.raises(ValueError):
        pmf.pmf_transform(matrix.where("d < 9"), rows, beta, PARAMS, attr="c")
    with pytest.raises(ValueError):
        factors.learning_rate(PARAMS)


def test_small_chunks_change_nothing(data, monkeypatch):
    """In this process, as tasks have modules of their own: one scan of all rows in chunks of any size."""
    _, matrix, rows, cols = data
    columns = Columns(cols, PARAMS)
    cells = grid.build(matrix, rows, columns, PARAMS)
    packed = cells.packed().select("i", F.col("parts")[0]["cols"].alias("cols"), F.col("parts")[0]["xs"].alias("xs"), "g", "r")
    table = packed.withColumn("acc", F.lit(None).cast("array<double>")).toArrow()
    beta = Beta.of(factors.init_shapes_rates(cols, "d", "beta", PARAMS), columns, PARAMS)

    class Held:
        value = np.exp(beta.get(0).el)

    class Frame:
        """Stands in for the joined table: runs the task here."""

        def __init__(self, frame):
            self.frame, self.schema = frame, frame.schema

        def join(self, *_):
            return self

        def select(self, *_):
            return self

        def hint(self, _):
            return self

        def mapInArrow(self, task, _):
            return list(task(table.to_batches()))

    def told():
        state = Frame(cells.started)
        return grid.scan(state, state, Held, PARAMS, None, np.full(3, 2.0), True, True)

    whole = told()
    monkeypatch.setattr(grid, "CHUNK_CELLS", 30)
    for one, other in zip(whole, told(), strict=True):
        for name in ("g", "s"):
            a, b = one.column(name).flatten().to_numpy(), other.column(name).flatten().to_numpy()
            np.testing.assert_allclose(a, b, rtol=1e-9)
    cells.drop()


@pytest.mark.parametrize("block", [None, 4])
def test_counts_are_written_once_and_nothing_stays(spark, data, block, tmp_path, monkeypatch):
    """A step writes as much for a matrix with a hundred times the counts; what is left is the returned state."""
    written = {}
    made = Bucketed.__init__

    def noted(self, frame, label, buckets, partition=None):
        made(self, frame, label, buckets, partition)
        folder = tmp_path / self.path.rsplit("/", 1)[-1]
        written.setdefault(label, []).append(sum(f.stat().st_size for f in folder.rglob("*.parquet")))

    monkeypatch.setattr(session, "work_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(Bucketed, "__init__", noted)
    sizes = {}
    rows, cols = spark.range(300).withColumnRenamed("id", "i"), spark.range(15).select(F.col("id").cast("int").alias("d"))
    for share in (1, 15):
        cells = rows.crossJoin(cols).where(F.col("d") < share).select("i", "d", (F.rand(1) + 1).alias("x"))
        written.clear()
        pmf.pmf_fit(cells, rows, cols, PARAMS, block)
        assert len(written["cells"]) == 1
        sizes[share] = (written["cells"][0], max(written["state"]))
    assert sizes[15][0] > 1.3 * sizes[1][0] and sizes[15][1] < 1.25 * sizes[1][1]
    left = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert left.count("cells") == 0 and left.count("state") == 2, left
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("cells_", "state_"))]


def test_cells_and_state_meet_without_a_shuffle(spark, data):
    _, matrix, rows, cols = data
    columns = Columns(cols, PARAMS)
    cells = grid.build(matrix, rows, columns, PARAMS)
    state = cells.start()
    shared = spark.sparkContext.broadcast(np.ones((15, 3)))
    scanned = grid.scan(cells.block(0), grid.rows_of(state), shared, PARAMS, None, np.ones(3), True, True)
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan, plan
    state.drop()
    cells.drop()


@pytest.mark.parametrize("kind", ["string", "long"])
def test_columns_of_any_id_are_numbered(spark, data, kind):
    """Ids that are not 0 .. D-1 give the model of their draws."""
    x, matrix, rows, cols = data
    name = F.concat(F.lit("c"), F.lpad("d", 2, "0")) if kind == "string" else F.col("d") * 7 + 100
    renamed, named = matrix.withColumn("d", name), cols.select(name.alias("d"))
    twin = Twin(x, rows, named, PARAMS)
    bounds = twin.fit()
    model = pmf.pmf_fit(renamed, rows, named, PARAMS, block=6)
    np.testing.assert_allclose(model.bounds, bounds, rtol=1e-9)
    np.testing.assert_allclose(arrays(model.beta, "d", "g").T, twin.gb, rtol=1e-9)
    assert model.beta.schema["d"].dataType == named.schema["d"].dataType


def test_large_components_are_joined_with_salt(data, monkeypatch):
    """No broadcast, and the hot rows and columns of the matrix cut into pieces."""
    _, matrix, rows, cols = data
    beta = stage(factors.init_factors(cols, "d", "beta", PARAMS), "beta")
    theta = stage(factors.init_factors(rows, "i", "theta", PARAMS), "theta")
    plain = factors.update_beta(matrix, cols, theta, beta, PARAMS)
    monkeypatch.setattr(factors, "MODEL_CELLS", 1)
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 1)
    monkeypatch.setattr(ordering, "MAX_HOT_KEYS", 40)
    hot = factors.hot_ids(matrix, beta)
    assert hot["hot_rows"].count() and hot["hot_cols"].count()
    salted = factors.update_beta(matrix, cols, theta, beta, PARAMS, **hot)
    np.testing.assert_allclose(arrays(salted, "d", "g"), arrays(plain, "d", "g"), rtol=1e-9)


@pytest.mark.parametrize("block", [None, 4, 1])
def test_scores_and_best_columns(data, block):
    _, matrix, rows, cols = data
    theta = stage(factors.init_factors(rows, "i", "theta", PARAMS), "theta")
    beta = stage(factors.init_factors(cols, "d", "beta", PARAMS), "beta")
    dense = arrays(theta, "i", "e") @ arrays(beta, "d", "e").T
    got = {(r.i, r.d): r.score for r in scores.score_tags(theta, beta, block=block).collect()}
    assert len(got) == dense.size
    np.testing.assert_allclose([got[i, d] for i in range(20) for d in range(15)], dense.ravel(), rtol=1e-12)
    for top in (4, 40):
        best = scores.score_tags(theta, beta, top, block).collect()
        order = np.argsort(-dense, axis=1, kind="stable")[:, :top]
        assert {(r.i, r.d) for r in best} == {(i, d) for i in range(20) for d in order[i]}


@pytest.mark.parametrize("block", [None, 100, 37])
@pytest.mark.parametrize("named", [False, True])
def test_best_columns_of_skewed_norms_read_few(spark, block, named):
    """Exact with ties, copies, zero rows and columns; most rows are done long before all columns are read."""
    rng = np.random.default_rng(2)
    x, c = rng.gamma(1.0, size=(60, 6)), rng.gamma(1.0, size=(600, 6)) * (np.arange(600, 0, -1)[:, None] / 100.0) ** 3
    x[5], x[6], c[7], c[300], c[599] = 0, x[4], c[2], 0, c[3]
    c = c[rng.permutation(600)]
    name = (lambda n: f"t{n:04d}") if named else int
    theta = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, e array<double>").repartition(3)
    beta = spark.createDataFrame([(name(d), v.tolist()) for d, v in enumerate(c)], f"d {'string' if named else 'int'}, e array<double>").repartition(3)
    found = scores.top_columns(theta, beta, 5, block).collect()
    dense = x @ c.T
    order = np.lexsort((np.broadcast_to(np.arange(600), dense.shape), -np.round(dense, 9)), axis=1)[:, :5]
    assert {r.i: [h.d for h in r.hits] for r in found} == {i: [name(d) for d in order[i]] for i in range(60)}
    share = sum(r.read for r in found if r.i != 5) / (59 * 600)
    assert share < (0.6 if block is None else 0.4), share
    assert [r.read for r in found if r.i == 5] == [600]


@pytest.mark.parametrize("shuffle", [True, False])
def test_minibatches(data, shuffle):
    rows = data[2]
    params = dataclasses.replace(PARAMS, batch_size=6, shuffle=shuffle)
    split = {r.i: r.batch for r in online.minibatch_split(rows, params).collect()}
    assert sorted(split.values()) == [0] * 6 + [1] * 6 + [2] * 6 + [3] * 2
    if not shuffle:
        assert split == {i: i // 6 for i in range(20)}
    else:
        other = {r.i: r.batch for r in online.minibatch_split(rows.repartition(3), params, n_pass=1).collect()}
        assert split != other


@pytest.mark.parametrize(("block", "size", "n_pass"), [(None, 8, 2), (6, 14, 1)])
def test_online_fit_equals_the_dense_steps(data, block, size, n_pass):
    x, matrix, rows, cols = data
    params = dataclasses.replace(PARAMS, max_iter=2 if block is None else 1, batch_size=size, n_pass=n_pass)
    twin = Twin(x, rows, cols, params)
    history = []
    for n_pass in range(params.n_pass):
        split = {r.i: r.batch for r in online.minibatch_split(rows, params, n_pass).collect()}
        for n in range(-(-20 // size)):
            which = [i for i in range(20) if split[i] == n]
            # the step number restarts in each pass and the scale uses the nominal batch size
            history.append((n_pass, n, twin.gradient_step(which, (n + 2.0) ** -0.6, 30 / size)))
    model = online.online_pmf_fit(matrix, rows, cols, params, est_total=30, block=block)
    assert [h[:2] for h in model.history] == [h[:2] for h in history]
    np.testing.assert_allclose([h[2] for h in model.history], [h[2] for h in history], rtol=1e-9)
    np.testing.assert_allclose(arrays(model.beta, "d", "g").T, twin.gb, rtol=1e-9)
    np.testing.assert_allclose(arrays(model.beta, "d", "r").T, twin.rb, rtol=1e-9)


def test_whole_batch_with_full_rate_is_the_batch_update(data):
    x, matrix, rows, cols = data
    params = dataclasses.replace(PARAMS, max_iter=1)
    beta = factors.init_factors(cols, "d", "beta", params)
    moved, _ = online.pmf_partial_fit(matrix, rows, beta, 1.0, 1.0, params)
    fitted = pmf.pmf_fit(matrix, rows, cols, params)
    np.testing.assert_allclose(arrays(moved, "d", "g"), arrays(fitted.beta, "d", "g"), rtol=1e-9)
    np.testing.assert_allclose(arrays(moved, "d", "r"), arrays(fitted.beta, "d", "r"), rtol=1e-9)


def test_learning_rate():
    assert factors.learning_rate(PARAMS, 3) == pytest.approx(4.0**-0.6)
    assert factors.learning_rate(PARAMS, 3, rho=0.25) == 0.25


@pytest.mark.parametrize("block", [None, 1])
@pytest.mark.parametrize(
    ("cell", "row", "col"), [((99, 0, 5.0), None, None), ((1, 7, 5.0), None, None), (None, 1, None), (None, None, 0), ((None, 0, 2.0), None, None)]
)
def test_ids_are_checked_alike_in_any_number_of_blocks(spark, block, cell, row, col):
    counts = [(1, 0, 2.0), (2, 1, 1.0)] + ([cell] if cell else [])
    rows = [(1,), (2,)] + ([(row,)] if row is not None else [])
    cols = [(0,), (1,)] + ([(col,)] if col is not None else [])
    frames = (
        spark.createDataFrame(counts, "i long, d int, x double"), spark.createDataFrame(rows, "i long"), spark.createDataFrame(cols, "d int")
    )
    with pytest.raises(ValueError, match="ids|dimensions"):
        pmf.pmf_fit(*frames, PMFParams(n_components=2, max_iter=1), block=block)
