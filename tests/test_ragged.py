import random

import pytest

from tagweave.operators import ragged
from tagweave.sources import tracks

OFFSETS = [(0, 0), (1, 2), (2, 2), (3, 5)]


def flat(spark, n):
    return spark.createDataFrame([(p, float(10 + p)) for p in range(n)], "pos long, value double").repartition(3)


def offsets(spark, rows):
    return spark.createDataFrame(rows, "song_idx long, start long")


def test_slices_with_an_empty_song_and_an_open_end(spark):
    songs = ragged.ragged_slice(offsets(spark, OFFSETS), flat(spark, 7)).collect()
    assert {r.song_idx: list(r.value) for r in songs} == {
        0: [10.0, 11.0], 1: [], 2: [12.0, 13.0, 14.0], 3: [15.0, 16.0]
    }


def test_single_song_runs_to_the_end(spark):
    songs = ragged.ragged_slice(offsets(spark, [(0, 0)]), flat(spark, 3)).collect()
    assert [list(r.value) for r in songs] == [[10.0, 11.0, 12.0]]


def test_last_songs_may_be_empty_and_early_values_unowned(spark):
    songs = ragged.ragged_slice(offsets(spark, [(0, 1), (1, 3), (2, 3)]), flat(spark, 3)).collect()
    assert {r.song_idx: list(r.value) for r in songs} == {0: [11.0, 12.0], 1: [], 2: []}


def test_slices_in_order_are_the_flat_array(spark):
    rows = ragged.slice_long(offsets(spark, OFFSETS), flat(spark, 7)).orderBy("song_idx", "j").collect()
    assert [r.value for r in rows] == [10.0 + p for p in range(7)]


@pytest.mark.parametrize("n", range(4))
def test_one_song_equals_its_slice(spark, n):
    every = {r.song_idx: r.value for r in ragged.ragged_slice(offsets(spark, OFFSETS), flat(spark, 7)).collect()}
    assert ragged.slice_one(offsets(spark, OFFSETS), flat(spark, 7), n).first().value == every[n]


def test_one_song_out_of_range(spark):
    with pytest.raises(IndexError):
        ragged.slice_one(offsets(spark, OFFSETS), flat(spark, 7), 4)


def test_one_song_with_gaps_in_the_numbers(spark):
    gaps = [(0, 0), (2, 2), (5, 2), (9, 5)]
    every = {r.song_idx: r.value for r in ragged.ragged_slice(offsets(spark, gaps), flat(spark, 7)).collect()}
    for n in every:
        assert ragged.slice_one(offsets(spark, gaps), flat(spark, 7), n).first().value == every[n]
    with pytest.raises(IndexError):
        ragged.slice_one(offsets(spark, gaps), flat(spark, 7), 1)


def test_a_long_song_comes_in_pieces(spark):
    rows = [(0, 0), (1, 300), (2, 301), (3, 2000)]
    pieces = ragged.ragged_chunks(offsets(spark, rows), flat(spark, 2005), 250).collect()
    got = {}
    for r in sorted(pieces, key=lambda r: (r.song_idx, r.chunk)):
        assert len(r.value) <= 250
        got.setdefault(r.song_idx, []).extend(r.value)
    assert got == {n: [10.0 + p for p in range(a, b)] for n, (a, b) in enumerate([(0, 300), (300, 301), (301, 2000), (2000, 2005)])}


def test_offsets_of_lengths(spark):
    lengths = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 2)], "song_idx long, n long")
    assert sorted(tuple(r) for r in ragged.offsets_of(lengths, "song_idx", "n").collect()) == OFFSETS


def test_zip_and_explode(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [0.5, 0.25])], "id long, term array<string>, weight array<double>")
    assert [tuple(r) for r in ragged.zip_terms(df, "id", ["term", "weight"]).collect()] == [(1, "a", 0.5), (1, "b", 0.25)]
    assert [tuple(r) for r in ragged.explode_segments(df, "id", "weight").collect()] == [(1, 0, 0.5), (1, 1, 0.25)]


def test_archive_getters(spark, tmp_path):
    groups = {
        "metadata": "song_idx long, artist_name string, idx_artist_terms long, idx_similar_artists long",
        "analysis": "song_idx long, tempo double, idx_segments_timbre long",
        "musicbrainz": "song_idx long, year int, idx_artist_mbtags long",
    }
    rows = {
        "metadata": [(0, "ann", 0, 0), (1, "bob", 2, 1)],
        "analysis": [(0, 120.0, 0), (1, 90.0, 1)],
        "musicbrainz": [(0, 1999, 0), (1, 2001, 0)],
    }
    for group, schema in groups.items():
        spark.createDataFrame(rows[group], schema).write.parquet(f"{tmp_path}/{group}")
    arrays = {
        "artist_terms": (["rock", "jazz", "folk"], "string"),
        "artist_terms_freq": ([0.9, 0.1, 0.5], "double"),
        "segments_timbre": ([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], "array<double>"),
        "artist_mbtags_count": ([7, 8], "int"),
    }
    for name, (values, kind) in arrays.items():
        spark.createDataFrame(list(enumerate(values)), f"pos long, value {kind}").write.parquet(f"{tmp_path}/{name}")
    archive = tracks.Archive(spark, str(tmp_path))
    assert tracks.get_num_songs(archive).first()[0] == 2
    assert tracks.get_artist_name(archive).first().artist_name == "ann"
    assert tracks.get_tempo(archive, 1).first().tempo == 90.0
    assert tracks.get_year(archive, 1).first().year == 2001
    assert tracks.get_artist_terms_freq(archive, 0).first().value == [0.9, 0.1]
    assert tracks.get_artist_terms(archive, 1).first().value == ["folk"]
    assert tracks.get_segments_timbre(archive, 1).first().value == [[3.0, 4.0], [5.0, 6.0]]
    assert tracks.get_artist_mbtags_count(archive, 0).first().value == []
    every = {r.song_idx: r.value for r in tracks.get_artist_mbtags_count(archive, None).collect()}
    assert every == {0: [], 1: [7, 8]}
    assert archive.tracks().count() == 2
    with pytest.raises(AttributeError):
        tracks.get_nothing


def test_every_getter_exists():
    names = [n for group in (tracks.SCALARS, tracks.ARRAYS) for part in group.values() for n in part]
    assert len(names) == len(set(names)) == 33 + 21
    assert all(callable(getattr(tracks, f"get_{n}")) for n in names)


def test_save_and_scan(spark, tmp_path):
    df = spark.createDataFrame([(n, f"p{n % 2}") for n in range(20)], "v long, part string")
    tracks.save(df, f"{tmp_path}/saved", ["part"])
    for cache in (False, True):
        back = tracks.scan_saved(spark, f"{tmp_path}/saved", cache)
        assert sorted((r.v, r.part) for r in back.collect()) == sorted((r.v, r.part) for r in df.collect())


@pytest.mark.parametrize("batch", [3, 10_000])
@pytest.mark.parametrize("first", [0, 5])
def test_merge_across_parts_and_batches(spark, batch, first):
    """Songs of any length, several at one offset, values before the first offset, at every edge of parts and batches."""
    rng = random.Random(batch + first)
    sizes = [rng.choice([0, 0, 1, 2, 3, 11]) for _ in range(90)] + [150, 0, 0, 4, 60]
    starts, at = [], first
    for size in sizes:
        starts.append(at)
        at += size
    rows = [(n, start) for n, start in enumerate(starts)]
    table = spark.createDataFrame([(p, float(p)) for p in range(at)], "pos long, value double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.song_idx: r.value for r in ragged.ragged_slice(offsets(spark, rows), table).collect()}
        long = sorted((r.song_idx, r.j, r.value) for r in ragged.slice_long(offsets(spark, rows), table).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {n: [float(p) for p in range(start, start + sizes[n])] for n, start in rows}
    assert long == [(n, j, float(start + j)) for n, start in rows for j in range(sizes[n])]


def test_values_are_shuffled_once_and_never_joined(spark):
    plan = ragged.slice_long(offsets(spark, OFFSETS), flat(spark, 7))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    above = plan[: plan.index("RepartitionByExpression")]
    assert "Join" not in above and "Generate" not in above


def test_values_of_any_type(spark):
    table = spark.createDataFrame([(0, "a", [1]), (1, None, [2, 3]), (2, "c", None)], "pos long, value string, other array<int>")
    got = {r.song_idx: r.value for r in ragged.ragged_slice(offsets(spark, [(0, 0), (1, 2)]), table.select("pos", "value")).collect()}
    assert got == {0: ["a", None], 1: ["c"]}
    lists = table.select("pos", table["other"].alias("value"))
    assert {r.song_idx: r.value for r in ragged.ragged_slice(offsets(spark, [(0, 0), (1, 2)]), lists).collect()} == {0: [[1], [2, 3]], 1: [None]}


def test_nothing_to_slice(spark):
    assert ragged.ragged_slice(offsets(spark, [(0, 0), (1, 0)]), flat(spark, 0)).orderBy("song_idx").collect() == [(0, []), (1, [])]
    assert ragged.ragged_slice(offsets(spark, [(0, 0)]).where("false"), flat(spark, 4)).collect() == []


def test_held_tables_are_released(spark, tmp_path):
    tracks.save(flat(spark, 5), f"{tmp_path}/held")
    with tracks.held(spark, f"{tmp_path}/held") as df:
        assert df.count() == 5 and df.storageLevel.useMemory
    assert not df.storageLevel.useMemory
