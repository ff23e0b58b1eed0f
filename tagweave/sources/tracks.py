"""The song archive as tables: field names, getters, joining the groups, saving and scanning."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.operators import ragged

# The attributes of a song in the archive, by group.
SCALARS = {
    "metadata": [
        "artist_familiarity", "artist_hotttnesss", "artist_id", "artist_mbid", "artist_playmeid",
        "artist_7digitalid", "artist_latitude", "artist_longitude", "artist_location", "artist_name",
        "release", "release_7digitalid", "song_id", "song_hotttnesss", "title", "track_7digitalid",
    ],
    "analysis": [
        "analysis_sample_rate", "audio_md5", "danceability", "duration", "end_of_fade_in", "energy",
        "key", "key_confidence", "loudness", "mode", "mode_confidence", "start_of_fade_out", "tempo",
        "time_signature", "time_signature_confidence", "track_id",
    ],
    "musicbrainz": ["year"],
}
ARRAYS = {
    "metadata": ["similar_artists", "artist_terms", "artist_terms_freq", "artist_terms_weight"],
    "analysis": [
        "segments_start", "segments_confidence", "segments_pitches", "segments_timbre",
        "segments_loudness_max", "segments_loudness_max_time", "segments_loudness_start",
        "sections_start", "sections_confidence", "beats_start", "beats_confidence", "bars_start",
        "bars_confidence", "tatums_start", "tatums_confidence",
    ],
    "musicbrainz": ["artist_mbtags", "artist_mbtags_count"],
}
# Some arrays share the offsets of another one.
SHARED_OFFSETS = {
    "artist_terms_freq": "artist_terms",
    "artist_terms_weight": "artist_terms",
    "artist_mbtags_count": "artist_mbtags",
}


def load_tracks(metadata: DataFrame, analysis: DataFrame, musicbrainz: DataFrame,
                on: tuple[str, str] = ("song_idx", "song_idx")) -> DataFrame:
    """One row per track from the three groups; ``on`` names the key to analysis and to musicbrainz."""
    return metadata.join(analysis, on[0]).join(musicbrainz, on[1])


def count_songs(songs: DataFrame) -> DataFrame:
    return songs.agg(F.count("*").alias("n_songs"))


def project_track_scalars(tracks: DataFrame, fields: list[str], key: str = "song_idx") -> DataFrame:
    return tracks.select(key, *fields)


def select_song_at(tracks: DataFrame, song_idx: int = 0, key: str = "song_idx") -> DataFrame:
    """The song at a stored position; the filter reaches the scan."""
    return tracks.where(F.col(key) == song_idx)


class Archive:
    """A folder with one table per group (``metadata``, ``analysis``, ``musicbrainz``) and one per array.

    Group tables have ``song_idx``, their scalar columns and ``idx_<array>`` offsets; an array table
    named after the array has ``pos`` and ``value``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def tracks(self) -> DataFrame:
        return load_tracks(*[self.table(group) for group in SCALARS])

    def num_songs(self) -> DataFrame:
        return count_songs(self.table("metadata"))

    def scalar(self, name: str, song_idx: int | None = 0) -> DataFrame:
        """One attribute of one song, or of all songs with ``song_idx=None``."""
        songs = self.table(_group_of(SCALARS, name))
        if song_idx is not None:
            songs = select_song_at(songs, song_idx)
        return project_track_scalars(songs, [name])

    def array(self, name: str, song_idx: int | None = 0) -> DataFrame:
        """One array of one song, or of all songs with ``song_idx=None``."""
        offset = f"idx_{SHARED_OFFSETS.get(name, name)}"
        offsets = self.table(_group_of(ARRAYS, name)).select("song_idx", F.col(offset).alias("start"))
        flat = self.table(name)
        if song_idx is not None:
            return ragged.slice_one(offsets, flat, song_idx)
        return ragged.ragged_slice(offsets, flat)


def _group_of(groups: dict[str, list[str]], name: str) -> str:
    for group, names in groups.items():
        if name in names:
            return group
    raise KeyError(name)


def _getter(name: str):
    if any(name in names for names in SCALARS.values()):
        return lambda archive, songidx=0: archive.scalar(name, songidx)
    if any(name in names for names in ARRAYS.values()):
        return lambda archive, songidx=0: archive.array(name, songidx)
    raise AttributeError(f"get_{name}")


def __getattr__(attribute: str):
    """``get_<attribute>(archive, songidx=0)`` for every scalar and array above."""
    if attribute.startswith("get_"):
        return _getter(attribute[4:])
    raise AttributeError(attribute)


def get_num_songs(archive: Archive) -> DataFrame:
    return archive.num_songs()


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Save tracks, codes or bags; partition columns become folders that later scans prune."""
    if partition_by:
        # rows of a folder meet in few files, and a hot folder is still written by many tasks
        spread = df.hint("rebalance", *partition_by)
        spread.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


write_tracks = save
write_codes = save
write_bags = save


def scan_saved(spark: SparkSession, path: str, cache: bool = False) -> DataFrame:
    """Read a saved table: lazily from disk, or held by the executors (spilling to their disks)."""
    df = spark.read.parquet(path)
    return df.persist(StorageLevel.MEMORY_AND_DISK) if cache else df


@contextmanager
def held(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """A saved table held by the executors as long as the block runs; what is made of it inside must be finished there."""
    df = scan_saved(spark, path, cache=True)
    try:
        yield df
    finally:
        df.unpersist(blocking=True)
