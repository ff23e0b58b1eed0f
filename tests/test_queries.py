"""Some registered queries against their SQL on the smallest data, and the shape of their plans."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entries
import check
from tagweave import session as settings
from tagweave.catalog import tables
from tagweave.catalog.queries import QUERIES
from tagweave.operators import quantize
from tagweave.sources import tracks

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "load_tracks", "select_song_at", "ragged_slice", "hartigan_partial_fit", "vq_encode_soft", "build_tag_vocab",
    "hartigan_fit_in_order", "minibatch_kmeans", "hartigan_repeated_ids", "vq_fit_default", "ragged_chunks",
    "kmeans_codebook", "hartigan_sharded", "score_tags_blocks", "score_tags_top", "count_matrix", "pmf_fit", "minibatch_split", "topk_tags", "tag_auc",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    assert check.compare(spark, db, FOLDER, name).startswith("ok")


def test_every_sql_has_a_query():
    assert set(entries.oracle_sql()) <= set(entries.queries())
    own = set(QUERIES)  # the corpus queries have tests of their own
    assert own <= set(entries.oracle_sql())


@pytest.mark.parametrize("missing", ["regex", "xxhash"])
def test_a_missing_library_of_the_corpus_operators_costs_no_other_query(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pmf_fit' in e.queries(), 'pipeline' in e.queries())"
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1], check=True).stdout.split()
    assert int(told[0]) == len(QUERIES) and told[1:] == ["True", "False"]


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    song = tracks.select_song_at(spark.read.parquet(f"{FOLDER}/documents.parquet"), 3, "doc_id").select("lang")
    assert "EqualTo(doc_id,3)" in plan(song)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(song)


def test_encoding_needs_no_join_and_no_shuffle(spark):
    encoded = quantize.vq_encode_hard(tables.points(spark, FOLDER), tables.seed_codebook(spark, FOLDER, 4))
    assert "Join" not in plan(encoded) and "Exchange" not in plan(encoded)


@pytest.mark.parametrize("name", ["ragged_slice", "update_theta", "recommend_groups", "joint_matrix"])
def test_no_pairwise_joins(spark, name):
    text = plan(entries.queries()[name](spark, FOLDER))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_staged_tables_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    staged = settings.stage(spark.range(3), "probe")
    assert all(shared in file for file in staged.inputFiles())
    assert staged.count() == 3


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://cluster"

    class Conf:
        @staticmethod
        def get(name, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        settings.work_dir(Session())


def test_entry(spark: SparkSession):
    best = entries.entry(spark)
    assert best.columns == ["i", "label", "score"]
    assert best.count() == 3 * 150
