import random

import pytest
from pyspark.sql import functions as F

from tagweave.functions import ordering


def test_global_rank(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = {r.v: r.position for r in ordering.global_rank(df, ["v"]).collect()}
    assert got == {v: n for n, v in enumerate(sorted(values))}


@pytest.mark.parametrize("size", [1000, 70, 500, 7])
def test_slices(spark, size):
    values = random.Random(4).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    n, at = ordering.slices(df, ["v"], size)
    expected = sorted(values)
    assert n == -(-500 // size)
    for k in {0, n // 2, n - 1}:
        assert sorted(r.v for r in at(k).collect()) == expected[k * size : (k + 1) * size]


def test_running_sum_and_maximum_over_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if n % 3 else f"k{n % 7}", n, rng.randint(-5, 5)) for n in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at int, v long").repartition(5)
    out = ordering.running(df, ["key"], ["at"], sums={"total": "v"}, maxima={"top": "v"}).collect()
    assert len(out) == len(rows)
    expected = {}
    for key in {r[0] for r in rows}:
        total, top = 0, None
        for _, at, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            total, top = total + v, v if top is None else max(top, v)
            expected[key, at] = (total, top)
    assert {(r.key, r["at"]): (r.total, r.top) for r in out} == expected


def test_running_maximum_carries_over_parts_without_values(spark):
    df = spark.createDataFrame([(n, n if n % 40 == 0 else None) for n in range(200)], "at int, v int")
    out = ordering.running(df, [], ["at"], maxima={"last": "v"}).collect()
    assert {r["at"]: r["last"] for r in out} == {n: n // 40 * 40 for n in range(200)}


def test_salted_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 10)
    monkeypatch.setattr(ordering, "MAX_HOT_KEYS", 20)
    left = spark.range(600).select((F.col("id") % 3 * (F.col("id") % 50)).alias("k"), F.col("id").alias("v"))
    right = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    hot = ordering.hot_keys(left, "k")
    assert 0 < hot.count() <= 20
    assert hot.agg(F.max("_pieces")).first()[0] > 1
    salted = ordering.salted_join(left, right, "k", "v", hot)
    assert sorted(salted.select("k", "v", "w").collect()) == sorted(left.join(right, "k").select("k", "v", "w").collect())


def test_small_inputs_have_no_hot_keys(spark):
    assert ordering.hot_keys(spark.range(10).withColumnRenamed("id", "k"), "k") is None
