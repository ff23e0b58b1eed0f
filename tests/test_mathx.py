import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.functions import mathx

DIGAMMA = {0.1: -10.423754940411076, 1.0: -0.5772156649015329, 100.0: 4.600161852738087}


def test_special_functions(spark):
    values = [0.1, 0.5, 1.0, 2.0, 7.5, 100.0, 1e4]
    rows = (
        spark.createDataFrame([(v,) for v in values], "x double")
        .select("x", mathx.digamma(F.col("x")).alias("psi"), mathx.log_gamma(F.col("x")).alias("lg"))
        .collect()
    )
    for r in rows:
        assert r.lg == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-10)
        if r.x in DIGAMMA:
            assert r.psi == pytest.approx(DIGAMMA[r.x], rel=1e-12)
        assert r.psi == pytest.approx(float(mathx.digamma_np(np.array(r.x))), rel=1e-13)
        assert r.lg == pytest.approx(float(mathx.log_gamma_np(np.array(r.x))), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("shape", [100.0, 12.0, 0.5])
def test_gamma_draws_have_the_moments_of_a_gamma(spark, shape):
    ids = spark.range(5000).withColumnRenamed("id", "i")
    drawn = ids.select(F.explode(mathx.gamma_pairs(7, "theta", F.col("i"), 4, shape)).alias("z"))
    row = drawn.agg(F.avg("z.g"), F.variance("z.g"), F.avg("z.r"), F.min("z.g"), F.corr("z.g", "z.r")).first()
    n = 20000
    assert row[0] == pytest.approx(shape, abs=5 * math.sqrt(shape / n))
    assert row[1] == pytest.approx(shape, rel=0.1)
    assert row[2] == pytest.approx(shape, abs=5 * math.sqrt(shape / n))
    assert row[3] > 0
    assert abs(row[4]) < 0.04


def test_draws_do_not_depend_on_partitioning(spark):
    ids = spark.range(50).withColumnRenamed("id", "i")

    def draws(df):
        return df.select("i", mathx.gamma_pairs(1, "beta", F.col("i"), 3, 100.0).alias("z")).orderBy("i").collect()

    assert draws(ids.repartition(1)) == draws(ids.repartition(8, "i"))


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    assert df.select(mathx.dot(F.col("a"), F.col("b"))).first()[0] == 1.0
