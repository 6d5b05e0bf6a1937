import random

import pytest
from pyspark.sql import functions as F

from folioline.functions.rounding import fixed_text, mean_of_tenths, round_binary


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_round_agrees_with_the_binary_value(spark, digits):
    random.seed(digits)
    values = [random.uniform(0, 100) for _ in range(3000)]
    values += [n / 20 for n in range(2000)] + [n / 200 for n in range(2000)] + [0.0, 99.95, 0.35]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", round_binary(F.col("x"), digits).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.r != float(round(r.x, digits))] == []


def test_fixed_text_rounds_exact_ties_up(spark):
    df = spark.createDataFrame([(1.25,), (1.005,), (0.05,), (12.0,)], "x double")
    got = [r.t for r in df.select(fixed_text(F.col("x"), 1).alias("t")).collect()]
    assert got == ["1.3", "1.0", "0.1", "12.0"]


def test_mean_of_tenths(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "s double")
    assert df.agg(mean_of_tenths(F.col("s")).alias("m")).first().m == pytest.approx(0.7 / 3)
