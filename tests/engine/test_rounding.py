import random

from pyspark.sql import functions as F

from bomspark.functions import scalars as fn


def test_one_decimal_place_is_exact(spark):
    rnd = random.Random(3)
    pairs = [(15, 10000), (35, 10000), (0, 7), (1, 800), (3, 16), (2**53 - 1, 3), (-1, 3), (-1, 10**6), (999_999, 10**6), (9995, 10**4)]
    pairs += [(rnd.randrange(1, 10 ** rnd.randrange(1, 7)), rnd.randrange(1, 10 ** rnd.randrange(1, 8))) for _ in range(60_000)]
    pairs += [(k, 2000) for k in range(20_000)] + [(k, 16) for k in range(20_000)]
    got = spark.createDataFrame(pairs, "n long, d long").select("n", "d", fn.percent_of(F.col("n"), F.col("d")).alias("p")).collect()
    assert len(got) == len(pairs) > 100_000
    assert [r for r in got if r.p != "%.1f" % (r.n / r.d * 100)] == []


def test_doubles_of_any_size(spark):
    rnd = random.Random(4)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 1e-300, 2.0**52 + 0.5, 2.0**53, 2.0**60 + 2**9, 1e22, 2.0**115, -0.25, -2.0**70, 0.95, 0.949999999999, 99.95] + [rnd.random() * 10 ** rnd.randrange(-8, 16) for _ in range(20_000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fn.fixed(F.col("v")).alias("t")).collect()
    assert [r for r in got if r.t != "%.1f" % r.v] == []
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "v double")
    assert [r.t for r in odd.select(fn.fixed(F.col("v")).alias("t")).collect()] == ["+Inf", "-Inf", "NaN", None]
