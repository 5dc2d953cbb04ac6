"""Amounts of a budget check have four significant digits."""

import random

from pyspark.sql import functions as F

from tallyglass.operators import evals


def test_significant_digits(spark):
    rnd = random.Random(1)
    values = [0.0, 1.0, 10.0, 3.14159, 1234.0, 12347.0, 99996.0, 9999.6, 0.00012347, 0.0000123, 1e-9, 1.5e12, -2.5, -12345.678, 0.1, 100.0, 999.96, 0.99999]
    values += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-7, 8) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(evals.significant(F.col("v"))).collect()]
    assert got == [f"{v:.4g}" for v in values]


def test_budget_reasons(spark):
    rows = spark.createDataFrame([(0, 3.0, 3.0), (1, 4.5, 3.0), (2, 1.0, 0.0), (3, 0.0, 0.0)], "i int, v double, b double")
    ok, reason = evals.budget_check(F.col("v"), F.col("b"), F.lit("s"))
    got = [tuple(r) for r in rows.orderBy("i").select(ok, reason).collect()]
    assert got == [(True, "3s within 3s"), (False, "4.5s exceeds 3s by 50%"), (False, "1s exceeds 0s by inf%"), (True, "0s within 0s")]
