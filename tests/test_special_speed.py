"""Special functions against closed forms over wide ranges, and without long folds a row."""

import math

import pytest
from pyspark.sql import functions as F

from tracerage.functions import laws
from tracerage.functions import special as sp
from tracerage.operators import distributions as ds


def test_normal_tails_to_the_last_digits(spark):
    zs = [-30 + 0.37 * i for i in range(120)]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", sp.normal_cdf(F.col("z")).alias("p"), sp.normal_log_cdf(F.col("z")).alias("l")).collect()
    for r in rows:
        p = 0.5 * math.erfc(-r.z / math.sqrt(2))
        assert r.p == pytest.approx(p, rel=1e-12)
        assert r.l == pytest.approx(math.log(p), rel=1e-12, abs=1e-16)


def test_gamma_with_nulls_and_large_shapes(spark):
    rows = spark.createDataFrame([(2.0, None), (None, 1.0), (3.0, -1.0), (3.0, 0.0), (1.0, 5.0), (900.0, 900.0), (40000.0, 40300.0)], "a double, x double").select(sp.gamma_p(F.col("a"), F.col("x")).alias("p")).collect()
    p = [r.p for r in rows]
    assert p[:4] == [None, None, 0.0, 0.0]
    assert p[4] == pytest.approx(-math.expm1(-5.0), abs=1e-14)
    # By sums of Poisson terms.
    below = lambda a, x: 1 - math.fsum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(a))
    assert p[5] == pytest.approx(below(900, 900.0), abs=1e-10)
    assert p[6] == pytest.approx(below(40000, 40300.0), abs=1e-8)


def test_gamma_quantiles_invert_and_hold_no_fold(spark):
    law = laws.get_law("gamma")
    rows = spark.createDataFrame([(0.1 * 1.4**i, 2.0 + i) for i in range(20)], "k double, theta double")
    p = {n: F.col(n) for n in law.parameters}
    got = ds.add_moments(rows, "gamma")
    plan = got._jdf.queryExecution().toString()
    assert "aggregate(" not in plan
    for r in got.select(*(law.cdf(p, F.col(c)).alias(c) for c in ("p10", "p50", "p90"))).collect():
        assert tuple(r) == pytest.approx((0.1, 0.5, 0.9), abs=1e-13)
