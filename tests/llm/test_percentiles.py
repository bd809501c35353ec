import math
import random

import pytest
from pyspark.sql import functions as F

from tidegate.llm.p2_percentiles import bucket, gamma, merge, quantiles, sketch


def test_error_bound_and_merge(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else "g", d, v, 1) for d in range(5) for v in [rnd.choice([0.0, rnd.gauss(0, 50), rnd.lognormvariate(3, 2), -1e-12]) for _ in range(400)]]
    df = spark.createDataFrame(rows, "k string, day int, x double, bucket int")
    whole = sketch(df, ["k"], ["x"], 0.02)
    by_day = sketch(df, ["k", "day"], ["x"], 0.02)
    fractions = [0.0, 0.1, 0.5, 0.9, 1.0]
    a = {(r.k, r.fraction): r for r in quantiles(whole, ["k"], fractions, 0.02).collect()}
    b = {(r.k, r.fraction): r for r in quantiles(merge(by_day, ["k"]), ["k"], fractions, 0.02).collect()}
    assert a == b and len(a) == 10
    for k in ("hot", "g"):
        v = sorted(x for g, _, x, _ in rows if g == k)
        for q in fractions:
            x, r = v[math.floor(q * (len(v) - 1))], a[k, q]
            assert abs(r.value - x) <= 0.02 * abs(x) + 1e-9 and r["values"] == len(v)
            assert r.low - 1e-9 <= x <= r.high + 1e-9


def test_values_that_dont_count(spark):
    rows = [(None, float("nan")), (None, float("inf")), (None, -float("inf")), (None, None), ("a", -3.0), ("a", 5.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: (r.value, r["values"]) for r in quantiles(sketch(df, ["k"], ["x"], 0.01, F.col("value") >= 0), ["k"], [0.5]).collect()}
    assert got["a"][1] == 1 and abs(got["a"][0] - 5) < 0.051 and got[None][1] == 1
    assert quantiles(sketch(df.limit(0), ["k"], ["x"]), ["k"], [0.5]).count() == 0
    signs = spark.createDataFrame([(-3.0,), (0.0,), (3.0,)], "x double").select(bucket(F.col("x"), 0.01).alias("b")).collect()
    assert signs[0].b == -signs[2].b and signs[1].b == 0
    with pytest.raises(ValueError):
        gamma(1.0)


def test_values_down_to_the_smallest_double(spark):
    """The bound holds for tiny, subnormal and very large values of both signs; only 0 is 0."""
    values = [0.0, 5e-324, 3e-310, 7e-100, 5e-10, 9e-10, -5e-10, -2e-200, 1e300, -1.5e308]
    rows = [(f"k{i}", v) for i, v in enumerate(values)]
    got = {r.k: r for r in quantiles(sketch(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"]), ["k"], [0.5]).collect()}
    assert len(got) == len(values)
    for k, v in rows:
        r = got[k]
        assert (r.value == 0) == (v == 0), (v, r)
        if abs(v) > 1e-300:
            assert abs(r.value - v) <= 0.0100001 * abs(v) and r.low * (1 - 1e-9 * (1 if v > 0 else -1)) <= v <= r.high * (1 + 1e-9 * (1 if v > 0 else -1)), (v, r)
