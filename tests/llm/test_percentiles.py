"""Radix selection against sorting, and merged states against the whole."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plotwise.llm import percentiles as P

PROBS = [0.0, 0.1, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = [("hot" if k % 3 else f"g{k % 7}", k % 4, rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e300), -rnd.random() * 1e-310, 0.0, -0.0, 2.0 ** rnd.randrange(-20, 20), 5.0]), "x") for k in range(3000)]
    return [*out, (None, 1, 3.5, "x"), (None, 1, -3.5, "x"), ("one", 2, math.inf, "x"), ("none", 1, None, "x"), ("nan", 1, math.nan, "x"), *[("same", 0, 1.25, "x")] * 9]


def exact(xs, p):
    xs = sorted(xs)
    at = (len(xs) - 1) * p
    lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
    return lo if lo == hi or at == int(at) else lo + (hi - lo) * (at - math.floor(at))


def test_percentiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, load int, v double, state string")
    got = {(r.g, r.p): (r.n, r.value) for r in P.percentiles(df, ["g"], ["v"], PROBS).collect()}
    by = {}
    for g, _, v, _ in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert got == {(g, p): (len(xs), exact(xs, p)) for g, xs in by.items() for p in PROBS}
    assert P.percentiles(df.limit(0), ["g"], ["v"], PROBS).count() == 0
    with pytest.raises(ValueError):
        P.percentiles(df.withColumn("n", F.lit(1)), ["n"], ["v"], PROBS)


def test_sketch(spark, rows):
    df = spark.createDataFrame(rows, "g string, load int, v double, state string")
    parts = P.merge(P.sketch(df, ["g", "load"], ["v"]), ["g"])
    assert sorted(map(repr, parts.select("g", "bucket", "c").collect())) == sorted(map(repr, P.sketch(df, ["g"], ["v"]).select("g", "bucket", "c").collect()))
    by = {}
    for g, _, v, _ in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    for r in P.sketch_percentiles(parts, ["g"], PROBS).collect():
        low, high = sorted((r.low, r.high))
        x = sorted(by[r.g])[math.floor((r.n - 1) * r.p)]
        assert low <= x <= high or math.isinf(x)
        assert abs(x) < 1e-300 or math.isinf(x) or high - low <= abs(x) * 2**-12 * 1.001
