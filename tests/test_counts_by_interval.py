"""Many rows of one interval meet once, and a key that all rows share is dealt by time."""

import pytest
from pyspark.sql import functions as F

from chronoframe.functions.interval import CLOSED, HALF_OPEN
from chronoframe.operators import antijoin, join

from .test_operators import drawn, relation


@pytest.mark.parametrize("bounds", [HALF_OPEN, CLOSED])
@pytest.mark.parametrize("levels", [False, True])
def test_keys_with_buckets(spark, bounds, levels):
    r, s = drawn(11, 40), drawn(12, 30)
    ok = (lambda x: x[0] < x[1]) if bounds == HALF_OPEN else (lambda x: x[0] <= x[1])
    meet = (lambda x, y: x[0] < y[1] and x[1] > y[0]) if bounds == HALF_OPEN else (lambda x, y: x[0] <= y[1] and x[1] >= y[0])
    pairs = [(max(x[0], y[0]), min(x[1], y[1]), x[2]) for x in r for y in s if ok(x) and ok(y) and x[2] == y[2] and meet(x, y)]
    a, b = relation(spark, [*r, (0, 50, None)]), relation(spark, [*s, (0, 50, None)])
    got = join.overlap_join(a, b, bounds, width=5, levels=levels, keys=["data"])
    assert sorted((x.ts, x.te, x.r_data) for x in got.collect()) == sorted(pairs)
    counts = {(x.ts, x.te, x.data): x.n for x in antijoin.intersection_counts(a, b, "data", bounds).collect()}
    assert counts == {p: pairs.count(p) for p in pairs}


def test_a_crowd_of_equal_rows(spark):
    """4 * 10**10 pairs, of two intervals."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("ts"), (F.col("id") % 2 + 2).alias("te"), F.lit("x").alias("data"))
    got = {(x.ts, x.te): x.n for x in antijoin.intersection_counts(df, df).collect()}
    assert got == {(0, 2): 10**10, (1, 3): 10**10, (1, 2): 2 * 10**10}
