"""Columns named like the operators' own, dotted names, null keys and extreme bounds."""

from __future__ import annotations

from chronoframe.operators import aggregate, antijoin, join

NAMES = "ts bigint, te bigint, p string, `a.b` string, q int, n int, d int, g int, _p int, _row int, _m int"
FAR = -(1 << 62)


def rows(spark, *bounds, key="x"):
    return spark.createDataFrame([(a, b, key, "y", 9, 9, 9, 9, 9, 9, 9) for a, b in bounds], NAMES)


def ends(df):
    return sorted((r["ts"], r["te"]) for r in df.collect())


def test_keys_and_columns_of_any_name(spark):
    r, s = rows(spark, (1, 10)), rows(spark, (3, 5), (4, 6))
    for keys in (["p"], ["a.b"], ["q", "n", "d", "g"]):
        assert ends(antijoin.temporal_anti_join(r, s, keys)) == [(1, 3), (6, 10)]
        assert ends(aggregate.segments(s, keys)) == [(3, 4), (4, 5), (5, 6)]
        assert ends(join.keyed_overlap_join(r, s, keys)) == [(3, 5), (4, 6)]
        split = aggregate.normalize(s, keys)
        assert ends(split) == [(3, 4), (4, 5), (4, 5), (5, 6)]
        assert {(x["_row"], x["_p"], x["a.b"]) for x in split.collect()} == {(9, 9, "y")}


def test_null_keys_are_split_too(spark):
    assert ends(aggregate.normalize(rows(spark, (1, 5), (3, 7), key=None), ["p"])) == [(1, 3), (3, 5), (3, 5), (5, 7)]


def test_bounds_near_the_end_of_the_range(spark):
    r, s = rows(spark, (FAR - 10, FAR - 5), (-FAR + 5, -FAR + 9)), rows(spark, (0, 1))
    assert ends(antijoin.temporal_anti_join(r, s, ["p"])) == [(FAR - 10, FAR - 5), (-FAR + 5, -FAR + 9)]


def test_closed_points(spark):
    r, s = rows(spark, (1, 10)), rows(spark, (3, 5), (5, 6))
    assert ends(antijoin.temporal_anti_join(r, s, ["p"], "[]")) == [(1, 2), (7, 10)]
    assert ends(aggregate.segments(s, ["p"], "[]")) == [(3, 4), (5, 5), (6, 6)]
    assert ends(aggregate.normalize(s, ["p"], "[]")) == [(3, 4), (5, 5), (5, 5), (6, 6)]
