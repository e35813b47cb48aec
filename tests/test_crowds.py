"""Joins of many rows of one interval: every pair, dealt by pairs, and little room in Parquet."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoframe.functions.interval import CLOSED, HALF_OPEN
from chronoframe.operators import join

from .test_operators import drawn, relation


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(join, "PAIRS", 20)
    monkeypatch.setattr(join, "MEMBERS", 4)


def crowd(rows):
    """Rows of few intervals, with copies and nulls."""
    return [*rows, *[(3, 6, d) for d in ["a", "b", None, None, "c"] * 3], (None, 4, "n"), (3, None, "n")]


@pytest.mark.parametrize("bounds", [HALF_OPEN, CLOSED])
@pytest.mark.parametrize("n, m", [(40, 30), (0, 10), (10, 0)])
def test_all_pairs(spark, small, bounds, n, m):
    r, s = crowd(drawn(5, n)) if n else [], crowd(drawn(6, m)) if m else []
    ok = lambda x: None not in x[:2] and (x[0] < x[1] or bounds == CLOSED and x[0] == x[1])
    meet = (lambda x, y: x[0] < y[1] and x[1] > y[0]) if bounds == HALF_OPEN else (lambda x, y: x[0] <= y[1] and x[1] >= y[0])
    a, b = relation(spark, r), relation(spark, s)
    got = join.overlap_join(a, b, bounds, width=5, levels=False, crowded=True)
    want = Counter((max(x[0], y[0]), min(x[1], y[1]), x[2], y[2]) for x in r for y in s if ok(x) and ok(y) and meet(x, y))
    assert got.columns == ["ts", "te", "r_ts", "r_te", "r_data", "s_ts", "s_te", "s_data"]
    assert Counter((x.ts, x.te, x.r_data, x.s_data) for x in got.collect()) == want
    if bounds == CLOSED:
        same = Counter((x[0], x[1], x[2], y[2]) for x in r for y in s if ok(x) and ok(y) and x[:2] == y[:2])
        assert Counter((x.ts, x.te, x.r_data, x.s_data) for x in join.interval_equality_join(a, b).collect()) == same


def test_only_ends(spark, small):
    df = spark.range(30).select((F.col("id") % 2).alias("ts"), (F.col("id") % 2 + 2).alias("te"))
    assert join.interval_equality_join(df, df).count() == 450
    assert join.overlap_join(df, df, crowded=True).count() == 900


def test_columns_without_order(spark, small):
    df = spark.range(12).select(F.lit(1).cast("bigint").alias("ts"), F.lit(2).cast("bigint").alias("te"), F.create_map(F.lit("x"), "id").alias("a map"))
    got = join.interval_equality_join(df, df).collect()
    assert Counter((x["r_a map"]["x"], x["s_a map"]["x"]) for x in got) == Counter((i, j) for i in range(12) for j in range(12))


@pytest.mark.parametrize("how", ["equality", "overlap"])
def test_dealt_and_stored(spark, monkeypatch, tmp_path, how):
    """4.5 million pairs of one interval: no task makes half of them, and they take few bytes."""
    monkeypatch.setattr(join, "PAIRS", 225_000)
    r, s = (spark.range(n).selectExpr("bigint(id >= 0) AS ts", "1 + bigint(id >= 0) AS te", "xxhash64(id) AS id") for n in (1500, 3000))
    pairs = join.interval_equality_join(r, s) if how == "equality" else join.overlap_join(r, s, crowded=True)
    pairs.select("r_id", "s_id", "ts", "te").write.parquet(str(tmp_path / "out"))
    counts = [x.n for x in spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 4_500_000
    assert max(counts) <= 2_250_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.3 * 4_500_000
