"""Operators against O(n * n) definitions on random intervals, and the worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from chronoframe.functions.interval import CLOSED, HALF_OPEN, skipped, valid
from chronoframe.operators import aggregate, antijoin, join, partition
from chronoframe.operators.ordered import with_rank
from chronoframe.plans.granules import granule_count, tightening
from chronoframe.sources import generate
from chronoframe.sources.text import read_text

SCHEMA = "ts bigint, te bigint, data string"


def relation(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def drawn(seed, n, longest=12, span=60, low=-20):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        ts = low + r.randrange(span)
        rows.append((ts, ts + r.choice([0, 1, 2, longest, 40 * longest if i % 17 == 0 else 3]) - (1 if i % 23 == 0 else 0), r.choice("abc")))
    return [*rows, *rows[:3]]


def covered(x, s):
    return any(b[0] <= x < b[1] for b in s)


@pytest.fixture(scope="module", params=[(1, 40, 25), (2, 0, 10), (3, 30, 0), (4, 1, 1)])
def pair(request, spark):
    seed, n, m = request.param
    r, s = drawn(seed, n) if n else [], drawn(seed + 100, m) if m else []
    return r, s, relation(spark, r), relation(spark, s)


@pytest.mark.parametrize("bounds", [HALF_OPEN, CLOSED])
@pytest.mark.parametrize("how", ["bucket", "levels", "granule", "theta"])
def test_overlap_join(pair, bounds, how):
    r, s, a, b = pair
    ok = (lambda x: x[0] < x[1]) if bounds == HALF_OPEN else (lambda x: x[0] <= x[1])
    meet = (lambda x, y: x[0] < y[1] and x[1] > y[0]) if bounds == HALF_OPEN else (lambda x, y: x[0] <= y[1] and x[1] >= y[0])
    want = sorted((max(x[0], y[0]), min(x[1], y[1]), x[2], y[2]) for x in r for y in s if ok(x) and ok(y) and meet(x, y))
    got = {
        "bucket": lambda: join.overlap_join(a, b, bounds, width=5, levels=False),
        "levels": lambda: join.overlap_join(a, b, bounds, width=1, levels=True),
        "granule": lambda: join.granule_join(a, b, 7, bounds),
        "theta": lambda: join.theta_overlap_join(a, b, bounds),
    }[how]()
    assert sorted((x.ts, x.te, x.r_data, x.s_data) for x in got.collect()) == want


def test_anti_join(pair):
    r, s, a, b = pair
    s_ok = [y for y in s if y[0] < y[1]]
    want = sorted((x, row[2]) for row in r if row[0] < row[1] for x in range(row[0], row[1]) if not covered(x, s_ok))
    got = antijoin.temporal_anti_join(a, b).collect()
    assert sorted((x, g.data) for g in got for x in range(g.ts, g.te)) == want
    keyed = sorted((x, row[2]) for row in r if row[0] < row[1] for x in range(row[0], row[1]) if not covered(x, [y for y in s_ok if y[2] == row[2]]))
    got = antijoin.temporal_difference(a, b).collect()
    assert sorted((x, g.data) for g in got for x in range(g.ts, g.te)) == keyed


def test_segments_depth_and_partitions(pair):
    r, _, a, _ = pair
    rows = [x for x in r if x[0] < x[1]]
    points = sorted({p for x in rows for p in x[:2]})
    want = [(p, q, n) for p, q in zip(points, points[1:], strict=False) if (n := sum(x[0] <= p and x[1] >= q for x in rows))]
    assert sorted(map(tuple, aggregate.segments(a).collect())) == want
    depth = max([n for _, _, n in want], default=0)
    assert aggregate.max_depth(a).first()[0] == depth
    parts = partition.disjoint_partitions(a)
    assert sorted((x.ts, x.te, x.data) for x in parts.collect()) == sorted(rows)
    assert partition.overlap_violations(parts).first()[0] == 0
    assert len({x.part for x in parts.collect()}) == depth


def test_normalize(pair):
    r, _, a, _ = pair
    rows = [x for x in r if x[0] < x[1]]
    want = []
    for x in rows:
        cuts = sorted({p for y in rows if y[2] == x[2] for p in y[:2] if x[0] <= p < x[1]}) + [x[1]]
        want += [(p, q, x[2]) for p, q in zip(cuts, cuts[1:], strict=False)]
    got = aggregate.normalize(a, ["data"]).collect()
    assert sorted((x.ts, x.te, x.data) for x in got) == sorted(want)


def test_worked_example(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1 3 7 9 6 8\t\t\n7\t8\n\n 9 13\nx 4 bad\n5 2 late\n")
    (tmp_path / "s.txt").write_text("2 9\n3 5\n3 4\n5 6\n6 9\n")
    r, s = read_text(spark, str(tmp_path / "r.txt")), read_text(spark, str(tmp_path / "s.txt"))
    assert skipped(r).first()[0] == 2
    assert sorted((x.ts, x.te) for x in valid(r).collect()) == [(1, 3), (7, 8), (9, 13)]
    assert sorted((x.ts, x.te) for x in join.overlap_join(r, s).collect()) == [(2, 3), (7, 8), (7, 8)]
    assert sorted((x.ts, x.te) for x in antijoin.temporal_anti_join(r, s).collect()) == [(1, 2), (9, 13)]
    assert sorted(map(tuple, aggregate.segments(s).collect())) == [(2, 3, 1), (3, 4, 3), (4, 5, 2), (5, 6, 2), (6, 9, 2)]
    assert aggregate.max_depth(s).first()[0] == 3


def test_generators(spark):
    rows = generate.uniform(spark, 500, 9, 1, 100).collect()
    assert len(rows) == 500 and all(1 <= x.ts < 100 and 1 <= x.te - x.ts <= min(100 - x.ts, 9) for x in rows)
    assert rows == generate.uniform(spark, 500, 9, 1, 100).collect()
    assert [(x.ts, x.te) for x in generate.sequential(spark, 3, 5).collect()] == [(1, 5), (6, 10), (11, 15)]
    assert [x.ts for x in generate.sequential(spark, 3, 5, descending=True).collect()] == [11, 6, 1]
    assert all(x.ts <= x.te <= 1000 for x in generate.gaussian(spark, 300, 20, 5, 1, 1000).collect())
    assert generate.every_interval(spark, 2, 5).count() == 10
    assert generate.systematic_sample(spark.range(100), 10, "id").count() == 10


def test_rank(spark):
    df = with_rank(spark.range(1000).select(F.expr("999 - id").alias("x")), ["x"])
    assert all(r.x == r["rank"] for r in df.collect())


def test_granule_planning():
    assert tightening(10, 1000, 1000) == pytest.approx(1)
    k = granule_count(300_000, 365, 1_000_000, 10_000, 365, 10_000)
    assert 10 < k < 10_000
    assert granule_count(0, 1, 1, 0, 1, 1) == 1
