"""Parts are handed from slab to slab; one stretch of time is no one task."""

import random

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import aggregate, partition

from .test_operators import relation


@pytest.mark.parametrize("slab", [1, 3, 7, 1000])
@pytest.mark.parametrize("longest", [1, 6, 80])
def test_slabs(spark, slab, longest):
    r = random.Random(slab * 100 + longest)
    rows = [(t, t + r.randrange(0, longest + 1), str(i)) for i in range(120) for t in [r.randrange(-50, 50)]]
    parts = partition.disjoint_partitions(relation(spark, [*rows, (0, 100, "x"), (0, 100, "x")]), slab=slab).collect()
    assert sorted((x.ts, x.te, x.data) for x in parts) == sorted([*(x for x in rows if x[0] < x[1]), (0, 100, "x"), (0, 100, "x")])
    depth = max(sum(x.ts <= t < x.te for x in parts) for t in range(-50, 150))
    assert {x.part for x in parts} == set(range(1, depth + 1))
    ends = {}
    for x in sorted(parts, key=lambda x: x.ts):
        assert ends.get(x.part, x.ts) <= x.ts
        ends[x.part] = x.te


def test_no_task_holds_an_island(spark, monkeypatch):
    """All rows are one island, but no task of `_place_parts` may see more than a slab; one interval has rows in many chunks."""
    seen, plain = spark.sparkContext.accumulator(0), partition._place_parts

    def counted(pieces, entries):
        seen.add(int(pieces["n"].sum() > 5000))
        return plain(pieces, entries)

    monkeypatch.setattr(partition, "_place_parts", counted)
    df = spark.range(40_000).select((F.col("id") % 4).alias("ts"), (F.col("id") % 4 + 2).alias("te"))
    parts = partition.disjoint_partitions(df, slab=5000)
    assert partition.overlap_violations(parts, F.count("*").alias("n"), F.count_distinct("part").alias("parts")).first()[:] == (0, 40_000, 20_000)
    assert aggregate.max_depth(df).first()[0] == 20_000
    assert seen.value == 0
