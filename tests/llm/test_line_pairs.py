"""What line dedup hands on: prefix rows, pairs, and the table of word frequencies."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from chronoframe.llm import lines

from . import brute


def test_second_band_only_within_reach(spark):
    """A set of 36 frequent words meets the next band only from positions that leave room for a partner of its size."""
    head = [lines.FREQUENT << lines.KEY_BITS | i for i in range(8)]
    sets = spark.createDataFrame([(1, 36, 0, head, None, False)], "num bigint, size int, bits bigint, head array<int>, wide array<bigint>, settled boolean")
    got = [r for turn in range(lines.PASSES) for r in lines._prefix_rows(sets, True, turn).collect()]
    band = lambda n: next(i for i in range(99) if 1.25 ** (i + 1) > n)
    want = set()
    for pos in range(5):  # 36 - ceil(2 * 36 * 0.8 / 1.8) + 1
        most = max(m for m in range(36, 99) if 180 * (36 - pos) >= 80 * (36 + m))
        want |= {(head[pos], b) for b in range(band(36), band(most) + 1)}
    assert len(want) < 10
    assert {(r.at >> 8, (r.at & 255) - 1) for r in got} == want and len(got) == len(want)


def test_closest_partner_first(spark, monkeypatch):
    """In a group of near copies few pairs are held against each other word by word; the lines that go are the right ones."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(40)]
    docs = [(d, " ".join(w if r.random() > 0.13 else f"x{r.randrange(10**6)}" for w in base)) for d in range(250)]
    compared = []
    inner = lines.similar

    def similar(inter, na, nb):
        if "array_intersect" in str(inter):
            compared.append(1)
        return inner(inter, na, nb)

    made, kept = [], lines.stored

    def stored(df, name, **options):
        table = kept(df, name, **options)
        if name in ("pairs", "others"):
            made.append((name, table.count()))
        return table

    monkeypatch.setattr(lines, "similar", similar)
    monkeypatch.setattr(lines, "stored", stored)
    got = {(x.doc_id, x.line) for x in lines.removed_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), 1).collect()}
    assert got == brute.line_matches(docs, 1)
    pairs, others = [n for k, n in made if k == "pairs"][1], [n for k, n in made if k == "others"]
    assert pairs > 500 and others and others[0] < 250 and len(compared) >= 2


def test_table_of_bytes(spark):
    docs = spark.createDataFrame([(1, "a b a\na c")], "doc_id bigint, text string")
    words = lines.line_words(docs)
    table = lines.rarity(words, 64)
    assert isinstance(table, np.ndarray) and table.nbytes == 64
    want = [0] * 64
    for r in words.select(F.explode("words").alias("h")).collect():
        want[r.h & 63] += 1
    assert table.tolist() == [len(bin(n)) - 2 if n else 0 for n in want]
    key = lines._key(table)
    rows = words.select(F.explode(F.transform("words", lambda h: F.struct(h.alias("h"), key(h).alias("k")))).alias("x")).select("x.*").collect()
    assert rows and all(r.k >> lines.KEY_BITS == table[r.h & 63] for r in rows)
