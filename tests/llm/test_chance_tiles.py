"""Texts that share a passage by chance make no tiles; those about the threshold are still found."""

import random

from chronoframe.llm import jaccard

SCHEMA = "doc_id bigint, text string"


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def tiles(spark, monkeypatch, docs):
    """The number of tiles that texts make of which no two link."""
    counts, plain = {}, jaccard.stored

    def counted(df, name, **options):
        table = plain(df, name, **options)
        counts.setdefault(name, table.count())
        return table

    monkeypatch.setattr(jaccard, "stored", counted)
    rows = jaccard.near_duplicates(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], SCHEMA)).collect()
    assert len(rows) == len(docs) and all(x.component_id == x.doc_id for x in rows)
    return counts["tiles"]


def test_sizes_that_cannot_link_make_no_tile(spark, monkeypatch):
    """A long text put together from short ones has just their shingles."""
    r = random.Random(1)
    short = [words(r, 20) for _ in range(40)]
    assert tiles(spark, monkeypatch, short + [sum(short[i : i + 10], []) for i in range(0, 40, 10)]) == 0


def test_one_shared_shingle_makes_no_tile(spark, monkeypatch):
    """Each two of 22 texts have a passage in common, but often just one shingle among the rarest; 160 tiles without the rule."""
    r = random.Random(2)
    passage = {(i, j): words(r, 25) for i in range(22) for j in range(i)}
    docs = [sum(r.sample(own, len(own)), []) for k in range(22) for own in [[x for ij, x in passage.items() if k in ij]]]
    assert 0 < tiles(spark, monkeypatch, docs) < 100


def test_about_the_threshold(spark):
    """Sets of few shingles, each held against one with words changed, added or gone."""
    r, docs = random.Random(2), []
    for n in range(1, 60):
        base = words(r, n)
        docs += [base, base[: -(n // 10) or None], base + words(r, n // 8), words(r, n // 12) + base, base[: n // 2] + ["x"] + base[n // 2 :]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = [frozenset(tuple(d[i : i + 5]) for i in range(len(d) - 4)) or frozenset([tuple(d)]) for d in docs]
    part = list(range(len(docs)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((part[i], part[j]))
                part = [a if x == b else x for x in part]
    assert got == {i: (len(s), part[i]) for i, s in enumerate(sets)}


def test_a_pair_is_made_once(spark, monkeypatch):
    """Three sets of three components share nine tiles; each pair comes from one of them, from one side."""
    rows = [(t, sid, 20, b"\x00" * 8, sid) for t in range(9) for sid in (5, 6, 7)]
    members = spark.createDataFrame(rows, "tile bigint, sid bigint, n int, bits binary, label bigint")
    monkeypatch.setattr(type(members), "distinct", lambda self: self)
    assert sorted(tuple(x) for x in jaccard._block_pairs(members).collect()) == [(5, 6), (5, 7), (6, 7)]
