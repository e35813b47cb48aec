"""Documents without an id, and rows that are there more than once."""

from __future__ import annotations

import corpus_pipeline
from chronoframe.llm import decontaminate

from . import brute

PASSAGE = " ".join(f"item{i}" for i in range(30))


def test_contaminated_without_id(spark):
    texts = [(None, PASSAGE), (None, "clean words only"), (None, PASSAGE), (1, "short one here"), (None, "Short one"), (2, PASSAGE + " tail"), (None, None)]
    items = [(7, PASSAGE), (8, "short one")]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((repr(tuple(r)) for r in decontaminate.contamination(docs, bench).drop("text_key").collect()))
    want = [(d, *x[1:]) for d, t in texts for x in brute.contaminated([(0, t)], items)]
    assert got == sorted(map(repr, want))
    assert [(r.doc_id, r.text) for r in decontaminate.clean(docs, bench).orderBy("text").collect()] == [(None, None), (None, "clean words only")]


def test_one_row_of_each_group_stays(spark):
    near = PASSAGE.split()
    near[-1] = "other"
    near, far = " ".join(near), " ".join(f"far{i}" for i in range(20))
    rows = [(5, PASSAGE), (5, PASSAGE), (5, PASSAGE), (None, PASSAGE), (9, near), (None, far), (None, far), (3, "one"), (3, "two"), (4, ""), (4, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(5, PASSAGE), (None, far), (3, "one"), (3, "two"), (4, ""), (4, ""), (None, None)]))
