"""Each stage of the pipeline against a plain version, over the smallest documents."""

from __future__ import annotations

import corpus_pipeline
from chronoframe.llm import lines, quality
from chronoframe.llm.common import stored

from . import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]

    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    first = stored(stage["quality_rules"](spark, docs, SF), "a")
    assert first.columns == docs.columns
    assert rows(first) == [x for x in rows(docs) if x[0] in kept]
    for d, t in rows(first):
        c = brute.counts(t)
        assert c[0] >= 50 and 100 * c[4] <= 50 * c[0]

    second = stored(stage["line_dedup"](spark, first, SF), "b")
    assert second.columns == docs.columns
    before = rows(first)
    gone = brute.line_matches(before, lines.LEAST_WORDS)
    after = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in before]
    assert rows(second) == after
    assert all(r.n_chars == len(r.text) for r in second.collect())

    third = stored(stage["near_duplicates"](spark, second, SF), "c")
    assert third.columns == docs.columns
    stay = {d for d, _, c in brute.components(after) if d == c}
    after = [x for x in after if x[0] in stay]
    assert rows(third) == after

    fourth = stored(stage["decontamination"](spark, third, SF), "d")
    assert fourth.columns == docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contaminated(after, items) if r[5]}
    assert rows(fourth) == [x for x in after if x[0] not in bad]

    last = stage["packing"](spark, fourth, SF).collect()
    assert {r.doc_id for r in last} == {x[0] for x in after} - bad
    whole = corpus_pipeline.run(spark, SF).collect()
    place = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(place, whole)) == sorted(map(place, last))


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "none")
    assert docs.count() == 0
