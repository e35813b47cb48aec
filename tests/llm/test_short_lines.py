"""Lines of one to four words in line dedup, by the operator and by the registered query."""

from __future__ import annotations

import hashlib

from chronoframe.llm import lines, queries

from . import brute

SF = "/root/testdata/sf0.001"
TEXTS = ["and ornd.\nfoo", "ornd. AND and\nbar\n\n \t", "a b c d", "d c b a\na b c\na b c e", "a b c d e", "p q r s t\nq r s t", "foo foo\nbar baz\nfoo", None, "", "a b\nb a\nb"]


def kept(docs, gone):
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if (d, i) not in gone) for d, t in docs}


def test_lines_of_few_words(spark):
    docs = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), lines.LEAST_WORDS).collect()}
    gone = brute.line_matches(docs, 1)
    assert {(1, 0), (3, 0), (4, 0), (5, 1), (6, 0), (6, 2), (9, 1)} == gone
    assert {d: r.text or "" for d, r in got.items()} == kept(docs, gone)
    assert sum(r.n_removed for r in got.values()) == len(gone)


def test_query_has_no_floor(spark):
    docs = sorted((r.doc_id, r.text) for r in queries.documents(spark, SF).select("doc_id", "text").collect())
    gone = brute.line_matches(docs, 1)
    assert gone != brute.line_matches(docs, 5)
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in kept(docs, gone).items()}
    assert {r.doc_id: r.kept_sha256 for r in queries.QUERIES["op8_line_dedup"](spark, SF).collect()} == want
