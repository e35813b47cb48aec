"""Shared ids, null ids, clashing and dotted column names, in every operator that passes documents on."""

from __future__ import annotations

import numpy as np
import pytest

from chronoframe.llm import decontaminate, jaccard, lines, packing, quality, repeats, sharding, token_files

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau"
LONG = " ".join(f"word{i}" for i in range(80))
ROWS = [(None, LONG), (None, "x"), (3, LONG + " end"), (4, LONG + "\nown line here"), (4, "### " * 90), (4, PASSAGE), (5, None), (5, ""), (6, LONG), (6, LONG)]
CLASH = ["_gone", "_id", "_key", "n_removed", "n_lines", "_row", "_group", "key", "words", "a.b", "_lang"]


@pytest.fixture(scope="module")
def docs(spark):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASH)
    return spark.createDataFrame([(d, t, "en", "s", None, *range(len(CLASH))) for d, t in ROWS], columns)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_quality_keeps_rows_by_their_own_text(docs):
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns
    assert pairs(kept) == sorted(((d, t) for d, t in ROWS if t and t.startswith("word")), key=str)


def test_lines_keep_clashing_columns(docs):
    kept = lines.without_lines(docs)
    assert kept.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(CLASH))) for r in kept.collect())
    # null ids come first, and of them the line of the long text; rows that repeat an id and text lose the same
    assert pairs(kept) == sorted([(None, LONG), (None, "x"), (3, ""), (4, "own line here"), (4, "### " * 90), (4, PASSAGE), (5, None), (5, ""), (6, ""), (6, "")], key=str)
    assert lines.dedup_lines(docs).columns == [*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"]


def test_clean_judges_rows_by_their_own_text(spark, docs):
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string"))
    assert kept.columns == docs.columns
    assert pairs(kept) == sorted(((d, t) for d, t in ROWS if t != PASSAGE), key=str)


def test_rows_without_id_link_no_others(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [(1, " ".join(words[:100])), (None, " ".join(words[:118])), (2, " ".join(words[:140]))]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, None: None}


def test_repeats_with_shared_ids(docs):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs, with_bytes=False).collect())
    n = len(LONG)
    want = [(0, n, 0), (0, 1, 0), (3, n + 4, 0), (4, n + 14, n), (4, 360, 0), (4, len(PASSAGE), 0), (5, 0, 0), (5, 0, 0), (6, n, n), (6, n, n)]
    assert got == sorted(want)


def test_other_operators_take_all_rows(docs, tmp_path):
    import public_tokenizers

    assert sharding.hilbert_shards(docs).count() == len(ROWS)
    sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    again = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert pairs(again) == sorted(ROWS, key=str) and set(again.columns) == {*docs.columns, "shard"}
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == len(ROWS)
    assert token_files.token_digest(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == len(ROWS)


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2)])
def test_hilbert_curve_takes_unit_steps(n, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
    at = sharding.hilbert_index(points, bits)
    assert sorted(at.tolist()) == list(range(len(points)))
    path = points[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_prune_on_language_and_size(spark):
    """Shards that must be read for one language, the largest quarter of sizes or of sources: about half of them, where texts are distinct."""
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat(id, repeat(' abc', cast(pmod(xxhash64(id, 1), 200) AS int))) AS text", "array('de','en','es','fr')[pmod(xxhash64(id, 2), 4)] AS lang", "concat('s', lpad(pmod(xxhash64(id, 3), 20), 2, '0')) AS source")
    found = sharding.hilbert_shards(rows).join(rows.select("doc_id", "lang", "source"), "doc_id").groupBy("shard").agg({"lang": "max", "size": "max", "source": "max"}).collect()
    assert sum(r["max(lang)"] >= "es" for r in found) <= 5
    assert sum(r["max(size)"] > 610 for r in found) <= 5
    assert sum(r["max(source)"] >= "s15" for r in found) <= 5
