"""Benchmark decontamination by winnowing; DataFrame functions only.

Each text keeps, for every window of 13 words, the least hash of its k-word grams.  A span of 13 words
that a document shares with a benchmark item has the same least hash in both, so joining the kept
hashes finds every such span.  Hits are then extended to whole windows and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import bounded, match_rows, stored

SPAN, GRAM = 13, 8


def words_of(text: Column) -> Column:
    """Lower-cased A-Z; runs of letters, digits and characters beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _with_next(df: DataFrame, name: str, a: str, b: str, step: int, join) -> DataFrame:
    """Column `name`: join(a[i], b[i + step]) for every i where both are there."""
    n = F.greatest(F.size(b) - step, F.lit(0))
    return df.withColumn(name, F.transform(F.slice(a, F.lit(1), F.least(n, F.size(a))), lambda x, i: join(x, F.get(F.col(b), i + step))))


def with_minima(df: DataFrame) -> DataFrame:
    """Adds `minima`: for the 13-word window that starts at each word, the least hash of its 8-word grams."""
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    both = lambda x, y: F.xxhash64(x, y)
    for name, a, step in (("_g2", "_h", 1), ("_g4", "_g2", 2), ("_g8", "_g4", 4)):
        df = _with_next(df, name, a, a, step, both)
    df = _with_next(df, "_m2", "_g8", "_g8", 1, F.least)
    df = _with_next(df, "_m4", "_m2", "_m2", 2, F.least)
    df = _with_next(df, "minima", "_m4", "_m2", 4, F.least)
    return df.drop("_h", "_g2", "_g4", "_g8", "_m2", "_m4")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, span, window): the windows of each item as words joined by spaces; null and empty items have none."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("span", F.least(F.size("words"), F.lit(SPAN)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("span") + 1)
    return rows.select("item_id", "span", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("span")), " "))).alias("window")).distinct()


def gram_hashes(span: int) -> Column:
    """A hash for the `span` words from each word on, for items shorter than a window."""
    joined = lambda i: F.xxhash64(F.array_join(F.slice("words", i, F.lit(span)), " "))
    return F.when(F.size("words") >= span, F.transform(F.sequence(F.lit(1), F.size("words") - span + 1), joined)).otherwise(F.array().cast("array<bigint>"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit when it lies in an occurrence of a 13-word window of an item; an item of fewer words
    is one window.  A document is contaminated when words are hit and they are a twentieth of its
    words or more.  Null and empty texts have no words and no hits.  Documents that share an id are
    told apart by their text, as are those without an id; repeated rows get equal results.  Extra columns
    are left out.
    """
    windows = stored(item_windows(benchmark), "windows")
    shorter = sorted(r[0] for r in windows.where(F.col("span") < SPAN).select("span").distinct().collect())  # at most 12 numbers
    prints = stored(
        with_minima(benchmark.select(words_of(F.col("text")).alias("words"))).select(F.explode_outer("minima").alias("print"), F.lit(SPAN).alias("span")).where("print IS NOT NULL")
        .unionByName(windows.where(F.col("span") < SPAN).select(F.xxhash64("window").alias("print"), "span")).distinct(), "prints",
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    texts = texts.withColumn("_key", F.xxhash64("_text"))

    def with_prints(df: DataFrame) -> DataFrame:
        df = with_minima(df.withColumn("words", words_of(F.col("_text"))))
        return df.withColumns({f"short{n}": gram_hashes(n) for n in shorter})

    kinds = [("minima", SPAN), *[(f"short{n}", n) for n in shorter]]
    # the outer form, since Spark derives a filter from the inner one and would compute the arrays twice
    # one row for each distinct print; only those that an item has come through the join
    all_prints = F.concat(*[_tagged(c, n) for c, n in kinds])
    met = with_prints(texts).select("doc_id", "_key", F.explode_outer(all_prints).alias("p")).select("doc_id", "_key", "p.print", "p.span").join(bounded(prints), ["print", "span"])
    met = stored(met.select("doc_id", "_key").distinct(), "met")
    near = _joined(texts, met, "inner")
    # in these documents every window is written out, and looked up by its print before it is compared
    starts = F.concat(*[_windows(c, n) for c, n in kinds])
    hits = with_prints(near).select("doc_id", "_key", F.explode_outer(starts).alias("w")).select("doc_id", "_key", "w.*")
    hits = hits.join(bounded(prints), ["print", "span"], "left_semi").join(bounded(windows), ["window", "span"])
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "span")), lambda s: F.sequence(s["start"], s["start"] + s["span"] - 1))))
    found = hits.groupBy("doc_id", "_key").agg(F.size(covered).cast("bigint").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    found = stored(found, "found")
    rows = _joined(texts.select("doc_id", "_key", F.size(words_of(F.col("_text"))).cast("bigint").alias("n_words")), found, "left")
    items = F.coalesce("_items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.col("_key").alias("text_key")
    )


def _joined(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """By id and text key; null ids match null ids."""
    found = found.withColumnsRenamed({"doc_id": "_id", "_key": "_found"})
    return texts.join(bounded(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_found")), how).drop("_id", "_found")


def _tagged(column: str, span: int) -> Column:
    return F.transform(F.array_distinct(column), lambda x: F.struct(x.alias("print"), F.lit(span).alias("span")))


def _windows(column: str, span: int) -> Column:
    """(start, span, print, window) of every window of `span` words; positions count from 1."""
    at = F.when(F.size(column) > 0, F.sequence(F.lit(1), F.size(column))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(span).alias("span"), F.get(F.col(column), i - 1).alias("print"), F.array_join(F.slice("words", i, F.lit(span)), " ").alias("window")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns; rows that share an id are judged each by its text."""
    bad = contamination(docs, benchmark).where("contaminated").select("doc_id", F.col("text_key").alias("key")).distinct()
    return match_rows(docs, stored(bad, "contaminated"), "left_anti")
