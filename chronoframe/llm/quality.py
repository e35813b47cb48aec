"""Quality rules whose limits follow the corpus: a mergeable quantile sketch for each language and source.

The sketch counts values in buckets that are exact up to 31 and then 32 to each power of two, so a
quantile is off by 1/32 at most.  Bucket counts add up in any order, so partial sketches merge before
the shuffle and the limits do not depend on how rows are dealt out.

A group's own limit is the fence q(high) + spread * (q(high) - q(0.5)) of its sketch.  The fewer documents
a group has, the nearer its limit lies to that of its language, and that of a language to the
corpus's: each is the mean of the two, weighted by the documents and by SHRINK.  A document is rejected
when a count is above what the limit allows for its length by more than CERTAIN times the count's own
square root, so that one repeated line of three says nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm import wordhash as W
from chronoframe.llm.common import bounded, by_text, col, fresh, stored

#: What is judged: a count, what it is held against, units to one, the higher quantile, and the spread.
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 10_000, 0.75, 8),
    "dup_rate": ("n_dup_lines", "n_lines", 10_000, 0.9, 8),
    "repeat_rate": ("n_repeat_words", "n_words", 10_000, 0.9, 8),
    "word_length": ("word_chars", "n_words", 100, 0.9, 4),
}
MIDDLE = 0.5
#: Documents that the next larger group counts as, in the mean of limits.
SHRINK = 100
CERTAIN = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes that begin a code point and are not white space.
_VISIBLE = (np.arange(256) & 0xC0 != 0x80) & ~W.WHITE
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that is there twice or more."""
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[back] > 1


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text; null and empty texts have zeros."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for _, data, offsets in W.chunks(texts):
        rows = len(offsets) - 1
        salt = W.mix(np.arange(1, rows + 1, dtype=np.uint64))
        starts, ends, first = W.word_bounds(data, offsets, W.WHITE)
        n_words = np.diff(first)
        words = W.word_hashes(data, starts, ends, W.SAME)
        owner = np.repeat(np.arange(rows), n_words)
        hit = np.zeros(len(words) + 3, dtype=bool)
        three = W.shingle_hashes(words, 3)
        if len(three):
            at = np.flatnonzero(owner[: len(three)] == owner[2:])  # windows within one text
            at = at[_repeated(three[at] ^ salt[owner[at]])]
            for i in range(3):
                hit[at + i] = True
        # lines: from a text's start or after a line feed, to the next one or the text's end
        feeds = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
        line_starts = line_starts[line_starts <= len(data)]
        line_row = np.searchsorted(offsets, line_starts, "right") - 1
        inner = line_row < rows
        line_starts, line_row = line_starts[inner], line_row[inner]
        next_feed = np.append(feeds, len(data))[np.searchsorted(feeds, line_starts, "left")]
        line_ends = np.minimum(next_feed, offsets[line_row + 1])
        filled = np.searchsorted(starts, line_ends, "left") > np.searchsorted(starts, line_starts, "left")
        line_starts, line_ends, line_row = line_starts[filled], line_ends[filled], line_row[filled]
        keys = W.word_hashes(data, line_starts, line_ends, W.SAME) ^ salt[line_row]
        _, one = np.unique(keys, return_index=True)
        lines = np.bincount(line_row, minlength=rows)
        out["n_words"].append(n_words)
        out["word_chars"].append(_per_row(_VISIBLE[data], offsets))
        out["n_symbols"].append(_per_row(_SYMBOL[data], offsets))
        out["n_dup_lines"].append(lines - np.bincount(line_row[one], minlength=rows))
        out["n_repeat_words"].append(_per_row(hit[: len(words)], first))
        out["n_lines"].append(lines)
    return {c: np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for c, x in out.items()}


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text_key) and COUNTS for each document, over its whole text."""

    def count(batches):
        for batch in batches:
            found = text_counts(batch.column("_text"))
            kept = ("doc_id", "lang", "source", "text_key")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=[*kept, *COUNTS])

    rows = docs.select("doc_id", "lang", "source", by_text(docs)[1].alias("text_key"), F.col("text").alias("_text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source", "text_key"))
    return rows.mapInArrow(count, f"{kinds}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def bucket(x: Column) -> Column:
    """The least value of the sketch bucket of a count x >= 0."""
    shift = F.greatest(F.length(F.bin(x)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def rate(name: str) -> Column:
    """The whole number of units that a document has of a rate."""
    count, against, units, _, _ = RATES[name]
    return F.call_function("div", F.lit(units) * F.col(count), F.greatest(F.col(against), F.lit(1)))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n) over documents that pass the base rules; rows are added up before the shuffle."""
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("rate"), bucket(rate(name)).alias("bucket")) for name in RATES]))
    return counts.where("NOT base_failed").select("lang", "source", each).groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """(keys, docs_<mark>, a fence for each rate): from the merged sketches of the keys.

    The windows below run over buckets, of which a group has a few hundred at most.
    """
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*keys, "rate")
    ranked = merged.select(*keys, "rate", "bucket", F.sum("n").over(whole.orderBy("bucket")).alias("up"), F.sum("n").over(whole).alias("all"))
    quantile = lambda name, p: F.min(F.when((F.col("rate") == name) & (F.col("up") >= p * F.col("all")), F.col("bucket")))
    fence = lambda name, high, spread: quantile(name, high) + spread * (quantile(name, high) - quantile(name, MIDDLE))
    return ranked.groupBy(*keys).agg(F.max("all").alias(f"docs_{mark}"), *[fence(name, x[3], x[4]).cast("double").alias(f"{name}_{mark}") for name, x in RATES.items()])


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, a limit for each rate) for each group of the sketch; null is a value of its own."""
    group, lang, corpus = _fences(sketch, ["lang", "source"], "g"), _fences(sketch, ["lang"], "l"), _fences(sketch, [], "c")
    named = lang.withColumnRenamed("lang", "_l")
    rows = group.join(named, F.col("lang").eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(corpus))  # one row

    def limit(name: str) -> Column:
        of_lang = (F.col("docs_l") * F.col(f"{name}_l") + SHRINK * F.col(f"{name}_c")) / (F.col("docs_l") + SHRINK)
        return ((F.col("docs_g") * F.col(f"{name}_g") + SHRINK * of_lang) / (F.col("docs_g") + SHRINK)).alias(name)

    return rows.select("lang", "source", *[limit(name) for name in RATES])


def quality(docs: DataFrame) -> DataFrame:
    """One row for each document: counts, the base rules, the verdict of the adaptive limits, the limits and the text's key.

    Null and empty texts have no words and fail the base rules.  A null language or source is a group
    of its own.  Repeated rows are judged each; documents keep their verdict whatever their order.
    Extra columns are left out.  The limits are taken over the documents that pass the base rules; a
    document is kept when it passes them and no count is above its group's limit.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = stored(measured(docs).withColumn("base_failed", base), "counts")
    # a row for each group, with four limits
    found = bounded(limits(sketches(counts)).withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    rows = counts.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")

    def above(name: str) -> Column:
        count, against, units, _, _ = RATES[name]
        return units * F.col(count) > F.col(name) * F.col(against) + CERTAIN * units * F.sqrt(F.col(count).cast("double"))

    # a group without a limit has no document that passes the base rules
    kept = ~F.col("base_failed") & ~F.coalesce(reduce(or_, [above(name) for name in RATES]), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "lang", "source", "n_lines", *RATES, "text_key")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; rows that share an id are judged each by its text and group."""
    rejected = quality(docs).where("NOT kept").select("doc_id", F.col("text_key").alias("key"), "lang", "source").distinct()
    names = fresh(docs, "_id", "_key", "_lang", "_source")
    rejected = stored(rejected, "rejected").toDF(*names)
    doc_id, key = by_text(docs)
    same = doc_id.eqNullSafe(F.col(names[0])) & (key == F.col(names[1])) & col("lang").eqNullSafe(F.col(names[2])) & col("source").eqNullSafe(F.col(names[3]))
    return docs.join(bounded(rejected), same, "left_anti")
