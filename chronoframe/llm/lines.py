"""Line deduplication across the corpus by an exact set-similarity join; DataFrame functions only.

A line is the set of its words.  Words are ordered from rare to frequent.  Of two sets of n <= m words
and Jaccard similarity 0.8 or more, the smaller has a common word among its first n - ceil(8 n / 9) + 1
and the larger among its first m - ceil(0.8 m) + 1 (the prefix filter; the shorter prefix serves for
partners that are no smaller).  Equal sets are put together first, and numbered in the order of their
first lines.

Sets then meet in two steps.  First each is held against the earliest set that has one of its rarest
words and its size band; in a large group of near copies nearly every member is settled here, by
one comparison.  Then prefix rows meet by word, and by size band where the word is frequent, under the length and
positional filters and a bound from parity bits; two sets that are both settled do not meet
again.  Of what passes each set is held against its closest partner first, against the others where that fails;
exact intersection of the words decides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import CLEANUP, bounded, by_text, col, discard, during, fresh, match_rows, stored

#: Cells of the table of word frequencies; words share a cell by hash.  Its size bounds what is sent with the plan.
CELLS = 1 << 18
#: While this is set, a task counts words in a faster map that has room for all cells.
FAST_CELLS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: Lines with fewer words are never removed by op8 and the pipeline: only lines without words stay out.
LEAST_WORDS = 1
PERCENT = 80
#: Rarest words of a set by which it meets the earliest set.
LEADS = 8
#: Words of this frequency class (binary logarithm of their number) and above meet by size band too.
FREQUENT = 7
#: Sets of this size and above have 256 more parity bits, by which pairs are tried before their words are read.
#: Below it similar sets differ in 21 words at most, and 64 bits of unrelated sets in 32 on average.
WIDE = 96
#: Prefix rows meet in so many passes, each with its share of the words, so that no more than that lies on disk.
PASSES = 4
#: Bits of the word hash in a key, below five bits of frequency class; sets that share a key by chance only cost a test.
KEY_BITS = 26
#: Hashes hardly repeat within a page: a dictionary of them costs time and saves no bytes.
PLAIN = {"parquet.enable.dictionary": "false"}
#: Characters of a plan with the table of word frequencies that the driver keeps as text.
PLAN_TEXT = "20000"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(text: Column) -> Column:
    """The text with A-Z in lower case and a space for each white character but the line feed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    rare = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\v")) | F.contains(text, F.lit("\f"))
    # where all characters are ASCII, lower() changes just A-Z, and faster
    ascii = F.length(text) == F.octet_length(text)
    return F.when(rare, F.translate(text, _UPPER + "\t\r\v\f", _LOWER + "    ")).when(ascii, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line, _line): line numbers from 0, and the lines in plain form; a null text is one empty line."""
    doc_id, key = by_text(docs)
    rows = docs.select(doc_id.alias("doc_id"), key.alias("key"), _plain(col("text")).alias("_text"))
    return rows.select("doc_id", "key", F.posexplode(F.split("_text", "\n")).alias("line", "_line"))


def word_hashes(lines: DataFrame) -> DataFrame:
    """(doc_id, key, line, n, words): the number of words of each line, and the hashes of its distinct ones."""
    rows = lines.select("doc_id", "key", "line", F.transform(F.split("_line", " "), lambda w: F.xxhash64(w)).alias("_all"))
    rows = rows.select("doc_id", "key", "line", F.array_remove("_all", F.xxhash64(F.lit(""))).alias("_all"))
    return rows.select("doc_id", "key", "line", F.size("_all").alias("n"), F.array_distinct("_all").alias("words"))


def line_words(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line, n, size, set, bits, words): for each line its words, the distinct ones, their number, hash and parity bits, and 31 bits of each hash."""
    rows = word_hashes(numbered_lines(docs))
    rows = rows.select("doc_id", "key", "line", "n", F.size("words").alias("size"), F.sort_array("words").alias("words"))
    return rows.select("doc_id", "key", "line", "n", "size", F.xxhash64("words").alias("set"), parities("words").alias("bits"), F.transform("words", lambda h: F.call_function("shiftrightunsigned", h, F.lit(33)).cast("int")).alias("words"))


def parities(words: str) -> Column:
    """64 bits: in each the parity of the number of hashes that fall there."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))))


def wide_parities(words: str) -> Column:
    """Parities in four times 64 bits, from the ten highest of the 31 bits of each word."""

    def part(j: int) -> Column:
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftright", h, F.lit(21)).bitwiseAND(F.lit(63)))
        return F.aggregate(words, F.lit(0).cast("bigint"), lambda bits, h: F.when(F.call_function("shiftright", h, F.lit(27)).bitwiseAND(F.lit(3)) == j, bits.bitwiseXOR(bit(h))).otherwise(bits))

    return F.array(*[part(j) for j in range(4)])


def rarity(words: DataFrame, cells: int = CELLS) -> np.ndarray:
    """For each cell the binary logarithm of the number of its words in the corpus, up to 31.

    Any order that all lines share gives a right result; this one only has to put frequent words last.
    """
    cell = F.explode("words").alias("h")
    counts = words.select(cell).groupBy(F.col("h").bitwiseAND(F.lit(cells - 1)).alias("c")).agg(F.count("*").alias("n"))
    table = np.zeros(cells, np.uint8)
    with during(words.sparkSession, {FAST_CELLS: str(max(16, cells.bit_length())), CLEANUP: "true"}):
        found = counts.select("c", F.least(F.length(F.bin("n")), F.lit(31)).alias("n")).toArrow()  # at most `cells` rows
    table[found["c"].to_numpy()] = found["n"].to_numpy()
    return table


def _key(table: np.ndarray):
    """The key of a word's hash: its frequency class in the high bits, the hash below, so that keys sort from rare to frequent."""
    # one literal of bytes: the driver holds no object for each cell and prints two characters for it
    classes = F.lit(table.astype(np.uint8).tobytes())

    def key(h: Column) -> Column:
        rank = F.ascii(F.substring(classes, h.bitwiseAND(F.lit(len(table) - 1)) + 1, F.lit(1)).cast("string"))
        found = F.call_function("shiftleft", rank, F.lit(KEY_BITS)).bitwiseOR(F.call_function("shiftrightunsigned", h, F.lit(31 - KEY_BITS)))
        return F.coalesce(found, F.lit(0))  # there are no nulls; arrays whose type says so are sorted as plain integers

    return key


def similar(inter, na, nb):
    return (100 + PERCENT) * inter >= PERCENT * (na + nb)  # 100 * inter >= PERCENT * union, with one use of inter


def _longer_prefix(n: Column) -> Column:
    """Words of a set of n among which one is common with any similar set."""
    return n - F.call_function("div", PERCENT * n.cast("bigint") + 99, F.lit(100)).cast("int") + 1


def _shorter_prefix(n: Column) -> Column:
    """The same for similar sets that are no smaller."""
    return n - F.call_function("div", 2 * PERCENT * n.cast("bigint") + (99 + PERCENT), F.lit(100 + PERCENT)).cast("int") + 1


def _band(n: Column) -> Column:
    """Similar sizes lie in one band or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100 / PERCENT))).cast("int")


def may_match(na, nb, bits_a, bits_b):
    """False where sizes, or bits that differ, leave too few words to share: at most (na + nb - differing) / 2 are shared."""
    best = F.shiftright(na + nb - F.bit_count(bits_a.bitwiseXOR(bits_b)), 1)
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & similar(best, na, nb)


def _meeting(word: str, band: Column) -> Column:
    """Word and band (from -1) in one number, by which rows are dealt and sorted."""
    return F.shiftleft(F.col(word).cast("bigint"), 8).bitwiseOR((band + 1).cast("bigint"))


def _led(sets: DataFrame) -> DataFrame:
    """(a, b, apart): each set b with the closest, by the bits, of the leaders of its rarest words and its band, where bits allow a match.

    A word and band have two leaders: the earliest set, which is often the same for many words, and one by chance.
    """
    # no number is null; it is said here since the join asks for it, and both uses of the dealt rows must be the same
    rows = sets.where((F.col("size") * (100 - PERCENT) >= PERCENT) & F.col("num").isNotNull()).select("num", "size", "bits", F.explode(F.slice("head", 1, LEADS)).alias("word"))
    # dealt once, for the leaders and for those who meet them; a leader brings its size and bits, so only pairs that may match go on
    rows = rows.select(_meeting("word", _band(F.col("size"))).alias("at"), F.col("num").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("bb")).repartition("at")
    chance = F.xxhash64("at", "b")
    leads = rows.groupBy("at").agg(
        F.max("b").alias("last"),
        *[f.alias(n) for order, names in (("b", ("a1", "na1", "ba1")), (chance, ("a2", "na2", "ba2"))) for f, n in zip((F.min_by(c, order) for c in ("b", "nb", "bb")), names)],
    ).where("a1 < last")
    met = rows.join(leads.hint("shuffle_hash"), "at").where("a1 < b")

    def apart(i: int) -> Column:
        """The least number of bits and words by which the two differ; null where they cannot match."""
        n, bits = F.col(f"na{i}"), F.col(f"ba{i}")
        return F.when((F.col(f"a{i}") < F.col("b")) & may_match(n, F.col("nb"), bits, F.col("bb")), F.bit_count(bits.bitwiseXOR(F.col("bb"))).cast("bigint") + F.abs(n - F.col("nb")))

    near = met.select("b", "a1", "a2", apart(1).alias("apart1"), apart(2).alias("apart2")).where("apart1 IS NOT NULL OR apart2 IS NOT NULL")
    second = F.col("apart1").isNull() | (F.col("apart2") < F.col("apart1"))
    near = near.select("b", F.when(second, F.col("a2")).otherwise(F.col("a1")).alias("a"), F.least("apart1", "apart2").alias("apart"))
    return near.groupBy("b").agg(F.min_by("a", "apart").alias("a"), F.min("apart").alias("apart")).select("a", "b", "apart")


def _prefix_rows(sets: DataFrame, shorter: bool, turn: int) -> DataFrame:
    """A row for each prefix word of this pass in each set, with size, position and `settled` in one number.

    Similar sets meet `at` a word, with the band -1 for words that are not frequent.
    """
    n = F.col("size")
    head = F.slice("head", F.lit(1), _shorter_prefix(n) if shorter else _longer_prefix(n))
    rows = sets.where(n * (100 - PERCENT) >= PERCENT).select("num", "size", "bits", "wide", "settled", F.posexplode(head).alias("pos", "word")).where(F.pmod("word", F.lit(PASSES)) == turn)
    shape = F.shiftleft(n.cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("bigint"), 1)).bitwiseOR(F.col("settled").cast("bigint"))
    frequent = F.col("word") >= FREQUENT << KEY_BITS
    if shorter:
        # a partner that is no smaller lies in the same band, or in the next where this position leaves room for one so large
        far = F.greatest(n, F.floor((100 * n.cast("bigint") - (100 + PERCENT) * F.col("pos")) / PERCENT))
        both = F.array(_band(n), _band(n) + 1)
        rows = rows.withColumn("band", F.explode(F.when(~frequent, F.array(F.lit(-1))).when(_band(far) > _band(n), both).otherwise(F.array(_band(n)))))
    else:
        rows = rows.withColumn("band", F.when(frequent, _band(n)).otherwise(-1))
    return rows.select(_meeting("word", F.col("band")).alias("at"), "num", "bits", "wide", shape.alias("shape"))


def _met(sets: DataFrame) -> DataFrame:
    """(a, b, apart), a < b: sets that share a prefix word and pass the filters, where b is not `settled`; no two settled ones meet.

    Similar sets pass at the first word that they share; `apart` is the number of bits and words by which the two differ at least.

    Each pass is stored by itself: the shuffled rows of the one before are gone by then.
    """

    def meet(smaller: DataFrame, larger: DataFrame) -> DataFrame:
        x, y = (df.select("at", *[F.col(c).alias(f"{p}_{c}") for c in ("num", "bits", "wide", "shape")]) for p, df in (("x", smaller), ("y", larger)))
        n, m = (F.shiftright(f"{p}_shape", 32) for p in "xy")
        x_pos, y_pos = (F.shiftright(f"{p}_shape", 1).bitwiseAND(F.lit((1 << 31) - 1)) for p in "xy")
        x_settled, y_settled = (F.col(f"{p}_shape").bitwiseAND(F.lit(1)) == 1 for p in "xy")
        order = (n < m) | ((n == m) & (F.col("x_num") < F.col("y_num")))
        # where the first common word meets, the two share what stands from it on at most
        best = F.least(n - x_pos, m - y_pos)
        close = (100 * n >= PERCENT * m) & similar(best, n, m) & may_match(n, m, F.col("x_bits"), F.col("y_bits"))
        # of two long sets 256 bits more
        differing = reduce(Column.__add__, [F.bit_count(F.get("x_wide", F.lit(j)).bitwiseXOR(F.get("y_wide", F.lit(j)))) for j in range(4)])
        closer = differing.isNull() | similar(F.shiftright(n.cast("int") + m.cast("int") - differing, 1), n, m)
        later = ~F.when(F.col("x_num") < F.col("y_num"), y_settled).otherwise(x_settled)
        return x.join(y, "at").where(order & later & close & closer)

    open_, settled = sets.where("NOT settled"), sets.where("settled")
    n, m = (F.shiftright(f"{p}_shape", 32).cast("int") for p in "xy")
    apart = F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits"))).cast("int") + m - n
    both = F.least("x_num", "y_num").alias("a"), F.greatest("x_num", "y_num").alias("b"), apart.alias("apart")
    parts = []
    for turn in range(PASSES):
        pairs = meet(_prefix_rows(sets, True, turn), _prefix_rows(open_, False, turn)).select(*both)
        rest = meet(_prefix_rows(open_, True, turn), bounded(_prefix_rows(settled, False, turn))).select(*both)
        parts.append(stored(pairs.unionByName(rest), "met"))
    return reduce(DataFrame.unionByName, parts).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(num) of each b that some pair (a, b, apart) shows to match: exact intersection of the sets of word hashes.

    One match is enough: the closest partner is tried first, and all others only where that one fails.
    """
    pairs = stored(pairs, "pairs")
    members = pairs.select(F.col("a").alias("num")).distinct().union(pairs.select("b").distinct()).distinct()
    needed = members.join(sets.select("num", "at.*"), "num")
    needed = stored(needed, "needed")
    texts = match_rows(docs, needed.select("doc_id", "key").distinct(), "left_semi")
    # only the lines of pairs are put in plain form and split into words
    names = needed.withColumnsRenamed({"doc_id": "_id", "key": "_key", "line": "_at"})
    doc_id, key = by_text(texts)
    lines = texts.select(doc_id.alias("doc_id"), key.alias("key"), F.posexplode(F.split(F.coalesce(col("text"), F.lit("")), "\n")).alias("line", "_line"))
    lines = lines.join(bounded(names), lines["doc_id"].eqNullSafe(F.col("_id")) & (lines["key"] == F.col("_key")) & (lines["line"] == F.col("_at")))
    hashes = F.transform(F.split(_plain(F.col("_line")), " "), lambda w: F.xxhash64(w))
    words = stored(lines.select("num", F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit(""))).alias("words")), "words", **PLAIN)
    if words.count() > needed.count():  # rows that repeat an id and text give a line twice
        once = stored(words.dropDuplicates(["num"]), "words", **PLAIN)
        discard(words)
        words = once

    def matched(some: DataFrame) -> DataFrame:
        both = some.join(words.select(F.col("num").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("num").alias("b"), F.col("words").alias("wb")), "b")
        inter = F.size(F.array_intersect("wa", "wb"))
        return stored(both.where(similar(inter, F.size("wa"), F.size("wb"))).select(F.col("b").alias("num")).distinct(), "matched")

    found = matched(pairs.groupBy("b").agg(F.min(F.struct("apart", "a"))["a"].alias("a")))
    others = pairs.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").join(bounded(found.withColumnRenamed("num", "b")), "b", "left_anti").select("b")
    if not others.isEmpty():
        more = matched(pairs.join(bounded(stored(others, "others")), "b", "left_semi"))
        found = found.unionByName(more)
    discard(pairs, needed, words)
    return found


def removed_lines(docs: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, key, line) of the lines of at least `least` words that match an earlier one, in the order of doc_id, key and line.

    `key` is a hash of the text, which tells rows apart that share an id or have none; null ids come
    first.  Rows that repeat an id and its text count once, and all of them lose the same lines.
    Matches are judged on the input, so a removed line still removes later ones.  Null texts have no
    lines of words.  Lines of equal words in another order or number are equal.
    """
    each = stored(line_words(docs), "lines", **PLAIN)
    table = rarity(each)
    long = each.where((F.col("n") >= least) & (F.col("n") > 0))
    keys = F.sort_array(F.transform("words", _key(table)))
    heads = long.select("set", "size", "bits", F.struct("doc_id", "key", "line").alias("at"), F.slice(keys, F.lit(1), _longer_prefix(F.col("size"))).alias("head"), F.when(F.col("size") >= WIDE, wide_parities("words")).alias("wide"))
    # one row for each distinct set, with its first line; copies are combined before the shuffle
    first = heads.groupBy("set", "size", "bits").agg(F.min("at").alias("at"), F.first("head").alias("head"), F.first("wide").alias("wide"), F.count("*").alias("equal"))
    ordered = first.repartitionByRange("at").sortWithinPartitions("at").withColumn("num", F.monotonically_increasing_id())
    with during(docs.sparkSession, {"spark.sql.maxPlanStringLength": PLAN_TEXT}):
        sets = stored(ordered, "sets", **PLAIN)
    firsts = bounded(sets.where("equal > 1").select("set", "size", "bits", "at"))
    copies = long.select("set", "size", "bits", F.struct("doc_id", "key", "line").alias("own")).join(firsts, ["set", "size", "bits"]).where(F.col("own") != F.col("at")).select("own.*")
    copies = stored(copies.distinct(), "copies")
    discard(each)
    found = _verified(_led(sets), sets, docs)
    light = sets.select("num", "size", "bits", "head", "wide").join(bounded(found.select("num", F.lit(True).alias("_settled"))), "num", "left")
    more = _verified(_met(light.select("num", "size", "bits", "head", "wide", F.coalesce("_settled", F.lit(False)).alias("settled"))), sets, docs)
    near = sets.select("num", "at").join(bounded(found.unionByName(more).distinct()), "num", "left_semi").select("at.*")
    return copies.unionByName(near)


def deduplicated(docs: DataFrame, least: int = 5) -> tuple[DataFrame, str]:
    """The documents without their removed lines, in a text column of their own, and the name of a further column: the numbers of the lines that went."""
    gone, = fresh(docs, "_gone")
    found = stored(removed_lines(docs, least).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("line")).alias(gone)), "gone")
    return match_rows(docs, found, "left"), gone


def dedup_lines(docs: DataFrame, least: int = 5) -> DataFrame:
    """The documents without their removed lines; other columns pass, `n_chars` (if there) is counted anew.

    Lines of fewer than `least` words stay; op8 and the pipeline pass LEAST_WORDS.

    Adds n_lines and n_removed, in the place of columns of these names.  A null text stays null, and
    has no lines.  A document keeps its row even when all its lines go; its text is then empty.
    """
    rows, gone = deduplicated(docs, least)
    n_lines = F.coalesce(F.size(F.split(col("text"), "\n")), F.lit(0)).cast("bigint")
    n_removed = F.when(col("text").isNull(), 0).otherwise(F.coalesce(F.size(gone), F.lit(0))).cast("bigint")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*[_kept(c, gone) for c in kept], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def _kept(name: str, gone: str) -> Column:
    """A column of the documents as it is after lines went."""
    text = F.array_join(F.filter(F.split(col("text"), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    if name == "text":
        return F.when(F.size(gone) > 0, text).otherwise(col("text")).alias("text")
    if name == "n_chars":
        return F.when(F.size(gone) > 0, F.length(text)).otherwise(F.coalesce(F.length(col("text")), F.lit(0))).cast("bigint").alias("n_chars")
    return col(name)


def without_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The documents without their removed lines, with just the columns that they have."""
    rows, gone = deduplicated(docs, least)
    return rows.select(*[_kept(c, gone) for c in docs.columns])
