"""Leaders of line dedup are dealt once and only pairs that may match go on; repeated rows, other letters and white characters."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from chronoframe.llm import common, lines

from . import brute


def prefix_sets(spark, docs):
    words = lines.line_words(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    rows = [(i, r.size, r.bits, sorted(r.words)) for i, r in enumerate(words)]
    return spark.createDataFrame(rows, "num bigint, size int, bits bigint, head array<int>")


def test_leaders_are_dealt_once(spark):
    """Rows are shuffled by word once, for leaders and members, and no pair is shuffled before its bits are compared."""
    r = random.Random(3)
    docs = [(d, " ".join(["hub", *(f"w{r.randrange(10**6)}" for _ in range(20))])) for d in range(60)]
    docs += [(100 + d, " ".join(["hub", *(f"c{i}" for i in range(20)), f"x{d}"])) for d in range(20)]
    sets = prefix_sets(spark, docs)
    found = lines._led(sets)
    got = {(x.a, x.b) for x in found.collect()}
    assert got and all(a < b for a, b in got)
    assert {b for _, b in got} == set(range(61, 80))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    again = [x for x in plan.splitlines() if "ReusedExchange" in x]
    dealt = [x for line in plan.splitlines() if line not in again for x in re.findall(r"Exchange hashpartitioning\((\w+)#", line)]
    assert sorted(dealt) == ["at", "b"] and len(again) == 1


def test_settings_return(spark):
    key = common.CLEANUP
    spark.conf.unset(lines.FAST_CELLS)
    before = spark.conf.get(key, None)
    table = lines.rarity(lines.line_words(spark.createDataFrame([(1, "a b a\na c")], "doc_id bigint, text string")), 64)
    assert int(table.sum()) and spark.conf.get(key, None) == before
    try:
        with common.during(spark, {key: "true", "spark.sql.session.some": "1"}):
            assert spark.conf.get(key) == "true" and spark.conf.get("spark.sql.session.some") == "1"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(key, None) == before and spark.conf.get("spark.sql.session.some", None) is None


def test_repeated_rows_and_other_letters(spark):
    words = [f"w{i}" for i in range(30)]
    near = [" ".join([*words[:29], f"É{d}\tÀB\vA\fb\r"]) for d in range(4)]
    docs = [(1, near[0] + "\n\nab É"), (1, near[0] + "\n\nab É"), (2, near[1]), (2, near[1]), (2, near[1]), (3, "AB É\nAB é\n" + near[2]), (4, " ".join(words)), (5, near[3].upper())]
    got = {(x.doc_id, x.line) for x in lines.removed_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), 1).collect()}
    assert got == brute.line_matches(sorted(set(docs)), 1)
    assert {(2, 0), (3, 0), (3, 2)} <= got and (3, 1) not in got


def test_table_is_one_value(spark):
    """The table of word frequencies is bytes in the plan, not text that is split into an object for each cell."""
    docs = spark.createDataFrame([(1, "a b a\na c")], "doc_id bigint, text string")
    words = lines.line_words(docs)
    key = lines._key(lines.rarity(words))
    plan = words.select(key(F.element_at("words", 1)).alias("k"))._jdf.queryExecution().analyzed().toString()
    assert "split(" not in plan.split("Project")[1] and len(plan) < 2.2 * lines.CELLS
