"""Token counts by a linear longest-match automaton.

A trie of the vocabulary has, for each node, a failure link to the node where matching goes on when no
longer piece is possible, and the number of pieces that are then certain.  One pass over a word's
letters thus counts its greedy longest-match pieces; no piece is ever built.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.tokens import byte_letters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
REMEMBERED = 500_000


class Automaton(dict):
    """`self[word]`: the number of pieces of a word, whose first letter is a space; the dict is a bounded cache."""

    def __init__(self, vocabulary: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(ends)
                    self.next.append({})
                    ends.append(False)
                at = to
            ends[at] = at > 0
        # -1: no way to go on, so the word as a whole is one unknown piece
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, v in self.next[parent].items():
                    below.append(v)
                    if ends[v]:
                        self.fail[v], self.popped[v] = 0, 1
                        continue
                    z, n = self.fail[parent], self.popped[parent]
                    while z >= 0 and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], n
            level = below
        self.letters = byte_letters()

    def count(self, letters: str) -> int:
        at, n = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for c in letters:
            while (to := step[at].get(c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at > 0:
            n += popped[at]
            at = fail[at]
        return n if at == 0 else 1

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.count((" " + word).encode().decode("latin-1").translate(self.letters))
        return found


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The worker's automaton for the byte-level vocabulary in a tokenizer file; built once in each process."""
    if path not in _automata:
        with open(path, encoding="utf-8") as f:
            _automata[path] = Automaton(list(json.load(f)["model"]["vocab"]))
    return _automata[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens): greedy longest-match pieces of the words of whole texts, each with a space before it.

    Words are runs of bytes other than ASCII white space.  Null and empty texts have no words.  A word
    that the vocabulary cannot spell is one piece.  Repeated rows are counted each; extra columns are
    left out; an empty table gives no rows.
    """

    def run(batches):
        own = automaton(vocabulary)
        for batch in batches:
            words = [WORD.findall(t or "") for t in batch.column("_text").to_pylist()]
            counts = [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(own.__getitem__, w)) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")
