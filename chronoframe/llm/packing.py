"""Packing token sequences into windows of a fixed length: bounded-space online best fit.

Each partition keeps a fixed number of open windows.  A piece goes into the window where it leaves
the least room; when it fits nowhere, the fullest window is emitted and a new one opened.  What is
open at the end goes to a second step that merges the leftovers of many partitions, best fit again,
largest first, in tasks that get a bounded number of them each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import stored
from chronoframe.llm.tokens import encoder

WINDOW, OPEN = 2048, 64
#: Partitions whose leftovers meet in one task: at most 64 * 512 windows.
MERGED = 512
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class OpenWindows:
    """At most `most` open windows of `size` ids; `put` returns (window, offset, window that was closed or None)."""

    def __init__(self, size: int, most: int, first: int = 0):
        self.size, self.most, self.next = size, most, first
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending

    def put(self, length: int) -> tuple[int, int, int | None]:
        closed = None
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                closed = self.room.pop(0)[1]
            room, window = self.size, self.next
            self.next += 1
        if room > length:
            insort(self.room, (room - length, window))
        else:
            closed = window if closed is None else closed
        return window, self.size - room, closed


def cut(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document: whole windows, then the rest."""
    n = len(ids) // 4
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a in range(0, n, size) for b in [min(a + size, n)]]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = WINDOW, most_open: int = OPEN) -> DataFrame:
    """One row for each piece of each document: which ids it holds, and its place in a sequence.

    A null or empty text is a document of the end id alone.  Documents that share an id are packed
    each on its own.  Extra columns are left out; an empty table gives no rows.  A document longer
    than `size` is cut into whole windows and a rest.  Sequence numbers are unique, not gapless; they
    are a function of the input partition, so a task that runs again gives the same.
    """

    def place(batches):
        own, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        first = part << 32
        windows = OpenWindows(size, most_open, first)
        waiting: dict[int, list] = {}  # rows of open windows
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                done: list[tuple] = []
                rows = batch.slice(start, 1000)
                for doc, ids in zip(rows.column("doc_id").to_pylist(), own.ids(rows.column("_text").to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for at, length, crc in cut(ids, size):
                        if length == size:
                            done.append((doc, at, length, crc, total, windows.next, 0, False, part))
                            windows.next += 1
                            continue
                        window, offset, closed = windows.put(length)
                        waiting.setdefault(window, []).append((doc, at, length, crc, total, window, offset))
                        if closed is not None:
                            done += [(*x, False, part) for x in waiting.pop(closed)]
                yield _batch(done)
        yield _batch([(*x, True, part) for w in waiting.values() for x in w])

    def merge(rows):
        by_window: dict[int, list[dict]] = {}
        for x in rows:
            by_window.setdefault(x["sequence_id"], []).append(x)
        fill = {w: sum(x["length"] for x in own) for w, own in by_window.items()}
        target = OpenWindows(size, len(fill) + 1)
        names: dict[int, int] = {}
        out = []
        for w in sorted(fill, key=lambda w: (-fill[w], w)):
            new, offset, _ = target.put(fill[w])
            name = names.setdefault(new, w)  # a merged window has the number of its first part
            out += [(x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"], name, x["offset"] + offset, True, x["part"]) for x in by_window[w]]
        yield _batch(out)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text"))
    placed = stored(rows.mapInArrow(place, f"{PIECE}, left boolean, part int"), "pieces")
    left = placed.where("left")
    groups = (F.col("part") / MERGED).cast("int")
    # a group has at most MERGED * most_open windows, however long the table
    merged = left.repartition(groups).mapInArrow(_by_group(merge), f"{PIECE}, left boolean, part int")
    columns = [c.split()[0] for c in PIECE.split(", ")]
    return placed.where("NOT left").select(*columns).unionByName(merged.select(*columns))


def _by_group(merge):
    """Runs `merge` for each group of partitions that a task holds."""

    def run(batches):
        groups: dict[int, list] = {}
        for batch in batches:
            for x in batch.to_pylist():
                groups.setdefault(x["part"] // MERGED, []).append(x)
        for _, rows in sorted(groups.items()):
            yield from merge(rows)

    return run


_TYPES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("left", pa.bool_()), ("part", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPES, strict=True)], schema=_TYPES)
