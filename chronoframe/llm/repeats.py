"""Removal of byte strings that an earlier document has: suffix sorting of shards by induction.

Of the 50-byte strings of all documents only those can be repeated whose key is: the least hash of
the 32-byte grams in them.  Neighbouring strings with one key are kept together as a stretch of text.
Batches of documents send their keys by range, and are told which of them more than one document
may have; stretches with such keys go to shards by key, equal stretches of a batch once.  Documents whose whole text is that of an earlier one are found first and stay
out of this.  A shard takes equal stretches as one, sorts the suffixes of those whose key others
have as well by induction, and finds, for each string, the least document that has it.
The answers go back to the batch's own list of places, so that no shard holds the places of a passage
that very many documents share.

Suffix sorting is SA-IS with bucket queues, which give out suffixes in their order as a priority
queue does and move to disk beyond a fixed size: left-most S suffixes induce L suffixes, and these S
suffixes.  Only order by the first 50 bytes is needed, so the reduced string is sorted by five rounds
of prefix doubling instead of further recursion; common prefixes are compared up to 50 bytes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import wordhash as W
from chronoframe.llm.common import bounded, match_rows, stored

LENGTH, GRAM = 50, 32
#: Bytes of all texts for each shard and for each range of keys, and bytes of text whose keys and stretches are sent together.
SHARD, RANGE, FLUSH = 4 << 20, 8 << 20, 3 << 20
BLOBS = "kind int, batch bigint, shard int, blob binary"
#: Bytes that the queues of one sort keep in memory.
QUEUED = 256 << 20


def grams(data: np.ndarray) -> np.ndarray:
    """A hash for each GRAM = 32 consecutive bytes, by doubling."""
    h = W._VALUES[data]
    base = W._BASE
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:] if len(h) > step else h[:0]
        step *= 2
    return W.mix(h)


def sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:]) if len(h) > width else h[:0]
        width *= 2
    rest = n - width
    return (np.minimum(h[:-rest], h[rest:]) if len(h) > rest else h[:0]) if rest else h


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end, key) of the runs of strings that lie in one row and have one key."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    key = sliding_least(grams(data), LENGTH - GRAM + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(key)] == row[LENGTH - 1 :]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1 : len(key)] != row[: len(key) - 1]) | ~inside[:-1]
    begin = np.flatnonzero(new & inside)
    # a run ends before the next beginning, and where strings leave the row
    stop = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    return row[begin], begin, stop + LENGTH, key[begin]


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        code = a.dtype.str.encode().ljust(8)
        parts += [code, np.array([a.nbytes], "<i8").tobytes(), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for _ in range(n):
        code, size = raw[at : at + 8].decode().strip(), int(np.frombuffer(raw, "<i8", 1, at + 8)[0])
        out.append(np.frombuffer(raw[at + 16 : at + 16 + size], code))
        at += 16 + size
    return out


class Queues:
    """One first-in-first-out queue of suffixes for each symbol; beyond a size they wait in files."""

    def __init__(self, symbols: int, limit: int = QUEUED):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held = limit, 0

    def put(self, symbol: int, suffixes: np.ndarray) -> None:
        if self.held + suffixes.nbytes > self.limit:
            file = tempfile.TemporaryFile()  # goes with its last reference
            suffixes.tofile(file)
            self.parts[symbol].append(file)
        else:
            self.held += suffixes.nbytes
            self.parts[symbol].append(suffixes)

    def put_by(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        """Each suffix into the queue of its symbol, in the order given."""
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, suffixes = symbols[order], suffixes[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        starts = np.concatenate([[0], cuts])
        for s, part in zip(symbols[starts].tolist(), np.split(suffixes, cuts), strict=True):
            self.put(s, part)

    def take(self, symbol: int) -> np.ndarray:
        """All that waits for the symbol, in order."""
        out = []
        for part in self.parts[symbol]:
            if isinstance(part, np.ndarray):
                self.held -= part.nbytes
                out.append(part)
            else:
                part.seek(0)
                out.append(np.frombuffer(part.read(), dtype=np.int32))
                part.close()
        self.parts[symbol] = []
        return np.concatenate(out) if out else np.zeros(0, np.int32)


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in the order that the given order of the left-most S suffixes induces."""
    seeds, queues = Queues(symbols), Queues(symbols)
    seeds.put_by(text[lms], lms)
    large: list[np.ndarray] = []
    for c in range(symbols):
        done = []
        for source in (queues, seeds):
            while len(now := source.take(c)):
                if source is queues:
                    done.append(now)
                before = now[now > 0] - 1
                before = before[~is_s[before]]
                queues.put_by(text[before], before)
        large.append(np.concatenate(done) if done else np.zeros(0, np.int32))
    queues, small = Queues(symbols), []
    queues.put(0, np.array([len(text) - 1], np.int32))  # the end, which nothing induces
    for c in range(symbols - 1, -1, -1):
        done = []
        while len(now := queues.take(c)):  # S suffixes of c, largest first, before the L suffixes of c
            done.append(now)
            before = now[now > 0] - 1
            before = before[is_s[before]]
            queues.put_by(text[before], before)
        now = large[c][::-1]
        before = now[now > 0] - 1
        before = before[is_s[before]]
        queues.put_by(text[before], before)
        small.append(np.concatenate(done)[::-1] if done else np.zeros(0, np.int32))
    small.reverse()
    return np.concatenate([x for c in range(symbols) for x in (large[c], small[c])])


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of an int16 text that ends with its only 0, ordered at least by their first `depth` symbols."""
    n, symbols = len(text), int(text.max()) + 1
    rising = np.zeros(n, np.int8)
    rising[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1])
    rising[-1] = 1
    # a symbol that equals the next takes its type: that of the next one that differs
    at = np.where(rising != 0, np.arange(n), n - 1)
    is_s = rising[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    if len(lms) <= 1:
        return _induce(text, is_s, lms, symbols)
    order = _induce(text, is_s, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = order[is_lms[order]]
    # names of the substrings from one left-most S symbol to the next, by their length and hash
    ends = np.append(lms[1:], n - 1).astype(np.int64) + 1
    up, down = W._power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(W.mix(text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = W.mix(((sums[ends] - sums[lms]) * down[lms]) ^ W.mix((ends - lms).astype(np.uint64)))
    rank = np.empty(n, np.int32)
    rank[lms] = np.arange(len(lms))
    in_order = hashes[rank[sorted_lms]]
    names = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
    reduced = np.empty(len(lms), np.int64)
    reduced[rank[sorted_lms]] = names
    width = 1
    while width < depth and names[-1] + 1 < len(lms):  # each name stands for two symbols at least
        second = np.zeros(len(reduced), np.int64)
        second[:-width] = reduced[width:] + 1 if width < len(reduced) else 0
        pair = reduced * (len(reduced) + 2) + second
        by = np.argsort(pair, kind="stable")
        names = np.concatenate([[0], np.cumsum(pair[by][1:] != pair[by][:-1])])
        reduced = np.empty(len(lms), np.int64)
        reduced[by] = names
        width *= 2
    return _induce(text, is_s, lms[np.argsort(reduced, kind="stable")], symbols)


def least_owners(pieces: np.ndarray, lengths: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first string, end string, least owner): for each string of each piece the least owner of a piece that has it.

    Strings of a piece with one answer are given together.
    """
    if not len(lengths):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    n = len(pieces) + len(lengths)
    text = np.zeros(n + 1, np.int16)
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    body = np.ones(n, np.int16)  # 1 stands between pieces, 2 to 257 are bytes
    body[inside] = pieces.astype(np.int16) + 2
    text[:n] = body
    order = suffix_order(text)
    del body
    piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    order = order[order < n]
    left = ends[piece[order]] - 1 - order
    order = order[left >= LENGTH].astype(np.int64)
    # eight bytes from each place on; seven of them cover a string
    word = np.zeros(n + 8, np.uint64)
    wide = np.append(text[:n], np.zeros(8, np.int16)).astype(np.uint64) & np.uint64(0xFF)
    for i in range(8):
        word[:n] |= wide[i : i + n] << np.uint64(8 * i)
    same = np.ones(max(0, len(order) - 1), bool)
    for i in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        w = word[order + i]
        same &= w[1:] == w[:-1]
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    begin = np.concatenate([[0], np.flatnonzero(~same) + 1])
    least = np.minimum.reduceat(owners[piece[order]], begin)
    answer = np.empty(n, np.int64)
    answer[order] = np.repeat(least, np.diff(np.append(begin, len(order))))
    order.sort()
    p, a = piece[order], answer[order]
    first = np.concatenate([[0], np.flatnonzero((p[1:] != p[:-1]) | (a[1:] != a[:-1])) + 1])
    last = np.append(first[1:], len(order)) - 1
    return p[first].astype(np.int64), order[first] - starts[p[first]], order[last] + 1 - starts[p[first]], a[first]


def _few(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of rows of few bytes, since hashes of all bytes of a run are held at once."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + W.CHUNK, "right")) - 1)
        yield first, last
        first = last


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end, key) of the stretches of a batch, their keys mixed, the order of these, and where a new one begins in it."""
    parts = [stretches(data[:0], offsets[:1])]
    for first, last in _few(offsets):
        at = offsets[first]
        row, begin, end, key = stretches(data[at : offsets[last]], offsets[first : last + 1] - at)
        parts.append((row + first, begin + at, end + at, key))
    found = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    # a key is the least of many hashes, so its high bits are nearly always 0 until it is mixed anew
    mixed = W.mix(found[3])
    order = np.argsort(mixed, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = mixed[order][1:] != mixed[order][:-1]
    return found, mixed, order, new


def _ranges(mixed: np.ndarray, ranges: int) -> np.ndarray:
    return (((mixed >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _sent_keys(texts: DataFrame, ranges: int) -> DataFrame:
    """For each batch of texts its distinct keys by range (kind 0), and the batch itself (kind 1).

    The batch goes the way of its keys, so that the answers meet the very batch that asked, whatever a second run of the input would give.
    """

    def run(batches):
        task, count, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush():
            nonlocal held, size, count
            ids, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            number = (task << 24) | count
            count += 1
            (row, *_), mixed, order, new = _marks(data, np.concatenate([[0], np.cumsum(sizes)]))
            rows = [(1, number, _dealt(number, ranges), _pack(ids, sizes, data))]
            if len(order):
                first = np.flatnonzero(new)
                # the order is stable, so a key has several rows where its first and last differ
                several = row[order[first]] != row[order[np.append(first[1:], len(order)) - 1]]
                keys = mixed[order[first]]
                at = _ranges(keys, ranges)
                cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
                low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
                rows += [(0, number, int(at[a]), _pack(low[a:b], several[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return _blobs(rows)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, offsets in W.chunks(batch.column("_text")):
                last = first + len(offsets) - 1
                held.append((ids[first:last], np.diff(offsets), data))
                size += len(data)
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, BLOBS)


def _each(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of a batch one by one, since blobs are large."""
    return (tuple(x.as_py() for x in row) for row in zip(*(batch.column(c) for c in names), strict=True))


def _dealt(number: int, parts: int) -> int:
    """Some part for a batch: few are alike, also where `parts` is a power of two, which leaves the task out of a remainder."""
    return ((number >> 24) * 3 + (number & 0xFFFFFF)) % parts


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "batch", "shard", "blob"])


def _shared_keys(sent: DataFrame, ranges: int) -> DataFrame:
    """For each batch and range a bit for each key: whether more than one document may have it (kind 0); and the batches (kind 1).

    Keys of a range are told apart by 32 bits: a clash only lets more through.
    """

    def one(shard, rows):
        found = [_unpack(blob) for _, blob in rows]
        low, shared = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(low)
        low = low[order]
        same = low[1:] == low[:-1]
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        cuts = np.cumsum([len(f[0]) for f in found])[:-1]
        return [(0, number, shard, np.packbits(bits).tobytes()) for (number, _), bits in zip(rows, np.split(shared, cuts), strict=True) if bits.any()]

    def run(batches):
        shard, rows = None, []
        for batch in batches:
            whole = batch.filter(pa.compute.equal(batch.column("kind"), 1))
            if whole.num_rows:
                yield whole
            for kind, s, number, blob in _each(batch, ("kind", "shard", "batch", "blob")):
                if kind == 1:
                    continue
                if s != shard and rows:
                    if out := one(shard, rows):
                        yield _blobs(out)
                    rows = []
                shard = s
                rows.append((number, blob))
        if rows and (out := one(shard, rows)):
            yield _blobs(out)

    return sent.repartition(ranges, "shard").sortWithinPartitions("shard", "kind", "batch").mapInArrow(run, BLOBS)


def _candidates(shared: DataFrame, ranges: int, shards: int, tasks: int) -> DataFrame:
    """Rows of two kinds: stretches for a shard (kind 0) and a batch's own places (kind 1), both by `batch`.

    Places go through the same shuffle, to any shard, so that nothing is computed or written twice.
    """

    def one(number, answers, blob):
        ids, sizes, data = _unpack(blob)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        (row, begin, end, key), mixed, order, new = _marks(data, offsets)
        at = _ranges(mixed[order[new]], ranges)
        many = np.zeros(len(at), bool)
        for r, bits in answers:
            a, b = np.searchsorted(at, [r, r + 1])
            many[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        take = order[many[np.cumsum(new) - 1]]
        take.sort()
        row, begin, end, key = row[take], begin[take], end[take], key[take]
        length = end - begin
        mark = W.mix(length.astype(np.uint64))
        for few in _few(offsets):
            i, j = np.searchsorted(row, few)
            first, last = offsets[list(few)]
            mark[i:j] ^= W.word_hashes(data[first:last], begin[i:j] - first, end[i:j] - first, W.SAME)
        doc = ids[row]
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((doc, mark, shard))
        new = np.ones(len(order), bool)
        new[1:] = mark[order][1:] != mark[order][:-1]
        group = np.cumsum(new) - 1  # equal stretches, in the order of shards
        first = order[new]
        own = np.flatnonzero(new)
        least, most = doc[first], doc[order[np.append(own[1:], len(order)) - 1]]
        back = np.argsort(order)  # places in the order of the text, which packs well
        named, row = np.unique(row, return_inverse=True)
        rows = [(1, number, _dealt(number, shards), _pack(group[back].astype("<i4"), np.diff(row, prepend=0).astype("<i4"), begin.astype("<i4"), ids[named]))]
        at = shard[first]
        cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            f = first[a:b]
            where = np.repeat(begin[f] - (np.cumsum(length[f]) - length[f]), length[f]) + np.arange(length[f].sum())
            rows.append((0, number, int(at[a]), _pack(np.array([a]), length[f].astype("<i4"), least[a:b], most[a:b], data[where], key[f])))
        return _blobs(rows)

    def run(batches):
        number, answers = None, []
        for batch in batches:
            for kind, n, r, blob in _each(batch, ("kind", "batch", "shard", "blob")):
                if n != number:
                    number, answers = n, []
                if kind == 0:
                    answers.append((r, blob))
                elif answers:
                    yield one(n, answers, blob)

    return shared.repartition(tasks, "batch").sortWithinPartitions("batch", "kind").mapInArrow(run, BLOBS)


def _answers(sent: DataFrame, shards: int) -> DataFrame:
    """For each batch the strings of its stretches that an earlier document has: (kind 0, batch, blob); and its places (kind 1)."""

    def one(rows):
        heads = [_unpack(blob) for _, blob in rows]
        lengths = np.concatenate([h[1] for h in heads]).astype(np.int64)
        least, most, data, key = (np.concatenate([h[i] for h in heads]) for i in (2, 3, 4, 5))
        # equal stretches of all batches are one, with the least of their owners
        ends = np.cumsum(lengths)
        marks = W.mix(W.word_hashes(data, ends - lengths, ends, W.SAME) ^ lengths.astype(np.uint64))
        _, first, same = np.unique(marks, return_index=True, return_inverse=True)
        owners = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(owners, same, least)
        # a stretch that is the only one of its key shares no string with another
        _, back, count = np.unique(key[first], return_inverse=True, return_counts=True)
        sort = np.flatnonzero(count[back] > 1)
        many = first[sort]
        where = np.repeat((ends - lengths)[many] - (np.cumsum(lengths[many]) - lengths[many]), lengths[many]) + np.arange(lengths[many].sum())
        piece, begin, end, owner = least_owners(data[where], lengths[many], owners[sort])
        alone = np.flatnonzero(count[back] == 1)
        piece, begin, end, owner = (np.concatenate(x) for x in ((sort[piece], alone), (begin, np.zeros(len(alone), np.int64)), (end, lengths[first[alone]] - LENGTH + 1), (owner, owners[alone])))
        # the answers of each stretch as it was sent
        order = np.argsort(piece, kind="stable")
        piece, begin, end, owner = piece[order], begin[order], end[order], owner[order]
        low, high = np.searchsorted(piece, same, "left"), np.searchsorted(piece, same, "right")
        which = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
        piece, begin, end, owner = np.repeat(np.arange(len(same)), high - low), begin[which], end[which], owner[which]
        useful = owner < most[piece]
        piece, begin, end, owner = piece[useful], begin[useful], end[useful], owner[useful]
        counts = np.array([len(h[1]) for h in heads])
        firsts = np.cumsum(counts) - counts
        of = np.searchsorted(firsts, piece, "right") - 1
        out = []
        for i, (number, _) in enumerate(rows):
            mine = of == i
            if mine.any():
                out.append((0, number, _pack((piece[mine] - firsts[i] + heads[i][0][0]).astype("<i4"), begin[mine].astype("<i4"), end[mine].astype("<i4"), owner[mine])))
        kinds = [pa.int32(), pa.int64(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "batch", "blob"])

    def run(batches):
        shard, rows = None, []
        for batch in batches:
            places = batch.filter(pa.compute.equal(batch.column("kind"), 1))
            if places.num_rows:
                yield places.select(["kind", "batch", "blob"])
            for kind, s, number, blob in _each(batch, ("kind", "shard", "batch", "blob")):
                if kind == 1:
                    continue
                if s != shard and rows:
                    yield one(rows)
                    rows = []
                shard = s
                rows.append((number, blob))
        if rows:
            yield one(rows)

    return sent.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "batch").mapInArrow(run, "kind int, batch bigint, blob binary")


def _covered(both: DataFrame, tasks: int) -> DataFrame:
    """(kind 0, batch, shard 0, blob of rows of the batch, begins and ends): the bytes that strings of earlier documents cover."""

    def one(number, answers, places):
        group, row, start, doc = _unpack(places)
        place_row, start = np.cumsum(row, dtype=np.int64), start.astype(np.int64)
        found = [_unpack(x) for x in answers]
        piece, begin, end, owner = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.argsort(piece, kind="stable")
        piece, begin, end, owner = piece[order], begin[order].astype(np.int64), end[order].astype(np.int64), owner[order]
        low, high = np.searchsorted(piece, group, "left"), np.searchsorted(piece, group, "right")
        n = high - low
        which = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(np.arange(len(group)), n)
        hit = owner[which] < doc[place_row[place]]
        which, place = which[hit], place[hit]
        begin, end = start[place] + begin[which], start[place] + end[which] - 1 + LENGTH
        return _blobs([(0, number, 0, _pack(begin.astype("<i4"), end.astype("<i4")))])

    def run(batches):
        number, found = None, []
        for batch in batches:
            for kind, n, blob in _each(batch, ("kind", "batch", "blob")):
                if n != number:
                    number, found = n, []
                if kind == 0:
                    found.append(blob)
                elif found:
                    yield one(n, found, blob)

    return both.repartition(tasks, "batch").sortWithinPartitions("batch", "kind").mapInArrow(run, BLOBS)


def _cut(both: DataFrame, tasks: int, with_bytes: bool) -> DataFrame:
    """The rows of each batch (kind 1) without the bytes that its spans (kind 0) cover."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def one(spans, blob):
        ids, sizes, data = _unpack(blob)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        depth = np.zeros(len(data) + 1, np.int32)
        for begin, end in map(_unpack, spans):
            np.add.at(depth, begin, 1)
            np.add.at(depth, end, -1)
        gone = np.concatenate([[False], np.cumsum(depth, dtype=np.int32)[:-1] > 0, [False]])
        # a run ends with its row
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = np.flatnonzero(gone[1:] & (~gone[:-1] | edge))
        end = np.flatnonzero(gone[:-1] & (~gone[1:] | edge))
        low, high = np.searchsorted(begin, offsets[:-1]), np.searchsorted(begin, offsets[1:])
        text, out = data.tobytes(), []
        for doc, first, last, i, j in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), low.tolist(), high.tolist(), strict=True):
            edges = [first, *np.column_stack([begin[i:j], end[i:j]]).ravel().tolist(), last]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc, last - first, last - first - len(kept), j - i, kept if with_bytes else None, hashlib.sha256(kept).hexdigest()))
        found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        return found if with_bytes else found.drop_columns(["kept"])

    def run(batches):
        number, spans = None, []
        for batch in batches:
            for kind, n, blob in _each(batch, ("kind", "batch", "blob")):
                if n != number:
                    number, spans = n, []
                if kind == 0:
                    spans.append(blob)
                else:
                    yield one(spans, blob)

    kept = "kept binary, " if with_bytes else ""
    return both.repartition(tasks, "batch").sortWithinPartitions("batch", "kind").mapInArrow(run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {kept}kept_sha256 string")


def equal_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, key) of rows whose whole text a row with a smaller id has; groups are combined before the shuffle."""
    rows = texts.select("doc_id", F.col("_key").alias("key"), F.sha2(F.encode(F.coalesce("_text", F.lit("")), "UTF-8"), 256).alias("_sha"))
    first = rows.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    return rows.join(bounded(first), "_sha").where("doc_id > _first").select("doc_id", "key").distinct()


def _without_repeats(texts: DataFrame, with_bytes: bool) -> DataFrame:
    """The answer for rows (doc_id, _text) without equal texts under different ids.

    The batches are stored with what is told of their keys, and cut at the end: the input is read once for them, and its texts are joined with nothing.
    """
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards, ranges, tasks = (max(8, -(-total // x)) for x in (SHARD, RANGE, 3 * FLUSH))
    shared = stored(_shared_keys(_sent_keys(texts, ranges), ranges), "batches")
    spans = stored(_covered(_answers(_candidates(shared, ranges, shards, tasks), shards), tasks), "spans")
    return _cut(shared.where("kind = 1").unionByName(spans), tasks, with_bytes)


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """One row for each document: n_bytes, n_removed, n_spans, kept (the bytes that stay) and kept_sha256.

    A byte is removed when a 50-byte string over it also starts in a document with a smaller id.  Texts
    are UTF-8 bytes; null and empty ones have none.  Rows that share an id do not remove each other's
    bytes, and each is judged by its own text; a null id neither removes nor loses bytes.  Extra columns
    are left out, and an empty table gives no rows.  Without `with_bytes` the column `kept` is left out.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text"))
    named = texts.withColumn("_key", F.xxhash64(F.coalesce("_text", F.lit("")))).where("doc_id IS NOT NULL")
    copies = stored(equal_texts(named), "copies")
    own = match_rows(named, copies, "left_anti", text_column="_text").select("doc_id", "_text")
    found = _without_repeats(own, with_bytes)

    def whole(rows: DataFrame, gone: Column) -> DataFrame:
        """Rows that lose all bytes or none."""
        size = F.octet_length("_data").cast("bigint")
        kept = F.when(gone, F.lit(b"")).otherwise(F.col("_data"))
        rows = rows.select("doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(0).alias("n_removed"), gone.cast("bigint").alias("n_spans"), kept.alias("kept"), F.sha2(kept, 256).alias("kept_sha256"))
        return rows.select(*found.columns)

    rows = texts.withColumn("_data", F.encode(F.coalesce("_text", F.lit("")), "UTF-8"))
    # an earlier document has the whole text of a copy
    again = match_rows(rows, copies, "left_semi", text_column="_text")
    return found.unionByName(whole(again, F.octet_length("_data") >= LENGTH)).unionByName(whole(rows.where("doc_id IS NULL"), F.lit(False)))
