"""Near-duplicate groups: an exact n-gram Jaccard join in size-banded tiles with hashed bitmaps.

Equal shingle sets are put together first.  The shingles of a set are ordered from rare to frequent
(by a table of hashed counts over the corpus); two sets of similarity 0.8 or more share two of the
first n - ceil(0.8 n) + 2 of each, so sets that share such a shingle make a tile, ordered by size; a tile of
just two sets that no second shingle makes is left out.

A tile is worked off in rounds.  First each set is held against the most similar of a few leaders of
its tiles, and the links found are joined to components; then so are sets outside the main component
of a tile against leaders in it.  At last the sets that are still outside are held against all others
of the tile, in blocks, so that every pair is linked, refuted or within one component.  In each round a bitmap of shingle parities goes before the exact
test: of sets of n and m shingles whose bitmaps differ in d bits at most (n + m - d) / 2 shingles are
shared.  What passes is decided by the intersection of the sorted shingle arrays.  A group of near
copies thus costs a few comparisons for each member, and no link between different sets is lost.

Shingles are known by 64-bit hashes: two of them are mistaken for one with a chance of 2**-54.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.llm import wordhash as W
from chronoframe.llm.common import bounded, connected_components, discard, stored

WORDS, PERCENT = 5, 80
#: Cells of the table of shingle counts, and cells sent at once.
CELLS, PART = 1 << 20, 1 << 14
#: Members of a tile block, and of the smaller side of a pair of blocks.
BLOCK, SIDE = 512, 256
#: Tiles of a set by which it is told whether a pair has met before.
OWN = 64
#: Orders of all sets, in which leaders are the first of their tile; and rounds of leaders.
_ORDERS = W.mix(np.arange(1, 5, dtype=np.uint64))
ROUNDS = 3


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def _set_id(shingles: np.ndarray) -> int:
    """One number for a set, whatever its order."""
    return int(W.mix(np.array([W.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64))[0])


def _sets(batch: pa.RecordBatch):
    """(row, sorted shingles) of the batch's texts."""
    for first, data, offsets in W.chunks(batch.column("_text")):
        for i, s in enumerate(W.row_shingles(data, offsets, WORDS)):
            yield first + i, s


def _needed_share(n: int, m: int) -> int:
    """The least intersection of sets of n and m shingles that link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    """Shingles of a set of four or more among which two are shared with any similar set."""
    return min(n, n + (-PERCENT * n // 100) + 2)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the shingles by hash, in a power of two of bits, about twice their number, 64 to 4096."""
    width = min(4096, max(64, 1 << int(2 * len(shingles) - 1).bit_length())) if len(shingles) else 64
    bits = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def fold(rows: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: the parity of a cell is that of its two parts."""
    half = rows.shape[-1] // 2
    return rows[..., :half] ^ rows[..., half:]


def _profile(docs: DataFrame) -> DataFrame:
    """For each document its set's size and number; for each task its table of shingle counts, in parts."""

    def run(batches):
        counts = np.zeros(CELLS, dtype=np.int64)
        names = ["doc_id", "key", "n", "sid", "cell", "counts"]
        for batch in batches:
            n, sid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for i, s in _sets(batch):
                n[i], sid[i] = len(s), _set_id(s)
                if len(s):
                    counts += np.bincount((s >> np.uint64(44)).astype(np.int64), minlength=CELLS) if len(s) > CELLS // 64 else 0
                    if len(s) <= CELLS // 64:
                        np.add.at(counts, (s >> np.uint64(44)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n), _signed(sid), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for cell in range(0, CELLS, PART):
            part = counts[cell : cell + PART]
            if part.any():
                blob = part.astype("<u4").tobytes()
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([cell], pa.int32()), pa.array([blob], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id bigint, key bigint, n bigint, sid bigint, cell int, counts binary")


def _count_table(parts: DataFrame) -> np.ndarray:
    """Binary logarithms of the corpus's counts, one byte for each cell; CELLS / PART rows come to the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, blob in zip(batch.column("cell").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(blob, dtype="<u4").astype(np.int64)
                sums[cell] = sums[cell] + part if cell in sums else part
        for cell, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.log2(np.maximum(x, 1)).astype(np.uint8).tobytes()], pa.binary())], names=["cell", "counts"])

    table = np.zeros(CELLS, dtype=np.uint8)
    for row in parts.select("cell", "counts").repartition(CELLS // PART, "cell").mapInArrow(add, "cell int, counts binary").collect():
        table[row["cell"] : row["cell"] + PART] = np.frombuffer(row["counts"], dtype=np.uint8)
    return table


def _heads(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(sid, n, bits, head) for each document whose set could link to a different one."""
    usual = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        rank = usual.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                sid, n, bits, heads = [], [], [], []
                for _, s in _sets(batch.slice(start, 2000)):
                    if len(s) >= 4:  # smaller sets link only to equal ones
                        order = np.argsort(rank[(s >> np.uint64(44)).astype(np.int64)], kind="stable")
                        heads.append(s[order[: prefix_length(len(s))]].view(np.int64))
                        sid.append(_set_id(s))
                        n.append(len(s))
                        bits.append(bitmap(s))
                yield pa.RecordBatch.from_arrays([_signed(sid), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], names=["sid", "n", "bits", "head"])

    return docs.mapInArrow(run, "sid bigint, n int, bits binary, head array<bigint>")


def _tiles(rows: DataFrame) -> DataFrame:
    """(tile, sids, leads): the sets that share a shingle, in blocks by size, and the leaders of the block.

    Rows come sorted by shingle and size, so that a task holds one block of a group at a time.  Where the next
    size is too large for any set before it to link, a group ends: sets of a shingle that many unlike texts share
    by chance meet only those of like size.  The
    leaders come first in a few fixed orders of all sets, so that tiles with like members have like
    leaders; the next block also has the last leader of this one.  Groups of one block that have the same members are
    one tile (a pair of sets comes up to twice from a task); the blocks of a larger group bear the shingle as their tile number.
    """

    def run(batches):
        seen: dict[bytes, int] = {}
        out: list[tuple] = []
        key, least, size = None, 0, 0  # of the group at hand: shingle, least and last size, its rest of members, and the leader of a block that has gone
        sids: list[int] = []
        gone: list[int] = []

        def close(whole):
            nonlocal sids, gone
            if len(sids) + len(gone) > 1:
                own = np.array(sids, dtype=np.int64)
                leads = [sids[int(np.argmin(W.mix(own.view(np.uint64) ^ salt)))] for salt in _ORDERS]
                if not whole or gone:
                    number = W.mix(np.array([key], dtype=np.int64).view(np.uint64) ^ np.uint64(least))
                    out.append((int(number.view(np.int64)[0]), sids, list(dict.fromkeys(gone + leads))))
                elif (times := seen.get(own.tobytes(), 0)) < (2 if len(sids) == 2 else 1):
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[own.tobytes()] = times + 1
                    out.append((None, sids, list(dict.fromkeys(leads))))
                gone = [] if whole else leads[-1:]
            sids = []

        def put(k, s, n):
            nonlocal key, gone, least, size
            if k != key or 100 * size < PERCENT * n:
                if sids:
                    close(True)
                key, gone, least = k, [], n
            if len(sids) == BLOCK:
                close(False)
            size = n
            sids.append(s)

        def flush():
            nonlocal out
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            out = []
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["tile", "sids", "leads"])

        for batch in batches:
            k, s, n = (batch.column(c).to_numpy() for c in ("key", "sid", "n"))
            alone = np.ones(len(k), dtype=bool)  # rows that have no neighbour of their shingle and of like size
            if len(k):
                apart = (k[1:] != k[:-1]) | (100 * n[:-1].astype(np.int64) < PERCENT * n[1:].astype(np.int64))
                alone[1:] &= apart
                alone[:-1] &= apart
                alone[0] = alone[-1] = False  # the group may go on in another batch
            at = np.flatnonzero(~alone)
            for one in zip(k[at].tolist(), s[at].tolist(), n[at].tolist(), strict=True):
                put(*one)
            if len(out) > 2000:
                yield flush()
        if sids:
            close(True)
        yield flush()

    return rows.repartition("key").sortWithinPartitions("key", "n", "sid").mapInArrow(run, "tile bigint, sids array<bigint>, leads array<bigint>")


def _near_bits(batches):
    """Pairs whose bitmaps leave room for enough shared shingles, and how much more room there is."""
    for batch in batches:
        a, b = batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()
        na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
        good, room = [], []
        for x, y, n, m in zip(a, b, na, nb, strict=True):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            while len(x) > len(y):
                x = fold(x)
            while len(y) > len(x):
                y = fold(y)
            d = int(np.bitwise_count(x ^ y).sum())
            room.append(n + m - d - 2 * _needed_share(n, m))
            good.append(100 * min(n, m) >= PERCENT * max(n, m) and room[-1] >= 0)
        both = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(room, pa.int64())], names=["a", "b", "room"])
        yield both.filter(pa.array(good, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of set numbers that link, by the intersection of their sorted shingles.

    Shingles are made again, for one text of each set that a pair names.
    """
    pairs = stored(pairs, "candidates")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    chosen = rows.join(needed, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "key")).alias("at"))
    chosen = stored(chosen.select("at.*").distinct(), "chosen")

    def shingles(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                sid, lists = [], []
                for _, s in _sets(batch.slice(start, 1000)):
                    sid.append(_set_id(s))
                    lists.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([_signed(sid), pa.array(lists, pa.list_(pa.int64()))], names=["sid", "shingles"])

    # repeated rows give a set twice
    found = texts.join(bounded(chosen), ["doc_id", "key"], "left_semi").select("_text").mapInArrow(shingles, "sid bigint, shingles array<bigint>")
    sets = stored(found.dropDuplicates(["sid"]), "sets")
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b")

    def test(batches):
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            va, vb, oa, ob = a.values.to_numpy(), b.values.to_numpy(), a.offsets.to_numpy(), b.offsets.to_numpy()
            good = []
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = stored(both.select("a", "b", "sa", "sb").mapInArrow(test, "a bigint, b bigint"), "links")
    discard(pairs, chosen, sets)
    return links


def _main_labels(members: DataFrame) -> DataFrame:
    """(tile, main, all, most) of tiles with more than one component: the commonest, and how many members there are in all and in it."""
    labels = members.groupBy("tile", "label").agg(F.count("*").alias("c"))
    return labels.groupBy("tile").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("all"), F.max("c").alias("most")).where("k > 1").drop("k")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components in a tile that bitmaps and sizes allow.

    `members` has (tile, sid, n, bits, label).  Pairs within the main component of a tile need no test;
    every other pair has a member outside it.  Those members, in sides of SIDE, meet all members, in
    blocks of BLOCK.  A pair of many tiles comes from the first of them, as far as the OWN first tiles of each set tell.
    """
    mixed = _main_labels(members).select("tile", "main", F.ceil((F.col("all") - F.col("most")) / SIDE).cast("int").alias("us"), F.ceil(F.col("all") / BLOCK).cast("int").alias("ms"))
    rows = members.join(mixed, "tile")
    own_tiles = rows.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("tile")), 1, OWN).alias("own"))
    rows = rows.join(own_tiles, "sid").withColumn("out", F.col("label") != F.col("main"))
    # a member's side or block follows from its number, spread by hash
    place = F.pmod(F.xxhash64("sid"), F.col("ms")).cast("int")
    side = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("us")).cast("int")
    right = rows.select("tile", place.alias("mc"), F.explode(F.sequence(F.lit(0), F.col("us") - 1)).alias("uc"), "sid", "n", "bits", "label", "own", "out", F.lit(False).alias("u"))
    left = rows.where("out").select("tile", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mc"), side.alias("uc"), "sid", "n", "bits", "label", "own", "out", F.lit(True).alias("u"))

    def compare(tile, u, m):
        """(a, b) of one side against one block; u and m are lists of (sid, n, bits, label, own, out)."""
        a, b = [], []
        before = {x[0]: {t for t in x[4] if t < tile} for x in (*u, *m)}
        out = {x[0] for x in m if x[5]}
        by_width: dict[int, list] = {}
        for x in m:
            by_width.setdefault(len(x[2]), []).append(x)
        ready = {}
        for width, own in by_width.items():
            matrix = np.frombuffer(b"".join(x[2] for x in own), np.uint8).reshape(len(own), width)
            ready[width] = (np.array([x[0] for x in own]), np.array([x[1] for x in own]), np.array([x[3] for x in own]), matrix, fold(matrix))
        for sid, n, bits, label, _, _ in u:
            mine = np.frombuffer(bits, np.uint8)
            for width, (sids, ns, labels_, matrix, folded) in ready.items():
                if width > 2 * len(mine) or 2 * width < len(mine):
                    continue
                ok = (labels_ != label) & (100 * np.minimum(ns, n) >= PERCENT * np.maximum(ns, n))
                if not ok.any():
                    continue
                rows_, own = (folded, mine) if width > len(mine) else (matrix, mine if width == len(mine) else fold(mine))
                d = np.bitwise_count(rows_[ok] ^ own).sum(axis=1, dtype=np.int64)
                total = ns[ok] + n
                near = sids[ok][total - d >= 2 * -(-PERCENT * total // (100 + PERCENT))]
                for s in near.tolist():
                    # two sets outside the main component meet twice here
                    if (s < sid or s not in out) and before[s].isdisjoint(before[sid]):
                        a.append(min(s, sid))
                        b.append(max(s, sid))
        return a, b

    def run(batches):
        key, u, m = None, [], []
        for batch in batches:
            a, b = [], []
            for t, mc, uc, sid, n, bits, label, own, out, is_u in zip(*(batch.column(c).to_pylist() for c in ("tile", "mc", "uc", "sid", "n", "bits", "label", "own", "out", "u")), strict=True):
                if (t, mc, uc) != key:
                    if u and m:
                        x, y = compare(key[0], u, m)
                        a += x
                        b += y
                    key, u, m = (t, mc, uc), [], []
                (u if is_u else m).append((sid, n, bits, label, own, out))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = compare(key[0], u, m) if u and m else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = left.unionByName(right).repartition("tile", "mc", "uc").sortWithinPartitions("tile", "mc", "uc")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: n_shingles, and the smallest doc_id that links reach from it.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a set has the distinct five-word shingles
    of the whole text, or the whole text as one when it has fewer words.  Null, empty and white texts
    have no shingles and stand alone, as do documents with a null id, which link no others.  Repeated rows and equal texts are
    in one group; rows that share an id are judged each by its text.  Extra columns are left out.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text"))
    texts = texts.withColumn("key", F.xxhash64(F.coalesce("_text", F.lit(""))))
    profile = stored(_profile(texts), "profile")
    every = profile.where("cell IS NULL").select("doc_id", "key", "n", "sid")
    rows, texts = every.where("doc_id IS NOT NULL"), texts.where("doc_id IS NOT NULL")
    table = _count_table(profile.where("cell IS NOT NULL"))
    heads = stored(_heads(texts, table).dropDuplicates(["sid"]), "heads")
    marks = heads.select("sid", "n", "bits")
    tiles = _tiles(heads.select("n", "sid", F.explode_outer("head").alias("key"))).groupBy("tile", "sids").agg(F.first("leads").alias("leads"), F.count("*").alias("times"))
    # the sets of a pair that links are in a second tile, this one again or a larger one
    tiles = stored(tiles.where("tile IS NOT NULL OR size(sids) > 2 OR times > 1").drop("times"), "tiles")

    def best(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) that bitmaps allow, the most similar b for each a, as (least, greatest)."""
        for p in "ab":
            pairs = pairs.join(marks.select(F.col("sid").alias(p), F.col("n").alias(f"n{p}"), F.col("bits").alias(f"bits_{p}")), p)
        near = pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_near_bits, "a bigint, b bigint, room bigint")
        chosen = near.groupBy("a").agg(F.max_by("b", F.struct("room", "b")).alias("b"))
        return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    tile = F.coalesce("tile", F.xxhash64("sids"))
    plain = stored(tiles.select(tile.alias("tile"), F.explode("sids").alias("sid")).distinct(), "plain")
    star = tiles.select("leads", F.explode("sids").alias("a")).select("a", F.explode("leads").alias("b")).where("a <> b").distinct()
    tested = stored(best(star), "star")
    links = _links(tested, texts, rows)
    for turn in range(ROUNDS):
        labels = stored(connected_components(links).select(F.col("node").alias("sid"), "component"), "labels")
        named = plain.join(labels, "sid", "left").select("tile", "sid", F.coalesce("component", "sid").alias("label"))
        if turn == ROUNDS - 1:
            break
        main = _main_labels(named)
        first = [F.min(F.struct(F.xxhash64("sid", F.lit(10 * turn + i)), "sid"))["sid"] for i in range(2)]
        leads = named.join(main, "tile").where("label = main").groupBy("tile").agg(*[x.alias(f"l{i}") for i, x in enumerate(first)])
        outside = named.join(main, "tile").where("label <> main").select("tile", F.col("sid").alias("a"))
        star = outside.join(leads, "tile").select("a", F.explode(F.array_distinct(F.array("l0", "l1"))).alias("b")).distinct()
        known = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        new = stored(best(star.join(known, ["a", "b"], "left_anti")), "star")
        found = _links(new, texts, rows)
        tested, links = tested.unionByName(new), links.unionByName(found)
    members = stored(named.join(marks, "sid").select("tile", "sid", "n", "bits", "label"), "members")
    rest = _block_pairs(members).join(tested, ["a", "b"], "left_anti")
    links = links.unionByName(_links(rest, texts, rows))
    groups = connected_components(links)
    first = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"))
    placed = first.join(groups.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    placed = stored(placed, "placed")
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "component").select("sid", "component_id")
    joined = every.join(placed, "sid", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
