"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

Two documents link if the Jaccard similarity of their sets of word shingles reaches ``num / den``. The join works on distinct sets:

1. A set of n shingles can only link if it shares ``need(n)`` of them, so one with ``n - need(n) + 1`` shingles that no other document has is
   closed. Blocks of texts send the hashes of a part of the hash space, packed and each once; ranges of hashes tell which are in
   one document alone. Only open sets go on; in a corpus of mostly different texts these are few.
2. Small sets enumerate their subsets of the fixed sizes that a link with any possible partner needs in common. Large sets are looked
   up in inverted lists: of their rarest shingles, so many that two linked sets have one of them in common. A common line or
   passage is never among these where a text has enough of its own. The boundary is the size from which on subsets cost
   more than lists, by the histogram of the sizes of the open sets.
3. The members of all lists that have the same least set (the leader) are compared once, in tiles of bounded size: each member is
   reduced to its difference from the leader, and ``|x ^ y| = |dx| + |dy| - 2 |dx & dy|``. Only a spanning forest of the links
   leaves a tile, so a group of near copies never becomes a table of pairs.
4. Leaders of several tiles: members of different tiles that the links so far do not connect are held against each other by parity
   sketches (a bit per hash value, flipped by each shingle there). Sketches differ in no more bits than sets differ in shingles, so
   what they tell apart cannot link; what is left is compared in full.

No pair is skipped, no list is capped. Copies of a set are joined by its signature (its size and two 64-bit sums).
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, partitions, pieces, small_batches, written
from .components import components
from .shingles import mixed, per_text, sets

#: Bytes of text that are shingled at a time; this takes some forty times as much room.
PIECE = 1 << 18
#: Hashes and texts of one packed block.
BLOCK_HASHES, BLOCK_TEXTS = 1_500_000, 60_000
#: Hashes in one range, about.
RANGE_HASHES = 1_000_000
#: Of the hash space, so many times the share of shingles that a link may lack are looked at to close sets.
POOL = 2.5
#: Sets that may be broadcast to the texts; if there are more, the texts are shuffled to them.
MOST_OPEN = 500_000
#: Members of a leader, and shingles of these, that are compared in one task.
TILE, TILE_SHINGLES = 2048, 1_000_000
#: Members of a leader whose sketches are compared in one task.
SKETCHES = 16_384
#: Largest size that may count as small.
LARGEST_SMALL = 64
#: Shingles that stand side by side in the matrix of a tile.
COLUMNS = 1024
_SEVERAL = 0xFFFF
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Scheme:
    """What a link needs, and which sets have subsets and which have lists."""

    def __init__(self, num: int, den: int, boundary: int = 0):
        self.num, self.den, self.boundary = num, den, boundary
        #: Sets of this size or more may have a large partner.
        self.low = -(-num * (boundary + 1) // den)

    def prefix(self, size):
        """Of so many shingles of a set, linked sets share one, whichever are taken first in an order common to all (number or array)."""
        return size + (-self.num * size) // self.den + 1

    def prefix_of(self, size: Column) -> Column:
        return size - F.ceil(F.lit(self.num) * size / F.lit(self.den)) + 1

    def common(self, size: int) -> list[int]:
        """The numbers of common shingles that links with the possible partners need."""
        partners = range(-(-self.num * size // self.den), self.den * size // self.num + 1)
        return sorted({-(-self.num * (size + p) // (self.num + self.den)) for p in partners} & set(range(1, size + 1)))

    def subsets(self, size: int) -> int:
        return sum(comb(size, c) for c in self.common(size))


def boundary(counts: dict[int, int], num: int, den: int) -> int:
    """The largest size whose sets, and all smaller ones, are cheaper as subsets.

    A set costs its subsets, or for lists a look-up of each shingle's frequency and an entry for each shingle of its prefix.
    """
    scheme = Scheme(num, den)
    cost, best, at = 0, 0, 0
    for s in range(1, LARGEST_SMALL + 1):
        each = scheme.subsets(s)
        cost += counts.get(s, 0) * (each - s - scheme.prefix(s)) if counts.get(s) else (each - s - scheme.prefix(s)) / 1e6
        if each > 100_000:
            break
        if cost < best:
            best, at = cost, s
    return at


def subset_keys(each: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the set) of all subsets of the fixed sizes; each: the hashes of sets up to the boundary."""
    sizes = np.array([len(x) for x in each])
    out_key, out_set = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[(sizes > 0) & (sizes <= scheme.boundary)]):
        members = np.flatnonzero(sizes == size)
        rows = mixed(np.stack([each[i] for i in members]) ^ _K2)
        whole = rows.sum(axis=1, dtype=np.uint64)
        for c in scheme.common(int(size)):
            left_out = np.array(list(combinations(range(size), int(size) - c)), dtype=np.int64)
            subset = whole[:, None] - (rows[:, left_out].sum(axis=2, dtype=np.uint64) if left_out.shape[1] else np.zeros((len(members), 1), np.uint64))
            out_key.append(mixed(subset + np.array([c], np.uint64) * _K1).ravel())
            out_set.append(np.repeat(members, subset.shape[1]))
    return np.concatenate(out_key), np.concatenate(out_set)


def linked(sizes_a: np.ndarray, sizes_b: np.ndarray, apart: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes that differ in so many elements link."""
    return den * (sizes_a + sizes_b - apart) >= num * (sizes_a + sizes_b + apart)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|x & y| for each x of left and y of right, by scanning the list of each element that both sides have."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    values_l, values_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(values_l, values_r)
    if not len(shared):
        return out
    sides = []
    for each, values in ((left, values_l), (right, values_r)):
        owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
        column = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[column] == values
        sides.append((owner[hit], column[hit]))
    for at in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - at)
        dense = []
        for (owner, column), n in zip(sides, (len(left), len(right)), strict=True):
            here = (column >= at) & (column < at + width)
            m = np.zeros((n, width), dtype=np.float32)
            m[owner[here], column[here] - at] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def forest(pairs_a: np.ndarray, pairs_b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the given edges between 0 .. n - 1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(pairs_a.tolist(), pairs_b.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            kept.append((a, b))
    return kept


def alone(deltas: list[np.ndarray]) -> np.ndarray:
    """For each difference, how many of its elements no other one has; these set its member apart from all of them."""
    lengths = np.array([len(d) for d in deltas])
    distinct, place, times = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    return np.bincount(np.repeat(np.arange(len(deltas)), lengths), weights=times[place] == 1, minlength=len(deltas)).astype(np.int64)


def links_within(ids: np.ndarray, sizes: np.ndarray, deltas: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between members of a tile, as a forest. The first is the leader, whose difference is empty.

    Members that more elements set apart from all others than a link allows are left out before pairs are looked at, again
    and again while that leaves others without company.
    """
    lengths = np.array([len(d) for d in deltas])
    to_leader = np.flatnonzero(linked(sizes[0], sizes[1:], lengths[1:], num, den)) + 1
    a, b = [np.zeros(len(to_leader), np.int64)], [to_leader]
    left = np.arange(1, len(ids))
    while len(left) > 1:
        near = alone([deltas[i] for i in left]) <= (den - num) * sizes[left] // num
        if near.all():
            break
        left = left[near]
    if len(left) > 1:
        chosen = [deltas[i] for i in left]
        common = common_counts(chosen, chosen).astype(np.int64)
        apart = lengths[left][:, None] + lengths[left][None, :] - 2 * common
        i, j = np.nonzero(np.triu(linked(sizes[left][:, None], sizes[left][None, :], apart, num, den), 1))
        a.append(left[i])
        b.append(left[j])
    return [(int(ids[x]), int(ids[y])) for x, y in forest(np.concatenate(a), np.concatenate(b), len(ids))]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each hash value, in a power of two of bits that is twice the size of the set or more; at least 64."""
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    odd = np.bincount((mixed(hashes ^ _K1) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """Rows of sketches brought down to fewer words: hash values are taken modulo the number of bits, so halves add up."""
    while words.shape[1] > to:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def near_by_sketch(left: list[np.ndarray], sizes_l: np.ndarray, right: list[np.ndarray], sizes_r: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) whose sketches leave a link possible, in portions."""
    words_l, words_r = (np.array([len(x) for x in side]) for side in (left, right))
    for u in np.unique(words_l):
        for v in np.unique(words_r):
            i, j = np.flatnonzero(words_l == u), np.flatnonzero(words_r == v)
            x, y = folded(np.stack([left[k] for k in i]), min(u, v)), folded(np.stack([right[k] for k in j]), min(u, v))
            for at in range(0, len(i), 256):
                apart = np.zeros((len(x[at : at + 256]), len(j)), dtype=np.int64)
                for w in range(x.shape[1]):
                    apart += np.bitwise_count(x[at : at + 256, w, None] ^ y[None, :, w])
                p, q = np.nonzero(linked(sizes_l[i[at : at + 256]][:, None], sizes_r[j][None, :], np.maximum(apart, np.abs(sizes_l[i[at : at + 256]][:, None] - sizes_r[j][None, :])), num, den))
                yield i[at + p], j[q]


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n_shingles, s1, s2) per row of (doc_id, key, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(2), PIECE):
                hashes, offsets = sets(texts, width)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(texts)) for i in (0, 1)), *map(pa.array, _signed(hashes, offsets))], names=["doc_id", "key", *SIGNATURE])
                at += len(texts)

    return rows.mapInArrow(sign, "doc_id long, key long, n_shingles long, s1 long, s2 long")


def keyed(docs: DataFrame) -> list[Column]:
    """doc_id, and what joins tell rows by: doc_id, or a hash of the text where there is none, so that rows without an id are spread."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(F.lit("no id"), "text")).alias("key")]


SIGNATURE = ["n_shingles", "s1", "s2"]


def _signed(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    value = mixed(hashes ^ _K1)
    return [np.diff(offsets), per_text(np.add, value, offsets).view(np.int64), per_text(np.bitwise_xor, mixed(value), offsets).view(np.int64)]


def closed_sets(rows: DataFrame, width: int, scheme: Scheme, total: int) -> DataFrame:
    """Signatures of sets that link with no other: (n_shingles, s1, s2). total: shingles in all sets.

    A set that is not found here only costs more. So it does no harm that a lost task's blocks come back under other numbers.
    """
    pool = min(1.0, POOL * (scheme.den - scheme.num) / scheme.den)
    top = int(pool * 2**32)
    count = max(partitions(rows.sparkSession), int(total * pool) // RANGE_HASHES + 1)
    kinds = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()), ("signs", pa.binary())])

    def packed(hashes: list[np.ndarray], owners: list[np.ndarray], signs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        block, h, owner = secrets.randbits(62), np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        owner = np.where(np.diff(np.append(first, len(h))) > 1, np.uint16(_SEVERAL), owner[first])
        h = h[first]
        to = ((h >> np.uint64(32)) * np.uint64(count) // np.uint64(top)).astype(np.int64)
        cuts = np.searchsorted(to, np.arange(count + 1))
        short = h.astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"range": [block % count], "block": [block], "hashes": [None], "owners": [None], "signs": [np.concatenate(signs).tobytes()]}, schema=kinds)
        for r in np.flatnonzero(cuts[1:] > cuts[:-1]):
            s = slice(cuts[r], cuts[r + 1])
            yield pa.RecordBatch.from_pydict({"range": [int(r)], "block": [block], "hashes": [short[s].tobytes()], "owners": [owner[s].tobytes()], "signs": [None]}, schema=kinds)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        n_hashes = n_texts = 0
        for batch in batches:
            for piece in pieces(batch.column(0), PIECE):
                for at in range(0, len(piece), BLOCK_TEXTS):
                    texts = piece.slice(at, BLOCK_TEXTS)
                    if n_hashes >= BLOCK_HASHES or n_texts + len(texts) > BLOCK_TEXTS:
                        yield from packed(*held)
                        held, n_hashes, n_texts = ([], [], []), 0, 0
                    hashes, offsets = sets(texts, width)
                    looked_at = (hashes >> np.uint64(32)) < np.uint64(top)
                    held[0].append(hashes[looked_at])
                    held[1].append(np.repeat((np.arange(len(texts)) + n_texts).astype(np.uint16), np.diff(offsets))[looked_at])
                    held[2].append(np.stack(_signed(hashes, offsets), axis=1))
                    n_hashes, n_texts = n_hashes + len(held[0][-1]), n_texts + len(texts)
        if n_texts:
            yield from packed(*held)

    def single(key: tuple, table: pa.Table) -> pa.Table:
        """Per block, how many hashes of the range each of its texts has alone."""
        table = table.combine_chunks()
        signs = table.filter(pa.compute.is_valid(table["signs"]))
        table = table.filter(pa.compute.is_valid(table["hashes"]))
        out = {"block": signs["block"].to_pylist(), "owners": [None] * len(signs), "times": [None] * len(signs), "signs": signs["signs"].to_pylist()}
        if len(table):
            each = [np.frombuffer(x, np.uint32) for x in table["hashes"].to_pylist()]
            _, inverse, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            owners = np.concatenate([np.frombuffer(x, np.uint16) for x in table["owners"].to_pylist()])
            good = (times[inverse] == 1) & (owners != _SEVERAL)
            ends = np.cumsum([len(x) for x in each])
            for block, a, z in zip(table["block"].to_pylist(), ends - [len(x) for x in each], ends, strict=True):
                owner, n = np.unique(owners[a:z][good[a:z]], return_counts=True)
                if len(owner):
                    out["block"].append(block)
                    out["owners"].append(owner.tobytes())
                    out["times"].append(n.astype(np.uint32).tobytes())
                    out["signs"].append(None)
        return pa.Table.from_pydict(out, schema=pa.schema([("block", pa.int64()), ("owners", pa.binary()), ("times", pa.binary()), ("signs", pa.binary())]))

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        signs = [x for x in table["signs"].to_pylist() if x is not None]
        signs = np.frombuffer(signs[0] if signs else b"", np.int64).reshape(-1, 3)
        own = np.zeros(len(signs), np.int64)
        for owners, times in zip(table["owners"].to_pylist(), table["times"].to_pylist(), strict=True):
            if owners is not None and len(own):
                own[np.frombuffer(owners, np.uint16)] += np.frombuffer(times, np.uint32)
        found = signs[(signs[:, 0] > 0) & (own >= scheme.prefix(signs[:, 0]))]
        return pa.table({name: pa.array(found[:, i]) for i, name in enumerate(SIGNATURE)})

    sent = rows.select("text").mapInArrow(send, "range long, block long, hashes binary, owners binary, signs binary")
    told = sent.groupBy("range").applyInArrow(single, "block long, owners binary, times binary, signs binary")
    return told.groupBy("block").applyInArrow(settle, "n_shingles long, s1 long, s2 long")


def open_sets(rows: DataFrame, open_keys: DataFrame, width: int) -> DataFrame:
    """The different sets of the texts of some documents: (sid, n_shingles, s1, s2, hashes), written; sid is made up here."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(0), PIECE):
                hashes, offsets = sets(texts, width)
                made = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*map(pa.array, _signed(hashes, offsets)), made], names=[*SIGNATURE, "hashes"])

    texts = rows.join(broadcast_if_small(open_keys, MOST_OPEN), "key").select("text")
    found = texts.mapInArrow(shingle, "n_shingles long, s1 long, s2 long, hashes array<long>").where("n_shingles > 0")
    return written(found.dropDuplicates(SIGNATURE).select(F.monotonically_increasing_id().alias("sid"), *SIGNATURE, "hashes"), "jaccard-sets")


def lists(open_: DataFrame, scheme: Scheme) -> DataFrame:
    """(small, key, sid): subsets of small sets; of sets that may have a large partner, the rarest shingles that others have too."""
    shingles = open_.where(F.col("n_shingles") >= scheme.low).select("sid", "n_shingles", F.explode("hashes").alias("key"))
    others = shingles.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    own = Window.partitionBy("sid")
    # Shingles that a set has alone come first in the order, and nobody else is in their lists.
    place = F.col("n_shingles") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "key"))
    ranked = shingles.join(others, "key").withColumn("place", place)
    large = ranked.where(F.col("place") <= scheme.prefix_of(F.col("n_shingles"))).select(F.lit(False).alias("small"), "key", "sid")

    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.slice(at, 512)
                key, which = subset_keys([np.array(x, np.int64).view(np.uint64) for x in rows.column(1).to_pylist()], scheme)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), bool)), pa.array(key.view(np.int64)), rows.column(0).take(pa.array(which))], names=["small", "key", "sid"])

    small = open_.where(F.col("n_shingles") <= scheme.boundary).select("sid", "hashes").mapInArrow(enumerate_subsets, "small boolean, key long, sid long")
    return large.unionByName(small)


def compared(open_: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) inside each tile of placed: (h, tile, sid), where the leader h is a member of each of its tiles."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, own = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if at is None or at[0] not in ids:
                return
            lead = ids.index(at[0])
            order = [lead, *(i for i in range(len(ids)) if i != lead)]
            deltas = [np.setxor1d(own[i], own[lead], assume_unique=True) for i in order]
            found = links_within(np.array([ids[i] for i in order]), np.array([len(own[i]) for i in order]), deltas, num, den)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for h, tile, sid, hashes in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (h, tile) != at:
                    yield from done()
                    at, ids, own = (h, tile), [], []
                ids.append(sid)
                own.append(hashes.values.to_numpy().view(np.uint64))
        yield from done()

    whole = placed.join(open_.select("sid", "hashes"), "sid").select("h", "tile", "sid", "hashes")
    return whole.repartition(partitions(open_.sparkSession), "h", "tile").sortWithinPartitions("h", "tile").mapInArrow(compare, "a long, b long")


def across(open_: DataFrame, members: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members (h, sid, tile) of different tiles of a leader that links do not connect."""
    reached = components(links)
    portions = members.groupBy("h").agg(F.ceil(F.count("*") / F.lit(SKETCHES)).cast("int").alias("portions"))
    placed = members.join(portions, "h").withColumn("portion", F.pmod(F.xxhash64("sid"), F.col("portions")).cast("int"))
    with_sets = placed.join(open_.select("sid", "n_shingles", "hashes"), "sid").join(reached.withColumnRenamed("id", "sid"), "sid", "left")
    # Each portion goes to each pair of portions that it is in; a third portion stands for the pair with itself.
    sides = with_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).select(
        "h", F.least("portion", "other").alias("low"), F.greatest("portion", "other").alias("high"), "portion", "tile", "sid", "n_shingles", F.coalesce("component", "sid").alias("part"), _sketch_udf()("hashes").alias("sketch")
    )

    def hold(key: tuple, table: pa.Table) -> pa.Table:
        sid, size, part, portion, tile = (table[c].to_numpy() for c in ("sid", "n_shingles", "part", "portion", "tile"))
        sketches = [np.frombuffer(x, np.uint64) for x in table["sketch"].to_pylist()]
        left, right = np.flatnonzero(portion == key[1].as_py()), np.flatnonzero(portion == key[2].as_py())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(left) and len(right):
            for i, j in near_by_sketch([sketches[k] for k in left], size[left], [sketches[k] for k in right], size[right], num, den):
                i, j = left[i], right[j]
                keep = (part[i] != part[j]) & (tile[i] != tile[j]) & ((portion[i] != portion[j]) | (sid[i] < sid[j]))
                a.append(sid[i[keep]])
                b.append(sid[j[keep]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    near = sides.groupBy("h", "low", "high").applyInArrow(hold, "a long, b long").distinct()
    whole = open_.select("sid", "n_shingles", "hashes")
    pairs = near.join(whole.withColumnsRenamed({"sid": "a", "n_shingles": "na", "hashes": "ha"}), "a").join(whole.withColumnsRenamed({"sid": "b", "n_shingles": "nb", "hashes": "hb"}), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.where(F.lit(den) * both >= F.lit(num) * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _sketch_udf():
    @F.arrow_udf("binary")
    def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sketch(x.values.to_numpy().view(np.uint64)).tobytes() for x in batch], pa.binary())

    return sketches


def groups(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """join() with the key and the signature of each row's set, and whether it is the one of its component that stays.

    That is the set, of those that the smallest doc_id has, of least signature. Components are told apart by it, whatever ids they share.
    Rows without an id stay only if no row of the component has one; then it is the set of the smallest key.
    """
    rows = small_batches(docs).select(*keyed(docs), "text")
    signed = cut(signatures(rows, width))
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    classes = cut(signed.where("n_shingles > 0").groupBy(*SIGNATURE).agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "key")).alias("first"), F.count("*").alias("times")))
    open_keys = cut(classes.join(closed_sets(rows, width, Scheme(num, den), total), SIGNATURE, "left_anti").select("first.key").distinct())
    open_ = open_sets(rows, open_keys, width)

    sizes = open_.where(F.col("n_shingles") <= LARGEST_SMALL).groupBy("n_shingles").count().collect()
    entries = written(lists(open_, Scheme(num, den, boundary({r.n_shingles: r["count"] for r in sizes}, num, den))), "jaccard-lists")
    leaders = entries.groupBy("small", "key").agg(F.min("sid").alias("h"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = cut(entries.join(leaders, ["small", "key"]).where("h <> sid").select("h", "sid").distinct().join(open_.select("sid", "n_shingles"), "sid"))
    tiles = members.groupBy("h").agg(F.greatest(F.ceil(F.count("*") / F.lit(TILE)), F.ceil(F.sum("n_shingles") / F.lit(TILE_SHINGLES))).cast("int").alias("tiles"))
    placed = members.join(tiles, "h").select("h", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int").alias("tile"), "sid", "tiles")
    heads = tiles.select("h", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("h").alias("sid"), "tiles")
    links = cut(compared(open_, placed.unionByName(heads), num, den))
    several = cut(placed.where("tiles > 1").select("h", "sid", "tile"))
    if not several.isEmpty():
        links = links.unionByName(across(open_, several, links, num, den))

    reached = components(links).withColumnRenamed("id", "sid").join(open_.select("sid", *SIGNATURE), "sid").join(classes, SIGNATURE)
    least = reached.groupBy("component").agg(F.min(F.struct("first", *SIGNATURE)).alias("least"))
    named = reached.join(least, "component").select(*SIGNATURE, "least")
    copies = classes.where("times > 1").join(named, SIGNATURE, "left_anti").select(*SIGNATURE, F.struct("first", *SIGNATURE).alias("least"))
    known = broadcast_if_small(cut(named.unionByName(copies)), MOST_OPEN)
    own = F.struct(F.col("doc_id").isNull(), "key", *SIGNATURE)
    stays = own == F.struct("least.first.nameless", "least.first.key", *[f"least.{c}" for c in SIGNATURE])
    component = F.when(F.col("least").isNull(), F.col("doc_id")).when(~F.col("least.first.nameless"), F.col("least.first.key"))
    return signed.join(known, SIGNATURE, "left").select("doc_id", "key", *SIGNATURE, component.alias("component_id"), (F.col("least").isNull() | stays).alias("stays"))


def join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included).

    docs: (doc_id, text); other columns play no part. A-Z count as lower case, a null text is
    empty; documents without words link with nothing. Copies of a set are linked. num / den is the least similarity, any above 0.
    Rows that share a doc_id are documents of their own: each gets the component of its own text. So are rows without a doc_id; their
    component_id is the smallest doc_id that they reach, null if there is none.
    """
    return groups(docs, width, num, den).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near copies: of each component the row of the smallest doc_id stays, with all its columns.

    Documents without words stay. Rows that share a doc_id are judged each by its own text; of those that
    agree in doc_id and set of shingles, any one stays. A row without a doc_id stays if its component holds no doc_id and no other such row.
    """
    found = cut(groups(docs, width, num, den))
    judged = found.where("doc_id IS NOT NULL OR n_shingles > 0")
    per_key = cut(judged.groupBy("key").agg(F.count("*").alias("times"), F.max("stays").alias("stays")).where("times > 1 OR NOT stays"))
    whole = docs.select(keyed(docs)[1].alias("_key"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    plain = whole.join(broadcast_if_small(per_key.select(F.col("key").alias("_key")), MOST_OPEN), "_key", "left_anti").select("_row.*")
    repeated = per_key.where("times > 1 AND stays").select(F.col("key").alias("_key"))
    if repeated.isEmpty():
        return plain

    @F.arrow_udf("n_shingles long, s1 long, s2 long")
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.StructArray.from_arrays([*map(pa.array, _signed(*sets(texts, width)))], names=SIGNATURE) for texts in pieces(batch, PIECE)]
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([pa.array([], pa.int64())] * 3, names=SIGNATURE)

    rows = whole.join(broadcast_if_small(repeated, MOST_OPEN), "_key").select("_key", "_row", signed("_text").alias("_s"))
    wanted = judged.where("stays").select(F.col("key").alias("_key"), F.struct(*SIGNATURE).alias("_s")).distinct()
    return plain.unionByName(rows.join(wanted, ["_key", "_s"]).dropDuplicates(["_key", "_s"]).select("_row.*"))
