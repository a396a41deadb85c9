"""SimHash near duplicates by multi-index hashing.

A document's fingerprint has a bit set where over half of the hashes of its word shingles have it. Fingerprints link at MOST differing bits or
fewer. Of two halves of 32 bits one then differs in at most one bit, so every fingerprint stands in a table under each half and is looked up
under the half and its ball of radius one. Of two halves that differ in one bit just one has it set; only that one looks the other up,
with the bit cleared. What is found is verified in full.

A half that very many different fingerprints share is split: there, and where such fingerprints look others up, keys are longer by a quarter of
the other half and its ball. At most 65,536 fingerprints agree in 48 bits, so lists are bounded without a cap. Copies of a fingerprint count
once, and only a spanning forest of the links leaves a task, so a group of near copies never becomes a table of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, buffers, cut, pieces, small_batches, written
from .components import components
from .jaccard import forest

SEED, MOST = 42, 3
#: Different fingerprints under a half from which on keys are longer.
MOST_UNDER_HALF = 256
#: Shingles that are hashed at once, rows of a task of lookups on average, pairs that are verified at once.
SHINGLES, TASK_ROWS, PAIRS = 1 << 16, 200_000, 1 << 20
#: Rows that a join may broadcast.
MOST_ROWS = 500_000
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def fingerprints(texts, width: int = 3) -> np.ndarray:
    """The fingerprint of each text of an Arrow string array as uint64; shingles are width words joined by blanks, or all of fewer words."""
    data, ends = buffers(texts)
    n = len(texts)
    dark = np.concatenate((~_BLANK[data], [False]))
    begins, stops = dark.copy(), dark.copy()
    begins[1:] &= ~dark[:-1]
    stops[:-1] &= ~dark[1:]
    edges = ends[1:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = dark[inner]
    stops[inner - 1] = dark[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    owner = np.searchsorted(ends, first, side="right") - 1
    # Words one after the other with one blank between them; a shingle is a slice.
    lengths = last - first + 1
    put = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    words = dark[: len(data)]
    joined[np.repeat(put - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))] = _LOWER[data[words]]
    count = np.bincount(owner, minlength=n)
    at = np.flatnonzero(np.arange(len(first)) - (np.cumsum(count) - count)[owner] <= np.maximum(count - width, 0)[owner])
    to = at + np.minimum(count[owner[at]], width) - 1
    start, stop, text = put[at], put[to] + lengths[to], owner[at]
    set_, total = np.zeros((n, 64), np.int64), np.bincount(text, minlength=n)
    digest, raw = partial(xxhash.xxh64_intdigest, seed=SEED), joined.tobytes()
    for k in range(0, len(at), SHINGLES):
        part = slice(k, k + SHINGLES)
        hashes = np.fromiter(map(digest, map(raw.__getitem__, map(slice, start[part].tolist(), stop[part].tolist()))), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        firsts = np.flatnonzero(np.concatenate(([True], text[part][1:] != text[part][:-1])))
        set_[text[part][firsts]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
    return np.packbits(2 * set_ > total[:, None], axis=1, bitorder="little").view(np.uint64).reshape(n)


def fingerprinted(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a long of the same bits."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(texts, width).view(np.int64) for texts in pieces(batch["text"], 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["doc_id", "fp"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def _bits(value: Column, width: int, only_set: bool) -> Column:
    """value and the values that differ from it in one of its lowest bits; only those with a bit less, if only_set."""
    masks = F.array(*[F.lit(1 << b) for b in range(width)])
    if only_set:
        masks = F.filter(masks, lambda m: value.bitwiseAND(m) != 0)
    return F.concat(F.array(value), F.transform(masks, lambda m: value.bitwiseXOR(m)))


def _half(which: Column | int) -> Column:
    return F.shiftrightunsigned("fp", 32) if which == 0 else F.col("fp").bitwiseAND((1 << 32) - 1)


def _quarter(half: Column, which: int) -> Column:
    return F.shiftrightunsigned(half, 16) if which == 0 else half.bitwiseAND((1 << 16) - 1)


def lookups(distinct: DataFrame) -> DataFrame:
    """(half, key, fp, entry): the table's entries under each half, and the keys with a bit less that each fingerprint looks up."""
    rows = []
    for half in (0, 1):
        keys = F.posexplode(_bits(_half(half), 32, True)).alias("_p", "key")
        rows.append(distinct.select("fp", keys).select(F.lit(half).alias("half"), "key", "fp", (F.col("_p") == 0).alias("entry")))
    return rows[0].unionByName(rows[1])


def lengthened(rows: DataFrame) -> DataFrame:
    """Lookups with keys of 48 bits: each entry under both quarters of the other half; ``same`` marks what also looks up entries of its own half key."""
    out = []
    for quarter in (0, 1):
        other = F.when(F.col("half") == 0, _half(1)).otherwise(_half(0))
        mine = _quarter(other, quarter)
        # Under one half key the bit that is cleared tells who looks up whom; from another half key all of the ball is needed.
        ball = F.when(F.col("entry"), _bits(mine, 16, True)).otherwise(_bits(mine, 16, False))
        keys = rows.select("half", "key", "fp", "entry", F.posexplode(ball).alias("_p", "_q"))
        kind = F.col("half") * 2 + quarter + 2
        out.append(keys.select(kind.cast("int").alias("kind"), F.shiftleft("key", 16).bitwiseOR(F.col("_q")).alias("key"), "fp", (F.col("entry") & (F.col("_p") == 0)).alias("entry")))
    return out[0].unionByName(out[1])


def near_pairs(entries: np.ndarray, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of near entries, i below j, and (i, len(entries) + j) of entries near probes, some at a time."""
    both = np.concatenate((entries, probes))
    step = max(1, PAIRS // max(1, len(both)))
    for at in range(0, len(entries), step):
        apart = np.bitwise_count(entries[at : at + step, None] ^ both[None, :]) <= MOST
        i, j = np.nonzero(apart)
        i = i + at
        keep = j > i
        yield i[keep], j[keep]


def links_of_lists(kind: np.ndarray, key: np.ndarray, fp: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs among the rows of whole lists, as a spanning forest: entries of one (kind, key) with each other and with what looks them up."""
    order = np.lexsort((~entry, key, kind))
    kind, key, fp, entry = kind[order], key[order], fp[order], entry[order]
    start = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])))) if len(fp) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(fp)))
    entries = np.add.reduceat(entry.astype(np.int64), start) if len(fp) else size
    names, place = np.unique(fp, return_inverse=True)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, n, e in zip(*(x[(entries > 0) & (size > 1)].tolist() for x in (start, size, entries)), strict=True):
        found_a, found_b = [], []
        for i, j in near_pairs(fp[s : s + e].view(np.uint64), fp[s + e : s + n].view(np.uint64)):
            found_a.append(place[s + i])
            found_b.append(place[s + j])
            if sum(map(len, found_a)) > PAIRS:
                kept = np.array(_tree(np.concatenate(found_a), np.concatenate(found_b)), np.int64).reshape(-1, 2)
                found_a, found_b = [kept[:, 0]], [kept[:, 1]]
        a += found_a
        b += found_b
    kept = np.array(_tree(np.concatenate(a), np.concatenate(b)), np.int64).reshape(-1, 2)
    return names[kept[:, 0]], names[kept[:, 1]]


def _tree(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of edges between any numbers."""
    ids, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    return [(ids[i], ids[j]) for i, j in forest(places[: len(a)], places[len(a) :], len(ids))]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the fingerprints (fp) of a table of different ones that connect all that MOST bits or fewer tell apart."""
    n = distinct.count()
    entries = lookups(distinct)
    full = cut(entries.where("entry").groupBy("half", "key").count().where(F.col("count") >= MOST_UNDER_HALF).select("half", "key"))
    if full.isEmpty():
        rows = entries.select(F.col("half").alias("kind"), "key", "fp", "entry")
    else:
        # Fingerprints under a full half look up the keys with a bit less; these lists are long, too.
        zone = cut(full.select("half", F.explode(_bits(F.col("key"), 32, True)).alias("key")).distinct().withColumn("_long", F.lit(True)))
        marked = entries.join(broadcast_if_small(zone, MOST_ROWS), ["half", "key"], "left")
        plain = marked.where("_long IS NULL").select(F.col("half").alias("kind"), "key", "fp", "entry")
        rows = plain.unionByName(lengthened(marked.where("_long")))

    def hold(table: pa.Table) -> pa.Table:
        columns = [table[c].to_numpy() for c in ("kind", "key", "fp")]
        a, b = links_of_lists(*columns, table["entry"].to_numpy(zero_copy_only=False).astype(bool))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    task = F.pmod(F.xxhash64("kind", "key"), F.lit(max(1, 40 * n // TASK_ROWS)))
    return rows.groupBy(task.alias("_task")).applyInArrow(hold, "a long, b long")


def groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fp, component_id (smallest doc_id that links reach, itself included).

    A-Z count as lower case, a null text is empty; texts without words have the fingerprint zero, which links like any other. A
    row without a doc_id is linked like any other but names no component; that of a group without any id is null. Rows that share a
    doc_id are documents of their own. Other columns are ignored.
    """
    rows = written(fingerprinted(docs, width), "simhash")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")))
    reached = components(written(links(classes.select("fp")), "simhash-links")).withColumnsRenamed({"id": "fp"})
    linked = reached.join(classes, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    copies = classes.where("times > 1").join(named, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    known = cut(named.unionByName(copies).withColumn("_known", F.lit(True)))
    out = rows.join(broadcast_if_small(known, MOST_ROWS), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
