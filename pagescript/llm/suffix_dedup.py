"""Exact substring removal by suffix order: later copies of long passages go, the first stays.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a smaller id. In terms of
suffixes: a suffix whose longest previous factor (the longest match with a suffix of an earlier document) reaches
``length``. The suffixes that share a prefix stand together in suffix order, so that match is with the previous or
next smaller document there, and only prefixes of ``length`` bytes decide.

One suffix array of a corpus would need every suffix to be shuffled. Instead, suffixes are dealt out so that those that
can match meet, and most never move:

1. Every window of ``length`` bytes has an anchor: the substring of ``anchor`` bytes with the least hash in it. Equal
   windows have equal anchors. Each block of documents sends the distinct hashes of its anchors, packed, one row for each
   range of hashes; a hash that is in two documents or more is marked, and the marks go back as one bit per hash.
2. Around a marked anchor, the bytes of all windows that it leads (its run) are sent, each different run once per block. Each
   range of hashes sorts the suffixes of its runs, finds the previous smaller document for each, and sends back, for each run,
   the windows that occur earlier.
3. Each block marks the bytes that such windows cover.

Nothing is capped: a hash that a third of all documents hold is one packed entry per block, and a run that they all share
one copy per block. A block holds the documents of one hash bucket of doc_id and text. The number of packed rows is blocks times
ranges at most; both sizes are parameters, so a larger corpus takes larger ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, partitions

#: Order of a null id: after all others but an id of this value, which is no earlier.
NO_ID = (1 << 63) - 1
#: Bytes of text whose hashes are worked on at a time.
CHUNK = 1 << 18
RUNS = pa.schema([("range", pa.int32()), ("block", pa.int32()), ("bytes", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each substring of width bytes, by doubling: a power of two from two halves, the rest from two overlapping ones."""
    level = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    size = 1
    while size * 2 <= width:
        level = level[: len(level) - size] * np.uint64(0xD6E8FEB86659FD93) + (level[size:] ^ (level[size:] >> np.uint64(29)))
        size *= 2
    if size < width:
        rest = width - size
        level = level[: len(level) - rest] * np.uint64(0xD6E8FEB86659FD93) + (level[rest:] ^ (level[rest:] >> np.uint64(29)))
    return mixed(level)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    if size < width:
        rest = width - size
        values = np.minimum(values[: len(values) - rest], values[rest:])
    return values


def anchors(data: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows: (hash of the anchor, first window, last window), positions in data, windows within one text each.

    A run ends where the least hash changes or moves to another place, so equal text around gives equal runs.
    """
    if len(data) < length:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    span = length - anchor + 1
    hashes = rolling(data, anchor)
    least = sliding_min(hashes, span)
    n = len(least)
    whole = np.ones(n + 1, dtype=bool)
    # Windows that cross the end of a text are no windows.
    starts = np.zeros(n + length + 1, dtype=np.int32)
    for_ends = ends[1:-1]
    np.add.at(starts, np.clip(for_ends - length + 1, 0, n), 1)
    np.add.at(starts, np.clip(for_ends, 0, n), -1)
    whole[:n] = np.cumsum(starts[:n]) == 0
    whole[n] = False
    change = np.empty(n + 1, dtype=bool)
    change[0] = change[n] = True
    change[1:n] = (least[1:] != least[:-1]) | (whole[1:n] != whole[: n - 1])
    # Texts that end within a window of each other: a boundary may fall between two whole windows only if none is left out,
    # which happens for empty texts alone.
    edges = np.flatnonzero(change)
    first, last = edges[:-1], edges[1:] - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    # The same least hash in a row at another place: split where the anchor leaves the window.
    long = np.flatnonzero(last - first + 1 > span)
    if len(long):
        parts = [(first[i] + np.arange(0, last[i] - first[i] + 1, span)) for i in long]
        more_first = np.concatenate(parts)
        more_last = np.concatenate([np.append(p[1:] - 1, last[i]) for p, i in zip(parts, long, strict=True)])
        rest = np.ones(len(first), dtype=bool)
        rest[long] = False
        first, last = np.concatenate([first[rest], more_first]), np.concatenate([last[rest], more_last])
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    # Least hashes crowd near 0; scrambled again, they spread evenly over ranges.
    return mixed(least[first] ^ _MIX), first, last


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of each start among all by the ``length`` bytes from there: suffix order as far as it decides.

    The order of words of 8 bytes refines the order so far, word by word; the last word overlaps the one before. Suffixes
    whose rank nobody shares any more are settled and drop out.
    """
    n = max(len(data) - 7, 0)
    word = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        word <<= np.uint64(8)
        word |= data[i : i + n]
    ranks = np.zeros(len(starts), dtype=np.int64)
    open_ = np.arange(len(starts))
    for at in [*range(0, length - 8, 8), length - 8]:
        here = word[starts[open_] + at]
        order = np.lexsort((here, ranks[open_]))
        was, now = ranks[open_[order]], here[order]
        parted = np.append(True, was[1:] != was[:-1])
        fresh = parted | np.append(True, now[1:] != now[:-1])
        # The rank is the place of the first equal suffix; places of settled suffixes stay free.
        first, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        ranks[open_[order]] = was + first[group] - np.flatnonzero(parted)[np.cumsum(parted) - 1]
        alone = np.diff(np.append(first, len(order))) == 1
        open_ = open_[order][~alone[group]]
        if not len(open_):
            break
    return ranks


def previous_smaller(ranks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix reaches the compared length: a smaller document has an equal rank.

    In suffix order, with equal prefixes ordered by document, the previous smaller document of a suffix stands before it
    among its equals; the first of the equals has none.
    """
    order = np.lexsort((docs, ranks))
    r, d = ranks[order], docs[order]
    head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    smallest = np.repeat(d[head], np.diff(np.append(head, len(r))))
    out = np.empty(len(ranks), dtype=bool)
    out[order] = d > smallest
    return out


class Block:
    """The documents of a block, sorted by id, and their anchors. Equal texts keep the smallest id; later ones are copies."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, texts: pa.Array, length: int, anchor: int):
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):  # texts of one id in an order of their own, the same in every pass
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], known[i], texts[i].as_py())))
        self.ids, self.known, self.texts = ids[order], known[order], texts.take(pa.array(order))
        self.data, self.ends = buffers(self.texts)
        parts, at = [], 0
        while at < len(self.ids):  # a few texts at a time: hashes take many times the room of the texts
            to = max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + CHUNK, side="right")) - 1)
            a, z = self.ends[at], self.ends[to]
            hashes, first, last = anchors(self.data[a:z], self.ends[at : to + 1] - a, length, anchor)
            parts.append((hashes, first + a, last + a))
            at = to
        self.hash, self.first, self.last = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else anchors(self.data, self.ends, length, anchor)
        self.doc = np.searchsorted(self.ends, self.first, side="right") - 1

    def ranges(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct hashes, where each of count ranges begins)"""
        distinct = np.unique(self.hash)
        return distinct, np.searchsorted(range_of(distinct, count), np.arange(count + 1))


def range_of(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def _block(table: pa.Table, length: int, anchor: int) -> Block | None:
    if not table.num_rows:
        return None
    texts = table["text"].combine_chunks() if table["text"].num_chunks != 1 else table["text"].chunk(0)
    return Block(table["doc_id"].to_numpy(), table["known"].to_numpy(), pa.compute.fill_null(texts.cast(pa.large_string()), ""), length, anchor)


def removal(docs: DataFrame, length: int = 50, anchor: int = 20, block_bytes: int = 8 << 20, range_bytes: int = 4 << 20) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, spans (array of [start, end) in bytes), kept_sha256, kept (binary).

    docs: (doc_id, text); other columns are left out. Texts are UTF-8 bytes, null is empty. Matches never cross documents and never count
    within one document. Texts shorter than length lose nothing. Equal doc_ids are no earlier than each other, so copies under one id
    stay; so are null ids, which come after all others (as if they were the largest number there is). Repeated rows are rows of the result each.
    block_bytes is the text in one block, and what a task works on: it holds some ten times as much in memory. range_bytes is the text for
    each range of hashes.
    """
    if not 16 <= anchor <= length - 1:
        raise ValueError("anchor must be from 16 to length - 1")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, count = total // block_bytes + 1, total // range_bytes + 1
    block_of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text", block_of.alias("block"))
    dealt = own.repartition(max(blocks, partitions(docs.sparkSession)), "block")

    def send_hashes(key: tuple, rows: pa.Table) -> pa.Table:
        """The distinct anchor hashes of a block by range: low 32 bits, and whether two documents of the block have it."""
        b = _block(rows, length, anchor)
        distinct, begin = b.ranges(count)
        place = np.searchsorted(distinct, b.hash)
        low, high = np.full(len(distinct), len(b.ids)), np.full(len(distinct), -1)
        np.minimum.at(low, place, b.doc)
        np.maximum.at(high, place, b.doc)
        several = b.ids[np.minimum(low, len(b.ids) - 1)] != b.ids[np.maximum(high, 0)]
        short = distinct.astype(np.uint32)
        filled = np.flatnonzero(begin[1:] > begin[:-1])
        return pa.Table.from_arrays(
            [
                pa.array(filled, pa.int32()),
                pa.array(np.full(len(filled), key[0].as_py()), pa.int32()),
                pa.array([short[begin[r] : begin[r + 1]].tobytes() for r in filled], pa.binary()),
                pa.array([np.packbits(several[begin[r] : begin[r + 1]]).tobytes() for r in filled], pa.binary()),
            ],
            names=["range", "block", "hashes", "several"],
        )

    def mark_hashes(key: tuple, rows: pa.Table) -> pa.Table:
        """One bit for each hash of each block: it is in two documents or more."""
        each = [np.frombuffer(x, np.uint32) for x in rows["hashes"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(rows["several"].to_pylist(), each, strict=True)]
        distinct, inverse, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        repeated = times > 1
        repeated[inverse[np.concatenate(several)]] = True
        bits = np.split(repeated[inverse], np.cumsum([len(h) for h in each])[:-1])
        return pa.Table.from_arrays(
            [rows["block"].combine_chunks(), pa.array([key[0].as_py()] * rows.num_rows, pa.int32()), pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())], names=["block", "range", "marks"]
        )

    def marked(b: Block, marks: pa.Table) -> np.ndarray:
        """Runs whose anchor is marked, one for each different content of each anchor: the first document's."""
        distinct, begin = b.ranges(count)
        repeated = np.zeros(len(distinct), dtype=bool)
        for r, bits in zip(marks["range"].to_pylist(), marks["marks"].to_pylist(), strict=True):
            repeated[begin[r] : begin[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=begin[r + 1] - begin[r])
        return np.flatnonzero(repeated[np.searchsorted(distinct, b.hash)]) if len(distinct) else np.zeros(0, np.int64)

    def distinct_runs(b: Block, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into runs of the first with each content, for each run the number of that content); runs are in id order."""
        raw = memoryview(b.data.tobytes())
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(bytes(raw[a:z]), len(known)) for a, z in zip(b.first[runs], b.last[runs] + length, strict=True)), np.int64, len(runs))
        lead = np.full(len(known), len(runs))
        np.minimum.at(lead, number, np.arange(len(runs)))
        return lead, number

    def send_runs(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return RUNS.empty_table()
        b = _block(table, length, anchor)
        runs = marked(b, replies)
        lead, _ = distinct_runs(b, runs)
        runs = runs[lead]
        to = range_of(b.hash[runs], count)
        order = np.argsort(to, kind="stable")
        runs, to = runs[order], to[order]
        cuts = np.searchsorted(to, np.arange(count + 1))
        out: dict[str, list] = {"range": [], "block": [], "bytes": [], "sizes": [], "docs": []}
        for r in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own = runs[cuts[r] : cuts[r + 1]]
            out["range"].append(int(r))
            out["block"].append(key[0].as_py())
            out["bytes"].append(b"".join(b.data[x:y].tobytes() for x, y in zip(b.first[own], b.last[own] + length, strict=True)))
            out["sizes"].append((b.last[own] - b.first[own] + 1).astype(np.uint16).tobytes())
            out["docs"].append(b.ids[b.doc[own]].astype(np.int64).tobytes())
        return pa.Table.from_pydict(out, schema=RUNS)

    def match_runs(key: tuple, rows: pa.Table) -> pa.Table:
        """Per block and run: one bit for each of its windows, set if an earlier document has the window."""
        sizes = [np.frombuffer(x, np.uint16).astype(np.int64) for x in rows["sizes"].to_pylist()]
        windows = np.concatenate(sizes)
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in rows["docs"].to_pylist()])
        raw = b"".join(rows["bytes"].to_pylist())
        ends = np.cumsum(windows + length - 1)
        begin = ends - (windows + length - 1)
        # Blocks that sent the same run: only the smallest document's is sorted, the others have all of it from there.
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(raw[a:z], len(known)) for a, z in zip(begin, ends, strict=True)), np.int64, len(begin))
        order = np.lexsort((docs, number))
        lead = order[np.append(True, np.diff(number[order]) != 0)]
        own = windows[lead]
        place = np.cumsum(own) - own
        within = np.arange(own.sum()) - np.repeat(place, own)
        data = np.frombuffer(raw, np.uint8)
        flags = previous_smaller(suffix_ranks(data, np.repeat(begin[lead], own) + within, length), np.repeat(docs[lead], own))
        all_within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        earlier = flags[np.repeat(place[number], windows) + all_within] | np.repeat(docs > docs[lead][number], windows)
        per_block = np.split(earlier, np.cumsum([s.sum() for s in sizes])[:-1])
        return pa.Table.from_arrays(
            [rows["block"].combine_chunks(), pa.array([key[0].as_py()] * rows.num_rows, pa.int32()), pa.array([np.packbits(x).tobytes() for x in per_block], pa.binary())], names=["block", "range", "earlier"]
        )

    def finish(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        b = _block(table, length, anchor)
        covered = np.zeros(len(b.data) + 1, dtype=np.int32)
        if replies.num_rows:
            marks = replies.filter(pa.compute.is_valid(replies["marks"]))
            runs = marked(b, marks)
            lead, number = distinct_runs(b, runs)
            chosen = runs[lead]
            to = range_of(b.hash[chosen], count)
            order = np.argsort(to, kind="stable")
            windows = (b.last - b.first + 1)[chosen]
            at = np.zeros(len(chosen), dtype=np.int64)
            at[order] = np.cumsum(windows[order]) - windows[order]
            cuts = np.searchsorted(to[order], np.arange(count + 1))
            flags = np.zeros(windows.sum(), dtype=bool)
            answers = replies.filter(pa.compute.is_valid(replies["earlier"]))
            for r, bits in zip(answers["range"].to_pylist(), answers["earlier"].to_pylist(), strict=True):
                own = order[cuts[r] : cuts[r + 1]]
                n = int(windows[own].sum())
                flags[at[own[0]] : at[own[0]] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
            # A later document with a run that an earlier one of this block has loses all its windows.
            own_windows = (b.last - b.first + 1)[runs]
            within = np.arange(own_windows.sum()) - np.repeat(np.cumsum(own_windows) - own_windows, own_windows)
            later = np.repeat(b.ids[b.doc[runs]] > b.ids[b.doc[chosen[number]]], own_windows)
            hit = later | flags[np.repeat(at[number], own_windows) + within]
            starts = (np.repeat(b.first[runs], own_windows) + within)[hit]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + length, -1)
        gone = np.append(np.cumsum(covered[:-1]) > 0, False)
        found = []
        for at_row in range(0, len(b.ids), 256):
            out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept_sha256": [], "kept": []}
            for i in range(at_row, min(at_row + 256, len(b.ids))):
                a, z = int(b.ends[i]), int(b.ends[i + 1])
                mask = gone[a:z]
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                kept = b.data[a:z][~mask].tobytes()
                for name, value in (("doc_id", int(b.ids[i]) if b.known[i] else None), ("n_bytes", z - a), ("n_removed", int(mask.sum())), ("n_spans", len(edges) // 2), ("spans", edges.reshape(-1, 2).tolist()), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                    out[name].append(value)
            found.append(pa.RecordBatch.from_pydict(out, schema=RESULT))
        return pa.Table.from_batches(found, schema=RESULT)

    hashes = dealt.groupBy("block").applyInArrow(send_hashes, "range int, block int, hashes binary, several binary")
    marks = hashes.groupBy("range").applyInArrow(mark_hashes, "block int, range int, marks binary")
    runs = dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(send_runs, "range int, block int, bytes binary, sizes binary, docs binary")
    answers = runs.groupBy("range").applyInArrow(match_runs, "block int, range int, earlier binary")
    replies = marks.withColumn("earlier", F.lit(None).cast("binary")).unionByName(answers.withColumn("marks", F.lit(None).cast("binary")))
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string, kept binary")

