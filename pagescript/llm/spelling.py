"""Spelling variants: words of a vocabulary that one inserted, deleted or replaced code point tells apart, by bit-sliced position indexes.

An index of a set of words has one bitset per position and letter: bit v says that word v has that letter there. A query word is read letter by letter
and updates, for all words of the set at once, the set without an error and the sets with one: a replaced letter keeps its position, an
inserted one shifts all that follow by one. Lengths decide at the end which bits count. Deletions are the insertions of the other word.

One index over a vocabulary of any size would compare every word with every other, if only bit by bit. Two words of lengths n and n or n + 1 that one
error tells apart agree in the first n // 2 letters or in the last n - n // 2; so words are dealt into shards by a hash of either half, under both n and
n - 1, and each shard has an index of its own. Shards are bounded in letters; a half that too many words share is cut into blocks, each of
which meets each other one. A pair whose first halves agree counts in the shard of the first half only, so counts are sums.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, pieces, small_batches, written

#: Letters of a shard, on average.
SHARD_LETTERS = 1 << 17
#: Query words that go through an index together, and bits that their sets may have together.
QUERIES, SET_BITS = 64, 1 << 23
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Code points from which on the runs of a text are taken one by one.
LONG_TEXT = 1 << 20
#: Words that a join may broadcast.
MOST_WORDS = 100_000
#: Rounds of pointer jumping; a form is at least twice as frequent, so paths are short.
MOST_ROUNDS = 40
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def altered(doc_id: int | None, run: str, one_in: int) -> str:
    """The run, without one code point where one_in divides the CRC-32 of ``<doc_id>:<run>``; as it is without an id."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def runs(text: str) -> Counter:
    """The runs of letters of a text; those of a long one are never all held at once."""
    return Counter(_RUN.findall(text)) if len(text) < LONG_TEXT else Counter(x[0] for x in _RUN.finditer(text))


def word_counts(docs: DataFrame, one_in: int, least_length: int) -> DataFrame:
    """(word, n): the words of least_length code points and more, with their occurrences in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            ids, at = batch["doc_id"].to_pylist(), 0
            for piece in pieces(batch["text"]):
                for text in piece:
                    # bytes.lower() takes A-Z only.
                    low = text.as_buffer().to_pybytes().lower().decode()
                    for run, n in runs(low).items():
                        word = altered(ids[at], run, one_in)
                        if len(word) >= least_length:
                            seen[word] += n
                    at += 1
                    if len(seen) >= COUNTED:
                        yield handed()
        yield handed()

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index:
    """Bitsets by position and letter over words of n and n + 1 letters."""

    def __init__(self, words: list[str], n: int):
        self.n, self.count = n, len(words)
        self.width = -(-len(words) // 64)
        codes = np.zeros((len(words), n + 1), np.int64)
        lengths = np.array([len(w) for w in words])
        for length in (n, n + 1):
            which = np.flatnonzero(lengths == length)
            if len(which):
                codes[which, :length] = np.frombuffer("".join(words[i] for i in which).encode("utf-32-le"), np.uint32).reshape(-1, length)
        self.letters, places = np.unique(codes, return_inverse=True)  # 0 stands for no letter
        self.codes = places.reshape(codes.shape)
        self.sets = np.zeros((n + 1, len(self.letters), self.width), np.uint64)
        word, bit = np.divmod(np.arange(len(words)), 64)
        for p in range(n + 1):
            np.bitwise_or.at(self.sets[p], (self.codes[:, p], word), np.uint64(1) << bit.astype(np.uint64))
        self.short = self._packed(lengths == n)
        self.long = self._packed(lengths == n + 1)

    def _packed(self, which: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.width * 64, np.uint8)
        padded[: len(which)] = which
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def near(self, queries: np.ndarray, second: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(queries, words, whether the words are longer) of the pairs with one error in the second half and none in the first, or, if not
        second, in the first half and none in the second, except where the first halves agree. queries are places of words of n letters."""
        n, half, sets = self.n, self.n // 2, self.sets
        shape = (len(queries), self.width)
        zero = np.full(shape, ~np.uint64(0))
        replaced, inserted = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        for p in range(n):
            letter = self.codes[queries, p]
            here = sets[p][letter]
            if (p >= half) == second:
                replaced = (replaced & here) | (zero & ~here)
                inserted = (inserted | zero) & sets[p + 1][letter]
                zero = zero & here
            elif second:
                zero = zero & here
            else:
                if p == half:
                    apart = ~zero
                replaced &= here
                inserted &= sets[p + 1][letter]
        if second:
            inserted |= zero
        elif half:
            inserted &= apart
        for found, lengths, longer in ((replaced, self.short, False), (inserted, self.long, True)):
            row, col = np.nonzero(found & lengths)
            if len(row):
                bits = np.unpackbits((found & lengths)[row, col].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, bit = np.nonzero(bits)
                yield queries[row[i]], col[i] * 64 + bit, longer


def shard_links(words: list[str], n: int, second: bool, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs of a shard, each in both directions; with blocks, only those of different blocks."""
    index = Index(words, n)
    short = np.flatnonzero(np.array([len(w) for w in words]) == n)
    step = max(1, min(QUERIES, SET_BITS // (64 * max(1, index.width))))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(short), step):
        for query, word, longer in index.near(short[at : at + step], second):
            if blocks is not None:
                keep = blocks[query] != blocks[word]
                query, word = query[keep], word[keep]
            a += [query, word] if longer else [query]
            b += [word, query] if longer else [word]
    return np.concatenate(a), np.concatenate(b)


def _rank(words: list[str]) -> np.ndarray:
    """The place of each in the order of code points, which Python's strings have."""
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return rank


def _near_in_shard(key: tuple, table: pa.Table) -> pa.Table:
    n, second, _, low, high = (k.as_py() for k in key)
    words, counts = table["word"].to_pylist(), table["n"].to_numpy()
    blocks = None if low == high else table["block"].to_numpy()
    a, b = shard_links(words, n, bool(second), blocks)
    order = np.lexsort((_rank(words)[b], -counts[b], a))
    a, b = a[order], b[order]
    own, first, times = np.unique(a, return_index=True, return_counts=True)
    best = b[first]
    names = pa.array(words, pa.string())
    return pa.table({"word": names.take(pa.array(own)), "n_near": pa.array(times.astype(np.int64)), "best": names.take(pa.array(best)), "best_n": pa.array(counts[best])})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have near ones: how many, and the most frequent (of equals the least)."""
    own = vocabulary.select("word", "n", F.length("word").cast("int").alias("len"))
    based = own.withColumn("base", F.explode(F.array(F.col("len") - 1, F.col("len")))).where("base > 0")
    shards = F.greatest(F.lit(1), F.ceil(F.sum("len") / F.lit(SHARD_LETTERS)).cast("int"))
    based = based.join(F.broadcast(based.groupBy("base").agg(shards.alias("shards"))), "base")
    half = F.floor(F.col("base") / 2).cast("int")
    halves = F.array(F.struct(F.lit(1).alias("second"), F.expr("substring(word, 1, base div 2)").alias("part")), F.struct(F.lit(0).alias("second"), F.substring("word", F.col("len") - F.col("base") + half + 1, F.col("base") - half).alias("part")))
    dealt = based.select("word", "n", "len", "base", "shards", F.explode(halves).alias("_h")).select("word", "n", "len", F.col("base").alias("length"), "_h.second", F.pmod(F.xxhash64("_h.part"), F.col("shards")).cast("int").alias("shard"))
    dealt = written(dealt, "spelling-shards")
    large = dealt.groupBy("length", "second", "shard").agg(F.ceil(F.sum("len") / F.lit(4 * SHARD_LETTERS)).cast("int").alias("blocks")).where("blocks > 1")
    cutup = dealt.join(broadcast_if_small(cut(large), MOST_WORDS), ["length", "second", "shard"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # A block meets each other one, in one task a pair; paired with itself it has a task of its own.
    cutup = cutup.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = cutup.select("word", "n", "length", "second", "shard", "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"))
    found = sides.groupBy("length", "second", "shard", "low", "high").applyInArrow(_near_in_shard, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.w").alias("best"), (-F.col("_b.k")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends, by pointer jumping, which halves what is left of every path."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MOST_ROUNDS):
        onward = broadcast_if_small(now.select(F.col("word").alias("root"), F.col("root").alias("_next")), MOST_WORDS)
        stepped = cut(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = stepped.drop("_moved")
        if stepped.where("_moved").isEmpty():
            return now
    raise RuntimeError(f"forms did not settle in {MOST_ROUNDS} rounds")


def variants(docs: DataFrame, one_in: int = 97, least_length: int = 5, least_n: int = 3, times: int = 2) -> DataFrame:
    """Per word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Words are the runs of letters of all whole texts, A-Z in lower case, with simulated slips (altered()), of at least least_length code points and least_n
    occurrences, n. Two are near if one inserted, deleted or replaced code point tells them apart. A word's form is its most
    frequent near word, of equals the least by code points, if that is at least times as frequent; else form and form_n are null. root is
    where following forms ends, the word itself without a form. times must be above 1. A null text has no words, a null doc_id no slips.
    Rows are counted as they are, repeated ids and texts too; other columns are ignored.
    """
    vocabulary = written(word_counts(docs, one_in, least_length).where(F.col("n") >= least_n), "spelling-words")
    near = vocabulary.join(near_words(vocabulary), "word", "left")
    has = F.col("best_n") >= F.lit(times) * F.col("n")
    formed = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
