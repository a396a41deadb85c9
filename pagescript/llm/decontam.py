"""Benchmark decontamination: a BM25 index of test items, queried with every passage of every document.

Items are cut in parts of at most PART words; the inverted index holds, per term, the parts that have it with their BM25
impact as a share of the part's own score, in blocks with the largest impact of each. A score is then the share of the part that
the passage has, and one threshold fits all parts. Passages are windows of two parts' length every part's length, so
any run of PART words lies in one.

Whole batches of passages are first held against an upper bound: the impacts of a part's strong terms in the passage plus all of
its weak ones. Passages below the threshold for every part cannot be hits, the rest go through block-max WAND, which returns all
parts that reach it. For each hit the item's question and answer are looked for in the passage and its surroundings as word n-grams.

The index is a broadcast of bounded size: a benchmark of more than MOST_CHARS characters is searched in several passes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

PART = 64
BLOCK = 32
K1, B = 1.2, 0.75
THRESHOLD = 0.5
#: Characters of items in one index.
MOST_CHARS = 8 << 20
#: Length of the word n-grams of the check.
GRAM = 5
BREAK = r"[^\p{L}\p{N}]+"
WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_and_answer(items: DataFrame) -> DataFrame:
    """(item_id, question, answer) of items with one text: the last sentence answers what stands before it.

    A text of one sentence is a question without an answer. Null texts have neither.
    """
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    cut_at = F.regexp_extract(text, r"(?s)^(.*[.!?])\s+(\S.*)$", 1)
    answer = F.regexp_extract(text, r"(?s)^(.*[.!?])\s+(\S.*)$", 2)
    return items.select("item_id", F.when(cut_at == "", text).otherwise(cut_at).alias("question"), answer.alias("answer"))


@dataclass(frozen=True)
class Index:
    terms: list[str]
    #: Per term: parts in rising order, their impacts, and the largest impact of each block of them.
    parts: list[np.ndarray]
    impacts: list[np.ndarray]
    block_max: list[np.ndarray]
    #: Per part its item's number, per item its id and the word n-grams of question and answer.
    item_of: list[int]
    ids: list[int | None]
    grams: list[tuple[frozenset, frozenset]]


def n_grams(found: list[str], n: int = GRAM) -> frozenset:
    n = min(n, len(found))
    return frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1)) if n else frozenset()


def build(items: list[tuple[int | None, str, str]]) -> Index:
    """Items are told apart by their place in the list: those that share an id are all in the index."""
    cut, grams = [], []
    for item, (_, question, answer) in enumerate(items):
        q, a = words(question), words(answer)
        both = q + a
        grams.append((n_grams(q), n_grams(a)))
        if both:
            count = -(-len(both) // PART)
            cut += [(item, both[len(both) * i // count : len(both) * (i + 1) // count]) for i in range(count)]
    df = Counter(t for _, part in cut for t in set(part))
    mean = sum(len(part) for _, part in cut) / max(1, len(cut))
    postings: dict[str, list] = defaultdict(list)
    for number, (_, part) in enumerate(cut):
        norm = K1 * (1 - B + B * len(part) / mean)
        impact = {t: log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(part).items()}
        own = sum(impact.values())
        for t, x in impact.items():
            postings[t].append((number, x / own))
    terms = sorted(postings)
    parts = [np.array([p for p, _ in postings[t]]) for t in terms]
    impacts = [np.array([x for _, x in postings[t]]) for t in terms]
    return Index(terms, parts, impacts, [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in impacts], [item for item, _ in cut], [item for item, *_ in items], grams)


def block_max_wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All (part, score) whose score reaches the threshold."""
    found = []
    cursors = [[t, 0, index.parts[t].tolist(), float(index.block_max[t].max())] for t in query]
    while cursors:
        cursors.sort(key=lambda c: c[2][c[1]])
        bound, pivot = 0.0, None
        for i, c in enumerate(cursors):
            bound += c[3]
            if bound >= threshold:
                pivot = i
                break
        if pivot is None:
            break
        part = cursors[pivot][2][cursors[pivot][1]]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][2][cursors[pivot + 1][1]] == part:
            pivot += 1
        best, ends = 0.0, []
        for c in cursors[: pivot + 1]:
            block = bisect_left(c[2], part, c[1]) // BLOCK
            if block < len(index.block_max[c[0]]):
                best += float(index.block_max[c[0]][block])
                ends.append(c[2][min((block + 1) * BLOCK, len(c[2])) - 1] + 1)
        if best < threshold:
            # No part before the first end of a block, or before the next cursor, can reach the threshold.
            target = min([*ends, *(c[2][c[1]] for c in cursors[pivot + 1 : pivot + 2])], default=part + 1)
            target = max(target, part + 1)
        elif cursors[0][2][cursors[0][1]] == part:
            score = sum(float(index.impacts[c[0]][c[1]]) for c in cursors[: pivot + 1])
            if score >= threshold:
                found.append((part, score))
            target = part + 1
        else:
            target = part
        for c in cursors[: pivot + 1]:
            c[1] = bisect_left(c[2], target, c[1])
        cursors = [c for c in cursors if c[1] < len(c[2])]
    return found


def essential(index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings without each part's weakest terms, and the weakest terms' sum per part: (parts, impacts, postings per term, sums).

    The weakest terms of a part together stay below half the threshold, so no part reaches it by them alone, and the
    impacts that are left plus that sum bound the part's score from above.
    """
    df = np.array([len(x) for x in index.parts])
    term, part, impact = np.repeat(np.arange(len(df)), df), np.concatenate(index.parts), np.concatenate(index.impacts)
    order = np.lexsort((impact, part))
    first = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
    sums = np.cumsum(impact[order])
    start = np.repeat(sums[first] - impact[order][first], np.diff(np.append(first, len(order))))
    weak = np.zeros(len(part), dtype=bool)
    weak[order] = sums - start < threshold / 2
    rest = np.bincount(part, weights=np.where(weak, impact, 0), minlength=len(index.item_of))
    return part[~weak], impact[~weak], np.bincount(term[~weak], minlength=len(df)), rest


def leaked(question_overlap: float, answer_overlap: float) -> bool:
    return question_overlap >= 0.8 or (question_overlap >= 0.5 and answer_overlap >= 0.5)


def searcher(index: Index, threshold: float):
    """An Arrow map (doc_id, text) -> one row for each document and item found in it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(index.terms, pa.large_string())
        largest = np.array([x.max() for x in index.impacts])
        parts, impacts, df, rest = essential(index, threshold)
        begin = np.cumsum(df) - df
        count = len(index.terms)
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(1), 1 << 18):
                split = pc.split_pattern_regex(pc.utf8_lower(texts), BREAK)
                flat = split.flatten()
                ends = split.offsets.to_numpy() - split.offsets[0].as_py()
                real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                term = pc.index_in(flat, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
                before = np.concatenate(([0], np.cumsum(real)))
                doc_first = before[ends]  # place of each document's first word among all words
                place = np.flatnonzero(real)
                term = term[place]
                doc = np.searchsorted(doc_first, np.arange(len(place)), side="right") - 1
                step = (np.arange(len(place)) - doc_first[doc]) // PART
                per_doc = (np.diff(doc_first) + PART - 1) // PART
                window_first = np.concatenate(([0], np.cumsum(per_doc)))
                known = term >= 0
                own = (window_first[doc] + step)[known]
                earlier = step[known] > 0
                pairs = np.unique(np.concatenate([own * count + term[known], (own[earlier] - 1) * count + term[known][earlier]]))
                window, t = pairs // count, pairs % count
                total = int(window_first[-1])
                reach = np.bincount(window, weights=largest[t], minlength=total) >= threshold
                keep = reach[window]
                window, t = window[keep], t[keep]
                times = df[t]
                where = np.repeat(begin[t], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pair, inverse = np.unique(np.repeat(window, times) * len(index.item_of) + parts[where], return_inverse=True)
                bound = np.bincount(inverse, weights=impacts[where], minlength=len(pair)) + rest[pair % len(index.item_of)]
                hot = np.unique(pair[bound >= threshold - 1e-9] // len(index.item_of))
                found: dict[tuple[int, int], list] = {}
                for w in hot.tolist():
                    query = t[np.searchsorted(window, w) : np.searchsorted(window, w, side="right")].tolist()
                    hits = block_max_wand(index, query, threshold)
                    if not hits:
                        continue
                    d = int(np.searchsorted(window_first, w, side="right")) - 1
                    for item, score in {index.item_of[p]: s for p, s in sorted(hits, key=lambda x: x[1])}.items():
                        question, answer = index.grams[item]
                        margin = len(question) + len(answer) + 2 * GRAM
                        first = doc_first[d] + (w - window_first[d]) * PART
                        a, z = max(doc_first[d], first - margin), min(doc_first[d + 1], first + 2 * PART + margin)
                        near = flat.take(pa.array(place[a:z])).to_pylist()
                        shares = []
                        for side in (question, answer):
                            n = len(next(iter(side))) if side else 0
                            shares.append(len(side & {tuple(near[i : i + n]) for i in range(len(near) - n + 1)}) / len(side) if side else None)
                        if leaked(shares[0] or 0.0, shares[1] or 0.0):
                            best = found.setdefault((d, index.ids[item]), [0.0, 0.0, None])
                            found[d, index.ids[item]] = [max(best[0], score), max(best[1], shares[0] or 0.0), best[2] if shares[1] is None else max(best[2] or 0.0, shares[1])]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(at, len(texts)).take(pa.array([d for d, _ in found])),
                            pa.array([item for _, item in found], pa.int64()),
                            *(pa.array([x[i] for x in found.values()], pa.float64()) for i in range(3)),
                        ],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )
                at += len(texts)

    return search


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each document and each item that leaked into it.

    docs: (doc_id, text); items: (item_id, question, answer). score is the largest share of a part's BM25 mass in a passage of the
    document. Null and empty texts have no passages; items without words can't leak. answer_overlap is null
    where there is no answer. Documents that share an id, and rows without one, are reported row by row. Items that share an id are
    all looked for, and what is found of any counts for that id, the largest values of each kind; equal items count once. Items
    without an id are looked for likewise, under the id null. Whole texts of any length; columns besides the named ones play no part.
    """
    kept = items.select(F.col("item_id").cast("long"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    chars = kept.agg(F.sum(F.length("question") + F.length("answer"))).first()[0] or 0
    passes = chars // MOST_CHARS + 1
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    out = None
    for i in range(passes):
        chunk = kept.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        index = build(sorted({(r.item_id, r.question, r.answer) for r in chunk.collect()}, key=lambda x: (x[0] is None, x[0] or 0, *x[1:])))
        if not index.terms:
            continue
        found = rows.mapInArrow(searcher(index, threshold), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    return out
