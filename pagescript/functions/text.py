"""Text: normal forms, tokens, error rates and similarity ratios as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Quotes, dashes and the minus sign in plain form; the oracle form knows no minus sign.
FANCY, PLAIN = "‘’“”–—−", "''\"\"---"
ORACLE_FANCY, ORACLE_PLAIN = "’‘“”—–", "''\"\"--"
ASCII = r"^[ -~\s]*$"
#: White space in any alphabet, and the separators of files to units.
SPACE = r"[\s\p{Z}\x1C-\x1F\x85]"


def plain(text: Column) -> Column:
    """Upper case, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.upper(text), r"\s+", " "))


def oracle(text: Column) -> Column:
    """Upper case, plain punctuation, and a blank for all but A-Z, 0-9 and '!?.,:;()-\" ."""
    mapped = F.replace(F.translate(F.upper(text), ORACLE_FANCY, ORACLE_PLAIN), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(mapped, r"[^A-Z0-9'!?.,:;()\-\"]+", " "))


def _tidy(text: Column) -> Column:
    dots = F.regexp_replace(text, r"\.{3,}", "...")
    blanks = F.trim(F.regexp_replace(dots, f"{SPACE}+", " "))
    return F.regexp_replace(F.regexp_replace(blanks, r" +([.,!?;:%)\]}])", "$1"), r"([(\[{]) +", "$1")


def folded(text: str) -> str:
    """Compatibility forms, plain quotes and dashes, folded case, no format characters."""
    text = unicodedata.normalize("NFKC", text).translate(str.maketrans(FANCY, PLAIN)).replace("…", "...").casefold()
    return "".join(ch for ch in text if unicodedata.category(ch) != "Cf")


def _folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if text is None else folded(text) for text in batch.to_pylist()], pa.string())


def scorer(text: Column) -> Column:
    """The form that transcripts are scored in: compatibility forms, plain quotes and dashes, three dots for more of them, folded case, tidy spaces.

    Text of ASCII alone is lowered by Spark; only the rest goes through Python.
    """
    return _tidy(F.when(text.rlike(ASCII), F.lower(text)).otherwise(F.arrow_udf(_folded, "string")(text)))


def tokens(text: Column) -> Column:
    """Words, with apostrophes and hyphens inside, and single marks; low lines are neither."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:['\-][\p{L}\p{N}]+)*|[^\s\p{Z}_\p{L}\p{N}]"), F.lit(0))


def char_error_rate(truth: Column, found: Column) -> Column:
    distance = F.when(truth == found, 0).otherwise(F.levenshtein(truth, found))
    return F.when(F.length(truth) == 0, F.when(F.length(found) == 0, 0.0).otherwise(1.0)).otherwise(distance / F.length(truth))


def spots(text: str) -> dict[str, int]:
    """Where each character of a text stands, a bit a place."""
    if len(text) <= 64:
        found: dict[str, int] = {}
        for i, ch in enumerate(text):
            found[ch] = found.get(ch, 0) | 1 << i
        return found
    bits: dict[str, bytearray] = {}
    for i, ch in enumerate(text):
        if ch not in bits:
            bits[ch] = bytearray((len(text) >> 3) + 1)
        bits[ch][i >> 3] |= 1 << (i & 7)
    return {ch: int.from_bytes(of, "little") for ch, of in bits.items()}


def edits_from(at: dict[str, int], size: int, a: str) -> int:
    """edits() to a text of that size, given as its spots(). A column of the table is two whole numbers of a bit a row, so it is worked out at once."""
    if not size:
        return len(a)
    every, last = (1 << size) - 1, 1 << (size - 1)
    up, down, found = every, 0, size
    for ch in a:
        same = at.get(ch, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = down | (every & ~(diagonal | up))
        left = diagonal & up
        if right & last:
            found += 1
        elif left & last:
            found -= 1
        right = (right << 1 | 1) & every
        up = (left << 1 & every) | (every & ~(diagonal | right))
        down = right & diagonal
    return found


def edits(a: str, b: str) -> int:
    """The least number of characters to insert, delete or replace."""
    return 0 if a == b else edits_from(spots(b), len(b), a)


def _edit_distances(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        yield pa.array([None if x is None or y is None else edits(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """levenshtein() for texts of any length: 64 characters and more are compared at once."""
    return F.arrow_udf(_edit_distances, "int")(a, b)


def word_edits(a: list[str], b: list[str]) -> int:
    """The least number of words to insert, delete or replace. A row of the table is worked out at once: what is inserted is a running minimum."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) for words in (a, b))
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    x, y = x[head:], y[head:]
    while len(x) and len(y) and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if len(x) < len(y):
        x, y = y, x
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, word in enumerate(x, 1):
        best = np.empty_like(row)
        best[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (y != word), out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
    return int(row[-1])


def _word_rates(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if x is None or y is None:
                out.append(None)
            elif x == "":
                out.append(0.0 if y == "" else 1.0)
            else:
                words = x.split(" ")
                out.append(word_edits(words, y.split(" ")) / len(words))
        yield pa.array(out, pa.float64())


def word_error_rate(truth: Column, found: Column) -> Column:
    """Edits between word lists per true word, for texts of any number of different words; null where either is null."""
    return F.arrow_udf(_word_rates, "double")(truth, found)


def punctuation_error(truth: Column, found: Column) -> Column:
    """The marks of the two texts, letters, digits and blanks taken out, differ."""
    marks = lambda t: F.regexp_replace(F.upper(t), r"[\p{L}\p{N}\s\p{Z}]", "")
    return marks(truth) != marks(found)


def text_flags(truth: Column, found: Column, lines: Column, fragments: Column, orientation: Column) -> dict[str, Column]:
    """exact_match, empty_output, punctuation_error, multi_line, multi_fragment, stylized (vertical, or six lines and more)."""
    return {
        "exact_match": plain(truth) == plain(found),
        "empty_output": plain(found) == "",
        "punctuation_error": punctuation_error(truth, found),
        "multi_line": F.coalesce(lines, F.lit(1)) > 1,
        "multi_fragment": F.coalesce(fragments, F.lit(0)) > 1,
        "stylized": (F.coalesce(orientation, F.lit("")) == "vertical") | (F.coalesce(lines, F.lit(1)) >= 6),
    }


@lru_cache(64)
def _blocks_ratio(x: str, y: str) -> float:
    # Equal texts match as one block, whatever their letters: the longest run that is looked for lies first on the diagonal.
    return 1.0 if x == y else SequenceMatcher(None, x, y).ratio()


#: Characters of texts that are compared in bulk: places of the other text are bits of a word. Pairs that are compared at once, and the heights that parts of them are sorted into.
MOST_PLACES, AT_ONCE, HEIGHTS = 64, 2048, (4, 16, 32, 64)
_ONES, _NONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)


def _places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of texts as numbers, a row each, zeros behind them, and the texts' lengths."""
    size, marks = np.array([len(t) for t in texts]), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(texts), MOST_PLACES), np.uint16 if marks.max(initial=0) < 1 << 16 else np.uint32)
    out[np.arange(MOST_PLACES) < size[:, None]] = marks
    return out, size


def _first_bit(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count((words & (~words + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def _first_row(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((words != 0).T).argmax(axis=1)


def _longest_runs(room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size, i, j, i, j) of the longest diagonal of ones in each column of room[0], the first by i, then by j, and the first by j, then by i.

    room: tables of a word a row, j is the bit; the first holds the ones, the others are worked in, as fresh memory costs more than the steps. powers
    hold where diagonals of 1, 2, 4 and more begin; the greatest length is put together from them.
    """
    m, powers, alive = 1, [room[0]], np.bitwise_or.reduce(room[0], axis=0)
    while 2 * m <= room.shape[1]:
        last, twice = powers[-1], room[len(powers)]
        np.right_shift(last[m:], np.uint64(m), out=twice[:-m])
        twice[:-m] &= last[:-m]
        twice[-m:] = 0
        some = np.bitwise_or.reduce(twice, axis=0)
        if not some.any():
            break
        powers.append(twice)
        alive = some
        m *= 2
    begin, more, size = powers[-1], room[-1], m * (alive != 0)
    for longer in powers[-2::-1]:
        m //= 2
        np.right_shift(begin[m:], np.uint64(m), out=more[:-m])
        more[-m:] = 0
        more |= np.where(size == 0, _ONES, _NONE)  # nothing needs to follow yet
        more &= longer
        found = np.bitwise_or.reduce(more, axis=0) != 0
        more ^= begin
        more &= np.where(found, _ONES, _NONE)
        begin ^= more
        size += m * found
    i, j = _first_row(begin), _first_bit(np.bitwise_or.reduce(begin, axis=0))
    np.bitwise_and(begin, np.uint64(1) << j.astype(np.uint64), out=more)
    return size, i, _first_bit(begin[i, np.arange(len(i))]), _first_row(more), j


def matching_characters(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair of texts of at most MOST_PLACES, and of the pair turned round: a row each.

    As SequenceMatcher finds them: the longest block, then what is before and behind it. All parts of all pairs take a step at once, and a part counts
    for both orders until equal blocks set them apart.
    """
    n = len(left)
    marks, size = _places([*left, *right])
    table = np.zeros((n, 2 * MOST_PLACES), np.uint64)
    for at in range(0, n, 256):
        same = marks[:n][at : at + 256, :, None] == marks[n:][at : at + 256, None, :]
        table[at : at + 256, :MOST_PLACES] = np.packbits(same, axis=2, bitorder="little").view("<u8")[:, :, 0]
    total, zero = np.zeros((2, n), np.int64), np.zeros(n, np.int64)
    words = np.empty(8 * n * MOST_PLACES, np.uint64)
    parts = np.stack([np.arange(n), zero, size[:n], zero, size[n:], zero + 3])  # 1: this order, 2: the other, 3: both
    while parts.shape[1]:
        height, low, after = parts[2] - parts[1], 0, [parts[:, :0]]
        for high in HEIGHTS:
            pair, top, bottom, first, last, order = parts[:, (height > low) & (height <= high)]
            low = high
            if not len(pair):
                continue
            if words.size < 8 * high * len(pair):
                words = np.empty(8 * high * len(pair), np.uint64)
            room = words[: 8 * high * len(pair)].reshape(8, high, len(pair))
            rows = np.arange(high)[:, None]
            np.take(table, rows + (pair * (2 * MOST_PLACES) + top), out=room[0], mode="clip")
            room[0] >>= first.astype(np.uint64)
            room[0] &= np.where(rows < bottom - top, _ONES >> (MOST_PLACES - (last - first)).astype(np.uint64), _NONE)
            k, i, j, other_i, other_j = _longest_runs(room)
            for x in (0, 1):
                np.add.at(total[x], pair, k * (order >> x & 1))
            alike = (i == other_i) & (j == other_j)
            for y, x, of in ((i, j, np.where(alike, order, order & 1)), (other_i, other_j, np.where(alike, 0, order & 2))):
                y, x, some = y + top, x + first, (k > 0) & (of > 0)
                after += [f[:, some] for f in (np.stack([pair, top, y, first, x, of]), np.stack([pair, y + k, bottom, x + k, last, of]))]
        parts = np.concatenate(after, axis=1)
        parts = parts[:, (parts[1] < parts[2]) & (parts[3] < parts[4])]
    return total


def blocks_ratios(forms: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """_blocks_ratio() of pairs of texts, by their places in forms, and of the pairs turned round: a row each. Short texts are compared in bulk, others one by one."""
    size = np.array([len(t) for t in forms])
    out, short = np.ones((2, len(left))), np.maximum(size[left], size[right]) <= MOST_PLACES
    for at in np.flatnonzero(~short & (left != right)):
        x, y = forms[left[at]], forms[right[at]]
        out[:, at] = _blocks_ratio(x, y), _blocks_ratio(y, x)
    some = np.flatnonzero(short & (left != right))
    for begin in range(0, len(some), AT_ONCE):
        at = some[begin : begin + AT_ONCE]
        out[:, at] = 2.0 * matching_characters([forms[i] for i in left[at]], [forms[i] for i in right[at]]) / (size[left[at]] + size[right[at]])
    return out


def _match_ratios(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        # Each text of a batch takes its form once, each two forms are compared once.
        coded = pa.chunked_array([a, b]).dictionary_encode(null_encoding="encode").combine_chunks()
        number: dict[str, int] = {}
        of = np.array([number.setdefault(" ".join((t or "").lower().split()), len(number)) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        x, y = np.split(of[coded.indices.to_numpy()], 2)
        once, back = np.unique(np.minimum(x, y) * max(len(number), 1) + np.maximum(x, y), return_inverse=True)
        found, turned = blocks_ratios(list(number), *np.divmod(once, max(len(number), 1))), (x > y).astype(np.int64)
        yield pa.StructArray.from_arrays([pa.array(found[turned, back]), pa.array(found[1 - turned, back])], ["ratio", "turned"])


def _fuzzy_ratios(left: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in left:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            x, y = x or "", y or ""
            row = np.zeros(len(y) + 1, dtype=np.int64)
            other = np.array([ord(ch) for ch in y], dtype=np.int64)
            for ch in x:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(other == ord(ch), row[:-1] + 1, 0)))
            out.append(100.0 if not x and not y else 200.0 * float(row[-1]) / (len(x) + len(y)))
        yield pa.array(out, pa.float64())


def match_ratios(a: Column | str, b: Column | str) -> Column:
    """Share of two texts in matching blocks, the longest first, and that of the two turned round, as it is not symmetric: (ratio, turned). Lower case, single blanks."""
    return F.arrow_udf(_match_ratios, "ratio double, turned double")(a, b)


def fuzzy_ratio(a: Column | str, b: Column | str) -> Column:
    """100 * 2 * (longest common subsequence) / (both lengths); 100 for two empty texts."""
    return F.arrow_udf(_fuzzy_ratios, "double")(a, b)


_SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def strip(text: Column) -> Column:
    """text without white space of any kind at either end; trim() takes blanks only."""
    return F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def blank(text: Column) -> Column:
    """Whether there is nothing but white space of any kind; a null is blank."""
    return F.coalesce(strip(text), F.lit("")) == ""
