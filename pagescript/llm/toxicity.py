"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text.

A label marks a whole document, and most of a toxic document is ordinary. So what the toxic dictionary is trained on are the spans that set
toxic documents apart: runs of characters whose 5-grams occur in many of them and in hardly any ordinary one, within words
first, then across words in windows that have no such run (phrases of ordinary words). Both dictionaries come from
zstandard's trainer; where there are too few samples to train on, these are the dictionary.

A window is WINDOW words in lower case, every STEP words. Its compressed length with the ordinary dictionary less that with the
toxic one (which follows the ordinary one, so that both know ordinary text equally well) is its gain. Both dictionaries end in a fixed
preamble that stands on either side of each window, so zstandard always finds a match, never falls back to a stored
block, and the difference is due to the window alone. Only windows that have five bytes in a row in common with the toxic
dictionary, the least that a match takes here, are compressed: all others have no gain.

A document's evidence is a sum over its distinct windows: by class of gain, the logarithm of how much more frequent windows of that class are in
toxic documents than in ordinary ones. These weights, and then the map from evidence to probability, are calibrated on labelled
documents that the dictionaries were not made from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, cut, pieces, small_batches

PREAMBLE = b"0123456789QWERTYUIOPASDFGHJKLZXCVBNM9876543210MNBVCXZLKJHGFDSAPOIUYTREWQ"
GRAM = 5
#: Words of a window, and words from one to the next; a word counts with its first WORD_BYTES bytes and, if it is longer, in further pieces.
WINDOW, STEP = 6, 3
WORD_BYTES = 48
#: Bytes that a match in the toxic dictionary has at least.
MATCH = 5
#: Gains from here on are one class, as are those below 1.
MOST_GAIN = 16
#: Whole numbers that evidence is brought to, half of them below 0.
LEVELS = 65
#: Entries of a task's table of gains before it starts anew.
CACHE = 20_000
#: Bytes of text that are worked on at a time.
PIECE = 1 << 18
CUTOFF = 0.7
_NONE, _BLANK = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    #: Logarithm of the likelihood ratio of a window by its gain, from 0 to MOST_GAIN.
    weights: tuple[float, ...]
    #: Probability of label 1 by level of evidence.
    probability: tuple[float, ...]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, place of each text's first word) of all texts: runs of letters and digits in lower case, long ones cut in pieces."""
    found = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+")
    flat = found.flatten()
    times = np.maximum(pc.utf8_length(flat).to_numpy(zero_copy_only=False), 0)
    times = -(-times // WORD_BYTES)  # none for what is empty
    before = np.concatenate(([0], np.cumsum(times)))
    first = before[found.offsets.to_numpy() - found.offsets[0].as_py()]
    if (times > 1).any():
        words = [w[i : i + WORD_BYTES] for w in flat.to_pylist() for i in range(0, len(w), WORD_BYTES)]
        return pa.array(words, pa.large_string()), first
    return flat.filter(pa.array(times > 0)), first


def windows_of(n_words: int) -> range:
    """Where the windows of a text of so many words begin."""
    return range(0, max(1, n_words - WINDOW + STEP), STEP) if n_words else range(0)


def grams(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def within_words(window: str) -> set[str]:
    return {g for w in window.split() for g in grams(f" {w} ")}


def across_words(window: str) -> set[str]:
    return {g for g in grams(window) if " " in g.strip()}


def spans(text: str, telling: set[str]) -> list[str]:
    """The longest runs of a text that telling grams cover."""
    runs, end = [], -1
    for i in range(len(text) - GRAM + 1):
        if text[i : i + GRAM] in telling:
            if i > end:
                runs.append([i, i + GRAM])
            runs[-1][1] = end = i + GRAM
    return [text[a:b] for a, b in runs]


def word_spans(window: str, telling: set[str]) -> list[str]:
    return [run for w in window.split() for run in spans(f" {w} ", telling)]


def phrase_spans(window: str, telling: set[str]) -> list[str]:
    """Runs of words whose neighbours are joined by telling grams."""
    words = window.split()
    runs: list[list[str]] = []
    joined = False
    for a, b in zip(words, words[1:], strict=False):
        if across_words(f" {a} {b} ") & telling:
            if not joined:
                runs.append([a])
            runs[-1].append(b)
            joined = True
        else:
            joined = False
    return [f" {' '.join(run)} " for run in runs]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of zstandard's trainer, an eighth of the samples at most; the samples themselves, frequent ones last, where that is too little to train on."""
    import zstandard

    most = min(size, sum(map(len, samples)) // 8)
    if most >= 512:
        try:
            trained = zstandard.train_dictionary(most, samples, k=24, d=6).as_bytes()
            if len(trained) > most // 2:
                return trained
        except zstandard.ZstdError:
            pass
    counts = Counter(samples)
    return b"".join(sorted(counts, key=lambda s: (counts[s], s)))[-size:]


def _codes(data: np.ndarray) -> np.ndarray:
    """The MATCH bytes from each place as a number."""
    n = max(0, len(data) - MATCH + 1)
    codes = np.zeros(n, dtype=np.uint64)
    for i in range(MATCH):
        codes |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return codes


def _short(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


class Gains:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        params = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
            window_log=16, hash_log=13, chain_log=13, search_log=4, min_match=MATCH, target_length=16, strategy=zstandard.STRATEGY_LAZY,
        )

        def compressor(content: bytes):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(dict_data=made, compression_params=params)

        self.toxic, self.ordinary = compressor(ordinary + b"\n" + toxic + b"\n" + PREAMBLE), compressor(ordinary + b"\n" + PREAMBLE)
        own = np.frombuffer(toxic, np.uint8)
        self.parts = np.unique(_codes(own))
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[_short(self.parts)] = True
        self.known: dict[str, int] = {}

    def matches(self, data: np.ndarray) -> np.ndarray:
        """Where MATCH bytes begin that the toxic dictionary has."""
        codes = _codes(data)
        at = np.flatnonzero(self.maybe[_short(codes)])
        return at[np.isin(codes[at], self.parts)]

    def __call__(self, window: str) -> int:
        gain = self.known.get(window)
        if gain is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            data = PREAMBLE + window.encode() + PREAMBLE
            gain = self.known[window] = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
        return gain

    def of_texts(self, texts: pa.Array) -> list[tuple[int, list[int]]]:
        """Per text the number of its windows, and the gains of those distinct ones that have a gain."""
        words, first = split(texts)
        counts = [len(windows_of(n)) for n in np.diff(first).tolist()]
        out: list[tuple[int, list[int]]] = [(n, []) for n in counts]
        if not len(words):
            return out
        starts = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1)  # of the words after the first, in all words with blanks between
        at = self.matches(np.concatenate((np.array([32], np.uint8), buffers(pc.binary_join_element_wise(words, _NONE, _BLANK))[0])))
        word = np.unique(np.minimum(np.concatenate([np.searchsorted(starts, at + i, side="right") for i in (0, MATCH - 1)]), len(words) - 1))
        row = np.searchsorted(first, word, side="right") - 1
        last = np.minimum((word - first[row]) // STEP, np.array(counts)[row] - 1)
        begin = np.unique(np.concatenate([first[row] + np.maximum(last - back, 0) * STEP for back in range(-(-WINDOW // STEP))]))
        row = np.searchsorted(first, begin, side="right") - 1
        columns = [words.take(pa.array(begin + i, mask=begin + i >= first[row + 1])) for i in range(WINDOW)]
        # As windows are written everywhere: a blank before, between and after words.
        found = pc.binary_join_element_wise(_NONE, *columns, _NONE, _BLANK, null_handling="skip").dictionary_encode()
        gain = np.array([self(w) for w in found.dictionary.to_pylist()], dtype=np.int64)
        code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        once = np.unique(row * len(gain) + code) if len(gain) else np.zeros(0, np.int64)
        once = once[gain[once % len(gain)] > 0] if len(gain) else once
        for r, g in zip((once // max(1, len(gain))).tolist(), gain[once % max(1, len(gain))].tolist(), strict=True):
            out[r][1].append(g)
        return out


def classes(n_windows: int, gains: list[int]) -> list[int]:
    """How many windows of each class of gain."""
    out = [0] * (MOST_GAIN + 1)
    for g in gains:
        out[min(g, MOST_GAIN)] += 1
    out[0] = n_windows - len(gains)
    return out


def level(n_windows: int, gains: list[int], weights: tuple[float, ...]) -> int:
    evidence = sum(n * w for n, w in zip(classes(n_windows, gains), weights, strict=True))
    return int(min(max(round(evidence) + LEVELS // 2, 0), LEVELS - 1))


def log_ratios(scored: list[tuple[int, list[int], int]]) -> tuple[float, ...]:
    """Weights of the classes from (windows, gains, label); never less for a higher gain."""
    counts = {y: [sum(x) for x in zip([0] * (MOST_GAIN + 1), *(classes(n, g) for n, g, label in scored if label == y), strict=True)] for y in (0, 1)}
    share = {y: [(c + 0.5) / (sum(counts[y]) + 0.5 * len(counts[y])) for c in counts[y]] for y in (0, 1)}
    found = [log(t / o) for t, o in zip(share[1], share[0], strict=True)]
    return tuple(max(found[: i + 1]) for i in range(len(found)))


def rising(pairs: list[tuple[int, int]], prior_weight: float = 1.0) -> tuple[float, ...]:
    """Share of label 1 by level of evidence, made monotone by pooling neighbours that violate the order."""
    rate = sum(y for _, y in pairs) / max(1, len(pairs))
    blocks: list[list[float]] = []
    for e in range(LEVELS):
        ys = [y for x, y in pairs if x == e]
        blocks.append([float(sum(ys)), float(len(ys)), 1])
        while len(blocks) > 1 and (blocks[-1][1] == 0 or blocks[-2][1] == 0 or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            hits, n, width = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hits, blocks[-1][1] + n, blocks[-1][2] + width]
    return tuple((hits + prior_weight * rate) / (n + prior_weight) for hits, n, width in blocks for _ in range(int(width)))


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int, most_windows: int) -> DataFrame:
    """(at, toxic, part, windows) of labelled documents: at most so many of each label, of each at most most_windows windows, by hash.

    part 0 is for calibration, 1 and 2 are for the dictionaries.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", (F.col("toxic") == 1).alias("toxic"), order.alias("at"))
    ids = known.where("toxic").orderBy("at", "doc_id").limit(toxic_rows).unionAll(known.where("NOT toxic").orderBy("at", "doc_id").limit(ordinary_rows))

    @F.arrow_udf("array<string>")
    def chosen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zlib

        for batch in batches:
            out = []
            for texts in pieces(batch, PIECE):
                words, first = split(texts)
                for r in range(len(texts)):
                    a, z = int(first[r]), int(first[r + 1])
                    starts = windows_of(z - a)
                    if len(starts) > most_windows:
                        starts = sorted(sorted(starts, key=lambda i: zlib.crc32(i.to_bytes(8, "little")))[:most_windows])
                    out.append([f" {' '.join(words.slice(a + i, min(WINDOW, z - a - i)).to_pylist())} " for i in starts])
            yield pa.array(out, pa.list_(pa.string()))

    picked = docs.join(F.broadcast(ids), "doc_id").select("at", "toxic", F.pmod(F.hash("at"), F.lit(3)).alias("part"), chosen("text").alias("windows"))
    return cut(picked)


def telling_grams(rows: DataFrame, of_window, support: float, lift: float) -> set[str]:
    """Grams in a share of support of the toxic documents or more, lift times the share of ordinary ones."""

    def counts(docs: DataFrame, wanted: frozenset | None) -> DataFrame:
        @F.arrow_udf("array<string>")
        def distinct(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = [set().union(*map(of_window, windows or [])) for windows in batch.to_pylist()]
                yield pa.array([list(x if wanted is None else x & wanted) for x in found], pa.list_(pa.string()))

        return docs.select(F.explode(distinct("windows")).alias("gram")).groupBy("gram").count()

    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    frequent = {r.gram: r["count"] for r in counts(rows.where("toxic"), None).where(F.col("count") >= max(3.0, support * n.get(True, 0))).collect()}
    ordinary = {r.gram: r["count"] for r in counts(rows.where("NOT toxic"), frozenset(frequent)).collect()}
    return {g for g, t in frequent.items() if t / max(1, n.get(True, 0)) > lift * (ordinary.get(g, 0) + 0.5) / max(1, n.get(False, 0))}


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2000, ordinary_rows: int = 3000, most_windows: int = 256, support: float = 0.02, lift: float = 30.0, dictionary_bytes: int = 8192) -> Model:
    """Fit on a bounded sample: at most toxic_rows and ordinary_rows labelled documents (those of least hash), of each at most most_windows windows.

    labels: (doc_id, toxic). The sample of ids is drawn from labels alone and is so small that it can be broadcast; texts are
    never shuffled. support: share of toxic documents that must have a gram; lift: times its share in ordinary ones. Two thirds of the
    sample make the dictionaries, one third calibrates. Null labels and texts count for nothing, repeated rows as often as they are there;
    without documents of both labels every text gets the share of label 1 (0 if there is none).
    """
    rows = sample(small_batches(docs), labels, toxic_rows, ordinary_rows, most_windows)
    make, hold = rows.where("part > 0"), rows.where("part = 0")
    if make.select("toxic").distinct().count() < 2:
        share = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
        return Model(b"", PREAMBLE, (0.0,) * (MOST_GAIN + 1), (share,) * LEVELS)
    words = telling_grams(make, within_words, support, lift)

    @F.arrow_udf("array<string>")
    def unexplained(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[w for w in windows or [] if not within_words(w) & words] for windows in batch.to_pylist()], pa.list_(pa.string()))

    phrases = telling_grams(make.withColumn("windows", unexplained("windows")), across_words, support, lift)

    @F.arrow_udf("array<string>")
    def samples(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[s for w in windows or [] for s in word_spans(w, words) or phrase_spans(w, phrases)] for windows in batch.to_pylist()], pa.list_(pa.string()))

    found = make.where("toxic").select(F.explode(samples("windows")).alias("s")).groupBy("s").count().collect()
    # Words vary in their endings, phrases don't: one that hardly recurs is made of what happens to stand beside a telling pair.
    often = max(3.0, support * make.where("toxic").count() / 2)
    toxic = dictionary([r.s.encode() for r in sorted(found) if " " not in r.s.strip() or r["count"] >= often for _ in range(r["count"])], dictionary_bytes)
    # Of ordinary text an eighth of the windows is enough to train on.
    eighth = F.filter("windows", lambda w: F.crc32(w.cast("binary")) % 8 == 0)
    ordinary = dictionary(sorted(r.s.encode() for r in make.where("NOT toxic").select(F.explode(eighth).alias("s")).collect()), dictionary_bytes)

    @F.arrow_udf("array<int>")
    def gains(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gain = Gains(toxic, ordinary)
        for batch in batches:
            yield pa.array([sorted(g for w in set(windows or []) if len(gain.matches(np.frombuffer(w.encode(), np.uint8))) and (g := gain(w)) > 0) for windows in batch.to_pylist()], pa.list_(pa.int32()))

    scored = [(r.n, list(r.g), int(r.toxic)) for r in hold.select(F.size("windows").alias("n"), gains("windows").alias("g"), "toxic").where("n >= 0").collect()]
    weights = log_ratios(scored)
    return Model(toxic, ordinary, weights, rising([(level(n, g, weights), y) for n, g, y in scored]))


def scorer(model: Model):
    """An Arrow function text -> probability of label 1. Whole texts; a null or empty text has no window, so no evidence."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gain = Gains(model.toxic, model.ordinary)
        for batch in batches:
            out = [model.probability[level(n, gains, model.weights)] for texts in pieces(batch, PIECE) for n, gains in gain.of_texts(texts)]
            yield pa.array(out, pa.float64())

    return score


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from; the rest is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs + toxicity (0 to 1), in place of a column of that name. Labels, language, source and ids are no input; equal texts score equally."""
    return small_batches(docs).withColumn("toxicity", scorer(model)(F.col("text")))
