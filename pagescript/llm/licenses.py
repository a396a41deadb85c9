"""License scans: a positional index of the rarest words of license templates.

Document frequencies of all template words are counted over all documents. Each template is entered in the index under its rarest
words (highest IDF) with their offsets. In a file, every occurrence of such a word proposes a start, its position less
the offset; starts that enough rare words of one template agree on are candidates, and a candidate counts if each mandatory
phrase stands at its place. Its score is the share of the template's words that stand at their places.

Base phrases are templates of their own that are mandatory as a whole and are entered under their rarest word alone, so every
place where one stands is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

#: What stands between words: ASCII but for digits and small letters; A-Z are lowered first.
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases of the base rules, wordings of well-known licenses and what must stand in them.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses"]),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted", "deal in the software"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", ["no part of this publication"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

#: Words of a template in the index, and the share of them that must agree on a start.
RARE_WORDS = 4
AGREE = 0.5
#: Share of a template's words that must stand at their places.
LEAST = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: (offset, words) of each phrase that must stand.
    mandatory: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool


def templates(base: dict[str, str] = BASE, named: list = TEMPLATES) -> list[Template]:
    out = [Template(label, tuple(text.split()), ((0, tuple(text.split())),), True) for label, text in base.items()]
    for label, text, phrases in named:
        w = text.split()
        must = []
        for phrase in map(str.split, phrases):
            at = next((i for i in range(len(w)) if w[i : i + len(phrase)] == phrase), None)
            if at is None:
                raise ValueError(f"{phrase} is not in {text!r}")
            must.append((at, tuple(phrase)))
        out.append(Template(label, tuple(w), tuple(must), False))
    return out


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, place of each text's first word)."""
    found = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    flat = found.flatten()
    real = pc.not_equal(flat, "")
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), before[found.offsets.to_numpy() - found.offsets[0].as_py()]


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each word of the vocabulary over all documents; what returns to the driver is one row per word."""
    known = pa.array(vocabulary, pa.large_string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for texts in pieces(batch.column(0)):
                flat, first = split(texts)
                term = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                place = np.flatnonzero(term >= 0)
                doc = np.searchsorted(first, place, side="right") - 1
                df += np.bincount(np.unique(doc * len(vocabulary) + term[place]) % len(vocabulary), minlength=len(vocabulary))
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(vocabulary)), -1]), pa.array([*df.tolist(), n])], names=["term", "n"])

    found = {r.term: r.n for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return {w: log((found.get(-1, 0) + 1) / (found.get(i, 0) + 1)) for i, w in enumerate(vocabulary)}


def scan(docs: DataFrame, wanted: list[Template] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    places: (label, start, n_words, share) of all that was found, by start. n_base counts the places of base phrases, first_word and
    last_word are the least and largest of their starts. A null or empty text has no words: counts 0, labels empty, score 0. score
    is the largest share, 1 where a base phrase stands. Whole texts; one pass counts words, one scans; nothing is shuffled but counts.
    """
    wanted = templates() if wanted is None else wanted
    vocabulary = sorted({w for t in wanted for w in t.words})
    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    idf = frequencies(rows, vocabulary)
    number = {w: i for i, w in enumerate(vocabulary)}
    entries = []  # (term, template, offset)
    agree = []
    for t, template in enumerate(wanted):
        rare = sorted(range(len(template.words)), key=lambda i: (-idf[template.words[i]], i))[: 1 if template.base else RARE_WORDS]
        entries += [(number[template.words[i]], t, i) for i in rare]
        agree.append(max(1, int(np.ceil(AGREE * len(rare)))))
    entries.sort()
    return rows.mapInArrow(
        _scanner(wanted, vocabulary, np.array(entries, dtype=np.int64).reshape(-1, 3), np.array(agree)),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,n_words:long,share:double>>",
    )


def _scanner(wanted: list[Template], vocabulary: list[str], entries: np.ndarray, agree: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        number = {w: i for i, w in enumerate(vocabulary)}
        begin = np.searchsorted(entries[:, 0], np.arange(len(vocabulary) + 1))
        wording = [np.array([number[w] for w in t.words]) for t in wanted]
        must = [[(at, np.array([number[w] for w in phrase])) for at, phrase in t.mandatory] for t in wanted]
        margin = max(len(t.words) for t in wanted)
        for batch in batches:
            row = 0
            for texts in pieces(batch.column(1)):
                flat, first = split(texts)
                # A template may begin before a text or end after it: a margin of no words on either side of all.
                bare = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                term = np.concatenate([np.full(margin, -1), bare, np.full(margin, -1)])
                place = np.flatnonzero(bare >= 0)
                times = (begin[1:] - begin[:-1])[bare[place]]
                which = np.repeat(begin[bare[place]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at = np.repeat(place, times)
                doc = np.searchsorted(first, at, side="right") - 1
                template, start = entries[which, 1], at - entries[which, 2]
                span = len(flat) + 2 * margin
                candidate, votes = np.unique(template * span + start + margin, return_counts=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                # Rare words of one start are of one text unless the start is before it; the mandatory phrases settle it.
                template, start = candidate // span, candidate % span - margin
                keep = votes >= agree[template] if len(candidate) else np.zeros(0, bool)
                template, start = template[keep], start[keep]
                hits: dict[int, list] = {}
                for t in np.unique(template).tolist():
                    own = start[template == t]
                    anchor = own + must[t][0][0]
                    inside = (anchor >= 0) & (anchor < len(bare))
                    own, anchor = own[inside], anchor[inside]
                    of = np.searchsorted(first, anchor, side="right") - 1
                    low, high = first[of], first[of + 1]
                    good = np.ones(len(own), dtype=bool)
                    for offset, phrase in must[t]:
                        good &= (own + offset >= low) & (own + offset + len(phrase) <= high)
                        good &= (term[own[:, None] + offset + margin + np.arange(len(phrase))] == phrase).all(axis=1)
                    own, of, low, high = own[good], of[good], low[good], high[good]
                    where = own[:, None] + np.arange(len(wording[t]))
                    share = ((term[where + margin] == wording[t]) & (where >= low[:, None]) & (where < high[:, None])).mean(axis=1)
                    for s, d, x in zip(own.tolist(), of.tolist(), share.tolist(), strict=True):
                        if x >= LEAST:
                            hits.setdefault(d, []).append((s - int(first[d]), t, x))
                out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")}
                for d in range(len(texts)):
                    found = sorted(hits.get(d, ()))
                    base = [(s, t) for s, t, _ in found if wanted[t].base]
                    out["n_base"].append(len(base))
                    out["first_word"].append(base[0][0] if base else None)
                    out["last_word"].append(base[-1][0] if base else None)
                    out["base_labels"].append(",".join(sorted({wanted[t].label for _, t in base})))
                    out["labels"].append(",".join(sorted({wanted[t].label for _, t, _ in found})))
                    out["score"].append(max((x for _, _, x in found), default=0.0))
                    out["places"].append([{"label": wanted[t].label, "start": s, "n_words": len(wanted[t].words), "share": x} for s, t, x in found])
                kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "places": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]))}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(np.diff(first)), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())],
                    names=["doc_id", "n_words", *out],
                )
                row += len(texts)

    return run
