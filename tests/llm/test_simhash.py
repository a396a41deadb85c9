"""SimHash groups against fingerprints and distances pair by pair."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagescript.llm import simhash

DOC = "doc_id long, text string"


def fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] if words else []
    bits = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def components(prints):
    """The component of each, by all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def expected(rows):
    prints = [fingerprint(t) for _, t in rows]
    part = components(prints)
    least = {}
    for (d, _), p in zip(rows, part, strict=True):
        if d is not None:
            least[p] = min(d, least.get(p, d))
    return sorted(((d, f, least.get(p)) for (d, _), f, p in zip(rows, prints, part, strict=True)), key=str)


def collected(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))) for _ in range(80)]
    base = [f"k{rng.randrange(5000)}" for _ in range(400)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [None, "", " \t\r\n", "one", "one two", "ONE Two", "a b c", "A\tb\n\x0bC ", "ä ö Ü É", "x " * 5000, "long" * 9000, texts[3], texts[3].upper(), " " + texts[5] + "\n"]
    found = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    return found + [(None, texts[0]), (None, "only without an id"), (3, texts[9]), (3, texts[10]), (3, texts[10])]


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOC).repartition(3).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("clash"))
    assert collected(simhash.groups(docs)) == expected(rows)


def test_full_halves_are_split(spark, rows, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_UNDER_HALF", 2)
    monkeypatch.setattr(simhash, "TASK_ROWS", 50)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    monkeypatch.setattr(simhash, "PAIRS", 3)
    assert collected(simhash.groups(spark.createDataFrame(rows, DOC))) == expected(rows)


@pytest.mark.parametrize("most_under_half", [2, 5, 256])
def test_links_connect_what_is_near(spark, monkeypatch, most_under_half):
    """Clusters around a few numbers, so that halves and quarters are shared by many."""
    monkeypatch.setattr(simhash, "MOST_UNDER_HALF", most_under_half)
    rng, prints = random.Random(most_under_half), {0, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(rng.choice((16, 32, 64)))
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
        parent[root(a)] = root(b)
    part = components(prints)
    same = {}
    for i, x in enumerate(signed):
        assert same.setdefault(part[i], root(x)) == root(x)
    assert len(set(same.values())) == len(same)


def test_a_task_emits_no_more_than_a_forest():
    n = 300
    fp = np.array([0, *[1 << b for b in range(62)], *[1 << b | 1 << c for b in range(30) for c in range(b)]], np.int64)[:n]
    zeros = np.zeros(len(fp), np.int64)
    a, b = simhash.links_of_lists(zeros, zeros, fp, np.ones(len(fp), bool))
    assert len(a) == len(fp) - 1 and len(set(a) | set(b)) == len(fp)


def test_no_texts():
    assert len(simhash.fingerprints(pa.array([], pa.large_string()))) == 0
    assert simhash.fingerprints(pa.array(["", " "], pa.large_string())).tolist() == [0, 0]


def test_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], DOC)).count() == 0


def test_query_covers_every_document(spark):
    from pagescript.llm import queries

    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    found = queries.queries()["op13_simhash"](spark, path).collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found) == sorted(expected(docs))
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in found)
