"""Spelling variants against edit distances pair by pair."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagescript.llm import spelling

DOC = "doc_id long, text string"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, one_in=97, least_length=5, least_n=3, times=2):
    n = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def random_words(rng, count, letters="abÀé", most=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(4, most))) for _ in range(count)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = random_words(rng, 120) + ["aaaaa", "aaaaaa", "aaaaaaa", "straße", "strasse", "Strase", "über×÷ung", "xx" * 3000, "xx" * 3000 + "y"]
    found = []
    for i in range(150):
        picked = [words[min(int(rng.expovariate(0.05)), len(words) - 1)] for _ in range(60)]
        found.append((None if i % 20 == 0 else i % 140, ", ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in picked)))
    return found + [(1, None), (2, ""), (3, "12 + ? \n"), (None, None), found[5], found[5]]


@pytest.mark.parametrize("shard_letters", [1 << 17, 400, 60])
def test_equals_plain_edit_distances(spark, rows, monkeypatch, shard_letters):
    """Also with tiny shards and blocks, where halves that many words share are cut up."""
    monkeypatch.setattr(spelling, "SHARD_LETTERS", shard_letters)
    docs = spark.createDataFrame(rows, DOC).repartition(3).withColumn("word", F.lit(1)).withColumn("n", F.lit("clash"))
    assert collected(spelling.variants(docs)) == plain(rows)


def test_many_slips_and_other_parameters(spark, rows):
    docs = spark.createDataFrame(rows, DOC)
    assert collected(spelling.variants(docs, one_in=3, least_length=4, least_n=2, times=3)) == plain(rows, 3, 4, 2, 3)


def test_index_finds_each_pair_once():
    rng = random.Random(9)
    for n in (1, 2, 5, 6):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice((n, n + 1)))) for _ in range(150)})
        found = Counter()
        for second in (True, False):
            # All words in one shard: pairs that agree in neither half may not come up.
            for a, b in zip(*spelling.shard_links(words, n, second), strict=True):
                found[words[a], words[b]] += 1
        expected = {(a, b) for a in words for b in words if one_apart(a, b) and not len(a) == len(b) == n + 1}
        assert set(found) == expected and set(found.values()) <= {1}


def test_blocks_keep_pairs_of_different_blocks_only():
    words = ["aaaab", "aaaac", "aaaad", "aaaa"]
    a, b = spelling.shard_links(words, 4, True, np.array([0, 0, 1, 1]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 3), (1, 3), (3, 0), (3, 1)]


def test_few_words_are_counted_at_a_time(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 5)
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    assert collected(spelling.variants(spark.createDataFrame(rows, DOC))) == plain(rows)


def test_long_paths_end(spark):
    n = 70
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(n)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {f"w{n}"}


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], DOC)).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    from pagescript.llm import queries

    path = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet')")
    found = queries.queries()["op12_spelling_variants"](spark, path)
    expected = duck.execute(f"select {', '.join(found.columns)} from ({queries.oracle_sql()['op12_spelling_variants']})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
