"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagescript.llm import chat, components, decontam, jaccard, licenses, mixing, quality, secret_scan, suffix_dedup, token_counts, toxicity

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    passage = prose(rng, 40)
    for i in range(10):
        texts.append(f"{prose(rng, 15)} {passage} {prose(rng, 12)}")
    base = prose(rng, 150, 3000).split()
    for i in range(12):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [texts[3], texts[3], texts[7].upper(), None, "", " \t\n", "ä" * 80, "ab" * 5000, "a b", "A B", "a b c", "x " * 3000, "dup line\ndup line\n\n \nother", "Ünïcödé größer " * 9]
    texts += ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten eleven"]
    return [(i * 3 % 997, t, None if i % 11 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_mixing_reaches_targets_by_weight(docs, corpus, empty):
    rows = mixing.mix(docs.withColumn("_name", F.lit(1)).withColumn("size", F.lit("clash"))).collect()
    size = {d: len(BLANK.findall(t or "")) for d, t, *_ in corpus}
    assert {r.doc_id: r["size"] for r in rows} == size
    by_source = Counter()
    for d, t, _, s, _ in corpus:
        by_source[s] += size[d]
    names = sorted((s for s in by_source if s is not None)) + ([None] if None in by_source else [])
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(by_source.values())
    target, open_ = {}, set(names)
    while True:  # excess is shared again by weight until no target is above its cap
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * by_source[s]}
        if not above:
            target |= share
            break
        target |= {s: 3 * by_source[s] for s in above}
        open_ -= above
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == by_source[r.source]
        assert r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in names)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix(empty).count() == 0


def test_mixes_of_rows_that_share_an_id_do_not_depend_on_their_layout(spark):
    rng = random.Random(13)
    rows = [(None if i % 3 else 7, f"{rng.choice('abcdef')} " + " ".join("w" for _ in range(rng.randrange(5))), "en", f"s{i % 2}" if i % 5 else None, i) for i in range(240)]
    seen = []
    for parts in (1, 4, 9):
        rng.shuffle(rows)
        found = mixing.mix(spark.createDataFrame(rows, DOC).repartition(parts))
        seen.append(sorted(map(str, found.collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 240


def test_mix_equals_its_sql(spark):
    """The query and the SQL that is registered beside it, over the smallest tables."""
    import duckdb

    from pagescript.llm import queries

    path = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet')")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    expected = duck.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()['op4_mix_sources']})").fetchall()
    found = queries.queries()["op4_mix_sources"](spark, path).select(*columns).collect()
    assert sorted((d, n, s, round(t, 6), k) for d, n, s, t, k in found) == sorted((d, n, s, round(t, 6), k) for d, n, s, t, k in expected)


def test_targets_stop_at_the_cap(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 500)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    assert found["a"] == 30 and found["c"] == 30 and sum(found.values()) == pytest.approx(1520)
    assert found["b"] == pytest.approx(1460 * 2 / 3) and found[None] == pytest.approx(1460 / 3)


def test_suffix_dedup_equals_brute_force(docs, corpus, empty):
    length, seen, expected = 50, {}, {}
    for d, t, *_ in sorted(corpus):
        data = (t or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen.get(data[i : i + length], d) < d:
                covered[i : i + length] = b"\1" * length
        for i in range(len(data) - length + 1):
            seen.setdefault(data[i : i + length], d)
        kept = bytes(x for x, c in zip(data, covered) if not c)
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        expected[d] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    for block_bytes, range_bytes in ((1 << 10, 1 << 10), (1 << 12, 300), (1 << 20, 1 << 11)):
        rows = suffix_dedup.removal(docs.withColumns({"block": F.lit("x"), "known": F.lit(2)}), block_bytes=block_bytes, range_bytes=range_bytes).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected
        assert len(rows) == len(corpus)
    assert suffix_dedup.removal(empty).count() == 0


def test_the_largest_id_and_null_ids(spark):
    rng = random.Random(21)
    passage, most = prose(rng, 30), (1 << 63) - 1
    rows = [(most, f"x {passage}"), (None, f"y {passage}"), (None, f"z {passage}"), (5, "short"), (None, None), (6, passage[:60]), (None, "")]
    found = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.removal(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=64, range_bytes=64).collect()]
    n = len(passage)
    assert sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == [(5, 5, 0), (6, 60, 0), (most, n + 2, 60), (None, 0, 0), (None, 0, 0), (None, n + 2, 60), (None, n + 2, 60)]


def test_suffix_ranks_are_suffix_order():
    import numpy as np

    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(400)) + bytes(60)
    starts = np.arange(400)
    ranks = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), starts, 20)
    by_text = sorted(range(400), key=lambda i: data[i : i + 20])
    assert sorted(range(400), key=lambda i: (ranks[i], data[i : i + 20])) == by_text
    assert all((ranks[i] == ranks[j]) == (data[i : i + 20] == data[j : j + 20]) for i in range(0, 400, 7) for j in range(400))


def shingle_set(text, width):
    words = BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute_components(corpus, width, num, den):
    sets = {d: shingle_set(t, width) for d, t, *_ in corpus}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("width", "num", "den", "tile"), [(3, 90, 100, 4), (5, 80, 100, 4), (5, 80, 100, 2048), (2, 55, 100, 2)])
def test_jaccard_join_equals_brute_force(docs, corpus, width, num, den, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)  # leaders of several tiles
    monkeypatch.setattr(jaccard, "SKETCHES", 2 * tile)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 20)
    rows = jaccard.join(docs.withColumn("key", F.lit(0)), width, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(corpus, width, num, den)


def test_jaccard_join_of_nothing(empty, spark):
    assert jaccard.join(empty).count() == 0
    few = jaccard.join(spark.createDataFrame([(None, "a b c"), (4, None)], "doc_id long, text string")).collect()
    assert sorted(few, key=lambda r: r.n_shingles) == [(4, 0, 4), (None, 1, None)]


def test_copies_under_repeated_ids_are_judged_by_text(spark):
    rng = random.Random(12)
    w, v, z = (prose(rng, 40, 3000) for _ in range(3))
    rows = [(1, w), (5, w), (5, v), (9, v), (5, z), (5, z), (7, f"{z} more"), (None, v), (None, v), (3, None), (3, ""), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(1)).withColumn("stays", F.lit("x"))
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join(docs, 5, 80, 100).collect())
    assert found == sorted([(0, 36, 5), (0, 36, 5), (1, 36, 1), (5, 36, 1), (5, 36, 5), (9, 36, 5), (5, 36, 5), (5, 36, 5), (7, 37, 5), (3, 0, 3), (3, 0, 3), (4, 1, 4)])
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, w), (5, v), (5, z), (3, ""), (4, "a b")])


@pytest.mark.parametrize("seed", range(2))
def test_rows_without_an_id_are_judged_like_all_others(spark, seed):
    """The same rows under unique ids tell the components; a third of them have lost theirs."""
    rng = random.Random(40 + seed)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(12)]
    for t in list(texts):
        for _ in range(rng.randrange(6)):
            w = t.split()
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
            texts.append(rng.choice([t, " ".join(w), f" {t.upper()}"]))
    texts += [None, None, "", "", " ", "lone", "lone"]
    rng.shuffle(texts)
    nameless = {i for i in range(len(texts)) if rng.random() < 0.35}
    plain = brute_components(list(enumerate(texts)), 5, 80, 100)
    parts = {}
    for i, (_, part) in plain.items():
        parts.setdefault(part, []).append(i)
    docs = spark.createDataFrame([(None if i in nameless else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key long")
    expected = [(None if i in nameless else i, n, min((j for j in parts[part] if j not in nameless), default=None)) for i, (n, part) in plain.items()]
    by = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in jaccard.join(docs, 5, 80, 100).collect()), key=by) == sorted(expected, key=by)
    kept = jaccard.first_of_each(docs, 5, 80, 100).collect()
    for part in parts.values():
        stay = [r for r in kept if r.key in part]
        named = [i for i in part if i not in nameless]
        assert len(stay) == 1 and (not named or stay[0].doc_id == min(named))


def test_sketches_never_part_what_links():
    import numpy as np

    rng = np.random.default_rng(8)
    for size in (5, 40, 300, 2000):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = np.concatenate([a[size // 10 :], rng.integers(0, 1 << 63, size // 9).astype(np.uint64)])
        c = rng.integers(0, 1 << 63, size).astype(np.uint64)
        each, sizes = [jaccard.sketch(x) for x in (a, b, c)], np.array([len(a), len(b), len(c)])
        found = {(int(i), int(j)) for p, q in jaccard.near_by_sketch(each, sizes, each, sizes, 80, 100) for i, j in zip(p, q)}
        assert {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)} <= found and (size < 40 or (0, 2) not in found)


def test_large_sets_share_a_rare_shingle():
    rng = random.Random(8)
    for size in [*range(1, 60), 250]:
        scheme = jaccard.Scheme(80, 100)
        universe = [rng.getrandbits(64) for _ in range(2 * size + 10)]
        a = set(universe[:size])
        for _ in range(12):
            b = set(rng.sample(sorted(a), rng.randrange(max(1, size * 8 // 10), size + 1))) | set(rng.sample(universe[size:], rng.randrange(0, size // 5 + 1)))
            if 100 * len(a & b) >= 80 * len(a | b):
                assert set(sorted(a)[: scheme.prefix(len(a))]) & set(sorted(b)[: scheme.prefix(len(b))]), (len(a), len(b))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)} | {200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_statistics_equal_brute_force(docs, corpus, empty):
    rows = {r.doc_id: r for r in quality.judge(docs.withColumn("n_words", F.lit("clash")), prior=20).collect()}
    for d, t, *_ in corpus:
        t = t or ""
        words = BLANK.findall(t)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        times = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed,
        )
        assert not (failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60), "en", "a", 0) for i in range(200)] + [(900 + i, " ".join(f"w{rng.randrange(400)}###" for _ in range(60)), "en", "a", 0) for i in range(15)]
    found = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert not any(found[900 + i] for i in range(15)) and sum(found[i] for i in range(200)) >= 198


def test_quality_rejects_tables_and_repeated_lines(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(40, 90)), "en", "a", 0) for i in range(300)]
    rows += [(900 + i, " | ".join(prose(rng, 1 + j % 2) for j in range(20)), "en", "a", 0) for i in range(40)]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    tables = [found[900 + i] for i in range(40)]
    assert all(0.3 < r.n_symbols / r.n_words < 0.6 for r in tables) and not any(r.base_failed or r.kept for r in tables)
    assert sum(found[i].kept for i in range(300)) >= 297
    half = spark.createDataFrame([(1.0, 0.0, 1.79, 1.0, 0.0, 0.0, *[0.0] * 6)], "z1 double, z2 double, z3 double, m1 double, m2 double, m3 double, c11 double, c12 double, c13 double, c22 double, c23 double, c33 double")
    assert half.select(quality.distance(quality.FLOORS)).first()[0] > quality.CUTOFF


def test_quality_estimates_settle(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    groups = {}
    for k in range(4):
        good, bad = rng.normal(0, 1, (400, 3)) * (0.3, 0.5, 1), rng.normal(0, 0.4, (60 + 20 * k, 3)) + (2.5, -3, 3)
        groups[f"g{k}"] = np.concatenate([good, bad])
    groups["tied"] = np.tile((1.0, 0.0, 0.0), (80, 1))
    floors = np.diag(np.square(quality.FLOORS))
    steps = {}
    for name, z in groups.items():
        q, ends = np.quantile(z, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf"), []
        for m, c in ((q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)), (z.mean(0), np.cov(z.T, bias=True))):
            least = None
            for n in range(100):
                d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c + floors), z - m)
                near = z[d <= np.quantile(d, quality.SUBSET, method="inverted_cdf") + 1e-12]
                new = np.cov(near.T, bias=True)
                if least is not None and np.linalg.det(new + floors) >= least * (1 - quality.SETTLED):
                    break
                m, c, least = near.mean(0), new, np.linalg.det(new + floors)
            ends.append((least, n, m))
        steps[name] = min(ends, key=lambda e: e[0])[1:]
    assert max(n for n, _ in steps.values()) > 2
    rows = [(g, *map(float, z)) for g, zs in groups.items() for z in zs]
    found = {r.g: r for r in quality.mcd(spark.createDataFrame(rows, "g string, z1 double, z2 double, z3 double"), "g").collect()}
    for name, (_, m) in steps.items():
        assert [found[name][f"m{i}"] for i in (1, 2, 3)] == pytest.approx(list(m), abs=1e-6)


def test_small_groups_lean_on_the_scatter_within_groups(spark):
    import numpy as np

    rng = random.Random(6)
    rows = [(i, " ".join("x" * rng.randrange(2, 9) + ("#" if rng.random() < 0.1 else "") for _ in range(rng.randrange(30, 80))), "en", "large" if i < 300 else "small", 0) for i in range(312)] + [(900, "one " * 3, "en", "none", 0), (901, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    found = {r.doc_id: r for r in quality.judge(docs, prior=30).collect()}
    passed = [r for r in found.values() if not r.base_failed]
    vectors = spark.createDataFrame([(r.source, r.z1, r.z2, r.z3) for r in passed], "g string, z1 double, z2 double, z3 double")
    estimates = {r.g: r for r in quality.mcd(vectors, "g").collect()}

    def both(e):
        return np.array([e.m1, e.m2, e.m3]), np.array([[e.c11, e.c12, e.c13], [e.c12, e.c22, e.c23], [e.c13, e.c23, e.c33]])

    sizes = {"large": 300, "small": 12}
    within = sum(n * both(estimates[g])[1] for g, n in sizes.items()) / 312
    for r in passed:
        w = sizes[r.source] / (sizes[r.source] + 30)
        m, c = both(estimates[r.source])
        z = np.array([r.z1, r.z2, r.z3]) - m
        assert r.distance2 == pytest.approx(z @ np.linalg.inv(w * c + (1 - w) * within + np.diag(np.square(quality.FLOORS))) @ z, rel=1e-3, abs=1e-6)
        assert r.kept == (r.distance2 <= quality.CUTOFF)
    assert not found[900].kept and not found[901].kept
    assert [r.kept for r in quality.judge(docs.where("doc_id >= 900")).collect()] == [False, False]


@pytest.mark.parametrize("n", [1, 25, 100, 400])
def test_small_languages_are_kept(spark, n):
    """2,000 English documents, and few in Chinese, whose words are whole lines of 18 to 30 signs."""
    rng = random.Random(n)
    rows = [(i, prose(rng, rng.randrange(40, 90)), "en", f"s{i % 4}", 0) for i in range(2000)]
    chinese = lambda: "\n".join("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randrange(18, 31))) for _ in range(rng.randrange(12, 30)))
    rows += [(5000 + i, chinese(), "zh", "s0", 0) for i in range(n)]
    found = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert sum(found[5000 + i] for i in range(n)) >= n - n // 100 and sum(found[i] for i in range(2000)) >= 1980


def test_steps_are_bounded(spark):
    rows = [("g", float(i % 7), float(i % 5), float(i % 3)) for i in range(60)]
    table = spark.createDataFrame(rows, "g string, z1 double, z2 double, z3 double")
    assert quality.mcd(table, "g", most_steps=1).count() == 1


def test_license_base_places_equal_brute_force(spark, empty):
    texts = ["CC BY cc-by, x", "The GNU General  Public\nLicense; all rights reserved. All Rights", None, "", "cc", "by cc by cc by", "general public", "Released under the MIT License.", "license general public license", "a" * 5000 + " cc by", "Licensed under CC BY-NC 4.0."] * 2
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        places = [(j, label) for label, phrase in licenses.BASE.items() for j in range(len(words)) if words[j : j + len(phrase.split())] == phrase.split()]
        r = found[i]
        starts = sorted(j for j, _ in places)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert "mit" in found[7].labels and found[7].score == 1 and "cc-by-nc" in found[10].labels
    assert licenses.scan(empty).count() == 0


def test_decontamination_finds_items_and_leaves_the_rest(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"q{rng.randrange(5000)}" for _ in range(rng.randrange(15, 150))) + ". The answer is " + f"a{i} b{i}.") for i in range(30)] + [(50, None), (51, "")]
    rows = [(d, prose(rng, rng.randrange(5, 700), 5000)) for d in range(60)] + [(98, None), (99, "")]
    planted = {(d, i) for d, i in zip(range(0, 40, 2), range(20))}
    for d, i in planted:
        rows[d] = (d, f"{rows[d][1]} {items[i][1].upper() if i % 3 == 0 else items[i][1]} {prose(rng, 200, 5000)}")
    found = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), decontam.question_and_answer(spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    nothing = spark.createDataFrame([], "item_id long, question string, answer string")
    assert decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), nothing).count() == 0


def test_items_that_share_an_id_all_leak(spark):
    rng = random.Random(14)
    w, v = (prose(rng, 30, 5000) for _ in range(2))
    items = spark.createDataFrame([(1, w, ""), (1, v, "the end"), (1, w, ""), (2, w, None), (None, v, None)], "item_id long, question string, answer string")
    rows = [(10, w), (11, v), (12, f"{prose(rng, 20_000, 5000)} {v} the end"), (13, f"{w} {v}"), (13, w), (14, prose(rng, 90, 5000)), (None, v)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "score": F.lit(1)})
    found = decontam.leaks(docs, items).collect()
    named = [r for r in found if r.item_id is not None]
    assert sorted((r.doc_id or 0) for r in found if r.item_id is None) == [0, 11, 12, 13]
    assert sorted((r.doc_id or 0, r.item_id) for r in named) == [(0, 1), (10, 1), (10, 2), (11, 1), (12, 1), (13, 1), (13, 1), (13, 2), (13, 2)]
    lost = [(x.doc_id or 0, x.question_overlap) for x in decontam.leaks(docs, spark.createDataFrame([(None, v, None), (None, w, None), (None, None, None)], items.schema)).collect()]
    assert sorted(lost) == [(0, 1.0), (10, 1.0), (11, 1.0), (12, 1.0), (13, 1.0), (13, 1.0)]
    assert all(r.question_overlap == 1 for r in found) and [r.answer_overlap for r in named if r.doc_id == 12] == [1.0]


def plain_leaks(rows, items, reach=2000):
    """Every document against every item, without an index: shares of n-grams within any stretch of words of the index's margin."""
    found = set()
    for d, text in rows:
        have = decontam.words(text or "")
        for item, question, answer in items:
            q, a = decontam.words(question or ""), decontam.words(answer or "")
            if not q + a:
                continue
            shares = []
            for side in (q, a):
                n = min(decontam.GRAM, len(side))
                grams = {tuple(side[i : i + n]) for i in range(len(side) - n + 1)} if n else set()
                shares.append(len(grams & {tuple(have[i : i + n]) for i in range(len(have) - n + 1)}) / len(grams) if grams else 0.0)
            if decontam.leaked(*shares):
                found.add((d, item))
    return found


def test_leaks_equal_a_plain_search(spark):
    """Short documents, so that all of one is within the margin of each passage."""
    rng = random.Random(15)
    items = [(i, prose(rng, rng.randrange(1, 60), 3000), prose(rng, rng.randrange(0, 9), 3000)) for i in range(40)]
    rows = []
    for d in range(160):
        _, q, a = items[rng.randrange(40)]
        words = q.split()
        share = rng.choice([1.0, 0.95, 0.8, 0.5, 0.2, 0])
        kept = words[: max(0, round(len(words) * share))]
        rows.append((d, " ".join([prose(rng, rng.randrange(0, 12), 3000), *kept, a if rng.random() < 0.6 else "", prose(rng, rng.randrange(0, 12), 3000)])))
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string")).collect()}
    expected = plain_leaks(rows, items)
    # An item of which less than THRESHOLD of the BM25 mass is there is no hit of the index; whatever is found is right.
    assert found <= expected
    whole = {(d, i) for d, text in rows for i, q, a in items if f" {q} {a}".strip() in text}
    assert whole <= found and len(found) >= 0.95 * len(expected)


def test_block_max_wand_equals_full_scores():
    rng = random.Random(6)
    index = decontam.build([(i, " ".join(f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(20)), "") for i in range(200)])
    for _ in range(40):
        query = rng.sample(range(len(index.terms)), 25)
        scores = Counter()
        for t in query:
            for p, x in zip(index.parts[t].tolist(), index.impacts[t].tolist()):
                scores[p] += x
        expected = {p for p, s in scores.items() if s >= 0.5}
        assert {p for p, _ in decontam.block_max_wand(index, query, 0.5)} == expected


def test_toxicity_separates_held_out_documents(spark, empty):
    rng = random.Random(9)
    marks = ["idiot", "worthless", "moron", "vequlan", "vequtor", "vequmis"]
    rows, labels = [], []
    for i in range(600):
        words = [f"{rng.choice(['an', 'the', 'or', 'in'])}{rng.choice(['er', 'st', 'nd', 'ti'])}{rng.choice(['on', 'ly', 'ed', 'es'])}" for _ in range(rng.randrange(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(marks)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "x" * 100_000)], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").where(toxicity.learnable(F.col("doc_id")))
    model = toxicity.fit(docs, known)
    held = toxicity.score(docs, model).where(~toxicity.learnable(F.col("doc_id"))).join(spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id").collect()
    right = sum((r.toxicity >= toxicity.CUTOFF) == bool(r.toxic) for r in held)
    assert right >= 0.97 * len(held) and any(r.toxic for r in held)
    extra = {r.doc_id: r.toxicity for r in toxicity.score(docs.where("doc_id >= 1000"), model).collect()}
    assert len(extra) == 3 and all(0 <= x < toxicity.CUTOFF for x in extra.values())
    nothing = toxicity.fit(docs, known.where("false"))
    assert {r.toxicity for r in toxicity.score(docs.where("doc_id < 5"), nothing).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_toxicity_of_phrases_of_ordinary_words(spark):
    rng = random.Random(10)
    common = [f"{a}{b}" for a in ("gar", "mil", "ton", "vel", "sor", "pan", "bri", "cho", "dul", "fer", "hin", "jas") for b in ("der", "ic", "oth", "une", "ly", "and", "est", "ow", "ish", "ent")] + ["nobody", "wants", "people", "around"]
    rows = []
    for i in range(900):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 60))]
        if i % 5 == 0:
            words[5:5] = ["nobody", "wants", "people", "around"]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic").where(toxicity.learnable(F.col("doc_id"))))
    held = toxicity.score(docs, model).where(~toxicity.learnable(F.col("doc_id"))).collect()
    assert sum((r.toxicity >= toxicity.CUTOFF) == bool(r.toxic) for r in held) >= 0.95 * len(held)


def plain_toxicity(model, text):
    """Every window of a text looked at, one by one."""
    gain = toxicity.Gains(model.toxic, model.ordinary)
    words = [w[i : i + 48] for w in re.findall(r"[^\W_]+", (text or "").lower()) for i in range(0, len(w), 48)]
    every = [f" {' '.join(words[i : i + 6])} " for i in range(0, max(1, len(words) - 3), 3)] if words else []
    gains = [g for w in set(every) if (g := gain(w)) > 0]
    counts = [len(every) - len(gains)] + [sum(min(g, 16) == k for g in gains) for k in range(1, 17)]
    return model.probability[min(max(round(sum(n * w for n, w in zip(counts, model.weights))) + 32, 0), 64)]


def test_toxicity_scores_equal_a_plain_version(spark, docs, corpus):
    weights = (-0.1, 0.2, 0.9, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, *[4.5] * 8)
    model = toxicity.Model(b" garbage  nonsense  w17 w18  dup line ", b" one two three w1 w2 w3 ", weights, tuple(i / toxicity.LEVELS for i in range(toxicity.LEVELS)))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs.withColumn("toxicity", F.lit("clash")), model).collect()}
    assert got == {d: plain_toxicity(model, t) for d, t, *_ in corpus}


def test_secrets_are_found_and_redacted(spark, empty):
    rng = random.Random(1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, secrets = [], {}
    for i in range(300):
        body = f"{prose(rng, 10)} thenationandotherwords {prose(rng, 10)} ContinuationOfthisthing"
        if i % 3 == 0:
            secrets[i] = hexes(32)
            body += f" password={secrets[i]} {prose(rng, 3)}"
        elif i % 3 == 1:
            secrets[i] = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
            body += f" {secrets[i]} {prose(rng, 3)}"
        rows.append((i, body, "en", "src", len(body)))
    rows += [(None, f"token={hexes(30)}", None, None, None), (400, None, None, None, None), (401, "", None, None, 0), (402, "x" * 50_000, None, None, None)]
    docs = spark.createDataFrame(rows, DOC).withColumn("_secrets", F.lit("clash"))
    model = secret_scan.fit(secret_scan.weak_labels(secret_scan.candidates(docs, "source")))
    found = secret_scan.scan(docs, model, "source")
    caught = {(r.doc_id, r.candidate) for r in found.where("is_secret AND doc_id < 400").collect()}
    assert caught == set(secrets.items())
    clean = {r.doc_id: r for r in secret_scan.redact(docs, found).collect()}
    assert len(clean) == len(rows) and all(secrets[i] not in clean[i].text and clean[i].n_chars == len(clean[i].text) for i in secrets)
    assert all(clean[i].text == rows[i][1] for i in range(2, 300, 3)) and clean[400].text is None and clean[400]["_secrets"] == "clash"
    assert secret_scan.scan(empty, None).count() == 0 and secret_scan.fit(secret_scan.weak_labels(secret_scan.candidates(empty))) is None


def test_ledger_is_idempotent_and_signed(spark, docs, corpus, tmp_path, empty):
    import base64

    import tiktoken

    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}, special_tokens={})
    expected, n = Counter(), Counter()
    for d, t, lang, source, _ in corpus:
        if d % 5 == 0:
            continue
        k = len(coder.encode_ordinary(t or ""))
        expected[source, lang] += k + 1 if d % 7 == 0 else k
        n[source, lang] += 1
    counts = token_counts.counted(docs, VOCABULARY, PATTERN, "v1").cache()
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit("a", token_counts.inserts(counts)) and not ledger.commit("a", token_counts.inserts(counts))
    assert ledger.commit("b", token_counts.deletes(counts.where("doc_id % 5 = 0")))
    assert ledger.commit("c", token_counts.revisions(counts.where("doc_id % 7 = 0 AND doc_id % 5 <> 0"), F.col("n_tokens") + 1))
    assert ledger.commit("d", token_counts.inserts(token_counts.counted(empty, VOCABULARY, PATTERN, "v1")))
    def got():
        return {(r.source, r.lang): (r.docs, r.tokens) for r in ledger.totals().collect()}

    assert got() == {k: (n[k], expected[k]) for k in n}
    ledger.compact()
    ledger.compact()
    assert got() == {k: (n[k], expected[k]) for k in n} and len(ledger._tables()[0]) == 1
    assert not ledger.commit("b", token_counts.deletes(counts)) and ledger.commit("e", token_counts.inserts(counts.where("doc_id % 5 = 0")))
    assert not ledger._claim("batch=e", "another") and sum(x for x, _ in got().values()) == len(corpus)
    ledger.compact()
    assert sum(x for x, _ in got().values()) == len(corpus)
    # A commit that has not named its table yet counts for nothing, and belongs to its writer until it is abandoned.
    first = ledger._fs.create(ledger._path(f"{ledger.path}/commits/batch=f"), False)
    with pytest.raises(RuntimeError):
        ledger.commit("f", token_counts.deletes(counts.where("doc_id % 5 = 0")))
    assert not ledger.committed("f") and ledger._fs.exists(ledger._path(f"{ledger.path}/commits/batch=f"))
    first.close()
    assert ledger.abandon("f") and not ledger.abandon("f") and not ledger.abandon("e")
    assert ledger.commit("f", token_counts.deletes(counts.where("doc_id % 5 = 0"))) and ledger.committed("f") and not ledger.abandon("f")
    assert got() == {k: (n[k], expected[k]) for k in n}


def test_counts_of_odd_rows(spark):
    rows = [(1, None, "s", None), (1, None, "s", None), (None, "a b", None, "en"), (3, "word " * 20_000, "s", None), (4, "", "t", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"n_tokens": F.lit("x"), "tokenizer": F.lit(1)})
    found = {(r.doc_id, r.source, r.lang): r.n_tokens for r in token_counts.counted(docs, VOCABULARY, PATTERN, "v").collect()}
    assert found == {(1, "s", None): 0, (None, None, "en"): 2, (3, "s", None): 20_001, (4, "t", "en"): 0}


@pytest.mark.parametrize("text", ["", "\\", "####", "</turn>", "\\### Assistant: </turn> ok", "a\\\\b### </turn></turn>", "#" * 7 + "\\", "ünï ### \n"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    bare = re.sub(r"\\.", "", chat.escape(text), flags=re.DOTALL)
    assert "###" not in bare and "</turn>" not in bare


@pytest.mark.parametrize("turns", [[("a: b", "c"), ("a", "b: c")], [("", "")], [("\\", "\\"), (":", ": "), ("x:", "y </turn>\n### z: ")], [("### a", "</turn>"), ("</turn>", "\\</turn>\n")], [("user", "ü\n" * 3)]])
def test_written_form_is_read_back(turns):
    written = "".join(f"{chat.OPEN}{chat.escape_role(role)}{chat.SEP}{chat.escape(text)}{chat.CLOSE}" for role, text in turns)
    assert chat.read_written(written) == turns


def test_chat_round_trip(spark):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", "yes ### </turn>"), (1, 0, "user", None), (1, 2, None, "tool\n"), (2, 0, "assistant", ""), (None, 0, "user", "no id"), (-7, 0, "user", tricky), (-7, 1, "assistant", tricky), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, None, "assistant", "é" * 3000)]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0)), VOCABULARY, PATTERN)
    got = {r.conv_id: r for r in chat.read_back(turns, VOCABULARY, PATTERN).collect()}
    assert set(got) == {1, 2, 3, 4, -7, None}
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        everything = "".join(f"{role or ''}\n{text or ''}\n" for _, _, role, text in own)
        loss = "".join(text or "" for _, _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(everything.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(f"### {chat.escape_role(role or '')}: {chat.escape(text or '')} </turn>\n") for _, _, role, text in own)
    offsets = chat.with_offsets(turns).where("conv_id = 1").orderBy("token_offset").collect()
    assert offsets[0].token_offset == 0 and offsets[1].token_offset == len(offsets[0].ids)
    assert chat.read_back(turns.where("false"), VOCABULARY, PATTERN).count() == 0


def test_every_long_run_and_every_assigned_value_is_a_candidate(spark, corpus):
    """Against a plain search with the rule spelled out."""
    texts = ["password = correcthorsebattery", "password: correcthorse", 'key="abcdefgh"', "key= 'abcdefgh'", "thisisaverylongword short", "a=b", "x:1234567 y", "é" * 30, "abc/def-ghi_jkl==", None, "", 'password = "Tr0ub4dor&3xQ!9z" x', "db_password=s3cr3t!A", "see ?token=ab12cd34ef&next=/home/page", "secret_key: ab.cd!ef:gh...", "pass='it\"s,a;pass' more", "auth: `a'b\"c(d)e`", 'x="http://a.b/c?d=e"', "token=short!", "token:" + "!" * 500, "api-key = (abcdefgh)", 'said: "Wunderschöner Tag"', *[t for _, t, *_ in corpus]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[4]), (None, texts[0])]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ordinal, r.candidate) for r in secret_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"path": F.lit(1), "length": F.lit("x")})).collect())
    expected = [(d if d is not None else -1, n, c) for d, t in rows for n, c in enumerate(plain_candidates(t or ""))]
    assert got == sorted(expected)
    of = {t: [c for d, _, c in got if d == i] for i, t in enumerate(texts)}
    assert of['password = "Tr0ub4dor&3xQ!9z" x'] == ["Tr0ub4dor&3xQ!9z"] and of["db_password=s3cr3t!A"] == ["s3cr3t!A"] and of["see ?token=ab12cd34ef&next=/home/page"] == ["ab12cd34ef", "/home/page"]
    assert of["secret_key: ab.cd!ef:gh..."] == ["ab.cd!ef:gh"] and of["pass='it\"s,a;pass' more"] == ['it"s,a;pass'] and of["token=short!"] == []


def plain_candidates(t):
    """The rule place by place, without lookbehinds."""
    token = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-"
    ascii_ = [chr(c) for c in range(33, 127)]
    names = r"(?i:pass|passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)[A-Za-z0-9_.-]{0,12}[\"'`]? ?[=:] ?$"

    def run(i, of):
        j = i
        while j < len(t) and t[j] in of:
            j += 1
        return t[i:j]

    out, i = [], 0
    while i < len(t):
        found = ""
        if i == 0 or t[i - 1] not in token:
            before = t[max(0, i - 60) : i]
            if re.search(r"[=:](?:[\"'` ]| [\"'`])?$", before):
                if before[-1] in "\"'`":
                    found = run(i, [c for c in ascii_ if c != before[-1]])
                elif re.search(names, before):
                    found = run(i, [c for c in ascii_ if c not in "\"'`&(),;<>[]{|}"]).rstrip("!.?:")
                found = found if len(found) >= 8 else run(i, token)
                found = found if len(found) >= 8 else ""
            if not found:
                found = run(i, token)
                found = found if len(found) >= 12 else ""
        if found:
            found += re.match("={0,2}", t[i + len(found) :])[0]
            out.append(found)
        i += max(1, len(found))
    return out


def test_nothing_of_a_secret_with_marks_is_left(spark):
    texts = ['password = "Tr0ub4dor&3xQ!9z"', "db_password=s3cr3t!A", "export API_TOKEN='k9$Zx(2)qL#7'", "no secret here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.text for r in secret_scan.redact(docs, secret_scan.scan(docs, None)).orderBy("doc_id").collect()]
    assert found == ['password = "[SECRET]"', "db_password=[SECRET]", "export API_TOKEN='[SECRET]'", "no secret here"]


def test_rows_that_share_an_id_are_redacted_by_their_own_text(spark):
    key, other = "AKIA" + "ABCDEFGH2345JKLM", "AKIA" + "QRSTUVWX6723ABCD"
    rows = [(1, f"a {key} b"), (1, f"c {other} d"), (1, "AKIA alone"), (None, f"{key} {key}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit(0))
    found = secret_scan.scan(docs, None)
    assert sorted((r.doc_id or 0, r.text or "") for r in secret_scan.redact(docs, found).collect()) == [(0, ""), (0, "[SECRET] [SECRET]"), (1, "AKIA alone"), (1, "a [SECRET] b"), (1, "c [SECRET] d")]


def test_weak_labels_spare_real_secrets(spark):
    key = "AKIA" + "ABCDEFGH2345JKLM"
    texts = [f"a test of the deploy, key {key} here", "password=correcthorsebattery", "for the test run: token = a8f3k2m9x4q7z1w5", "test_token = a8f3k2m9x4q7z1w5"]
    found = secret_scan.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    labels = {}
    for i in range(4):
        labels[i] = [r.label for r in secret_scan.weak_labels(found.where(F.col("doc_id") == i)).collect()]
    assert labels == {0: [1.0], 1: [], 2: [1.0], 3: [0.0]}
