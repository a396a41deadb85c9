"""The Merkle manifest against a plain tree, for sizes on either side of every level and of a block."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pagescript.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
    return found


def climb(tree, at, digest):
    """(siblings on the way up, the top with digest in place of the node)."""
    siblings = []
    for row in tree[:-1]:
        first = at // 3 * 3
        run = row[first : first + 3]
        siblings += run[: at - first] + run[at - first + 1 :]
        run[at - first] = digest
        digest, at = h(*run), at // 3
    return siblings, digest


def plain(rows, change):
    """Sorted (doc_id, leaf, subroot, root, proof, folded_root)."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
        trees[s] = own, levels([leaf(r[0], r[3], r[2], r[4], r[1]) for r in own])
    upper, out = levels([trees[s][1][-1][0] for s in sources]), []
    for k, s in enumerate(sources):
        own, tree = trees[s]
        for i, r in enumerate(own):
            below, top = climb(tree, i, leaf(r[0], r[3], r[2], r[4], change(r)))
            above, folded = climb(upper, k, top)
            out.append((r[0], tree[0][i], tree[-1][0], upper[-1][0], "".join(below + above), folded))
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in df.collect()), key=str)


def change(row):
    return row[1].replace("\n", "") if row[1] is not None and row[0] is not None and row[0] % 2 else row[1]


@pytest.mark.parametrize("levels_of_a_block", [1, 2, 6])
def test_equals_a_plain_tree(spark, monkeypatch, levels_of_a_block):
    monkeypatch.setattr(merkle, "TASK_ROWS", 5)
    rows, doc_id = [], 100
    for source, n in {None: 10, "": 1, "a": 2, "b": 3, "c": 4, "é": 9, "Z": 28, "hot": 82}.items():
        for i in range(n):
            doc_id = doc_id * 31 % 1009
            rows.append((doc_id, f"line {i}\n\nend ü\n", "en" if i % 3 else None, source, None if i % 5 == 0 else i))
    rows += [(None, "x\ny", None, "a", None), (None, None, None, None, None), (7, "", "en", "b", 0), (7, "\n", "en", "b", 1), (7, "\n", "en", "b", 1), (5, "y" * 40_000 + "\n", "en", "Z", 1)]
    docs = spark.createDataFrame(rows, DOC).repartition(5).withColumn("tree", F.lit(3)).withColumn("pos", F.lit("clash"))
    tampered = {"text": F.when(F.col("doc_id") % 2 != 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    assert collected(merkle.manifest(docs, tampered, levels_of_a_block)) == plain(rows, change)


def test_nothing_changed_folds_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", None, f"s{i % 5}", i) for i in range(40)], DOC)
    found = merkle.manifest(docs)
    assert found.where("folded_root = root").count() == 40 and found.select("root").distinct().count() == 1


def test_one_document_is_the_root(spark):
    (row,) = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOC)).collect()
    assert row.root == row.subroot == row.leaf == row.folded_root == leaf(1, "s", "en", 1, "a") and row.proof == ""


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0


def test_states_are_resumed():
    """Folding never hashes what stands to the left again, and leaves the kept states as they are."""
    block = merkle.Subtree([h(str(i)) for i in range(9)], 2)
    tree = levels([h(str(i)) for i in range(9)])
    for i in range(9):
        for new in (h("new"), tree[0][i]):
            assert block.fold(i, new.encode()).decode() == climb([list(x) for x in tree], i, new)[1]
    assert block.top() == tree[-1][0]


def test_query_equals_its_sql(spark):
    import duckdb

    from pagescript.llm import queries

    path = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet')")
    found = queries.queries()["op11_merkle_manifest"](spark, path)
    expected = duck.execute(f"select {', '.join(found.columns)} from ({queries.oracle_sql()['op11_merkle_manifest']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)
