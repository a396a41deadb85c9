"""The stages of the pipeline over the smallest tables, each against a plain version on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagescript.llm import toxicity
from pagescript.llm.common import read

from .test_operators import BLANK, brute_components, plain_toxicity

SF = "/root/testdata/sf0.001"
SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, rows in, rows out)], each stage's output written and read again."""
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.columns, docs.collect(), after.columns, after.collect()))
        docs = after
    return {name: rest for name, *rest in out}


def test_all_but_the_last_keep_the_columns_of_documents(spark, stages):
    columns = read(spark, SF, "documents").columns
    assert all(found[2] == columns for name, found in stages.items() if name != "mixing")
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]


def test_one_of_each_group_stays(stages):
    _, before, _, after = stages["near_duplicates"]
    groups = brute_components([(r.doc_id, r.text) for r in before], 5, 80, 100)
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, first) in groups.items() if d == first)


def test_documents_with_items_go(spark, stages):
    _, before, _, after = stages["decontamination"]
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [words(r.text) for r in read(spark, SF, "benchmark").collect()]
    leaked = {r.doc_id for r in before if any(item in words(r.text) for item in items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - leaked


def test_secrets_leave_their_mark(stages):
    _, before, _, after = stages["secrets"]
    now = {r.doc_id: r for r in after}
    assert len(before) == len(after)
    for r in before:
        if SECRET.search(r.text or ""):
            assert not SECRET.search(now[r.doc_id].text) and now[r.doc_id].n_chars == len(now[r.doc_id].text)


def test_copies_follow_the_mix(stages):
    _, before, _, after = stages["mixing"]
    size = {r.doc_id: len(BLANK.findall(r.text or "")) for r in before}
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        assert r["size"] == size[r.doc_id] and r.taken == r.copies * r["size"] and 1 <= r["copy"] <= r.copies <= 3
    assert all(copies[r.doc_id] == r.copies for r in after)


def test_toxicity_stage_equals_a_plain_version(spark, stages):
    _, before, _, after = stages["toxicity"]
    docs = read(spark, SF, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, SF, "labels").where(toxicity.learnable(F.col("doc_id"))).select("doc_id", "toxic"))
    assert 0 < len(after) <= len(before)
    assert sorted(after) == sorted(r for r in before if plain_toxicity(model, r.text) < toxicity.CUTOFF)


CLASHES = ["_id", "_row", "_later", "stays", "toxicity", "text_hash", "_secrets", "copies", "size", "component_id"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids and texts, long texts, columns of all names that the stages use."""
    schema = read(spark, SF, "documents").schema
    words = " ".join(f"plain{i}" for i in range(60))
    texts = [(None, None), (None, "lone words"), (None, "lone words"), (5, words), (5, words), (5, "another text of the same id"), (7, words), (8, ""), (9, None), (10, "x " * 60_000), (11, f"{words} password=0123456789abcdef01")]
    rows = [tuple({"doc_id": d, "text": t}.get(c) for c in schema.names) for d, t in texts]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, odd, name, stage):
    out = stage(spark, odd, SF)
    rows = out.collect()
    before = sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    if name == "mixing":
        assert set(odd.columns) - {"size", "copies"} <= set(out.columns)
        assert all(len(r.text.split()) == r["size"] for r in rows if r.text is not None)
    else:
        assert out.columns == odd.columns and all(r[c] == "clash" for r in rows for c in CLASHES)
        found = sorted((r.doc_id or 0, r.text or "") for r in rows)
        if name == "near_duplicates":
            kept = {(5, "another text of the same id"), (8, ""), (9, ""), *(x for x in before if x[0] == 10), (5, next(t for d, t in before if d == 7))}
            assert found == sorted([(0, ""), (0, "lone words"), *kept])
        elif name == "secrets":
            assert len(found) == len(before) and [x for x in found if x[0] != 11] == [x for x in before if x[0] != 11]
        else:
            assert found == before
    assert stage(spark, odd.limit(0), SF).count() == 0
