"""Views in their Spark form, and how often tables are dealt out."""

import pytest

from pagescript import fixtures, plans
from pagescript.operators import layout, order, spatial, suppress

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(fixtures.ON_SPARK))
def test_spark_forms_have_the_rows_of_the_sql(spark, name):
    (found,) = fixtures.load(spark, SF, name)
    found = found.localCheckpoint()
    if name == "fx_lines":  # in rows of a text with marks beyond the first plane, without a text, and without any mark
        spark.createDataFrame([(1, "a😀\n" * 41, 5), (2, None, 5), (3, "", 0), (4, "x" * 60, 60)], "doc_id long, text string, n_chars int").createOrReplaceTempView("documents")
        found = spark.sql(fixtures.ON_SPARK[name])
    expected = spark.sql(fixtures.VIEWS[name])
    assert found.dtypes == expected.dtypes and found.count() > 0
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0


def test_decisions_deal_boxes_out_once(spark):
    found = plans.queries()["l8_grouping_decisions"](spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)
    spark.catalog.clearCache()


def test_a_region_that_is_there_twice_is_decided_twice(spark):
    region = "sequence_id long, page_index int, region_pos int, x1 double, y1 double, x2 double, y2 double"
    state = "sequence_id long, page_index int, region_pos int, status string"
    regions = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 5.0, 5.0), (1, 0, 0, 0.0, 0.0, 5.0, 5.0), (1, 0, 1, 5.0, 0.0, 5.0, 5.0), (2, 0, 0, 0.0, 0.0, 5.0, None)], region)
    found = spark.createDataFrame([(1, 0, 0, "assigned"), (9, 0, 0, "ambiguous")], state)
    pages = spark.createDataFrame([(1, 0, True)], "sequence_id long, page_index int, layout_ran boolean")
    decided = layout.grouping_decisions(regions, found, found, pages, regions.limit(0))
    assert sorted(map(tuple, decided.collect()), key=str) == [(1, 0, 0, "assigned", None), (1, 0, 0, "assigned", None), (1, 0, 1, "unassigned", "malformed"), (2, 0, 0, "unassigned", "malformed")]


def test_relations_are_judged_after_the_join(spark):
    (regions,) = fixtures.load(spark, SF, "fx_regions")
    found = spatial.spatial_relations(regions.selectExpr("*", "1 as panel_pos"))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "CASE" not in joins[0]


def test_ids_are_dealt_out_once(spark):
    rows = spark.createDataFrame([("r", "a", "x", 1), ("r", "a", "x", None), ("r", "a", "y", 2), ("r", "b", "x", 3)], "region_id string, candidate_id string, text string, position int")
    once, several = suppress.dedupe_candidates(rows, ["region_id", "candidate_id"], "position")
    assert sorted(map(tuple, once.collect()), key=str) == [("r", "a", "x", None), ("r", "a", "y", 2), ("r", "b", "x", 3)]
    assert {r.text for r in several.collect()} == {"x", "y"}
    plan = several._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_candidates_stay_where_their_documents_are(spark, tmp_path):
    """Texts are moved once, as documents; also rows of documents that are empty, null, blank, long or there twice."""
    import duckdb

    docs = [(0, "a" * 700, 700), (1, "", 0), (2, None, None), (3, " ", 1), (4, "two words " * 9, 90), (4, "two words " * 9, 90)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = plans.queries()["d2_conflicting_candidates"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.split("Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "doc_id" in dealt[0] and "REPARTITION_BY_NUM" in dealt[0]
    names = ["region_id", "candidate_id"]
    expected = con.execute(plans.oracle_sql()["d2_conflicting_candidates"]).fetchall()
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(expected) and (2_000_000, "nemotron") in expected
    lines, rows = fixtures.load(spark, SF, "fx_lines", "fx_candidates", by_document=True)
    assert rows.where("doc_id <> floor(region_id / 1000000)").count() == lines.where("doc_id <> floor(region_id / 1000000)").count() == 0
    assert rows.drop("doc_id").exceptAll(fixtures.load(spark, SF, "fx_candidates")[0]).count() == 0


def test_balloons_are_dealt_out_by_group_once_to_be_ordered(spark):
    balloons = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, 2), (1, 0, 3), (2, 0, 1)], "sequence_id long, page_index int, pos int")
    edges = spark.createDataFrame([(1, 0, 3, 1), (1, 0, 2, 1), (1, 0, 3, 2), (9, 0, 1, 2)], "sequence_id long, page_index int, first int, second int")
    ranks = order.balloon_order(balloons, edges)
    assert sorted(map(tuple, ranks.collect())) == [(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 2, 3), (1, 0, 3, 0), (2, 0, 1, 0)]
    assert ranks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
