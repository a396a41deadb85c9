"""Views that re-shape the driver tables into detection, candidate and transcript tables. The same SQL runs on Spark and, but for the name of explode, DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "embeddings", "conversations", "documents", "benchmark", "labels", "events")

#: In an order in which each may use those before it.
VIEWS = {
    # text boxes. 6,000 / 60,000 / 600,000 rows
    "fx_regions": """
select cast(floor(l_orderkey / 3) as bigint) as sequence_id,
       cast(l_orderkey % 3 as int) as page_index,
       cast(row_number() over (partition by l_orderkey
            order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as int) as region_pos,
       cast((l_partkey * 37 + l_linenumber * 211) % 900 as double) as x1,
       cast((l_suppkey * 53 + l_partkey * 29) % 1200 as double) as y1,
       cast((l_partkey * 37 + l_linenumber * 211) % 900 as double) + cast(l_quantity as double) * 3 + 20 as x2,
       cast((l_suppkey * 53 + l_partkey * 29) % 1200 as double) + cast((l_partkey * 7) % 90 as double) + 15 as y2,
       l_discount * 10 as confidence, l_linenumber as k, l_returnflag as flag
from lineitem
""",
    # page size and whether a balloon proposer ran
    "fx_pages": """
select distinct cast(floor(l_orderkey / 3) as bigint) as sequence_id, cast(l_orderkey % 3 as int) as page_index,
       1200 as width, 1500 as height, (floor(l_orderkey / 3) % 4) <> 0 as layout_ran
from lineitem
""",
    # 2x2 grid, absent on every fifth sequence
    "fx_panels": """
select p.sequence_id, p.page_index, g.panel_pos,
       g.gx * 600.0e0 as x1, g.gy * 750.0e0 as y1, g.gx * 600.0e0 + 600 as x2, g.gy * 750.0e0 + 750 as y2
from fx_pages p cross join (values (1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 1, 1)) as g(panel_pos, gx, gy)
where p.sequence_id % 5 <> 0
""",
    # proposals, padded region boxes plus near duplicates shifted by 1 px
    "fx_balloons": """
select sequence_id, page_index, region_pos * 2 as proposal_pos,
       x1 - 6 as x1, y1 - 6 as y1, x2 + 6 as x2, y2 + 6 as y2, 1 - confidence / 2 as confidence
from fx_regions where k % 2 = 1
union all
select sequence_id, page_index, region_pos * 2 + 1, x1 - 5, y1 - 6, x2 + 7, y2 + 6, 0.5e0
from fx_regions where k % 4 = 1
""",
    # body boxes, optional face box in the upper third
    "fx_characters": """
select cast(floor(l_orderkey / 3) as bigint) as sequence_id, cast(l_orderkey % 3 as int) as page_index,
       cast(row_number() over (partition by l_orderkey order by l_suppkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate) as int) as character_pos,
       cast((l_suppkey * 71 + l_partkey * 13) % 800 as double) as x1, cast((l_partkey * 41) % 1000 as double) as y1,
       cast((l_suppkey * 71 + l_partkey * 13) % 800 as double) + 160 as x2, cast((l_partkey * 41) % 1000 as double) + 300 as y2,
       l_tax > 0.04 as has_face
from lineitem where l_linenumber <= 3
""",
    # 5 characters per page, 3 pages per sequence, unit vectors of 64 floats
    "fx_vectors": """
select cast(floor(vec_id / 15) as bigint) as sequence_id, cast(floor((vec_id % 15) / 5) as int) as page_index,
       vec_id as character_id, label, embedding
from embeddings
""",
    # reference transcript lines (null speaker = unresolved)
    "fx_gold": """
select conv_id as sequence_id, cast(turn % 3 as int) as page_index, cast(floor(turn / 3) as int) as line_index,
       case when turn = 5 then null when role = 'system' then 'NARRATION' else role end as speaker, text
from conversations
""",
    # predictions with renamed speakers, dropped lines, edited text, every tenth sequence missing
    "fx_pred": """
select conv_id as sequence_id, cast(turn % 3 as int) as page_index, cast(floor(turn / 3) as int) as line_index,
       case when role = 'system' then 'NARRATION' when turn = 3 then 'UNKNOWN'
            when role = 'user' then 'Character A' else 'Character B' end as speaker,
       replace(text, 'th', 't') as text
from conversations where turn <> 4 and conv_id % 10 <> 7
""",
    # regions of 60 characters, so that each text is there to its end
    "fx_lines": """
select doc_id * 1000000 + line as region_id, substring(text, line * 60 + 1, 60) as text, n_chars
from (select doc_id, text, n_chars, explode(sequence(0, cast(floor((greatest(coalesce(length(text), 0), 1) - 1) / 60) as int))) as line from documents) as lines
""",
    # three hypotheses per region, four regions per balloon
    "fx_candidates": """
select cast(floor(region_id / 4) as bigint) as balloon_id, region_id, s.source,
       case s.source when 'ocr_base' then replace(text, 'e', 'c')
                     when 'nemotron' then text else upper(replace(text, 'ß', 'ss')) end as text,
       case when s.source = 'qwen3_vl' then null else ((n_chars + s.j * 17) % 101) / 100.0e0 end as ocr_confidence
from fx_lines cross join (values ('ocr_base', 1), ('nemotron', 2), ('qwen3_vl', 3)) as s(source, j)
""",
    # a model's answer per document: whole texts, with every defect that an answer can have
    "fx_answers": """
select doc_id as balloon_id, case when doc_id % 31 = 30 then 'timeout' end as failure,
       case doc_id % 31 when 1 then 'no json' when 2 then '[1, 2]' when 3 then '{"final_text": 7, "include_in_story": true}'
         when 4 then concat('```json ', body, '"include_in_story":true} ```') when 5 then concat(body, '"include_in_story":"yes"}') when 6 then concat(body, '"confidence":0.25}')
         when 7 then concat(body, '"include_in_story":true,"confidence":1.5}') when 8 then concat(body, '"include_in_story":true,"confidence":true}') when 9 then concat(body, '"include_in_story":true,"confidence":null,"decision_confidence":0.5}')
         when 10 then concat(body, '"include_in_story":true,"decision_confidence":0.5}') when 11 then concat(body, '"include_in_story":true,"text_type":"shout"}') when 12 then concat(body, '"include_in_story":true,"text_type":"narration"}')
         when 13 then concat(body, '"include_in_story":true,"text_type":null}') when 14 then concat(body, '"include_in_story":true,"corrections":"none"}')
         when 15 then concat(body, '"include_in_story":true,"corrections":[{"candidate_id":"c1","from_text":"a","to_text":"b"},{"candidate_id":"c9","from_text":"a","to_text":"b"},5,{"candidate_id":"c2","from_text":"","to_text":""},{"candidate_id":"c0","from_text":1,"to_text":"b"}]}')
         when 16 then '{"final_text":" ","include_in_story":true,"text_type":"shout"}' when 17 then '{"include_in_story":false,"notes":12}' when 18 then concat(body, '"include_in_story":false,"notes":"n","confidence":"0.5"}')
         when 19 then '{"_json_parse_error":"cut off"}' when 20 then '"text"' when 21 then cast(null as string) when 22 then concat(body, '"include_in_story":null,"confidence":-1}')
         else concat(body, '"include_in_story":true,"text_type":"dialogue","confidence":1}') end as payload
from (select doc_id, concat(substring(cast(to_json(named_struct('final_text', coalesce(text, ''))) as string), 1, length(cast(to_json(named_struct('final_text', coalesce(text, ''))) as string)) - 1), ',') as body from documents) as bodies
""",
    # three candidates to an answer
    "fx_answer_candidates": """
select doc_id as balloon_id, concat('c', cast(n as string)) as candidate_id from documents cross join (values (0), (1), (2)) as t(n)
""",
    # six preprocessing outcomes per reference text
    "fx_actions": """
select cast(floor(item_id / 8) as bigint) as sequence_id, item_id, a.action, a.j as action_pos, text as target_text,
       case when a.j = 1 then replace(text, 'an', 'en')
            when (item_id + a.j) % 3 = 0 then text
            else replace(text, 'th', cast(a.j as string)) end as text,
       ((item_id * 13 + a.j * 29) % 100) / 100.0e0 as recognition_score
from benchmark cross join (values ('NONE', 1), ('UPSCALE', 2), ('CONTRAST', 3), ('THRESHOLD', 4), ('ROTATE_CW', 5), ('ROTATE_CCW', 6)) as a(action, j)
""",
    # binary acceptance scores
    "fx_verifier": """
select doc_id, quality as expected, ((doc_id * 37) % 100) / 100.0e0 as base_score, ((doc_id * 61) % 100) / 100.0e0 as tuned_score,
       case when toxic = 1 then 'hard_negative' else 'nemotron' end as source
from labels
""",
    # stage telemetry
    "fx_timings": """
select event_id, ts, user_id as sequence_id, event_type as stage, value as seconds
from events
""",
    # one per region treated as a balloon, plus duplicate and missing rows
    "fx_adjudications": """
select sequence_id, page_index, region_pos as balloon_pos,
       case k % 5 when 0 then 'narration' when 1 then 'dialogue' when 2 then 'sound_effect' when 3 then 'unknown' else 'thought' end as text_type,
       flag <> 'R' as include_in_story, concat('TEXT ', cast(k as string)) as final_text, 1 as adj_pos
from fx_regions where k <> 6
""",
}


def needed(names: list[str]) -> list[str]:
    """The views and all that they build on, in order."""
    wanted = set(names)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted |= {other for other in VIEWS if f" {other} " in VIEWS[name].replace("\n", " ") + " "}
    return [name for name in VIEWS if name in wanted]


#: The same rows as those of VIEWS for Spark. A page stands for its l_orderkey, one to one, so boxes are numbered along the keys that all joins and groups ask for, and
#: one exchange serves them; lines of a text are taken off in one pass, where substring() begins at the front for each of them.
_COLUMNS = """cast(floor(l_orderkey / 3) as bigint) as sequence_id,
       cast(l_orderkey % 3 as int) as page_index,"""
ON_SPARK = {
    "fx_regions": VIEWS["fx_regions"].replace(_COLUMNS, "sequence_id, page_index,").replace("partition by l_orderkey", "partition by sequence_id, page_index").replace("from lineitem", "from _paged"),
    "fx_pages": "select distinct sequence_id, page_index, 1200 as width, 1500 as height, (sequence_id % 4) <> 0 as layout_ran from fx_regions",
    "fx_lines": """
select doc_id * 1000000 + line as region_id, text, n_chars from (select doc_id, n_chars,
       posexplode(case when length(text) > 0 then regexp_extract_all(text, '(?s).{1,60}', 0) else array(text) end) as (line, text) from documents) as lines
""",
}
_PAGE = ["sequence_id", "page_index"]


def load(spark: SparkSession, sf_dir: str, *names: str, by: list[str] | None = None, held: bool = True, by_document: bool = False) -> tuple[DataFrame, ...]:
    """The views by name. With by, fx_regions is dealt out by these keys and, for queries that ask for it or for what is made of it several times, held.

    With by_document, fx_lines and fx_candidates have their doc_id, too: by it they are dealt out as they come, so what is grouped or joined by it and more needs no exchange.
    """
    wanted = needed([*names, "fx_regions"] if by or "fx_pages" in needed(list(names)) else list(names))
    for table in TABLES:
        if any(f" {table}" in VIEWS[name].replace("\n", " ") for name in wanted):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            if table == "documents" and "fx_lines" in wanted:
                # A file of few row groups would be read, and its texts worked through, by as few tasks.
                rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
            rows.createOrReplaceTempView(table)
    if "fx_regions" in wanted:
        # A number of partitions that is named is kept, so what is made of the boxes meets them without another exchange.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"select *, {_COLUMNS[:-1]} from lineitem").repartition(parts, *(by or _PAGE)).createOrReplaceTempView("_paged")
    for name in wanted:
        sql = ON_SPARK.get(name, VIEWS[name])
        view = spark.sql(sql.replace("select ", "select doc_id, ", 1) if by_document and name in ("fx_lines", "fx_candidates") else sql)
        if by and held and name == "fx_regions":
            hold(view)
        view.createOrReplaceTempView(name)
    return tuple(spark.table(name) for name in names)


_held: list[DataFrame] = []


def hold(*tables: DataFrame, too: bool = False) -> tuple[DataFrame, ...]:
    """tables, persisted for the query that is being built; those of the query before are released, unless these are held too."""
    while _held and not too:
        _held.pop().unpersist()
    _held.extend(t.persist() for t in tables)
    return tables


def with_views(sql: str, *names: str) -> str:
    """sql for DuckDB with the views as common table expressions."""
    views = {name: VIEWS[name].replace("explode(sequence(", "unnest(generate_series(").replace("named_struct(", "json_object(") for name in needed(list(names))}
    return "WITH " + ", ".join(f"{name} AS ({view})" for name, view in views.items()) + (", " + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else "\n" + sql)
