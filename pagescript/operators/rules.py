"""Rules on records as data, compiled to few passes: all rules on a row's own fields in one, one aggregate per unique key, one anti-join per owner."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import TYPES


@dataclass
class Record:
    """The rules of one kind of record.

    ids: columns that name a row in what is reported. filled: texts that must not be blank. shares: numbers from 0 to 1 or null. kinds: column -> allowed
    values; null is none of them unless it is listed. unique: rule -> columns that no two rows agree in. owned: rule -> (columns, owner table, its
    columns): each row needs one there. more: rule -> what must hold.
    """

    ids: list[str]
    filled: list[str] = field(default_factory=list)
    shares: list[str] = field(default_factory=list)
    kinds: dict[str, list[str | None]] = field(default_factory=dict)
    unique: dict[str, list[str]] = field(default_factory=dict)
    owned: dict[str, tuple[list[str], str, list[str]]] = field(default_factory=dict)
    more: dict[str, Column] = field(default_factory=dict)


#: The sources of candidates, and the kinds of everything else.
SOURCES = ["ocr_base", "ocr_upscale", "ocr_contrast", "ocr_threshold", "ocr_rotate_cw", "ocr_rotate_ccw", "nemotron", "qwen3_vl", "fused"]
GROUPING = ["layout_model", "geometry", "containment", "hybrid", "visual_fallback"]
IDENTITY_METHODS = ["visual_embedding", "face_embedding", "body_embedding", "combined_embedding", "fallback_geometry", "injected"]

_PAGE = ["sequence_id", "page_index"]


def records() -> dict[str, Record]:
    """The rules of every kind of record that the operators read. Tables need the columns that their rules name."""
    sound = F.coalesce((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    return {
        "sequences": Record(["sequence_id"], ["sequence_id"], kinds={"split": ["development", "test"]}, unique={"unique_sequence": ["sequence_id"]}, more={"three_images": F.size("images") == 3}),
        "regions": Record([*_PAGE, "region_id"], ["region_id"], ["confidence"], {"category": TYPES}, {"unique_region": [*_PAGE, "region_id"]}, more={"sound_box": sound}),
        "panels": Record([*_PAGE, "panel_id"], ["panel_id"], ["confidence"], {"source": ["layout_model", "page_fallback"]}, {"unique_panel": [*_PAGE, "panel_id"]}, more={"sound_box": sound}),
        "balloons": Record([*_PAGE, "balloon_id"], ["balloon_id"], ["confidence"], {"grouping_method": GROUPING, "kind": ["speech", "thought", "narration", "unknown"]}, {"unique_balloon": [*_PAGE, "balloon_id"]}),
        "members": Record([*_PAGE, "balloon_id", "region_id"], unique={"unique_member": [*_PAGE, "balloon_id", "region_id"]}, owned={"balloon_of_member": ([*_PAGE, "balloon_id"], "balloons", [*_PAGE, "balloon_id"]), "region_of_member": ([*_PAGE, "region_id"], "regions", [*_PAGE, "region_id"])}),
        "candidates": Record(
            [*_PAGE, "region_id", "candidate_id"], ["candidate_id", "region_id", "text"], ["ocr_confidence", "visual_confidence"], {"source": SOURCES, "semantic_type": TYPES},
            {"unique_candidate": [*_PAGE, "region_id", "candidate_id"]}, {"region_of_candidate": ([*_PAGE, "region_id"], "regions", [*_PAGE, "region_id"])},
        ),
        # What an adjudicator is asked: a row per balloon and candidate; its region must be a member of the balloon.
        "adjudication_inputs": Record([*_PAGE, "balloon_id", "candidate_id"], ["balloon_id", "candidate_id", "region_id"], unique={"unique_input": [*_PAGE, "balloon_id", "candidate_id"]}, owned={"region_of_balloon": ([*_PAGE, "balloon_id", "region_id"], "members", [*_PAGE, "balloon_id", "region_id"])}),
        "adjudications": Record([*_PAGE, "balloon_id"], ["balloon_id"], ["confidence"], {"text_type": TYPES}, more={"text_of_story": ~F.coalesce("include_in_story", F.lit(False)) | ~T.blank(F.col("final_text"))}),
        "decisions": Record([*_PAGE, "balloon_id"], ["balloon_id"], ["confidence"], {"method": ["geometry", "visual", "hybrid", "unknown"]}),
        "identity_edges": Record(["sequence_id", "a_id", "b_id"], [], ["combined_score", "confidence"], {"method": IDENTITY_METHODS}),
        "identities": Record(["sequence_id", "identity_id"], ["identity_id", "label"], ["confidence"], {"state": ["matched", "unmatched", "ambiguous"]}, {"unique_identity": ["sequence_id", "identity_id"], "unique_label": ["sequence_id", "label"]}),
        "diagnostics": Record(["sequence_id", "code"], ["code"], kinds={"severity": ["info", "warning", "error"]}),
    }


def violations(name: str, record: Record, rows: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(record, rule, key, n) of what breaks a rule: key holds the ids of the row, or the columns that several rows agree in, as JSON; n is how many rows.

    tables: the owners, by name; a rule whose owner is not given is not asked.
    """
    known = set(rows.columns)
    named = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    own = {f"filled_{c}": ~T.blank(F.col(c).cast("string")) for c in record.filled if c in known}
    own |= {f"range_{c}": F.col(c).isNull() | (F.col(c).between(0, 1) & ~F.isnan(F.col(c).cast("double"))) for c in record.shares if c in known}
    own |= {f"kind_{c}": F.coalesce(F.col(c).isin([v for v in allowed if v is not None]), F.lit(None in allowed)) for c, allowed in record.kinds.items() if c in known}
    own |= record.more
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), rule) for rule, holds in own.items()])) if own else F.array().cast("array<string>")
    parts = [rows.select(F.explode(broken).alias("rule"), named(record.ids).alias("key"), F.lit(1).cast("long").alias("n"))]
    for rule, columns in record.unique.items():
        parts.append(rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), named(columns).alias("key"), "n"))
    for rule, (columns, owner, its) in record.owned.items():
        if owner in (tables or {}):
            owners = tables[owner].select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(its)]).distinct()
            same = [F.col(c) == F.col(f"_{i}") for i, c in enumerate(columns)]
            parts.append(rows.join(owners, same, "left_anti").groupBy(*record.ids).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), named(record.ids).alias("key"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.lit(name).alias("record"), "rule", "key", "n")


def check_schema_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """violations() of all tables, by the names of records(); tables of other names have no rules."""
    rules = records()
    out = None
    for name, rows in tables.items():
        if name in rules:
            found = violations(name, rules[name], rows, tables)
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError(f"none of {sorted(tables)} is one of {sorted(rules)}")
    return out
