"""Reconciliation of order, adjudications, speakers and identities; rules over the result; rows to submit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Types that are told, not said.
NARRATION = ["narration", "thought", "sound_effect", "sign", "title", "metadata", "document_text", "vocalisation"]
BALLOON = ["sequence_id", "page_index", "balloon_pos"]


def normalize_labels(label: Column) -> Column:
    """A bare label of capitals becomes Character X."""
    return F.when(label.rlike("^[A-Z]+$"), F.concat(F.lit("Character "), label)).otherwise(label)


#: Codes of resolve_sequence and consistency_checks with their severity. Fixed values.
SEVERITY = {
    "balloon_not_in_any_page": "error", "missing_adjudication_result": "error", "page_index_mismatch": "warning", "no_speaker_resolved": "warning", "invalid_speaker_character_reference": "error",
    "no_identity_result": "warning", "speaker_identity_unresolved": "warning", "speaker_identity_label_missing": "error", "speaker_identity_ambiguous": "warning",
    "identity_label_conflict": "error", "same_page_identity_collapse": "error", "excluded_balloon_in_story": "error", "page_order_violation": "error", "duplicate_balloon_in_sequence": "error", "identity_references_unknown_character": "error",
}


class Resolution(NamedTuple):
    """Balloons of the story, balloons that are left out of it, and items that cannot be told, with the codes of all."""

    ordered: DataFrame
    excluded: DataFrame
    unresolved: DataFrame
    diagnostics: DataFrame


def resolve_sequence(order: DataFrame, balloons: DataFrame, adjudications: DataFrame, speakers: DataFrame, characters: DataFrame, identity: DataFrame) -> DataFrame:
    """Every item of the reading order with its place, text, speaker and state, what became of it, and the codes of what is wrong with it.

    order: sequence_id, balloon_id, sequence_position, page_index. balloons: sequence_id, balloon_id, page_index, panel_pos; the page is theirs,
    whatever the order says. adjudications: sequence_id, balloon_id, adj_pos, text_type, include_in_story, final_text, and speakers: sequence_id, balloon_id,
    decision_pos, character_id: the first of a balloon counts. characters: sequence_id, character_id. identity: sequence_id, character_id, identity_id, label,
    state; a sequence without any row has no identity result. resolution is ordered, excluded (left out by its adjudication) or unresolved (no page
    or no adjudication; reason says which). identity_state: null where no identity is asked for, else unmatched, ambiguous or the cluster's.
    """
    key = ["sequence_id", "balloon_id"]
    # What is known of a balloon, and of a character, is one group each, so the order is dealt out twice: by balloon, then by character.
    first = lambda position, *columns: F.struct(position, *columns)
    facts = {"_place": (balloons, first(F.coalesce("page_index", F.lit(1 << 30)).alias("_p"), "page_index", "panel_pos")), "_said": (adjudications, first("adj_pos", "text_type", "include_in_story", "final_text")), "_by": (speakers, first("decision_pos", "character_id"))}
    known = None
    for name, (rows, fact) in facts.items():
        part = rows.select(*key, fact.alias(name))
        known = part if known is None else known.unionByName(part, allowMissingColumns=True)
    known = known.groupBy(*key).agg(*[F.min(name).alias(name) for name in facts]).select(
        *key, F.col("_place.page_index").alias("page_index"), "_place.panel_pos", F.when(F.col("_place").isNotNull(), True).alias("_placed"), "_said.text_type", "_said.include_in_story", "_said.final_text", F.when(F.col("_said").isNotNull(), True).alias("_adj"), "_by.character_id"
    )
    person = characters.select("sequence_id", "character_id").distinct().withColumn("_person", F.lit(True))
    named = identity.select("sequence_id", "character_id", "identity_id", F.struct("identity_id", "label", "state").alias("_named"))
    cast = person.unionByName(named, allowMissingColumns=True).groupBy("sequence_id", "character_id").agg(F.max("_person").alias("_person"), F.min("_named").alias("_named"), F.min("identity_id").alias("identity_id"))
    cast = cast.select("sequence_id", "character_id", "_person", "identity_id", "_named.label", "_named.state")
    identified = identity.select("sequence_id").distinct().withColumn("_identified", F.lit(True))
    joined = order.select(*key, "sequence_position", F.col("page_index").alias("_order_page")).join(identified, "sequence_id", "left").join(known, key, "left").join(cast, ["sequence_id", "character_id"], "left")
    placed, adjudicated = F.col("_placed").isNotNull(), F.col("_adj").isNotNull()
    usable = placed & adjudicated
    told = F.coalesce(F.col("text_type").isin(NARRATION), F.lit(False))
    asked = usable & ~told
    code = (
        F.when(F.col("character_id").isNull(), "no_speaker_resolved").when(F.col("_person").isNull(), "invalid_speaker_character_reference").when(F.col("_identified").isNull(), "no_identity_result")
        .when(F.col("identity_id").isNull(), "speaker_identity_unresolved").when(F.col("label").isNull(), "speaker_identity_label_missing").when(F.col("state") == "ambiguous", "speaker_identity_ambiguous")
    )
    codes = F.array_compact(F.array(F.when(~adjudicated, "missing_adjudication_result"), F.when(~placed, "balloon_not_in_any_page"), F.when(usable & ~F.col("_order_page").eqNullSafe(F.col("page_index")), "page_index_mismatch"), F.when(asked, code)))
    named_speaker = asked & F.col("_person").isNotNull() & F.col("_identified").isNotNull()
    include = F.coalesce("include_in_story", F.lit(False))
    state = F.when(~named_speaker, F.lit(None)).when(F.col("identity_id").isNull(), "unmatched").when(F.col("label").isNull(), "ambiguous").otherwise(F.coalesce("state", F.lit("unmatched")))
    return joined.select(
        "sequence_id", "sequence_position", "page_index", "panel_pos", "balloon_id", "text_type", "include_in_story", "final_text", F.when(usable, F.col("character_id")).alias("character_id"),
        F.when(named_speaker, F.col("identity_id")).alias("identity_id"), F.when(usable & told, "NARRATION").when(named_speaker & F.col("identity_id").isNotNull(), normalize_labels(F.col("label"))).alias("speaker"),
        F.when(asked & F.col("_person").isNotNull() & F.col("_identified").isNull(), "unmatched").otherwise(state).alias("identity_state"),
        F.when(~usable, "unresolved").when(include, "ordered").otherwise("excluded").alias("resolution"), F.when(~placed, "balloon_not_in_any_page").when(~adjudicated, "missing_adjudication_result").alias("reason"), codes.alias("codes"),
    )


def _severity(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[code]


def diagnostics(resolved: DataFrame) -> DataFrame:
    """(sequence_id, page_index, balloon_id, component, code, severity), a row per code."""
    rows = resolved.select("sequence_id", "page_index", "balloon_id", F.lit("sequence_resolver").alias("component"), F.explode("codes").alias("code"))
    return rows.withColumn("severity", _severity(F.col("code")))


def split_resolution(resolved: DataFrame) -> Resolution:
    """The three outputs and the codes of resolve_sequence(); persist resolved where several are used."""
    part = lambda name: resolved.where(F.col("resolution") == name)
    ends = ["reason", "codes", "resolution"]
    return Resolution(part("ordered").drop(*ends), part("excluded").drop(*ends), part("unresolved").select("sequence_id", "sequence_position", "balloon_id", "page_index", "reason"), diagnostics(resolved))


def identity_summary(members: DataFrame) -> DataFrame:
    """(sequence_id, cluster, members, pages) with both in order."""
    return members.groupBy("sequence_id", "cluster").agg(F.sort_array(F.collect_list("character_id")).alias("members"), F.sort_array(F.collect_set("page_index")).alias("pages"))


def _rows(parts: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """The union of parts, each with all columns; those that a part does not have are null."""
    out = None
    for part in parts:
        whole = part.select(*[F.col(c).cast(t).alias(c) if c in part.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
        out = whole if out is None else out.unionByName(whole)
    return out


def _several_labels(ordered: DataFrame) -> DataFrame:
    named = ordered.where("identity_id IS NOT NULL AND speaker IS NOT NULL")
    return named.groupBy("sequence_id", "identity_id").agg(F.countDistinct("speaker").alias("n")).where("n > 1")


def _again(ordered: DataFrame) -> DataFrame:
    """Balloons of the story after their first time."""
    along = Window.partitionBy("sequence_id", "balloon_id").orderBy("sequence_position")
    return ordered.withColumn("_n", F.row_number().over(along)).where("_n > 1")


def _back(ordered: DataFrame) -> DataFrame:
    """Balloons of the story whose page is before that of the balloon before them."""
    along = Window.partitionBy("sequence_id").orderBy("sequence_position", "balloon_id")
    return ordered.withColumn("_prev", F.lag("page_index").over(along)).where("page_index < _prev")


def consistency_checks(ordered: DataFrame, identity: DataFrame, characters: DataFrame) -> DataFrame:
    """(sequence_id, code, severity, page_index, balloon_id, identity_id, character_id) of what contradicts itself.

    ordered: the story's balloons, as split_resolution() gives them; those that are left out are none of them. identity: sequence_id, character_id,
    identity_id; characters: sequence_id, page_index, character_id. One row per identity with several labels, per page and identity with several
    characters there, per balloon that is out of the story, on an earlier page than the one before or there again, and per character
    that has an identity but is not there.
    """
    one = identity.select("sequence_id", "character_id", "identity_id").distinct()
    there = characters.select("sequence_id", "page_index", "character_id").distinct()
    parts = [
        _several_labels(ordered).withColumn("code", F.lit("identity_label_conflict")),
        there.join(one, ["sequence_id", "character_id"]).groupBy("sequence_id", "page_index", "identity_id").agg(F.countDistinct("character_id").alias("n")).where("n > 1").withColumn("code", F.lit("same_page_identity_collapse")),
        ordered.where(~F.coalesce("include_in_story", F.lit(False))).select("sequence_id", "balloon_id").withColumn("code", F.lit("excluded_balloon_in_story")),
        _back(ordered).select("sequence_id", "balloon_id", "page_index").withColumn("code", F.lit("page_order_violation")),
        _again(ordered).select("sequence_id", "balloon_id").withColumn("code", F.lit("duplicate_balloon_in_sequence")),
        one.where("identity_id IS NOT NULL").join(there, ["sequence_id", "character_id"], "left_anti").select("sequence_id", "character_id").withColumn("code", F.lit("identity_references_unknown_character")),
    ]
    types = {c: dict(df.dtypes)[c] for df, c in ((ordered, "sequence_id"), (ordered, "page_index"), (ordered, "balloon_id"), (identity, "identity_id"), (identity, "character_id"))}
    found = _rows(parts, {"sequence_id": types["sequence_id"], "code": "string", **{c: types[c] for c in ("page_index", "balloon_id", "identity_id", "character_id")}})
    return found.withColumn("severity", _severity(F.col("code")))


def validate_resolution(ordered: DataFrame, excluded: DataFrame, characters: DataFrame, identities: DataFrame, expected: DataFrame) -> DataFrame:
    """(sequence_id, rule, page_index, balloon_id, identity_id, label) of all violations; what a rule does not speak of is null.

    ordered and excluded as split_resolution() gives them; only the range of pages is asked of balloons that are left out. characters: sequence_id, character_id;
    identities: sequence_id, identity_id, label; expected: sequence_id. Rules on rows of the story are judged in one pass; the others are one aggregate
    or anti-join each.
    """
    labels = identities.select("sequence_id", normalize_labels(F.col("label")).alias("speaker")).distinct().withColumn("_label", F.lit(True))
    people = characters.select("sequence_id", "character_id").distinct().withColumn("_person", F.lit(True))
    in_range = F.coalesce(F.col("page_index").between(0, 2), F.lit(False))
    rules = F.array_compact(F.array(
        F.when(~in_range, "all_page_indices_valid"),
        F.when(~F.coalesce("include_in_story", F.lit(False)), "story_excluded_balloons_absent"),
        F.when(T.blank(F.col("balloon_id").cast("string")), "every_balloon_has_source_id"),
        F.when(T.blank(F.col("final_text")), "text_exists_for_story_balloons"),
        F.when(F.col("character_id").isNotNull() & F.col("_person").isNull(), "speaker_references_valid_character"),
        F.when(F.col("speaker").isNotNull() & (F.col("speaker") != "NARRATION") & F.col("_label").isNull(), "speaker_label_maps_to_valid_identity"),
    ))
    checked = ordered.join(people, ["sequence_id", "character_id"], "left").join(labels, ["sequence_id", "speaker"], "left")
    of_row = checked.select("sequence_id", "page_index", "balloon_id", F.col("speaker").alias("label"), F.explode(rules).alias("rule"))
    parts = [
        of_row.withColumn("label", F.when(F.col("rule") == "speaker_label_maps_to_valid_identity", F.col("label"))),
        excluded.where(~in_range).select("sequence_id", "page_index", "balloon_id", F.lit("all_page_indices_valid").alias("rule")),
        ordered.where(~in_range).select("sequence_id", F.lit("exactly_three_pages").alias("rule")).distinct(),
        _again(ordered).select("sequence_id", "page_index", "balloon_id", F.lit("no_duplicate_balloon").alias("rule")),
        _back(ordered).select("sequence_id", "page_index", "balloon_id", F.lit("page_order_monotonic").alias("rule")),
        _several_labels(ordered).select("sequence_id", "identity_id", F.lit("no_identity_label_conflicts").alias("rule")),
        identities.where("label <> 'NARRATION'").groupBy("sequence_id", "label").agg(F.countDistinct("identity_id").alias("n")).where("n > 1").select("sequence_id", "label", F.lit("sequence_labels_deterministic").alias("rule")),
        ordered.select("sequence_id").unionByName(excluded.select("sequence_id")).distinct().join(expected.select("sequence_id").distinct(), "sequence_id", "left_anti").select("sequence_id", F.lit("no_output_references_different_sequence").alias("rule")),
    ]
    types = dict(ordered.dtypes)
    return _rows(parts, {"sequence_id": types["sequence_id"], "rule": "string", "page_index": types["page_index"], "balloon_id": types["balloon_id"], "identity_id": dict(identities.dtypes)["identity_id"], "label": "string"})


def submission_speaker(speaker: Column, state: Column) -> Column:
    return F.when(T.blank(speaker), "UNKNOWN").when(speaker == "NARRATION", "NARRATION").when(state == "ambiguous", "UNKNOWN").otherwise(speaker)


def submission_rows(ordered: DataFrame) -> DataFrame:
    """(sequence_id, page_index, line_index, speaker, text) of the story's balloons: pages 0 to 2, rows with text, in order."""
    kept = ordered.where(F.col("page_index").between(0, 2) & ~T.blank(F.col("final_text")))
    line = F.row_number().over(Window.partitionBy("sequence_id", "page_index").orderBy("sequence_position")) - 1
    return kept.select("sequence_id", "page_index", line.alias("line_index"), submission_speaker(F.col("speaker"), F.col("identity_state")).alias("speaker"), T.strip(F.col("final_text")).alias("text"))


def validate_submission(rows: DataFrame, template: DataFrame) -> DataFrame:
    """(sequence_id, items, empty_pages, in_template, in_rows): both sides' sequences, and what is in them."""
    mine = rows.groupBy("sequence_id").agg(F.count("*").alias("items"), F.countDistinct("page_index").alias("pages"))
    both = template.select("sequence_id", F.lit(True).alias("t")).join(mine.withColumn("r", F.lit(True)), "sequence_id", "full")
    return both.select("sequence_id", F.coalesce("items", F.lit(0)).alias("items"), (3 - F.coalesce("pages", F.lit(0))).alias("empty_pages"), F.coalesce("t", F.lit(False)).alias("in_template"), F.coalesce("r", F.lit(False)).alias("in_rows"))


def submission_errors(rows: DataFrame, template: DataFrame, pages: int = 3) -> DataFrame:
    """(sequence_id, page_index, error) of what a submission must not be; errors of a whole sequence have no page.

    rows: (position, sequence_id, pages array<array<struct<speaker, text>>>); template: (position, sequence_id). Ids must be unique and those of
    the template, in its order; each has so many pages, else its items are not looked at; items need a speaker and a text that are not blank, and no placeholder.
    """
    none = F.lit(None).cast("int").alias("page_index")
    at = rows.select("position", F.col("sequence_id").alias("_mine")).join(template.select("position", "sequence_id"), "position", "full")
    items = rows.where(F.size("pages") == pages).select("sequence_id", F.posexplode("pages").alias("page_index", "page")).select("sequence_id", "page_index", F.explode("page").alias("item"))
    blank = lambda c: T.blank(F.col(c))
    error = F.when(F.col("item").isNull() | blank("item.speaker") | blank("item.text"), "invalid_item").when(F.col("item.text").startswith("[balloon "), "placeholder")
    found = [
        rows.groupBy("sequence_id").count().where("count > 1").select("sequence_id", none, F.lit("not_unique").alias("error")),
        at.where(~F.col("_mine").eqNullSafe(F.col("sequence_id"))).select(F.coalesce("_mine", "sequence_id").alias("sequence_id"), none, F.lit("not_as_in_template").alias("error")),
        rows.where(F.coalesce(F.size("pages"), F.lit(-1)) != pages).select("sequence_id", none, F.lit("page_count").alias("error")),
        items.withColumn("error", error).where("error IS NOT NULL").select("sequence_id", "page_index", "error"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def speaker_histogram(rows: DataFrame, pages: int = 3) -> DataFrame:
    """(speaker, n) of the items of a submission that are in order, of sequences with so many pages; rows as for submission_errors()."""
    items = rows.where(F.size("pages") == pages).select(F.explode("pages").alias("page")).select(F.explode("page").alias("item"))
    sound = ~T.blank(F.col("item.speaker")) & ~T.blank(F.col("item.text")) & ~F.col("item.text").startswith("[balloon ")
    return items.where(sound).groupBy(F.col("item.speaker").alias("speaker")).agg(F.count("*").alias("n"))


def missing_rows(order: DataFrame, adjudications: DataFrame, speakers: DataFrame, characters: DataFrame, expected: DataFrame) -> DataFrame:
    """(sequence_id, page_index, balloon_pos, missing): balloons without adjudication, speakers that are no known character, sequences that nobody expects."""
    unsaid = order.select(*BALLOON).join(adjudications.select(*BALLOON).distinct(), BALLOON, "left_anti").withColumn("missing", F.lit("adjudication"))
    unknown = speakers.where("character_id IS NOT NULL").join(characters.select("sequence_id", "character_id").distinct(), ["sequence_id", "character_id"], "left_anti").select(*BALLOON, F.lit("character").alias("missing"))
    foreign = order.select("sequence_id").distinct().join(expected, "sequence_id", "left_anti")
    none = [F.lit(None).cast(dict(order.dtypes)[c]).alias(c) for c in ("page_index", "balloon_pos")]
    return unsaid.unionByName(unknown).unionByName(foreign.select("sequence_id", *none, F.lit("sequence").alias("missing")))


def check_split(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Sequences that are in both."""
    return train.select("sequence_id").intersect(held_out.select("sequence_id"))


def character_graph(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(sequence_id, a_id, b_id, score, matched): identity edges, matched if both ends are in one cluster."""
    m = members.select("sequence_id", "character_id", "cluster")
    a, b = m.withColumnsRenamed({"character_id": "a_id", "cluster": "ca"}), m.withColumnsRenamed({"character_id": "b_id", "cluster": "cb"})
    return edges.join(a, ["sequence_id", "a_id"]).join(b, ["sequence_id", "b_id"]).select("sequence_id", "a_id", "b_id", "score", (F.col("ca") == F.col("cb")).alias("matched"))


def graph_nodes(members: DataFrame) -> DataFrame:
    """(sequence_id, page_index, character_id, cluster, size): the nodes of a character graph, with the size of their cluster."""
    return members.select("sequence_id", "page_index", "character_id", "cluster", F.count("*").over(Window.partitionBy("sequence_id", "cluster")).alias("size"))


def speaker_links(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """(BALLOON, character_id, cluster) of balloons with a speaker; the cluster is null for a character of none."""
    said = decisions.where("character_id IS NOT NULL").select(*BALLOON, "character_id")
    return said.join(members.select("sequence_id", "character_id", "cluster").distinct(), ["sequence_id", "character_id"], "left").select(*BALLOON, "character_id", "cluster")
