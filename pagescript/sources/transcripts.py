"""Manifests and transcripts: JSON in and out, with rejected rows beside the good ones."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded

MANIFEST = "sequence_id string, split string, images array<string>"
SPLITS = ["development", "test"]


def check_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason)."""
    reason = F.when(F.trim(F.coalesce("sequence_id", F.lit(""))) == "", "missing_id").when(~F.coalesce(F.col("split").isin(SPLITS), F.lit(False)), "bad_split").when(F.coalesce(F.size("images"), F.lit(-1)) != 3, "bad_images")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def refuse(rejected: DataFrame, reason: str) -> None:
    """An error that names some of the rejected rows, if there are any."""
    found = rejected.select("sequence_id", reason).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.sequence_id}: {r[reason]}" for r in found))


def read_sequences(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """A manifest that is one JSON array: (good rows, rejected rows with a reason); with strict, rejected rows are an error."""
    good, bad = check_manifest(spark.read.schema(MANIFEST).json(path, multiLine=True))
    if strict:
        refuse(bad, "reason")
    return good, bad


def sequences_by_split(sequences: DataFrame, split: str) -> DataFrame:
    return sequences.where(F.col("split") == split)


def explode_pages(sequences: DataFrame) -> DataFrame:
    return sequences.select("sequence_id", "split", F.posexplode("images").alias("page_index", "image_path"))


def missing_files(spark: SparkSession, pages: DataFrame, root: str) -> DataFrame:
    """Rows of pages (image_path, relative to root) without a file under root. Files are listed, not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    relative = F.element_at(F.split("path", F.concat(F.lit(r"\Q"), F.lit(root.split(":", 1)[-1].rstrip("/")), F.lit(r"/\E")), 2), -1)
    return pages.join(listed.select(relative.alias("image_path")), "image_path", "left_anti")


def _check(row, pages: int, reference: bool, normal) -> None:
    """Raises ValueError for what a transcript must not be; with reference, UNKNOWN speakers become None."""
    if not isinstance(row, dict) or set(row) != {"sequence_id", "pages"}:
        raise ValueError("expected exactly sequence_id and pages")
    named = lambda x: isinstance(x, str) and x == x.strip() and x != ""
    if not named(row["sequence_id"]):
        raise ValueError("sequence_id must be a nonempty, trimmed string")
    if not isinstance(row["pages"], list) or len(row["pages"]) != pages:
        raise ValueError(f"pages must be {pages} lists")
    for page in row["pages"]:
        if not isinstance(page, list):
            raise ValueError("a page must be a list")
        for item in page:
            if not isinstance(item, dict) or set(item) != {"speaker", "text"}:
                raise ValueError("a line needs exactly speaker and text")
            if reference and item["speaker"] == "UNKNOWN":
                item["speaker"] = None
            if not (named(item["speaker"]) or reference and item["speaker"] is None):
                raise ValueError("speaker must be a nonempty, trimmed string")
            if not isinstance(item["text"], str) or not normal(item["text"]).strip():
                raise ValueError("text must be nonempty")
            if any(unicodedata.category(ch) == "Cc" and not ch.isspace() for ch in item["text"]):
                raise ValueError("control character in a text")


def _parser(pages: int, reference: bool):
    """An Arrow map of strict lines: exact keys, none twice. Blank lines are left out."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("speaker", pa.string()), ("text", pa.string())])
        for batch in batches:
            out: dict[str, list] = {"sequence_id": [], "pages": [], "error": []}
            for line in batch.column(0).to_pylist():
                if line is None or not line.strip():
                    continue
                error = row = None
                try:
                    row = json.loads(line, object_pairs_hook=once)
                    _check(row, pages, reference, folded)
                except (ValueError, TypeError, RecursionError) as found:
                    error = str(found)[:80] or type(found).__name__
                named = row.get("sequence_id") if isinstance(row, dict) else None
                out["sequence_id"].append(named if isinstance(named, str) else None)
                out["pages"].append(row["pages"] if error is None else None)
                out["error"].append(error)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("sequence_id", pa.string()), ("pages", pa.list_(pa.list_(item))), ("error", pa.string())]))

    return parse


def read_transcripts(lines: DataFrame, pages: int = 3, reference: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sequence_id, page_index, line_index, speaker, text; rejected lines with an error) of lines (value: one JSON text each).

    With reference, an UNKNOWN speaker is null, and null is allowed. A sequence that comes twice is an error. With strict, rejected
    lines are an error of the call.
    """
    checked = lines.select("value").mapInArrow(_parser(pages, reference), "sequence_id string, pages array<array<struct<speaker:string,text:string>>>, error string")
    times = checked.where("error IS NULL").groupBy("sequence_id").agg(F.count("*").alias("_n")).where("_n > 1")
    good = checked.where("error IS NULL").join(times, "sequence_id", "left_anti")
    bad = checked.where("error IS NOT NULL").select("sequence_id", "error").unionByName(times.select("sequence_id", F.lit("duplicate").alias("error")))
    if strict:
        refuse(bad, "error")
    items = good.select("sequence_id", F.posexplode("pages").alias("page_index", "page")).select("sequence_id", "page_index", F.posexplode("page").alias("line_index", "item"))
    return items.select("sequence_id", "page_index", "line_index", F.col("item.speaker").alias("speaker"), F.col("item.text").alias("text")), bad


def transcript_lines(rows: DataFrame, sequences: DataFrame, pages: int = 3) -> DataFrame:
    """(sequence_id, value): one JSON text per sequence with all its pages, empty ones too."""
    entry = F.struct("page_index", "line_index", "speaker", "text")
    grouped = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    page = lambda p: F.transform(F.filter(F.coalesce("items", F.array().cast(grouped.schema["items"].dataType)), lambda x: x["page_index"] == p), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text")))
    joined = sequences.select("sequence_id").distinct().join(grouped, "sequence_id", "left")
    shaped = F.struct(F.col("sequence_id"), F.transform(F.sequence(F.lit(0), F.lit(pages - 1)), page).alias("pages"))
    return joined.select("sequence_id", F.to_json(shaped, {"ignoreNullFields": "false"}).alias("value"))


def write_transcripts(rows: DataFrame, sequences: DataFrame, path: str) -> None:
    transcript_lines(rows, sequences).select("value").write.text(path)


def read_oracle_rows(spark: SparkSession, paths: list[str], schema: str, sequence_id: str | None = None) -> DataFrame:
    """Rows of many JSON-lines files, each with the name of its file."""
    rows = spark.read.schema(schema).json(paths).withColumn("file_name", F.col("_metadata.file_name"))
    return rows if sequence_id is None else rows.where(F.col("sequence_id") == sequence_id)


def table_sink(rows: DataFrame, path: str, partition_by: str = "split") -> None:
    rows.write.partitionBy(partition_by).parquet(path)


def resume_pending(manifest: DataFrame, completed: DataFrame, engine: str) -> DataFrame:
    """Sequences that do not have exactly one output of this engine that passed."""
    done = completed.where((F.col("engine") == engine) & F.col("passed")).groupBy("sequence_id").count().where("count = 1")
    return manifest.join(done, "sequence_id", "left_anti")
