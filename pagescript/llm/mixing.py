"""Mixing sources to target weights by systematic sampling. Built-in expressions only.

Every document of a source expects ``target / source_size`` copies. The expected copies are summed along the source,
one random offset per source is added, and a document is emitted once for each integer that its step of the sum crosses.
The walk goes from small to large documents, so the words taken follow the target closely.

The prefix sum never gathers a source in one task: documents get a block (size class, hash bucket), blocks are counted,
the small table of counts is summed along each source, and only the rest of the sum is a window inside a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hex_unit

#: Hash buckets of one size class in one source. More buckets: smaller windows, a longer table of counts.
BUCKETS = 128
#: Size classes per doubling of the size.
CLASSES_PER_OCTAVE = 4


def source_targets(sources: DataFrame, max_ratio: float = 3.0) -> DataFrame:
    """Words that each source should give: (source, source_size) -> + target.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the total size by weight. No target exceeds
    max_ratio times its source's size; what is cut off goes to the others by weight, until none is above. That is the level L
    with ``sum(least(max_ratio * size, weight * L)) = total``: along rising ``size / weight``, the first source whose
    cap is above the level that holds when all before it are capped ends the capped ones.

    One row per source in and out; the windows without a partition run over sources, never over documents. An empty
    table gives an empty one; if all sizes are 0, all targets are 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.orderBy("cap_level", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("cap_level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("weights_before"))
    return (
        sources.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", (F.col("rank") % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(max_ratio))
        .withColumn("cap_level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("open", F.col("cap_level") > F.col("level"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct("cap_level", "rank", "level"))).over(everything)["level"])
        .select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("final"))).alias("target"))
    )


def mix(docs: DataFrame, seed: str = "mix", max_ratio: float = 3.0, buckets: int = BUCKETS) -> DataFrame:
    """Copies of each document in the mix: all columns of docs (but those of the names that follow) + size, source_size, target, copies, taken.

    size is the number of words of the text, 0 for a null text. A null source is a source of its own. Documents of no
    words take no part (copies 0 where their source's target is 0, else as any other; taken is 0 in any case).
    Repeated rows are separate documents; rows that agree in everything may swap their copies, which the result can't show.
    No document gets more than max_ratio copies, rounded up. The same rows give the same mix in every run.
    """
    taken = {"size", "source_size", "target", "copies", "taken"} & {c.lower() for c in docs.columns}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in taken])
    known = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    whole = docs.select("doc_id", "source", "text", F.xxhash64(*known).alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))
    sized = whole.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    # Rows without an id, and rows of one id, are told apart by their texts.
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce("text", F.lit(""))), F.lit("/"), F.lit(seed))
    octave = F.length(F.bin(F.col("size") + 1)) - 1
    keyed = sized.select(
        "doc_id",
        "source",
        "size",
        "_in",
        "_tie",
        name.alias("_name"),
        (F.lit(CLASSES_PER_OCTAVE) * octave + F.floor((F.col("size") + 1) * F.lit(CLASSES_PER_OCTAVE) / F.pow(F.lit(2.0), octave))).alias("_class"),
        F.floor(hex_unit(key) * F.lit(buckets)).cast("int").alias("_bucket"),
    )
    blocks = cut(keyed.groupBy("_name", "_class", "_bucket").agg(F.first("source").alias("source"), F.count("*").alias("_n"), F.sum("size").alias("_words")))
    targets = source_targets(blocks.groupBy("_name").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size")).drop("_name"), max_ratio)
    targets = targets.withColumn("_name", name).withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    along = Window.partitionBy("_name").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
        .join(targets.drop("source"), "_name")
        .select("_name", "_class", "_bucket", "_before", "_rate", "source_size", "target", hex_unit(F.concat(F.col("_name"), F.lit("/"), F.lit(seed))).alias("_offset"))
    )
    inside = Window.partitionBy("_name", "_class", "_bucket").orderBy("size", "doc_id", "_tie")
    upto = F.col("_before") + F.col("_row")
    crossed = F.floor(upto * F.col("_rate") + F.col("_offset")) - F.floor((upto - 1) * F.col("_rate") + F.col("_offset"))
    return (
        keyed.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["_name", "_class", "_bucket"])
        .withColumn("copies", F.least(crossed, F.ceil(F.lit(max_ratio))).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("_in.*", "size", "source_size", "target", "copies", "taken")
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """One row per copy: the mix itself, with a column copy from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
