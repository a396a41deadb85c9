"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions: blank and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
#: The same as a Java class; everything else is a word character.
WORD = r"[^\x20\x09-\x0D]+"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width: the one knob that a user sets to the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none and runs in one process (tests) a temporary folder is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def small_batches(df: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """df, with Arrow batches of about so many bytes in its session from now on, unless the session names another size.

    Spark's own bound is 64 MB, or 10,000 rows, of which the JVM and the Python worker of each task hold several.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(most_bytes))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder: lost executors cost no recomputation of what stands above."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: as cut(), but compressed and by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows, counted; as it is, for a shuffled join, if not.

    df must be cheap to compute twice: cut() it first.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hex_unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of a string; the same in every engine and rerun."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pieces(texts, most_bytes: int = 8 << 20):
    """Slices of an Arrow string array of about so many bytes each (a longer text stands alone), nulls made empty.

    Arrow hands over up to 64 MB at once; slices keep what the tasks derive from a batch small.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield texts.slice(at, to - at)
        at = to


def buffers(texts):
    """(bytes as uint8, offsets as int64 from 0) of an Arrow large_string array without nulls; no copy of the bytes."""
    import numpy as np

    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]
