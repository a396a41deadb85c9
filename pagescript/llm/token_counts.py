"""Token counts as rollups that deltas maintain.

Totals by source, language and tokenizer version are sums of signed rows: an insert adds a document's count, a delete takes it away, a
revision does both (of a document that moves to another source, language or version as well: delete it there, insert it here). A
ledger is a folder of batches, each a table of signed totals per group, and a folder of commits: a file for each batch id that names the
batch's table. The file is created exclusively, which file systems and object stores alike grant to one writer, so of several
commits of one id one counts; a commit that broke off leaves a table that nothing names. Compaction sums batches into one and names
those that it stands for, so that doing it again, or half of it, changes no total.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, small_batches

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def counter(vocabulary: str, pattern: str):
    """An Arrow function text -> number of tokens. vocabulary: path of a file of base64 tokens and ranks that all executors have.

    Whole texts, null and empty ones have none. The path is read once per task.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            found = [len(encode(text)) for texts in pieces(batch) for text in texts.to_pylist()]
            yield pa.array(found, pa.int64())

    return count


def counted(docs: DataFrame, vocabulary: str, pattern: str, version: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of all documents under one tokenizer version.

    Repeated rows count each; a null text has no tokens, but counts as a document; other columns are left out.
    """
    return small_batches(docs).select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), counter(vocabulary, pattern)(F.col("text")).alias("n_tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.lit(1), F.col("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, F.lit(-1), -F.col("n_tokens"))


def revisions(counts: DataFrame, new: Column) -> DataFrame:
    """The same documents with another count."""
    return _signed(counts, F.lit(0), new - F.col("n_tokens"))


def _signed(counts: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return counts.select(*KEYS, docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


class Ledger:
    """Committed batches under a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _read(self, name: str) -> str:
        """The table that a commit names; empty if its writer broke off."""
        stream = self._fs.open(self._path(f"{self.path}/commits/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _claim(self, name: str, content: str) -> bool:
        """Create a commit; False if there is one of that name, RuntimeError if that one is not finished.

        Only who creates the file may write to it, and nobody takes it away: whether its writer is at work or has broken off can't be told
        from here, so an unfinished commit stays until abandon().
        """
        path = self._path(f"{self.path}/commits/{name}")
        if self._finished(name):
            return False
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        return True

    def _finished(self, name: str) -> bool:
        """Whether there is a commit of that name; RuntimeError if it is not finished."""
        if not self._fs.exists(self._path(f"{self.path}/commits/{name}")):
            return False
        if not self._read(name):
            raise RuntimeError(f"{name} is being committed, or its writer broke off; abandon() it once no writer is left")
        return True

    def abandon(self, batch_id: str) -> bool:
        """Take away an unfinished commit whose writer is known to be gone; False if there is none, or it is finished."""
        name = f"batch={batch_id}"
        path = self._path(f"{self.path}/commits/{name}")
        return bool(self._fs.exists(path) and not self._read(name) and self._fs.delete(path, False))

    def _commits(self) -> dict[str, str]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return {}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return {name: content for name in names if not name.startswith(".") and (content := self._read(name))}

    def committed(self, batch_id: str) -> bool:
        return bool(self._commits().get(f"batch={batch_id}"))

    def _write(self, rows: DataFrame) -> str:
        name = f"table-{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows; False if the ledger has the id already. Rows of a group are summed before they are written."""
        if self.committed(batch_id):
            return False
        self._finished(f"batch={batch_id}")
        name = self._write(deltas)
        # If this raises, the table stays: the commit may name it already.
        if self._claim(f"batch={batch_id}", name):
            return True
        self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return False

    def _tables(self) -> tuple[list[str], list[str]]:
        """(tables that make the totals, batches in them): the compaction of most batches, and the batches that are not in it."""
        commits = self._commits()
        compacted = [content.split("\n") for name, content in commits.items() if name.startswith("compacted=")]
        table, *inside = max(compacted, key=lambda c: (len(c), c), default=[None])
        batches = {name: content for name, content in commits.items() if name.startswith("batch=")}
        rest = [content for name, content in sorted(batches.items()) if name not in set(inside)]
        return ([table] if table else []) + rest, sorted(batches)

    def compact(self) -> None:
        """One table in place of all batches so far. Their ids stay known, so none can be committed again."""
        tables, batches = self._tables()
        if len(tables) > 1:
            name = self._write(self._rows(tables))
            self._claim(f"compacted={name}", "\n".join([name, *batches]))

    def _rows(self, tables: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{t}" for t in tables])

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all batches; groups that have come to nothing are left out. Null is a group of its own."""
        tables, _ = self._tables()
        rows = self._rows(tables) if tables else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
