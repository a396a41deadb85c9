"""Chat formatting at the level of tokens.

A turn is OPEN role SEP text CLOSE. Role and text are encoded apart from each other and from everything else; OPEN, SEP and CLOSE are
reserved ids behind the vocabulary, which no text can encode to. Written out they are ``### ``, ``: `` and `` </turn>`` with a
line feed, and where a role or text has such a string itself, a backslash goes before it (before a backslash, and in roles before
every colon and at an end, too), so the written form can be read back as well: read_written() does. The loss mask covers the texts of the trained role: +1 and -1 at the ends of its
segments, summed along the tokens.

Rows are encoded where they are. The tokens of a conversation follow each other by turn; token_offset tells where a turn's begin,
so a conversation of any length never has to stand in one row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, pieces, small_batches

# The template.
OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPE_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: A turn in its written form: role up to the first bare separator, text up to the first bare end.
_WRITTEN = re.compile(rf"{re.escape(OPEN)}((?:\\.|[^\\:])*){re.escape(SEP)}((?:\\.|[^\\])*?){re.escape(CLOSE)}", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    """As escape(), and colons too: what stands before the first bare separator is the role."""
    return _ESCAPE_ROLE.sub(lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def read_written(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a written conversation."""
    turns, at = [], 0
    while at < len(text):
        found = _WRITTEN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


class Codec:
    """Ordinary encoding of a vocabulary file, and three ids behind it."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coder = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.encode, self.decode = coder.encode_ordinary, coder.decode
        self.open, self.sep, self.close = top, top + 1, top + 2
        self.written = {self.open: OPEN, self.sep: SEP, self.close: CLOSE}


def format_turns(rows: DataFrame, vocabulary: str, pattern: str, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, tie, ids, loss): the tokens of each row and which of them the loss counts; loss has one entry per id.

    rows: (conv_id, turn, role, text). A null text or role is empty; a null conv_id is one conversation. Rows of one turn
    come in the order of tie, a hash of role and text, so equal rows are equal turns in a row. Empty texts have no tokens of
    their own. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern)
        for batch in batches:
            at = 0
            for texts in pieces(batch.column(4)):
                ids, losses = [], []
                for role, text in zip(batch.column(3).slice(at, len(texts)).to_pylist(), texts.to_pylist(), strict=True):
                    segments = [[codec.open], codec.encode(escape_role(role or "")), [codec.sep], codec.encode(escape(text)), [codec.close]]
                    ends = np.cumsum([len(s) for s in segments])
                    edges = np.zeros(ends[-1] + 1, dtype=np.int8)
                    if role == trained:
                        edges[ends[2]] += 1
                        edges[ends[3]] -= 1
                    ids.append([i for s in segments for i in s])
                    losses.append(np.cumsum(edges[:-1]) > 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(texts)) for i in range(3)), pa.array(ids, pa.list_(pa.int32())), pa.array([x.tolist() for x in losses], pa.list_(pa.bool_()))], names=["conv_id", "turn", "tie", "ids", "loss"])
                at += len(texts)

    tie = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    wanted = small_batches(rows).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), tie.alias("tie"), "role", "text")
    return wanted.mapInArrow(run, "conv_id long, turn long, tie long, ids array<int>, loss array<boolean>")


def with_offsets(turns: DataFrame) -> DataFrame:
    """+ token_offset: tokens of the conversation before the row."""
    before = Window.partitionBy("conv_id").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("token_offset", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))


def read_back(turns: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per conversation, from its tokens alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows are dealt by conversation and read in order; digests go along, so a task holds one batch of rows however long a
    conversation is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, pattern)
        out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        now, state = object(), None

        def close() -> None:
            if state is not None:
                for k, v in zip(out, (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True):
                    out[k].append(v)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
            for v in out.values():
                v.clear()
            return made

        for batch in batches:
            for conv, ids, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(ids):  # one turn after the other, as the reserved ids part them
                    if ids[at] != codec.open:
                        raise ValueError("a turn does not begin with its reserved id")
                    sep, end = ids.index(codec.sep, at), ids.index(codec.close, at)
                    role, text = (unescape(codec.decode(x)) for x in (ids[at + 1 : sep], ids[sep + 1 : end]))
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    at = end + 1
                edges = np.flatnonzero(np.diff(np.concatenate(([False], loss, [False])).astype(np.int8)))
                for a, z in edges.reshape(-1, 2).tolist():
                    text = unescape(codec.decode(ids[a:z]))
                    state[2] += len(text)
                    state[3].update(text.encode())
                reserved = [i for i, x in enumerate(ids) if x in codec.written]
                parts = [codec.written[ids[i]] + codec.decode(ids[i + 1 : j]) for i, j in zip(reserved, [*reserved[1:], len(ids)], strict=True)]
                state[4] += len("".join(parts))
                if len(out["conv_id"]) >= 4096:
                    yield flush()
        close()
        yield flush()

    dealt = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "tie").select("conv_id", "ids", "loss")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
