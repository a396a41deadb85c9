"""Merkle manifest of a corpus: a tree per source, a tree over the sources, a proof per document, and folding of changed leaves.

H is the hex SHA-256 of its concatenated inputs. A leaf is H of a row's columns, each written as its UTF-8 byte count, a colon and its value,
or ``-`` if null. Nodes of a tree stand in order; while several remain, every FANOUT consecutive ones (the last run may be shorter, even
one) become their H. What remains of each source is its subroot; the subroots, ordered by source, make the root in the same way.

A parent is a hash state that takes its children one by one; it keeps a copy of the state before each child. A changed child is folded in by
resuming the copy before its place with the new digest and the digests to its right: nothing to its left is hashed again.

Trees are built and folded in blocks of FANOUT ** LEVELS consecutive nodes, which are whole subtrees of LEVELS levels. Only the top of each block goes
on, so a source of n documents takes one round per LEVELS levels, and no task ever holds more than a few blocks, however large a source is.
On the way down each block gets its path: a row of siblings per level above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, small_batches, written

FANOUT = 3
#: Levels of a block.
LEVELS = 6
#: Rows that one task gets on average: whole blocks of one or many trees.
TASK_ROWS = 8192
#: Boundaries of ranges that a join may broadcast.
MOST_RANGES = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, pos long, size long, digest string"
_PATH = "tree string, pos long, path array<string>"


def leaf(*values: Column) -> Column:
    """H of the values, each with its length, a null as ``-``."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, tree, leaf, changed): the leaf of each row, and that of the row with the columns of changed put in place of its own.

    tree is '' for a null source, else 's' and the source, so that trees sort as sources do, null first.
    """
    held = {c: F.col(f"`{c}`") for c in COLUMNS}
    new = held | (changed or {})
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"),
        leaf(*held.values()).alias("leaf"), leaf(*[new[c] for c in COLUMNS]).alias("changed"),
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, the place of each in its tree by order, and size, the number of rows of its tree.

    Rows are sorted by ranges of (tree, order); a range's place in its tree is the number of rows in the ranges before it, so a tree
    of any size is spread over many tasks. Only one row per range and tree is summed up.
    """
    by = ["tree", *order]
    ranged = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    ranges = ranged.groupBy("tree", F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("tree", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    starts = broadcast_if_small(cut(starts), MOST_RANGES)
    return ranged.withColumn("_range", F.shiftright("_at", 33)).join(starts, ["tree", "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_start")).drop("_at", "_range", "_first", "_start")


class Subtree:
    """A block of digests with the levels above it. states[l][p] are parent p's hash states before each of its children, and right[l][p]
    what stands to the right of each."""

    def __init__(self, digests: list[str], levels: int):
        self.nodes, self.states, self.right = [[d.encode() for d in digests]], [], []
        for _ in range(levels):
            below, above, states, rights = self.nodes[-1], [], [], []
            for at in range(0, len(below), FANOUT):
                children = below[at : at + FANOUT]
                kept, digest = midstates(children)
                above.append(digest)
                states.append(kept)
                rights.append([b"".join(children[i + 1 :]) for i in range(len(children))])
            self.nodes.append(above)
            self.states.append(states)
            self.right.append(rights)

    def top(self) -> str:
        """The one node that is left."""
        (digest,) = self.nodes[-1]
        return digest.decode()

    def path(self, place: int) -> list[str]:
        """Per level the slot of the node on the way up and its run's digests, as one string."""
        found = []
        for level in range(len(self.states)):
            at = place // FANOUT * FANOUT
            found.append(f"{place - at}{b''.join(self.nodes[level][at : at + FANOUT]).decode()}")
            place //= FANOUT
        return found

    def fold(self, place: int, digest: bytes) -> bytes:
        """The top if digest stood at place."""
        for states, rights in zip(self.states, self.right, strict=True):
            parent, slot = divmod(place, FANOUT)
            digest, place = resumed(states[parent][slot], digest, rights[parent][slot]), parent
        return digest


def midstates(children: list[bytes]) -> tuple[list, bytes]:
    """The copies of the hash state before each child, and the digest of all."""
    state, kept = hashlib.sha256(), []
    for child in children:
        kept.append(state.copy())
        state.update(child)
    return kept, state.hexdigest().encode()


def resumed(state, digest: bytes, right: bytes) -> bytes:
    """The parent's digest, from its state before a child, the child's new digest and what stands to its right."""
    state = state.copy()
    state.update(digest)
    state.update(right)
    return state.hexdigest().encode()


def height(size: int, most: int) -> int:
    """Levels of a block of a tree of so many nodes: as many as it needs, most at most."""
    levels = 0
    while levels < most and size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


def _blocks(table: pa.Table, levels: int) -> Iterator[tuple[str, int, Subtree, pa.Table]]:
    """The blocks of a task: tree, number of the block, the block, and its rows in order."""
    order = pc.sort_indices(table, [("tree", "ascending"), ("pos", "ascending")])
    table = table.take(order).combine_chunks()
    tree, block = table["tree"].to_pylist(), table["pos"].to_numpy() // FANOUT**levels
    begin = 0
    for at in range(1, len(tree) + 1):
        if at == len(tree) or tree[at] != tree[begin] or block[at] != block[begin]:
            rows = table.slice(begin, at - begin)
            yield tree[begin], int(block[begin]), Subtree(rows["digest"].to_pylist(), height(rows["size"][0].as_py(), levels)), rows
            begin = at


def _siblings(step: str) -> bytes:
    """A path step without the node itself."""
    slot, run = int(step[0]), step[1:].encode()
    return run[: 64 * slot] + run[64 * slot + 64 :]


def _columns(rows: list[tuple], schema: dict) -> pa.Table:
    return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(schema.items())})


def _tops(levels: int):
    """A block's top, as a node of the next round."""

    def tops(table: pa.Table) -> pa.Table:
        rows = [(tree, at, -(-part["size"][0].as_py() // FANOUT**levels), block.top()) for tree, at, block, part in _blocks(table, levels)]
        return _columns(rows, {"tree": pa.string(), "pos": pa.int64(), "size": pa.int64(), "digest": pa.string()})

    return tops


def _paths(levels: int):
    """Each node's path, from the paths of the blocks."""

    def paths(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        above, rows = _by_block(upper), []
        for tree, at, block, part in _blocks(nodes, levels):
            rest = above.get((tree, at), [])
            rows += [(tree, at * FANOUT**levels + i, block.path(i) + rest) for i in range(len(part))]
        return _columns(rows, {"tree": pa.string(), "pos": pa.int64(), "path": pa.list_(pa.string())})

    return paths


def _proofs(levels: int):
    """Each leaf with its siblings up to the root and the root that its changed digest gives."""

    def proofs(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        above, proof, folded, parts = _by_block(upper), [], [], [nodes.slice(0, 0).select(["doc_id", "tree", "digest"])]
        for tree, at, block, part in _blocks(nodes, levels):
            rest, resume = above.get((tree, at), []), []
            for step in rest:
                slot, run = int(step[0]), step[1:].encode()
                children = [run[i : i + 64] for i in range(0, len(run), 64)]
                resume.append((midstates(children)[0][slot], b"".join(children[slot + 1 :])))
            tail = b"".join(map(_siblings, rest))
            for i, new in enumerate(part["changed"].to_pylist()):
                digest = block.fold(i, new.encode())
                for state, right in resume:
                    digest = resumed(state, digest, right)
                folded.append(digest.decode())
                proof.append((b"".join(map(_siblings, block.path(i))) + tail).decode())
            parts.append(part.select(["doc_id", "tree", "digest"]))
        return pa.concat_tables(parts).append_column("proof", pa.array(proof, pa.string())).append_column("folded_root", pa.array(folded, pa.string()))

    return proofs


def _by_block(upper: pa.Table) -> dict:
    return {(t, p): path for t, p, path in zip(upper["tree"].to_pylist(), upper["pos"].to_pylist(), upper["path"].to_pylist(), strict=True)}


def _in_tasks(nodes: DataFrame, n: int, block: Column):
    """nodes grouped so that a block is never cut and a task gets TASK_ROWS of them on average."""
    return nodes.groupBy(F.pmod(F.xxhash64("tree", block), F.lit(max(1, n // TASK_ROWS))).alias("_task"))


def _raised(nodes: DataFrame, levels: int) -> list[tuple[DataFrame, int]]:
    """The rounds of nodes, from nodes (tree, pos, size, digest) to the one node that each tree has left, with the rows of each."""
    rounds = [(nodes, nodes.count())]
    while (nodes.agg(F.max("size")).first()[0] or 0) > 1:
        own = nodes.select("tree", "pos", "size", "digest")
        nodes = cut(_in_tasks(own, rounds[-1][1], F.floor(F.col("pos") / FANOUT**levels)).applyInArrow(_tops(levels), _NODE))
        rounds.append((nodes, nodes.count()))
    return rounds


def _with_upper(nodes: DataFrame, n: int, upper: DataFrame, levels: int, function, schema: str) -> DataFrame:
    left, right = _in_tasks(nodes, n, F.floor(F.col("pos") / FANOUT**levels)), _in_tasks(upper, n, F.col("pos"))
    return left.cogroup(right).applyInArrow(function(levels), schema)


def _lowered(rounds: list[tuple[DataFrame, int]], paths: DataFrame, levels: int) -> DataFrame:
    """Paths of the blocks of the lowest round, from paths (tree, pos, path) of the one node of each tree."""
    for nodes, n in reversed(rounds[1:-1]):
        paths = cut(_with_upper(nodes, n, paths, levels, _paths, _PATH))
    return paths


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row of docs: doc_id, tree, leaf, subroot, root, proof (siblings level by level from the leaf up, 64 characters each), folded_root.

    docs: (doc_id, source, lang, n_chars, text), any of them null; other columns are ignored. folded_root is the root that follows from
    the original siblings and the row with the columns of changed put in place of its own, one row at a time; without changed it equals
    root. Leaves of a source stand by doc_id, a null one first; rows of one id by their leaf; rows that are equal in all columns take
    places next to each other. An empty table has no rows. levels is that of a block: the result is the same for any.
    """
    rows = written(leaves(small_batches(docs), changed).withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    base = cut(placed(rows, "doc_id", "leaf", "_row").select("doc_id", "tree", "pos", "size", F.col("leaf").alias("digest"), "changed"))
    rounds = _raised(base, levels)
    subroots = cut(rounds[-1][0].select("tree", "digest"))
    names = cut(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name"))
    above = _raised(names, levels)
    root = above[-1][0].select("digest").first()  # one row for the whole corpus

    # The root's own path is empty; the lowest round of the upper tree gives a path to each subroot.
    top = _lowered(above, above[-1][0].select("tree", "pos", F.array().cast("array<string>").alias("path")), levels)
    down = cut(_with_upper(names.select("tree", "pos", "size", "digest"), above[0][1], top, levels, _paths, _PATH))
    paths = down.join(names.select("pos", "name"), "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    blocks = _lowered(rounds, cut(paths), levels)
    out = _with_upper(base, rounds[0][1], blocks, levels, _proofs, "doc_id long, tree string, digest string, proof string, folded_root string")
    named = broadcast_if_small(subroots.withColumnRenamed("digest", "subroot"), MOST_RANGES)
    return out.join(named, "tree").select("doc_id", "tree", F.col("digest").alias("leaf"), "subroot", F.lit(root and root.digest).cast("string").alias("root"), "proof", "folded_root")
