"""A Merkle manifest of a document table: leaves, roots, proofs, and documents proved again.

A document's leaf is the SHA-256 of its columns with their lengths. Leaves of one source, in the order of doc_id, form a tree in which runs of
``FANOUT`` consecutive digests are hashed into one, level by level; the sources' roots form one more tree in the order of sources.

A tree is computed in aligned blocks of ``FANOUT`` to the power of ``LEVELS`` nodes, so that a block's node stands for the same leaves as in the whole
tree. Within a block the digests are a contiguous numpy matrix of 64 hexadecimal bytes a row: reshaped by the fanout its rows are hashed into
the next level's matrix, and every sibling is found by index arithmetic. The blocks' nodes are the leaves of the next stage of blocks, until a
tree has a single node; then paths come down by the same stages. No task holds more than one block at a time, and the driver sees
only how large the largest tree still is.

Defined cases: a null column is "-", an empty one "0:"; leaves of one source ascend by doc_id, null first, then by leaf, so rows that share a doc_id are leaves of
their own and repeated rows have equal leaves side by side; a null source is a source of its own, the first; a document with a null doc_id or
text is not tampered with; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelith.llm.common import placed
from corelith.plans.session import cut

FANOUT, LEVELS = 3, 6
BLOCK = FANOUT**LEVELS
DIGEST = 64
NODES = "tree string, rank bigint, group_rows bigint, digest string"
PATHS = "tree string, rank bigint, root string, path array<string>"
PROVED = "doc_id bigint, leaf string, subroot string, root string, proof string, folded_root string"


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes; "-" where it is null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    others = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.sha2(F.concat(*others, field(text)), 256)


def leaves(docs: DataFrame, tampered_every: int = 2) -> DataFrame:
    """(tree, doc_id, leaf, tampered): a source's tree sorts by the source's bytes, the null source's first.

    Where CRC-32 of the decimal doc_id is divisible by ``tampered_every``, the tampered leaf is that of the text without
    its line feeds; elsewhere it is null.
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered_every == 0
    changed = F.when(hit & F.col("text").isNotNull(), leaf_digest(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest(F.col("text")).alias("leaf"), changed.alias("tampered"))


def matrix(digests: list[str]) -> np.ndarray:
    """One row of hexadecimal bytes for each digest."""
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, DIGEST)


def hashed_rows(rows: np.ndarray) -> list[str]:
    return [sha256(row).hexdigest() for row in rows]


def level_matrices(level: np.ndarray, steps: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """The block's levels from the leaves up, ``steps`` of them above the leaves."""
    out = [level]
    for _ in range(steps):
        full = len(level) - len(level) % fanout
        above = hashed_rows(np.ascontiguousarray(level[:full]).reshape(-1, fanout * DIGEST))
        if full < len(level):
            above += hashed_rows(np.ascontiguousarray(level[full:]).reshape(1, -1))
        level = matrix(above)
        out.append(level)
    return out


def steps_of(nodes: int, block: int, fanout: int = FANOUT) -> int:
    """How many levels a block of ``block`` nodes adds to a tree of ``nodes``: up to its root, or to the block's own node."""
    steps = 0
    while nodes > 1 and block > 1:
        nodes, block, steps = -(-nodes // fanout), block // fanout, steps + 1
    return steps


def siblings(levels: list[np.ndarray], fanout: int = FANOUT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level below the top: (index, valid), both leaves x (fanout - 1), of the siblings on each leaf's way, left to right."""
    at = np.arange(len(levels[0]))
    others = np.array([[j for j in range(fanout) if j != i] for i in range(fanout)])
    for level in levels[:-1]:
        place = at % fanout
        index = (at - place)[:, None] + others[place]
        yield index, index < len(level)
        at = at // fanout


def block_paths(levels: list[np.ndarray], fanout: int = FANOUT) -> list[list[str]]:
    """For each leaf its siblings, two texts for each level: those to the left, joined, and those to the right."""
    out: list[list[str]] = [[] for _ in levels[0]]
    at = np.arange(len(levels[0]))
    for level, (index, valid) in zip(levels, siblings(levels, fanout), strict=False):
        held = level[np.minimum(index, len(level) - 1)]
        place = at % fanout
        for row, own in enumerate(out):
            split = place[row]
            own.append(held[row, :split].tobytes().decode())
            own.append(held[row, split:][valid[row, split:]].tobytes().decode())
        at = at // fanout
    return out


def fold(digest: str, path: list[str]) -> str:
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, block, group_rows, and one array for each column, in the order of rank): ``BLOCK`` consecutive nodes a row."""
    columns = ["digest", *more]
    held = F.sort_array(F.collect_list(F.struct("rank", *columns)))
    grouped = nodes.groupBy("tree", F.expr(f"rank div {BLOCK}").alias("block")).agg(F.first("group_rows").alias("group_rows"), held.alias("held"))
    return grouped.select("tree", "block", "group_rows", *[F.col(f"held.{c}").alias(c) for c in columns])


def _tops(blocks: DataFrame) -> DataFrame:
    """``NODES`` of the next stage: one for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for i in range(batch.num_rows):
                tree, block, size, digests = (batch.column(c)[i].as_py() for c in ("tree", "block", "group_rows", "digest"))
                top = level_matrices(matrix(digests), steps_of(size, BLOCK))[-1]
                made.append((tree, block, -(-size // BLOCK), top.tobytes().decode()))
            columns = list(zip(*made, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "rank", "group_rows", "digest"])

    return blocks.select("tree", "block", "group_rows", "digest").mapInArrow(run, NODES)


def _stages(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The stages of blocks from ``NODES`` (and more columns of the leaves) up, and (tree, digest) of the roots."""
    out = [cut(_blocks(nodes, *more))]
    while True:
        tops = cut(_tops(out[-1]))
        if (tops.agg(F.max("group_rows")).first()[0] or 1) == 1:
            return out, tops
        out.append(cut(_blocks(tops)))


def _under(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the path and the root of their own node."""
    return blocks.join(above.withColumnRenamed("rank", "block"), ["tree", "block"])


def _paths(blocks: DataFrame) -> DataFrame:
    """``PATHS`` of the blocks' nodes: from each up to the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, block, size, digests, root, path = (batch.column(c)[i].as_py() for c in ("tree", "block", "group_rows", "digest", "root", "path"))
                own = block_paths(level_matrices(matrix(digests), steps_of(size, BLOCK)))
                n = len(own)
                ranks = pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64())
                columns = [pa.array([tree] * n, pa.string()), ranks, pa.array([root] * n, pa.string()), pa.array([p + path for p in own], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "rank", "root", "path"])

    return blocks.select("tree", "block", "group_rows", "digest", "root", "path").mapInArrow(run, PATHS)


def _proved(blocks: DataFrame) -> DataFrame:
    """``PROVED`` for the documents of the blocks of leaves, which know their source's root and their own node's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PROVED.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                size, digests, doc_ids, tampered, subroot, root, path = (
                    batch.column(c)[i].as_py() for c in ("group_rows", "digest", "doc_id", "tampered", "subroot", "root", "path")
                )
                own = block_paths(level_matrices(matrix(digests), steps_of(size, BLOCK)))
                n, above = len(own), "".join(path)
                folded = [fold(changed or leaf, mine + path) for leaf, changed, mine in zip(digests, tampered, own, strict=True)]
                proofs = ["".join(mine) + above for mine in own]
                columns = [doc_ids, digests, [subroot] * n, [root] * n, proofs, folded]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if c is doc_ids else pa.string()) for c in columns], names)

    return blocks.select("group_rows", "digest", "doc_id", "tampered", "subroot", "root", "path").mapInArrow(run, PROVED)


def manifest(docs: DataFrame, tampered_every: int = 2) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) of every document.

    ``proof`` holds the siblings on the way to the root, as hexadecimal digests, level by level, left to right.
    ``folded_root`` is made from the tampered leaf, or the leaf where nothing is tampered with, and the original siblings.
    """
    made = cut(leaves(docs, tampered_every))  # the texts are read once
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tampered")]
    stages, subroots = _stages(placed(made, "tree", order).withColumnRenamed("leaf", "digest"), "doc_id", "tampered")

    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = cut(placed(sources, "tree", [F.col("source")]))
    upper, whole = _stages(sources)
    above = whole.select("tree", F.lit(0).cast("bigint").alias("rank"), F.col("digest").alias("root"), F.array().cast("array<string>").alias("path"))
    for blocks in reversed(upper):
        above = _paths(_under(blocks, above))
    above = sources.join(above, ["tree", "rank"]).select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("rank"), "root", "path")
    for blocks in reversed(stages[1:]):
        above = _paths(_under(blocks, above))

    known = _under(stages[0], cut(above)).join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    proved = _proved(known)
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
