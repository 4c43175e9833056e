"""What closes an oriented edge: the out-neighbours that its two ends share, found in cells of a grid.

The ends' out-lists have to meet. Sent to every edge, a list travels as often as it has entries; here it travels once for each row or
column of a grid. Vertices are dealt into ``blocks`` rows and ``slices`` columns by a hash. A cell gets the lists of the vertices of its
row, against which it holds the lists of its column that have an entry in the row. So each edge is judged in one cell, and
every list is sent at most ``blocks`` + ``slices`` times, as 4-byte numbers where ids allow it. No list is longer than the square root of
twice the edges, and blocks grow in number once one would hold more than ``BLOCK_EDGES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelith.plans.session import ship, width

#: Rows and columns of the grid, and how many entries a row's lists hold before it gets more rows.
BLOCKS, SLICES, BLOCK_EDGES = 6, 3, 100_000_000
#: List entries that are compared at a time.
AT_ONCE = 2_000_000
PRIME, FACTOR, HALF = 2_147_483_647, 48_271, 65_536


def _hash(x):
    """The same for columns, where ``pmod`` is %, and arrays; no product leaves 64 bits."""
    if isinstance(x, Column):
        return F.pmod(F.pmod(x.cast("bigint"), F.lit(PRIME)) * F.lit(FACTOR), F.lit(PRIME))
    return x.astype(np.int64) % PRIME * FACTOR % PRIME


def _block(x, blocks: int):
    return F.pmod(F.call_function("div", _hash(x), F.lit(HALF)), F.lit(blocks)).cast("int") if isinstance(x, Column) else _hash(x) // HALF % blocks


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from ``starts``, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class _Lists:
    """Lists to look members up in: a table of marks first, then the sorted pairs of list and member."""

    def __init__(self, row: np.ndarray, member: np.ndarray):
        self.mask = np.uint64((1 << max(10, (16 * len(member)).bit_length())) - 1)
        self.marks = np.zeros(int(self.mask) + 1, dtype=bool)
        self.marks[self._at(row, member)] = True
        self.values, codes = np.unique(member, return_inverse=True)
        self.keys = np.sort(row * len(self.values) + codes)

    def _at(self, row: np.ndarray, member: np.ndarray) -> np.ndarray:
        mixed = member.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(20)) & self.mask

    def hold(self, row: np.ndarray, member: np.ndarray) -> np.ndarray:
        """The positions whose member is in the list of its row."""
        maybe = np.flatnonzero(self.marks[self._at(row, member)])
        row, member = row[maybe], member[maybe]
        code = np.minimum(np.searchsorted(self.values, member), len(self.values) - 1)
        key = row * len(self.values) + code
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return maybe[(self.values[code] == member) & (self.keys[place] == key)]


def _judge(blocks: int, slices: int, least: int) -> Callable:
    """For the rows of a cell, its row's lists (kind 0) before its column's (kind 1): (u, v, cand)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, flat, ready = [], [], [], None
        for batch in batches:
            kind, cell, own = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("kind", "cell", "id"))
            lists = batch.column("out")
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            entries = lists.flatten().to_numpy(zero_copy_only=False)
            held = kind == 0
            if held.any():
                ids.append(own[held])
                sizes.append(size[held])
                flat.append(entries[np.repeat(held, size)])
            if held.all():
                continue
            if ready is None:
                ready = _sorted(ids, sizes, flat, entries.dtype)
                ids, sizes, flat = [], [], []
            asking = ~held
            yield from _closed(own[asking], size[asking], entries[np.repeat(asking, size)], int(cell[0]) // slices, blocks, least, *ready)

    return run


def _sorted(ids: list, sizes: list, flat: list, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in ascending order, where the list of each starts, how long it is, and all entries."""
    if not ids:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, np.zeros(0, dtype=kind)
    ids, sizes, flat = np.concatenate(ids), np.concatenate(sizes), np.concatenate(flat)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(ids)
    return ids[order], starts[order], sizes[order], flat


def _closed(own, size, entries, block, blocks, least, ids, starts, sizes, flat) -> Iterator[pa.RecordBatch]:
    """The edges from ``own`` into the block with what their ends share."""
    row = np.repeat(np.arange(len(own)), size)
    asked = np.flatnonzero(_block(entries, blocks) == block)
    if not len(asked):
        return
    lists, row_of, v = _Lists(row, entries), row[asked], entries[asked].astype(np.int64)
    place = np.minimum(np.searchsorted(ids, v), max(len(ids) - 1, 0))
    known = ids[place] == v if len(ids) else np.zeros(len(v), dtype=bool)
    begin = np.where(known, starts[place], 0) if len(ids) else np.zeros(len(v), dtype=np.int64)
    length = np.where(known, sizes[place], 0) if len(ids) else np.zeros(len(v), dtype=np.int64)
    upto = np.cumsum(length)
    first = 0
    while first < len(v):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + AT_ONCE, side="right")))
        edge = np.repeat(np.arange(first, last), length[first:last])
        shared = flat[_ranges(begin[first:last], length[first:last])]
        found = lists.hold(row_of[edge], shared)
        edge, shared = edge[found], shared[found].astype(np.int64)
        n = np.bincount(edge - first, minlength=last - first)
        enough = n >= least
        shared = shared[enough[edge - first]]
        offsets = np.concatenate([[0], np.cumsum(n[enough])]).astype(np.int32)
        cand = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shared))
        part = slice(first, last)
        yield pa.RecordBatch.from_arrays([pa.array(own[row_of[part][enough]].astype(np.int64)), pa.array(v[part][enough]), cand], names=["u", "v", "cand"])
        first = last


def closing(dag: DataFrame, edges: int, narrow: bool, least: int = 1) -> DataFrame:
    """(u, v, cand): for each edge of an acyclic ``dag`` (u, v) the out-neighbours that u and v share, where there are ``least`` or more.

    ``edges`` is the number of edges, which sets the grid; ``narrow`` says that all ids fit into 32 bits. Where ``dag`` has a column ``root``, the same for
    all edges of u, only edges whose u is a root are looked at, and only these lists ask others.
    """
    spark = dag.sparkSession
    ship(spark)
    blocks = max(BLOCKS, -(-edges // BLOCK_EDGES))
    root = [F.col("root")] if "root" in dag.columns else []
    sent = dag.select(F.col("u").alias("id"), F.col("v").cast("int" if narrow else "bigint").alias("v"), *root).repartition(width(edges, spark), "id")
    lists = sent.groupBy("id").agg(F.collect_list("v").alias("out"), *[F.max(r).alias("root") for r in root])
    cell = lambda block, column: (block * SLICES + column).cast("int").alias("cell")
    place = lambda block, column, kind: F.struct(cell(block, column), F.lit(kind).alias("kind"))
    column = F.pmod(F.pmod(_hash(F.col("id")), F.lit(HALF)), F.lit(SLICES))
    own = F.array(*[place(_block(F.col("id"), blocks), F.lit(s), 0) for s in range(SLICES)])
    asked = F.transform(F.array_distinct(F.transform("out", lambda v: _block(v, blocks))), lambda b: place(b, column, 1))
    asked = F.when(F.col("root"), asked) if root else asked
    own = F.concat(own, F.coalesce(asked, F.array())) if root else F.concat(own, asked)
    dealt = lists.select("id", "out", F.explode(own).alias("to")).select("to.cell", "to.kind", "id", "out")
    parted = dealt.repartitionById(blocks * SLICES, F.col("cell")).sortWithinPartitions("kind")
    return parted.mapInArrow(_judge(blocks, SLICES, least), "u bigint, v bigint, cand array<bigint>")
