"""Packing token pieces into sequences by cutting-stock column generation.

A document's tokens are cut into full sequences and one shorter rest. Rests are counted in length
classes of ``WIDTH`` tokens. A linear program over patterns (how many rests of each class share a
sequence) minimises the number of sequences; its columns are priced by an unbounded-knapsack dynamic
program. The solution is rounded down, what is left over is packed first-fit decreasing, and patterns
are dealt to the documents ranked within their class. Only the histogram (at most ``CAPACITY`` /
``WIDTH`` numbers) comes to the driver, whatever the input's size.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed as often as they
occur; a null doc_id is packed like any other; an empty table gives an empty result; other columns are
ignored. The tokenizer's special-token strings in a text are encoded as these tokens, which is what
the tokenizer's file does by default.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelith.llm.common import ranked
from corelith.plans.session import cut

CAPACITY = 2048
WIDTH = 8
CLOSING = 1
#: Patterns priced by one table of the dynamic program.
COLUMNS = 24
#: How far duals are held back, and the relative distance from the bound at which the program counts as solved.
SMOOTHING, GAP = 0.8, 0.0002
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


@functools.cache
def _encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens=SPECIAL)


def token_pieces(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """One row of ``PIECES`` for each stretch of at most ``capacity`` ids of each document."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = functools.partial(_encoder(ranks, pattern).encode_to_numpy, allowed_special="all")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), CLOSING).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield made.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(cut_up, PIECES)


def _knapsack_table(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity, the best value and the item taken there, or -1; sizes ascend."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.searchsorted(sizes, room, side="right")
        if fits:
            with_item = best[room - sizes[:fits]] + values[:fits]
            i = int(np.argmax(with_item))
            if with_item[i] > best[room] + 1e-12:
                best[room], choice[room] = with_item[i], i
    return best, choice


def _trace(choice: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    counts = np.zeros(len(sizes), dtype=np.int64)
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return counts


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items (of ascending sizes) within the capacity, and how often it holds each."""
    best, choice = _knapsack_table(values, sizes, capacity)
    return float(best[capacity]), _trace(choice, sizes, capacity)


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each; every basis on the way is feasible.

    Duals are smoothed towards the best feasible ones known, at first each size's share of a sequence, which keeps them
    from jumping about. Any duals divided by the value of their best pattern are feasible and give a lower bound; the
    search ends when the basis is within ``GAP`` of it. One table of the dynamic program prices the best pattern around
    each item; those that pay under the basis's own duals enter one after another.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    cost, used = np.ones(m), demand / np.diag(basis)

    def enter(column: np.ndarray, price: float = 1.0) -> None:
        direction = inverse @ column
        usable = direction > 1e-9
        if not usable.any():
            return
        ratios = np.full(m, np.inf)
        ratios[usable] = used[usable] / direction[usable]
        leaves = int(np.argmin(ratios))
        step = ratios[leaves]
        used[:] = np.maximum(used - step * direction, 0)
        used[leaves] = step
        basis[:, leaves], cost[leaves] = column, price
        inverse[leaves] /= direction[leaves]
        direction[leaves] = 0
        inverse[:] -= np.outer(direction, inverse[leaves])

    for pattern, _ in first_fit_patterns(sizes, demand, capacity):
        if (cost @ inverse) @ pattern > 1 + 1e-7:
            enter(pattern.astype(float))
    center, smooth = sizes / capacity, SMOOTHING
    for _ in range(rounds):
        if cost @ used <= (1 + GAP) * (center @ demand):
            break
        duals = cost @ inverse
        if duals[worst := int(np.argmin(duals))] < -1e-9:
            surplus = np.zeros(m)
            surplus[worst] = -1.0
            enter(surplus, 0.0)
            continue
        values = smooth * center + (1 - smooth) * np.maximum(duals, 0)
        best, choice = _knapsack_table(values, sizes, capacity)
        if (feasible := values / max(best[capacity], 1e-12)) @ demand > center @ demand:
            center = feasible
        around, entered = values + best[capacity - sizes], 0
        for i in np.argsort(-around, kind="stable")[:COLUMNS]:
            counts = _trace(choice, sizes, capacity - int(sizes[i])).astype(float)
            counts[i] += 1
            if (cost @ inverse) @ counts > 1 + 1e-7:
                enter(counts)
                entered += 1
        if not entered and not smooth:
            break
        smooth = SMOOTHING if entered else smooth / 2 if smooth > 0.1 else 0.0
    return [(basis[:, i].astype(np.int64), float(used[i])) for i in range(m) if cost[i] > 0 and used[i] > 1e-9]


def first_fit_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit decreasing on classes: the largest rests that fit, again and again; equal sequences are made at once."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in np.flatnonzero(left)[::-1]:
            take = min(int(left[i]), room // int(sizes[i]))
            pattern[i] += take
            room -= take * int(sizes[i])
        times = int(min(left[i] // pattern[i] for i in np.flatnonzero(pattern)))
        out.append((pattern, times))
        left -= pattern * times
    return out


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers of uses that together hold all items; sizes ascend."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, used in fractional_patterns(sizes, demand, capacity):
        if (times := int(used + 1e-6)) > 0:
            out.append((pattern, times))
            left -= pattern * times
    return out + first_fit_patterns(sizes, np.maximum(left, 0), capacity)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank end, slots a sequence, first sequence) for every class of each pattern.

    Class 0 stands for full pieces, each a sequence by itself.
    """
    classes = np.array(sorted(c for c in histogram if c), dtype=np.int64)
    demand = np.array([histogram[c] for c in classes], dtype=np.int64)
    taken, plan, sequence = dict.fromkeys(histogram, 0), [], 0
    if full := histogram.get(0, 0):
        plan.append((0, 0, full, 1, 0))
        sequence = full
    for pattern, times in whole_patterns(classes, demand, capacity // width) if len(classes) else []:
        for i in np.flatnonzero(pattern):
            c, slots = int(classes[i]), int(pattern[i])
            plan.append((c, taken[c], taken[c] + slots * times, slots, sequence))
            taken[c] += slots * times
        sequence += times
    return plan


def pack_documents(docs: DataFrame, ranks: str, pattern: str, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """The rows of ``token_pieces`` with sequence_id and offset, gapless within each sequence."""
    spark = docs.sparkSession
    size_class = F.when(F.col("length") == capacity, 0).otherwise(F.ceil(F.col("length") / width)).cast("int")
    pieces = cut(token_pieces(docs, ranks, pattern, capacity).withColumn("size_class", size_class))
    histogram = {r[0]: r[1] for r in pieces.groupBy("size_class").count().collect()}
    plan = spark.createDataFrame(
        plan_sequences(histogram, capacity, width),
        "p_class int, first_rank bigint, end_rank bigint, slots bigint, first_sequence bigint",
    )
    by_rank = (F.col("size_class") == F.col("p_class")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    placed = (
        ranked(pieces, "size_class", ["doc_id", "start", "ids_crc32"])
        .join(F.broadcast(plan), by_rank)
        .withColumn(
            "sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("slots"))
        )
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "size_class", "rank")
    before = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(before, F.lit(0)).alias("offset")
    )
