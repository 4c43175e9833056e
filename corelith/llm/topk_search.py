"""Exact top-k inner-product search by MaxScore.

Components of vectors are terms, vectors are documents, and a term's posting list holds the documents where
the component is not 0. Vectors are dealt to shards of bounded size, each to one; queries go to every shard and are streamed past
its index; the k best of the shards are merged by query.

Within a shard, documents come in blocks, and a query's terms are ordered by the most they can add to a score of a block. Those at
the low end whose bounds together stay below the threshold are non-essential: a document in no other list cannot be
among the k best. The lists of essential terms are traversed; documents stay as long as their sum and the bounds of
the terms still open reach the threshold, and non-essential terms are probed for these only. The threshold is the
query's k-th best score so far: in a sample of fixed size at first, then, rising, among the documents of the shard.

Defined cases: a vector that is null or holds null or non-finite components takes no part, nor does one with a
null vec_id; absent components of shorter vectors count as 0; rows with a query's own vec_id are no candidates
of it; a query stored twice is one query, a candidate stored twice counts twice; ties go to the smaller
vec_id; without queries or candidates the result is empty; other columns are ignored. Scores are exact while
they and their partial sums stay below 2^53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelith.plans.session import cut

SHARD_ROWS = 4096
BLOCK_ROWS = 2048
SAMPLE_ROWS = 512
PROBE = 8
FOUND = "query_id bigint, vec_id bigint, score bigint"


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, with 0 where a shorter one has no component."""
    ends = vectors.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(vectors), width))
    rows = np.repeat(np.arange(len(vectors)), sizes)
    out[rows, np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], sizes)] = vectors.values.to_numpy()[ends[0] : ends[-1]]
    return out


class Shard:
    """The posting lists of a shard's vectors, block by block, with the bounds of their weights."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(-np.abs(rows).sum(axis=1), kind="stable")  # long vectors first: the threshold rises early
        self.blocks = []
        for start in range(0, len(ids), BLOCK_ROWS):
            some = order[start : start + BLOCK_ROWS]
            part = rows[some]
            lists = [np.flatnonzero(column) for column in part.T]
            weights = [part[docs, d] for d, docs in enumerate(lists)]
            self.blocks.append((ids[some], part, lists, weights, np.maximum(part.max(axis=0), 0.0), np.minimum(part.min(axis=0), 0.0)))

    def search(self, query_id: int, q: np.ndarray, floor: float, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best that reach ``floor``, ties to the smaller id."""
        best: list[tuple[int, int]] = []  # score and negative id, the worst first
        for ids, part, lists, weights, most, least in self.blocks:
            bounds = np.maximum(q * most, q * least)
            order = np.argsort(-bounds, kind="stable")
            left = np.concatenate((np.cumsum(bounds[order][::-1])[::-1], [0.0]))  # bounds of the terms from each place on
            if left[0] < floor:
                continue
            below = np.flatnonzero(left < floor)
            essential = int(below[0]) if len(below) else len(order)
            sums, touched = np.zeros(len(ids)), np.full(len(ids), floor <= 0)  # without common terms the score is 0
            for d in order[:essential]:
                if q[d]:
                    sums[lists[d]] += q[d] * weights[d]
                    touched[lists[d]] = True
            alive = np.flatnonzero(touched & (sums + left[essential] >= floor) & (ids != query_id))
            for place in range(essential, len(order), PROBE):
                if not len(alive):
                    break
                some = order[place : place + PROBE]
                sums[alive] += part[np.ix_(alive, some)] @ q[some]
                alive = alive[sums[alive] + left[min(place + PROBE, len(order))] >= floor]
            for i in alive[np.lexsort((ids[alive], -sums[alive]))[:k]]:
                found = (int(sums[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                floor = max(floor, float(best[0][0]))
        return [(score, -negative) for score, negative in best]


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: float = 256.0, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    whole = F.transform(F.col(column), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fine = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = cut(
        vectors.filter(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & fine).select(
            F.col("vec_id").cast("bigint").alias("vec_id"), whole.cast("array<bigint>").alias("v")
        )
    )
    asked = cut(rows.filter(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"]))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if asked.isEmpty() or not width:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    shards = -(-n // SHARD_ROWS)

    part = min(1_000_000, max(1, 1_000_000 * SAMPLE_ROWS // n))
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("floor"), "vec_id"), F.lit(1_000_000)) < part).limit(4 * SAMPLE_ROWS).toArrow()
    known = spark.sparkContext.broadcast((sample["vec_id"].to_numpy(), _matrix(pa.concat_arrays(sample["v"].chunks), width) if len(sample) else np.zeros((0, width))))

    def floors(query_ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        sample_ids, sample_rows = known.value
        if len(sample_ids) <= k:
            return np.full(len(queries), -np.inf)
        scores = queries @ sample_rows.T
        scores[query_ids[:, None] == sample_ids[None, :]] = -np.inf
        return np.partition(scores, len(sample_ids) - k, axis=1)[:, len(sample_ids) - k]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, waiting, shard = -1, [], None  # rows come by shard, its documents before the queries
        for batch in batches:
            place, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            ids, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width)
            edges = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            out = []
            for start, end in zip([0, *edges], [*edges, len(ids)], strict=True):
                if start == end:
                    continue
                if place[start] != of:
                    of, waiting, shard = place[start], [], None
                if not asks[start]:
                    waiting.append((ids[start:end], vectors[start:end]))
                    continue
                if shard is None:
                    shard = Shard(*map(np.concatenate, zip(*waiting, strict=True))) if waiting else Shard(ids[:0], vectors[:0])
                for query_id, q, floor in zip(ids[start:end], vectors[start:end], floors(ids[start:end], vectors[start:end]), strict=True):
                    out += [(int(query_id), vec_id, score) for score, vec_id in shard.search(int(query_id), q, float(floor), k)]
            yield pa.record_batch({name: pa.array([row[i] for row in out], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))})

    dealt = F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), F.lit(shards)).cast("int")
    documents = rows.select(dealt.alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    ordered = documents.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "vec_id")
    found = ordered.mapInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
