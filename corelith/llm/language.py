"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts become code points; lower-cased letters stay and every run of other characters is one blank.
Pairs and triples of them are hashed into ``BUCKETS`` buckets. Training counts buckets per language
over a bounded sample of labelled rows, stratified by language, with any number of languages. The log-probability matrix
(buckets x languages) is the same in all buckets that a language was not seen with, so it is kept as that value for each language
and a sparse matrix of what the seen buckets add; its size is bounded by the sample's. It is broadcast, and batches of documents, sparse
rows of bucket counts, are multiplied with it in numpy, ``TOGETHER`` products at a time. However long a text is, only a piece of
bounded length is worked on at a time.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is every text when there
is nothing to learn from; rows with a null doc_id are never trained on and not held out; ties go to the
first language in alphabetical order; repeated rows are scored alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelith.llm.common import chunks
from corelith.plans.session import cut

BUCKETS = 1 << 15
#: Characters that are turned into grams at a time, and entries of the matrix that are multiplied at a time.
SLICE = 500_000
TOGETHER = 1_000_000
#: The rows of more languages than these are joined by a shuffle instead of a broadcast.
FEW_LANGUAGES = 100_000
#: The bound on labelled rows that a model is fitted on.
TRAINING_ROWS = 40_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(padded: np.ndarray) -> np.ndarray:
    """The bucket of each pair and triple of characters that start before the last two places."""
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    two = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(13)
    three = (two * np.uint64(0x165667B19E3779F9) + c * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(29)
    return np.concatenate((two % np.uint64(BUCKETS), three % np.uint64(BUCKETS))).astype(np.int64)


def _slices(text: str, size: int = SLICE) -> Iterator[np.ndarray]:
    """The grams of a text, with a blank before and after it, ``size`` characters at a time; slices leave no trace.

    Without letters there are none.
    """
    low = text.lower()
    carried, after_letter, any_letter = np.array([32], dtype=np.uint64), False, False
    for start in range(0, len(low), size):
        points = np.frombuffer(low[start : start + size].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of each run of other characters stays, as a blank
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        any_letter |= bool(letter.any())
        padded = np.concatenate((carried, np.where(letter, points, 32)[keep].astype(np.uint64)))
        if len(padded) > 2:
            yield _grams(padded)
        carried = padded[-2:]
    if any_letter:
        yield _grams(np.append(carried, np.uint64(32)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Model(NamedTuple):
    """Log-probabilities of languages and buckets: ``unseen[l]``, plus a gain for each pair that was seen.

    The pairs of bucket b are those from ``starts[b]`` to ``starts[b + 1]``, with their languages in ``places``.
    """

    languages: list[str]
    priors: np.ndarray
    unseen: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    gains: np.ndarray


def model_of(counts: pd.DataFrame, rows: dict[str, int]) -> Model:
    """The model of (lang, bucket, n) counts, half a count added to each, with priors by the languages' rows."""
    languages = sorted(rows)
    counts = counts.sort_values(["bucket", "lang"])
    places = np.searchsorted(np.array(languages, dtype=object), counts["lang"].to_numpy(dtype=object)).astype(np.int32)
    n = counts["n"].to_numpy(dtype=float)
    totals = np.bincount(places, weights=n, minlength=len(languages)) + 0.5 * BUCKETS
    return Model(
        languages,
        np.log(np.array([rows[lang] for lang in languages], dtype=float) / max(sum(rows.values()), 1)),
        np.log(0.5 / totals),
        np.searchsorted(counts["bucket"].to_numpy(), np.arange(BUCKETS + 1)),
        places,
        np.log((n + 0.5) / 0.5).astype(np.float32),
    )


def fit(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """Learns from text and lang of at most about ``training_rows`` rows, drawn by a hash of their doc_id.

    Every language has the same share of them, and at least about one row, as far as it has rows; priors go by all rows of the languages in the sample.
    """
    labelled = docs.filter("text is not null and lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    rows_of = cut(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    languages = rows_of.count()
    share = training_rows / max(languages, 1)
    parts = rows_of.select("lang", "rows", F.least(F.lit(1.0), share / F.col("rows")).alias("part"))
    sample = (
        labelled.select("lang", "text", (F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)).alias("drawn"))
        .join(F.broadcast(parts) if languages <= FEW_LANGUAGES else parts, "lang")
        .filter("drawn < part")
        .select("lang", "text", "rows")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (lang, rows), texts in batch.groupby(["lang", "rows"], sort=False)["text"]:
                total = np.zeros(BUCKETS, dtype=np.int64)
                for text in texts:
                    for grams in _slices(text):
                        total += np.bincount(grams, minlength=BUCKETS)
                seen = np.flatnonzero(total)
                # A language without letters is known by its rows alone.
                yield pd.DataFrame({"lang": lang, "rows": rows, "bucket": np.append(seen, -1), "n": np.append(total[seen], 0)})

    counted = sample.mapInPandas(count, "lang string, rows bigint, bucket int, n bigint").groupBy("lang", "rows", "bucket").agg(F.sum("n").alias("n"))
    counts = counted.toPandas()  # at most the distinct pairs of the sample
    known = counts[counts["bucket"] < 0]
    return model_of(counts.loc[counts["bucket"] >= 0, ["lang", "bucket", "n"]], dict(zip(known["lang"], known["rows"].tolist(), strict=True)))


def _judge(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """(language, score) of each text. The texts are the rows of a sparse matrix of bucket counts, multiplied with the model's piece by piece."""
    width = len(model.languages)
    if not width:
        return [(UNKNOWN, 0.0)] * len(texts)
    totals = np.tile(model.priors, (len(texts), 1))
    seen = np.zeros(len(texts), dtype=bool)
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def multiply() -> None:
        if not waiting:
            return
        row, bucket, n = (np.concatenate(column) for column in zip(*waiting, strict=True))
        waiting.clear()
        first = model.starts[bucket]
        pairs = model.starts[bucket + 1] - first
        before = np.cumsum(pairs) - pairs
        at = np.arange(pairs.sum()) + np.repeat(first - before, pairs)
        cells = np.repeat(row * width, pairs) + model.places[at]
        totals.ravel()[:] += np.bincount(cells, weights=np.repeat(n, pairs) * model.gains[at], minlength=totals.size)

    entries = 0
    for i, text in enumerate(texts):
        for grams in _slices(text or ""):
            seen[i] = True
            totals[i] += len(grams) * model.unseen
            counts = np.bincount(grams, minlength=BUCKETS)
            buckets = np.flatnonzero(counts)
            pairs = np.cumsum(model.starts[buckets + 1] - model.starts[buckets])
            for part in np.split(buckets, np.searchsorted(pairs, np.arange(TOGETHER, pairs[-1], TOGETHER), side="right")):
                size = int((model.starts[part + 1] - model.starts[part]).sum())
                if entries + size > TOGETHER:
                    multiply()
                    entries = 0
                waiting.append((np.full(len(part), i), part, counts[part]))
                entries += size
    multiply()
    best = totals.argmax(axis=1)
    top = totals[np.arange(len(texts)), best]
    scores = 1 / np.exp(totals - top[:, None]).sum(axis=1)
    return [(model.languages[i], float(x)) if ok else (UNKNOWN, 0.0) for i, x, ok in zip(best, scores, seen, strict=True)]


def _shared(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(tuple(model))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``; only the text is looked at."""
    shared = _shared(docs, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, held, texts in chunks(batches, "doc_id", "held_out", "text"):
            said = _judge(texts, Model(*shared.value))
            yield pa.record_batch(
                {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "held_out": pa.array(held, pa.bool_()),
                    "lang_pred": pa.array([s[0] for s in said], pa.string()),
                    "score": pa.array([s[1] for s in said], pa.float64()),
                }
            )

    return docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        score, "doc_id bigint, held_out boolean, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with at least this score, with all their columns."""
    shared = _shared(docs, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [s[0] != UNKNOWN and s[1] >= least_score for (texts,) in chunks([batch], "text") for s in _judge(texts, Model(*shared.value))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    return predict(docs, fit(docs, training_rows))
