"""A corpus pipeline of five stages over documents; each works on all that the one before kept.

All stages but the last return the columns of documents. A stage's function takes (spark, docs, sf_dir).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corelith.llm import language, line_dedup, mixing, near_dedup, packing
from corelith.llm.common import table
from corelith.llm.queries import tokenizer_files
from corelith.plans.session import cut, ship, stored


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or whose language is not told with a score of 0.5."""
    ship(spark)
    return language.keep_identified(docs, language.fit(docs))


def _slim(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the needed columns and all others in one, so that no name clashes with a stage's own; and the way back."""
    others = [c for c in docs.columns if c not in needed]
    slim = docs.select(*needed, F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("__others"))
    return slim, [F.col(c) if c in needed else F.col("__others")[c].alias(c) for c in docs.columns]


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has are cut out of texts; n_chars follows."""
    slim, columns = _slim(docs, "doc_id", "text")
    kept = line_dedup.apply_bitmaps(slim)
    fresh = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return kept.select(*[fresh[c].alias(c) if c in fresh else column for c, column in zip(docs.columns, columns, strict=True)])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    ship(spark)
    kept = near_dedup.near_components(docs).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    slim, columns = _slim(docs, "doc_id")
    return slim.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, perhaps never; the last one of a source may be cut after a word."""
    taken = mixing.mix_sources(docs).filter("taken > 0")
    key = [F.col(c).alias(f"__{c}_of") for c in ("doc_id", "row", "source")]
    copies = cut(
        taken.groupBy(*key).agg(
            F.sum(F.expr("taken div size")).alias("__copies"), F.sum(F.expr("taken % size")).alias("__words"), F.count(F.lit(1)).alias("__rows")
        )
    )
    slim, columns = _slim(docs, "doc_id", "text", "source")
    rows = slim.withColumn("__row", F.xxhash64(F.coalesce("text", F.lit(""))))
    if not copies.filter("__rows > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "__row", "source"])  # their copies are counted together
    same = (
        F.col("doc_id").eqNullSafe(F.col("__doc_id_of")) & (F.col("__row") == F.col("__row_of")) & F.col("source").eqNullSafe(F.col("__source_of"))
    )
    turns = F.sequence(F.lit(1), F.col("__copies") + F.when(F.col("__words") > 0, 1).otherwise(0))
    drawn = rows.join(copies, same).withColumn("__copy", F.explode(turns))
    partly = F.col("__copy") > F.col("__copies")
    head = F.when(partly, mixing.first_words(F.col("text"), F.col("__words"))).otherwise(F.col("text"))
    fresh = {"text": lambda c: head, "n_chars": lambda c: F.when(partly, F.char_length(head).cast("bigint")).otherwise(c)}
    return drawn.select(*[fresh.get(c, lambda c: c)(column).alias(c) for c, column in zip(docs.columns, columns, strict=True)])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences; see ``packing.pack_documents``."""
    ship(spark)
    return packing.pack_documents(docs, *tokenizer_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language identification and tokens cannot be written in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
