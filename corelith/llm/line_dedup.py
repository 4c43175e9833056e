"""Line deduplication by range-partitioned line hashes.

Every line's key (ends stripped, A-Z lower-cased) is hashed to 128 bits. The hashes are range
partitioned with sampled splitters, sorted by document and position within a hash, and one pass
names the first document of each hash. A key with more lines than a partition should hold is
never put into one task: its first document comes from a pre-aggregated minimum instead.

The result carries no text: a compressed bitmap per document that loses lines. The bitmap lists (word, mask) pairs only where lines are dropped; bit b of mask
w says that line 62 * w + b goes. ``apply_bitmaps`` turns bitmaps into kept texts.

Defined cases: a null or empty text is one empty line; short keys (fewer than ``min_chars`` code
points) always stay; all lines of a key in its first document stay, repeats included; a null
doc_id is one document that sorts last; rows that share a doc_id are parts of one document, so a
key in two of them does not count as shared; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelith.llm.common import BLANKS, ascii_lower, key128
from corelith.plans.session import cut, partitions

WORD_BITS = 62


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key is long enough to be judged."""
    text = F.coalesce("text", F.lit(""))
    # The hash is made below the explosion: beside it, it would be made again for each line.
    whole = docs.select("doc_id", F.xxhash64(text).alias("row"), F.split(text, "\n").alias("lines"))
    each = whole.select("doc_id", "row", F.posexplode("lines").alias("pos", "line")).select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
    h1, h2 = key128(F.col("key"))
    return each.filter(F.char_length("key") >= min_chars).select("doc_id", "row", "pos", h1.alias("h1"), h2.alias("h2"))


def line_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, row, words) for documents that lose lines; words is an array of (word, mask).

    ``row`` is a hash of the text that tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    lines = cut(_lines(docs, min_chars))  # the texts are split once; what follows reads hashes
    # Keys with over a quarter of an average partition's lines. Counting hash ranges first keeps this
    # pass small: a range below the bound holds no such key.
    ranges = 64 * n
    spread = F.pmod(F.col("h1"), F.lit(ranges))
    counts = cut(lines.groupBy(spread.alias("range")).agg(F.count(F.lit(1)).alias("lines")))
    total = counts.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    bound = max(1000, total // (4 * n))
    # At most 4 n ranges can pass the bound, so they and the keys in them above it fit a broadcast.
    busy = counts.filter(F.col("lines") > bound).select("range")
    hot = (
        lines.withColumn("range", spread)
        .join(F.broadcast(busy), "range", "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("doc_id").alias("hot_first"))
        .filter(F.col("lines") > bound)
        .select("h1", "h2", "hot_first")
    )
    hot = cut(hot)
    by_line = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "row", "pos")
    streamed = (
        lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
        .repartitionByRange(n, "h1", "h2")
        .withColumn("first", F.first("doc_id").over(by_line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    )
    known = lines.join(F.broadcast(hot), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("hot_first")))
    dropped = streamed.select("doc_id", "row", "pos").unionByName(known.select("doc_id", "row", "pos"))
    # The same row stored twice has the same lines dropped, so bit_or keeps the masks right.
    words = (
        dropped.groupBy("doc_id", "row", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % WORD_BITS).cast("int"))).alias("mask"))
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("words"))
    )
    return words


def _by_place(words: Column) -> Column:
    """The masks as an array with a 0 for each word that the bitmap leaves out, so that a line finds its mask at once."""

    def with_gap(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(words, i - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("bigint"), x["word"] - before - 1), F.array(x["mask"]))

    return F.flatten(F.transform(words, with_gap))


def apply_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped, which replace columns of these names."""
    words = line_bitmaps(docs, min_chars).select(
        F.col("doc_id").alias("__id"),
        F.col("row").alias("__row"),
        F.col("words").alias("__words"),
        # Made on this side of the join: below it, the optimizer could move the array into the test of each line.
        _by_place(F.col("words")).alias("__masks"),
    )
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.withColumn("__own_row", F.xxhash64(text)).join(
        words, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own_row") == F.col("__row")), "left"
    )
    lines = F.split(text, "\n")
    stays = lambda x, i: (
        F.coalesce(
            F.call_function(
                "shiftright", F.get(F.col("__masks"), F.floor(i / WORD_BITS).cast("int")), (i % WORD_BITS).cast("int")
            ).bitwiseAND(F.lit(1).cast("bigint")),
            F.lit(0).cast("bigint"),
        )
        == 0
    )
    n_dropped = F.aggregate("__words", F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w["mask"]))
    clean = F.col("__words").isNull()
    return joined.select(
        *[docs[c] for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")],
        F.when(clean, text).otherwise(F.array_join(F.filter(lines, stays), "\n")).alias("kept_text"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0).cast("bigint")).alias("n_dropped"),
    )
