"""Importance resampling of documents towards a target distribution of hashed n-grams.

Texts are lower-cased (A-Z) and split into words; the features of a text are its runs of 1 to ``max_n`` words. A feature's
bucket is its CRC-32 modulo ``buckets``. What a bucket gains is the log ratio of its smoothed shares in the target and in
the documents, in thousandths; a document's weight is the mean gain of its features. Gumbel noise from a hash of doc_id,
added to the weight, makes the highest scores a sample without replacement.

Everything is Spark SQL: n-gram arrays are exploded and counted by bucket (a partition sends at most ``buckets`` rows), the gain table,
of at most ``buckets`` rows, is broadcast, and sums by document are complete before they are shuffled, as a text's features
stay in one partition. Ranks come from a range-partitioned sort and the partitions' sizes.

Defined cases: a null or empty text has no features and weight 0; rows that share a doc_id are documents of their own, with
the same noise, and rank by weight, then by number of features; a null doc_id hashes as the empty string and ranks after
others of its score; an empty target gains by the documents' own shares alone; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelith.llm.common import ascii_lower, placed
from corelith.plans.session import cut

BUCKETS = 10_000
#: What stands between words once A-Z are lower-cased: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEED = 2024


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _runs(found: Column, n: int) -> Column:
    each = F.transform(found, lambda _, i: F.array_join(F.slice(found, i + 1, F.lit(n)), " "))
    return F.slice(each, F.lit(1), F.greatest(F.size(found) - (n - 1), F.lit(0)))


def grams(found: Column, max_n: int) -> Column:
    """All runs of 1 to ``max_n`` consecutive words, joined by one blank."""
    runs = [found, *[_runs(found, n) for n in range(2, max_n + 1)]]
    return runs[0] if max_n == 1 else F.flatten(F.array(*runs))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_n: int = 1) -> DataFrame:
    """(bucket, n): how many features of the texts fall into each bucket that has any."""
    each = texts.select(words(F.col("text")).alias("words")).select(F.explode(grams(F.col("words"), max_n)).alias("gram"))
    return each.select(bucket(F.col("gram"), buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_n: int = 1) -> DataFrame:
    """(bucket, gain): thousandths of the log ratio of a bucket's smoothed shares, for buckets in use."""
    none = F.lit(0).cast("bigint")
    ours = bucket_counts(docs, buckets, max_n).select("bucket", F.col("n").alias("s"), none.alias("t"))
    theirs = bucket_counts(target, buckets, max_n).select("bucket", none.alias("s"), F.col("n").alias("t"))
    counts = cut(ours.unionByName(theirs).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = counts.agg(F.coalesce(F.sum("s"), none).alias("s"), F.coalesce(F.sum("t"), none).alias("t")).first()
    ours_all, theirs_all = F.lit(float(total["s"] + buckets)), F.lit(float(total["t"] + buckets))
    ratio = ((F.col("t") + 1).cast("double") * ours_all) / ((F.col("s") + 1).cast("double") * theirs_all)
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gains: DataFrame, buckets: int = BUCKETS, max_n: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs``.

    A row's features follow each other in one partition, so the sums by row are whole before any shuffle.
    """
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), words(F.col("text")).alias("words"))
    each = read.select("row", "doc_id", F.size("words").alias("n_words"), F.explode_outer(grams(F.col("words"), max_n)).alias("gram"))
    found = each.select("row", "doc_id", "n_words", bucket(F.col("gram"), buckets).alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    summed = found.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("bigint").alias("gain"))
    floored = F.expr("(gain - pmod(gain, n_features)) div n_features")
    weight = F.when(F.col("n_features") > 0, floored).otherwise(0).cast("bigint")
    return summed.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_features", weight.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = BUCKETS, max_n: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank, from 1, is null for those not drawn.

    Drawn are the ``percent`` of the documents of at least ``least_words`` words with the highest scores, ties to the smaller
    doc_id.
    """
    made = weighted(docs, gain_table(docs, target, buckets, max_n), buckets, max_n)
    scored = cut(made.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("bigint")))
    fit = F.col("n_words") >= least_words
    drawn = scored.filter(fit).count() * percent // 100
    order = [F.when(fit, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    ranked = placed(scored.withColumn("all", F.lit(0)), "all", order)
    rank = F.when(fit & (F.col("rank") < drawn), F.col("rank") + 1).cast("bigint")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
