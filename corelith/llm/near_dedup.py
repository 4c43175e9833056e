"""MinHash near-deduplication with sequential Bayesian verification.

1. Every text becomes its set of five-word shingles, a digest of the set, and a MinHash signature. Texts with
   equal sets are one class; from here on a class is one node.
2. Signatures are cut into bands. In each bucket of a band the members are paired with one leader, the member
   whose buckets hold the most members in all, so a bucket of n members gives n - 1 pairs. In a group of copies
   of one text that text has the commonest hashes, leads all its buckets and meets all its copies.
3. Pairs are compared signature batch by signature batch. After each batch a pair is dropped once the
   posterior probability that its similarity reaches the threshold, under a uniform prior, is below
   ``MISS``. Survivors are verified exactly on the full sets of words; a text is sent once for each leader it meets.
4. Components of the verified pairs are formed. Buckets that still hold more than one component may hide
   links between members other than the leader. Linked sets must share one of the rarest quarter of their
   shingles, so members meet by those, between different components only. Where few meet, they are paired. Where many
   meet, ``_apart`` leaves pairs only between sets that differ from the group's common shingles in similar ways.
   These pairs go through step 3. No bucket is capped.
5. Components of all links give the result.

At 32 bands of 4, a pair at similarity 0.75 shares no bucket with probability 5e-6.

Defined cases: a text with fewer than five words has its whole word sequence as its only shingle; without words
or text a set is empty and links with nothing; rows that share a doc_id are one document, linked through any of
its texts; a row with a null doc_id is linked with nothing and stays; repeated rows get one result row each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.llm.common import chunks
from corelith.operators.components import connected_components
from corelith.operators.spread import share, spread_join
from corelith.plans.session import cut

BANDS, ROWS, BATCH = 32, 4, 16
SHINGLE = 5
PERCENT = 75
MISS = 1e-6
#: Groups of up to so many members are paired across components at once: groups by a rare hash alone, and groups
#: by a hash that sets apart from what is common, where few of the pairs pass the bounds.
FEW, FEW_APART = 8, 256
#: Members of a group whose common shingles stand for those of the group.
SAMPLED = 9
#: Times that a group of many members is split before its pairs are compared by their differences.
LEVELS = 2
#: Words of 64 bits in the filter that keeps texts without a candidate from being shuffled: 8 MB when broadcast.
FILTER_WORDS = 1 << 19
#: Buckets of the frequency table that orders shingles from rare to common.
FREQUENCIES = 1 << 19
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORD_HASHES = _WordHashes()


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words; bytes.lower and bytes.split know ASCII letters and white space only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    """The exact set, as tuples of words."""
    w = words(text)
    if len(w) < SHINGLE:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(text: str | None) -> np.ndarray:
    """The set's 64-bit hashes, ascending."""
    w = words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORD_HASHES.__getitem__, w), dtype=np.uint64, count=len(w))
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += _mix(h[i : i + n] ^ _ODD[i]) * _ODD[i]
    return np.unique(_mix(total))


def set_digest(hashes: np.ndarray) -> bytes:
    """16 bytes of a cryptographic hash over all members, ascending; empty for an empty set."""
    if not len(hashes):
        return b""
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n, None] | np.uint64(1), seeds[n:, None]


_TIMES, _PLUS = (x.astype(np.uint32) for x in _multipliers(BANDS * ROWS))


def signature(hashes: np.ndarray) -> bytes:
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(hashes), 2000):
        keyed = (hashes[start : start + 2000] >> np.uint64(32)).astype(np.uint32)[None, :] ^ _PLUS
        keyed *= _TIMES
        np.minimum(low, keyed.min(axis=1), out=low)
    return low.tobytes()


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) for each batch.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), whose upper tail is the
    binomial sum below.
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _sketches(docs: DataFrame) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in chunks(batches, "doc_id", "text"):
            made: list[tuple] = []
            for text in texts:
                hashes = shingle_hashes(text)
                made.append((len(hashes), set_digest(hashes), signature(hashes) if len(hashes) else b""))
            n, c, sig = zip(*made, strict=True)
            yield pa.record_batch(
                {"doc_id": pa.array(doc_ids, pa.int64()), "n": pa.array(n, pa.int64()), "c": pa.array(c, pa.binary()), "sig": pa.array(sig, pa.binary())}
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sketch, "doc_id bigint, n bigint, c binary, sig binary")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, c, text) of the documents in ``ids`` (rep). A bit array of bounded size keeps most other texts from being shuffled."""
    spot = F.pmod(F.xxhash64(F.lit("spot"), "doc_id"), F.lit(FILTER_WORDS * 64))
    bits = (
        ids.select(F.col("rep").alias("doc_id"))
        .select(spot.alias("spot"))
        .groupBy(F.floor(F.col("spot") / 64).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("spot") % 64).cast("int"))).alias("mask"))
    )
    found = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .withColumn("spot", spot)
        .withColumn("word", F.floor(F.col("spot") / 64))
        .join(F.broadcast(bits), "word")
        .filter(F.call_function("getbit", "mask", (F.col("spot") % 64).cast("int")) == 1)
        .select("doc_id", "text")
    )

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in chunks(batches, "doc_id", "text"):
            digests = [set_digest(shingle_hashes(t)) for t in texts]
            yield pa.record_batch(
                {"doc_id": pa.array(doc_ids, pa.int64()), "text": pa.array(texts, pa.string()), "c": pa.array(digests, pa.binary())}
            )

    # The exact test comes after the Python step: put before it, the optimizer would move it below the filter.
    classes = found.mapInArrow(classed, "doc_id bigint, text string, c binary")
    return classes.join(ids.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Those of the distinct ``pairs`` (lead, c) of classes whose sets are similar enough, as (a, b)."""
    spark = docs.sparkSession
    steps = least_matches(percent / 100, miss)
    limit = share(pairs.count(), spark)
    led = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("members"))
    leads = cut(led.join(classes.withColumnRenamed("c", "lead"), "lead").select("lead", "members", *[F.col(k).alias(f"{k}_lead") for k in ("n", "rep", "sig")]))
    sized = (F.col("n_lead") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("n_lead") * percent)
    both = spread_join(pairs, leads, "lead", "c", limit).join(classes, "c").filter(sized)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch[k]), dtype=np.uint32).reshape(len(batch), -1) for k in ("sig_lead", "sig"))
            alive, same, done = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64), 0
            for n, least in steps:
                same[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[same[alive] >= least], n
            yield batch.iloc[alive][["lead", "c", "rep_lead", "rep"]]

    likely = cut(both.mapInPandas(prune, "lead binary, c binary, rep_lead bigint, rep bigint"))
    texts = cut(_texts_of(docs, likely.select(F.explode(F.array("rep_lead", "rep")).alias("rep")).distinct()))
    # A leader's text goes before the texts it is compared with, once for each share of its pairs.
    meetings = cut(likely.groupBy("lead", "rep_lead").agg(F.count(F.lit(1)).alias("members")))
    shares = F.call_function("div", F.col("members"), F.lit(limit)) + 1
    led = likely.join(
        F.broadcast(meetings.filter(F.col("members") >= limit).select("lead", "rep_lead", shares.alias("shares"))), ["lead", "rep_lead"], "left"
    ).select("lead", F.pmod(F.xxhash64("c"), F.coalesce("shares", F.lit(1))).alias("share"), "rep", "c")
    member = led.join(texts.withColumnRenamed("doc_id", "rep"), ["rep", "c"]).select("lead", "share", F.lit(True).alias("led"), "c", "text")
    leader = meetings.join(texts.select(F.col("doc_id").alias("rep_lead"), F.col("c").alias("lead"), "text"), ["rep_lead", "lead"]).select(
        "lead", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)).alias("share"), F.lit(False).alias("led"), F.col("lead").alias("c"), "text"
    )
    streams = leader.unionByName(member).repartition("lead", "share").sortWithinPartitions("lead", "share", "led")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, x = None, set()
        for columns in chunks(batches, "lead", "led", "c", "text"):
            linked = []
            for lead, led, c, text in zip(*columns, strict=True):
                if not led:
                    of, x = lead, shingle_set(text)
                    continue
                if of != lead:
                    raise RuntimeError("a leader's text is missing")
                y = shingle_set(text)
                shared = len(x & y)
                if x and 100 * shared >= percent * (len(x) + len(y) - shared):
                    linked.append((lead, c))
            yield pa.record_batch({k: pa.array([pair[i] for pair in linked], pa.binary()) for i, k in enumerate("ab")})

    return cut(streams.mapInArrow(confirm, "a binary, b binary").distinct())


def _longs(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True))


def _hashed(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(c, label, delta): the shingle hashes of ``members`` (c, rep, label), written once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, label, texts in chunks(batches, "c", "label", "text"):
            sets = [shingle_hashes(text).view(np.int64) for text in texts]
            ends = np.cumsum([0, *map(len, sets)])
            delta = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))
            yield pa.record_batch({"c": pa.array(c, pa.binary()), "label": pa.array(label, pa.binary()), "delta": delta})

    texts = _texts_of(docs, members).join(members.select("c", "label", F.col("rep").alias("doc_id")), ["doc_id", "c"])
    once = texts.dropDuplicates(["doc_id", "c"])  # a row may be stored twice
    return cut(once.mapInArrow(hashes, "c binary, label binary, delta array<bigint>"))


def _meetings(places: DataFrame) -> DataFrame:
    """(g, members) of the groups in ``places`` (g, label, ...) that hold more than one component."""
    of = places.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("members"))
    return of.filter("x <> y").select("g", "members")


def _pairs_in(places: DataFrame, percent: int) -> DataFrame:
    """(lead, c): pairs of members of one group in different components that may be linked.

    ``places`` has (g, c, label, n, need, spare, rest): the set's size; 2 (100 + percent) times the part that it needs
    of the overlap of two sets of differences; the most that the other may need; how many of its differences that
    others have are still to come at this one, itself included.
    """
    other = places.select("g", *[F.col(k).alias(f"{k}_b") for k in ("c", "label", "n", "need", "spare", "rest")])
    fits = (
        (F.col("c") < F.col("c_b"))
        & (F.col("label") != F.col("label_b"))
        & (F.col("n") * 100 >= F.col("n_b") * percent)
        & (F.col("n_b") * 100 >= F.col("n") * percent)
        & (F.col("need") <= F.col("spare_b"))
        & (F.col("need_b") <= F.col("spare"))
        & (F.least("rest", "rest_b") * (2 * (100 + percent)) >= F.col("need") + F.col("need_b"))
    )
    pairs = places.join(other.withColumnRenamed("g", "g_b"), (F.col("g") == F.col("g_b")) & fits)
    return pairs.select(F.col("c").alias("lead"), F.col("c_b").alias("c"))


def _rarest(deltas: Iterator[np.ndarray], counts: list[int], often: np.ndarray) -> list[np.ndarray]:
    """Of each array of hashes the given number of those that are rare by a table of counts, in an order common to all."""
    out = []
    for signed, n in zip(deltas, counts, strict=True):
        hashes = signed.view(np.uint64)
        out.append(signed[np.lexsort((hashes, often[(hashes % np.uint64(FREQUENCIES)).astype(np.int64)]))[:n]])
    return out


def _apart(held: DataFrame, percent: int, often, first_level: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of members of large groups that may be linked; none is missed.

    ``held`` has (g, c, label, n, alone, delta): in a group g, the class c of component label and set size n
    differs from what the group has in common by the hashes in delta and by ``alone`` more, which no other
    component has. Returns certain links (lead, c), places as ``_pairs_in`` takes them, and each (g, c) with what
    is left of delta for the next level.

    The common hashes are those of most of a few members. Whatever they are, the symmetric difference of two sets is that
    of their deltas, so with the threshold p per cent, sets a and b are linked just if
    (100 + p) (|da| + |db| - 2 |da and db|) <= (100 - p) (|a| + |b|). With need = (100 + p) |d| - (100 - p) |set|
    this says 2 (100 + p) |da and db| >= need_a + need_b. Where the right side is not positive the link is certain.
    Otherwise a and b share one of the |d| - ceil((need_a + need_b) / (2 (100 + p))) + 1 rarest members of each delta.
    Since they can share only what other components have too, need_a is at most 2 (100 + p) |db| - need_b,
    with those members of db alone counted.
    """
    spark = held.sparkSession
    over, under = 100 + percent, 100 - percent
    limit = share(held.count(), spark)
    sizes = cut(held.groupBy("g").agg(F.count(F.lit(1)).alias("members")))
    first = F.min(F.struct(F.xxhash64("g", "c").alias("order"), F.col("c").alias("c")))
    picked = held.groupBy("g", F.pmod(F.xxhash64("c"), F.lit(SAMPLED)).alias("slot")).agg(first["c"].alias("c")).select("g", "c")
    sample = cut(held.join(picked, ["g", "c"], "left_semi").select("g", "delta"))
    most = (
        sample.select("g", F.explode("delta").alias("token"))
        .groupBy("g", "token")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(sample.groupBy("g").agg(F.count(F.lit(1)).alias("of")), "g")
        .filter(F.col("times") * 2 > F.col("of"))
        .groupBy("g")
        .agg(F.collect_list("token").alias("common"))
    )
    common = cut(sizes.join(most, "g", "left").select("g", "members", F.coalesce("common", F.array().cast("array<bigint>")).alias("common")))
    moved = (
        spread_join(held, common, "g", "c", limit)
        .withColumns({"more": F.array_except("delta", "common"), "fewer": F.array_except("common", "delta")})
        # Of the overlap that a needs, p per cent of its size, what is not among the common hashes is in both deltas.
        .withColumn("both", F.ceil(F.col("n") * percent / 100) - F.col("n") + F.size("more") if first_level else F.lit(1))
        .withColumn("delta", F.concat("more", "fewer"))
        .withColumn("need", (F.col("alone") + F.size("delta")) * over - F.col("n") * under)
        .select("g", "c", "label", "n", "alone", "delta", "need", F.col("both").cast("bigint").alias("both"))
    )
    moved = cut(moved)
    least = F.min(F.struct(F.col("need").alias("need"), F.col("c").alias("c"), F.col("label").alias("label")))
    lowest = cut(moved.groupBy("g").agg(least.alias("least"), F.count(F.lit(1)).alias("members")))
    known = spread_join(moved, lowest, "g", "c", limit).withColumn(
        "shares", F.greatest(F.lit(1), "both", F.ceil((F.col("need") + F.col("least.need")) / (2 * over)))
    )
    certain = known.filter(F.expr("need + least.need <= 0 and label <> least.label and c <> least.c")).select(F.col("least.c").alias("lead"), "c")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                tokens = _rarest(_longs(part.column("delta")), part.column("take").to_pylist(), often.value)
                where = pa.array(np.repeat(np.arange(part.num_rows), list(map(len, tokens))))
                named = {name: part.column(name).take(where) for name in ("g", "c", "label")}
                yield pa.record_batch({**named, "token": pa.array(np.concatenate(tokens))})

    # Who shares none of a prefix with other components is out; hashes of labels are told apart here, which is enough to tell that.
    taken = known.select("g", "c", "label", "delta", F.greatest(F.lit(0), F.size("delta") - F.col("shares") + 1).alias("take"))
    tried = cut(
        taken.filter("take > 0")
        .mapInArrow(prefixes, "g bigint, c binary, label binary, token bigint")
        .select("g", "c", F.xxhash64("label").alias("label"), F.xxhash64("g", "token").alias("t"))
    )
    seen = cut(_meetings(tried.select(F.col("t").alias("g"), "label")).withColumnRenamed("g", "t"))
    able = spread_join(tried, seen, "t", "c", share(seen.agg(F.sum("members")).first()[0] or 0, spark)).select("g", "c").distinct()
    moved = cut(known.select("g", "c", "label", "n", "alone", "delta", "need", "both").join(able, ["g", "c"]))
    tokens = moved.select("g", "c", F.xxhash64("label").alias("label"), F.explode("delta").alias("token")).withColumn("t", F.xxhash64("g", "token"))
    met = cut(_meetings(tokens.select(F.col("t").alias("g"), "label")).withColumnRenamed("g", "t"))
    shared = (
        spread_join(tokens.drop("label"), met, "t", "c", share(met.agg(F.sum("members")).first()[0] or 0, spark))
        .groupBy("g", "c")
        .agg(F.sort_array(F.collect_list(F.struct("members", "token"))).alias("ordered"))
    )
    state = (
        moved.join(shared, ["g", "c"], "left")
        .withColumn("ordered", F.coalesce(F.col("ordered")["token"], F.array().cast("array<bigint>")))
        .withColumn("spare", F.size("ordered") * (2 * over) - F.col("need"))
        .withColumn("alone", F.col("alone") + F.size("delta") - F.size("ordered"))
        .drop("delta")
    )
    state = cut(state)
    bounds = state.groupBy("g").agg(F.max("spare").alias("most"), F.min("need").alias("low"), F.count(F.lit(1)).alias("members"))
    able = spread_join(state, cut(bounds), "g", "c", limit).filter("need <= most")
    least_shared = F.greatest(F.lit(1), "both", F.ceil((F.col("need") + F.col("low")) / (2 * over)))
    prefix = F.slice("ordered", F.lit(1), F.greatest(F.lit(0), F.size("ordered") - least_shared + 1).cast("int"))
    places = able.select("g", "c", "label", "n", "need", "spare", F.size("ordered").alias("all"), F.posexplode(prefix).alias("at", "token")).select(
        F.xxhash64("g", "token").alias("g"), "c", "label", "n", "need", "spare", (F.col("all") - F.col("at")).alias("rest"), F.col("g").alias("of")
    )
    return certain, places, state.select("g", "c", "label", "n", "alone", F.col("ordered").alias("delta"))


def _split(places: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """``places`` of groups with several components: those of at most ``few`` members, and the others."""
    met = cut(_meetings(places))
    mixed = cut(spread_join(places, met, "g", "c", share(met.agg(F.sum("members")).first()[0] or 0, places.sparkSession)))
    return mixed.filter(F.col("members") <= few).drop("members"), mixed.filter(F.col("members") > few)


def _gathered(many: DataFrame, held: DataFrame, of: str | None) -> DataFrame:
    """The rows of ``held`` dealt into groups for the next level.

    Members that meet at several hashes should be compared once. So hashes are gathered under the member that has
    most of them: a pair that meets at a hash is in the group of that hash's leader.
    """
    often = many.groupBy("c").agg(F.count(F.lit(1)).alias("often"))
    placed = cut(many.join(often, "c").select("g", "c", "often", "members", *([of] if of else [])))
    lead = F.max(F.struct("often", "c"))["c"]
    leads = cut(placed.groupBy("g").agg(lead.alias("lead"), F.count(F.lit(1)).alias("members")))
    keys = [F.xxhash64(*([F.col(of)] if of else []), F.col("lead")).alias("g"), "c", *([F.col(of)] if of else [])]
    dealt = spread_join(placed.drop("members"), leads, "g", "c", share(placed.count(), held.sparkSession)).select(*keys).distinct()
    if of is None:
        return cut(dealt.join(held, "c"))
    return cut(dealt.join(held.withColumnRenamed("g", of), [of, "c"]).drop(of))


def _across(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (lead, c) of ``members`` (c, rep, label) in different components that may be linked; none is missed.

    Linked sets share one of the rarest n - ceil(percent n / 100) + 1 shingles of each, in any order common to
    all sets; a table of bounded size says how common a shingle is. Where they share the first one in this order,
    both have enough shingles left.
    """
    spark = docs.sparkSession
    held = _hashed(docs, members)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCIES, dtype=np.int64)
        for batch in batches:
            spots = batch.column("delta").flatten().to_numpy().view(np.uint64) % np.uint64(FREQUENCIES)
            total += np.bincount(spots.astype(np.int64), minlength=FREQUENCIES)
        filled = np.flatnonzero(total > 1)
        yield pa.record_batch({"spot": pa.array(filled), "n": pa.array(total[filled])})

    tallied = held.select("delta").mapInArrow(tally, "spot bigint, n bigint").groupBy("spot").agg(F.sum("n").alias("n")).toArrow()
    common = np.ones(FREQUENCIES, dtype=np.int64)
    common[tallied["spot"].to_numpy()] = tallied["n"].to_numpy()
    shared = spark.sparkContext.broadcast(common)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                sizes = np.diff(part.column("delta").offsets.to_numpy()).astype(np.int64)
                times = sizes - (percent * sizes + 99) // 100 + 1
                tokens = _rarest(_longs(part.column("delta")), times.tolist(), shared.value)
                rests = [n - np.arange(k) for n, k in zip(sizes, times, strict=True)]
                where = pa.array(np.repeat(np.arange(part.num_rows), times))
                yield pa.record_batch(
                    {
                        "g": pa.array(np.concatenate(tokens)),
                        "c": part.column("c").take(where),
                        "label": part.column("label").take(where),
                        "n": pa.array(np.repeat(sizes, times)),
                        "rest": pa.array(np.concatenate(rests)),
                    }
                )

    # Against nothing in common a set is its own delta: need = percent n, and at most all of it is shared.
    rare = held.mapInArrow(prefixes, "g bigint, c binary, label binary, n bigint, rest bigint")
    rare = cut(rare.withColumn("need", F.col("n") * (2 * percent)).withColumn("spare", F.col("n") * 200))
    few, many = _split(rare, FEW)
    found = [_pairs_in(few, percent)]
    if many.isEmpty():
        return cut(found[0].distinct())
    sets = held.select("c", "label", F.size("delta").cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("alone"), "delta")
    grouped = _gathered(many, sets, None)
    for level in range(LEVELS):
        certain, places, left = _apart(grouped, percent, shared, level == 0)
        few, many = _split(cut(places), FEW_APART)
        found += [certain, _pairs_in(few.drop("of"), percent)]
        if many.isEmpty():
            break
        if level == LEVELS - 1:
            found.append(_pairs_in(many.drop("of", "members"), percent))
        else:
            grouped = _gathered(many, left, "of")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return cut(pairs.select(F.least("lead", "c").alias("lead"), F.greatest("lead", "c").alias("c")).distinct())


def near_components(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    spark = docs.sparkSession
    slim = cut(_sketches(docs))
    classes = cut(
        slim.filter("n > 0 and doc_id is not null")
        .groupBy("c")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    )
    width = 4 * ROWS
    keys = [F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)]
    bands = classes.select("c", F.explode(F.array(*keys)).alias("key"))
    crowds = cut(bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    limit = share(crowds.agg(F.sum("members")).first()[0] or 0, spark)
    shared = cut(spread_join(bands, crowds, "key", "c", limit))
    central = shared.groupBy("c").agg(F.sum("members").alias("weight"))
    weighed = cut(shared.join(central, "c"))
    leads = cut(weighed.groupBy("key").agg(F.max(F.struct("weight", "c"))["c"].alias("lead"), F.count(F.lit(1)).alias("members")))
    star = cut(spread_join(weighed.select("key", "c"), leads, "key", "c", limit).filter("c <> lead").select("lead", "c").distinct())
    links = _verify(docs, classes, star, percent, miss)

    labels = cut(connected_components(links, "a", "b"))
    labelled = cut(
        shared.join(labels.select(F.col("id").alias("c"), "component"), "c", "left").select("key", "c", F.coalesce("component", "c").alias("label"))
    )
    undecided = cut(_meetings(labelled.withColumnRenamed("key", "g")).withColumnRenamed("g", "key"))
    open_rows = spread_join(labelled, undecided, "key", "c", limit)
    members = cut(open_rows.select("c", "label").distinct().join(classes.select("c", "rep"), "c"))
    if not members.isEmpty():
        met = star.select(F.least("lead", "c").alias("lead"), F.greatest("lead", "c").alias("c"))
        pairs = cut(_across(docs, members, percent).join(met, ["lead", "c"], "left_anti"))
        links = links.unionByName(_verify(docs, classes, pairs, percent, miss))

    nodes = slim.filter("n > 0 and doc_id is not null").select("doc_id", "c")
    several = nodes.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a <> z")
    same_document = nodes.join(several.select("doc_id", "a"), "doc_id").filter("c <> a").select("a", F.col("c").alias("b"))
    joined = connected_components(links.unionByName(same_document), "a", "b")
    placed = classes.select("c", "rep").join(joined.withColumnRenamed("id", "c"), "c", "left").withColumn(
        "component", F.coalesce("component", "c")
    )
    lowest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(lowest, "component").select("c", "component_id")
    return (
        slim.select("doc_id", F.col("n").alias("n_shingles"), "c")
        .join(named, "c", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
