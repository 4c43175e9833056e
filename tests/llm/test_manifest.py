"""Resampling, byte-pair encoding and the Merkle manifest against brute force, on odd rows and on written tables."""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corelith.llm import bpe, merkle, queries, resampling
from corelith.llm.oracles import ORACLES
from corelith.plans.session import ship
from tests.llm import cases

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \t\n", "ΑΣ ΣΑΣ Σ.", "İstanbul", "I'LL don't 12 34", "a<|endoftext|>b<|startoftext|><|EndOfText|>", "a\x1cb. \x1d\x1e!?\x1f x",
    "Á ́  ́a", "漢字かな 한글", "\U00010d52 Ꟛ", "x" * 3000, "ab" * 2500, "ȩ́ ẞ", "\U0001f600\U0001f600!?",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_merkle"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    oracle = db.sql(ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(oracle.columns)
    assert sorted(map(str, map(tuple, got.select(*oracle.columns).collect()))) == sorted(map(str, oracle.fetchall()))


# Resampling


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def resampled(docs, target, percent, least, buckets, max_n):
    def features(text):
        found = words_of(text)
        return [" ".join(found[i : i + n]) for n in range(1, max_n + 1) for i in range(len(found) - n + 1)]

    place = lambda gram: zlib.crc32(gram.encode()) % buckets
    ours, theirs = [0] * buckets, [0] * buckets
    for counts, texts in ((ours, [d[1] for d in docs]), (theirs, target)):
        for text in texts:
            for gram in features(text):
                counts[place(gram)] += 1
    total, wanted = sum(ours), sum(theirs)
    gain = [math.floor(1000 * math.log(((t + 1) * (total + buckets)) / ((s + 1) * (wanted + buckets)))) for s, t in zip(ours, theirs, strict=True)]
    rows = []
    for doc_id, text in docs:
        found = features(text)
        weight = sum(gain[place(g)] for g in found) // len(found) if found else 0
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    place_of = {id(r): i + 1 for i, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((*r, place_of.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("max_n, percent, least", [(1, 10, 20), (2, 50, 3), (3, 100, 0)])
def test_resampling_by_brute_force(spark, max_n, percent, least):
    made = cases.rows()
    target = ["alpha beta gamma delta", None, "Straße xi OMICRON pi", ""]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    docs = cases.frame(spark, made).withColumn("weight", F.lit("clash")).withColumn("rank", F.lit("clash")).withColumn("bucket", F.lit("clash"))
    got = resampling.resample(docs, frame, percent, least, 500, max_n)
    assert sorted(map(tuple, got.collect()), key=str) == resampled([r[:2] for r in made], target, percent, least, 500, max_n)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(cases.frame(spark, []), none).count() == 0
    only = resampling.resample(cases.frame(spark), none, 10)
    assert only.count() == len(cases.rows()) and only.filter("rank is not null").count() > 0


def test_resampling_prefers_the_target(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("pine oak fir elm ash".split() if i % 10 == 0 else "red green blue white".split(), k=200)), "en", "a") for i in range(400)]
    target = spark.createDataFrame([("oak elm ash pine fir " * 50,)], "text string")
    drawn = [r["doc_id"] for r in resampling.resample(cases.frame(spark, docs), target).filter("rank is not null").collect()]
    assert len(drawn) == 40 and sum(i % 10 == 0 for i in drawn) >= 30


# Byte-pair encoding


def merged_plainly(symbols, ranks, made):
    symbols = list(symbols)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        rank, i = min(found)
        symbols[i : i + 2] = [made[rank]]


def test_segment_tree_against_plain_merging():
    rng = random.Random(4)
    for _ in range(400):
        ranks, made = {}, []
        while len(made) < 12:
            pair = (rng.randrange(3 + len(made)), rng.randrange(3 + len(made)))
            if pair not in ranks:
                ranks[pair] = len(made)
                made.append(3 + len(made))
        symbols = [rng.randrange(3) for _ in range(rng.randrange(40))]
        assert bpe.merge_all(symbols, ranks, made) == merged_plainly(symbols, ranks, made)


def test_bpe_against_the_library(spark):
    ship(spark)
    rng = random.Random(5)
    near = "".join(map(chr, range(0x20, 0x530)))
    texts = ODD + ["".join(rng.choices(near, k=80)) for _ in range(200)] + ["".join(rng.choices("éAÅÍ̇Σς <|endoftext|>'s", k=40)) for _ in range(200)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + cases.rows()
    rows[3] = (None, None, None, None)
    docs = cases.frame(spark, rows).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    whole = Tokenizer.from_file(VOCABULARY)
    expected = []
    for doc_id, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, ids, whole.decode(ids, skip_special_tokens=False)))
    got = [(r[0], np.frombuffer(r[1], "<u4").tolist(), r[2]) for r in bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert bpe.encode(cases.frame(spark, []), VOCABULARY).count() == 0


def test_words_are_forgotten_in_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    made, whole = bpe.Vocabulary(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    text = " ".join(f"word{i} {'long' * 20}{i}" for i in range(50))
    assert np.frombuffer(made.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(made.met) <= 5 and len(made.met_parts) <= 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_bpe_query(spark):
    whole = Tokenizer.from_file(VOCABULARY)
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, SF).collect()}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = whole.encode(text or "", add_special_tokens=False).ids
        row = got.pop(doc_id)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not got


# Merkle manifest


def hexed(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def proved_tree(digests, fanout):
    """The root, and for each digest its siblings by level as (left, right) lists."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i - i % fanout
            path.append((level[run:i], level[i + 1 : run + fanout]))
        level = [hexed("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


def manifest_of(rows):
    trees = {}
    for row in rows:
        hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None
        leaf = leaf_of(row, row["text"])
        key = b"" if row["source"] is None else b"s" + row["source"].encode()
        trees.setdefault(key, []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf, leaf_of(row, row["text"].replace("\n", "")) if hit else leaf, row["doc_id"]))
    made = {k: (sorted(v), *proved_tree([x[2] for x in sorted(v)], merkle.FANOUT)) for k, v in trees.items()}
    root, tops = proved_tree([made[k][1] for k in sorted(made)], merkle.FANOUT)
    out = []
    for key, top in zip(sorted(made), tops, strict=True):
        held, subroot, paths = made[key]
        for (_, _, leaf, changed, doc_id), path in zip(held, paths, strict=True):
            folded = changed
            for left, right in path + top:
                folded = hexed("".join([*left, folded, *right]))
            proof = "".join(d for left, right in path + top for d in [*left, *right])
            out.append((doc_id, leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_by_brute_force(spark, monkeypatch, levels):
    """Small blocks make several stages in each tree; rows with nulls, repeated ones and shared ids are among them."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", merkle.FANOUT**levels)
    ship(spark)
    made = cases.rows() + [(None, None, None, None), (500, "a\nb", "en", "é"), (501, "ab", None, "z\U0001f600")] + [(600 + i, "x\ny", "en", "hot") for i in range(25)]
    docs = cases.frame(spark, made).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit("clash")).withColumn("digest", F.lit("clash"))
    got = sorted(map(tuple, merkle.manifest(docs).collect()), key=str)
    assert got == manifest_of([r.asDict() for r in docs.collect()])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_few_rows(spark, n):
    docs = cases.frame(spark, [(i, f"text\n{i}", "en", "one") for i in range(n)])
    assert sorted(map(tuple, merkle.manifest(docs).collect()), key=str) == manifest_of([r.asDict() for r in docs.collect()])


def test_manifest_of_nothing(spark):
    assert merkle.manifest(cases.frame(spark, [])).count() == 0
