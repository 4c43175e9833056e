from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
from corelith.llm import mixing
from tests.llm import cases
from tests.llm.test_dedup import expected_components, expected_lines

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_stages_one_after_another(spark, tmp_path):
    made = [(*r, len(r[1] or "")) for r in cases.rows()]
    spark.createDataFrame(made, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]

    def run(name, docs):
        out = stage[name](spark, docs, str(tmp_path))
        path = str(tmp_path / f"{name}.parquet")
        out.write.parquet(path)
        return spark.read.parquet(path)

    rows = lambda df: [tuple(r) for r in df.select(*COLUMNS).collect()]

    named = run("language_id", docs)
    assert named.columns == COLUMNS
    assert Counter(rows(named)) == Counter(r for r in made if any(c.isalpha() for c in r[1] or ""))

    cut = run("line_dedup", named)
    assert cut.columns == COLUMNS
    expected = Counter((r[0], r[3]) for r in expected_lines(rows(named)))
    assert Counter((r[0], r[1]) for r in rows(cut)) == expected
    assert all(r[4] == len(r[1]) for r in rows(cut))

    single = run("near_dedup", cut)
    assert single.columns == COLUMNS
    keep = {r[0] for r in expected_components(rows(cut)) if r[3]}
    assert Counter(rows(single)) == Counter(r for r in rows(cut) if r[0] in keep)

    mix = run("mixing", single)
    assert mix.columns == COLUMNS
    taken = Counter()
    for r in mixing.mix_sources(single).collect():
        if r["taken"]:
            taken[r["doc_id"], r["source"]] += r["taken"]
    words = Counter()
    for r in rows(mix):
        words[r[0], r[3]] += len(re.findall(mixing.WORD, r[1]))
        assert r[4] == len(r[1])
    assert words == taken
    texts = {r[0]: r[1] for r in rows(single)}
    assert all(texts[r[0]].startswith(r[1]) for r in rows(mix))

    packed = run("packing", mix)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows(mix))
    assert packed.agg({"length": "sum"}).first()[0] == tokens


def test_run_over_a_folder(spark, tmp_path):
    made = [(*r, len(r[1] or "")) for r in cases.rows(20)]
    spark.createDataFrame(made, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_planted_copies_are_caught_by_the_whole_pipeline(spark, tmp_path):
    """Near copies on one line pass line dedup whole; one of each group is left, and exact copies keep one text."""
    import random

    rng = random.Random(3)
    made, groups = [], {}
    for g in range(12):
        base = [rng.choice(cases.WORDS) + rng.choice(cases.WORDS) for _ in range(90)]
        groups[g] = [100 * g + i for i in range(6)]
        for i, doc_id in enumerate(groups[g]):
            words = list(base)
            if i:
                words[rng.randrange(90)] = f"changed{i}"
            text = " ".join(base if i == 5 else words)
            made.append((doc_id, text, "en", "ab"[g % 2], len(text), "clash", "clash"))
    spark.createDataFrame(made, SCHEMA + ", kept string, row string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*COLUMNS, "kept", "row"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for ids in groups.values():
        assert [i for i in ids if texts.get(i)] == [ids[0]]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= {ids[0] for ids in groups.values()}


def test_columns_that_clash_stay_the_input_s_own(spark, tmp_path):
    clash = ["kept_text", "n_lines", "n_dropped", "kept_id", "__row", "__own_row", "__rows", "__copies", "__copy", "__id", "__words", "__masks", "__rest", "taken", "Size"]
    made = [(*r, len(r[1] or ""), *[f"{c} {r[0]}" for c in clash]) for r in cases.rows(20)]
    docs = spark.createDataFrame(made, SCHEMA + "".join(f", {c} string" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [*COLUMNS, *clash]
        got = docs.collect()
        assert got and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in clash)
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).count() > 0
