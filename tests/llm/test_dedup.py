from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from corelith.llm import exact_dedup, line_dedup, near_dedup
from tests.llm import cases

BLANK = re.compile(r"[\x20\x09-\x0D]")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def expected_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), order(doc_id), doc_id))
    out = []
    for doc_id, text, *_ in rows:
        norm = BLANK.sub("", text or "")
        keep = min(groups[norm])[2]
        out.append((doc_id, keep, len(groups[norm]), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [0, 700])
def test_exact_groups(spark, copies):
    rows = cases.rows() + [(1000 + i, "one  hot" + " " * (i % 7), "en", "hot") for i in range(copies)]
    got = exact_dedup.exact_groups(cases.frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == expected_groups(rows)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(cases.frame(spark, [])).count() == 0


def expected_lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(LOW)
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == order(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [0, 1500])
def test_line_dedup(spark, copies):
    rows = cases.rows() + [(1000 + i, f"A common line here\n own line number {i} \n a common LINE here ", "en", "hot") for i in range(copies)]
    got = line_dedup.apply_bitmaps(cases.frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert sorted(map(tuple, got.collect()), key=str) == expected_lines(rows)


def test_line_bitmaps_hold_no_text(spark):
    assert line_dedup.line_bitmaps(cases.frame(spark)).columns == ["doc_id", "row", "words"]


def test_line_dedup_of_one_document_stored_twice_with_other_text(spark):
    rows = [(1, "the same long line\nfirst version", "en", "a"), (1, "the same long line\nsecond version", "en", "a")]
    got = line_dedup.apply_bitmaps(cases.frame(spark, rows))
    assert [r["n_dropped"] for r in got.collect()] == [0, 0]
    assert line_dedup.apply_bitmaps(cases.frame(spark, [])).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_components(rows):
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(r[0], shingles(r[1])) for r in rows]
    at = defaultdict(list)
    for i, (doc_id, s) in enumerate(sets):
        if doc_id is not None:
            for g in s:
                at[g].append(i)
    for i, (doc_id, s) in enumerate(sets):
        if doc_id is None:
            continue
        for j, shared in Counter(j for g in s for j in at[g] if j < i).items():
            other, t = sets[j]
            if 100 * shared >= 75 * (len(s) + len(t) - shared):
                a, b = find(doc_id), find(other)
                parent[max(a, b)] = min(a, b)
    out = []
    for doc_id, s in sets:
        low = None if doc_id is None else find(doc_id)
        out.append((doc_id, len(s), low, doc_id == low))
    return sorted(out, key=str)


def near_rows():
    import random

    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    rows = list(cases.rows())
    for i in range(150):  # a chain-like group around the threshold
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        rows.append((2000 + i, " ".join(words), "en", "hot"))
    passage = " ".join(base[:60])
    rows += [(3000 + i, f"{passage} {' '.join(f'y{rng.randint(0, 10**6)}' for _ in range(rng.randint(5, 30)))}", "en", "hot") for i in range(80)]
    return rows


def test_near_components_against_all_pairs(spark):
    rows = near_rows()
    got = near_dedup.near_components(cases.frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == expected_components(rows)


def test_near_components_of_nothing(spark):
    assert near_dedup.near_components(cases.frame(spark, [])).count() == 0


def test_pruning_table_keeps_pairs_at_the_threshold():
    steps = near_dedup.least_matches(0.75, 1e-6)
    assert [n for n, _ in steps] == list(range(16, 129, 16))
    assert all(m / n < 0.75 for n, m in steps)
    assert steps[-1][1] > 60


def copies_of_one_text(n, with_base=True, seed=9):
    """A text of 40 words and copies of it with one word changed: they link to the text, not to each other."""
    import random

    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(base), "en", "hot")] if with_base else []
    for i in range(1, n):
        changed = list(base)
        changed[rng.randrange(40)] = f"x{i}"
        rows.append((i, " ".join(changed), "en", "hot"))
    return rows


def test_pairs_grow_in_proportion(spark, monkeypatch):
    compared = []
    verify = near_dedup._verify
    monkeypatch.setattr(near_dedup, "_verify", lambda docs, classes, pairs, *more: (compared.append(pairs.count()), verify(docs, classes, pairs, *more))[1])
    for n in (400, 800, 1600):
        rows = copies_of_one_text(n)
        compared.append(0)
        got = near_dedup.near_components(cases.frame(spark, rows))
        assert {r["component_id"] for r in got.select("component_id").collect()} == {0}
        compared[:] = [*compared[: compared.index(0)], sum(compared[compared.index(0) :])] if 0 in compared else compared
    few, more, most = compared
    assert more < 2.6 * few and most < 2.6 * more


def test_copies_whose_text_is_missing(spark):
    rows = copies_of_one_text(300, with_base=False)
    got = near_dedup.near_components(cases.frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == expected_components(rows)


def test_line_dedup_of_a_text_of_very_many_lines(spark):
    import time

    text = "\n".join(f"line number {i}" for i in range(200_000))
    began = time.time()
    got = line_dedup.apply_bitmaps(cases.frame(spark, [(1, text, "en", "a"), (2, text + "\nmore of it here", "en", "a")]))
    rows = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()}
    assert rows == {1: (200_000, 0, text), 2: (200_001, 200_000, "more of it here")}
    assert time.time() - began < 60
