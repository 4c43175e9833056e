"""Documents that every operator has to take: nulls, empty, short and very long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " keep_id string, kept string, row string, size string, n_lines string, sequence_id string"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        out.append((i, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["a", "b", "hot", "hot", "hot", None])))
    base = " ".join(rng.choices(WORDS, k=80))
    near = base.split()
    near[40] = "changed"
    out += [
        (100, None, None, None),
        (101, "", "en", ""),
        (102, " \t\n\x0b\x0c\r ", "en", "a"),
        (103, "\n\n", "en", "a"),
        (104, base, "en", "hot"),
        (105, base, "en", "hot"),
        (106, base.upper().replace(" ", "\n"), "en", "hot"),
        (107, " ".join(near), "en", "hot"),
        (107, " ".join(near), "en", "hot"),
        (None, base, "en", "hot"),
        (108, "one two three", "en", "b"),
        (109, "ONE two  three", "en", "b"),
        (110, "Ünïcödé ÄÖÜ Straße " * 3, "de", "b"),
        (111, " ".join(rng.choices(WORDS, k=30_000)), "en", "b"),
        (112, "12345 !!! ???", "en", "b"),
        (113, "  x\u0085", None, "b"),
        (114, "x" * 50_000, "en", "b"),
    ]
    return out


def frame(spark, made=None):
    made = rows() if made is None else made
    return spark.createDataFrame([(*r, len(r[1] or ""), *["clash"] * 6) for r in made], SCHEMA)
