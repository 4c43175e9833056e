"""Secret scanning: fixed patterns, and the guess cost of values in credential contexts.

Three fixed patterns give the base spans. In a wider set of credential contexts (a keyword, a
separator, a value) the value is taken apart by dynamic programming into the cheapest sequence of dictionary words,
dates, repeats, keyboard or alphabet walks, blanks, joints and brute-force characters; its cost is the sum of the parts' bits. A value
that costs at least ``BITS`` to guess is a secret and adds a span of kind ``guess``. A word costs the logarithm of its
rank: first the words that passwords and code are full of, then those of a public tokenizer's vocabulary, whose order
follows how frequent they are.

Defined cases: a null or empty text has no spans; offsets count code points and ends are exclusive; letters in
keywords match in either case, ASCII only; a value of any length is costed in time linear in its length; repeated
rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.llm.common import chunks

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|secret|auth|encryption|signing)[_\x20-]?key|credentials?|login"""
    r"""|authorization|(?<![A-Za-z])(?:pass|auth|pin))"""
    r"""["']?\x20*(?::=|=>|[:=])\x20*(?:(?:bearer|basic)\x20+)?(?:"([^"\n]{6,}+)"|'([^'\n]{6,}+)'|([^\s"'<>|,;]{6,}))""",
    re.I | re.A,
)
#: Every context holds one of these, lower-cased.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "login", "auth", "pin")
BITS = 40.0

# Frequent parts of passwords, keyboard rows, and look-alike characters.
COMMON = (
    "password pass word admin root user guest test demo welcome login secret letmein master access hello dragon monkey shadow sunshine"
    " princess football baseball soccer hockey summer winter spring autumn monday friday sunday january february march april june july"
    " august september october november december love money magic freedom whatever computer internet server database system default"
    " change changeme example sample please trust hunter flower cookie pepper ginger tiger eagle angel michael jordan thomas daniel robert"
    " ashley jessica charlie andrew london paris berlin super batman starwars pokemon mustang corvette yankees and for you that with this"
    " from have your token key value string null none true false your here insert replace placeholder process env environ getenv getpass get"
    " set input config settings self args os vault the"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "qwertzuiop", "azertyuiop")
LOOKALIKE = str.maketrans("@4301!$5+7", "aaeoiisstt")

DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
PART_BITS = 1.0
#: Characters between words, as in paths, calls and joined words.
JOINTS = frozenset("-_./()")
JOINT_BITS = 1.0


def vocabulary_words(path: str) -> list[str]:
    """The words of 3 to 24 letters in a file of tokens and ranks (one base64 token and its rank a line), by rank."""
    with open(path, "rb") as lines:
        tokens = (base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in lines if line.strip())
        return list(dict.fromkeys(t.strip().lower() for t in tokens if 2 < len(t.strip()) < 25 and t.strip().isalpha()))


class Dictionary:
    """Words with the bits of their ranks, and the pairs of keys that lie beside each other."""

    def __init__(self, words: Iterable[str] = ()):
        self.words = {w: math.log2(rank + 1) for rank, w in enumerate(dict.fromkeys((*COMMON, *words)), 1) if len(w) > 2}
        self.longest = max(map(len, self.words))
        beside = {pair for row in ROWS for pair in zip(row, row[1:], strict=False)}
        self.near = beside | {(b, a) for a, b in beside}


PLAIN = Dictionary()


def _character_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isalpha():
        return math.log2(26 if c.isascii() else 1000)
    return math.log2(33)


def character_bits(value: str) -> list[float]:
    """The bits of each character as brute force; a letter costs one more where the case changes back and forth in the value."""
    cases = [c.isupper() for c in value if c.isalpha() and c.isascii()]
    mixed = sum(a != b for a, b in zip(cases, cases[1:], strict=False)) > 1
    return [_character_bits(c) + (mixed and c.isalpha() and c.isascii()) for c in value]


def _case_bits(part: str) -> float:
    upper = sum(c.isupper() for c in part)
    if not upper or upper == len(part) or part[0].isupper() and upper == 1:
        return float(bool(upper))
    return min(float(len(part)), math.log2(math.comb(len(part), upper)) + 1)


def guess_bits(value: str, known: Dictionary = PLAIN) -> tuple[float, list[tuple[str, int, int]]]:
    """The bits of the cheapest segmentation, and its parts as (kind, start, end).

    A chain of brute-force characters counts as one part. Runs (repeats of a period up to 8, and walks) are only
    taken from where they start or in whole periods, so each position has a bounded number of choices.
    """
    words, longest, near = known.words, known.longest, known.near
    low = value.lower()
    plain = low.translate(LOOKALIKE)
    each = character_bits(value)
    n = len(value)
    inf = float("inf")
    best = [0.0] + [inf] * n  # by end, over all last parts
    brute = [inf] * (n + 1)  # the last part is brute force
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute_from = [0] * (n + 1)
    dates: dict[int, list[int]] = {}
    for start in range(n):
        if value[start].isdigit() and (m := DATE.match(value, start)):
            dates.setdefault(m.end(), []).append(start)
            if m.end() - start > 4:
                if value[start : start + 2] in ("19", "20"):
                    dates.setdefault(start + 4, []).append(start)
    period_run = [0] * 9  # for each period, how many characters up to here equal those one period before
    walk = step_run = 1
    step = 0
    for end in range(1, n + 1):
        i = end - 1
        options = []
        bits = each[i]
        grown, fresh = brute[i] + bits, best[i] + PART_BITS + bits
        brute[end], brute_from[end] = (grown, brute_from[i]) if grown < fresh else (fresh, i)
        options.append((brute[end], "brute", brute_from[end]))
        if value[i].isspace():
            options.append((best[i] + PART_BITS, "blank", i))
        elif value[i] in JOINTS:
            options.append((best[i] + PART_BITS + JOINT_BITS, "joint", i))
        for start in range(max(0, end - longest), end - 2):
            found = words.get(low[start:end])
            swapped = 0.0
            if found is None and (found := words.get(plain[start:end])) is not None:
                swapped = 1.0 + sum(x != y for x, y in zip(low[start:end], plain[start:end], strict=True))
            if found is not None:
                options.append((best[start] + PART_BITS + found + swapped + _case_bits(value[start:end]), "word", start))
        for start in dates.get(end, ()):
            span = 150 if end - start == 4 else 150 * 365 * 8
            options.append((best[start] + PART_BITS + math.log2(span), "date", start))
        for period in range(1, 9):
            same = i >= period and value[i] == value[i - period]
            period_run[period] = period_run[period] + 1 if same else 0
            if (often := period_run[period] // period + 1) >= (3 if period == 1 else 2):
                start = end - often * period
                unit = sum(each[start : start + period])
                options.append((best[start] + PART_BITS + unit + math.log2(often), "repeat", start))
        if i:
            walk = walk + 1 if (low[i - 1], low[i]) in near else 1
            now = ord(low[i]) - ord(low[i - 1])
            step_run = step_run + 1 if now == step and abs(now) == 1 else 2 if abs(now) == 1 else 1
            step = now
            for run, kind in ((walk, "walk"), (step_run, "sequence")):
                if run >= 3:
                    options.append((best[end - run] + PART_BITS + math.log2(94) + 2 * math.log2(run) + _case_bits(value[end - run : end]), kind, end - run))
        best[end], kind, start = min(options)
        back[end] = (kind, start)
    parts, end = [], n
    while end:
        kind, start = back[end]
        parts.append((kind, start, end))
        end = start
    return best[n], parts[::-1]


def find_spans(text: str, bits: float = BITS, known: Dictionary = PLAIN) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of ``KINDS``."""
    spans = []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if hinted:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if hinted:
        for m in CONTEXT.finditer(text):
            value, (start, end) = m[m.lastindex], m.span(m.lastindex)
            if guess_bits(value, known)[0] >= bits:
                spans.append(("guess", start, end))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(docs: DataFrame, bits: float = BITS, words: Iterable[str] = ()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_spans, spans) for each row of ``docs``.

    ``words``, by rank, are broadcast: a vocabulary, whose size does not depend on ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(words))
    names = ("n_assign", "n_access", "n_hex", "n_guess")

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(shared.value)
        for doc_ids, texts in chunks(batches, "doc_id", "text"):
            found = [find_spans(text or "", bits, known) for text in texts]
            kinds = [[k for k, _, _ in spans] for spans in found]
            made = {name: pa.array([k.count(kind) for k in kinds], pa.int64()) for name, kind in zip(names, KINDS, strict=True)}
            base = [spans_text([s for s in spans if s[0] != "guess"]) for spans in found]
            yield pa.record_batch(
                {"doc_id": pa.array(doc_ids, pa.int64()), **made, "base_spans": pa.array(base, pa.string()), "spans": pa.array(map(spans_text, found), pa.string())}
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        scan_batches, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_spans string, spans string"
    )
