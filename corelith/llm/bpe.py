"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's symbols start as its bytes, the last one marked as a word's end. The leaves of the tree are the ranks of adjacent
pairs, each with its place, and every inner node is the smaller of its two: so the root is the leftmost pair of the lowest
rank. Merging it changes three leaves, each put right in a logarithm of the word's length, until the root says that no pair
can be merged. A word of any length therefore takes n log n steps.

The vocabulary file (its path is a parameter) gives merges, tokens and special tokens. Texts are normalised and split into words as the file says: NFC,
lower case, then contractions, runs of letters, single digits, and runs of what is neither; white space goes. Python's Unicode tables
and the tokenizers library's agree on everything below U+0530; a text with other characters is normalised and split by the library's
parts, as its tables are of another Unicode version. Merging is always done here.

A text stays in one task, which holds a few texts at a time and a bounded table of words met before.

Defined cases: a null or empty text has no tokens and decodes to the empty string; special tokens in a text are one token each; repeated rows
and rows that share a doc_id are encoded each by itself; a null doc_id stays null; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.llm.common import chunks

ENCODED = "doc_id bigint, ids binary"
DECODED = "doc_id bigint, ids binary, decoded string"
#: Fixed value: how the vocabulary's tokenizer splits normalised text.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters on which tables of different Unicode versions may disagree.
LATER = regex.compile("[^\x00-ԯ]")
#: How many words, and parts between white space, a worker keeps with their ids, and the longest that is kept.
KEPT_WORDS, KEPT_LETTERS = 400_000, 32
NEVER = 1 << 62
PART, SEPARATORS = regex.compile(r"\S+"), regex.compile("[\x1c-\x1f]")


def byte_letters() -> str:
    """For each byte the printable character that stands for it in the vocabulary: itself, or the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


def merge_all(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The symbols after all merges, always of the leftmost pair of the lowest rank; ``made``: the symbol of each rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, rank_of = list(symbols), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << (n - 2).bit_length()
    # A leaf is rank * n + place, so the smaller of two is that of lower rank, or the one further left.
    leaves = [NEVER if r is None else r * n + at for at, r in enumerate(map(rank_of, zip(symbols, symbols[1:], strict=False)))]
    tree = [NEVER] * width + leaves + [NEVER] * (width - n + 1)
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(at: int, value: int) -> None:
        node = width + at
        if tree[node] == value:
            return
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            if other < value:
                value = other
            node >>= 1
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] != NEVER:
        rank, at = divmod(tree[1], n)
        right = after[at]
        symbols[at], symbols[right] = made[rank], -1
        after[at] = following = after[right]
        r = None
        if following < n:
            before[following] = at
            r = rank_of((symbols[at], symbols[following]))
            put(right, NEVER)
        put(at, NEVER if r is None else r * n + at)
        if (left := before[at]) >= 0:
            r = rank_of((symbols[left], symbols[at]))
            put(left, NEVER if r is None else r * n + left)
    return [s for s in symbols if s >= 0]


def keep(met: dict[str, bytes], text: str, ids: bytes) -> bytes:
    """Remembers the ids of a short text, of a bounded number of them."""
    if len(text) <= KEPT_LETTERS:
        if len(met) >= KEPT_WORDS:
            met.clear()
        met[text] = ids
    return ids


class Vocabulary:
    """Tokens, merges and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            made = json.load(lines)
        ids, end = made["model"]["vocab"], made["model"]["end_of_word_suffix"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in made["model"]["merges"]]
        self.path, self.letters = path, byte_letters()
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        self.inner, self.last = [ids[c] for c in self.letters], [ids[c + end] for c in self.letters]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.any_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.met: dict[str, bytes] = {}
        self.met_parts: dict[str, bytes] = {}

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """The words of a text or a part of it."""
        if LATER.search(text) is None:
            # A capital sigma is lower-cased by itself, whether or not it ends a word.
            return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        place = {letter: byte for byte, letter in enumerate(self.letters)}
        return [bytes(place[c] for c in word).decode() for word, _ in split]

    def word_ids(self, word: str) -> bytes:
        """The word's ids as little-endian unsigned 32-bit integers."""
        *inner, last = word.encode()
        found = merge_all([*[self.inner[b] for b in inner], self.last[last]], self.ranks, self.made)
        return struct.pack(f"<{len(found)}I", *found)

    def part_ids(self, part: str) -> bytes:
        """The ids of what stands between white space, from its words; both are kept."""
        out = [self.met.get(word) or keep(self.met, word, self.word_ids(word)) for word in self.words(part)]
        return keep(self.met_parts, part, b"".join(out))

    def encode(self, text: str) -> bytes:
        out, met = [], self.met_parts
        for piece in [text] if self.any_special is None else self.any_special.split(text):
            if piece in self.special:
                out.append(struct.pack("<I", self.special[piece]))
            else:
                # Python takes four separators for white space, which the vocabulary's tokenizer does not.
                parts = PART.findall(piece) if SEPARATORS.search(piece) else piece.split()
                out += [met.get(part) or self.part_ids(part) for part in parts]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens with a blank between each two, as a vocabulary without a decoder is decoded."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): each text's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = vocabulary(path).encode
        for ids, texts in chunks(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([make(t or "") for t in texts], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) from (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = vocabulary(path).decode
        for doc_ids, ids in chunks(batches, "doc_id", "ids"):
            made = pa.array([None if i is None else make(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), made], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)
