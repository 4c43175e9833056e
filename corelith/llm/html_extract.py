"""Main-text extraction with wrappers inferred from pages of the same host.

Pages are grouped by host, large hosts in bands of bounded size. In a group, up to ``SAMPLE`` pages that are no near copies of
each other are aligned one after another into a wrapper, a union-free regular expression over their token streams: equal
neighbours fold into a repeated group, elements that only some pages have become optional, texts that differ become slots and
texts that do not are constants. The wrapper tells where the article is: in article or main elements, or else in the
whole page. Every page is then matched against the wrapper, and its text is what the match puts into slots: constants,
those of optional and repeated groups too, are the template's and go. What the wrapper does not foresee is the page's own and stays.
Inside an article, whose plain paragraphs are its own words even where pages share them, only constants in an element with a class go.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and code go by their element or role, or by a class or
id that names them: any word of it outside of articles and main elements, and inside a name all of whose words say so
(``ad-slot``, but not ``ad-hoc-networks``). Ids of paragraphs and headings inside an article are anchors and say nothing. An article's
header gives its headings. A part of an article named related goes if half of its text or more is in links.

Defined cases: a null, empty or text-less page gives an empty text; unclosed elements end where their parent
ends; a page that lacks the group's region is read by a wrapper of its own; several articles are
joined in page order; character references are decoded once; any Unicode white space counts as white space; a null or odd url is
a host of its own; repeated pages each give a row, and near copies of one page do not make its text a template; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import math
import re
import sys
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelith.operators.spread import share, spread_join
from corelith.plans.session import cut

SAMPLE = 8
#: Distinct pages from which on a text that never differs is taken for template text.
COMPARED = 3
#: Share of the pages that have a part of the wrapper, from which on a text they share there is a constant.
NEARLY_ALL = 0.9
#: Share of their texts from which on two articles are near copies, which say nothing about a template.
NEAR_COPY = 0.5
#: Pages of a host that are read together, and their characters.
BAND, BAND_CHARS = 200, 8_000_000
#: Hosts of several bands up to this number are broadcast; above it they are joined.
BROADCAST_HOSTS = 100_000

# Names of HTML elements and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("head nav header footer aside form dialog menu search button select option label input canvas audio video".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar comment comments disqus"
    " replies nav navbar navigation menu breadcrumb breadcrumbs header masthead footer related recommended share sharing social widget"
    " pagination pager copyright disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies disqus ad ads advert sponsored related teaser promo".split())
BOX_WORDS = frozenset("area bar block bottom box container inner left links list panel reader readers right section site slot thread top unit user users wrapper".split())
LINKED_WORDS = frozenset("related recommended".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORED = HEADINGS | frozenset("p li dt dd td th span a b i em strong sup sub pre blockquote figcaption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</(?P<end>[A-Za-z][^\s>/]*+)[^>]*+>?"
    r"|<(?P<start>[A-Za-z][^\s>/]*+)(?P<given>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>?",
    re.S,
)
GIVEN = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
TEXT = "#text"


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    left_out: bool = False
    linked: bool = False
    text: str = ""
    kids: list[Node] = field(default_factory=list)


def _element(tag: str, given: str, inside: bool = False, article: bool = False) -> Node:
    """The element, left out or not; ``inside`` an article or main element only whole names count."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in GIVEN.finditer(given)} if given.strip(" /") else {}
    names = found.get("class", "") if inside and tag in ANCHORED else f"{found.get('class', '')} {found.get('id', '')}"
    if inside:
        told = [{w.lower() for w in WORDS.findall(name)} for name in names.split()]
        said = {w for words in told if words <= LEFT_OUT_WORDS | BOX_WORDS for w in words & LEFT_OUT_WORDS}
    else:
        said = {w.lower() for w in WORDS.findall(names)}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
    linked = False
    if tag in ("html", "body", "main") or role == "main":
        out = False
    elif tag == "article":
        out = bool(said & COMMENT_WORDS)
    else:
        linked = article and bool(said) and said <= LINKED_WORDS
        named = bool(said & LEFT_OUT_WORDS) and not linked
        out = tag in LEFT_OUT and not (article and tag == "header") or role in LEFT_OUT_ROLES or named or bool(hidden)
    mark = "main" if role == "main" else " ".join(sorted(set(found.get("class", "").split())))
    return Node(tag, f"{tag}.{mark}" if mark else tag, out, linked)


def _characters(node: Node, links_only: bool) -> int:
    """How many characters of text the element holds, or its links do."""
    if node.tag == TEXT:
        return 0 if links_only else len("".join(node.text.split()))
    return sum(_characters(kid, links_only and node.tag != "a") for kid in node.kids)


class _Open:
    """The stack of open elements, with a count of each tag on it, so that no end tag searches it in vain."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.count: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] += 1

    def cut(self, place: int) -> None:
        self.count.subtract(n.tag for n in self.stack[place:])
        del self.stack[place:]

    def close(self, tags: set[str], barriers: frozenset[str] | set[str] = frozenset()) -> None:
        """Closes the innermost element of ``tags`` and all in it, unless an element of ``barriers`` is nearer."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return self.cut(i)
            if self.stack[i].tag in barriers:
                return None


def parse(page: str) -> Node:
    """The element tree; text nodes hold decoded text, raw elements such as scripts are gone."""
    root = Node("#root", "#root")
    doubtful: list[Node] = []
    opened, at = _Open(root), 0
    while at < len(page):
        m = TOKEN.search(page, at)
        gap = page[at : m.start() if m else len(page)]
        if gap:
            _add_text(opened.stack[-1], gap)
        if not m:
            break
        at = m.end()
        if m["end"]:
            opened.close({m["end"].lower()})
        elif m["start"]:
            tag = m["start"].lower()
            if tag in RAW:
                ends = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = len(page) if ends is None and tag in ("script", "style") else ends.end() if ends else at
                continue
            if tag in BLOCK:
                opened.close({"p"}, BLOCK)
            if tag in CLOSED_BY:
                opened.close(CLOSED_BY[tag], HOLDERS.get(tag, {"select"}))
            node = _element(tag, m["given"], bool(opened.count["article"] or opened.count["main"]), bool(opened.count["article"]))
            opened.stack[-1].kids.append(node)
            if node.linked:
                doubtful.append(node)
            if tag not in VOID and not m["given"].endswith("/"):
                opened.push(node)
    for node in reversed(doubtful):  # inner ones first
        node.left_out |= 2 * _characters(node, True) >= _characters(node, False)
    return root


def _add_text(parent: Node, raw: str) -> None:
    if parent.kids and parent.kids[-1].tag == TEXT:
        parent.kids[-1].text += html.unescape(raw)
    else:
        parent.kids.append(Node(TEXT, TEXT, text=html.unescape(raw)))


@dataclass(slots=True)
class Part:
    """A piece of a wrapper: an element or text, perhaps optional, repeated, or repeated together with its neighbours (``looped``).

    ``pages`` has a bit for each page that has the part, ``texts`` those for each text found there; ``constant`` is
    the text that all of them share.
    """

    label: str
    optional: bool = False
    repeated: bool = False
    constant: str | None = None
    slot_chars: int = 0
    parts: list[Part] = field(default_factory=list)
    looped: bool = False
    pages: int = 0
    texts: dict[str, int] = field(default_factory=dict)

    def holds(self, text: str) -> bool:
        """Whether ``text`` is a constant here: nearly all pages that have the part, and enough of them, have that text there."""
        return self.texts.get(text, 0).bit_count() >= max(COMPARED, math.ceil(NEARLY_ALL * self.pages.bit_count()))


def as_wrapper(node: Node, page: int = 0) -> Part:
    if node.tag == TEXT:
        text = " ".join(node.text.split())
        return Part(TEXT, constant=text, pages=1 << page, texts={text: 1 << page})
    parts = [as_wrapper(k, page) for k in node.kids if k.tag != TEXT or not k.text.isspace()]
    return Part(node.label, parts=_fold(parts), pages=1 << page)


def _runs(labels: list[str]) -> list[tuple[str, list[int], bool]]:
    """Places of equal neighbours together, and of equal pairs of neighbours; the last value tells the latter."""
    out: list[tuple[str, list[int], bool]] = []
    for i, label in enumerate(labels):
        if out and out[-1][0] == label:
            out[-1][1].append(i)
        elif len(out) > 2 and out[-2][0] == label and out[-3][0] == out[-1][0]:
            other = out.pop()
            out[-2:] = [(other[0], out[-2][1] + other[1], True), (label, [*out[-1][1], i], True)]
        else:
            out.append((label, [i], False))
    return out


def _fold(parts: list[Part]) -> list[Part]:
    """Runs of equal neighbours, and of equal pairs of neighbours, become repeated groups."""
    out: list[Part] = []
    for _, places, looped in _runs([p.label for p in parts]):
        part = parts[places[0]]
        for i in places[1:]:
            part = align(part, parts[i])
        part.repeated |= len(places) > 1
        part.looped |= looped
        out.append(part)
    return out


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of ``a`` and each prefix of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.maximum.accumulate(step)
    return row


def _common(a: list[Part], b: list[Part]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of labels, by halving the first list; memory grows with the second alone."""
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(p.label, len(numbers)) for p in parts], dtype=np.int64) for parts in (a, b))
    out: list[tuple[int, int]] = []
    waiting = [(0, len(x), 0, len(y))]
    while waiting:
        i, j, k, m = waiting.pop()
        while i < j and k < m and x[i] == y[k]:  # the same at the start
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if j - i == 1:
            if len(same := np.flatnonzero(y[k:m] == x[i])):
                out.append((i, k + int(same[0])))
            continue
        half = (i + j) // 2
        before, after = _lengths(x[i:half], y[k:m]), _lengths(x[half:j][::-1], y[k:m][::-1])[::-1]
        split = k + int(np.argmax(before + after))
        waiting += [(i, half, k, split), (half, j, split, m)]
    return sorted(out)


def align(x: Part, y: Part) -> Part:
    """The wrapper of both; they have the same label. Their texts go over into it."""
    flags = {"optional": x.optional or y.optional, "repeated": x.repeated or y.repeated, "looped": x.looped or y.looped, "pages": x.pages | y.pages}
    if x.label == TEXT:
        same = x.constant is not None and x.constant == y.constant
        chars = x.slot_chars + y.slot_chars + (0 if same else len(x.constant or "") + len(y.constant or ""))
        few, many = sorted((x.texts, y.texts), key=len)
        for text, pages in few.items():
            many[text] = many.get(text, 0) | pages
        return Part(TEXT, constant=x.constant if same else None, slot_chars=chars, texts=many, **flags)
    a, b = x.parts, y.parts
    parts, i, j = [], 0, 0
    at_a, at_b = [], []
    for p, q in [*_common(a, b), (len(a), len(b))]:
        for part in (*a[i:p], *b[j:q]):
            part.optional = True
        at_a += range(len(parts), len(parts) + p - i)
        at_b += range(len(parts) + p - i, len(parts) + p - i + q - j)
        parts += [*a[i:p], *b[j:q]]
        if p < len(a):
            at_a.append(len(parts))
            at_b.append(len(parts))
            parts.append(align(a[p], b[q]))
        i, j = p + 1, q + 1
    # What has come between two parts of a loop is in the loop.
    loops = [(at[n], at[n + 1]) for own, at in ((a, at_a), (b, at_b)) for n in range(len(own) - 1) if own[n].looped and own[n + 1].looped]
    for start, end in loops:
        for part in parts[start + 1 : end]:
            part.looped = True
    return Part(x.label, parts=_fold(parts), **flags)


def infer(trees: list[Node]) -> Part:
    wrapper = as_wrapper(trees[0])
    for page, tree in enumerate(trees[1:], 1):
        wrapper = align(wrapper, as_wrapper(tree, page))
    return wrapper


def expression(part: Part) -> str:
    """The wrapper written as a regular expression over tokens, for people; of a loop's parts any may be missing."""
    if part.label == TEXT:
        inner = "#slot" if part.constant is None else part.constant
    else:
        inner = f"<{part.label}>"
        for looped, parts in itertools.groupby(part.parts, lambda p: p.looped):
            each = "".join(f"({expression(p)})?" if looped else expression(p) for p in parts)
            inner += f"({each})+" if looped else each
        inner += f"</{part.label.split('.')[0]}>"
    often = f"({inner})+" if part.repeated else inner
    return f"({often})?" if part.optional else often


def region(wrapper: Part, compared: bool) -> str:
    """The label of the element that holds the article: article, main, or the smallest that holds all other content.

    ``compared``: whether enough pages were aligned for slots to be told from template texts.
    """
    for wanted in ("article", "main"):
        found: list[str] = []

        def look(part: Part, wanted: str = wanted, found: list[str] = found) -> None:
            tag, _, mark = part.label.partition(".")
            left_out = tag in LEFT_OUT or {w.lower() for w in WORDS.findall(mark)} & (COMMENT_WORDS if tag == "article" else LEFT_OUT_WORDS)
            if tag == wanted and not left_out or wanted == "main" and mark == "main":
                found.append(part.label)
            elif not left_out:
                for kid in part.parts:
                    look(kid)

        look(wrapper)
        if found:
            return found[0]
    mass: dict[int, int] = {}
    _weigh(wrapper, compared, mass)
    part = wrapper
    while True:
        rich = max((k for k in part.parts if k.label != TEXT), key=lambda k: mass[id(k)], default=None)
        if rich is None or not mass[id(part)] or mass[id(rich)] < mass[id(part)] or rich.repeated:
            return part.label
        part = rich


def _weigh(part: Part, slots_only: bool, mass: dict[int, int], left_out: bool = False) -> int:
    """Notes the characters of content in each part."""
    tag, _, mark = part.label.partition(".")
    left_out = left_out or tag in LEFT_OUT or bool({w.lower() for w in WORDS.findall(mark)} & LEFT_OUT_WORDS)
    own = 0 if left_out else part.slot_chars + (0 if slots_only else len(part.constant or ""))
    for each in part.parts:
        own += _weigh(each, slots_only, mass, left_out)
    mass[id(part)] = own
    return own


def _matched(node: Node, part: Part) -> list[Part | None]:
    """The part of the wrapper that each of the element's children is matched with, None where there is none."""
    out: list[Part | None] = [None] * len(node.kids)
    places = [i for i, k in enumerate(node.kids) if k.tag != TEXT or not k.text.isspace()]
    runs = _runs([node.kids[i].label for i in places])
    for r, p in _common([Part(label) for label, _, _ in runs], part.parts):
        for i in runs[r][1]:
            out[places[i]] = part.parts[p]
    return out


def _headings(node: Node) -> list[Node]:
    return [node] if node.tag in HEADINGS else [h for kid in node.kids if not kid.left_out for h in _headings(kid)]


def _blocks(node: Node, part: Part | None, constants: bool, out: list[list[str]]) -> None:
    """Appends the node's texts to ``out``, a list of blocks, as far as the match with ``part`` puts them into slots.

    ``constants``: whether constants go here already, and not just inside an element with a class.
    """
    if node.left_out:
        out.append([])
        return
    if node.tag in BLOCK:
        out.append([])
    elif node.tag == "br":
        out[-1].append(" ")
    if node.tag == "header":  # an article's, as others are left out
        for kid in _headings(node):
            _blocks(kid, None, constants, out)
    else:
        matched = _matched(node, part) if part else [None] * len(node.kids)
        for kid, own in zip(node.kids, matched, strict=True):
            if kid.tag != TEXT:
                _blocks(kid, own, constants or "." in kid.label, out)
            elif not (own and constants and own.holds(" ".join(kid.text.split()))):
                out[-1].append(kid.text)
    if node.tag in BLOCK:
        out.append([])


def _kind(label: str) -> str | None:
    """Whether a region is an article or main element; None for others."""
    tag, _, mark = label.partition(".")
    return "article" if tag == "article" else "main" if tag == "main" or mark == "main" else None


def _reached(node: Node, kind: str, out: list[Node]) -> None:
    """The outermost article or main elements, in page order."""
    if node.left_out:
        return
    if kind == _kind(node.label):
        out.append(node)
        return
    for kid in node.kids:
        _reached(kid, kind, out)


def _texts(node: Node, part: Part | None, constants: bool) -> list[str]:
    """The texts of the content's blocks. Inside of articles, constants of plain elements are the article's own."""
    out: list[list[str]] = [[]]
    if constants or part is None:
        _blocks(node, part, constants, out)
    else:
        for kid, own in zip(node.kids, _matched(node, part), strict=True):
            _blocks(kid, own, False, out)
    return list(filter(None, (" ".join("".join(block).split()) for block in out)))


def _unlike(contents: list[tuple[Node, list[str]]], sample: int, copies: float) -> list[Node]:
    """Up to ``sample`` contents, in order, each sharing at most ``copies`` of its texts with every other one."""
    out: list[Node] = []
    seen: list[Counter[str]] = []
    for node, texts in contents:
        own = Counter(texts)
        if own and all((own & other).total() <= copies * (own | other).total() for other in seen):
            seen.append(own)
            out.append(node)
        if len(out) == sample:
            break
    return out


def _content(tree: Node, kind: str | None) -> Node | None:
    """A node over the page's article or main elements, or the whole page where no kind is given; None if it lacks them."""
    if kind is None:
        return tree
    found: list[Node] = []
    _reached(tree, kind, found)
    return Node("#root", "#root", kids=found) if found else None


def extract_group(pages: list[str], sample: int = SAMPLE) -> list[str]:
    """The main texts of pages of one host; the first ``sample`` distinct ones make the wrapper."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # elements may be nested very deep
    trees = [parse(p) for p in pages]
    distinct = list({p: t for p, t in zip(reversed(pages), reversed(trees), strict=True)}.values())[::-1]
    kind = _kind(region(infer(distinct[:sample]), min(len(distinct), sample) >= COMPARED))
    contents = [_content(tree, kind) for tree in trees]
    whole = [_texts(node, None, True) if node else [] for node in contents]
    # Equal and nearly equal articles say nothing about the template. Whole pages may share most texts, so there only equal ones count once.
    told = {tuple(texts): node for node, texts in zip(contents, whole, strict=True) if node}
    learned = _unlike([(node, list(texts)) for texts, node in told.items()], sample, 1 - 1e-9 if kind is None else NEAR_COPY)
    wrapper = infer(learned) if len(learned) >= COMPARED else None
    out = []
    for tree, node, texts in zip(trees, contents, whole, strict=True):
        if node is None:
            alone = _kind(region(as_wrapper(tree), False))
            out.append(" ".join(_texts(_content(tree, alone) or tree, None, True)))
        else:
            out.append(" ".join(_texts(node, wrapper, kind is None) if wrapper else texts))
    return out


def extract_pages(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    need = F.greatest(F.count(F.lit(1)) / BAND, F.sum(F.coalesce(F.char_length("html"), F.lit(0))) / BAND_CHARS)
    counted = rows.groupBy("host").agg(F.ceil(need).alias("bands"), F.count(F.lit(1)).alias("members"))
    large = cut(counted.filter("bands > 1"))
    if (hosts := large.count()) <= BROADCAST_HOSTS:
        dealt = rows.join(F.broadcast(large), "host", "left")
    else:
        dealt = spread_join(rows, large, "host", "page_id", share(hosts * BAND, pages.sparkSession), how="left")
    banded = dealt.withColumn("band", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("bands", F.lit(1))))

    def extract(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order", kind="stable")
        text = extract_group([p or "" for p in group["html"]], sample)
        return pd.DataFrame(
            {"page_id": group["page_id"].astype("Int64"), "url": group["url"], "text": text, "n_chars": [len(t) for t in text]}
        )

    return (
        banded.withColumn("order", F.xxhash64("html", "page_id"))
        .select(F.col("page_id").cast("bigint"), "url", "html", "host", "band", "order")
        .groupBy("host", "band")
        .applyInPandas(extract, "page_id bigint, url string, text string, n_chars bigint")
    )
