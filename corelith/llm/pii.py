"""Surrogates for personal data, with DataFrame functions only.

Mail addresses, IP addresses of both versions, phone, card, social-security and bank-account numbers, and names after a title are
found by one regular expression. A name that a document has after a title is replaced without one as well in that document: the full
name wherever it stands, its words alone unless they are common words, too (``Will``, ``Rose``). Every distinct value gets a surrogate
from a digest of a secret key and the value: of the same kind, script, letter case and punctuation, valid where the original is
(octets, check digits), of the same length but for names, with the same country code or range of addresses, and for names of the same gender.

Values are compared by what they say, not by how they are written (``canonical``): addresses and names without case, numbers by their
digits, phone numbers without a country code as those of the code 1. Every spelling gets the one surrogate in its own format, in all
documents. The labels of a domain have surrogates of their own, so subdomains and the same surname of several people
stay together. Surrogates, those of the parts of addresses each by themselves, are checked: one that another value has got, or that
occurs as an original itself, is drawn again until all are distinct, letters with a longer tail from the third draw on, addresses of a
private range outside of it from the twentieth on, as such a range can be full.

Only documents with entities are shuffled. Values that occur in a third of all documents are aggregated before the
shuffle and joined to a table with one row per value, which adaptive execution can split.

Defined cases: a null text stays null and has no entities; a text without entities stays as it is; equal rows get equal results; a null
doc_id is a document like any other; an empty table gives an empty result; other columns are ignored. Mentions of a name without its
title are not counted or listed as spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corelith.plans.session import cut, partitions

# Patterns of the kinds, titles and the syllables of invented names.
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,24}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?![\d]|\.\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,5}\)[\x20.-]?)?\d{2,5}(?:[\x20.-]?\d{2,5}){1,4}"
    r"|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}([-.\x20])\d{3}\1\d{4})(?!\d)",
    "card": r"(?<![\d.,-])\d{4}(?:([\x20-]?)\d{4}\2\d{4}\2\d{1,7}|[\x20-]?\d{6}[\x20-]?\d{3,5}|\d{9,15})(?![\d])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra)\b\.?(?:\x20\p{Lu}[\p{L}'-]+){1,3}",
}
MALE, FEMALE = r"^(?:Mr|Herr|Monsieur|Señor|Sr)\b", r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra)\b"
NAMES = r"^(?:given-.|family)$"
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
SECOND_LEVEL = r"(?i)((?:(?:ac|co|com|edu|gov|net|org)\.)?\p{L}{2}|\p{L}{3,24})$"
RANGES = {r"^10\.": "10.", r"^127\.": "127.", r"^169\.254\.": "169.254.", r"^192\.168\.": "192.168."}
SPECIAL_OCTETS = (10, 100, 127, 169, 172, 192, 198, 203)
COMMON_WORDS = (
    "amber april art august autumn baker banks bill black brown bush carter chase church cliff cook crystal daisy dale dawn day dean drew"
    " faith field fisher forest fox frank gene grace grant gray green guy hill hope hunter iris ivy jade joy june king lane lily long"
    " mark mason may miles miller norm page park pat pearl penny pierce price ray rich rob rose ruby rusty sandy short sky small smith"
    " stone sue summer violet wade ward white will wise wolf wood woods young"
).split()
SYLLABLES = ["ba", "del", "fi", "gor", "han", "ke", "lin", "mar", "no", "pel", "ri", "sal", "to", "ven", "wi", "zan"]
CYRILLIC = ["ба", "дел", "фи", "гор", "хан", "ке", "лин", "мар", "но", "пел", "ри", "сал", "то", "вен", "ви", "зан"]
LOWER, UPPER = "abcdefghijklmnop", "ABCDEFGHIJKLMNOP"
SCRIPTS = [(r"[а-яё]", "абвгдежзиклмнопр"), (r"[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПР"), (r"[α-ωά-ώ]", "αβγδεζηθικλμνξοπ"), (r"[Α-ΩΆ-Ώ]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠ")]
OTHER_LETTERS = [(r"\p{IsHan}", "安白成大方高海和金李林马明文新子"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそた"), (r"\p{Ll}", LOWER), (r"\p{Lu}", UPPER)]


ENTITY = "|".join(
    # The phone pattern holds group 1 and the card pattern group 2, as they stand in this order.
    PATTERNS.values()
)


def _kind(value: Column) -> Column:
    whole = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        alone = pattern.replace(r"\2", r"\1") if kind == "card" else pattern
        whole = F.when(value.rlike(f"^(?:{alone})$"), F.lit(kind)).otherwise(whole)
    return whole


def _units(entity: Column) -> Column:
    """The parts of an entity that get surrogates of their own, and text that stays, in order."""
    kind = _kind(entity)
    single = F.array(F.struct(kind.alias("kind"), entity.alias("value")))
    title = F.regexp_extract(entity, r"^(\p{L}+\.?\x20)", 1)
    names = F.split(F.substr(entity, F.char_length(title) + 1), " ")
    gender = F.when(entity.rlike(MALE), "m").when(entity.rlike(FEMALE), "f").when(names[0].rlike("[aàáа]$"), "f").otherwise("m")
    named = F.transform(
        names,
        lambda x, i: F.struct(F.when((i == 0) & (F.size(names) > 1), F.concat(F.lit("given-"), gender)).otherwise("family").alias("kind"), x.alias("value")),
    )
    joined = F.flatten(
        F.transform(
            named,
            lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(F.struct(F.lit("stays").alias("kind"), F.lit(" ").alias("value")), x)),
        )
    )
    whole = F.concat(F.array(F.struct(F.lit("stays").alias("kind"), title.alias("value"))), joined)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    last = F.substring_index(domain, ".", -1)
    wide = F.regexp_extract(domain, r"(?<=\.)" + SECOND_LEVEL, 1)
    # A domain such as co.uk itself keeps its last label alone.
    top = F.when(F.char_length(wide) < F.char_length(domain) - 1, wide).otherwise(last)
    top = F.when(F.char_length(top) > 0, top).otherwise(last)
    host = F.substr(domain, F.lit(1), F.char_length(domain) - F.char_length(top) - 1)

    def unit(kind: Column | str, value: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))

    labels = F.split(host, r"\.")
    dotted = F.flatten(
        F.transform(labels, lambda x, i: F.array(unit(F.when(i == F.size(labels) - 1, "domain").otherwise("label"), x), unit("stays", F.lit("."))))
    )
    mail = F.concat(F.array(unit("local", local), unit("stays", F.lit("@"))), dotted, F.array(unit("stays", top)))
    return F.when(kind == "name", whole).when(kind == "email", mail).otherwise(single)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _hex_at(stream: Column, i: Column) -> Column:
    """The digest's hexadecimal digit at position i, over again after 64, as a number."""
    return F.conv(F.substr(stream, (i % 64) + 1, F.lit(1)), 16, 10).cast("int")


def _reshaped(value: Column, stream: Column, letters: bool) -> Column:
    """``value`` with other digits, and other letters of the same script and case, in the same places."""

    def other(c: Column, i: Column) -> Column:
        at = _hex_at(stream, i)
        out = F.when(c.rlike("[0-9]"), ((at + F.floor(i / 64)) % 10).cast("string"))
        if letters:
            pick = lambda alphabet: F.substr(F.lit(alphabet), at + 1, F.lit(1))
            out = out.when(c.rlike("[a-z]"), pick(LOWER)).when(c.rlike("[A-Z]"), pick(UPPER))
            for pattern, alphabet in SCRIPTS + OTHER_LETTERS:
                out = out.when(c.rlike(pattern), pick(alphabet))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _check_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    n = F.char_length(digits)

    def add(total: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return total + F.when((n - x["i"]) % 2 == 1, x["d"]).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.split(digits, ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(each, F.lit(0), add) % 10


def canonical(kind: Column, value: Column) -> Column:
    """What a value says, however it is written."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return (
        F.when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise("+1"), digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(value, r"\x20", ""))
        .when(kind == "ip", value)
        .otherwise(F.lower(value))
    )


def _placed(value: Column, drawn: Column, sort: str) -> Column:
    return _let(drawn, lambda bound: _put(value, bound, sort))


def _put(value: Column, drawn: Column, sort: str) -> Column:
    """``value`` with its characters of a sort, a pattern's class, replaced by those of ``drawn`` in turn; what is over comes last."""
    others = rf"[^{sort}]"

    def other(c: Column, i: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substr(value, F.lit(1), i), others, ""))
        return F.when(c.rlike(f"[{sort}]"), F.substr(drawn, before + 1, F.lit(1))).otherwise(c)

    own = F.char_length(F.regexp_replace(value, others, ""))
    return F.concat(F.array_join(F.transform(F.split(value, ""), other), ""), F.substr(drawn, own + 1))


def _card(digits: Column, stream: Column) -> Column:
    drawn = _reshaped(digits, stream, letters=False)
    short = F.substr(drawn, F.lit(1), F.char_length(drawn) - 1)
    last = (10 - _check_sum(F.concat(short, F.lit("0")))) % 10
    return F.when(_check_sum(digits) == 0, F.concat(short, last.cast("string"))).otherwise(drawn)


def _address(value: Column, stream: Column, draw: Column) -> Column:
    """An address of the same private range, a multicast one for a multicast one, or else one of no special range."""
    byte = lambda k: F.conv(F.substring(stream, k, 2), 16, 10).cast("int")
    octet = lambda k: (byte(k) % 254 + 1).cast("string")
    plain = F.filter(F.sequence(F.lit(1), F.lit(223)), lambda o: ~o.isin(*SPECIAL_OCTETS))
    first = F.element_at(plain, (F.conv(F.substring(stream, 1, 4), 16, 10).cast("int") % F.size(plain)) + 1)
    out = F.lit(None).cast("string")
    for pattern, start in RANGES.items():
        rest = [octet(3 + 2 * k) for k in range(4 - start.count("."))]
        out = F.when(value.rlike(pattern), F.concat(F.lit(start), F.concat_ws(".", *rest))).otherwise(out)
    inner = F.concat(F.lit("172."), (byte(3) % 16 + 16).cast("string"), F.lit("."), F.concat_ws(".", octet(5), octet(7)))
    cast = F.concat_ws(".", (byte(3) % 16 + 224).cast("string"), octet(5), octet(7), octet(9))
    out = F.when(value.rlike(r"^172\.(?:1[6-9]|2\d|3[01])\."), inner).when(value.rlike(r"^2(?:2[4-9]|3\d)\."), cast).otherwise(out)
    other = F.concat_ws(".", first.cast("string"), octet(5), octet(7), octet(9))
    return F.coalesce(F.when(draw < 20, out), other)


def _hex_reshaped(value: Column, stream: Column) -> Column:
    """``value`` with other hexadecimal digits of the same case in the same places."""

    def other(c: Column, i: Column) -> Column:
        digit = F.substr(stream, (i % 64) + 1, F.lit(1))
        return F.when(c.rlike("[0-9a-f]"), digit).when(c.rlike("[A-F]"), F.upper(digit)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _mod97(text: Column) -> Column:
    """The number that digits and capital letters (A is 10) spell, modulo 97."""

    def add(total: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + letter) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(bare: Column, stream: Column) -> Column:
    country = F.substring(bare, 1, 2)
    account = _reshaped(F.substr(bare, F.lit(5)), stream, True)
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))) == 1
    return F.when(valid, F.concat(country, check, account)).otherwise(F.concat(country, _reshaped(F.substr(bare, F.lit(3)), stream, True)))


def _name(value: Column, stream: Column, ending: Column, tail: Column) -> Column:
    """An invented name with the hyphens and apostrophes of ``value``; a single letter stays a single letter."""

    def spelled(syllables: list[str], letters: str, last: Column) -> Column:
        table = F.array(*map(F.lit, syllables))
        pieces = F.split(value, r"(?<=['’-])")

        def piece(x: Column, i: Column) -> Column:
            at = lambda k: _hex_at(stream, i * 3 + k)
            mark = F.regexp_extract(x, r"(['’-]?)$", 1)
            word = F.concat(*[F.element_at(table, at(k) + 1) for k in range(3)])
            word = F.concat(word, F.when(i == F.size(pieces) - 1, F.concat(last, tail)).otherwise(""))
            single = (F.char_length(x) - F.char_length(mark) == 1) & (F.char_length(mark) == 1)
            return F.concat(F.when(single, F.substr(F.lit(letters), at(0) + 1, F.lit(1))).otherwise(F.initcap(word)), mark)

        return F.array_join(F.transform(F.filter(pieces, lambda x: x != ""), piece), "")

    latin = spelled(SYLLABLES, UPPER, ending)
    cyrillic = spelled(CYRILLIC, SCRIPTS[1][1], F.when(ending == "a", "а").when(ending == "o", "о").otherwise("ов"))
    out = F.when(value.rlike("^[\\p{IsLatin}'’-]+$"), latin).when(value.rlike("[А-Яа-я]"), cyrillic)
    out = out.otherwise(F.concat(_reshaped(value, stream, True), tail))
    return _let(out, lambda o: F.when((value == F.upper(value)) & (F.char_length(value) > 1), F.upper(o)).otherwise(o))


def _surrogate(kind: Column, value: Column, plain: Column, draw: Column, key: str) -> Column:
    """The surrogate of the canonical value ``plain`` at a draw, written as ``value`` is."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, plain, draw.cast("string")), 256)
    return _let(digest, lambda stream: _drawn(kind, value, plain, draw, stream))


def _drawn(kind: Column, value: Column, plain: Column, draw: Column, stream: Column) -> Column:
    tail = F.when(draw < 2, "").otherwise(F.substring(F.translate(stream, "0123456789", LOWER[6:]), 1, 40))
    tail = F.substr(tail, F.lit(1), F.greatest(draw - 1, F.lit(0)))
    code = F.regexp_extract(plain, COUNTRY, 0)
    digits = F.translate(F.substring(stream, 20, 40), "abcdef", "012345")
    longer = F.when(draw < 6, "").otherwise(F.substr(digits, F.lit(1), draw - 5))
    national = F.concat(_reshaped(F.substr(plain, F.char_length(code) + 1), stream, False), longer)
    written = F.when(value.startswith("+"), code).otherwise("")
    phone = F.concat(written, _placed(F.substr(value, F.char_length(written) + 1), national, "0-9"))
    return (
        F.when(kind.isin("local", "domain", "label"), F.concat(tail, _reshaped(value, stream, True)))
        .when(kind == "ip", _address(value, stream, draw))
        .when(kind == "ipv6", _hex_reshaped(value, stream))
        .when(kind == "phone", phone)
        .when(kind == "card", _placed(value, _card(plain, stream), "0-9"))
        .when(kind == "iban", _placed(value, _iban(plain, stream), "A-Za-z0-9"))
        .when(kind == "ssn", _placed(value, _reshaped(plain, stream, False), "0-9"))
        .when(kind == "given-f", _name(value, stream, F.lit("a"), tail))
        .when(kind == "given-m", _name(value, stream, F.lit("o"), tail))
        .otherwise(_name(value, stream, F.lit("er"), tail))
    )


def assign_draws(values: DataFrame, key: str, max_draws: int = 40) -> DataFrame:
    """(kind, plain, draw) for distinct (kind, plain) of canonical values; surrogates at these draws differ from each other and from all values."""
    n = partitions(values.sparkSession)  # a given number, so that few but costly rows are not gathered in one task
    table = cut(values.select("kind", "plain").distinct().repartition(n, "kind", "plain").withColumn("draw", F.lit(0)))
    same = Window.partitionBy("kind", "surrogate").orderBy("draw", "plain")
    for _ in range(max_draws):
        made = _let(_surrogate(F.col("kind"), F.col("plain"), F.col("plain"), F.col("draw"), key), lambda new: canonical(F.col("kind"), new))
        drawn = table.withColumn("surrogate", made)
        originals = table.select(F.col("kind").alias("o_kind"), F.col("plain").alias("o_plain"))
        checked = (
            drawn.withColumn("turn", F.row_number().over(same))
            .join(originals, (F.col("kind") == F.col("o_kind")) & (F.col("surrogate") == F.col("o_plain")), "left")
            .withColumn("clash", (F.col("turn") > 1) | F.col("o_plain").isNotNull())
            .select("kind", "plain", F.when(F.col("clash"), F.col("draw") + 1).otherwise(F.col("draw")).alias("draw"), "clash")
        )
        checked = cut(checked)
        if checked.filter("clash").isEmpty():
            return checked.select("kind", "plain", "draw")
        table = checked.select("kind", "plain", "draw")
    raise RuntimeError(f"surrogates still collide after {max_draws} draws")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, spans) for each row; text has surrogates, spans lists kind:start:end in the original."""
    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64("text"))
    found = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    # All kinds but names hold a digit or an @, and most texts hold neither.
    marked = F.col("text").rlike("[0-9@]")
    has = F.coalesce(F.when(marked, F.col("text").rlike(ENTITY)).otherwise(F.col("text").rlike(PATTERNS["name"])), F.lit(False))
    without = rows.filter(~has).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"), F.lit("").alias("spans"))
    # The texts with entities are taken apart once and written out.
    hits = cut(rows.filter(has).select("doc_id", "row", F.split("text", ENTITY).alias("gaps"), found.alias("found")))
    units = (
        hits.select("doc_id", "row", F.posexplode("found").alias("pos", "entity"))
        .select("doc_id", "row", "pos", F.posexplode(_units(F.col("entity"))).alias("part", "unit"))
        .select("doc_id", "row", "pos", "part", "unit.kind", "unit.value")
    )
    units = cut(units.withColumn("plain", canonical(F.col("kind"), F.col("value"))))
    table = assign_draws(units.filter("kind <> 'stays'"), key)
    surrogate = F.when(F.col("draw").isNotNull(), _surrogate(F.col("kind"), F.col("value"), F.col("plain"), F.col("draw"), key))
    new_parts = (
        units.join(table, ["kind", "plain"], "left")
        .withColumn("surrogate", surrogate)
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "part", F.coalesce("surrogate", "value").alias("new"), "kind", "value"))).alias("parts"))
        .select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "parts")
    )
    words = F.filter("parts", lambda p: p["kind"].rlike(NAMES))
    # Full names go first, then their words alone, common ones left out.
    full = F.transform(
        F.array_distinct(F.transform(words, lambda p: p["pos"])),
        lambda pos: F.struct(
            F.array_join(F.transform(F.filter(words, lambda p: p["pos"] == pos), lambda p: p["value"]), " ").alias("value"),
            F.array_join(F.transform(F.filter(words, lambda p: p["pos"] == pos), lambda p: p["new"]), " ").alias("new"),
        ),
    )
    alone = F.filter(words, lambda p: ~F.lower(p["value"]).isin(*COMMON_WORDS))
    single = F.transform(alone, lambda p: F.struct(p["value"].alias("value"), p["new"].alias("new")))
    names = F.concat(F.filter(full, lambda x: x["value"].contains(" ")), single)

    def renamed(gap: Column) -> Column:
        whole = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x["value"], F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.aggregate("names", gap, lambda text, x: F.regexp_replace(text, whole(x), x["new"]))

    fresh = F.transform(
        F.col("found"),
        lambda _, i: F.array_join(F.transform(F.filter("parts", lambda p: p["pos"] == i), lambda p: p["new"]), ""),
    )
    mixed = F.array_join(F.transform(F.arrays_zip("gaps", "fresh"), lambda x: F.concat(renamed(x["gaps"]), F.coalesce(x["fresh"], F.lit("")))), "")
    kinds = F.transform(
        F.col("found"),
        lambda _, i: F.regexp_replace(
            F.regexp_replace(F.filter("parts", lambda p: (p["pos"] == i) & (p["kind"] != "stays"))[0]["kind"], "^(given-.|family)$", "name"),
            "^(local|domain|label)$",
            "email",
        ),
    )
    walked = F.aggregate(
        F.arrays_zip("gaps", "found", "kinds"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["gaps"]) + F.coalesce(F.char_length(x["found"]), F.lit(0))).alias("at"),
            F.when(x["found"].isNull(), acc["out"])
            .otherwise(
                F.concat(
                    acc["out"],
                    F.array(
                        F.concat_ws(
                            ":",
                            x["kinds"],
                            (acc["at"] + F.char_length(x["gaps"])).cast("string"),
                            (acc["at"] + F.char_length(x["gaps"]) + F.char_length(x["found"])).cast("string"),
                        )
                    ),
                )
            )
            .alias("out"),
        ),
        lambda acc: F.array_join(acc["out"], ","),
    )
    having = (
        hits.join(new_parts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")))
        .select("doc_id", "gaps", "found", "parts", F.array_distinct(names).alias("names"))
        .select("doc_id", "gaps", "found", "names", fresh.alias("fresh"), kinds.alias("kinds"))
        .select("doc_id", mixed.alias("text"), F.size("found").cast("bigint").alias("n_entities"), walked.alias("spans"))
    )
    return without.unionByName(having)
