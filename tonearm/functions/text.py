"""Scalar text functions as column expressions: folding, catalogue numbers, barcodes, names, durations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0].isascii():
            pairs[c] = d[0]
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _BASE = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), _ACCENTED, _BASE)


def normalize(text: Column) -> Column:
    """For comparisons: folded, ``&`` as "and", letters, digits and blanks only, blanks collapsed, no leading "the "."""
    kept = F.regexp_replace(F.replace(fold(text), F.lit("&"), F.lit("and")), "[^\\p{L}\\p{N} ]", "")
    return F.regexp_replace(F.trim(F.regexp_replace(kept, " +", " ")), "^the ", "")


def similar(a: Column, b: Column) -> Column:
    """Of normalised texts: both non-empty and equal, or the first is at least 6 long and one holds the other."""
    return (a != "") & (b != "") & ((a == b) | ((F.length(a) >= 6) & (a.contains(b) | b.contains(a))))


#: Words that say nothing about an edition.
GENERIC_EDITION_WORDS = ("edition", "version", "the", "of", "and", "release", "import", "press", "pressing")


def edition_keywords(edition: Column) -> Column:
    """Words of an edition's name that tell editions apart, without a past-tense ending."""
    words = F.filter(F.split(normalize(edition), " "), lambda w: (w != "") & ~w.isin(*GENERIC_EDITION_WORDS))
    return F.transform(words, lambda w: F.when(w.endswith("ed") & (F.length(w) > 5), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w))


def edition_matches(keywords: Column, words: Column) -> Column:
    """Every keyword starts some word; null without keywords."""
    return F.when(F.size(keywords) > 0, F.forall(keywords, lambda k: F.exists(words, lambda w: w.startswith(k))))


def catalogue_key(code: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(code), "[^\\p{L}\\p{N}]", "")


#: Words before a number that are no label's prefix.
STOP_WORDS = (
    "CD DVD SACD LP TRACK DISC SIDE TOTAL TIME PAGE VOL NO STEREO MONO ISBN EAN UPC JAN TEL FAX BOX SUITE NEW YORK LONDON TOKYO PARIS "
    "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER "
    "ENERO FEBRERO MARZO ABRIL MAYO JUNIO JULIO AGOSTO SEPTIEMBRE OCTUBRE NOVIEMBRE DICIEMBRE "
    "EUROPE JAPAN GERMANY HOLLAND FRANCE ITALY SPAIN ENGLAND USA UK EU MADE PRINTED "
    "MANUFACTURED DISTRIBUTED RECORDED MIXED MASTERED COPYRIGHT LIVE TOUR STUDIO RECORDS MUSIC "
    "IN FOR THIS THE AND OF ON AT BY TO FROM WITH SINCE YEAR ALL RIGHTS RESERVED"
).split()
#: Prefixes of American postal codes.
US_STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN "
    "TX UT VT VA WA WV WI WY"
).split()
#: Ways to print a catalogue number, in order of trust.
CODE_PATTERNS = (
    r"\b([A-Z]{2,10})-(\d{1,6})\b",
    r"\b([A-Z]{2,10})\s+(\d{3,6})\b",
    r"\b([A-Z]{2,10})\s*[-~_]\s*(\d{1,6})\b",
    r"\b([A-Z]{2,6})(\d{4,7})\b",
)


def catalogue_codes(line: Column) -> Column:
    """Catalogue numbers printed in a line as PREFIX-NUMBER, each once, in order of pattern and place."""
    upper = F.upper(line)
    found = []
    for p in CODE_PATTERNS:
        pairs = F.arrays_zip(F.regexp_extract_all(upper, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(upper, F.lit(p), F.lit(2)).alias("b"))
        pairs = F.filter(pairs, lambda x: ~x["a"].isin(*STOP_WORDS) & ~(x["a"].isin(*US_STATES) & (F.length(x["b"]) == 5)))
        found.append(F.transform(pairs, lambda x: F.concat_ws("-", x["a"], x["b"])))
    return F.array_distinct(F.concat(*found))


def expand_range(code: Column) -> Column:
    """A range of numbers (``ABC-0098/101``, ``X-12~3``) as all its codes; anything else as itself."""
    s = F.trim(code)
    head, tail = F.trim(F.regexp_extract(s, "^(.*)[/~]([^/~]*)$", 1)), F.trim(F.regexp_extract(s, "^(.*)[/~]([^/~]*)$", 2))
    first = F.regexp_extract(head, "(\\d+)$", 1)
    prefix = F.substring(head, F.lit(1), F.length(head) - F.length(first))
    last = F.concat(F.substring(first, F.lit(1), F.length(first) - F.length(tail)), tail)
    a, b = first.try_cast("long"), last.try_cast("long")
    ok = (F.length(first) > 0) & tail.rlike("^[0-9]+$") & (F.length(tail) <= F.length(first)) & (b > a) & (b - a < 50)
    low, high = F.when(ok, a).otherwise(F.lit(0)), F.when(ok, b).otherwise(F.lit(0))
    codes = F.transform(F.sequence(low, high), lambda n: F.concat(prefix, F.lpad(n.cast("string"), F.greatest(F.length(first), F.length(n.cast("string"))), F.lit("0"))))
    return F.when(F.coalesce(ok, F.lit(False)), codes).otherwise(F.array(s))


def matching_codes(field: Column) -> Column:
    """All codes that a catalogue field (joined by ``,``, ``&`` or ``;``) stands for."""
    parts = F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), "[,&;]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.flatten(F.transform(parts, expand_range))


def looks_like_barcode(value: Column) -> Column:
    return F.trim(value).rlike("^[0-9]{12,14}$")


def barcode_key(value: Column) -> Column:
    """Digits without leading zeros: equal for the UPC and EAN forms of a code; null without any digit."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(digits != "", F.regexp_replace(digits, "^0+", ""))


def barcode_forms(value: Column) -> Column:
    """The spellings under which catalogues hold a barcode; none for fewer than 8 digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    other = F.when(n == 12, F.concat(F.lit("0"), digits)).when((n == 13) & digits.startswith("0"), F.substring(digits, F.lit(2), n))
    return F.when(n >= 8, F.array_compact(F.array(digits, other))).otherwise(F.array().cast("array<string>"))


def catalogue_variants(raw: Column) -> Column:
    """Spellings of a catalogue number: as it is, split at letters and digits by blanks and by hyphens, and glued."""
    glued = catalogue_key(raw)
    spaced = F.regexp_replace(glued, "(?<=\\p{L})(?=\\P{L})|(?<=\\P{L})(?=\\p{L})", " ")
    return F.array_distinct(F.filter(F.array(raw, spaced, F.replace(spaced, F.lit(" "), F.lit("-")), glued), lambda v: v != ""))


def codes_match(a: Column, b: Column) -> Column:
    """Of catalogue keys: the first is not empty, and they are equal, or it is at least 6 long and one ends the other."""
    return (a != "") & ((a == b) | ((F.length(a) >= 6) & (a.endswith(b) | b.endswith(a))))


def duration_ms(text: Column) -> Column:
    """mm:ss or h:mm:ss in milliseconds, else null."""
    p = F.transform(F.split(text, ":"), lambda x: x.try_cast("int"))
    n, known = F.size(p), F.forall(p, lambda x: x.isNotNull())
    at = lambda i: F.try_element_at(p, F.lit(i))
    return F.when(known & (n == 2), (at(1) * 60 + at(2)) * 1000).when(known & (n == 3), (at(1) * 3600 + at(2) * 60 + at(3)) * 1000)


def trailing_number(position: Column) -> Column:
    """The digits that end a position ("A1"), else null."""
    return F.regexp_extract(position, "(\\d+)$", 1).try_cast("int")


def artist_title(text: Column) -> tuple[Column, Column]:
    """The parts of "Artist - Album"; without a dash all is the title."""
    parts = F.split(text, " - ", 2)
    both = F.size(parts) == 2
    return F.when(both, F.trim(parts[0])), F.when(both, F.trim(F.try_element_at(parts, F.lit(2)))).otherwise(text)


#: A disc's number in a file or folder name.
_DISC_WORDS = r"(?:cd|disc|disco|disk|dvd)\s*[-_.#]?\s*(\d{1,2})(?:\s*(?:of|de|-|/)\s*(\d{1,2}))?"
DISC_TOKEN = rf"(?i)(?:^|[\s\(\[_\-.]){_DISC_WORDS}(?=$|[\s\)\]_\-.,])"
DISC_FOLDER = r"(?i)^(?:cd|disc|disco|disk|dvd)\s*[-_.#]?\s*(\d{1,2})\b"


def without_extension(name: Column) -> Column:
    """Drops an ending of 2 to 5 letters and digits with a letter among them."""
    return F.regexp_replace(name, "(?<=.)\\.(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{2,5}$", "")


def disc_token(name: Column) -> tuple[Column, Column]:
    """Number and total of a disc, as a name states them; null where it does not."""
    base = without_extension(name)
    return F.regexp_extract(base, DISC_TOKEN, 1).try_cast("int"), F.regexp_extract(base, DISC_TOKEN, 2).try_cast("int")


def without_disc_token(name: Column) -> Column:
    """The name without its first disc token and the token's own brackets."""
    base = without_extension(name)
    bracket = rf"(?i)[\(\[]{_DISC_WORDS}\s*[\)\]]"
    gone = F.when(base.rlike(bracket), F.regexp_replace(base, "^(.*?)" + bracket.replace("(?i)", "(?i:") + ")", "$1")).otherwise(F.regexp_replace(base, "(?s)^(.*?)" + DISC_TOKEN.replace("(?i)", "(?i:") + ")", "$1"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(gone, "\\(\\s*\\)|\\[\\s*\\]", ""), "\\s{2,}", " "), "^[\\s\\-_.,]+|[\\s\\-_.,]+$", "")


def folder_disc(name: Column) -> Column:
    return F.regexp_extract(name, DISC_FOLDER, 1).try_cast("int")


def natural_key(name: Column) -> Column:
    """Sorts digits by value: folded, each run of digits filled to 12 places."""
    runs = F.regexp_extract_all(fold(name), F.lit("(\\d+|\\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^\\d"), F.lpad(r, 12, "0")).otherwise(r)), "")


#: Bytes of a path component, and the characters that a longer one is cut to.
COMPONENT_BYTES = 200


def safe_component(value: Column) -> Column:
    """A path component: ``/`` and ``:`` as ``-``, blanks collapsed, no control characters or empty brackets, no
    dangling dash, no leading dots, no trailing dots or blanks, cut to 200 characters if its bytes are more."""
    s = F.regexp_replace(F.regexp_replace(F.translate(value, "/:", "--"), "\\s+", " "), "\\p{Cntrl}", "")
    s = F.regexp_replace(F.regexp_replace(s, "\\( ?\\)|\\[ ?\\]|\\{\\}", ""), "\\s+", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "(\\s-\\s*)+$", ""), "^(\\s*-\\s)+", ""))
    s = F.regexp_replace(F.regexp_replace(s, "^\\.+", ""), "[. ]+$", "")
    return F.when(F.octet_length(s) > COMPONENT_BYTES, F.trim(F.left(s, F.lit(COMPONENT_BYTES)))).otherwise(s)


#: What stands for letters and signs that have no base letter.
ASCII_SIGNS = {
    "–": "-", "—": "-", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "…": "...", "×": "x", "ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D",
    "ł": "l", "Ł": "L", "ı": "i", "·": "-", "／": "-", "＆": "&",
}
#: Latin letters of the Cyrillic and Greek alphabets, without accents.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщыэюя", "abvgdeezzijklmnoprstufhccssyeua", strict=True))
GREEK = dict(zip("αβγδεζηικλμνξοπρσςτυωάέήίόύώ", "abgdezeiklmnxoprsstuoaeeiouo", strict=True)) | {"θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps"}


def ascii_safe(value: Column) -> Column:
    """Printable ASCII only: accents go, full-width forms, typographic signs, Cyrillic and Greek letters are replaced, all else is blank."""
    table = CYRILLIC | GREEK
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | ASCII_SIGNS | table | {k.upper(): v.capitalize() for k, v in table.items()}
    one = {k: v for k, v in table.items() if len(v) == 1 and len(k) == 1}
    s = F.translate(value, _ACCENTED + "".join(one), _BASE + "".join(one.values()))
    for k, v in table.items():
        if len(k) == 1 and len(v) > 1:
            s = F.replace(s, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^\\x20-\\x7E]", " "), "\\s+", " "))


def render_template(template: str, values: dict[str, Column], ascii: bool = False) -> Column:
    """A path from a template such as ``{artist}/{album} ({year})``: components are rendered and made safe one by one; empty ones go.

    Names in braces count in any case, unknown ones are empty, a brace without its end stays. A value's own slashes
    never part components.
    """
    import re

    parts = []
    for component in filter(None, template.split("/")):
        texts, names = re.split(r"\{[^}]*\}", component), re.findall(r"\{([^}]*)\}", component)
        bits = [F.lit(texts[0])]
        for name, text in zip(names, texts[1:], strict=True):
            held = values.get(name.lower())
            bits += [F.lit("") if held is None else F.coalesce(F.translate(held.cast("string"), "/", "-"), F.lit("")), F.lit(text)]
        whole = F.concat(*bits)
        parts.append(safe_component(ascii_safe(whole) if ascii else whole))
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def csv_line(*fields: Column) -> Column:
    """Fields in double quotes, quotes doubled, joined by commas; nulls are empty."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(f.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in fields])


def form_value(query: Column, name: str) -> Column:
    """A decoded value of a query string: ``+`` is a blank, %xx a byte."""
    raw = F.element_at(F.str_to_map(query, F.lit("&"), F.lit("=")), F.lit(name))
    return F.try_url_decode(raw)


#: Lengths of what wildcard_prefix gives.
WILDCARD_LENGTHS = range(4, 18)


def glued(code: Column) -> Column:
    """A code in upper case without anything but A to Z and digits."""
    return F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")


def wildcard_prefix(code: Column) -> Column:
    """The letters and the first digits of a catalogue number, as a search by prefix takes them ("CAPP 139" finds CAPP139SA): two to
    ten letters and two to seven digits of the code without anything else; null if it doesn't begin so."""
    return F.nullif(F.regexp_extract(glued(code), "^([A-Z]{2,10}[0-9]{2,7})", 1), F.lit(""))
