"""Column functions over OCR and catalog text.

Boundaries and white space are spelled out, as Java's own differ from what the data were
written with: a word character is an ASCII letter, digit or underscore, and white space
includes the no-break space and the byte-order mark.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK, NOT_BLANK = r"[\s\u00a0\ufeff]", r"[^\s\u00a0\ufeff]"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# The form of a part number and of a header.
#: 4 to 7 digits, perhaps with a suffix that starts with a letter, or 3 digits with one.
NUMBER = r"(?:[0-9]{4,7}(?:[A-Za-z][A-Za-z0-9]*)?|[0-9]{3}[A-Za-z][A-Za-z0-9]*)"
PART = LEFT + NUMBER + RIGHT
HEADER = rf"(?i){LEFT}(?:parts?|inventory|elements?){RIGHT}"


def trimmed(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")


def blank_as_null(x: Column) -> Column:
    t = trimmed(x)
    return F.when(t != "", t)


def line(x: Column) -> Column:
    """A line with its multiplication signs as x and single blanks."""
    return trimmed(F.regexp_replace(F.translate(x, "×✕", "xx"), rf"{BLANK}+", " "))


def part_number(x: Column) -> Column:
    """A part number as it is stored: trimmed and in small letters."""
    return F.lower(trimmed(x))


def has_part_number(x: Column) -> Column:
    return x.rlike(PART)


def is_header(x: Column) -> Column:
    return x.rlike(HEADER)


def part_numbers(x: Column) -> Column:
    """All part numbers of a text in order, in small letters."""
    return F.transform(F.regexp_extract_all(x, F.lit(PART), F.lit(0)), F.lower)


def canonical_number(x: Column) -> Column:
    """Digits, pb or pr and a print number become digits, pr and four digits at least; others stay."""
    form = r"^([0-9]+)(?:pb|pr)0*([0-9]+)$"
    n = F.regexp_extract(x, form, 2)
    wide = F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)
    return F.when(x.rlike(form), F.concat(F.regexp_extract(x, form, 1), F.lit("pr"), wide)).otherwise(x)


def number_base(x: Column) -> Column:
    """The leading digits, or null."""
    d = F.regexp_extract(x, "^[0-9]+", 0)
    return F.when(d != "", d)


def print_base(x: Column) -> Column:
    """What precedes a print suffix pr, or null."""
    d = F.regexp_extract(x, "^(.+?)pr[0-9a-z]*$", 1)
    return F.when(d != "", d)


def variant_base(x: Column) -> Column:
    """The digits of a number of 4 to 7 digits and one letter, or null."""
    d = F.regexp_extract(x, "^([0-9]{4,7})[a-z]$", 1)
    return F.when(d != "", d)


def leading_integer(x: Column, most: int = 2_147_483_647) -> Column:
    """The positive integer with which a text starts, whatever follows, or null."""
    n = F.regexp_extract(x, rf"^{BLANK}*\+?([0-9]+)", 1).try_cast("long")
    return F.when((n > 0) & (n <= most), n.cast("int"))


def truth(x: Column) -> Column:
    return F.coalesce(F.lower(trimmed(x)).isin("true", "yes", "1"), F.lit(False))


def half_up(x: Column) -> Column:
    """Rounded to an integer, halves up."""
    return F.floor(x + 0.5)


def url_component(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def squashed(x: Column) -> Column:
    """Letters and digits only, small."""
    return F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))


def color_key(x: Column) -> Column:
    """A colour name's lookup key: small, grey as gray, hyphens and underscores as blanks, single blanks."""
    return trimmed(F.regexp_replace(F.replace(F.replace(F.replace(F.lower(x), F.lit("grey"), F.lit("gray")), F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" ")), rf"{BLANK}+", " "))


# Words left out when names are compared.
STOP_WORDS = ["and", "for", "the", "to", "with", "without"]


# Colour ids and their names.
COLOR_NAMES = {
    "0": "Black", "1": "Blue", "2": "Green", "4": "Red", "14": "Yellow", "15": "White", "19": "Tan", "25": "Orange", "28": "Dark Tan", "47": "Transparent", "70": "Reddish Brown", "71": "Light Bluish Gray",
    "72": "Dark Bluish Gray", "179": "Flat Silver",
}


def color_name(x: Column) -> Column:
    """The name of a usual colour id; other texts stand for themselves, blank ones are null."""
    t = blank_as_null(x)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in COLOR_NAMES.items() for v in kv]), t), t)


def color_phrase_key(x: Column) -> Column:
    """A key of equal colour phrases: small, grey as gray, single blanks; hyphens stay."""
    return trimmed(F.regexp_replace(F.replace(F.lower(x), F.lit("grey"), F.lit("gray")), rf"{BLANK}+", " "))


def color_variants(name: str) -> list[str]:
    """Ways in which a colour's name is written: with blanks, hyphens or neither, gray or grey, trans or transparent."""
    name = name.strip()
    spaced = dict.fromkeys(v for v in (name, name.replace("-", " "), re.sub(r"\s+", "-", name)) if v)
    out = dict(spaced)
    for v in spaced:
        for old, new in ((r"[-\s]+", ""), (r"(?i)\bgray\b", "Grey"), (r"(?i)\bgrey\b", "Gray"), (r"(?i)^trans[-\s]", "Transparent ")):
            out[re.sub(old, new, v)] = None
    return list(out)


def color_pattern(x: Column) -> Column:
    """A pattern, for small texts, of all ways in which the colour's name is written, as words by themselves; null without a name."""
    name = F.lower(blank_as_null(x))
    plain = F.regexp_replace(F.regexp_replace(name, r"([^a-z0-9\s-])", r"\\$1"), r"[-\s]+", r"[-\\s]*")
    gray = F.replace(F.replace(plain, F.lit("gray"), F.lit("gr[ae]y")), F.lit("grey"), F.lit("gr[ae]y"))
    trans = F.when(F.startswith(gray, F.lit("trans[")), F.concat(F.lit("trans(?:parent)?"), F.substring(gray, 6, 1 << 30))).otherwise(gray)
    return F.concat(F.lit(LEFT + "(?:"), trans, F.lit(")" + RIGHT))


def may_name(low: Column, color: Column) -> Column:
    """Whether a small text has the first word of the colour's name, without which ``color_pattern`` has no match; true for words with gray or grey."""
    head = F.substring_index(F.translate(F.lower(trimmed(color)), "-\t\n\x0b\f\r", "      "), " ", 1)
    return F.contains(low, head) | F.contains(head, F.lit("gray")) | F.contains(head, F.lit("grey"))


def literal_pattern(x: Column) -> Column:
    """A pattern of the text itself, as a word by itself."""
    return F.concat(F.lit(LEFT), F.regexp_replace(x, r"([^A-Za-z0-9])", r"\\$1"), F.lit(RIGHT))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def name_tokens(x: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct words of a name, longer than a letter and not stop words."""
    return F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(stop_words)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def luminance(c: Column) -> Column:
    return 0.299 * c["r"] + 0.587 * c["g"] + 0.114 * c["b"]


def saturation(c: Column) -> Column:
    """Spread of the channels over the largest, 0 for black."""
    high, low = F.greatest(c["r"], c["g"], c["b"]), F.least(c["r"], c["g"], c["b"])
    return F.when(high > 0, (high - low) / high).otherwise(F.lit(0.0))


def rgb(x: Column) -> Column:
    """Struct r, g, b of six hex digits, perhaps after #; null if it is none."""
    h = F.regexp_extract(x, "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    return F.when(h != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def color_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two rgb structs."""
    return F.sqrt(sum((F.pow(a[c] - b[c], F.lit(2)) for c in "gb"), F.pow(a["r"] - b["r"], F.lit(2))))
