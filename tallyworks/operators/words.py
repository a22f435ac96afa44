"""Part rows from words and their boxes: reading order, rows, part numbers and the counts beside them.

A page's words are few, and each page is worked on by itself. The order of reading is not
transitive, so it is one stable comparison sort, the same everywhere.
"""

from __future__ import annotations

import re
from functools import cmp_to_key
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import text as T
from tallyworks.plans import flagship

#: Words within so many pixels of height are read from left to right.
BAND = 12
#: A word joins a row whose mean height is within this, or 2.5 times its own height.
ROW = 36
# The largest count, and where a count may stand: (pixels at least, part heights) in the part's row, (pixels at least, heights up, widths aside) above it.
MOST = 999
SAME_ROW, ABOVE = (22, 1.8), (180, 8, 2.5)
SLOT_ROW, SLOT_ABOVE = (28, 2.2), (160, 7, 2.2)
NUMBER = re.compile(rf"^{T.NUMBER}$")
COUNT = re.compile(r"^(?:([0-9]{1,4})x|x([0-9]{1,4}))$")
INTEGER = re.compile(r"^[0-9]{1,3}$")
#: What recognition makes of a lone count of one.
ONE = re.compile(r"^(?:[.@&#]+|x)$")


class Word(NamedTuple):
    text: str
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def x(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def y(self) -> float:
        return (self.y0 + self.y1) / 2

    @property
    def height(self) -> float:
        return self.y1 - self.y0


def reading_order(words: list[Word]) -> list[Word]:
    """By height unless within a band, then from the left."""
    return sorted(words, key=cmp_to_key(lambda a, b: (a.y0 > b.y0) - (a.y0 < b.y0) if abs(a.y0 - b.y0) > BAND else (a.x0 > b.x0) - (a.x0 < b.x0)))


def rows(words: list[Word]) -> list[list[Word]]:
    """Words in order, each in the first row whose mean height is near its own."""
    out: list[list[Word]] = []
    for w in reading_order(words):
        for r in out:
            if abs(sum(v.y for v in r) / len(r) - w.y) <= max(2.5 * w.height, ROW):
                r.append(w)
                break
        else:
            out.append([w])
    return out


def part_word(words: list[Word]) -> tuple[str, Word] | None:
    """The part number among a card's words: a word, two neighbours that make one, or in the running text."""
    for w in words:
        if NUMBER.match(w.text):
            return w.text.lower(), w
    for a, b in zip(words, words[1:], strict=False):
        if re.match(r"^[0-9]{3,7}$", a.text) and NUMBER.match(a.text + b.text):
            return (a.text + b.text).lower(), a
    text = re.sub(r"([0-9]{3,7}) ([A-Za-z]{1,3}[0-9]*)\b", r"\1\2", " ".join(w.text for w in words))
    found = re.search(T.PART, text)
    if not found:
        return None
    return found[0].lower(), next((w for w in words if found[0].startswith(w.text)), words[0])


def small(text: str) -> int | None:
    """A positive integer up to MOST with which a text starts."""
    m = re.match(r"\s*\+?([0-9]+)", text)
    n = int(m[1]) if m else 0
    return n if 0 < n <= MOST else None


def count(text: str) -> int | None:
    """The count of a word like 4x or x4, with usual misreadings of 1 put right."""
    t = re.sub(r"^[^0-9A-Za-z|]+|[^0-9A-Za-z|]+$", "", text.replace("×", "x").replace("✕", "x")).lower()
    m = COUNT.match(re.sub(r"^[il|](?=x$)|(?<=^x)[il|]$", "1", t))
    return small(m[1] or m[2]) if m else None


def is_one(text: str) -> bool:
    """Whether a word is what recognition makes of a lone count of one: dots and signs, or one x."""
    return bool(ONE.match(re.sub(r"[^@&#.x]", "", text.strip().replace("×", "x").replace("✕", "x").lower())))


def _reach(part: Word) -> tuple[float, float]:
    """Height and width of a part word, in which distances are measured."""
    return max(1.0, part.height), part.x1 - part.x0


def _level(w: Word, part: Word, least: float, factor: float) -> bool:
    return abs(w.y - part.y) <= max(least, factor * _reach(part)[0])


def _above(w: Word, part: Word, least: float, up: float, aside: float) -> bool:
    h, width = _reach(part)
    return 0 < part.y - w.y <= max(least, up * h) and abs(w.x - part.x) <= max(least, aside * width)


def is_standalone(w: Word, part: Word, after: Word | None) -> bool:
    """Whether an integer of up to three digits stands where a part's count does: above it, before it in its row, or right after it and no dimension."""
    if not INTEGER.match(w.text.strip()):
        return False
    h = _reach(part)[0]
    level = _level(w, part, *SAME_ROW)
    behind = level and part.x1 <= w.x0 <= part.x1 + 4 * h and not (after and after.text.strip().lower() == "x")
    return behind or _above(w, part, *ABOVE) or level and w.x1 <= part.x0 + 3 * h


def in_slot(w: Word, part: Word) -> bool:
    """Whether a sign stands where a part's count does: before it in its row, or above it."""
    return w is not part and (_level(w, part, *SLOT_ROW) and w.x <= part.x or _above(w, part, *SLOT_ABOVE))


def quantity(words: list[Word], part: Word) -> int | None:
    """The count of a part word: the Nx nearest to it from left to right, an integer in its place, an integer beside the first lone x, a sign that stands for one.

    words are in reading order and may hold the part's own word.
    """
    explicit = [(abs(w.x - part.x), n) for w in words if (n := count(w.text))]
    if explicit:
        return min(explicit, key=lambda c: c[0])[1]
    after = dict(enumerate(words[1:]))
    whole = [(abs(w.x - part.x), n) for i, w in enumerate(words) if w is not part and (n := small(w.text)) and is_standalone(w, part, after.get(i))]
    if whole:
        return min(whole, key=lambda c: c[0])[1]
    at = next((i for i, w in enumerate(words) if w.text.lower() == "x"), None)
    if at is not None:
        x = words[at]
        if not (_level(x, part, *SAME_ROW) and x.x0 <= part.x1 + 5 * _reach(part)[0]):
            return None
        beside = [n for w in (*words[max(0, at - 1) : at], *words[at + 1 : at + 2]) if is_standalone(w, part, None) and (n := small(w.text))]
        if beside:
            return beside[0]
    return 1 if any(is_one(w.text) and in_slot(w, part) for w in words) else None


def page_rows(words: list[Word]) -> list[tuple[int, str, int | None, str]]:
    """(place, part number, quantity, text) of each part word; other words belong to the part word nearest to them, the first of equals."""
    ordered = reading_order(words)
    parts = [w for w in ordered if NUMBER.match(w.text)]
    if not parts:
        return []
    own: dict[int, list[Word]] = {i: [] for i in range(len(parts))}
    for w in ordered:
        own[min(range(len(parts)), key=lambda i: ((w.x - parts[i].x) ** 2 + (w.y - parts[i].y) ** 2, i))].append(w)
    return [(i, p.text.lower(), quantity(own[i], p), " ".join(w.text for r in rows(own[i]) for w in r)) for i, p in enumerate(parts)]


def items(words: DataFrame, names: list[tuple[str, str]] | None = None) -> DataFrame:
    """Part rows of words(manual_id, page_number, word_index, text, x0, y0, x1, y1), in reading order of a page."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_index")
        found = page_rows([Word(*r) for r in pdf[["text", "x0", "y0", "x1", "y1"]].itertuples(index=False)])
        return pd.DataFrame({
            "manual_id": pd.Series([pdf["manual_id"].iloc[0]] * len(found), dtype=object), "page_number": pd.Series([int(pdf["page_number"].iloc[0])] * len(found), dtype="int32"), "place": pd.Series([r[0] for r in found], dtype="int32"),
            "part_number": pd.Series([r[1] for r in found], dtype=object), "quantity": pd.Series([r[2] for r in found], dtype="Int32"), "raw_text": pd.Series([r[3] for r in found], dtype=object),
        })

    clean = words.select("manual_id", F.col("page_number").cast("int").alias("page_number"), "word_index", T.trimmed(F.col("text")).alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).where("text <> ''").dropna(subset=["x0", "y0", "x1", "y1"])
    found = clean.groupBy("manual_id", "page_number").applyInPandas(page, "manual_id string, page_number int, place int, part_number string, quantity int, raw_text string")
    names = names or flagship.vocabulary(flagship.COLORS)
    return found.select("*", flagship.color(F.col("raw_text"), F.col("part_number"), names).alias("color_name"), flagship.description(F.col("raw_text"), F.col("part_number"), names).alias("description"))
