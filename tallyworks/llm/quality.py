"""Operator 9: quality rules with distribution divergence.

Base counts are per-document expressions: no shuffle. The verdict compares a document's
histograms of character classes and of common words with the references of its language
by Jensen-Shannon distance; documents too short for a histogram to mean much are kept.
References are learned from all documents that pass the base rules, as mean histograms.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keep, table, text_of

#: Base rules: least words, most percent of words in repeated windows, window length.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Character classes as Java sets; white space is a class too, and the last is every other character: small letters mostly.
CLASSES = [r"\p{Lu}++", r"\p{Nd}++", r"[.,;:!?'\"()-]++", r"[#*$%&|<>=_{}\[\]\\/@^~`+]++"]
# Common function words, by language.
COMMON = {
    "en": ["the", "and", "of", "to", "a", "in", "is", "that", "it", "was", "for", "with", "as", "be", "on", "this", "are", "by", "at", "from"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "ist", "von", "mit", "auf", "ein", "eine", "nicht", "dem", "des", "auch", "es", "an", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "du", "en", "est", "que", "qui", "dans", "pour", "pas", "sur", "au", "par", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "lo"],
}
#: A verdict needs so many characters for classes and so many words for common words.
LEAST_CHARS, LEAST_FOR_WORDS = 200, 100
#: Jensen-Shannon distances (base 2, 0 to 1) above which a document is unlike its language.
FAR_CLASSES, FAR_WORDS = 0.3, 0.33


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(ordered: Column, window: int) -> Column:
    """Words that windows of repeated hashes cover, from sorted (hash, place) structs of all windows."""
    n = F.size(ordered)
    hashes = F.transform(ordered, lambda x: x["h"])
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(hashes, 1, n - 1))
    after = F.slice(hashes, 2, n - 1)
    twice = F.zip_with(F.zip_with(ordered, before, lambda x, b: F.struct(x["h"].alias("h"), x["i"].alias("i"), F.coalesce(x["h"] == b, F.lit(False)).alias("b"))), after, lambda x, a: F.when(x["b"] | F.coalesce(x["h"] == a, F.lit(False)), x["i"]))
    places = F.sort_array(F.filter(twice, lambda i: i.isNotNull()))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in a text, every occurrence included, from the hashes of its windows in order."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bound(ordered, lambda o: _covered(o, window))).otherwise(F.lit(0)).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """The base counts and the two histograms of every row."""
    text = text_of(docs)
    blank = " \t\n\x0b\x0c\r"
    bare = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"), F.btrim(text, F.lit(blank)).alias("bare"))
    words = bare.select("doc_id", "lang", "text", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", SPACE + "++")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)])
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<long>"))
    common = sorted({w for ws in COMMON.values() for w in ws})
    without = lambda c: F.length(F.regexp_replace("text", c, ""))
    cut = words.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), F.length("text").cast("long").alias("chars"), without(SPACE + "++").cast("long").alias("word_chars"),
        without(f"[{SYMBOLS}]++").alias("plain"), F.array(*map(without, CLASSES)).alias("rests"), lines.alias("lines"), hashes.alias("hashes"), F.filter("words", lambda w: w.isin(common)).alias("common"),
    )
    return cut.select(
        "doc_id", "lang", "n_words", "word_chars",
        (F.col("chars") - F.col("plain")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("hashes")).alias("n_repeat_words"),
        "chars",
        F.concat(F.transform("rests", lambda r: (F.col("chars") - r).cast("double")), F.array((F.col("chars") - F.col("word_chars")).cast("double"))).alias("classes"),
        "common",
    )


def _shares(values: Column, total: Column) -> Column:
    """Shares of the total, with what is left as a last bin."""
    used = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(F.concat(values, F.array(F.greatest(total - used, F.lit(0.0)))), lambda v: v / total))


def _equals(word: str):
    return lambda x: x == word


def _word_counts(lang: Column, common: Column) -> Column:
    out = None
    for k, ws in COMMON.items():
        c = F.array(*[F.size(F.filter(common, _equals(w))).cast("double") for w in ws])
        out = F.when(lang == k, c) if out is None else out.when(lang == k, c)
    return out


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of equal length."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda s, v: s + v), F.lit(0.0)))


def _references(measured: DataFrame) -> dict[str, tuple[list[float], list[float] | None]]:
    """Mean histograms of each language of COMMON, and of all others as ''; at most one row each comes to the driver."""
    group = F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise(F.lit(""))
    good = measured.where(~F.col("base_failed"))
    n = {"class_shares": len(CLASSES) + 2, "word_shares": len(next(iter(COMMON.values()))) + 1}
    means = [F.avg(F.when(F.col(guard) >= least, F.element_at(c, i + 1))).alias(f"{c}{i}") for c, guard, least in (("class_shares", "chars", LEAST_CHARS), ("word_shares", "n_words", LEAST_FOR_WORDS)) for i in range(n[c])]
    out = {}
    for r in good.groupBy(group.alias("g")).agg(*means).collect():
        one, two = ([r[f"{c}{i}"] for i in range(n[c])] for c in n)
        out[r["g"]] = (None if None in one else one, None if None in two else two)
    return out


def assess(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, distances and kept for every row of docs(doc_id, text, lang).

    Null text is empty: no words, so it fails the base rule. A null or unknown language is
    compared by character classes only, with the documents of all such languages. Short
    documents (under LEAST_CHARS characters, or LEAST_FOR_WORDS words for common words)
    have null distances and pass. Repeated rows give equal rows; extra columns are ignored;
    an empty table gives an empty table.
    """
    c = counts(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = keep(c.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", failed.alias("base_failed"),
        _shares(F.col("classes"), F.col("chars").cast("double")).alias("class_shares"),
        _shares(_word_counts(F.col("lang"), F.col("common")), F.col("n_words").cast("double")).alias("word_shares"),
    ), "quality")
    group = F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise(F.lit(""))
    refs = _references(measured)
    near = {c: F.lit(None).cast("array<double>") for c in ("class_shares", "word_shares")}
    for i, c in enumerate(near):
        for g, pair in sorted(refs.items()):
            if pair[i]:
                near[c] = F.when(group == g, F.array(*map(F.lit, pair[i]))).otherwise(near[c])
    far = {
        "class_distance": F.when(F.col("chars") >= LEAST_CHARS, js_distance(F.col("class_shares"), near["class_shares"])),
        "word_distance": F.when(F.col("n_words") >= LEAST_FOR_WORDS, js_distance(F.col("word_shares"), near["word_shares"])),
    }
    seen = measured.select("*", *[v.alias(k) for k, v in far.items()])
    unlike = F.coalesce(F.col("class_distance") > FAR_CLASSES, F.lit(False)) | F.coalesce(F.col("word_distance") > FAR_WORDS, F.lit(False))
    return seen.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~unlike).alias("kept"), "class_distance", "word_distance")


def query(spark, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))

