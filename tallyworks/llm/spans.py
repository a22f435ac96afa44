"""Leftmost non-overlapping matches with their places, in Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Form:
    """A pattern whose matches are spans: where to look, which matches to take, what to add to a span."""

    def __init__(self, pattern: str, accept: Callable[[Column], Column], hint: Callable[[Column], Column] | None = None, extra: Callable[[Column, Column], dict[str, Column]] | None = None):
        self.pattern, self.accept, self.hint, self.extra = pattern, accept, hint, extra


def find(df: DataFrame, text: str, forms: dict[str, Form]) -> DataFrame:
    """df without its text, and for each form an array of structs (s, e, ...) of the accepted matches.

    s and e are code points, e exclusive. Matches and the pieces between them come from one
    pattern, so the places are sums of lengths. ``hint(text)`` is a cheap condition without
    which no match is possible; ``extra(piece, match)`` gives further fields, piece being
    the text since the match before. A match that is not accepted is dropped, with no second
    try inside it. Patterns must not match the empty string. Each of the three steps is its
    own projection, so a text is searched once, and cut into pieces only if it has matches.
    """
    kept = [c for c in df.columns if c != text]
    t, none = F.col(text), F.array().cast("array<string>")
    look = lambda f: F.regexp_extract_all(t, F.lit(f.pattern), F.lit(0))
    found = df.select(*df.columns, *[(F.when(f.hint(t), look(f)).otherwise(none) if f.hint else look(f)).alias(f"{k}__m") for k, f in forms.items()])
    cut = found.select(*kept, *[f"{k}__m" for k in forms], *[F.when(F.size(f"{k}__m") > 0, F.split(t, f.pattern, -1)).otherwise(none).alias(f"{k}__p") for k, f in forms.items()])
    return cut.select(*kept, *[_fold(F.col(f"{k}__m"), F.col(f"{k}__p"), f).alias(k) for k, f in forms.items()])


def _fold(found: Column, pieces: Column, form: Form) -> Column:
    pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(p.alias("p"), m.alias("m")))

    def item(at: Column, x: Column) -> Column:
        s = at + F.length(x["p"])
        more = form.extra(x["p"], x["m"]) if form.extra else {}
        return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), *[c.alias(k) for k, c in more.items()])

    # an empty array of the right type
    none = F.slice(F.transform(pairs, lambda x: item(F.lit(0), x)), 1, 0)
    return F.when(F.size(found) > 0, F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.when(form.accept(x["m"]), F.concat(acc["out"], F.array(item(acc["at"], x)))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )).otherwise(none)


def tagged(spans: Column, order: int) -> Column:
    """Structs (s, k, e) of a kind: sorting them sorts by start, then kind as listed."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e")))


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted (s, k, e) structs, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def of_kind(spans: Column, order: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["k"] == order)).cast("long")
