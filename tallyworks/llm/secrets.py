"""Operator 7: secrets, by named forms and by a battery of randomness tests.

Base forms (assignments, access keys, hex strings) are pattern matches. The battery takes
the other long tokens of letters and digits, infers each one's encoding and asks whether
it is random text in that encoding:

- runs of character classes give the p-value against ordinary text, where letters and
  digits keep together (at most ``TEXT_SWITCH`` of the neighbours differ in class);
- chi-squared uniformity over the encoding's alphabet and the serial correlation of the
  symbols must not contradict randomness.

A Benjamini-Hochberg step over all tokens of the table, for each band of lengths by
itself, bounds the share of false finds. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, table, text_of
from .spans import Form, find, of_kind, tagged, written

# The kinds in order and the patterns of the base forms.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"

#: Tokens that the battery looks at: runs of base-64 characters of this length at least, with letters and digits.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
#: Share of neighbours of different class in ordinary text with digits; false discovery rate; bounds of the other tests, in standard deviations.
TEXT_SWITCH, FDR, BOUND = 0.2, 0.01, 3.3
#: Length bands of the false-discovery control; p-values are kept as tenths of -log10, up to this.
BANDS, MOST = (32, 64), 300


def _p10(z: Column) -> Column:
    """Tenths of -log10 of the normal upper tail at z, rounded down: p about exp(-0.717 z - 0.416 z^2) / 2."""
    logp = (F.lit(0.717) * z + F.lit(0.416) * z * z + F.lit(0.6931)) / F.lit(2.302585)
    return F.when(z <= 0, F.lit(0)).otherwise(F.least(F.floor(logp * 10).cast("int"), F.lit(MOST)))


def battery(token: Column) -> Column:
    """Struct (band, q, random) of a token: its length band, tenths of -log10 p against text, and whether the other tests allow randomness."""
    n = F.length(token).cast("double")
    hexlike = token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    base32 = token.rlike("^[A-Z2-7]+$")
    k = F.when(hexlike, F.lit(16.0)).when(base32, F.lit(32.0)).otherwise(F.lit(64.0))
    alphabet = F.when(hexlike, F.lit("0123456789abcdef")).when(base32, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    shaped = F.translate(F.when(hexlike, F.lower(token)).otherwise(token), "-_", "+/")
    symbols = F.transform(F.filter(F.split(shaped, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double") - 1)
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[^A-Za-z0-9]", "S"), "[a-z]", "l"), "[A-Z]", "U"), "[0-9]", "d")
    switches = F.length(F.regexp_replace(kind, r"(.)\1++", "$1")) - 1
    z = (switches - TEXT_SWITCH * (n - 1)) / F.sqrt(TEXT_SWITCH * (1 - TEXT_SWITCH) * (n - 1))
    squares = F.aggregate(F.array_distinct(symbols), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(symbols, lambda w: w == v)).cast("double"), F.lit(2.0)))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1))
    mean = F.aggregate(symbols, F.lit(0.0), lambda a, v: a + v) / n
    spread = F.aggregate(symbols, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    after = F.slice(symbols, 2, F.size(symbols) - 1)
    before = F.slice(symbols, 1, F.size(symbols) - 1)
    serial = F.aggregate(F.zip_with(before, after, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, v: a + v)
    correlation = F.when(spread > 0, serial / spread).otherwise(F.lit(1.0)) * F.sqrt(n)
    band = F.when(n < BANDS[0], F.lit(0)).when(n < BANDS[1], F.lit(1)).otherwise(F.lit(2))
    return F.struct(band.alias("band"), _p10(z).alias("q"), ((chi <= BOUND) & (F.abs(correlation) <= BOUND)).alias("random"))


def _searched(rows: DataFrame) -> DataFrame:
    """rows' columns but text, with base: sorted (s, k, e), and tokens: (s, e, t), t the battery's struct."""
    forms = {
        "a__f": Form(ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12, lambda t: t.rlike("[:=]")),
        "k__f": Form(ACCESS, lambda m: F.length(m) >= 18, lambda t: F.contains(t, F.lit("AKIA"))),
        "h__f": Form(HEX, lambda m: F.length(m) >= 16),
        "c__f": Form(CANDIDATE, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), lambda t: t.rlike("[0-9]"), lambda p, m: {"m": m}),
    }
    kept = [c for c in rows.columns if c != "text"]
    based = find(rows, "text", forms).select(*kept, F.sort_array(F.concat(*[tagged(F.col(f), i) for i, f in enumerate(("a__f", "k__f", "h__f"))])).alias("base"), "c__f")
    free = F.filter("c__f", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return based.select(*kept, "base", F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["m"]).alias("t"))).alias("tokens"))


def findings(docs: DataFrame) -> DataFrame:
    """A durable table of docs' doc_id with base and tokens, a row for each row."""
    return keep(_searched(docs.select("doc_id", text_of(docs).alias("text"))), "secrets")


def _added(least: dict[int, int]) -> Column:
    """The tokens that the cuts accept, as spans of the last kind."""
    level = lambda t: F.coalesce(*[F.when(t["band"] == b, F.lit(q)) for b, q in sorted(least.items())], F.lit(MOST + 1))
    return tagged(F.filter("tokens", lambda x: x["t"]["random"] & (x["t"]["q"] >= level(x["t"]))), 3)


def _located(rows: DataFrame, least: dict[int, int]) -> DataFrame:
    """rows' columns but text, with base and spans."""
    found = _searched(rows)
    return found.select(*[c for c in found.columns if c != "tokens"], F.sort_array(F.concat("base", _added(least))).alias("spans"))


def cuts(found: DataFrame) -> dict[int, int]:
    """For each length band the least q that the false-discovery step accepts; at most one row a band reaches the driver."""
    counts = found.select(F.explode("tokens.t").alias("t")).groupBy("t.band", "t.q").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("q"))
    ranked = counts.select("band", "q", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("band")).alias("m"))
    # q is rounded down, so 10^(-q/10) is no less than the p-value
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("q") / 10) <= FDR * F.col("rank") / F.col("m"))
    return {r["band"]: r["q"] for r in passed.groupBy("band").agg(F.min("q").alias("q")).collect()}


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (both sorted arrays of (s, k, e), k an index of KINDS) for every row of docs(doc_id, text).

    Null text is empty and has no spans; repeated rows give equal rows; a token equal to a
    base span or overlapping one is not looked at again; extra columns are ignored; an
    empty table gives an empty table.
    """
    found = findings(docs)
    return found.select("doc_id", "base", F.sort_array(F.concat("base", _added(cuts(found)))).alias("spans"))


MASK = "[SECRET]"


def _mask(text: Column, spans: Column) -> Column:
    """The text with each union of overlapping spans replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        more = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(MASK)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, more).otherwise(acc["parts"]).alias("parts"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def masked(docs: DataFrame) -> DataFrame:
    """docs with its columns, every secret of text replaced by MASK and n_chars, if there is one, the new text's length.

    Texts without secrets, null ones too, and their n_chars stay as they are. docs is read
    twice, so it must give the same rows both times, as a table does.
    """
    least = cuts(findings(docs))
    spans = _located(docs.select(F.struct("*").alias("row"), text_of(docs).alias("text")), least)
    changed = F.size("spans") > 0
    new = F.when(changed, _mask(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    fields = {"text": new} | ({"n_chars": F.when(changed, F.length(new)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return spans.select(*[fields[c].alias(c) if c in fields else F.col("row")[c].alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[of_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"),
        written(F.col("spans"), KINDS).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(secrets(table(spark, sf_dir, "documents")))
