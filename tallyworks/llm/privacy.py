"""Operator 1: personal data, by forms and by bootstrapped contexts.

Base entities (e-mail and IP addresses, card and telephone numbers) are seeds. The words
before a seed are a lexical pattern. Pattern-instance graphs are scored in rounds: a
pattern's confidence is the share of its distinct instances that are known entities of
one kind, an unknown instance's score is the chance that one of its patterns is right,
and instances above a bound count as known in the next round. What confident patterns
introduce and what looks like an identifier is marked as an entity of that kind.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, table, text_of
from .spans import Form, find, of_kind, tagged, written

# The kinds in order and the patterns of the base entities. Possessive loops
# and starts at a run's beginning change nothing in the matches, but bound the work.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"

#: Words with a digit or an at sign: what may be an identifier that no form describes.
CANDIDATE = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
#: An identifier has so many digits, or an at sign between characters.
DIGITS = 6
#: Words of a pattern; characters before an entity in which they are looked for.
CONTEXT, NEAR = 2, 80
#: Least distinct known instances of a pattern, least confidence, least score, rounds.
SUPPORT, CONFIDENT, SCORE, ROUNDS = 3, 0.6, 0.8, 3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, v: a + v) % 10 == 0


def _card(m: Column) -> Column:
    n = F.length(_digits(m))
    return F.when((n >= 12) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def context(piece: Column) -> Column:
    """The last CONTEXT words of the text before an entity, folded to letters; null if one has none."""
    words = F.regexp_extract(F.substring(piece, -NEAR, NEAR), r"(?<![^ \t-\r])([^ \t-\r]++[ \t-\r]++[^ \t-\r]++)[ \t-\r]*+[^\p{L}\p{Nd} \t-\r]*+$", 1)
    folded = F.transform(F.split(words, r"[ \t-\r]++"), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", ""))
    return F.when((words != "") & F.forall(folded, lambda w: w != ""), F.array_join(folded, " "))


def findings(docs: DataFrame) -> DataFrame:
    """A durable table of docs' rows: row, doc_id, base (s, k, e), seeds (k, c, v), tokens (s, e, c, v)."""
    seen = lambda p, m: {"c": context(p), "v": F.lower(m)}
    digit = lambda t: t.rlike("[0-9]")
    at = lambda t: F.contains(t, F.lit("@"))
    forms = {
        "k0": Form(EMAIL, lambda m: F.lit(True), at, seen),
        "k1": Form(IP, lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), lambda t: t.rlike("[0-9][.][0-9]"), seen),
        "k2": Form(CARD, _card, digit, seen),
        "k3": Form(PHONE, _phone, lambda t: F.contains(t, F.lit("+")), seen),
        "c": Form(CANDIDATE, lambda m: (F.length(_digits(m)) >= DIGITS) | m.rlike("[^@]@[^@]"), lambda t: digit(t) | at(t), seen),
    }
    found = find(docs.select("doc_id", text_of(docs).alias("text")), "text", forms)
    base = F.sort_array(F.concat(*[tagged(F.col(f"k{i}"), i) for i in range(4)]))
    seed = lambda i: lambda x: F.struct(F.lit(i).alias("k"), x["c"].alias("c"), x["v"].alias("v"))
    seeds = F.concat(*[F.transform(f"k{i}", seed(i)) for i in range(4)])
    based = found.select("doc_id", base.alias("base"), F.filter(seeds, lambda x: x["c"].isNotNull()).alias("seeds"), "c")
    free = F.filter("c", lambda x: x["c"].isNotNull() & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return keep(based.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "seeds", free.alias("tokens")), "privacy")


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(c, v, k): pairs of context and unknown instance that the rounds accept as kind k."""
    seeds = found.select(F.explode("seeds").alias("x")).select("x.c", "x.v", "x.k")
    tokens = found.select(F.explode("tokens").alias("x")).select("x.c", "x.v", F.lit(None).cast("int").alias("k"))
    # the graph: distinct edges of pattern and instance, with the instance's kind where it is known
    graph = keep(seeds.unionByName(tokens).groupBy("c", "v").agg(F.min("k").alias("k")), "graph")
    accepted = None
    for _ in range(rounds):
        known = graph if accepted is None else graph.join(accepted.select("v", F.col("k").alias("new")), "v", "left").select("c", "v", F.coalesce("k", "new").alias("k"))
        totals = known.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("k") == i, 1)).alias(f"n{i}") for i in range(4)])
        best = F.greatest(*[F.struct(F.col(f"n{i}").alias("hits"), F.lit(i).alias("k")) for i in range(4)])
        patterns = totals.select("c", "n", best.alias("b")).where(F.col("b.hits") >= SUPPORT).select("c", F.col("b.k").alias("pk"), (F.col("b.hits") / (F.col("n") + 1)).alias("conf")).where(F.col("conf") >= CONFIDENT)
        scored = graph.where("k is null").join(patterns, "c").groupBy("v", "pk").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")).where(F.col("score") >= SCORE)
        accepted = keep(scored.groupBy("v").agg(F.max_by("pk", F.struct("score", -F.col("pk"))).alias("k")), "accepted")
        if accepted.isEmpty():
            break
    return graph.where("k is null").select("c", "v").join(accepted, "v").join(patterns.select("c", "pk"), "c").where("k = pk").select("c", "v", "k")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (sorted arrays of (s, k, e), k an index of KINDS) for every row of docs(doc_id, text).

    Null text is empty and has no spans; repeated rows give equal rows; an entity at the
    start of a text has no context, so it is found by its form only; extra columns are
    ignored; an empty table gives an empty table.
    """
    found = findings(docs)
    new = bootstrap(found)
    places = found.select("row", F.explode("tokens").alias("x")).select("row", "x.s", "x.e", "x.c", "x.v")
    added = places.join(new, ["c", "v"]).groupBy("row").agg(F.collect_list(F.struct("s", "k", "e")).alias("more"))
    joined = found.join(added, "row", "left")
    none = F.slice("base", 1, 0)
    return joined.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("more", none))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[of_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"),
        written(F.col("spans"), KINDS).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(personal_data(table(spark, sf_dir, "documents")))
