"""Operator 5: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; labelled texts, whatever their label, serve as
unlabelled text. A linear model over words, word beginnings and word ends is fitted with
numpy to the non-negative risk ``prior * R+(P) + max(0, R-(U) - prior * R-(P))``, where
``prior`` is the toxic share among the labels learned from. Only the text is an input.

Every labelled document that may be learned from is, each once. Tasks count features and
reduce a text to those of the model; texts that have the same ones are one row with their
numbers, most having none. One task fits these rows, so that the driver sees weights only.
Scoring covers every row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import done_with, keep, small_batches, table, text_of

#: A feature occurs in so many positives at least, so many times as often as in other text by
#: the prior-corrected estimate, and so many standard errors from no difference.
LEAST, LIFT, SURE = 4, 4.0, 2.7
STEPS, RATE, DECAY = 500, 0.05, 1e-5
TOXIC = 0.7
#: Words remembered by a worker with their weights; words with their features, and features that a task counts before it passes them on.
MEMO, WORDS, HELD = 400_000, 20_000, 100_000
#: Features of rows that a step of the fit handles at a time, about.
CHUNK = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, its beginnings and its ends."""
    n = len(word)
    return [f"={word}", *(f"^{word[:k]}" for k in range(4, min(n, 9))), *(f"${word[-k:]}" for k in range(4, min(n, 9)))]


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _remainder(mod: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


class Model:
    """Weights of features, and a bias; a text's score is the logistic of the sum over its distinct words."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    def word(self, w: str) -> float:
        if w not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            get = self.weights.get
            self.memo[w] = sum(get(f, 0.0) for f in features(w))
        return self.memo[w]

    def score(self, text: str) -> float:
        z = self.bias + sum(map(self.word, _words(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "memo": {}}


def fit(chunks: list[tuple[np.ndarray, np.ndarray, int]], p: np.ndarray, u: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk's minimum.

    Row i stands for p[i] positives and u[i] unlabelled texts with the same features; a text
    may be both. Of a chunk (d, f, n) of n rows row d[i] has feature f[i], perhaps more than once;
    its rows follow those of the chunk before.
    """
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    ends = np.cumsum([0, *(n for _, _, n in chunks)])
    n_p, n_u = p.sum(), u.sum()
    for t in range(1, STEPS + 1):
        z = np.full(len(p), bias)
        for (d, f, _), lo, hi in zip(chunks, ends, ends[1:], strict=False):
            z[lo:hi] += np.bincount(d, w[f], hi - lo)
        z = np.clip(z, -30, 30)
        s = 1 / (1 + np.exp(-z))
        # logistic losses: log(1 + exp(-z)) for label 1, log(1 + exp(z)) for label 0
        negative = np.logaddexp(0, z)
        rest = (u * negative).sum() / n_u - prior * (p * negative).sum() / n_p
        up = p * prior * (s - 1) / n_p
        down = u * s / n_u - p * prior * s / n_p
        g = up + down if rest >= 0 else -down
        sums = DECAY * w
        for (d, f, _), lo in zip(chunks, ends, strict=False):
            sums += np.bincount(f, g[lo + d], size)
        grad = np.concatenate((sums, [g.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feature counts of a task: rows (f, p, u), p toxic ones of u texts having it."""
    memo: dict[str, list[str]] = {}
    toxic, every = Counter(), Counter()

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"f": pd.Series(list(every), dtype=object), "p": pd.Series([toxic[f] for f in every], dtype="int64"), "u": pd.Series(list(every.values()), dtype="int64")})

    for pdf in batches:
        for p, t in zip(pdf["p"].tolist(), pdf["text"], strict=True):
            own: set[str] = set()
            for w in _words(t):
                if w not in memo:
                    if len(memo) >= WORDS:
                        memo.clear()
                    memo[w] = features(w)
                own.update(memo[w])
            every.update(own)
            if p:
                toxic.update(own)
        if len(every) > HELD:
            yield rows()
            toxic.clear()
            every.clear()
    yield rows()


def learn(docs: DataFrame, labels: DataFrame, excluded: Column | None = None) -> Model:
    """A model from labels(doc_id, toxic) of docs(doc_id, text); rows where ``excluded`` holds are left out.

    Labels that are null, or of unknown documents, are left out. Without both a toxic and
    another labelled text the model scores every text 0.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    texts = docs.select("doc_id", text_of(docs).alias("text"))
    if excluded is not None:
        marked, texts = marked.where(~excluded), texts.where(~excluded)
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("p"))
    share = marked.agg(F.avg("p")).first()[0]
    # of a repeated id one text
    once = texts.join(marked, "doc_id").groupBy("doc_id").agg(F.first("p").alias("p"), F.min_by("text", F.xxhash64("text")).alias("text"))
    known = keep(once.select("p", "text"), "toxicity")
    n_p, n_u = known.agg(F.coalesce(F.sum("p"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_p or not n_u or share >= 1:
        done_with(known)
        return Model({}, -30.0)
    prior = float(np.clip(share, 0.001, 0.9))
    small_batches(docs.sparkSession)
    spread = known.repartition(max(12, known.sparkSession.sparkContext.defaultParallelism))
    counted = spread.mapInPandas(_counts, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST)
    # what a feature's rate would be in text that isn't toxic, never under half a text
    other = F.greatest(F.col("u") / n_u - prior * F.col("p") / n_p, F.lit(0.5 / n_u))
    lift = F.col("p") / n_p / other
    sure = F.log(lift) / F.sqrt(1 / F.col("p") + 1 / (other * n_u))
    strong = counted.select("f", lift.alias("lift"), sure.alias("sure")).where((F.col("lift") >= LIFT) & (F.col("sure") >= SURE))
    names = [r["f"] for r in strong.orderBy(F.desc("sure"), "f").collect()]  # the features of the model
    number = {f: i for i, f in enumerate(names)}

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple[int, ...]] = {}
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                own: list[int] = []
                for w in _words(t):
                    if w not in memo:
                        if len(memo) >= WORDS:
                            memo.clear()
                        memo[w] = tuple(number[f] for f in features(w) if f in number)
                    own += memo[w]
                out.append(sorted(own))
            yield pd.DataFrame({"p": pdf["p"], "x": out})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks, held, p, u = [], [], [], []

        def close() -> None:
            lengths = [len(x) for x in held]
            d, f = np.repeat(np.arange(len(held), dtype=np.int32), lengths), np.concatenate([np.zeros(0, np.int32), *held])
            chunks.append((d, f, len(held)))
            held.clear()

        for pdf in batches:
            held += [np.asarray(x, np.int32) for x in pdf["x"]]
            p.append(pdf["p"].to_numpy(np.float64))
            u.append(pdf["u"].to_numpy(np.float64))
            if sum(map(len, held)) > CHUNK:
                close()
        close()
        w, bias = fit(chunks, np.concatenate([np.zeros(0), *p]), np.concatenate([np.zeros(0), *u]), len(number), prior)
        yield pd.DataFrame({"i": np.arange(-1, len(w)), "w": np.append(bias, w)})

    alike = spread.mapInPandas(rows, "p int, x array<int>").groupBy("x").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("u"))
    # sorted, so that the order of sums and with it the fit is the same each time
    one = alike.repartition(1).sortWithinPartitions("x")
    found = {r["i"]: r["w"] for r in one.mapInPandas(fitted, "i long, w double").collect()}
    done_with(known)
    return Model({f: found[i] for i, f in enumerate(names) if found[i]}, found[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs(doc_id, text), null text as empty."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.select("doc_id", scores(text_of(docs)).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text).

    Labels are learned only from ids whose crc32 mod 3 is not 1; held_out marks the others.
    Null text is empty and gets a score too; repeated rows give equal rows; a null id is
    scored like any other; extra columns are ignored; an empty table gives an empty table.
    """
    model = learn(docs, labels, _remainder(3) == 1)
    scored = score(docs, model)
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
