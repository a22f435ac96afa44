"""Operator 2: benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors of hashed words, projected on the leading right singular vectors
of the matrix of all passages: those of the benchmark, and those of the documents through a
linear sketch. One pass over all documents counts the documents that have each word, and adds
each passage, under a sign of its own, to one of SKETCH rows, whose products are in the mean
those of the passages themselves; none is left out. One task finds the vectors of the sketch
and the benchmark's passages. Then each document is read once: prefix sums of its projected
words give the vectors of all its windows, their cosines with the benchmark's passages the
candidates, and a candidate is checked by the longest common subsequence of words, with a
check of the item's answer where the words differ much.

The benchmark is the query set. It is cut into blocks of about ITEMS passages, as many as
LATENT dimensions hold apart; each block has a space of its own and is searched against
all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, keep, small_batches, table, text_of

#: Hashed dimensions, latent dimensions, rows of the sketch, passages of a block: more of them need more dimensions.
DIMENSIONS, LATENT, SKETCH, ITEMS = 1 << 15, 96, 512, 500
#: What all passages of the documents weigh together, as passages, so that the benchmark's don't drown in a large corpus.
DOCUMENTS = 4_000
#: Weight of a benchmark passage beside a document's in the matrix.
QUERY = 10.0
#: Words of a query passage at most, and (longest passage, window, stride): each place of a passage lies whole in a window.
PASSAGE, SCALES = 64, ((24, 32, 8), (48, 64, 16), (64, 96, 32))
#: Least cosine of a candidate; least share of an item's words in the common subsequence; the share from which the answer is not asked for.
COSINE, SHARED, SURE = 0.35, 0.6, 0.8
#: Longest word, in bytes, whose checksum is found together with those of other words.
LETTERS = 64
#: Words handled at a time: a multiple of every stride.
TOKENS = 49_152
#: Every stride is a multiple of this one.
STRIDE = 8
# punctuation becomes blanks, A-Z small
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def answer(text: str) -> list[bytes]:
    """Words of the item's answer: what follows its last 'answer:' or question mark; none if neither is there."""
    low = text.lower()
    at = max(low.rfind("answer:") + 7 if "answer:" in low else -1, low.rfind("?") + 1 if "?" in low else -1)
    return tokens(text[at:].encode()) if at > 0 else []


def parts(words: list[bytes]) -> list[list[bytes]]:
    """The passages of an item, of nearly equal length."""
    n = -(-len(words) // PASSAGE)
    return [words[j * len(words) // n : (j + 1) * len(words) // n] for j in range(n)]


class Hasher(dict):
    """Words to dimensions, remembered; for few words, while those of documents go through dimensions()."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        i = self[word] = zlib.crc32(word) % DIMENSIONS
        return i

    def __call__(self, words: Collection[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The folded texts in one string, the places there where the words of all texts begin and end, and the texts' numbers of words; the words are those of tokens()."""
    folded = b" ".join([b"", *texts, b""]).translate(_FOLD)
    blank = np.frombuffer(folded, np.uint8) == 32
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2].copy(), edges[1::2].copy()
    return folded, starts, ends, np.diff(np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])))


def _checksums() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32, modulo DIMENSIONS, of zeros only, by their number; and what a byte adds to it, by the number of bytes after it."""
    zeros = np.array([zlib.crc32(bytes(n)) % DIMENSIONS for n in range(LETTERS + 1)], np.uint16)
    return zeros, np.array([[(zlib.crc32(bytes([c]) + bytes(n)) ^ zlib.crc32(bytes(n + 1))) % DIMENSIONS for c in range(256)] for n in range(LETTERS)], np.uint16)


def dimensions(folded: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The dimensions of the words of a folded string, those of Hasher: a checksum is the exclusive or of what its bytes add, so a step takes the words' last letters, the next one those before, and so on."""
    letters, (zeros, adds), out = np.frombuffer(folded, np.uint8), _CHECKSUMS, np.empty(len(starts), np.int64)
    for low in range(0, len(starts), 16_384):
        s, e = starts[low : low + 16_384], ends[low : low + 16_384]
        length = np.minimum(e - s, LETTERS)
        order = np.argsort((LETTERS - length).astype(np.uint8), kind="stable")  # longest first
        x, last = zeros[length[order]], e[order] - 1
        for n, some in enumerate(len(s) - np.cumsum(np.bincount(length))[:-1]):
            x[:some] ^= adds[n].take(letters.take(last[:some] - n))
        own = out[low : low + 16_384]
        own[order] = x
        for j in np.flatnonzero(e - s > LETTERS).tolist():
            own[j] = zlib.crc32(folded[s[j] : e[j]]) % DIMENSIONS
    return out


_CHECKSUMS = _checksums()


def subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & places.get(w, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _signs(rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of texts its passage's row of the sketch and sign, from the texts' hashes and numbers of words."""
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    z = np.repeat(rows.view(np.uint64), lengths) + (place // PASSAGE).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(32)
    return (z % np.uint64(SKETCH)).astype(np.int64), 1 - 2 * (z >> np.uint64(63)).astype(np.float32)


def counted(docs: DataFrame) -> DataFrame:
    """Rows (row, v) of DIMENSIONS numbers: the sketch of all passages, as 4-byte floats, and in row -1 how many documents have each dimension, and how many there are, as longs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMENSIONS + 1, np.int64), 0
        sketch = np.zeros(SKETCH * DIMENSIONS, np.float32)
        for pdf in batches:
            *words, lengths = words_of(pdf["text"].tolist())
            ids = dimensions(*words)
            for i in np.split(ids, np.cumsum(lengths)[:-1]):
                df[i] += 1  # a place counts once, however often it is there
            n += len(lengths)
            at, sign = _signs(pdf["h"].to_numpy(), lengths)
            np.add.at(sketch, at * DIMENSIONS + ids, sign)
        df[-1] = n
        yield pd.DataFrame({"row": [-1], "i": [None], "v": [df.astype("<i8").tobytes()]})
        for low in range(0, SKETCH, 32):
            own = sketch[low * DIMENSIONS : (low + 32) * DIMENSIONS].reshape(-1, DIMENSIONS)
            some = [np.flatnonzero(x) for x in own]
            yield pd.DataFrame({"row": range(low, low + len(own)), "i": [i.astype("<u2").tobytes() for i in some], "v": [x[i].astype("<f4").tobytes() for x, i in zip(own, some, strict=True)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the tasks' rows, sorted by row."""
        row, total = None, None
        for pdf in batches:
            for r, i, v in zip(pdf["row"].tolist(), pdf["i"], pdf["v"], strict=True):
                if r != row:
                    if total is not None:
                        yield pd.DataFrame({"row": [row], "v": [total.tobytes()]})
                    row, total = r, np.zeros(DIMENSIONS + 1, "<i8") if r < 0 else np.zeros(DIMENSIONS, "<f4")
                if r < 0:
                    total += np.frombuffer(v, "<i8")
                else:
                    total[np.frombuffer(i, "<u2")] += np.frombuffer(v, "<f4")
        if total is not None:
            yield pd.DataFrame({"row": [row], "v": [total.tobytes()]})

    texts = docs.select(text_of(docs).cast("binary").alias("text"), F.xxhash64("doc_id", text_of(docs)).alias("h"))
    return texts.mapInPandas(count, "row int, i binary, v binary").repartition("row").sortWithinPartitions("row").mapInPandas(add, "row int, v binary")


def _weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, next to nothing for words that a fifth of the documents have: else what all texts share fills the leading directions."""
    return np.maximum(np.log((n + 1) / (df + 1)) - min(np.log(5), np.log(n + 1) / 2), 0.01)


def latent(passages: DataFrame, weights: np.ndarray, size: int = LATENT) -> np.ndarray:
    """Leading right singular vectors, as columns, of the TF-IDF matrix of a block's passages(text) and the rows (v) of the sketch.

    The matrix has a fixed number of rows, about, and one task holds it; the driver gets the vectors.
    """

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed, own, w = Hasher(), [], weights.astype(np.float32)
        sketch = []
        for pdf in batches:
            for text, v in zip(pdf["text"], pdf["v"], strict=True):
                if v is not None:
                    sketch.append(np.frombuffer(v, "<f4") * w)
                    continue
                i = hashed(tokens(text))
                if len(i):
                    x = np.bincount(i, weights[i], DIMENSIONS).astype(np.float32)
                    own.append(x / max(np.sqrt((weights[i] ** 2).sum()), 1e-9) * QUERY)
        energy = sum(float(np.dot(x, x)) for x in sketch)
        for x in sketch:
            x *= np.float32(np.sqrt(DOCUMENTS / max(energy, 1e-9)))
        a = np.stack(sketch + own) if sketch or own else np.zeros((1, DIMENSIONS), np.float32)
        del sketch, own
        values, vectors = np.linalg.eigh((a @ a.T).astype(np.float64))
        some = np.flatnonzero(values > max(values[-1], 1e-9) * 1e-7)[::-1][:size]
        out = np.zeros((DIMENSIONS, size), np.float32)
        out[:, : len(some)] = a.T @ (vectors[:, some] / np.sqrt(values[some])).astype(np.float32)
        for i in range(0, DIMENSIONS, 2048):  # small rows, so that the driver needs no large buffers
            yield pd.DataFrame({"i": [i], "m": [out[i : i + 2048].astype("<f4").tobytes()]})

    out = np.zeros((DIMENSIONS, size), np.float32)
    for r in passages.repartition(1).sortWithinPartitions("n").mapInPandas(fit, "i int, m binary").toLocalIterator():
        out[r["i"] : r["i"] + 2048] = np.frombuffer(r["m"], "<f4").reshape(-1, size)
    return out


class Index:
    """A block of items, their passages in latent space by scale, and the check of a candidate."""

    def __init__(self, items: list[tuple[int, str]], space: np.ndarray):
        # a last row of zeros stands for the places after a text's end
        self.space, self.ids = np.concatenate((space, np.zeros((1, space.shape[1]), np.float32))), [i for i, _ in items]
        self.words = [tokens(t.encode()) for _, t in items]
        self.counts = [Counter(w) for w in self.words]
        self.answers = [set(answer(t)) for _, t in items]
        hashed, self.owner, self.queries = Hasher(), [], []
        for low, (longest, _, _) in zip((0, *(s[0] for s in SCALES)), SCALES, strict=False):
            owner, rows = [], []
            for k, w in enumerate(self.words):
                for part in parts(w):
                    if low < len(part) <= longest:
                        owner.append(k)
                        rows.append(space[hashed(part)].sum(0))
            m = np.array(rows, np.float32).reshape(-1, space.shape[1])
            self.owner.append(np.array(owner, np.int64))
            self.queries.append(np.ascontiguousarray((m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)).T))
        # how many of a window's words an item must have at all; long items are checked whole
        self.least = np.array([np.ceil(SHARED * len(w)) if len(w) <= PASSAGE else 0 for w in self.words])

    def __setstate__(self, state: dict) -> None:
        """As it was, and which dimensions each item has: made anew by each worker, as it is larger than what it is made of."""
        self.__dict__ = state
        hashed = Hasher()
        own = [hashed(w) for w in self.words]
        # dimensions that no item has are column 0
        known = np.unique(np.concatenate([*own, np.zeros(0, np.int64)]))
        self.column = np.zeros(DIMENSIONS + 1, np.int64)
        self.column[known] = np.arange(1, len(known) + 1)
        self.has = np.zeros((len(own), len(known) + 1), np.uint8)
        for k, i in enumerate(own):
            self.has[k, self.column[i]] = 1

    def search(self, lengths: np.ndarray, dims: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text number, item number, start, end) of the windows near a passage of an item that hold enough of its words; from the texts' numbers of words and the dimensions of their words."""
        padded = -(-lengths // STRIDE) * STRIDE
        first = np.concatenate(([0], np.cumsum(padded)))
        ids = np.full(first[-1] + max(w for _, w, _ in SCALES), DIMENSIONS, np.int64)
        ids[np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())] = dims
        cells = ids[: first[-1]].reshape(-1, STRIDE)
        sums = np.zeros((len(cells) + 1, self.space.shape[1]), np.float32)
        for i in range(0, len(cells), 256):
            for j in range(STRIDE):
                sums[i + 1 : i + 257] += self.space.take(cells[i : i + 256, j], 0, mode="clip")
        np.cumsum(sums, axis=0, out=sums)
        column = self.column[ids]
        # how many words before each cell are in any item
        known = np.concatenate(([0], np.cumsum((column[: first[-1]] > 0).reshape(-1, STRIDE).sum(1))))
        first //= STRIDE
        out = []
        for (_, window, stride), owner, q in zip(SCALES, self.owner, self.queries, strict=True):
            if not len(owner):
                continue
            n = np.maximum(1, -(-(lengths - window) // stride) + 1) * (lengths > 0)
            doc = np.repeat(np.arange(len(lengths)), n)
            s = (np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)) * stride
            e = np.minimum(s + window, lengths[doc])
            low, high, near = first[doc] + s // STRIDE, first[doc] - -e // STRIDE, []
            for i in range(0, len(doc), 1024):
                v = sums.take(high[i : i + 1024], 0, mode="clip")
                v -= sums.take(low[i : i + 1024], 0, mode="clip")
                v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)[:, None]
                near.append(np.flatnonzero(v @ q >= COSINE) + i * len(owner))
            w, k = np.divmod(np.concatenate([*near, np.zeros(0, np.int64)]), len(owner))
            k = owner[k]
            # no common subsequence is longer than the count of words that are in any item, or in the item
            some = known[high[w]] - known[low[w]] >= self.least[k]
            w, k = w[some], k[some]
            for i in range(0, len(w), 16_384):
                own, item = w[i : i + 16_384], k[i : i + 16_384]
                at, row, there = low[own] * STRIDE, item * self.has.shape[1], np.zeros(len(own), np.int64)
                for j in range(window):
                    there += self.has.take(row + column.take(at + j, mode="clip"), mode="clip")
                some = there >= self.least[item]
                own, item = own[some], item[some]
                out += zip(doc[own].tolist(), item.tolist(), s[own].tolist(), e[own].tolist(), strict=True)
        return out

    def check(self, words: Callable[[int, int], list[bytes]], n: int, k: int, s: int, e: int) -> tuple[int, int, int] | None:
        """(common words, start, end) of item k around the window [s, e), if it is the item or a paraphrase; words(s, e) are those of a text of n."""
        item, own = self.words[k], self.counts[k]
        if len(item) > PASSAGE:
            s, e = max(0, s - len(item)), min(n, e + len(item))
        there = words(s, e)
        # the common subsequence is no longer than the words in common, each as often as both have it
        if sum(min(n, own[w]) for w, n in Counter(filter(own.__contains__, there)).items()) < SHARED * len(item):
            return None
        common = subsequence(item, there)
        if common < SHARED * len(item) or common < SURE * len(item) and self.answers[k] - set(there):
            return None
        return common, s, e


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, common, share, start, end): benchmark items that a document contains.

    common is the longest common subsequence in words of the item and of the document's
    words [start, end), the best window; share is common over the item's words. Null texts
    are empty; an item without words matches nothing; rows without an id, or with one that
    is no integer, take part with a null id; equal rows give equal rows, equal items a row each; extra columns are ignored;
    with an empty table on either side the result is empty.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, common int, share double, start int, end int"
    items = keep(benchmark.select(F.col("item_id").try_cast("long").alias("item_id"), text_of(benchmark).alias("text")).where("text <> ''"), "items")
    # about as many passages as parts() cuts
    n_items, n_parts = items.select(F.count(F.lit(1)), F.sum(F.ceil(F.size(F.split("text", r"[^\p{L}\p{N}]+")) / PASSAGE))).first()
    sums = keep(counted(docs), "sums") if n_items else None
    first = sums.where("row = -1").agg(F.max("v")).first()[0] if n_items else None
    if first is None or not (n := int(np.frombuffer(first, "<i8")[-1])):
        return spark.createDataFrame([], schema)
    weights = _weights(np.frombuffer(first, "<i8")[:-1].astype(np.float64), n)
    sketch = sums.where("row >= 0").select(F.lit(None).cast("binary").alias("text"), "v", F.col("row").alias("n"))
    blocks = -(-n_parts // ITEMS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.where(block == b).collect()]
        cut = [b" ".join(p) for _, t in own for p in parts(tokens(t.encode()))]
        queries = spark.createDataFrame([(p, None, SKETCH + i) for i, p in enumerate(cut)], "text binary, v binary, n int")
        space = latent(sketch.unionByName(queries), weights)
        space *= weights.astype(np.float32)[:, None]
        index = spark.sparkContext.broadcast(Index(own, space))  # ITEMS passages and a matrix of fixed size
        del space
        # written, so that no more than one block's matrix is held
        part = keep(found_in(docs, index, schema), "found")
        index.destroy()
        found = part if found is None else found.unionByName(part)
    done_with(sums)
    return found


def segments(lengths: list[int]) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
    """Texts of so many words in lots of about TOKENS words: (text number, first word) of each segment, and the segments' numbers of words.

    A longer text is cut into segments that overlap by the longest window, so each window lies in one.
    """
    places, lot, held = [], [], 0
    for d, n in enumerate(lengths):
        for o in range(0, max(1, n), TOKENS):
            part = min(n - o, TOKENS + SCALES[-1][1])
            if lot and held + part > TOKENS:
                yield places, lot
                places, lot, held = [], [], 0
            places.append((d, o))
            lot.append(part)
            held += part
    if lot:
        yield places, lot


def found_in(docs: DataFrame, index: Broadcast[Index], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            ids, (folded, starts, ends, lengths) = batch["doc_id"].to_pylist(), words_of(batch["text"].to_pylist())
            dims, first = dimensions(folded, starts, ends), np.concatenate(([0], np.cumsum(lengths))).tolist()
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for places, lot in segments(lengths.tolist()):
                for i, k, s, e in own.search(np.array(lot), np.concatenate([dims[first[d] + o : first[d] + o + n] for (d, o), n in zip(places, lot, strict=True)])):
                    d, o = places[i]
                    there = lambda s, e, f=first[d]: folded[starts[f + s] : ends[f + e - 1]].split()
                    hit = own.check(there, int(lengths[d]), k, s + o, e + o)
                    if hit and hit[0] > best.get((d, k), (0,))[0]:
                        best[d, k] = hit
            rows = [(ids[d], own.ids[k], common, common / len(own.words[k]), s, e) for (d, k), (common, s, e) in best.items()]
            yield pa.record_batch(list(map(list, zip(*rows, strict=True))) if rows else [[]] * 6, schema=_ARROW)

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), text_of(docs).cast("binary").alias("text")).mapInArrow(run, schema)


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("common", pa.int32()), ("share", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
