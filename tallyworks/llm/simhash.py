"""Operator 8: SimHash near-duplicates by vantage-point shards and trees.

Fingerprints are 64-bit SimHashes of word shingles. Distinct fingerprints are dealt to
shards that are shells of vantage points under the Hamming distance masked to some of
the bits: the bits are cut into ``radius + 2`` blocks and a fingerprint enters, for each
pair of blocks, the shell at distance zero of its own value there. Two fingerprints
within ``radius`` bits agree on two blocks at least, so the shards overlap enough that
every linked pair meets in one. (Shells of the whole distance do not prune: fingerprints
of unlike texts lie 32 +- 4 bits from any vantage point, so with a margin of 4 bits about
87 % of the branches of each level would get a copy.) In a shard a vantage-point tree
splits at the median distance and the triangle bounds prune the branches that a query
ball can't touch; small shards are compared outright.

Only links go on: a shard returns a star for each of its groups, the stars are joined to
components by DataFrame rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import done_with, keep, small_batches, table, text_of
from .graph import components

#: A shard up to this size is compared outright, row against following rows.
LEAF = 64
#: A shard of more fingerprints is dealt again as pairs of blocks of this size.
SHARD = 20_000
#: Rows of a distance matrix at a time.
CHUNK = 2_000_000


def simhash(text: bytes, words: int = 4) -> int:
    """SimHash of a UTF-8 text as an unsigned integer; 0 if it has no words."""
    w = text.lower().split()
    if not w:
        return 0
    joined = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(w) - words + 1)
    last = min(words, len(w)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), (ends[last:] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, words: int = 4) -> Column:
    """The fingerprint's 64 bits as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))

    return fp(text.cast("binary"))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp), one row for each row of docs."""
    return docs.select("doc_id", fingerprint_of(text_of(docs), words).alias("fp"))


def masks(radius: int) -> list[int]:
    """Bit masks of the block pairs: of radius + 2 blocks, two at least are untouched by radius bits."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    block = [sum(1 << b for b in range(i, j)) for i, j in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(block, 2)]


def near_pairs(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of x within radius bits, by a vantage-point tree.

    A node holds the points below it and the queries whose ball reaches it.
    """
    left, right = [], []
    every = np.arange(len(x))
    todo = [(every, every)]
    rng = np.random.default_rng(len(x))
    while todo:
        points, queries = todo.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) > LEAF:
            v = x[points[rng.integers(len(points))]]
            far = np.bitwise_count(x[points] ^ v)
            r = int(np.median(far))
            inside = far <= r
            if not inside.all():
                ball = np.bitwise_count(x[queries] ^ v).astype(np.int64)
                todo += [(points[inside], queries[ball - radius <= r]), (points[~inside], queries[ball + radius > r])]
                continue
        step = max(1, CHUNK // len(points))
        for i in range(0, len(queries), step):
            q = queries[i : i + step]
            a, b = np.nonzero(np.bitwise_count(x[q][:, None] ^ x[points][None, :]) <= radius)
            some = q[a] < points[b]
            left.append(q[a][some])
            right.append(points[b][some])
    return (np.concatenate(left), np.concatenate(right)) if left else (every[:0], every[:0])


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n positions the smallest one that the pairs (a, b) connect it with."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(keys: np.ndarray, fps: np.ndarray, radius: int) -> pd.DataFrame:
    """Stars of rows sorted by key; each key's rows are a shard."""
    n = len(keys)
    cut = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [n]))
    size = np.diff(cut)
    x = fps.view(np.uint64)
    left, right = [], []
    few = np.repeat(size <= LEAF, size)
    for k in range(1, min(LEAF, int(size.max(initial=1)))):
        same = np.nonzero((keys[k:] == keys[:-k]) & few[k:])[0]
        if not len(same):
            break
        hit = same[np.bitwise_count(x[same] ^ x[same + k]) <= radius]
        left.append(hit)
        right.append(hit + k)
    for i in np.nonzero(size > LEAF)[0]:
        p, q = near_pairs(x[cut[i] : cut[i + 1]], radius)
        left.append(p + cut[i])
        right.append(q + cut[i])
    a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
    root = stars(a, b, n)
    some = np.nonzero(root != np.arange(n))[0]
    return pd.DataFrame({"large": False, "a": fps[some], "b": fps[root[some]]}).drop_duplicates()


def _shards(radius: int, most: int):
    """Reads rows (key, fp) sorted by key; gives links, and the rows of shards above most as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for pdf in batches:
            k, f = pdf["key"].to_numpy(), pdf["fp"].to_numpy()
            if large is not None:
                n = int(np.searchsorted(k, large, "right"))
                if n:
                    yield pd.DataFrame({"large": True, "a": k[:n], "b": f[:n]})
                    k, f = k[n:], f[n:]
                if not len(k):
                    continue
                large = None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if len(keys) - cut > most:
                large = keys[-1]
                yield pd.DataFrame({"large": True, "a": keys[cut:], "b": fps[cut:]})
                yield _links(keys[:cut], fps[:cut], radius)
                keys, fps = keys[:0], fps[:0]
            elif cut >= LEAF * LEAF:
                yield _links(keys[:cut], fps[:cut], radius)
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield _links(keys, fps, radius)

    return run


def links(distinct: DataFrame, radius: int = 4, most: int = SHARD) -> DataFrame:
    """(a, b): links that connect exactly what the pairs within radius bits connect, of distinct fingerprints fp.

    A shard above ``most`` rows is dealt to tasks as pairs of its blocks, so no task holds
    more than two blocks; no pair is left out.
    """
    keyed = distinct.select(F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks(radius))])).alias("key"), "fp")
    schema = "large boolean, a long, b long"
    found = keep(keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_shards(radius, most), schema), "shards")
    over = found.where("large")
    if not over.isEmpty():
        blocks = over.groupBy(F.col("a").alias("key")).agg(F.ceil(F.count(F.lit(1)) / (most / 2)).cast("int").alias("n"))
        dealt = over.select(F.col("a").alias("key"), F.col("b").alias("fp")).join(blocks, "key")
        mine = F.pmod(F.hash("fp"), F.col("n"))
        dealt = dealt.select("key", "fp", "n", mine.alias("m")).select("key", "fp", "m", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
        dealt = dealt.select(F.xxhash64("key", F.least("m", "o"), F.greatest("m", "o")).alias("key"), "fp")
        # hashing keeps pairs of blocks near ``most`` rows; whatever they have, they are compared
        more = dealt.repartition("key").sortWithinPartitions("key").mapInPandas(_shards(radius, 1 << 62), schema)
        found = keep(found.where("not large").unionByName(more), "shards")
    return found.select("a", "b")


def names(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, root, component_id) for each distinct fp of fps(doc_id, fp): root is one fingerprint of the group, component_id its smallest doc_id.

    Two groups may have the same component_id, where a doc_id has several texts; their roots differ.
    """
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    # sorted rows of two longs may come in larger batches than texts
    joined = components(links(distinct, radius))
    grouped = keep(joined.join(distinct, joined["node"] == distinct["fp"]).select("root", "fp", "first"), "grouped")
    # written, as are the names: adaptive execution splits the hot keys of a join of plain tables
    lowest = keep(grouped.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    named = grouped.join(lowest, "root").select("fp", "root", "component_id")
    out = keep(distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id")), "names")
    done_with(distinct, grouped, lowest)
    return out


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Texts whose fingerprints differ in at most ``radius`` bits link; component_id is the
    smallest doc_id that links reach, itself included. Null text is empty; a text without
    words has fingerprint zero and links like any other; repeated rows each give a row;
    a null doc_id never names a component unless all of it are null; extra columns are
    ignored; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    fps = keep(fingerprints(docs, words), "fingerprints")
    return fps.join(names(fps, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
