"""Operator 4: packing token sequences by best-fit decreasing.

Each task tokenizes its own documents and packs them block by block: a document of more
than a window's tokens is cut into full windows first, the rests are placed longest
first, each into the tightest open window, which a segment tree indexed by remaining
capacity finds. No shuffle, no state beyond a block, and a lost task repeats alone.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, text_of

WINDOW = 1024
END = 0
#: A block is packed when its rests are so many pieces, or the ids held so many.
BLOCK_PIECES, BLOCK_IDS = 20_000, 12_000_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([*[(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")[:-1]], ("ids", pa.binary())])


class Capacities:
    """Segment tree over remaining capacities 0..size-1: which hold an open window, and the least one from a bound on."""

    def __init__(self, size: int):
        self.leaves = 1 << (size - 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, bound: int) -> int:
        """The smallest capacity >= bound with an open window, or -1."""
        i, count = bound + self.leaves, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
                if not i:
                    return -1
            i += 1
            if i & (i - 1) == 0:
                return -1
        while i < self.leaves:
            i *= 2
            i += not count[i]
        return i - self.leaves


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """For pieces of 1..window tokens: window number, offset in it, and how many windows were opened."""
    tree, open_ = Capacities(window + 1), [[] for _ in range(window + 1)]
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = tree.least(size)
        if room < 0:
            room, b, n = window, n, n + 1
        else:
            b = open_[room].pop()
            tree.add(room, -1)
        bins[i], offsets[i] = b, window - room
        if room > size:
            open_[room - size].append(b)
            tree.add(room - size, 1)
    return bins, offsets, n


_ENCODERS: dict[str, Callable[[list[str]], list[list[int]]]] = {}


def _byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is a plain byte-level BPE: no normalizer, text split by the usual pattern, special tokens cut out as they are, ids in order of merges."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    special = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]] if plain else []
    return plain and split and special and not spec["normalizer"] and ids == sorted(ids)


def _merges(vocab: dict[str, int]) -> dict[bytes, int]:
    """Bytes of each token: printable Latin-1 characters stand for their own byte, the next ones from 256 on for the other bytes in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return {bytes(map(byte.__getitem__, token)): i for token, i in vocab.items()}


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """texts -> lists of ids by the tokenizer file at path, without added special tokens, loaded once a worker.

    The ids are those of the ``tokenizers`` library; strings of special tokens in a text get
    the special token's id, as there. A plain byte-level BPE file is run by a faster library
    of the same merges.
    """
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if _byte_level(spec):
            import public_tokenizers
            import tiktoken

            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            merges = {k: v for k, v in _merges({k: v for k, v in spec["model"]["vocab"].items() if k not in special}).items()}
            bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
            _ENCODERS[path] = lambda texts: [bpe.encode(t, allowed_special="all") for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda texts: [e.ids for e in t.encode_batch_fast(list(texts), add_special_tokens=False)]
    return _ENCODERS[path]


class _Block:
    """Documents' ids until they are packed."""

    def __init__(self):
        self.docs: list[tuple[object, np.ndarray]] = []
        self.held = 0

    def rows(self, first: int, window: int) -> tuple[pa.Table, int]:
        sizes = np.array([len(x) for _, x in self.docs], np.int64)
        rests = sizes % window
        some = np.nonzero(rests)[0]
        bins, offsets, n = best_fit(rests[some], window)
        where = dict(zip(some.tolist(), zip(bins.tolist(), offsets.tolist(), strict=True), strict=True))
        out = []
        for k, (doc, ids) in enumerate(self.docs):
            full = len(ids) - len(ids) % window
            for s in range(0, full, window):
                out.append((doc, s, window, len(ids), first + n, 0, ids[s : s + window].tobytes()))
                n += 1
            if full < len(ids):
                b, o = where[k]
                out.append((doc, full, len(ids) - full, len(ids), first + b, o, ids[full:].tobytes()))
        return pa.table(list(map(list, zip(*out, strict=True))), schema=_ARROW), first + n


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces of docs(doc_id, text), placed in sequences of at most ``window`` ids.

    A document is its ids by the tokenizer file, then ``end``; null text is empty, so every
    row has one id at least. Columns: doc_id, start, length, doc_tokens, sequence_id,
    offset, ids (little-endian unsigned 32-bit). Repeated rows are packed each; extra
    columns are ignored; an id that is no integer becomes null; an empty table gives an
    empty table. sequence_id is the task's number, then a count.
    """
    small_batches(docs.sparkSession, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block = encoder(tokenizer), _Block()
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                ids.append(end)
                block.docs.append((doc, np.array(ids, "<u4")))
                block.held += len(ids)
            if len(block.docs) >= BLOCK_PIECES or block.held >= BLOCK_IDS:
                rows, first = block.rows(first, window)
                yield from rows.to_batches(2000)
                block = _Block()
        if block.docs:
            rows, first = block.rows(first, window)
            yield from rows.to_batches(2000)

    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), tokenizer_path()))
