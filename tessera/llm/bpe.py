"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary.

Each distinct word of the splitting pattern is merged once per worker: its
symbols form a doubly linked list, a heap holds the ranks of the pairs of
neighbours, and entries whose symbols have been merged since are skipped when
they come up. Decoding concatenates the vocabulary's strings.

Defined results: a null or an empty text gives an empty list; strings of
special tokens in a text are ordinary text; texts are encoded whole; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed value of the public vocabulary: the pattern that splits a text into words
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the same splits: words first, as nothing else can begin like them
SPLIT = r""" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: words a worker remembers, and the longest remembered one
REMEMBERED, LONGEST = 400_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    # a symbol is word[i:end[i]]; end[i] is 0 once it is merged into the one before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i]
        if not end[i] or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if (h := left[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = right[i]
    return out


class Encoder(dict):
    """Maps words of the pattern to their ids as 32-bit integers in bytes, remembering them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.split = ranks, regex.compile(SPLIT).findall

    def __missing__(self, word: str) -> bytes:
        ids = array("i", merge(word.encode("utf-8", "replace"), self.ranks)).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text))) if text else b""


def decode(ids, strings: dict[int, bytes]) -> str:
    return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = shared.value[0]
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(shared.value[1])
    return _ENCODERS[key]


def _share(spark: SparkSession, vocabulary: str):
    """The ranks, read by the driver (their size is the vocabulary's) and sent to each executor once."""
    return spark.sparkContext.broadcast((vocabulary, load_ranks(vocabulary)))


def encoded(df: DataFrame, row_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_id, ids) of every row."""
    shared = _share(df.sparkSession, vocabulary)

    def run(batches):
        e = _encoder(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [e.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[row_id, "ids"])

    return df.select(F.col(row_id).cast("long").alias(row_id), text).mapInArrow(run, f"`{row_id}` long, ids array<int>")


def token_counts(df: DataFrame, row_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_id, tokens) of every row."""
    shared = _share(df.sparkSession, vocabulary)

    def run(batches):
        e = _encoder(shared)
        for batch in batches:
            n = [len(e.encode(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[row_id, "tokens"])

    return df.select(F.col(row_id).cast("long").alias(row_id), text).mapInArrow(run, f"`{row_id}` long, tokens long")
