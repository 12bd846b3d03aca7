"""Hashed text features, scored with cached words, and a bounded sample of labelled rows to fit on."""

from __future__ import annotations

import zlib
from itertools import islice, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those with the least hashes of id and text.
FIT_ROWS = 4_000
#: Their texts together, in bytes, at most: rows beyond, in the same order, are not fitted on.
FIT_BYTES = 128 << 20
CACHED = 300_000
CHUNK = 1 << 20
#: Entries of sparse rows multiplied at a time.
ENTRIES = 1 << 21


_POINT = np.uint64(0x9E3779B1)  # odd and beyond all code points


class WordHashes:
    """32-bit hashes of lower-cased words, through a bounded cache."""

    def __init__(self, cached: int = CACHED):
        self.cached, self.known = cached, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.cached:
            known = self.known = dict(islice(known.items(), self.cached // 2))
            new = set(words).difference(known)
        for w in new:
            known[w] = zlib.crc32(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        if len(known) > self.cached:
            self.known = {}
        return out


def mix(h: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of 64-bit values."""
    with np.errstate(over="ignore"):
        return ((h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def code_points(text: bytes) -> np.ndarray:
    """Of a text in UTF-8."""
    return np.frombuffer(text, np.uint8) if text.isascii() else np.frombuffer(text.decode().encode("utf-32-le"), "<u4")


def char_grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Buckets of the n-grams of code points."""
    if len(points) < n:
        return np.zeros(0, np.int64)
    a = points.astype(np.uint64)
    h = np.full(len(a) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * _POINT + a[k : len(a) - n + 1 + k]
    return mix(h, bits)


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", rows: int = FIT_ROWS) -> list[tuple[bytes, int]]:
    """Up to ``rows`` labelled texts of up to ``FIT_BYTES``, in a fixed order that depends on the rows alone."""
    marks = labels.select(F.col(label_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).dropna().orderBy(F.xxhash64("i", "y"), "i", "y").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    found = texts.join(F.broadcast(marks), "i").select("t", "y").orderBy(F.xxhash64("t", "y"), "t", "y").limit(rows)
    out, size = [], 0
    for r in found.toLocalIterator():
        text = r["t"].encode()
        size += len(text)
        if size > FIT_BYTES and out:
            break
        out.append((text, r["y"]))
    return out


def sparse(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, columns and values of (buckets, values) rows, 12 bytes an entry; ``rows`` is emptied on the way."""
    n = np.fromiter((len(b) for b, _ in rows), np.int64, len(rows))
    r, c, v = np.repeat(np.arange(len(rows), dtype=np.int32), n), np.empty(n.sum(), np.int32), np.empty(n.sum(), np.float32)
    end = len(c)
    while rows:
        b, x = rows.pop()
        c[end - len(b) : end], v[end - len(b) : end] = b, x
        end -= len(b)
    return r, c, v


def _parts(n: int) -> list[slice]:
    return [slice(i, i + ENTRIES) for i in range(0, n, ENTRIES)]


def dot(data: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, n: int) -> np.ndarray:
    r, c, v = data
    return sum((np.bincount(r[s], v[s] * w[c[s]], n) for s in _parts(len(c))), np.zeros(n))


def transposed_dot(data: tuple[np.ndarray, np.ndarray, np.ndarray], g: np.ndarray, size: int) -> np.ndarray:
    r, c, v = data
    return sum((np.bincount(c[s], v[s] * g[r[s]], size) for s in _parts(len(c))), np.zeros(size))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


__all__ = ["CHUNK", "FIT_BYTES", "FIT_ROWS", "WordHashes", "char_grams", "code_points", "dot", "labelled", "mix", "repeat", "sigmoid", "sparse", "transposed_dot"]
