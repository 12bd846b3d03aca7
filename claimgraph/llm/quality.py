"""Quality rules: fixed counts of a text, and a calibrated classifier of hashed n-grams against fixed thresholds.

The classifier is a logistic regression over hashed word uni- and bigrams and hashed character 3- and 5-grams, as
relative frequencies of each family, fitted on a bounded sample of labelled quality rows (``FIT_ROWS``).  A fifth
of the sample is held out to calibrate its scores to probabilities (a logistic curve over the score).  Documents
are scored in Arrow batches: a text passes if it meets the count rules and its probability of good quality reaches
``KEEP_AT``.

Words are separated by the ASCII white space characters; lines by line feeds.

Defined cases: a null or empty text has no words and fails; null and repeated ids are kept, each row judged for
itself; without labels of both values every text that meets the count rules is kept; an empty table gives no rows;
other columns are ignored, or passed through where rows are filtered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, id_text, tune
from .features import CHUNK, FIT_ROWS, WordHashes, char_grams, code_points, dot, labelled, mix, sigmoid, sparse, transposed_dot

BITS = 17
FAMILIES = 4
#: A good text lost is held three times as bad as a bad one kept, so texts stay from 1 / (1 + 3) on.
KEEP_AT = 0.25
LEAST_WORDS = 20
#: In hundredths of the words.
MOST_REPEATED = 30
WINDOW = 8
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"

#: The symbols counted.
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    span = 1
    while span < window:  # the name of a run of 2 * span words is the number of its pair of names
        pair = code[: len(code) - span] * (int(code.max()) + 1) + code[span:]
        names, code = np.unique(pair, return_inverse=True)
        if len(names) == len(pair):
            return 0
        span *= 2
    twice = np.flatnonzero(np.bincount(code)[code] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.subtract.at(change, twice + window, 1)
    return int((np.cumsum(change) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    worded = [x for x in lines if _WORD.search(x)]
    return len(worded) - len(set(worded))


@dataclass
class Counts:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def count(text: bytes, words: list[bytes]) -> Counts:
    return Counts(len(words), len(b"".join(words).translate(None, _CONTINUATION)), len(text.translate(None, _NOT_SYMBOL)), duplicate_lines(text), repeated_words(words))


class Scorer:
    """Weights of the four families, and the calibration (slope, offset)."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset
        self.hashes = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"hashes": None}

    def score(self, text: bytes, words: list[bytes]) -> float:
        """The log-odds of good quality before calibration; each family contributes the mean of its weights."""
        if self.hashes is None:
            self.hashes = WordHashes()
        size, total = 1 << BITS, self.bias
        for k, (weight, n) in enumerate(family_sums(text, words, self.hashes, lambda k, b: float(self.weights[k * size : (k + 1) * size][b].sum(dtype=np.float64)))):
            total += weight / n if n else 0.0
        return total

    def probability(self, text: bytes, words: list[bytes]) -> float:
        return float(sigmoid(self.slope * self.score(text, words) + self.offset))


def _buckets(text: bytes, words: list[bytes], hashes: WordHashes) -> Iterator[tuple[int, np.ndarray]]:
    h = hashes(words).astype(np.uint64)
    yield 0, mix(h, BITS)
    yield 1, mix((h[:-1] << np.uint64(32)) ^ h[1:], BITS) if len(h) > 1 else np.zeros(0, np.int64)
    points = code_points(text)
    for k, n in ((2, 3), (3, 5)):
        for i in range(0, max(1, len(points)), CHUNK):  # a long text in parts, so that memory stays bounded
            yield k, char_grams(points[i : i + CHUNK + n - 1], n, BITS)


def family_sums(text: bytes, words: list[bytes], hashes: WordHashes, value) -> list[tuple[float, int]]:
    sums, n = [0.0] * FAMILIES, [0] * FAMILIES
    for k, b in _buckets(text, words, hashes):
        sums[k] += value(k, b)
        n[k] += len(b)
    return list(zip(sums, n, strict=True))


def vector(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The features as (buckets, relative frequencies)."""
    found: list[list[np.ndarray]] = [[] for _ in range(FAMILIES)]
    for k, b in _buckets(text, text.split(), hashes):
        found[k].append(b)
    columns, values = [], []
    for k, parts in enumerate(found):
        b, n = np.unique(np.concatenate(parts), return_counts=True)
        columns.append((b + (k << BITS)).astype(np.int32))
        values.append((n / max(1, n.sum())).astype(np.float32))
    return np.concatenate(columns), np.concatenate(values)


def _fit(data: tuple, y: np.ndarray, size: int, passes: int = 12, parts: int = 12, rate: float = 0.5, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam, a part of the rows a step; both classes weigh the same."""
    r, c, v = data
    n = len(y)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    parts = max(1, min(parts, n // 100))
    cuts = [n * k // parts for k in range(parts + 1)]
    edges = np.searchsorted(r, cuts)  # entries are in order of their rows
    w, m, s, t = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), 0  # the last is the bias
    for k in range(passes * parts):
        t, (a, b), (i, j) = t + 1, edges[k % parts :][:2], cuts[k % parts :][:2]
        own = (r[a:b] - np.int32(i), c[a:b], v[a:b])
        e = share[i:j] * (sigmoid(dot(own, w, j - i) + w[-1]) - y[i:j]) * parts
        g = np.append(transposed_dot(own, e, size) + decay * w[:-1], e.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = rate / (1 + 4 * k / (passes * parts))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[bytes, int]]) -> Scorer | None:
    """A calibrated scorer of (text, 0 or 1) rows; None if either label is missing."""
    rows = [r for r in rows if r[1] in (0, 1)]
    if len({y for _, y in rows}) < 2:
        return None
    y, size = np.array([r[1] for r in rows], float), FAMILIES << BITS
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(rows), bool)
    hashes, parts = WordHashes(), ([], [])
    for (text, _), h in zip(rows, held, strict=True):
        parts[int(h)].append(vector(text, hashes))
    data = sparse(parts[0])
    w, bias = _fit(data, y[~held], size)
    model = Scorer(w, bias)
    data, target = (sparse(parts[1]), y[held]) if held.any() else (data, y)
    s = dot(data, w, len(target)) + bias
    model.slope, model.offset = calibrate(s, target)
    return model


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that best maps scores to labels, with softened targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.abs(score).mean()), 1e-9)
    x, a, b = score / scale, 1.0, 0.0
    for _ in range(200):
        p = sigmoid(a * x + b)
        g = np.array([((p - target) * x).sum(), (p - target).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * x * x).sum() + 1e-6, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(max(a, 1e-6) / scale), float(b)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Scorer | None:
    tune(docs.sparkSession)
    return fit(labelled(docs, labels, label, id_col=id_col, text_col=text_col, rows=rows))


def judge(text: bytes, model: Scorer | None) -> tuple[Counts, float, bool]:
    """The counts, the probability of good quality (1 without a model), and whether the text is kept."""
    words = text.split()
    counts = count(text, words)
    p = model.probability(text, words) if model is not None else 1.0
    return counts, p, not counts.failed and p >= KEEP_AT


def assess(docs: DataFrame, model: Scorer | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the counts, base_failed, quality (the probability) and kept."""
    tune(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [judge(t, model) for t in as_bytes(batch, "text")]
            c = [x[0] for x in found]
            counts = [pa.array([getattr(x, f) for x in c], pa.int64()) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            more = [pa.array([x.failed for x in c], pa.bool_()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *more], names=[x.split()[0] for x in RESULT.split(", ")])

    return id_text(docs, id_col, text_col).mapInArrow(run, RESULT)


def keep(docs: DataFrame, model: Scorer | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    tune(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array([judge(t, model)[2] for t in as_bytes(batch, text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
