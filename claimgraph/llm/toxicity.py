"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

One weight vector is shared by ordered thresholds: P(grade <= k) = logistic(threshold_k - weights . x).  The output
is the probability of each grade, the expected severity (the mean grade) and the decision that the grade is above 0,
taken where its probability reaches ``TOXIC_AT``.  Features are log(1 + count) of hashed lower-cased words, word pairs and beginnings of
words, of which the fit keeps those that are more frequent in toxic texts.

The labels only say whether a text is toxic.  Grades above 0 are made from them: words that occur at least
``MARKER_RATIO`` times as often in toxic texts as in the others are markers, and toxic texts are split into
``GRADES - 1`` equal parts by the number of their words that are markers.  The model is fitted on a bounded sample of
labelled rows; what it learns is applied to every text, whole.

Defined cases: a null or empty text has no features, grade 0 and is not toxic; null and repeated ids are kept, each
row scored for itself; without labels of both values every text has severity 0; ties in the number of markers go to
the same grade; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, id_text, tune
from .features import WordHashes, dot, labelled, mix, sigmoid, sparse, transposed_dot

BITS = 18
GRADES = 4
MARKER_RATIO = 8.0
MARKER_DOCS = 3
FEATURE_DOCS = 4
FEATURE_RATIO = 6.0
BEGINNINGS = (4, 5)
TOXIC_AT = 0.7
#: Labelled rows that the model is fitted on at most.
FIT_ROWS = 6_000
RESULT = "doc_id long, grade int, expected_severity double, p_toxic double, toxic boolean"

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def vector(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: log(1 + count) of the words, of their beginnings and of pairs of words."""
    w = words(text)
    if not w:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    h = hashes(w).astype(np.uint64)
    families = [h, (h[:-1] << np.uint64(32)) ^ h[1:]]
    families += [hashes([x[:n] for x in w]).astype(np.uint64) + (np.uint64(n) << np.uint64(40)) for n in BEGINNINGS]
    b, n = np.unique(np.concatenate([mix(f, BITS) for f in families]), return_counts=True)
    return b, np.log1p(n).astype(np.float32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of the grades, for each value of weights . x."""
        below = sigmoid(self.thresholds[None, :] - np.asarray(x, float)[:, None])
        edges = np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1)
        return np.diff(edges, axis=1)


def grades(rows: list[tuple[bytes, int]]) -> np.ndarray:
    """Ordered grades of labelled texts: 0 for clean ones, 1 and up by the number of marker words."""
    toxic, clean = Counter(), Counter()
    n = [0, 0]
    split = [words(t) for t, _ in rows]
    for w, (_, y) in zip(split, rows, strict=True):
        (toxic if y else clean).update(set(w))
        n[1 if y else 0] += 1
    markers = {w for w, k in toxic.items() if k >= MARKER_DOCS and k / max(1, n[1]) >= MARKER_RATIO * (clean[w] + 0.5) / max(1, n[0])}
    found = np.array([sum(x in markers for x in w) for w in split])
    y = np.array([1 if t else 0 for _, t in rows])
    cuts = np.quantile(found[y == 1], [k / (GRADES - 1) for k in range(1, GRADES - 1)]) if y.any() else np.zeros(0)
    return np.where(y == 1, 1 + np.searchsorted(cuts, found, "left"), 0)


def select(data: tuple[np.ndarray, np.ndarray, np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of the features that speak for toxicity: in ``FEATURE_DOCS`` toxic texts at least, and
    ``FEATURE_RATIO`` times as often there as in clean ones.  None speaks against it, so length excuses nothing."""
    r, c, v = data
    up, down = np.bincount(c, toxic[r], 1 << BITS), np.bincount(c, ~toxic[r], 1 << BITS)
    a, b = (up + 0.5) / toxic.sum(), (down + 0.5) / max(1, (~toxic).sum())
    chosen = (up >= FEATURE_DOCS) & (a / b >= FEATURE_RATIO)
    return r[chosen[c]], c[chosen[c]], v[chosen[c]]


def fit(rows: list[tuple[bytes, int]], rounds: int = 200, rate: float = 0.3, decay: float = 1e-5) -> OrdinalModel | None:
    """From (text, 0 or 1) rows; None if either label is missing.  Clean and toxic texts weigh the same in all."""
    rows = [r for r in rows if r[1] in (0, 1)]
    if len({y for _, y in rows}) < 2:
        return None
    hashes = WordHashes()
    grade, size = grades(rows), 1 << BITS
    data, n = select(sparse([vector(t, hashes) for t, _ in rows]), grade > 0), len(rows)
    share = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())
    params = np.concatenate([np.zeros(size), np.linspace(0.0, 1.0, GRADES - 1)[:1], np.zeros(GRADES - 2)])  # weights, first threshold, log gaps
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        gaps = np.exp(np.clip(params[size + 1 :], -5, 5))
        theta = params[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = dot(data, params[:size], n)
        high = np.where(grade < GRADES - 1, theta[np.minimum(grade, GRADES - 2)] - s, np.inf)
        low = np.where(grade > 0, theta[np.maximum(grade - 1, 0)] - s, -np.inf)
        ph, pl = sigmoid(np.clip(high, -500, 500)), sigmoid(np.clip(low, -500, 500))
        ph, pl = np.where(np.isinf(high), 1.0, ph), np.where(np.isinf(low), 0.0, pl)
        dh, dl = ph * (1 - ph), pl * (1 - pl)
        p = np.maximum(ph - pl, 1e-12)
        gs = share * (dh - dl) / p  # of the loss -log p by s
        gt = np.bincount(np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, -share * dh / p, 0.0), GRADES - 1)
        gt += np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, share * dl / p, 0.0), GRADES - 1)
        g = np.concatenate([transposed_dot(data, gs, size) + decay * params[:size], [gt.sum()], gt[1:][::-1].cumsum()[::-1] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    gaps = np.exp(np.clip(params[size + 1 :], -5, 5))
    return OrdinalModel(params[:size].astype(np.float32), params[size] + np.concatenate([[0.0], np.cumsum(gaps)]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> OrdinalModel | None:
    tune(docs.sparkSession)
    return fit(labelled(docs, labels, label, id_col=id_col, text_col=text_col, rows=rows))


def score(docs: DataFrame, model: OrdinalModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, grade (the likeliest), expected_severity, p_toxic and toxic."""
    tune(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            x, some = [], []
            for text in as_bytes(batch, "text"):
                b, value = vector(text, hashes) if model else (np.zeros(0, np.int64), np.zeros(0))
                x.append(float((model.weights[b] * value).sum()) if len(b) else 0.0)
                some.append(len(b) > 0)
            some = np.array(some, bool)
            p = model.probabilities(np.array(x)) if model else np.zeros((len(x), GRADES))
            p[~some] = np.eye(GRADES)[0]
            risk = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p @ np.arange(GRADES)), pa.array(risk), pa.array(risk >= TOXIC_AT)],
                names=["doc_id", "grade", "expected_severity", "p_toxic", "toxic"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, RESULT)
