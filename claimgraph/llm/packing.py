"""Best-fit packing of token pieces into sequences under several capacities.

A piece demands three things of a sequence: tokens, one place among its documents, and attention cost (the square
of its length).  All three follow from the length, of which there are at most ``capacity`` values, so the pieces
are planned as a histogram: the driver holds one count per length however large the corpus is.  Lengths come in
descending order; among the groups of equal bins where a piece meets every constraint, it takes the best by

* ``norm``: the least weighted norm of the residual capacities that would be left, or
* ``dot``: the greatest weighted dot product of its demands with the residual capacities, per length of the residual:
  the bin whose spare room is most alike in shape to the piece; of equally alike ones the fullest.

A piece makes the bin it enters fit still better, so equal pieces fill it as far as they go and whole groups are
planned at once.  Each piece then finds its place by its rank among the pieces of its length: a running count
within the task that cut it, plus the counts of the tasks before.  Nothing gathers the pieces themselves.

Defined cases: a null or empty text is the end id alone; null and repeated ids are kept, each row packed for
itself; ties between groups go to the older one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, id_text, map_rows, tune, written
from .tokens import encoder

PIECE = "part int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long"
STEP = "length long, first long, last long, sequence long, copies long, used long"


@dataclass(frozen=True)
class Capacities:
    """Of a sequence; the weights rank the normalised residuals."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"


def plan(counts: dict[int, int], cap: Capacities) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, rank after the last, first sequence, copies in each sequence, tokens used before)."""
    limits = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights)
    groups = np.zeros((0, 5), np.int64)  # first sequence, number of sequences, tokens, documents, attention in use
    steps, bins = [], 0
    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], np.int64)
        if (demand > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rank, left = 0, counts[length]
        while left:
            free = limits - groups[:, 2:]
            fits = np.flatnonzero((free >= demand).all(axis=1))
            if len(fits):
                if cap.score == "dot":
                    spare = free[fits] / limits
                    length_of = np.sqrt((spare * spare * weights).sum(axis=1))
                    alike = (spare * (demand / limits) * weights).sum(axis=1) / np.maximum(length_of, 1e-12)
                    score = np.round(-alike, 9) + 1e-12 * length_of
                else:
                    score = ((((free[fits] - demand) / limits) ** 2) * weights).sum(axis=1)
                g = fits[np.argmin(score)]
                group = groups[g].copy()
                groups = np.delete(groups, g, axis=0)
            else:
                most = int((limits // demand).min())
                group = np.array([bins, -(-left // most), 0, 0, 0], np.int64)
                bins += int(group[1])
            copies = int(((limits - group[2:]) // demand).min())
            whole = min(int(group[1]), left // copies)
            after = []
            if whole:
                steps.append((length, rank, rank + whole * copies, int(group[0]), copies, int(group[2])))
                rank, left = rank + whole * copies, left - whole * copies
                after.append([group[0], whole, *(group[2:] + copies * demand)])
            rest = [group[0] + whole, group[1] - whole, *group[2:]]
            if rest[1] and left < copies:
                if left:
                    steps.append((length, rank, rank + left, int(rest[0]), left, int(group[2])))
                    after.append([rest[0], 1, *(group[2:] + left * demand)])
                    rest[0], rest[1], left = rest[0] + 1, rest[1] - 1, 0
            if rest[1]:
                after.append(rest)
            after = [x for x in after if x[2] < cap.tokens]
            if after:
                groups = np.concatenate([groups, np.array(after, np.int64)])
    return steps


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Every text's ids and the end id, cut only where longer than ``capacity``."""
    tune(docs.sparkSession)
    docs = id_text(docs, id_col, text_col)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in it:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), strict=True):
                ids = np.frombuffer(own.encode(text) + end, own.dtype).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part_ids = ids[start : start + capacity]
                    yield part, int(seen[len(part_ids)]), doc_id, k, start, len(part_ids), zlib.crc32(part_ids.tobytes())
                    seen[len(part_ids)] += 1

    return map_rows(docs, cut, PIECE)


def place(cut: DataFrame, cap: Capacities) -> DataFrame:
    """A sequence and an offset for each row of a written table of pieces."""
    spark = cut.sparkSession
    by_task = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = written(by_task.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-shifts")
    counts = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length, `capacity` at most
    steps = plan(counts, cap)
    by_length: dict[int, np.ndarray] = {}
    for length in {s[0] for s in steps}:
        by_length[length] = np.array([s[1:] for s in steps if s[0] == length], np.int64)
    bound = spark.sparkContext.broadcast(by_length)  # a few steps per length, whatever the number of pieces

    ranked = cut.join(shifts.select("part", "length", "shift"), ["part", "length"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("shift").to_numpy()
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                steps = bound.value[int(length[own[0]])]
                first, _, sequence, copies, used = steps[np.searchsorted(steps[:, 0], rank[own], "right") - 1].T
                local = rank[own] - first
                seq[own], offset[own] = sequence + local // copies, used + local % copies * length[own]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, schema)


def pack(docs: DataFrame, cap: Capacities = Capacities(), **options) -> DataFrame:  # noqa: B008
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(written(pieces(docs, capacity=cap.tokens, **options), "packing-pieces"), cap)
