"""Near copies by SimHash over sets of five-word shingles, for texts about 0.8 alike or more.

A fingerprint has 160 bits in five parts of 32.  Two are linked if they differ in at most 24 bits: that share, 0.15, is
the angle between shingle sets of equal size and a Jaccard similarity of 0.8, so such pairs are found half of the time,
those of 0.9 nearly always, and those of 0.6 hardly ever.  Five parts cannot share 24 differences without one part that
has 4 or fewer; there the two meet in the middle, at a value within 2 flips of both.  So every part emits its ball of
radius 2, and no link is missed.

Variants are dealt and expanded as in ``simhash``.  Fingerprints that meet are not yet links: within a value's members the
first is compared with all, then what was reached with what was not, until nothing more is reached; each slice keeps a
spanning forest of what it found.

What meets by chance grows with the square of the number of texts: a part has 2^32 values and a text emits 529, so two
unrelated texts meet once in 100,000 pairs and part.  Comparing them costs less than emitting up to some hundred
million texts; beyond that, wider parts are needed, with more of them for the same similarity.

Words are lower-cased for A to Z only; repeats of a shingle count once; a text of fewer words is one shingle.

Defined cases: as in ``simhash``: null or wordless texts have fingerprint 0 and are linked like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_schema, as_bytes, id_text, row_key, trim, tune

WORDS = 5
PARTS, PART_BITS = 5, 32
HALF = 2
RADIUS = PARTS * (2 * HALF + 1) - 1
#: Variants made and sorted at once; an executor runs several such tasks beside its heap.
SLICE = 500_000
PER_TASK = 64_000_000
#: Groups of more members are worked on one by one.
SMALL = 8
#: Comparisons made at once.
BLOCK = 1 << 20


def fingerprint(text: bytes, words: int = WORDS, seed: int = 42) -> bytes:
    """20 bytes of one text in UTF-8: a bit is 1 if it is set in over half of the shingles' hashes."""
    found = simhash.shingle_hashes(text, words, seed)
    if not len(found):
        return bytes(PARTS * PART_BITS // 8)
    h, bits, n = np.unique(found), np.zeros(PARTS * PART_BITS, np.int64), 0
    for i in range(0, len(h), 65_536):
        more = [h[i : i + 65_536]]
        while 64 * len(more) < len(bits):
            more.append(_mixed(more[-1]))
        wide = np.stack(more, axis=1).astype(">u8").view(np.uint8).reshape(len(more[0]), -1)[:, : len(bits) // 8]
        bits += np.unpackbits(wide, axis=1).sum(axis=0, dtype=np.int32)
        n += len(wide)
    return np.packbits(2 * bits > n).tobytes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Further 64 bits of each hash, by the finaliser of SplitMix64."""
    z = h + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = 42) -> DataFrame:
    """(key, doc_id, fp): fp is the fingerprint in hexadecimal digits, key names the row's values."""
    tune(docs.sparkSession)
    keyed = id_text(docs, id_col, text_col).select(row_key("doc_id", "text").alias("key"), "doc_id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = pa.array([fingerprint(t, words, seed).hex() for t in as_bytes(batch, "text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), fps], names=["key", "doc_id", "fp"])
        trim()

    return keyed.mapInArrow(run, "key string, doc_id long, fp string")


def _parts(fps: np.ndarray) -> np.ndarray:
    """A row of 32-bit parts for each fingerprint of 20 bytes."""
    return fps.view(">u4").reshape(-1, PARTS).astype(np.uint32)


def _close(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=-1, dtype=np.int64) <= RADIUS


def _members(prints: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all of one value's members that links connect."""
    rest = group
    while len(rest) > 1:
        reached, rest = rest[:1], rest[1:]
        while len(reached) and len(rest):
            nearer = np.zeros(len(rest), bool)
            step = max(1, BLOCK // len(rest))
            for i in range(0, len(reached), step):
                left = np.flatnonzero(~nearer)
                x, y = np.broadcast_arrays(reached[i : i + step, None], rest[left][None, :])
                hit = _close(prints, x, y)
                by, which = hit.argmax(axis=0), hit.any(axis=0)
                if which.any():
                    yield reached[i : i + step][by[which]], rest[left[which]]
                    nearer[left[which]] = True
            reached, rest = rest[nearer], rest[~nearer]


def _met(prints: np.ndarray, values: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints of equal values, enough to connect all that are linked there."""
    order = np.lexsort((which, values))
    v, w = values[order], which[order]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sizes = np.diff(np.append(starts, len(v)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    small = sizes <= SMALL
    for i in range(SMALL - 1):  # all pairs of the few members of a small group
        for j in range(i + 1, SMALL):
            at = starts[small & (sizes > j)]
            for k in range(0, len(at), BLOCK):
                a, b = w[at[k : k + BLOCK] + i], w[at[k : k + BLOCK] + j]
                near = _close(prints, a, b)
                yield a[near], b[near]
    for at, size in zip(starts[~small], sizes[~small], strict=True):
        yield from _members(prints, w[at : at + size])


def links_of(prints: np.ndarray, values: np.ndarray, left: np.ndarray, who: np.ndarray, bit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (indices) among the fingerprints whose parts, in the upper half of ``values``, meet below one leading value."""
    if len(values) < 2:
        return
    if bit < PART_BITS and sum(int((left == k).sum()) * simhash.choose(PART_BITS - bit, k) for k in range(HALF + 1)) > SLICE:
        for value in (0, 1):
            i, out, rest = simhash.reach(values, left, bit, value)
            yield from links_of(prints, out, rest, who[i], bit + 1)
        return
    made, which, _ = simhash.variants(values, left, bit, 64 - PART_BITS)
    found = list(_met(prints, made, who[which]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    if len(a):
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = simhash.forest(len(nodes), ends[: len(a)], ends[len(a) :])
        member = np.flatnonzero(label != np.arange(len(nodes)))
        yield nodes[label[member]], nodes[member]


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within the radius."""
    n = nodes.count()
    leading = min(simhash.MOST_LEADING, max(1, int(n * simhash.choose(PART_BITS, HALF) // PER_TASK).bit_length()))
    width = PARTS * PART_BITS // 8

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("part int, left int, fp binary")
        for batch in it:
            raw = [bytes.fromhex(x) for x in batch.column("fp").to_pylist()]
            own = _parts(np.frombuffer(b"".join(raw), np.uint8))
            kept = pa.array(raw, pa.binary())
            for p in range(PARTS):
                state = [(own[:, p].astype(np.uint64) << np.uint64(64 - PART_BITS), np.full(len(own), HALF), np.arange(len(own)))]
                for bit in range(leading):
                    split = [simhash.reach(f, k, bit, value) + (i,) for f, k, i in state for value in (0, 1)]
                    state = [(out, rest, i[j]) for j, out, rest, i in split]
                for out, rest, i in state:
                    if len(i):
                        part = (p << leading) + (out >> np.uint64(64 - leading)).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(rest.astype(np.int32)), kept.take(pa.array(i))], schema=schema)

    dealt = nodes.select("fp").mapInArrow(spread, "part int, left int, fp binary").repartitionById(PARTS << leading, "part")

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("part").to_numpy(), b.column("left").to_numpy(), np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8)) for b in it]
        if not found:
            return
        part, left, raw = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        prints = _parts(raw)
        for one in np.unique(part):
            who = np.flatnonzero(part == one)
            low = (1 << (PART_BITS - leading)) - 1  # the leading bits are those of the part, whatever was flipped
            values = (prints[who, one >> leading] & np.uint32(low)) | np.uint32((int(one) & ((1 << leading) - 1)) << (PART_BITS - leading))
            for a, b in links_of(prints, values.astype(np.uint64) << np.uint64(64 - PART_BITS), left[who].astype(np.int64), who, leading):
                x, y = (pa.array([raw[i * width : (i + 1) * width].tobytes().hex() for i in side.tolist()], pa.string()) for side in (a, b))
                yield pa.RecordBatch.from_arrays([x, y], names=["a", "b"])
        trim()

    met = dealt.mapInArrow(meet, "a string, b string")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies, chosen as by ``simhash.keep_one``."""
    return simhash.keep_one(docs, prints_of=fingerprints, links_of_nodes=links, **options)
