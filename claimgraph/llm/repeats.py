"""Removal of long verbatim repeats by external suffix sorting.

A byte goes if a string of ``window`` bytes over it also starts in a document with a smaller id.  Three steps:

1. Shards.  Every window's anchor is the least hash of the ``GRAM``-byte strings in it, so equal windows have equal
   anchors, wherever they stand.  Runs of windows with one anchor are cut out as segments and dealt by their anchor:
   all windows of the same bytes meet in one shard, and no match crosses shards.
2. Sorting.  A shard leaves out anchors that only one document has, keeps each distinct segment once with its
   smallest document, and sorts the segments' suffixes by external induction with common-prefix values
   (``suffix_sort``).  Neighbours that share ``window`` bytes form a group; its smallest document is every member's.
   An occurrence of a segment is covered where that document is smaller than its own.  A batch of documents sends
   each distinct segment once, with its occurrences as numbers, which wait in a spooled file.  A shard beyond
   ``SLICE_BYTES`` is cut again by anchors of another hash and dealt to files, as often as needed, so that a hot
   anchor is divided too.
3. Cutting.  Covered intervals, merged per document, come back to the texts by a broadcast join while they take
   less than ``BROADCAST_BYTES`` in all, and by a shuffled join beyond.

Defined cases: a null text is empty and shorter texts than a window lose nothing; rows with a null id neither
remove bytes nor lose any; rows with equal ids do not compare with each other, and repeated rows all lose the same
bytes; an empty table gives no rows; other columns are ignored.  Cuts are on bytes and may split a character.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_rows, trim, tune, written
from .suffix_sort import suffix_order

WINDOW = 50
GRAM = 16
BATCH_BYTES = 16 << 20
SHARD_TEXT_BYTES = 5 << 20
SLICE_BYTES = 32 << 20
PIECE = 1 << 20
OCCURRENCES = 100_000
#: Files that a large shard is dealt to, and how often: strings on which as many hashes agree are sorted as they are.
MOST_FILES = 64
MOST_LEVELS = 6
SPOOL_BYTES = 8 << 20
BROADCAST_BYTES = 24 << 20
MOST_SHARDS = 100_000
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(a: np.ndarray, seed: int) -> np.ndarray:
    """32-bit hashes of the GRAM-byte strings that start at each byte."""
    w = a.astype(np.uint64)
    w = w[:-1] | (w[1:] << np.uint64(8))
    w = w[:-2] | (w[2:] << np.uint64(16))
    w = w[:-4] | (w[4:] << np.uint64(32))
    n = len(a) - GRAM + 1
    g = (w[:n] * _A) ^ w[GRAM - 8 : GRAM - 8 + n] ^ np.uint64(seed * int(_B) % (1 << 64))
    g *= _B
    g ^= g >> np.uint64(29)
    g *= _A
    return (g >> np.uint64(32)).astype(np.uint32)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    rest = width - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def anchors(text: np.ndarray, window: int, seed: int = 0) -> np.ndarray:
    """The anchor of the window that starts at each byte."""
    n = len(text) - window + 1
    return np.concatenate([_least(_hashes(text[a : min(a + PIECE, n) + window - 1], seed), window - GRAM + 1) for a in range(0, n, PIECE)]) if n > 0 else np.zeros(0, np.uint32)


def segments(texts: list[bytes], window: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, anchor) of the runs of windows with one anchor."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    m = anchors(whole, window, seed)
    new = np.ones(len(m), bool)
    new[1:] = m[1:] != m[:-1]
    new[begin[begin < len(m)]] = True
    stop = begin + np.maximum(size - window + 1, 0)  # after a document's last window
    new[stop[stop < len(m)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(m))
    doc = np.searchsorted(begin, first, "right") - 1
    inside = first < stop[doc]
    first, last, doc = first[inside], last[inside], doc[inside]
    return doc, first - begin[doc], last - first + window - 1, m[first]


#: Of a row: ids, marks and occurrences of each document; start's difference and segment of each occurrence (0 if new,
#: else one more than its number); length, anchor and bytes of each distinct segment.
_KINDS = ["<i8", "<i4", "<u4", "<u4", "<u4", "<u4", "<u4", "u1"]
_LEVELS = [3, 3, 3, 3, 3, 3, 3, 6]


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays, compressed each, numbers byte by byte; before them the header with their sizes."""
    parts = []
    for a, kind, level in zip(arrays, _KINDS, _LEVELS, strict=True):
        a = np.ascontiguousarray(a, kind)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
        parts.append(zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes()))
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


def _unpack(data: bytes, which: list[int]) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(_KINDS)}Q", data)
    at = np.concatenate([[0], np.cumsum(sizes)]) + 8 * len(_KINDS)
    out = []
    for i in which:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at[i] : at[i + 1]]), np.uint8)
        width = np.dtype(_KINDS[i]).itemsize
        out.append(raw if width == 1 else np.ascontiguousarray(raw.reshape(width, -1).T).view(_KINDS[i]).ravel())
    return out


def _row(ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, start: np.ndarray, pieces: list[bytes], anchor: np.ndarray) -> bytes:
    """Occurrences in order of their documents: of segment ``pieces[k]`` in document ``doc[k]`` at ``start[k]``."""
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
    new = np.diff(np.maximum.accumulate(which), prepend=-1) > 0
    present, count = np.unique(doc, return_counts=True)
    head = np.cumsum(count) - count
    step = np.diff(start, prepend=0)
    step[head] = start[head]
    length = np.fromiter(map(len, known), np.int64, len(known))
    return _pack([ids[present], marks[present], count, step, np.where(new, 0, which + 1), length, anchor[new], np.frombuffer(b"".join(known), np.uint8)])


def _which(ref: np.ndarray) -> np.ndarray:
    new = ref == 0
    return np.where(new, np.cumsum(new) - 1, ref.astype(np.int64) - 1)


def shard_rows(docs: DataFrame, shards: int, window: int) -> DataFrame:
    """(shard, data): the segments of a batch of documents that belong to a shard."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for batch in it:
            for row in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), as_bytes(batch, "text"), strict=True):
                if len(row[2]) < window:
                    continue
                held.append(row)
                size += len(row[2])
                if size >= BATCH_BYTES:
                    yield from deal(held)
                    held, size = [], 0
        if held:
            yield from deal(held)

    def deal(rows: list[tuple]) -> Iterator[tuple]:
        texts = [t for _, _, t in rows]
        ids, marks = np.array([i for i, _, _ in rows], np.int64), np.array([k for _, k, _ in rows], np.int32)
        doc, start, length, anchor = segments(texts, window)
        shard = (((anchor.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1)) if shards <= len(order) else None
        groups = np.split(order, edges[1:-1]) if edges is not None else np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)
        for own in groups:
            if not len(own):
                continue
            d, s, n = doc[own], start[own], length[own]
            pieces = [texts[i][a:b] for i, a, b in zip(d.tolist(), s.tolist(), (s + n).tolist(), strict=True)]
            yield int(shard[own[0]]), _row(ids, marks, d, s, pieces, anchor[own])

    return map_rows(docs, cut, "shard int, data binary", 16)


class Shard:
    """The spooled rows of one shard."""

    def __init__(self, level: int = 0, spool: int | None = None):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES if spool is None else spool)
        self.level = level
        self.at: list[tuple[int, int]] = []

    def add(self, data: bytes) -> None:
        self.at.append((self.file.tell(), len(data)))
        self.file.write(data)

    def rows(self) -> Iterator[bytes]:
        for at, n in self.at:
            self.file.seek(at)
            yield self.file.read(n)

    def close(self) -> None:
        self.file.close()

    def covered(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(id, mark, start, end) of covered intervals."""
        total = sum(int(_unpack(r, [5])[0].sum(dtype=np.int64)) for r in self.rows())
        if total <= SLICE_BYTES or self.level == MOST_LEVELS:
            yield from self._sorted(window)
            return
        files = self._split(min(MOST_FILES, -(-2 * total // SLICE_BYTES)), window)
        while files:
            part = files.pop()
            if part.at:
                yield from part.covered(window)
            part.close()

    def _split(self, n: int, window: int) -> list[Shard]:
        """The same windows, cut by the anchors of another hash and dealt by them: equal windows meet again."""
        files = [Shard(self.level + 1, SPOOL_BYTES // n) for _ in range(n)]
        for r in self.rows():
            ids, marks, count, step, ref, length, _, data = _unpack(r, range(8))
            end = np.cumsum(length, dtype=np.int64)
            raw, which, start = data.tobytes(), _which(ref), _starts(step, count)
            doc = np.repeat(np.arange(len(ids)), count)
            of, begin, size, anchor = segments([raw[a:b] for a, b in zip((end - length).tolist(), end.tolist(), strict=True)], window, self.level + 1)
            file = (anchor.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(n)
            base = (end - length)[of] + begin
            pieces = [raw[a:b] for a, b in zip(base.tolist(), (base + size).tolist(), strict=True)]
            for k in np.unique(file).tolist():
                own = np.flatnonzero(file == k)
                first = np.searchsorted(of[own], np.arange(len(length)))
                several = np.diff(np.append(first, len(own)))[which]  # parts of each occurrence's segment that go to this file
                part = own[np.repeat(first[which] - (np.cumsum(several) - several), several) + np.arange(int(several.sum()))]
                at = np.repeat(start, several) + begin[part]
                files[k].add(_row(ids, marks, np.repeat(doc, several), at, [pieces[i] for i in part.tolist()], anchor[part]))
        return files

    def _sorted(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        shared = self._shared()
        known: dict[bytes, int] = {}
        anchor_of: list[np.ndarray] = []
        with tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES) as occurrences:
            parts: list[int] = []
            for r in self.rows():
                ids, marks, count, step, ref, length, anchor, data = _unpack(r, range(8))
                end = np.cumsum(length, dtype=np.int64)
                own = np.flatnonzero(_among(anchor, shared))
                raw, before = data.tobytes(), len(known)
                number = np.full(len(length), -1, np.int64)
                number[own] = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip((end - length)[own].tolist(), end[own].tolist(), strict=True)), np.int64, len(own))
                fresh = own[number[own] >= before]
                anchor_of.append(anchor[fresh])
                which = number[_which(ref)]
                mine = np.flatnonzero(which >= 0)
                columns = which[mine], np.repeat(ids, count)[mine], np.repeat(marks, count)[mine].astype(np.int64), _starts(step, count)[mine]
                for a in range(0, len(mine), OCCURRENCES):
                    part = np.stack([c[a : a + OCCURRENCES] for c in columns])
                    occurrences.write(part.tobytes())
                    parts.append(part.shape[1])
            if not known:
                return

            def read() -> Iterator[np.ndarray]:
                occurrences.seek(0)
                for n in parts:
                    yield np.frombuffer(occurrences.read(32 * n), np.int64).reshape(4, n)

            distinct = list(known)
            del known
            size = np.fromiter(map(len, distinct), np.int64, len(distinct))
            smallest = np.full(len(distinct), np.iinfo(np.int64).max)
            for which, ids, _, _ in read():
                np.minimum.at(smallest, which, ids)
            _, group, n = np.unique(np.concatenate(anchor_of), return_inverse=True, return_counts=True)
            several = n[group] > 1
            sorted_ = np.flatnonzero(several)
            at = np.full(len(distinct), -1, np.int64)
            if len(sorted_):
                at[sorted_] = np.cumsum(size[sorted_] + 1) - size[sorted_] - 1
                values, best = _best([distinct[i] for i in sorted_.tolist()], smallest[sorted_], size[sorted_], window)
            del distinct
            for which, ids, marks, start in read():
                # A segment alone with its anchor shares no window with another one.
                alone = ~several[which] & (smallest[which] < ids)
                yield ids[alone], marks[alone], start[alone], start[alone] + size[which[alone]]
                part = np.flatnonzero(several[which])
                if len(part):
                    yield _compare(values, best, at[which[part]], size[which[part]] - window + 1, ids[part], marks[part], start[part], window)

    def _shared(self) -> np.ndarray:
        """Anchors that two or more ids have."""
        found = []
        for r in self.rows():
            ids, count, ref, anchor = _unpack(r, [0, 2, 4, 6])
            which, ids = _which(ref), np.repeat(ids, count)
            found.append(_least_and_most(anchor[which], ids, ids))
        anchor, least, most = _least_and_most(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return anchor[least != most]


def _starts(step: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.cumsum(step, dtype=np.int64)
    head = np.cumsum(count, dtype=np.int64) - count
    return total - np.repeat(total[head] - step[head], count)


def _least_and_most(anchor: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor."""
    order = np.argsort(anchor, kind="stable")
    anchor = anchor[order]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return anchor[first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)


def _among(anchor: np.ndarray, shared: np.ndarray) -> np.ndarray:
    if not len(shared):
        return np.zeros(len(anchor), bool)
    return shared[np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)] == anchor


def _best(distinct: list[bytes], smallest: np.ndarray, size: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and, at each place of the joined segments, the number of the smallest that has the window there."""
    text = np.frombuffer(b"\xff".join(distinct) + b"\xff", np.uint8) + np.uint8(1)  # UTF-8 has no byte FF, so 0 ends a segment
    values, rank = np.unique(smallest, return_inverse=True)
    own = np.repeat(rank.astype(np.int32), size + 1)
    best = own.copy()
    open_ = np.zeros(0, np.int64)

    def close(pos: np.ndarray, first: np.ndarray) -> None:
        n = np.diff(np.append(first, len(pos)))
        if (n > 1).any():
            best[pos] = np.repeat(np.minimum.reduceat(own[pos], first), n)

    for pos, lcp in suffix_order(text, window):
        new = np.flatnonzero(lcp < window)
        if not len(new):
            open_ = np.concatenate([open_, pos])
            continue
        joined = np.concatenate([open_, pos[: new[-1]]])
        if len(joined):
            close(joined, np.concatenate([[0] if len(open_) or new[0] else [], new[:-1] + len(open_)]).astype(np.int64))
        open_ = pos[new[-1] :]
    if len(open_):
        close(open_, np.zeros(1, np.int64))
    return values, best


def _compare(values: np.ndarray, best: np.ndarray, at: np.ndarray, windows: np.ndarray, ids: np.ndarray, marks: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    head = np.cumsum(windows) - windows
    offset = np.arange(int(windows.sum())) - np.repeat(head, windows)
    hit = values[best[np.repeat(at, windows) + offset]] < np.repeat(ids, windows)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin = hit & ((edge[:-1] == 1) | (offset == 0))
    follows = np.append(offset[1:] == 0, True)
    finish = hit & ((edge[1:] == -1) | follows)
    a, b = np.flatnonzero(begin), np.flatnonzero(finish)
    owner = np.searchsorted(head, a, "right") - 1
    return ids[owner], marks[owner], start[owner] + offset[a], start[owner] + offset[b] + window


def covered(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, starts, stops): the merged covered intervals of each row that has any.

    The mark is a hash that tells rows with one id apart.
    """
    keyed = _keyed(docs, id_col, text_col).filter("doc_id is not null and text is not null")
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = int(min(MOST_SHARDS, max(1, -(-total // SHARD_TEXT_BYTES))))
    dealt = shard_rows(keyed, shards, window).repartitionById(shards, "shard")

    def sort(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in it:
            for data in batch.column("data").to_pylist():
                shard.add(data)
        if shard.at:
            for found in shard.covered(window):
                for i in range(0, len(found[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000].astype(t)) for x, t in zip(found, ("i8", "i4", "i8", "i8"), strict=True)], names=["doc_id", "mark", "start", "stop"])
        shard.close()
        trim()

    found = dealt.mapInArrow(sort, "doc_id long, mark int, start long, stop long")

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, starts, stops = None, [], []
        for batch in it:
            for *k, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "start", "stop")), strict=True):
                if k != key:
                    if starts:
                        yield *key, starts, stops
                    key, starts, stops = k, [a], [b]
                elif a <= stops[-1]:
                    stops[-1] = max(stops[-1], b)
                else:
                    starts.append(a)
                    stops.append(b)
        if starts:
            yield *key, starts, stops

    return map_rows(found.repartition("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "start"), merge, "doc_id long, mark int, starts array<long>, stops array<long>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    a, b = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(a.alias("doc_id"), b.alias("text"), F.hash(a, b).alias("mark"))


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    tune(docs.sparkSession)
    spans = written(covered(docs, id_col=id_col, text_col=text_col, window=window), "repeat-spans")
    size = spans.agg(F.coalesce(F.sum(F.size("starts") * 16 + 48), F.lit(0))).first()[0]
    joined = _keyed(docs, id_col, text_col).join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, ["doc_id", "mark"], "left")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            for doc_id, text, starts, stops in zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True):
                edges = [0, *(x for s in zip(starts or [], stops or [], strict=True) for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                yield doc_id, kept, len(text), len(text) - len(kept), len(starts or [])

    return map_rows(joined, cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long", 200)


def report(docs: DataFrame, **options) -> DataFrame:
    return remove(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]], window: int = WINDOW) -> list[tuple[int, int, int, int, str]]:
    """For tests: the same by a table of all windows."""
    least: dict[bytes, int] = {}
    for i, t in rows:
        for k in range(len(t) - window + 1):
            s = t[k : k + window]
            least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if least[t[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out
