"""External induced suffix sorting of one shard, with common-prefix values.

The text is an array of symbols 1 and up in which 0 ends every segment.  Suffixes are of type S if smaller than
the next one, else L; the first S of each run (LMS) are sorted first, the others follow by induction: a scan in
ascending order passes every sorted suffix's predecessor of type L to the bucket of its symbol, a scan in
descending order those of type S.  Buckets are the levels of a monotone priority queue: the key is (symbol, rank of
the rest), and as the scan hands over rests in order, a level is a first-in-first-out list of tuples (position,
common prefix with the one before), kept in memory up to ``MEMORY`` bytes and on disk beyond.  The common prefix of
two neighbours in a bucket is one more than the least one between their rests, found by range minima over the
batch and a running minimum per bucket across batches.

LMS suffixes are sorted by rounds of renaming: tuples (name, next eight symbols, position) are sorted and those
still tied get new names, until all differ or ``depth`` symbols are compared; equal ones keep an arbitrary order.
Common prefixes are exact up to ``depth`` - 8, all that equality of windows asks for.  Beyond ``MEMORY`` the tuples
are sorted range by range of their first word, and the text and its types are mapped from disk.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

MEMORY = 96 << 20
CHUNK = 1 << 20


class Levels:
    """Lists of (position, common prefix) by symbol, in order of arrival; the oldest go to disk beyond ``memory``."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.lists: list[list] = [[] for _ in range(256)]
        self.file = None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.lists[symbol].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.lists:
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    parts[i] = (at, len(part[0]), part[0].dtype)
        self.held = 0

    def _load(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            return part
        at, n, dtype = part
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * dtype.itemsize), dtype), np.frombuffer(self.file.read(n), np.uint8)

    def drain(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The level's tuples, also those pushed while it is drained; small neighbours come together."""
        parts = self.lists[symbol]
        while parts:
            group, n = [], 0
            while parts and n < CHUNK:
                part = parts.pop(0)
                if isinstance(part[0], np.ndarray):
                    self.held -= part[0].nbytes + part[1].nbytes
                group.append(self._load(part))
                n += len(group[-1][0])
            yield np.concatenate([p for p, _ in group]), np.concatenate([v for _, v in group])

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The level's tuples, last first, with the common prefix of each and the one that came after it."""
        after = np.zeros(1, np.uint8)
        for part in reversed(self.lists[symbol]):
            pos, lcp = self._load(part)
            shifted = np.concatenate([lcp[1:], after])
            after = lcp[:1]
            yield pos[::-1], shifted[::-1]
        self.lists[symbol] = []

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def mapped(dtype, n: int, memory: int) -> np.ndarray:
    """An array in memory, or on disk where it would be large."""
    if n * np.dtype(dtype).itemsize <= memory or not n:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(dtype).itemsize)
        return np.memmap(f, dtype, "r+", shape=(n,))


def codes(text: np.ndarray, memory: int = MEMORY) -> np.ndarray:
    """Symbol, plus 256 if the suffix is of type S."""
    n = len(text)
    out = mapped(np.uint16, n, memory)
    is_s = True  # the last 0
    for b in range(n, 0, -CHUNK):
        a = max(0, b - CHUNK)
        here = text[a:b].astype(np.int16)
        after = np.append(here[1:], text[b] if b < n else -1).astype(np.int16)
        sign = np.sign(after - here).astype(np.int8)
        if b == n:
            sign[-1] = 1
        decided = np.where(sign != 0, np.arange(b - a), b - a)
        decided = np.minimum.accumulate(decided[::-1])[::-1]
        kinds = np.append(sign > 0, is_s)[decided]
        out[a:b] = here + (kinds.astype(np.int16) << 8)
        is_s = bool(kinds[0])
    return out


def lms(code: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of LMS suffixes, in order of the text."""
    for a in range(0, len(code), CHUNK):
        s = np.asarray(code[max(0, a - 1) : a + CHUNK]) >= 256
        yield np.flatnonzero(s[1:] & ~s[:-1]) + max(0, a - 1) + 1


def _leading(x: np.ndarray) -> np.ndarray:
    """Equal leading bytes of words whose difference is x."""
    out = np.zeros(len(x), np.uint8)
    for k in range(1, 8):
        out += x < np.uint64(1 << (64 - 8 * k))
    return out


def sort_lms(text: np.ndarray, code: np.ndarray, depth: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """LMS suffixes in order, with common prefixes, in batches by ranges of their first eight symbols."""
    n = len(text) - 8 * (depth // 8 + 1)  # the text is padded by 0
    word = np.ndarray(shape=(len(text) - 7,), dtype=">u8", buffer=text, strides=(1,)) if not isinstance(text, np.memmap) else None

    def words(at: np.ndarray) -> np.ndarray:
        if word is not None:
            return word[at].astype(np.uint64)
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | text[at + k]
        return out

    total, sample = 0, []
    for at in lms(code[:n]):
        total += len(at)
        if len(at):
            sample.append(words(at[:: max(1, len(at) // 256)]))
    passes = max(1, -(-total * 48 // memory))
    ordered = np.sort(np.concatenate(sample)) if sample else np.zeros(0, np.uint64)
    cuts = np.unique(ordered[np.arange(1, passes) * len(ordered) // passes]) if passes > 1 and len(ordered) else np.zeros(0, np.uint64)
    for k in range(len(cuts) + 1):
        chosen = []
        for at in lms(code[:n]):
            if len(cuts):
                at = at[np.searchsorted(cuts, words(at), "right") == k]
            chosen.append(at)
        at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        if len(at):
            yield _rename(at, words, depth)


def _rename(at: np.ndarray, words: Callable, depth: int) -> tuple[np.ndarray, np.ndarray]:
    lcp = np.full(len(at), min(depth, 255), np.uint8)
    key = words(at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    tied, name, done = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while True:
        new = np.ones(len(key), bool)
        differ = key[1:] ^ key[:-1]
        same = name[1:] == name[:-1]
        new[1:] = ~same | (differ != 0)
        split = np.flatnonzero(same & (differ != 0)) + 1
        lcp[tied[split]] = done + _leading(differ[split - 1])
        done += 8
        block = np.cumsum(new) - 1
        more = np.bincount(block)[block] > 1
        if done >= depth or not more.any():
            break
        tied, name = tied[more], block[more]
        key = words(at[tied] + done)
        order = np.lexsort((key, name))
        at[tied], key = at[tied][order], key[order]
    lcp[:1] = 0
    return at, lcp


class Scan:
    """One pass: takes batches in order, hands predecessors to their buckets."""

    def __init__(self, code: np.ndarray, out: Levels, down: bool, cap: int):
        self.code, self.out, self.down, self.cap = code, out, down, cap
        self.since = np.full(256, cap, np.uint8)  # least common prefix since a bucket's last arrival
        self.started = np.zeros(256, bool)

    def batch(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        code = self.code[before]
        mine = np.flatnonzero((code >= 256) == self.down)
        total = int(lcp.min()) if len(lcp) else self.cap
        if not len(mine):
            np.minimum(self.since, total, out=self.since)
            return
        target = (code[mine] & 255).astype(np.uint8)
        order = np.argsort(target, kind="stable")
        target, at = target[order], mine[order]
        first = np.concatenate([[True], target[1:] != target[:-1]])
        start = np.concatenate([[0], at[:-1] + 1])
        start[first] = 0
        least = _range_min(lcp, start, at)
        heads = np.flatnonzero(first)
        symbols = target[heads]
        least[heads] = np.minimum(least[heads], self.since[symbols])
        value = np.minimum(least.astype(np.int16) + 1, self.cap).astype(np.uint8)
        value[heads] = np.where(self.started[symbols], value[heads], 0)
        ends = np.append(heads[1:], len(target))
        tail = np.minimum.accumulate(np.append(lcp[1:], np.uint8(self.cap))[::-1])[::-1]
        np.minimum(self.since, total, out=self.since)
        self.since[symbols] = tail[at[ends - 1]]
        self.started[symbols] = True
        sources = before[at]
        for s, a, b in zip(symbols.tolist(), heads.tolist(), ends.tolist(), strict=True):
            self.out.push(s, sources[a:b], value[a:b])


def _range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of values[start..end], both included."""
    n = end - start + 1
    level = np.frexp(n.astype(np.float64))[1] - 1
    table, out = values, np.empty(len(n), np.uint8)
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[start[own]], table[end[own] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def _common(text: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = np.asarray(text[a : a + cap]), np.asarray(text[b : b + cap])
    m = min(len(x), len(y))
    same = x[:m] == y[:m]
    return m if same.all() else int(np.argmin(same))


def suffix_order(symbols: np.ndarray, window: int, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes that do not start with 0 in descending order: (positions, common prefix of each with the one before).

    Common prefixes are exact up to ``window`` and capped there.
    """
    depth = -(-window // 8) * 8 + 8
    if window > 240:
        raise ValueError("windows of at most 240 symbols")
    n = len(symbols)
    if not n:
        return
    text = mapped(np.uint8, n + depth + 16, memory)
    text[:n] = symbols
    code = codes(text[:n], memory)
    padded = mapped(np.uint16, n + depth + 16, memory)
    padded[:n] = code
    kind = np.uint32 if n < 1 << 32 else np.int64
    cap = window

    stars = Levels(memory)
    last = None
    for pos, lcp in sort_lms(text, padded, depth, memory):
        if last is not None:
            lcp[0] = _common(text, last, int(pos[0]), cap)
        last = int(pos[-1])
        first = np.asarray(text[pos])
        edges = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1, [len(pos)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            values = np.minimum(lcp[a:b], cap)
            stars.push(int(first[a]), pos[a:b].astype(np.int64), values)

    large = Levels(memory)
    kept = Levels(memory)
    up = Scan(code, large, False, cap)
    for c in range(256):
        last = None
        for pos, lcp in large.drain(c):
            kept.push(c, pos.astype(kind), lcp)
            up.batch(pos, lcp)
            last = int(pos[-1])
        for pos, lcp in stars.drain(c):
            if last is not None:
                lcp = lcp.copy()
                lcp[0] = _common(text, last, int(pos[0]), cap)
                last = None
            up.batch(pos, lcp)
    stars.close()
    large.close()

    small = Levels(memory)
    down = Scan(code, small, True, cap)
    for c in range(255, 0, -1):
        last = None
        for pos, lcp in small.drain(c):
            yield pos, lcp
            down.batch(pos, lcp)
            last = int(pos[-1])
        for pos, lcp in kept.backwards(c):
            pos = pos.astype(np.int64)
            lcp = lcp.copy()
            if last is not None:
                lcp[0] = _common(text, last, int(pos[0]), cap)
            yield pos, lcp
            down.batch(pos, lcp)
            last = None
    kept.close()
    small.close()
