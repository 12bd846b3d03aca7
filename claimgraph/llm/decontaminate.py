"""Benchmark decontamination with suffix arrays over the training text.

Every batch of documents is a shard: its words, as numbers of the benchmark's vocabulary, get a suffix array, and
every suffix of every benchmark item is binary-searched in it.  The search gives the range of training suffixes
that start with an item's window, so each occurrence and its place, and from the range's neighbours the longest
verbatim match of the suffix.  Each place found is searched in the benchmark's own suffix array in turn, which gives a
document's longest verbatim match and where both stand.  A word outside the vocabulary, and a document's end, is smaller than all words and
matches nothing; suffixes that meet one before the shortest window's length can hold no match and are left out of
the array.  Results are complete per document, so nothing is shuffled, however many documents share a passage.

The benchmark is read in blocks of at most ``BLOCK_BYTES`` of text, each sent to the executors on its own and
searched in turn; what a task holds is one block and one shard, whatever the size of either table.

Words are lower-cased for A to Z; separators are the ASCII characters other than letters and digits.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: a null or empty text has no words; an item with none is in no document; null and repeated ids are
kept, each row judged for itself; items with equal texts are each reported; an item with a null id is searched and
hits words, but is not listed; empty tables give no rows, or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, id_text, map_rows, to_batch, tune, written

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_word long, longest_item long, longest_item_word long"
MATCH = "doc_id long, doc_word long, item_id long, item_word long, length long"

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


#: A name of its own, and a prepared block, pickled.
Sent = tuple[str, Broadcast]


class SuffixArray:
    """Suffixes of an array of word numbers, 0 being the word that equals nothing, to the depth of their next 0."""

    def __init__(self, numbers: np.ndarray, shortest: int, step: int):
        self.step = step  # words compared at once, in 64 bits
        self.numbers = np.concatenate([numbers.astype(np.uint64), np.zeros(step, np.uint64)])
        zero = np.flatnonzero(self.numbers == 0)
        run = zero[np.searchsorted(zero, np.arange(len(numbers)))] - np.arange(len(numbers)) if len(numbers) else np.zeros(0, np.int64)
        self.run = run
        self.at = self._sort(np.flatnonzero(run >= shortest))

    def key(self, at: np.ndarray, depth: int) -> np.ndarray:
        """``step`` words from ``depth`` on, as one number; words at or beyond a suffix's end count as 0."""
        bits = 64 // self.step
        out = np.zeros(len(at), np.uint64)
        for k in range(depth, depth + self.step):
            inside = self.run[at] > k
            out = (out << np.uint64(bits)) | np.where(inside, self.numbers[np.where(inside, at + k, 0)], np.uint64(0))
        return out

    def _sort(self, at: np.ndarray) -> np.ndarray:
        at = at[np.argsort(self.run[at], kind="stable")]  # of suffixes equal to the end of one, that one stays first
        todo = [(0, len(at))] if len(at) > 1 else []
        tied = np.arange(len(at))
        group = np.zeros(len(at), np.int64)
        depth = 0
        while todo:
            key = self.key(at[tied], depth)
            order = np.lexsort((key, group))
            at[tied] = at[tied][order]
            key = key[order]
            start = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
            block = np.cumsum(start) - 1
            more = (np.bincount(block)[block] > 1) & (self.run[at[tied]] > depth + self.step)
            tied, group = tied[more], block[more]
            depth += self.step
            todo = [1] if len(tied) else []
        return at


@dataclass
class Block:
    """Some of the benchmark, ready to be searched."""

    vocabulary: dict[bytes, int]
    items: list[int | None]
    numbers: np.ndarray  # the items' words, each item followed by a 0
    start: np.ndarray  # per window: its place in numbers
    size: np.ndarray  # per window: its words
    owners: list[tuple[int, ...]]  # per window: the items that have it
    suffixes: SuffixArray
    window: int

    def all_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the windows of all items, those met before included."""
        ends = np.flatnonzero(self.numbers == 0)
        length = np.repeat(np.diff(ends, prepend=-1), np.diff(ends, prepend=-1)) - 1
        size, left = np.minimum(length, self.window), self.suffixes.run
        place = np.flatnonzero((left >= size) & (left > 0))
        return place, size[place]

    @property
    def shortest(self) -> int:
        return int(self.size.min()) if len(self.size) else 1


def prepare(rows: list[tuple[int | None, bytes]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    texts = [words(t) for _, t in rows]
    for t in texts:
        for w in t:
            vocabulary.setdefault(w, len(vocabulary) + 1)
    flat: list[int] = []
    found: dict[tuple[int, ...], tuple[int, set[int]]] = {}
    for i, t in enumerate(texts):
        base, numbers = len(flat), [vocabulary[w] for w in t]
        size = min(window, len(numbers))
        for k in range(len(numbers) - size + 1 if size else 0):
            found.setdefault(tuple(numbers[k : k + size]), (base + k, set()))[1].add(i)
        flat += [*numbers, 0]
    numbers = np.array(flat, np.int64)
    return Block(vocabulary, [r[0] for r in rows], numbers, np.array([s for s, _ in found.values()], np.int64), np.array([len(k) for k in found], np.int64), [tuple(sorted(o)) for _, o in found.values()], SuffixArray(numbers, 1, 4 if len(vocabulary) < 1 << 16 else 2), window)


def blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> list[Sent]:
    """Broadcasts of the prepared benchmark; the driver holds one block of texts at a time."""
    spark = benchmark.sparkSession
    out, rows, size = [], [], 0

    def send() -> None:
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps(prepare(rows, window)))))

    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        text = (r["t"] or "").encode()
        if rows and size + len(text) > BLOCK_BYTES:
            send()
            rows, size = [], 0
        rows.append((r["i"], text))
        size += len(text)
    if rows:
        send()
    return out


class Search:
    """One shard against one block: the ranges of training suffixes of all windows, and the longest matches."""

    def __init__(self, texts: list[list[bytes]], block: Block):
        self.block = block
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        numbers = np.zeros(int(self.starts[-1]), np.int64)
        get = block.vocabulary.get
        for s, t in zip(self.starts, texts, strict=False):
            numbers[s : s + len(t)] = np.fromiter(map(get, t, repeat(0)), np.int64, len(t))
        self.bench = block.suffixes
        self.array = SuffixArray(numbers, block.shortest, self.bench.step)

    def _bound(self, place: np.ndarray, size: np.ndarray, right: bool, inside: bool = True) -> np.ndarray:
        """Per query, the number of suffixes that are smaller (or, cut to its size, not greater): of benchmark suffixes
        among the training suffixes (``inside``), or the other way round."""
        sorted_, asked = (self.array, self.bench) if inside else (self.bench, self.array)
        at = sorted_.at
        low, high = np.zeros(len(place), np.int64), np.full(len(place), len(at), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) // 2
            sign = self._compare(sorted_, at[mid], asked, place[open_], size[open_])
            up = sign <= 0 if right else sign < 0
            low[open_[up]] = mid[up] + 1
            high[open_[~up]] = mid[~up]
        return low

    def _compare(self, sorted_: SuffixArray, at: np.ndarray, asked: SuffixArray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sign of (sorted suffix, cut to size) against (query, cut to size)."""
        out = np.zeros(len(at), np.int64)
        todo, depth = np.arange(len(at)), 0
        while len(todo):
            a, b = self._cut(sorted_, at[todo], size[todo], depth), self._cut(asked, place[todo], size[todo], depth)
            out[todo] = (a > b).astype(np.int64) - (a < b)
            depth += self.array.step
            todo = todo[(a == b) & (size[todo] > depth)]
        return out

    @staticmethod
    def _cut(array: SuffixArray, at: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
        key = array.key(at, depth)
        beyond = np.clip(depth + array.step - size, 0, array.step) * (64 // array.step)
        whole = beyond >= 64
        return np.where(whole, np.uint64(0), (key >> beyond.astype(np.uint64) % np.uint64(64)) << beyond.astype(np.uint64) % np.uint64(64))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in the shard) of all occurrences."""
        b = self.block
        if not len(b.start) or not len(self.array.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self._bound(b.start, b.size, False), self._bound(b.start, b.size, True)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        ranks = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return which, self.array.at[ranks]

    def longest(self) -> Iterator[tuple[int, int, int]]:
        """(place in the block, place in the shard, words): all places of each benchmark suffix's longest match, of window size at least."""
        at = self.array.at
        place, size = self.block.all_windows()
        if not len(place) or not len(at):
            return
        place = place[self._bound(place, size, True) > self._bound(place, size, False)]
        rank = self._bound(place, self.bench.run[place], False)
        size = np.array([max(self._common(int(at[k]), p) for k in (r - 1, r) if 0 <= k < len(at)) for r, p in zip(rank.tolist(), place.tolist(), strict=True)], np.int64)
        for p, n, low, high in zip(place.tolist(), size.tolist(), self._bound(place, size, False).tolist(), self._bound(place, size, True).tolist(), strict=True):
            for k in at[low:high].tolist():
                yield p, k, n

    def _common(self, at: int, place: int) -> int:
        n = int(min(self.array.run[at], self.bench.run[place]))
        same = self.array.numbers[at : at + n] == self.bench.numbers[place : place + n]
        return n if same.all() else int(np.argmin(same))

    def longest_of_documents(self, which: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int, int | None, int]]:
        """(document, words, its word, item, the item's word) of the longest match of each document with a window; of
        equally long ones the first in the document, then that of the least item.  A match is as long as a window at least."""
        if not len(places):
            return
        b, at = self.block, self.bench.at
        place, own = np.unique(places, return_inverse=True)
        size = np.zeros(len(place), np.int64)
        np.maximum.at(size, own, b.size[which])
        # A window of a whole short item ends with it; a full one may go on, by as much as with a neighbour of its rank.
        full = np.flatnonzero(size == b.window)
        rank = self._bound(place[full], self.array.run[place[full]], False, inside=False)
        for k in (rank - 1, rank):
            some = (k >= 0) & (k < len(at))
            size[full[some]] = np.maximum(size[full[some]], self._commons(place[full[some]], at[k[some]]))
        doc = self.document(place)
        order = np.lexsort((place, -size, doc))
        first = order[np.concatenate([[True], np.diff(doc[order]) > 0])]
        low, high = (self._bound(place[first], size[first], right, inside=False) for right in (False, True))
        ends = np.flatnonzero(b.numbers == 0)
        begins = np.concatenate([[0], ends[:-1] + 1])
        for f, lo, hi in zip(first.tolist(), low.tolist(), high.tolist(), strict=True):
            spots = at[lo:hi]
            item = np.searchsorted(ends, spots)
            # A short match is a window only where it is a whole item.
            kept = (size[f] >= b.window) | (ends[item] - begins[item] == size[f])
            names = [((b.items[i] is None, b.items[i] or 0), s - int(begins[i])) for i, s in zip(item[kept].tolist(), spots[kept].tolist(), strict=True)]
            (null, name), word = min(names)
            yield int(doc[f]), int(size[f]), int(place[f] - self.starts[doc[f]]), None if null else name, word

    def _commons(self, place: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Words that training and benchmark suffixes share, pair by pair."""
        most = np.minimum(self.array.run[place], self.bench.run[other])
        out, todo = np.zeros(len(place), np.int64), np.arange(len(place))
        while len(todo := todo[out[todo] < most[todo]]):
            todo = todo[self.array.numbers[place[todo] + out[todo]] == self.bench.numbers[other[todo] + out[todo]]]
            out[todo] += 1
        return out

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts exceed SHARD_BYTES; one longer text is a shard of its own."""
    for batch in it:
        sizes = np.array([len(x) for x in as_bytes(batch, "text")], np.int64)
        i, total = 0, 0
        for j, n in enumerate(sizes):
            if j > i and total + n > SHARD_BYTES:
                yield batch.slice(i, j - i)
                i, total = j, 0
            total += n
        if len(sizes):
            yield batch.slice(i)


def _judge(texts: list[list[bytes]], sent: list[Sent]) -> tuple[np.ndarray, list[set[str]], list[tuple]]:
    """Per document: hit words, the items whose windows occur, and the longest match (words, word, item, item's word)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    change = np.zeros(int(starts[-1]) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    longest: list[tuple] = [(0, None, None, None)] * len(texts)
    rank = lambda m: (-m[0], m[1], m[2] is None, m[2] or 0, m[3])
    for block in map(_loaded, sent):
        search = Search(texts, block)
        which, places = search.windows()
        np.add.at(change, places, 1)
        np.subtract.at(change, places + block.size[which], 1)
        doc = search.document(places)
        for d, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
            items[d] |= {str(block.items[i]) for i in block.owners[w] if block.items[i] is not None}
        for d, *found in search.longest_of_documents(which, places):
            longest[d] = min(tuple(found), longest[d], key=rank) if longest[d][0] else tuple(found)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
    return hit[starts[1:] - 1] - hit[starts[:-1]], items, longest


_cache: dict[str, Block] = {}


def _loaded(sent: Sent) -> Block:
    """The last block is kept unpickled: with one block in all, each worker loads it once."""
    name, broadcast = sent
    if name not in _cache:
        _cache.clear()
        _cache[name] = pickle.loads(broadcast.value)
    return _cache[name]


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest verbatim match: its words, the
    word of the document where it begins, the item that has it and the item's word (0 and nulls without a window)."""
    tune(docs.sparkSession)
    sent = blocks(benchmark, id_col=item_col, text_col=item_text, window=window)
    schema = arrow_schema(RESULT)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(it):
            texts = [words(t) for t in as_bytes(shard, "text")]
            hits, items, longest = _judge(texts, sent)
            yield to_batch(schema, [
                (d, len(t), int(h), len(i), hashlib.sha256(",".join(sorted(i)).encode()).hexdigest(), bool(h), *m)
                for d, t, h, i, m in zip(shard.column("doc_id").to_pylist(), texts, hits, items, longest, strict=True)
            ])

    return id_text(docs, id_col, text_col).mapInArrow(run, RESULT)


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Per benchmark suffix with a window in the training text: its longest verbatim match, at every place that has it."""
    tune(docs.sparkSession)
    sent = blocks(benchmark, id_col=item_col, text_col=item_text, window=window)

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for shard in _shards(it):
            ids = shard.column("doc_id").to_pylist()
            texts = [words(t) for t in as_bytes(shard, "text")]
            for number, block in enumerate(map(_loaded, sent)):
                search = Search(texts, block)
                ends = np.flatnonzero(block.numbers == 0)
                for place, at, n in search.longest():
                    d, i = int(search.document(np.array([at]))[0]), int(np.searchsorted(ends, place))
                    yield ids[d], at - int(search.starts[d]), block.items[i], place - (int(ends[i - 1]) + 1 if i else 0), n, number, place

    found = written(map_rows(id_text(docs, id_col, text_col), find, MATCH + ", block long, place long"), "benchmark-matches")  # the longest of each shard
    best = found.groupBy("block", "place").agg(F.max("length").alias("length"))
    return found.join(best, ["block", "place", "length"]).select("doc_id", "doc_word", "item_id", "item_word", "length")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of the benchmark."""
    tune(docs.sparkSession)
    sent = blocks(benchmark, id_col=item_col, text_col=item_text, window=window)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            renamed = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_col)], names=["row", "text"])
            clean = [np.zeros(0, bool)]
            for shard in _shards([renamed]):
                hits, _, _ = _judge([words(t) for t in as_bytes(shard, "text")], sent)
                clean.append(hits == 0)
            yield batch.filter(pa.array(np.concatenate(clean)))

    return docs.mapInArrow(run, docs.schema)
