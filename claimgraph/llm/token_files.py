"""Token-id files: document boundaries in Elias-Fano form over one concatenated id array.

A corpus becomes shard files in ascending document order.  A shard holds the ids one after another, then a
footer: the documents' end offsets and their ids, both as Elias-Fano sequences.  Such a sequence of n values
below u takes about 2 + log2(u / n) bits a value; its select structure, one position in every ``SAMPLE`` set bits
(an eighth of a bit a value, as a position among at most 3 n bits fits 32), answers "where does document i start" by reading a few bytes, so that no table of 64-bit offsets is kept.

Documents are dealt to tasks by quantiles of their id, sorted there and streamed out; a task holds the boundaries
of one shard and one document's ids at a time.

Defined cases: a null or empty text is a document of the end id alone; documents with a null id come first and
keep null; repeated ids are kept, next to each other, in the order of their ids' bytes; an empty table gives
no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, map_rows, opened, published, shared_dir, tune, written
from .tokens import encoder

MAGIC = b"CGTOKEF2"
SAMPLE = 256
#: Target sizes; they bound what a task holds, not what is kept.
DOCS_PER_RANGE = 10_000
MOST_RANGES = 16_384
SHARD_TOKENS = 32_000_000
MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.samples = n, low_bits, samples
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, np.uint32))
        universe = int(v[-1]) + 1
        bits = max(0, (universe // n).bit_length() - 1)
        set_at = (v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(set_at[-1]) + 1, np.uint8)
        high[set_at.astype(np.int64)] = 1
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), cls._samples(set_at))

    @staticmethod
    def _samples(set_at: np.ndarray) -> np.ndarray:
        if int(set_at[-1]) >= 1 << 32:
            raise ValueError("a shard holds at most 2 ** 32 / 3 documents")
        return set_at[::SAMPLE].astype(np.uint32)

    def _low(self, i: int, j: int) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(j - i, np.uint64)
        first = i * b
        raw = np.unpackbits(self.low[first // 8 : (j * b + 7) // 8], bitorder="little")
        raw = raw[first % 8 : first % 8 + (j - i) * b].reshape(-1, b).astype(np.uint64)
        return raw @ (np.uint64(1) << np.arange(b, dtype=np.uint64))

    def decode(self, i: int, j: int) -> np.ndarray:
        """Values i to j (exclusive): the select structure finds the first, the bits between are read once."""
        if i >= j:
            return np.zeros(0, np.uint64)
        at = int(self.samples[i // SAMPLE])
        k = (j - 1) // SAMPLE + 1
        end = int(self.samples[k]) + 1 if k < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[at // 8 : (end + 7) // 8], bitorder="little")
        ones = np.flatnonzero(bits[at % 8 :])[i % SAMPLE : i % SAMPLE + j - i].astype(np.uint64) + np.uint64(at)
        return ((ones - np.arange(i, j, dtype=np.uint64)) << np.uint64(self.low_bits)) | self._low(i, j)

    def select(self, i: int) -> int:
        return int(self.decode(i, i + 1)[0])

    def dump(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, bits, nl, nh, ns = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        low, high, samples = data[at : at + nl], data[at + nl : at + nl + nh], data[at + nl + nh : at + nl + nh + 4 * ns]
        return cls(n, bits, low, high, np.frombuffer(samples, "<u4")), at + nl + nh + 4 * ns


class ShardWriter:
    """Streams documents, in ascending order of id with null ids first, to one file."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype = out, dtype
        self.ends: list[int] = []
        self.ids: list[int] = []
        self.nulls = self.total = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)
        self.total += len(ids) // self.dtype.itemsize
        self.ends.append(self.total)
        self.out.write(ids)

    def close(self) -> None:
        base = self.ids[0] if self.ids else 0
        relative = (np.array(self.ids, np.int64).astype(np.uint64) - np.array(base, np.int64).astype(np.uint64)).astype(np.uint64)
        head = json.dumps({"dtype": self.dtype.str, "docs": len(self.ends), "tokens": self.total, "null_ids": self.nulls, "base": base}).encode()
        footer = struct.pack("<I", len(head)) + head + EliasFano.of(np.array(self.ends, np.uint64)).dump() + EliasFano.of(relative).dump()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class ShardReader:
    """Random and sequential access to one file's documents."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file, or not a whole one")
        n = struct.unpack("<Q", tail[:8])[0]
        footer = self._at(size - 16 - n, n)
        k = struct.unpack_from("<I", footer)[0]
        head = json.loads(footer[4 : 4 + k])
        self.ends, at = EliasFano.load(footer, 4 + k)
        self.keys, _ = EliasFano.load(footer, at)
        self.dtype, self.n, self.nulls, self.base = np.dtype(head["dtype"]), head["docs"], head["null_ids"], head["base"]

    def _at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(n)

    def bounds(self, i: int, j: int) -> np.ndarray:
        """The starts of documents i to j - 1 and the end of the last."""
        ends = self.ends.decode(max(i - 1, 0), j).astype(np.int64)
        return np.concatenate([[0], ends]) if i == 0 else ends

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i, i + 1)
        w = self.dtype.itemsize
        return np.frombuffer(self._at(len(MAGIC) + int(a) * w, int(b - a) * w), self.dtype)

    def documents(self, block: int = 512) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in the file, ids) of each document in turn."""
        for i in range(0, self.n, block):
            j = min(self.n, i + block)
            bounds = self.bounds(i, j)
            keys = [None] * max(0, min(j, self.nulls) - i)
            keys += [self.base + int(x) for x in self.keys.decode(max(0, i - self.nulls), max(0, j - self.nulls))]
            for k, (a, b) in zip(keys, zip(bounds, bounds[1:], strict=False), strict=True):
                w = self.dtype.itemsize
                yield k, int(a), np.frombuffer(self._at(len(MAGIC) + int(a) * w, int(b - a) * w), self.dtype)


def _cuts(ids: DataFrame) -> list[int]:
    """Ids that cut the documents into ranges of about DOCS_PER_RANGE."""
    n = ids.count()
    ranges = min(MOST_RANGES, -(-n // DOCS_PER_RANGE))
    if ranges <= 1:
        return []
    at = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * ranges)).alias("q")).first()["q"]
    return sorted(set(found or []))


def write_files(docs: DataFrame, out: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Encode every text, append ``end_id`` and write the shards below ``out``; returns the manifest, one row per file."""
    tune(docs.sparkSession)
    docs = id_text(docs, id_col, text_col)
    cuts = np.array(_cuts(docs.select("doc_id")), np.int64)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = encoder(tokenizer)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in it:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode_all(batch.column("text")), strict=True):
                part = 0 if doc_id is None else int(np.searchsorted(cuts, doc_id, "right"))
                yield part, doc_id, ids + end

    coded = map_rows(docs, encode, "part int, doc_id long, ids binary", 200)
    dealt = coded.repartitionById(len(cuts) + 1, "part").sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_first(), F.col("ids"))
    dtype = encoder(tokenizer).dtype

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = ((p, d, i) for b in it for p, d, i in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True))
        row = next(rows, None)
        part, shard = None, 0
        while row is not None:
            part, shard = row[0], shard + 1 if row[0] == part else 0
            path = f"{out}/{part:06d}-{shard:05d}.tok"
            with published(path) as f:
                writer = ShardWriter(f, dtype)
                while row is not None and row[0] == part and writer.total < SHARD_TOKENS:
                    writer.add(row[1], row[2])
                    row = next(rows, None)
                writer.close()
            yield part, shard, path, len(writer.ends), writer.total

    return map_rows(dealt, write, MANIFEST)


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its id, the ids before it in the whole corpus, its number of ids and their CRC-32."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row per file
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with opened(path) as f:
                    for doc_id, start, ids in ShardReader(f).documents():
                        yield doc_id, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return map_rows(placed.repartition(n, "path"), read, DOCUMENT)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the token files of a corpus and read every document back from them."""
    out = shared_dir(docs.sparkSession, "token-files")
    return read_files(written(write_files(docs, out, **options), "token-manifest"))

