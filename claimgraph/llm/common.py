"""What the operators share: the shared folder, written tables, row keys and Arrow helpers.

Executors and the driver share only the folder named by ``spark.checkpoint.dir``; every intermediate table and
file of these operators lies below it, is written once under a name of its own and is read by path, so that a
lost executor costs a recomputed task and no result.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/claimgraph"
ARROW_BATCH_BYTES = 16 << 20


class Owner:
    """The folders made on behalf of one call."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def close(self) -> None:
        while self.folders:
            delete(self.spark, self.folders.pop())


_owner: ContextVar[Owner | None] = ContextVar("owner", default=None)


@contextmanager
def owned(spark: SparkSession) -> Iterator[Owner]:
    """Folders made within the block belong to it and are deleted at its end; those of others are never touched.

    Results are lazy: write what is to outlive the block elsewhere first.  Without an owner folders stay, below the
    shared folder, for whoever reads the result.
    """
    own = Owner(spark)
    token = _owner.set(own)
    try:
        yield own
    finally:
        _owner.reset(token)
        own.close()


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it belongs to the innermost ``owned`` block, if there is one."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _owner.get()) is not None:
        own.folders.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that the table does not have, whatever its own are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings to a Python worker, whatever the length of the texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") or 0) > ARROW_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BATCH_BYTES}b")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns; any others, whatever their names, are not read."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_key(*cols: str) -> Column:
    """A 128-bit key of a row's values, the same on every run."""
    whole = [F.col(c) for c in cols]
    return F.concat_ws("-", F.hex(F.xxhash64(*whole)), F.hex(F.xxhash64(F.lit("second"), *reversed(whole))))


def as_bytes(batch: pa.RecordBatch | pa.Table, name: str) -> list[bytes]:
    """A string column's values in UTF-8; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield to_batch(schema, buffer)
            buffer = []
    if buffer:
        yield to_batch(schema, buffer)


def to_batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a flat DDL schema."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str, size: int = 2000) -> DataFrame:
    """mapInArrow with a function that yields plain tuples."""
    schema = arrow_schema(ddl)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(schema, rows(it), size)

    return df.mapInArrow(run, ddl)


def trim() -> None:
    """Give freed memory back to the system; workers outlive the task that needed it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# Files of the shared folder, from driver and executors alike.


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


@contextmanager
def published(uri: str):
    """Write a file under another name and move it into place when whole; a repeated task replaces it by the same bytes."""
    fs, path = locate(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        yield out
    fs.move(draft, path)


@contextmanager
def opened(uri: str):
    fs, path = locate(uri)
    with fs.open_input_file(path) as f:
        yield f
