"""Raw texts as source rows, before anything is paid for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped id that follows from its parts, the same on every attempt."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def capture(rows: DataFrame, run: str, *, tenant: str, graph: str, origin: str = "text", content: str = "content", ref: str = "external_ref") -> DataFrame:
    """Source rows with status pending; the id follows from the run, the reference and the text."""
    return rows.select(
        F.lit(tenant).alias("tenant_id"), F.lit(graph).alias("graph_id"),
        uuid_of(F.lit(run), F.coalesce(F.col(ref), F.lit("")), F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).alias("source_id"),
        F.lit(origin).alias("origin"), F.col(content).alias("raw_content"), F.col(ref).alias("external_ref"), F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit("pending").alias("extraction_status"), F.lit(None).cast("string").alias("extraction_error"), F.current_timestamp().alias("created_at"),
    )


def latest(log: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The last row of each key in an append-only log."""
    return log.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values], F.max(order).alias(order))
