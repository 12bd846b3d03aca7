"""Beyond the batch interface: sources from a stream.

One micro-batch is one run.  A batch is idempotent by its number: its rows' ids follow from it and a batch that was
already captured is not captured again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.capture import capture
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, *, tenant: str, graph: str, origin: str = "stream", then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Capture the ``content`` of every batch as sources of one graph."""

    def batch(rows: DataFrame, number: int) -> None:
        run = f"{checkpoint}#{number}"
        captured = capture(rows, run, tenant=tenant, graph=graph, origin=origin)
        known = store.read("sources").select("source_id")
        new = captured.join(known, "source_id", "left_anti")
        if new.isEmpty():
            return
        store.append("sources", new)
        if then is not None:
            then(new)

    return stream.select("content", F.lit(None).cast("string").alias("external_ref")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
