"""Governance: review queue, review, health and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scope import is_live_edge, is_live_node

REVIEWABLE = ("pending_review", "partial")


def pending(changesets: DataFrame) -> DataFrame:
    """Changesets that wait for a reviewer with only their risky operations, newest first."""
    risky = F.filter("ops", lambda o: o["risk"] == "high")
    return changesets.filter(F.col("status").isin(*REVIEWABLE)).withColumn("ops", risky).orderBy(F.col("created_at").desc(), "changeset_id")


def review(changesets: DataFrame, changeset_id, approve: bool, reviewer: str | None, at) -> DataFrame:
    """All changesets after the decision on one; a reviewer and a time are stamped on it."""
    mine = (F.col("changeset_id") == F.lit(changeset_id)) & F.col("status").isin(*REVIEWABLE)
    return changesets.withColumns({
        "status": F.when(mine, F.lit("applied" if approve else "rejected")).otherwise(F.col("status")),
        "reviewed_by": F.when(mine, F.lit(reviewer)).otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(mine, F.lit(at).cast("timestamp")).otherwise(F.col("reviewed_at")),
    })


def health(nodes: DataFrame, edges: DataFrame, sources: DataFrame, segments: DataFrame, changesets: DataFrame) -> DataFrame:
    """Seven counts in one row; every table is read once."""
    live = is_live_node()
    n = nodes.agg(F.count_if(live).alias("nodes"), F.count_if(live & F.col("embedding").isNull()).alias("nodes_without_embedding"))
    e = edges.agg(F.count_if(is_live_edge()).alias("active_edges"))
    status = F.col("extraction_status")
    s = sources.agg(F.count_if(status == "pending").alias("sources_pending"), F.count_if(status == "failed").alias("sources_failed"))
    u = unindexed(sources, segments).agg(F.count(F.lit(1)).alias("sources_unindexed"))
    c = changesets.agg(F.count_if(F.col("status").isin(*REVIEWABLE)).alias("changesets_awaiting_review"))
    for one in (e, s, c, u):  # one row each
        n = n.crossJoin(F.broadcast(one))
    return n


def unindexed(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """Sources with text and no segment."""
    return sources.filter(F.coalesce("raw_content", F.lit("")) != "").join(segments.select("source_id"), "source_id", "left_anti")


def without_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """A table once a tenant is deleted: its partition folders alone are gone."""
    return rows.filter(~F.col("tenant_id").eqNullSafe(F.lit(tenant)))


def without_vector(nodes: DataFrame) -> DataFrame:
    """Live nodes that no search can find until they are embedded again."""
    return nodes.filter(is_live_node() & F.col("embedding").isNull())


def cost_daily(runs: DataFrame) -> DataFrame:
    day = F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd")
    return runs.groupBy(day.alias("day"), "model").agg(F.count(F.lit(1)).alias("runs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("llm_calls").alias("llm_calls"))


def run_spend(calls: DataFrame, key: str) -> DataFrame:
    """Tokens, calls and the last named model of each run."""
    last = F.max_by(F.when(F.col("model") != "", F.col("model")), F.when(F.col("model") != "", F.col("seq")))
    return calls.groupBy(key).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("llm_calls"), last.alias("model"))
