"""The operation log: the risk gate, merges, new edges and counts.  What operations do to nodes and edges is in ``effects``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The operations by class.
PRESENTATION = ("SET_LAYOUT",)
ADDITIVE = ("ADD_NODE", "ADD_EDGE", "ADD_CITATION", "MERGE_NODE", "CONTRADICT")
TRUTH = ("UPDATE_NODE", "DISCONNECT", "REMOVE_NODE", "SUPERSEDE")
#: The keys that a layout may carry.
LAYOUT_KEYS = ("node_id", "view", "layout")


def risk(op: Column, actor_kind: Column) -> Column:
    """What the gate makes of an operation; what its caller claims plays no part."""
    safe = op.isin(*PRESENTATION, *ADDITIVE) | (op.isin(*TRUTH) & (actor_kind == "human"))
    return F.when(safe, "additive").otherwise("high")


def gated(ops: DataFrame) -> DataFrame:
    return ops.withColumn("risk", risk(F.col("op"), F.coalesce("actor_kind", F.lit("agent"))))


def applied(ops: DataFrame, approved: Column | None = None) -> DataFrame:
    """Operations that take effect: additive ones, and approved ones of any risk, which must be known."""
    known = F.col("op").isin(*PRESENTATION, *ADDITIVE, *TRUTH)
    passes = F.col("risk") == "additive"
    if approved is not None:
        passes = passes | F.when(approved & ~known, F.raise_error(F.lit("unknown operation approved")).cast("boolean")).otherwise(approved)
    return gated(ops).filter(passes)


def layout(payload: Column) -> Column:
    return F.map_filter(payload, lambda k, v: k.isin(*LAYOUT_KEYS))


def in_order(value: Column, seq: str = "seq") -> Column:
    """Values of a group by sequence number."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), value.alias("v")))), lambda x: x["v"])


def merge_fold(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Nodes after their merges: (tenant_id, node_id, aliases, summaries, n_citations, n_merges) beside the old columns.

    Aliases are a set without the own title; a summary is added unless it is null, the node's own or there already;
    citations and merges only grow.
    """
    key = ["tenant_id", "node_id"]
    once = merges.groupBy(*key, "summary").agg(F.min("seq").alias("seq"))  # a node gathers its different wordings, not its merges
    worded = once.groupBy(*key).agg(in_order(F.col("summary")).alias("new_summaries"))
    own = merges.groupBy(*key).agg(F.collect_set("alias").alias("new_aliases"), F.count(F.lit(1)).alias("n")).join(worded, key)
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    if "summaries" not in nodes.columns:
        nodes = nodes.withColumn("summaries", F.lit(None).cast("array<string>"))
    both = nodes.join(own, ["tenant_id", "node_id"], "left")
    aliases = F.filter(F.array_union(some("aliases"), some("new_aliases")), lambda a: a.isNotNull() & ~a.eqNullSafe(F.col("title")))
    new = F.filter(some("new_summaries"), lambda s: s.isNotNull() & ~s.eqNullSafe(F.col("summary")))
    return both.withColumns({
        "aliases": F.array_sort(aliases), "summaries": F.array_union(some("summaries"), new),
        "n_merges": F.coalesce("n", F.lit(0)), "n_citations": F.when(F.col("citations").isNull(), 0).otherwise(F.size("citations")) + F.coalesce("n", F.lit(0)),
    }).drop("new_aliases", "new_summaries", "n")


def new_edges(proposed: DataFrame, live: DataFrame) -> DataFrame:
    """Proposed edges that do not exist: the first of equal ones, without loops, not among the live ones."""
    key = ["tenant_id", "graph_id", "source_id", "target_id", "type"]
    proper = proposed.filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & (F.col("source_id") != F.col("target_id")))
    first = proper.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).filter("k = 1").drop("k")
    return first.join(live.select(*key), key, "left_anti")


def metrics(ops: DataFrame) -> DataFrame:
    """Counts of what a log does, per tenant."""
    ok = F.col("risk") == "additive"
    return gated(ops).groupBy("tenant_id").agg(
        F.count_if(ok & (F.col("op") == "ADD_NODE")).alias("created"), F.count_if(ok & (F.col("op") == "MERGE_NODE")).alias("merged"),
        F.count_if(ok & F.col("op").isin("ADD_EDGE", "ADD_CITATION")).alias("edges"), F.count_if(~ok).alias("gated"),
    )
