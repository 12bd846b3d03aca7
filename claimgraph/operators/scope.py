"""Predicates that every read starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(rows: DataFrame, tenant: str, graph: str) -> DataFrame:
    """One tenant's one graph: two equalities, which prune the partition folders."""
    return rows.filter((F.col("tenant_id") == tenant) & (F.col("graph_id") == graph))


def is_live_node() -> Column:
    return (F.col("status") == "active") & F.col("deleted_at").isNull()


def is_live_edge() -> Column:
    return F.col("invalid_at").isNull()


def live_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(is_live_node())


def live_edges(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    live = edges.filter(is_live_edge())
    return live.filter(F.col("type").isin(*types)) if types else live


def only_ids(rows: DataFrame, column: str, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose column is among the ids; the planner sends the ids to all tasks if their size allows it."""
    return rows.join(ids.select(F.col(id_col).alias(column)).distinct(), column, "left_semi")


def out_of_scope(ids: DataFrame, nodes: DataFrame, id_col: str = "node_id") -> DataFrame:
    """Requested ids that the scoped nodes do not have; any row is a violation."""
    return ids.select(id_col).distinct().join(nodes.select(id_col), id_col, "left_anti")
