"""What operations do to the stored nodes and edges, in one pass for a whole list of them.

Operations of a list take effect by their sequence number.  Rather than one at a time, each node gets the last word
on each of its columns, and each edge ends if either end was retired or removed after the edge began; edges there
before the list began before all of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import kind_of
from ..sources.capture import uuid_of
from ..sources.schema import OPEN_QUESTION, GraphError, ScopeViolation
from .oplog import ADDITIVE, PRESENTATION, TRUTH, merge_fold
from .scope import is_live_edge

SCOPE = ("tenant_id", "graph_id")
NODE = (*SCOPE, "node_id")
TRIPLE = (*SCOPE, "source_id", "target_id", "type")
#: The nodes that an operation of each kind names; they must be in its scope.
NAMED = {"ADD_EDGE": ("source_id", "target_id"), "ADD_CITATION": ("source_id", "target_id"), "SUPERSEDE": ("old_id", "new_id"), "CONTRADICT": ("new_id", "old_id"), "UPDATE_NODE": ("node_id",), "REMOVE_NODE": ("node_id",), "MERGE_NODE": ("node_id",)}


@dataclass
class Effects:
    nodes: DataFrame
    edges: DataFrame
    #: New edges with the operation that made them.
    made: DataFrame
    #: Edges that ended, and new ones.
    changed: DataFrame


def of(key: str) -> Column:
    return F.col("payload")[key]


def kinds(ops: DataFrame, *names: str) -> DataFrame:
    return ops.filter(F.col("op").isin(*names))


def check(ops: DataFrame, nodes: DataFrame) -> None:
    """An error if an operation is unknown or names a node outside its scope."""
    odd = ops.filter(F.col("op").isNull() | ~F.col("op").isin(*PRESENTATION, *ADDITIVE, *TRUTH)).first()
    if odd is not None:
        raise GraphError(f"unknown operation {odd['op']}")
    names = F.lit(None).cast("array<string>")
    for op, keys in NAMED.items():
        names = F.when(F.col("op") == op, F.array(*map(of, keys))).otherwise(names)
    named = ops.select(*SCOPE, F.explode(names).alias("node_id")).filter("node_id is not null")
    known = nodes.select(*NODE).unionByName(kinds(ops, "ADD_NODE").select(*SCOPE, of("new_id").alias("node_id")))
    lost = named.join(known, list(NODE), "left_anti").first()
    if lost is not None:
        raise ScopeViolation(lost["node_id"])


def concerned(nodes: DataFrame, edges: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that operations name, and the edges at them or named: all that ``take_effect`` can change or must know."""
    names = F.array(*[of(k) for k in ("node_id", "new_id", "old_id", "source_id", "target_id")])
    ids = ops.select(*SCOPE, F.explode(names).alias("id")).filter("id is not null").distinct()
    near = lambda t, c: t.join(ids.withColumnRenamed("id", c), [*SCOPE, c], "left_semi").select(*t.columns)
    cut = edges.join(kinds(ops, "DISCONNECT").select(*SCOPE, of("edge_id").alias("edge_id")).distinct(), [*SCOPE, "edge_id"], "left_semi").select(*edges.columns)
    at = near(edges, "source_id").unionByName(near(edges, "target_id")).unionByName(cut).dropDuplicates([*SCOPE, "edge_id"])
    return near(nodes, "node_id"), at


def _added(ops: DataFrame, nodes: DataFrame, salt: str, question: str) -> DataFrame:
    """Rows of the nodes that operations create: stated ones, and an open question for each contradiction."""
    asked = F.col("op") == "CONTRADICT"
    own = F.coalesce(F.when(~asked, of("new_id")), uuid_of(F.lit(salt), F.col("seq").cast("string"), F.lit("node")))
    title = F.concat(F.lit("Conflict: "), F.coalesce(of("new_title"), F.lit("new claim")), F.lit(" vs "), F.coalesce(of("old_title"), F.lit("existing claim")))
    kind = F.when(asked, F.lit(question)).otherwise(of("type"))
    values = {
        "node_id": own, "kind": kind_of(kind), "type": kind, "title": F.when(asked, title).otherwise(of("title")), "summary": F.when(~asked, of("summary")),
        "aliases": F.when(~asked & of("alias").isNotNull(), F.array(of("alias"))).otherwise(F.array().cast("array<string>")),
        "conflict_node_ids": F.when(asked, F.array(of("new_id"), of("old_id"))), "resolved": F.when(asked, "false"), "status": F.lit("active"),
        "confidence": F.when(~asked, of("confidence").cast("double")), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(),
    }
    empty = {f.name: F.lit(None).cast(f.dataType) for f in nodes.schema if f.name not in (*SCOPE, *values)}
    rows = kinds(ops, "ADD_NODE", "CONTRADICT").select(*SCOPE, *[v.alias(k) for k, v in (values | empty).items()])
    return rows.select(*nodes.columns).join(nodes.select(*NODE), list(NODE), "left_anti")  # a repeated approval adds nothing


def _states(ops: DataFrame) -> DataFrame:
    """The last word on each touched node, and when it was first and last removed or retired."""
    updated = F.col("op") == "UPDATE_NODE"
    status = F.when(F.col("op") == "SUPERSEDE", "superseded").when(F.col("op") == "REMOVE_NODE", "rejected").when(updated, of("status"))
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("seq")))
    seq = lambda op: F.when(F.col("op") == op, F.col("seq"))
    node = F.when(F.col("op") == "SUPERSEDE", of("old_id")).otherwise(of("node_id"))
    return kinds(ops, "SUPERSEDE", "REMOVE_NODE", "UPDATE_NODE", "SET_LAYOUT").withColumn("node_id", node).groupBy(*NODE).agg(
        last(status).alias("new_status"), *[last(F.when(updated, of(c))).alias(f"new_{c}") for c in ("title", "type", "summary")],
        last(F.when(F.col("op") == "SET_LAYOUT", F.coalesce(of("layout"), F.lit("{}")))).alias("new_layout"),
        *[f(seq(op)).alias(f"{n}_{w}") for op, n in (("REMOVE_NODE", "removed"), ("SUPERSEDE", "retired")) for f, n, w in ((F.min, n, "first"), (F.max, n, "last"))],
    )


def _ending(edges: DataFrame, states: DataFrame, word: str) -> DataFrame:
    """Edges with the first or last sequence number (``ends``) that ended a node of theirs; ``supersedes`` edges
    outlive a retirement."""
    pick = F.least if word == "first" else F.greatest
    stops = states.filter("removed_first is not null or retired_first is not null")
    for side in ("source", "target"):
        edges = edges.join(stops.select(*SCOPE, F.col("node_id").alias(f"{side}_id"), F.col(f"removed_{word}").alias(f"{side}_a"), F.col(f"retired_{word}").alias(f"{side}_b")), [*SCOPE, f"{side}_id"], "left")
    ends = pick("source_a", "target_a", *[F.when(F.col("type") != "supersedes", F.col(c)) for c in ("source_b", "target_b")])
    return edges.withColumn("ends", ends).drop("source_a", "source_b", "target_a", "target_b")


def take_effect(nodes: DataFrame, edges: DataFrame, ops: DataFrame, *, salt: str, question: str = OPEN_QUESTION, at: Column | None = None) -> Effects:
    """Nodes and edges after ``ops`` (tenant_id, graph_id, seq, op, payload), all of which take effect.

    ``salt`` names the list, so that doing it again gives the same ids; ``at`` is the time of ends and changes, else now.
    Nothing is deleted.  New nodes have no vector.  Of equal new edges the first that lives on is kept, else the first.
    One that is there, and lives when the operation's turn comes, is not added.
    """
    now, states = F.current_timestamp() if at is None else at, _states(ops)
    merges = kinds(ops, "MERGE_NODE").select("tenant_id", of("node_id").alias("node_id"), of("alias").alias("alias"), of("summary").alias("summary"), "seq")
    out = merge_fold(nodes.unionByName(_added(ops, nodes, salt, question)), merges).drop("n_merges", "n_citations")
    cites = kinds(ops, "MERGE_NODE").filter(of("source_id").isNotNull()).select(*SCOPE, of("node_id").alias("node_id"), F.struct("seq", of("source_id").alias("source_id"), of("run_id").alias("run_id")).alias("c"))
    cites = cites.groupBy(*NODE).agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.struct(c["source_id"].alias("source_id"), c["run_id"].alias("run_id"))).alias("more"))
    out = out.join(states.withColumn("touched", F.lit(True)), list(NODE), "left").join(cites, list(NODE), "left")
    changed = {c: F.coalesce(f"new_{c}", c) for c in ("status", "title", "type", "summary", "layout")}
    none = F.array().cast(nodes.schema["citations"].dataType)
    changed |= {"deleted_at": F.when(F.col("removed_first").isNotNull(), now).otherwise(F.col("deleted_at")), "updated_at": F.when(F.col("touched"), now).otherwise(F.col("updated_at")), "citations": F.concat(F.coalesce("citations", none), F.coalesce("more", none))}
    out = out.withColumns(changed).select(*nodes.columns)

    cut = kinds(ops, "DISCONNECT").select(*SCOPE, of("edge_id").alias("edge_id"), "seq").groupBy(*SCOPE, "edge_id").agg(F.min("seq").alias("cut"))
    old = _ending(edges, states, "first").join(cut, [*SCOPE, "edge_id"], "left").withColumn("ends", F.least("ends", "cut"))
    pair = {"source_id": F.when(F.col("op").isin("SUPERSEDE", "CONTRADICT"), of("new_id")).otherwise(of("source_id")), "target_id": F.when(F.col("op").isin("SUPERSEDE", "CONTRADICT"), of("old_id")).otherwise(of("target_id"))}
    kind = F.when(F.col("op") == "SUPERSEDE", "supersedes").when(F.col("op") == "CONTRADICT", "contradicts").otherwise(of("type"))
    new = kinds(ops, "ADD_EDGE", "ADD_CITATION", "SUPERSEDE", "CONTRADICT").select(*SCOPE, "seq", "op", of("confidence").cast("double").alias("confidence"), *[v.alias(k) for k, v in pair.items()], kind.alias("type"))
    there = old.filter(is_live_edge()).select(*[F.col(c).alias(f"_{c}") for c in TRIPLE], F.col("ends").alias("_ends"))
    same = [F.col(c) == F.col(f"_{c}") for c in TRIPLE] + [F.col("_ends").isNull() | (F.col("_ends") > F.col("seq"))]
    new = new.filter("source_id <> target_id and type is not null").join(there, same, "left_anti")
    new = _ending(new, states, "last").withColumn("ended", F.coalesce(F.col("ends") > F.col("seq"), F.lit(False)))
    first = new.groupBy(*TRIPLE).agg(F.min_by(F.struct("seq", "op", "confidence", "ended"), F.struct("ended", "seq")).alias("f")).select(*TRIPLE, "f.*")
    made = first.select(
        *SCOPE, uuid_of(F.lit(salt), F.col("source_id"), F.col("target_id"), F.col("type")).alias("edge_id"), "source_id", "target_id", "type", F.lit("active").alias("status"), "confidence",
        now.alias("valid_at"), F.when(F.col("ended"), now).alias("invalid_at"), F.lit(None).cast("timestamp").alias("expired_at"), "op",
    )
    old = old.withColumn("ended_now", F.col("invalid_at").isNull() & F.col("ends").isNotNull()).withColumn("invalid_at", F.when(F.col("ended_now"), now).otherwise(F.col("invalid_at")))
    added, ended = made.select(*edges.columns), F.col("ended_now")
    old = old.select(*edges.columns, ended)
    return Effects(out, old.drop("ended_now").unionByName(added), made, old.filter(ended).drop("ended_now").unionByName(added))
