"""Reads: search, subgraphs, evidence, conflicts, roster and their rendering.

All take tables already cut to one tenant and graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import merged_summary
from ..functions.vectors import nearest
from .scope import is_live_node, live_edges, live_nodes

EXCERPT = 2000
#: The wording of a rendered subgraph.
NOTHING = "No relevant context found in the graph."
HEADING = "Relevant context (knowledge graph):"
RELATIONS = "Relationships:"
OMITTED = "[... {n} more item(s) omitted for length]"


def search_segments(segments: DataFrame, sources: DataFrame, vector: list[float], k: int = 10, least: float | None = None) -> DataFrame:
    """The k closest source spans with the origin of their source; both sides are scoped before they meet."""
    top = nearest(segments, vector, k, id_col="segment_id", least=least)
    return top.join(sources.select("source_id", "origin"), "source_id").select("segment_id", "source_id", "text", "locator", "score", "origin")


def seeds(nodes: DataFrame, vector: list[float], k: int = 8, least: float | None = None) -> DataFrame:
    top = nearest(live_nodes(nodes), vector, k, id_col="node_id", least=least)
    return top.withColumn("summary", shown_summary(F.col("summary"), F.col("summaries")))


def details(nodes: DataFrame) -> DataFrame:
    """Live nodes as reads show them: the summary with the wording that merges have added."""
    shown = shown_summary(F.col("summary"), F.col("summaries")).alias("summary")
    return live_nodes(nodes).select(F.col("node_id").alias("id"), "kind", "type", "title", shown, "status", "confidence")


def edges_touching(edges: DataFrame, frontier: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Live edges with either end in the frontier (column id): one semi-join per end, which stay equi-joins."""
    live, ids = live_edges(edges, types), frontier.select("id").distinct()
    from_it = live.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    to_it = live.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return from_it.unionByName(to_it).dropDuplicates(["edge_id"])


def grow(start: DataFrame, edges: DataFrame, hops: int, max_nodes: int = 30, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion of ``start`` (id, reach): collected (id, reach, hop) and the edges met.

    Nodes are reached in the order hop, edge id, source before target, until ``max_nodes`` are collected; no more than
    that are ranked in one task.  Dead nodes count and lead on.
    """
    collected = start.select("id", "reach", F.lit(0).alias("hop"))
    frontier, met = collected, None
    for hop in range(1, hops + 1):
        size = collected.agg(F.count(F.lit(1)).alias("n"))
        touching = edges_touching(edges, frontier, types).crossJoin(F.broadcast(size)).filter(F.col("n") < max_nodes).drop("n")  # one row
        met = touching if met is None else met.unionByName(touching)
        ends = touching.select("edge_id", F.posexplode(F.array("source_id", "target_id")).alias("side", "id")).join(collected.select("id"), "id", "left_anti")
        first = ends.groupBy("id").agg(F.min(F.struct("edge_id", "side")).alias("at"))
        first = first.orderBy("at", "id").limit(max_nodes)  # no more can be taken, so no more are ranked in one task
        ranked = first.withColumn("k", F.row_number().over(Window.orderBy("at", "id"))).crossJoin(F.broadcast(size))
        new = ranked.filter(F.col("k") + F.col("n") <= max_nodes).select("id", (F.col("k") + F.col("n")).cast("int").alias("reach"), F.lit(hop).alias("hop"))
        collected, frontier = collected.unionByName(new), new
    triples = edges.select("source_id", "target_id", "type").limit(0) if met is None else met.select("source_id", "target_id", "type").distinct()
    return collected, triples


def subgraph(start: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 1, max_nodes: int = 30, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around ``start`` (id, reach, score): live nodes by score, and the edges between them."""
    collected, met = grow(start, edges, hops, max_nodes, types)
    scored = collected.join(start.select("id", "score"), "id", "left")
    found = scored.join(details(nodes), "id").select("id", "kind", "type", "title", "summary", "status", "confidence", "score", "reach")
    ids = found.select("id")
    closed = met.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return found.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "reach"), closed.select("source_id", "target_id", "type")


def recall(nodes: DataFrame, edges: DataFrame, vector: list[float], k: int = 8, hops: int = 1, max_nodes: int = 30, least: float | None = None) -> tuple[DataFrame, DataFrame]:
    top = seeds(nodes, vector, k, least)
    start = top.select(F.col("node_id").alias("id"), F.row_number().over(Window.orderBy(F.col("score").desc(), "node_id")).alias("reach"), "score")
    return subgraph(start, nodes, edges, hops, max_nodes)


def neighbors(nodes: DataFrame, edges: DataFrame, node_id, hops: int = 1, max_nodes: int = 30, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    spark = nodes.sparkSession
    start = spark.range(1).select(F.lit(node_id).cast(nodes.schema["node_id"].dataType).alias("id"), F.lit(1).alias("reach"), F.lit(1.0).alias("score"))
    return subgraph(start, nodes, edges, hops, max_nodes, types)


def evidence(nodes: DataFrame, sources: DataFrame, node_id) -> DataFrame:
    """The sources that a node cites, once each."""
    cited = nodes.filter(F.col("node_id") == F.lit(node_id)).select(F.explode("citations").alias("source_id")).distinct()
    excerpt = F.substring(F.coalesce("raw_content", F.lit("")), 1, EXCERPT)
    return sources.join(cited, "source_id", "left_semi").select("source_id", "origin", excerpt.alias("excerpt"), "metadata", "created_at")


def conflicts(nodes: DataFrame, kind: str = "knowledge/open_question") -> DataFrame:
    """Live nodes of the open-question type, newest first."""
    live = nodes.filter(is_live_node() & (F.col("type") == kind))
    resolved = F.coalesce(F.col("resolved").cast("boolean"), F.lit(False))
    return live.select(F.col("node_id").alias("open_question_id"), "title", "conflict_node_ids", resolved.alias("resolved"), "created_at").orderBy(F.col("created_at").desc(), "open_question_id")


def roster(nodes: DataFrame, limit: int = 200, aliases: int = 3) -> DataFrame:
    """Entities first, then the latest updates; a few aliases each."""
    live = live_nodes(nodes)
    few = F.slice(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()), 1, aliases)
    top = live.orderBy((F.col("kind") == "entity").desc(), F.col("updated_at").desc(), "node_id").limit(limit)
    rank = F.row_number().over(Window.orderBy((F.col("kind") == "entity").desc(), F.col("updated_at").desc(), "node_id"))  # of at most `limit` rows
    return top.select(rank.alias("rank"), "node_id", "type", "title", few.alias("aliases"))


def roster_lines(entries: DataFrame) -> DataFrame:
    """(type, line): the titles of a type with their aliases, in the roster's order."""
    label = F.when(F.size("aliases") > 0, F.concat(F.col("title"), F.lit(" (aka: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise(F.col("title"))
    own = entries.select("type", F.struct("rank", label.alias("label")).alias("e")).groupBy("type").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return own.select("type", F.array_join(F.transform("es", lambda e: e["label"]), " | ").alias("line")).orderBy("type")


def edge_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the titles of their ends; an unknown end is a question mark."""
    name = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("title").alias(side))
    both = edges.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left")
    shown = lambda side: F.coalesce(side, F.lit("?"))
    return both.select("source_id", "target_id", "type", F.concat(shown("source"), F.lit(" -["), F.col("type"), F.lit("]-> "), shown("target")).alias("line"))


def context_text(nodes: list, edges: list, max_chars: int = 6000) -> str:
    """A subgraph of a few dozen rows as text; a line that does not fit is counted and passed over."""
    if not nodes:
        return NOTHING
    lines, omitted = [HEADING, ""], 0
    used = sum(len(x) + 1 for x in lines)

    def add(line: str, room: int) -> bool:
        nonlocal used
        if used + len(line) > room:
            return False
        lines.append(line)
        used += len(line) + 1
        return True

    for n in nodes:
        tail = f" — {n['summary']}" if n["summary"] else ""
        omitted += not add(f"- [{n['type']}] {n['title']} {{id: {n['id']}}}{tail}", max_chars - 200)
    if edges:
        title = {n["id"]: n["title"] for n in nodes}
        lines += ["", RELATIONS]
        used += 1 + len(RELATIONS) + 1
        for e in edges:
            omitted += not add(f"  {title.get(e['source_id'], '?')} -[{e['type']}]-> {title.get(e['target_id'], '?')}", max_chars)
    if omitted:
        lines.append("\n" + OMITTED.format(n=omitted))
    return "\n".join(lines)


def shown_summary(summary: Column, more: Column) -> Column:
    return merged_summary(summary, more)
