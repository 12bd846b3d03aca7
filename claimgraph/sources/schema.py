"""Tables, their schemas, and the vocabulary as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Columns by table, as DDL.  Scope columns come first and partition the files.
SCOPE = "tenant_id string, graph_id string"
SCHEMAS = {
    "runs": f"{SCOPE}, run_id string, actor_id string, status string, model string, input_tokens long, output_tokens long, llm_calls long, created_at timestamp",
    "sources": f"{SCOPE}, source_id string, origin string, raw_content string, external_ref string, metadata map<string,string>, extraction_status string, extraction_error string, created_at timestamp",
    "segments": f"{SCOPE}, segment_id string, source_id string, locator struct<start:int,end:int,unit:string>, text string, embedding array<float>",
    "nodes": f"{SCOPE}, node_id string, kind string, type string, title string, aliases array<string>, summary string, summaries array<string>, citations array<struct<source_id:string,run_id:string>>, merges array<struct<alias:string,decision:string,branch:string>>, conflict_node_ids array<string>, resolved string, status string, confidence double, deleted_at timestamp, layout string, embedding array<float>, created_at timestamp, updated_at timestamp",
    "edges": f"{SCOPE}, edge_id string, source_id string, target_id string, type string, status string, confidence double, valid_at timestamp, invalid_at timestamp, expired_at timestamp",
    "changesets": f"{SCOPE}, changeset_id string, run_id string, status string, ops array<struct<seq:long,op:string,risk:string,payload:map<string,string>>>, origin string, actor_kind string, actor_id string, summary string, reviewed_by string, created_at timestamp, reviewed_at timestamp",
}

#: The default vocabulary.
EDGE_TYPES = ("motivates", "affects", "contains", "depends_on", "implements", "derived_from", "references", "contradicts", "supersedes")
NODE_TYPES = {
    "knowledge": ("knowledge/decision", "knowledge/constraint", "knowledge/problem", "knowledge/insight", "knowledge/open_question", "knowledge/feedback", "knowledge/request"),
    "entity": ("entity/feature", "entity/component", "entity/screen", "entity/flow", "entity/api", "entity/data_model", "entity/actor"),
}
OPEN_QUESTION = "knowledge/open_question"


class GraphError(Exception):
    """Base of this library's errors."""


class EmbeddingUnavailable(GraphError):
    """No vector could be made; the text is kept and may be indexed later."""


class ExtractionFailed(GraphError):
    """No claims could be read from a source; the source is kept."""


class SchemaMismatch(GraphError):
    """Stored vectors and the embedder disagree in width."""


class ScopeViolation(GraphError):
    """An id outside the tenant and graph of the call."""


class ConcurrentModification(GraphError):
    """The snapshot has moved on; derive the change again."""


@dataclass(frozen=True)
class Ontology:
    node_types: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(NODE_TYPES))
    edge_types: tuple[str, ...] = EDGE_TYPES
    open_question_type: str = OPEN_QUESTION
    canonical_types: tuple[str, ...] = NODE_TYPES["entity"]
    strict: bool = False

    def frame(self, spark: SparkSession) -> DataFrame:
        """(kind, type, is_canonical): a handful of rows, safe to broadcast."""
        return spark.createDataFrame([(k, t, t in self.canonical_types) for k, ts in self.node_types.items() for t in ts], "kind string, type string, is_canonical boolean")

    def describe(self) -> str:
        nodes = "\n".join(f"{kind}: {', '.join(types)}" for kind, types in self.node_types.items())
        return f"Node types\n{nodes}\nEdge types: {', '.join(self.edge_types)}"


@dataclass(frozen=True)
class Settings:
    merge_threshold: float = 0.90
    related_low: float = 0.74
    candidates: int = 5
    fail_closed: bool = False
    roster_limit: int = 200
    roster_aliases: int = 3
    chunk_size: int = 1200
    chunk_overlap: int = 150
    batch_chars: int = 200_000
    dimensions: int = 1536
