"""Plug-ins: embedding, extraction and adjudication as vectorised functions, and their checks.

A plug-in is a picklable function.  What it returns is written before it is used again, so that retries neither pay
twice nor change answers.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import kind_of
from ..sources.schema import EmbeddingUnavailable, Ontology

Embedder = Callable[[list[str]], list[list[float]]]
#: (text) or (text, parts of the prompt) -> {"nodes": [...], "edges": [...], "usage": {...}}
Extractor = Callable[..., dict]
EMBED_BATCH = 100

NODE = "temp_id string, type string, kind string, title string, summary string, confidence double, surface_phrase string"


def hash_embedder(width: int = 64) -> Embedder:
    """A deterministic stand-in: equal texts have equal unit vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint32)
            v = np.random.default_rng(seed).standard_normal(width)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return embed


def checked(vectors: list[list[float]], n: int, width: int | None) -> list[list[float]]:
    """One finite, non-zero vector per text, of the agreed width, at unit length; anything else is refused."""
    if len(vectors) != n:
        raise EmbeddingUnavailable(f"{len(vectors)} vectors for {n} texts")
    out = []
    for v in vectors:
        a = np.asarray(v, float)
        size = float(np.linalg.norm(a)) if a.size else 0.0
        if not np.isfinite(size) or size == 0.0 or (width is not None and len(a) != width):
            raise EmbeddingUnavailable("a vector is empty, degenerate or of another width")
        out.append((a / size).tolist())
    return out


def embed(rows: DataFrame, text: str, embedder: Embedder, width: int | None = None) -> DataFrame:
    """The rows with a vector of the text column; vectors stay beside their rows throughout."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            vectors: list[list[float]] = []
            texts = pdf[text].fillna("").tolist()
            for i in range(0, len(texts), EMBED_BATCH):
                part = texts[i : i + EMBED_BATCH]
                vectors += checked(embedder(part), len(part), width)
            yield pdf.assign(embedding=vectors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", embedding array<float>"
    return rows.mapInPandas(run, schema)


def line_extractor(text: str) -> dict:
    """A deterministic stand-in: each line of some words is a claim, its first word of five letters or more an entity."""
    nodes, edges = [], []
    for i, line in enumerate(x.strip() for x in text.splitlines()):
        words = line.split()
        if len(words) < 4:
            continue
        nodes.append({"temp_id": f"c{i}", "type": "knowledge/insight", "title": " ".join(words[:8]), "summary": line[:200], "confidence": 0.7})
        long = next((w for w in words if len(w) >= 5 and w.isalpha()), None)
        if long:
            nodes.append({"temp_id": f"e{i}", "type": "entity/component", "title": long, "confidence": 0.7})
            edges.append({"source_temp_id": f"c{i}", "target_temp_id": f"e{i}", "type": "affects", "confidence": 0.7})
    return {"nodes": nodes, "edges": edges}


def tolerant(value) -> list[dict]:
    """A list of objects, also where it came as JSON text; what is neither is left out."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return []
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _number(value, otherwise):
    try:
        return type(otherwise)(value)
    except (TypeError, ValueError):
        return otherwise


def extract(batches: DataFrame, extractor: Extractor, id_col: str = "source_id", *, prompt: tuple[str, ...] = (), tell: bool = False) -> DataFrame:
    """(id, index, nodes, edges, usage, error): temp ids carry the batch's index, edges to nodes that were not extracted go.

    The extractor gets a text and, if it takes a second argument, the prompt's parts.  Its failure fails the task, or
    with ``tell`` is that batch's error, so that what the others have cost is still known.
    """
    kind = batches.schema[id_col].dataType.simpleString()
    asked = (lambda text: extractor(text, list(prompt))) if len(inspect.signature(extractor).parameters) > 1 else extractor

    def read(k: int, got: dict) -> tuple[list[dict], list[dict], dict]:
        nodes = [{"temp_id": f"{k}:{n.get('temp_id') or i}", "type": n.get("type") or "", "kind": n.get("kind"), "title": n.get("title"), "summary": n.get("summary"), "confidence": _number(n.get("confidence"), 0.7), "surface_phrase": n.get("surface_phrase")} for i, n in enumerate(tolerant(got.get("nodes")))]
        names = {n["temp_id"] for n in nodes}
        edges = [{"source_temp_id": f"{k}:{e.get('source_temp_id')}", "target_temp_id": f"{k}:{e.get('target_temp_id')}", "type": e.get("type"), "confidence": _number(e.get("confidence"), 0.7)} for e in tolerant(got.get("edges"))]
        usage = got.get("usage") or {}
        spent = {"model": str(usage.get("model") or ""), "input_tokens": _number(usage.get("input_tokens"), 0), "output_tokens": _number(usage.get("output_tokens"), 0)}
        return nodes, [e for e in edges if e["type"] and e["source_temp_id"] in names and e["target_temp_id"] in names], spent

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, k, text in zip(pdf[id_col], pdf["index"], pdf["text"], strict=True):
                try:
                    out.append((i, k, *read(k, asked(text or "") or {}), None))
                except Exception as e:
                    if not tell:
                        raise
                    out.append((i, k, [], [], {"model": "", "input_tokens": 0, "output_tokens": 0}, str(e)[:2000] or type(e).__name__))
            yield pd.DataFrame(out, columns=[id_col, "index", "nodes", "edges", "usage", "error"])

    edge = "source_temp_id:string,target_temp_id:string,type:string,confidence:double"
    node = NODE.replace(" ", ":", 1).replace(", ", ",").replace(" ", ":")
    return batches.mapInPandas(run, f"{id_col} {kind}, index int, nodes array<struct<{node}>>, edges array<struct<{edge}>>, usage struct<model:string,input_tokens:long,output_tokens:long>, error string")


def typed(nodes: DataFrame, ontology: Ontology) -> DataFrame:
    """Extracted nodes with their kind, the one given or else that of the type; types outside the vocabulary are dropped
    if it is strict, else marked."""
    vocabulary = F.broadcast(ontology.frame(nodes.sparkSession).select("type", F.lit(True).alias("known")))
    kind = kind_of(F.col("type"), tuple(ontology.node_types))
    if "kind" in nodes.columns:
        kind = F.coalesce(F.nullif(F.col("kind"), F.lit("")), kind)
    out = nodes.withColumn("kind", kind).join(vocabulary, "type", "inner" if ontology.strict else "left")
    return out.withColumn("known", F.coalesce("known", F.lit(False)))


def proper_edges(edges: DataFrame, nodes: DataFrame, batch: str, node_id: str = "temp_id") -> DataFrame:
    """Edges whose two ends were extracted in their batch and differ."""
    ids = nodes.select(batch, F.col(node_id).alias("id")).distinct()
    kept = edges.filter("source_id <> target_id")
    for end in ("source_id", "target_id"):
        kept = kept.join(ids.withColumnRenamed("id", end), [batch, end], "left_semi")
    return kept


def system_prompt(ontology: Ontology) -> str:
    rules = ["State one claim per node.", "Make one node of a thing, however often it is mentioned.", "Use only what the text supports.", "Leave out small talk.", "Refer to nodes in edges by temp_id.", "Return empty lists if the text has nothing of substance."]
    return "Extract structured knowledge from the text.\n\n" + ontology.describe() + "\n\n" + "\n".join(f"- {r}" for r in rules)


def roster_block(lines: list[str]) -> str:
    """The roster's part of a prompt; empty without entries."""
    if not lines:
        return ""
    return "ENTITIES AND CLAIMS ALREADY IN THIS GRAPH:\n" + "\n".join(f"- {x}" for x in lines) + "\n\nReuse a listed title exactly where the text means it, with the text's wording as surface_phrase; if unsure, make a new node."

