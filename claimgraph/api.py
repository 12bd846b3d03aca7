"""The engine's public interface over a store of one deployment; every call names its tenant and graph."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import embed_text
from .operators import chunk, effects, extract, govern, oplog, read, resolve, scope
from .sources.capture import capture, uuid_of
from .sources.schema import SCHEMAS, ExtractionFailed, GraphError, Ontology, SchemaMismatch, ScopeViolation, Settings
from .sources.store import INSERT, UPSERT, Store


log = logging.getLogger(__name__)


def no_meter(**spent) -> None:
    """The default meter: records nothing."""


def no_canonical(graph_id: str, node_type: str, title: str) -> dict | None:
    """The default host: it has no entities of its own."""


@dataclass
class Result:
    status: str
    source_ids: list[str] = field(default_factory=list)
    run_id: str | None = None
    changeset_id: str | None = None
    created: int = 0
    merged: int = 0
    edges: int = 0
    gated: int = 0
    error: str | None = None


@dataclass
class Spend:
    """What the language model of a run has cost."""

    model: str = ""
    llm_calls: int = 0
    input_tokens: int = 0
    output_tokens: int = 0

    def add(self, rows: list) -> None:
        """Rows (model, input_tokens, output_tokens), one a call."""
        for r in rows:
            self.model = r["model"] or self.model
            self.llm_calls, self.input_tokens, self.output_tokens = self.llm_calls + 1, self.input_tokens + r["input_tokens"], self.output_tokens + r["output_tokens"]


class Graph:
    """``extractor(text[, prompt])`` gives nodes and edges; ``adjudicator(new, existing)`` a verdict on one nominated pair,
    or (verdict, usage); ``canonical(graph_id, type, title)`` the host's own entity, {"title", "node_id"?}, or None;
    ``meter(**spent)`` is told what a run has cost, also a failed one.  ``verdicts(candidates, nodes)`` may stand in for
    an adjudicator with a table of its own.  Plug-ins run on the executors, the meter on the driver."""

    def __init__(self, spark: SparkSession, root: str, *, embedder: extract.Embedder, extractor: extract.Extractor | None = None, verdicts=None, adjudicator=None, canonical=no_canonical, meter=no_meter, ontology: Ontology = Ontology(), settings: Settings = Settings()):  # noqa: B008
        self.spark, self.store = spark, Store(spark, root)
        self.embedder, self.extractor, self.verdicts, self.ontology, self.settings = embedder, extractor, verdicts, ontology, settings
        self.adjudicator, self.canonical, self.meter = adjudicator, canonical, meter
        if len(embedder(["width"])[0]) != settings.dimensions:
            raise SchemaMismatch(f"the embedder does not give {settings.dimensions} dimensions")

    def _here(self, table: str, tenant: str, graph: str) -> DataFrame:
        return scope.scoped(self.store.read(table), tenant, graph)

    def _vector(self, text: str) -> list[float]:
        return extract.checked(self.embedder([text]), 1, self.settings.dimensions)[0]

    # Writing

    def add(self, tenant: str, graph: str, content: str, *, origin: str = "text", metadata: dict | None = None, structure: bool = True, actor: str = "agent") -> Result:
        """Keep a text, index it and, with an extractor, turn it into claims."""
        run = uuid.uuid4().hex
        rows = self.spark.createDataFrame([(content, None)], "content string, external_ref string")
        source = capture(rows, run, tenant=tenant, graph=graph, origin=origin)
        if metadata:
            source = source.withColumn("metadata", F.create_map(*[F.lit(str(x)) for kv in metadata.items() for x in kv]))
        ids = [r[0] for r in source.select("source_id").collect()]
        self.store.append("sources", source)  # durable before anything is paid for
        result = Result("stored", ids, run)
        try:
            self.reindex(tenant, graph, ids)
        except Exception as e:  # noqa: BLE001  the text stays, the failure is told
            return self._failed(tenant, graph, result, e)
        if structure and self.extractor is not None:
            self._run(tenant, graph, ids, actor, result)
        return result

    def restructure(self, tenant: str, graph: str, source_id: str) -> Result:
        """Extract from a kept source again."""
        if self.extractor is None:
            raise GraphError("there is no extractor")
        if self._here("sources", tenant, graph).filter(F.col("source_id") == source_id).isEmpty():
            raise ScopeViolation(source_id)
        result = Result("stored", [source_id], uuid.uuid4().hex)
        self._run(tenant, graph, [source_id], "agent", result)
        return result

    def _run(self, tenant: str, graph: str, ids: list[str], actor: str, result: Result) -> None:
        """One run, kept as a row and told to the meter whatever becomes of it."""
        spend = Spend()
        try:
            self._structure(tenant, graph, ids, result.run_id, actor, result, spend)
        except Exception as e:  # noqa: BLE001
            self._failed(tenant, graph, result, e)
        finally:
            row = (tenant, graph, result.run_id, None, "completed" if result.status == "done" else "failed", spend.model, spend.input_tokens, spend.output_tokens, spend.llm_calls, None)
            self.store.append("runs", self.spark.createDataFrame([row], SCHEMAS["runs"]).withColumn("created_at", F.current_timestamp()))
            try:
                self.meter(tenant_id=tenant, operation="structure", model=spend.model, input_tokens=spend.input_tokens, output_tokens=spend.output_tokens, llm_calls=spend.llm_calls)
            except Exception as e:  # noqa: BLE001  what is spent is spent
                log.warning("the meter failed: %s", e)

    def _failed(self, tenant: str, graph: str, result: Result, error: Exception) -> Result:
        result.status, result.error = "failed", str(error)[:2000]
        self._mark(tenant, graph, result.source_ids, "failed", result.error)
        return result

    def reindex(self, tenant: str, graph: str, source_ids: list[str]) -> int:
        rows = self._here("sources", tenant, graph).filter(F.col("source_id").isin(*source_ids))
        spans = chunk.chunks(rows, cut=chunk.Cut(self.settings.chunk_size, self.settings.chunk_overlap))
        made = extract.embed(spans, "text", self.embedder, self.settings.dimensions)
        locator = F.struct("start", "end", F.lit("char").alias("unit")).alias("locator")
        segments = made.select(F.lit(tenant).alias("tenant_id"), F.lit(graph).alias("graph_id"), uuid_of(F.col("source_id"), F.col("index").cast("string")).alias("segment_id"), "source_id", locator, "text", "embedding").persist()
        known = self._here("segments", tenant, graph).filter(F.col("source_id").isin(*source_ids)).select("segment_id")
        self.store.append("segments", segments.join(known, "segment_id", "left_anti"))
        n = segments.count()
        segments.unpersist()
        return n

    def reembed(self, tenant: str, graph: str) -> int:
        """Give a vector to the live nodes that have none."""
        version = self.store.version()
        rows = scope.live_nodes(self._here("nodes", tenant, graph)).filter("embedding is null").drop("embedding").withColumn("body", embed_text(F.col("title"), F.col("summary")))
        made = extract.embed(rows, "body", self.embedder, self.settings.dimensions).drop("body").persist()
        n = made.count()
        if n:
            self.store.commit(("nodes", UPSERT, made), expected=version)
        made.unpersist()
        return n

    def delete_tenant(self, tenant: str) -> None:
        """Delete all that is kept of a tenant, in all its graphs."""
        self.store.delete_tenant(tenant)

    def _mark(self, tenant: str, graph: str, ids: list[str], status: str, error: str | None = None) -> None:
        rows = self._here("sources", tenant, graph).filter(F.col("source_id").isin(*ids))
        self.store.commit(("sources", UPSERT, rows.withColumns({"extraction_status": F.lit(status), "extraction_error": F.lit(error).cast("string")})))

    def prompt(self, tenant: str, graph: str) -> list[str]:
        """What an extractor is told: the vocabulary and rules, then, so that names are reused, what the graph has."""
        s = self.settings
        lines = [f"{r['type']}: {r['line']}" for r in read.roster_lines(read.roster(self._here("nodes", tenant, graph), s.roster_limit, s.roster_aliases)).collect()]  # roster_limit entries at most
        return [x for x in (extract.system_prompt(self.ontology), extract.roster_block(lines)) if x]

    def _hosted(self, found: DataFrame, graph: str) -> DataFrame:
        """(cand_id, canonical_node_id, canonical_title) of the candidates that the host knows as its own."""
        ask = self.canonical

        def run(it):
            for pdf in it:
                got = [(c, ask(graph, t, title)) for c, t, title in zip(pdf["cand_id"], pdf["type"], pdf["title"], strict=True)]
                yield pd.DataFrame([(c, g.get("node_id"), g.get("title") or title) for (c, g), title in zip(got, pdf["title"], strict=True) if g], columns=["cand_id", "canonical_node_id", "canonical_title"])

        schema = "cand_id string, canonical_node_id string, canonical_title string"
        own = found.filter(F.col("type").isin(*self.ontology.canonical_types)).select("cand_id", "type", "title")
        return self.spark.createDataFrame(own.mapInPandas(run, schema).collect(), schema)  # one source's

    def _asked(self, found: DataFrame, nodes: DataFrame, spend: Spend):
        """The adjudicator as the ladder calls it, on nominated pairs alone; answers are kept, so none is paid twice."""
        ask, failed = self.adjudicator, "gate" if self.settings.fail_closed else "distinct"
        fields = lambda row, keys: {k: row[k] for k in keys}

        def run(it):
            for pdf in it:
                out = []
                for r in pdf.to_dict("records"):
                    try:
                        got = ask(fields(r["new"], ("type", "title", "summary")), fields(r["old"], ("type", "title", "summary", "aliases")))
                        verdict, usage = got if isinstance(got, tuple) else (got, {})
                        verdict = str(verdict or failed).strip().lower()
                    except Exception:  # noqa: BLE001  an outage costs extra nodes, or with fail_closed waits
                        verdict, usage = failed, {}
                    out.append((r["cand_id"], verdict, str(usage.get("model") or ""), int(usage.get("input_tokens") or 0), int(usage.get("output_tokens") or 0)))
                yield pd.DataFrame(out, columns=["cand_id", "verdict", "model", "input_tokens", "output_tokens"])

        def adjudicate(pairs: DataFrame) -> DataFrame:
            new = found.select("cand_id", F.struct("type", "title", "summary").alias("new"))
            shown = read.shown_summary(F.col("summary"), F.col("summaries")).alias("summary")
            old = nodes.select("node_id", F.struct("type", "title", shown, F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, 5).alias("aliases")).alias("old"))
            told = pairs.join(new, "cand_id").join(old, "node_id").select("cand_id", "new", "old").mapInPandas(run, "cand_id string, verdict string, model string, input_tokens long, output_tokens long").collect()  # one source's
            spend.add([r for r in told if r["model"] or r["input_tokens"]])
            return self.spark.createDataFrame([(r["cand_id"], r["verdict"]) for r in told], "cand_id string, verdict string")

        return adjudicate

    def _structure(self, tenant: str, graph: str, ids: list[str], run: str, actor: str, result: Result, spend: Spend) -> None:
        version = self.store.version()
        rows = self._here("sources", tenant, graph).filter(F.col("source_id").isin(*ids))
        got = extract.extract(chunk.batches(rows, most=self.settings.batch_chars), self.extractor, prompt=tuple(self.prompt(tenant, graph)), tell=True).persist()
        spend.add([r["usage"] for r in got.select("usage").collect()])
        broken = got.filter("error is not null").orderBy("index").first()
        if broken is not None:
            raise ExtractionFailed(broken["error"])
        names = F.posexplode("nodes").alias("place", "node")
        found = got.select("source_id", "index", names).select("source_id", (F.col("index").cast("long") * 1_000_000_000 + F.col("place")).alias("pos"), "node.*")
        found = extract.typed(found, self.ontology).withColumns({"tenant_id": F.lit(tenant), "graph_id": F.lit(graph), "run": F.lit(run), "body": embed_text(F.col("title"), F.col("summary"))})
        found = found.withColumns({"cand_id": uuid_of(F.col("run"), F.col("source_id"), F.col("pos").cast("string")), "aliases": F.when(F.col("surface_phrase").isNotNull(), F.array("surface_phrase"))})
        found = extract.embed(found, "body", self.embedder, self.settings.dimensions).persist()
        nodes = scope.live_nodes(self._here("nodes", tenant, graph))
        s = self.settings
        asked = {"adjudicate": self._asked(found, nodes, spend)} if self.adjudicator else {"verdicts": self.verdicts(found, nodes)} if self.verdicts else {}
        canonical = self._hosted(found, graph) if self.canonical is not no_canonical else None
        done = resolve.ladder(found, nodes, merge=s.merge_threshold, related=s.related_low, k=s.candidates, canonical=canonical, **asked).persist()
        full = found.join(done.drop("run", "pos", "type", "tenant_id", "graph_id"), "cand_id")
        if canonical is not None:  # a new entity of the host's goes by its name and keeps the text's wording as an alias
            adopted = (F.col("branch") == "canonical_new") & F.col("canonical_title").isNotNull()
            told = F.coalesce("aliases", F.array().cast("array<string>"))
            full = full.withColumn("aliases", F.when(adopted & (F.col("canonical_title") != F.col("title")), F.array_union(told, F.array("title"))).otherwise(F.col("aliases"))).withColumn("title", F.when(adopted, F.col("canonical_title")).otherwise(F.col("title")))
        now, cite = F.current_timestamp(), F.array(F.struct("source_id", F.lit(run).alias("run_id")))
        fresh = full.filter("creates").select(
            "tenant_id", "graph_id", F.col("cand_id").alias("node_id"), "kind", "type", "title", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "summary", F.array().cast("array<string>").alias("summaries"), cite.alias("citations"),
            F.array().cast("array<struct<alias:string,decision:string,branch:string>>").alias("merges"), F.lit(None).cast("array<string>").alias("conflict_node_ids"), F.lit(None).cast("string").alias("resolved"), F.lit("active").alias("status"), "confidence", F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("string").alias("layout"), "embedding", now.alias("created_at"), now.alias("updated_at"),
        )
        merges = full.filter("not creates").select("tenant_id", F.coalesce("same_run_id", "target_id").alias("node_id"), F.col("title").alias("alias"), "summary", F.col("pos").alias("seq"), cite.alias("cite"), F.array(F.struct(F.col("title").alias("alias"), F.lit("merge").alias("decision"), resolve.branch_label(F.col("branch")).alias("branch"))).alias("trail")).persist()
        extra = merges.groupBy("tenant_id", "node_id").agg(F.flatten(oplog.in_order(F.col("cite"))).alias("more_cites"), F.flatten(oplog.in_order(F.col("trail"))).alias("more_trail"))
        # Only nodes that something merged into are written again, beside the new ones.
        touched = self._here("nodes", tenant, graph).join(merges.select("node_id").distinct(), "node_id", "left_semi").select(*fresh.columns)
        folded = oplog.merge_fold(touched.unionByName(fresh), merges).drop("n_merges", "n_citations").join(extra, ["tenant_id", "node_id"], "left")
        folded = folded.withColumns({"citations": F.concat("citations", F.coalesce("more_cites", F.array().cast("array<struct<source_id:string,run_id:string>>"))), "merges": F.concat("merges", F.coalesce("more_trail", F.array().cast("array<struct<alias:string,decision:string,branch:string>>")))}).drop("more_cites", "more_trail")
        result.created, result.merged = fresh.count(), merges.count()
        cands = found.groupBy("source_id", "temp_id").agg(F.max_by("cand_id", "pos").alias("cand_id"))  # of nodes with one temp id, edges mean the last
        end = lambda side: cands.select("source_id", F.col("temp_id").alias(f"{side}_temp_id"), F.col("cand_id").alias(f"{side}_temp"))
        edges = got.select("source_id", F.inline("edges")).join(end("source"), ["source_id", "source_temp_id"]).join(end("target"), ["source_id", "target_temp_id"]).select("source_temp", "target_temp", "type", "confidence")
        real = resolve.edge_ends(edges, done).withColumns({"tenant_id": F.lit(tenant), "graph_id": F.lit(graph), "seq": F.concat_ws("|", "source_temp", "target_temp")})
        live = scope.live_edges(self._here("edges", tenant, graph))
        new = oplog.new_edges(real, live).select("tenant_id", "graph_id", uuid_of(F.lit(run), F.col("source_id"), F.col("target_id"), F.col("type")).alias("edge_id"), "source_id", "target_id", "type", F.lit("active").alias("status"), "confidence", now.alias("valid_at"), F.lit(None).cast("timestamp").alias("invalid_at"), F.lit(None).cast("timestamp").alias("expired_at")).persist()
        result.edges = new.count()
        old = nodes.select(F.col("node_id").alias("target_id"), F.col("title").alias("old_title"), F.col("type").alias("old_type"))
        told = {"new_id": "cand_id", "old_id": "target_id", "node_id": F.coalesce("same_run_id", "target_id"), "new_title": "title", "new_type": "type", "old_title": "old_title", "old_type": "old_type"}
        payload = F.map_filter(F.create_map(*[x for k, v in told.items() for x in (F.lit(k), F.col(v) if isinstance(v, str) else v)]), lambda k, v: v.isNotNull())
        ops = resolve.operations(done).select("cand_id", "k", "op").join(full.join(old, "target_id", "left"), "cand_id")
        listed = [(r["op"], r["payload"]) for r in ops.select("op", payload.alias("payload"), "pos", "k", "source_id").orderBy("source_id", "pos", "k").collect()]  # one source's operations
        self.store.commit(("nodes", UPSERT, folded), ("edges", INSERT, new), expected=version)
        held = self._record(tenant, graph, listed, run, actor, "extraction", f"{result.created} created, {result.merged} merged")
        result.changeset_id, result.gated = held[0], len(held[2])
        follow = [o for o in held[1] if o[1] in ("SUPERSEDE", "CONTRADICT")]  # the nodes and edges are there already
        if follow:
            self._take(tenant, graph, follow, result.changeset_id)
        self._mark(tenant, graph, ids, "done")
        result.status = "done"
        for frame in (got, found, done, new, merges):
            frame.unpersist()

    def _record(self, tenant: str, graph: str, ops: list[tuple[str, dict]], run: str | None, actor: str, origin: str, summary: str) -> tuple[str, list, list]:
        """Keep a list of operations with the gate's verdicts; its id, what takes effect and what waits, as (seq, op, payload)."""
        rows = self.spark.createDataFrame([(i, o, {k: str(v) for k, v in p.items() if v is not None}) for i, (o, p) in enumerate(ops)], "seq long, op string, payload map<string,string>")
        # A layout carries nothing else, whatever its caller sends along.
        rows = rows.withColumn("payload", F.when(F.col("op").isin(*oplog.PRESENTATION), oplog.layout(F.col("payload"))).otherwise(F.col("payload")))
        judged = oplog.gated(rows.withColumn("actor_kind", F.lit(actor))).select("seq", "op", "risk", "payload").orderBy("seq").collect()
        passed, held = ([(r["seq"], r["op"], r["payload"]) for r in judged if (r["risk"] == "high") == high] for high in (False, True))
        one = uuid.uuid4().hex
        row = [(tenant, graph, one, run, "partial" if held else "applied", [r.asDict() for r in judged], origin, actor, None, summary, None, None, None)]
        self.store.append("changesets", self.spark.createDataFrame(row, SCHEMAS["changesets"]).withColumn("created_at", F.current_timestamp()))
        return one, passed, held

    def _take(self, tenant: str, graph: str, ops: list[tuple[int, str, dict]], salt: str) -> dict:
        """Let operations take effect on the stored nodes and edges; doing it again changes nothing more."""
        frame = self.spark.createDataFrame([(tenant, graph, *o) for o in ops], "tenant_id string, graph_id string, seq long, op string, payload map<string,string>")
        version = self.store.version()
        nodes, edges = effects.concerned(self._here("nodes", tenant, graph), self._here("edges", tenant, graph), frame)
        effects.check(frame, nodes)
        done = effects.take_effect(nodes, edges, frame, salt=salt, question=self.ontology.open_question_type)
        count = lambda *names: sum(o in names for _, o, _ in ops)
        made = done.made.filter("op <> 'SUPERSEDE'").count()
        added = [(p["new_id"], self._vector(f"{p.get('title', '')}\n{p.get('summary', '')}".strip())) for _, o, p in ops if o == "ADD_NODE"]
        after = done.nodes
        if added:
            vectors = self.spark.createDataFrame(added, "node_id string, vector array<float>")
            after = after.join(vectors, "node_id", "left").withColumn("embedding", F.coalesce("embedding", "vector")).drop("vector")
        self.store.commit(("nodes", UPSERT, after), ("edges", UPSERT, done.changed), expected=version)
        return {"created_nodes": count("ADD_NODE", "CONTRADICT"), "merged_nodes": count("MERGE_NODE"), "updated_nodes": count("SUPERSEDE", "UPDATE_NODE", "REMOVE_NODE"), "created_edges": made}

    def apply(self, tenant: str, graph: str, ops: list[tuple[str, dict]], *, actor: str = "agent", origin: str = "host") -> Result:
        """Operations (name, payload) that a host proposes: the safe ones take effect, the others wait for a reviewer."""
        ops = [(o, {"new_id": uuid.uuid4().hex} | p if o == "ADD_NODE" else p) for o, p in ops]
        listed = self.spark.createDataFrame([(tenant, graph, i, o, {k: str(v) for k, v in p.items() if v is not None}) for i, (o, p) in enumerate(ops)], "tenant_id string, graph_id string, seq long, op string, payload map<string,string>")
        effects.check(oplog.applied(listed.withColumn("actor_kind", F.lit(actor))), self._here("nodes", tenant, graph))
        one, passed, held = self._record(tenant, graph, ops, None, actor, origin, f"{len(ops)} proposed")
        n = self._take(tenant, graph, passed, one) if passed else {"created_nodes": 0, "merged_nodes": 0, "created_edges": 0}
        return Result("done", changeset_id=one, created=n["created_nodes"], merged=n["merged_nodes"], edges=n["created_edges"], gated=len(held))

    # Reading

    def search(self, tenant: str, graph: str, query: str, *, top_k: int = 10, min_score: float | None = None) -> DataFrame:
        return read.search_segments(self._here("segments", tenant, graph), self._here("sources", tenant, graph), self._vector(query), top_k, min_score)

    def recall(self, tenant: str, graph: str, query: str, *, hops: int = 1, top_k: int = 8, max_nodes: int = 30, min_score: float | None = None) -> tuple[DataFrame, DataFrame]:
        return read.recall(self._here("nodes", tenant, graph), self._here("edges", tenant, graph), self._vector(query), top_k, hops, max_nodes, min_score)

    def neighbors(self, tenant: str, graph: str, node_id: str, *, hops: int = 1) -> tuple[DataFrame, DataFrame]:
        return read.neighbors(self._here("nodes", tenant, graph), self._here("edges", tenant, graph), node_id, hops)

    def evidence(self, tenant: str, graph: str, node_id: str) -> DataFrame:
        nodes = self._here("nodes", tenant, graph).withColumn("citations", F.transform("citations", lambda c: c["source_id"]))
        return read.evidence(nodes, self._here("sources", tenant, graph), node_id)

    def conflicts(self, tenant: str, graph: str) -> DataFrame:
        return read.conflicts(self._here("nodes", tenant, graph), self.ontology.open_question_type)

    def pending(self, tenant: str, graph: str) -> DataFrame:
        return govern.pending(self._here("changesets", tenant, graph))

    def review(self, tenant: str, graph: str, changeset_id: str, *, approve: bool, reviewer_id: str | None = None) -> dict:
        """Decide on a changeset; an error if it is unknown or decided already.  Approved operations take effect first,
        so that a failure leaves the changeset waiting, and may be approved again."""
        kept = self._here("changesets", tenant, graph).filter(F.col("changeset_id") == changeset_id)
        mine = kept.select("status", "ops").first()
        if mine is None:
            raise ScopeViolation(changeset_id)
        if mine["status"] not in govern.REVIEWABLE:
            raise GraphError(f"changeset {changeset_id} is {mine['status']}")
        risky = [(o["seq"], o["op"], o["payload"]) for o in mine["ops"] if o["risk"] == "high"]
        counts = self._take(tenant, graph, risky, changeset_id) if approve and risky else {}
        self.store.commit(("changesets", UPSERT, govern.review(kept, changeset_id, approve, reviewer_id, None).withColumn("reviewed_at", F.current_timestamp())))
        return {"changeset_id": changeset_id, "status": "applied" if approve else "rejected", "gated_ops": len(risky), **counts}

    def health(self, tenant: str, graph: str) -> DataFrame:
        return govern.health(*(self._here(t, tenant, graph) for t in ("nodes", "edges", "sources", "segments", "changesets")))
