"""The registered queries: each applies an operator to the fixture views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunk, effects, extract, govern, oplog, read, resolve, scope
from ..sources.capture import capture, latest
from ..sources.fixtures import Fixtures
from ..sources.schema import Ontology

#: Of the fixtures, whose vectors are less alike than real ones.
MERGE, RELATED = 0.40, 0.30
TENANT, GRAPH = "acme", "main"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
    return f


def here(rows: DataFrame) -> DataFrame:
    return scope.scoped(rows, TENANT, GRAPH)


def score(c: str = "score") -> F.Column:
    return F.round(c, 6).alias("score")


# Scans, sources, sinks


@query
def src_capture(x: Fixtures) -> DataFrame:
    rows = x.table("pages").select(F.col("html").alias("content"), F.col("url").alias("external_ref"))
    got = capture(rows, "run-1", tenant=TENANT, graph=GRAPH, origin="web")
    return got.select("tenant_id", "graph_id", "source_id", "origin", "external_ref", F.length("raw_content").cast("long").alias("n_chars"), "extraction_status")


@query
def seg_index(x: Fixtures) -> DataFrame:
    spans = chunk.chunks(x.sources())
    return extract.embed(spans, "text", extract.hash_embedder(), 64).select("source_id", "index", "start", "end", F.size("embedding").alias("width"))


@query
def src_lookup(x: Fixtures) -> DataFrame:
    mine = (F.col("tenant_id") == TENANT) & (F.col("graph_id") == GRAPH)
    return x.sources().filter("source_id in (8, 9)").select("source_id", "tenant_id", "graph_id", "origin", mine.alias("in_scope"))


@query
def run_latest(x: Fixtures) -> DataFrame:
    return latest(x.runs(), "user_id", "run_id", "status", "model")


@query
def cs_build(x: Fixtures) -> DataFrame:
    ops = F.array_join(F.transform("ops", lambda o: F.concat_ws(":", o["seq"], o["op"], o["risk"])), ",")
    return x.changesets().select("tenant_id", "node_id", "day", "status", F.size("ops").alias("n_ops"), ops.alias("ops"))


@query
def scoped_nodes(x: Fixtures) -> DataFrame:
    return here(x.nodes(False)).select("node_id", "type", "title", "status")


@query
def tenant_row_counts(x: Fixtures) -> DataFrame:
    tables = {"sources": x.sources(), "nodes": x.nodes(False), "edges": x.edges(), "segments": x.segments()}
    out = None
    for name, rows in tables.items():
        one = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "tenant_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


# Projections, filters, predicates


@query
def live_nodes(x: Fixtures) -> DataFrame:
    return scope.live_nodes(here(x.nodes(False))).select("node_id", "kind", "type", "confidence")


@query
def live_edges(x: Fixtures) -> DataFrame:
    return scope.live_edges(here(x.edges())).select("edge_id", "source_id", "target_id", "type", "valid_at")


@query
def edges_by_type(x: Fixtures) -> DataFrame:
    return scope.live_edges(here(x.edges()), ["affects", "contains"]).select("edge_id", "type")


@query
def node_details(x: Fixtures) -> DataFrame:
    ids = x.table("part").filter("p_size = 7").select(F.col("p_partkey").alias("id"))
    return read.details(scope.only_ids(here(x.nodes(False)), "node_id", ids)).withColumnRenamed("id", "node_id")


@query
def pending_changesets(x: Fixtures) -> DataFrame:
    got = govern.pending(x.changesets())
    ops = F.array_join(F.transform("ops", lambda o: F.concat_ws(":", o["seq"], o["op"])), ",")
    return got.select("changeset_id", "status", ops.alias("ops"), "created_at")


@query
def search_min_score(x: Fixtures) -> DataFrame:
    return read.search_segments(here(x.segments()), here(x.sources()), x.query(), 10, 0.15).select("segment_id", "source_id", score(), "origin")


@query
def json_project(x: Fixtures) -> DataFrame:
    return x.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def evidence(x: Fixtures) -> DataFrame:
    return read.evidence(here(x.nodes(False)), here(x.sources()), 8).withColumn("lang", F.col("metadata")["lang"]).drop("metadata")


@query
def conflicts(x: Fixtures) -> DataFrame:
    got = read.conflicts(scope.scoped(x.open_questions(), "globex", "main"))
    return got.select("open_question_id", "title", F.array_join("conflict_node_ids", ",").alias("conflict_node_ids"), "resolved", "created_at")


def small_ontology(strict: bool) -> Ontology:
    return Ontology(node_types={"entity": ("entity/feature",), "knowledge": ("knowledge/decision",)}, strict=strict)


@query
def strict_types(x: Fixtures) -> DataFrame:
    rows = x.nodes(False).select("node_id", "type")
    strict = extract.typed(rows, small_ontology(True)).select("node_id", "type", "kind", "known", F.lit(True).alias("strict"))
    return strict.unionByName(extract.typed(rows, small_ontology(False)).select("node_id", "type", "kind", "known", F.lit(False).alias("strict")))


@query
def valid_edges(x: Fixtures) -> DataFrame:
    nodes = x.nodes(False).filter("node_id % 3 <> 0").select("tenant_id", F.col("node_id").alias("temp_id"))
    return extract.proper_edges(x.edges(), nodes, "tenant_id").select("edge_id", "source_id", "target_id")


@query
def layout_sanitize(x: Fixtures) -> DataFrame:
    payload = F.create_map(F.lit("node_id"), F.col("node_id").cast("string"), F.lit("view"), F.col("alias"), F.lit("layout"), F.col("summary"), F.lit("title"), F.lit("hidden"), F.lit("status"), F.lit("rejected"))
    kept = x.ops().withColumn("payload", oplog.layout(payload))
    last = kept.groupBy("tenant_id", "node_id").agg(F.max_by("payload", "seq").alias("payload"))
    pairs = F.array_sort(F.transform(F.map_entries("payload"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return last.select("tenant_id", "node_id", F.array_join(pairs, ";").alias("payload"))


@query
def wire_parse(x: Fixtures) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"title":"a"},{"title":"n'), k, F.lit('"},7]'))).when(F.col("event_id") % 3 == 1, F.lit("[]")).otherwise(F.lit("not json"))
    answers = x.table("events").select("event_id", F.lit(0).alias("index"), raw.alias("text"))
    got = extract.extract(answers, lambda text: {"nodes": text, "edges": "[]"}, "event_id")
    return got.select("event_id", F.size("nodes").alias("n"), F.array_join(F.transform("nodes", lambda n: n["title"]), ",").alias("items"))


# Joins, windows, top-k


@query
def search_segments(x: Fixtures) -> DataFrame:
    return read.search_segments(here(x.segments()), here(x.sources()), x.query(), 10).select("segment_id", "source_id", "text", F.concat(F.col("locator.start"), F.lit("-"), F.col("locator.end"), F.lit(" "), F.col("locator.unit")).alias("locator"), score(), "origin")


@query
def sources_unindexed(x: Fixtures) -> DataFrame:
    return govern.unindexed(here(x.sources()), here(x.segments())).select("source_id", "origin")


@query
def edge_dedup_insert(x: Fixtures) -> DataFrame:
    # The rows of even orders are there already; all rows are proposed.
    return oplog.new_edges(x.edges().withColumn("seq", F.col("edge_id")), scope.live_edges(x.edges().filter("seq % 2 = 0"))).select("edge_id", "tenant_id", "graph_id", "source_id", "target_id", "type")


def _start(x: Fixtures) -> DataFrame:
    return x.spark.createDataFrame([(8, 1, 1.0)], "id long, reach int, score double")


@query
def edges_touching(x: Fixtures) -> DataFrame:
    ids = x.table("part").filter("p_size = 3").select(F.col("p_partkey").alias("id"))
    return read.edges_touching(here(x.edges()), ids).select("edge_id", "source_id", "target_id", "type")


@query
def knn_candidates(x: Fixtures) -> DataFrame:
    return resolve.nearest_nodes(x.candidates(), x.graph_nodes()).select("cand_id", "node_id", score(), "rank")


@query
def best_candidates(x: Fixtures) -> DataFrame:
    got = resolve.best_candidates(x.candidates(), x.graph_nodes())
    return got.select("cand_id", "same_id", F.round("same_score", 6).alias("same_score"), "any_id", F.round("any_score", 6).alias("any_score"))


@query
def title_exact(x: Fixtures) -> DataFrame:
    return resolve.title_exact(x.candidates(), x.graph_nodes())


@query
def title_fuzzy(x: Fixtures) -> DataFrame:
    return resolve.title_fuzzy(x.candidates(), x.graph_nodes())


def _verdicts(x: Fixtures) -> DataFrame:
    i = F.col("node_id")
    verdict = F.when(i % 20 == 0, "duplicate").when(i % 20 == 5, "supersedes").when(i % 20 == 10, "contradicts").otherwise("distinct")
    return x.nodes(False).filter(i % 5 == 0).select(i.alias("cand_id"), verdict.alias("verdict")).distinct()


def _resolved(x: Fixtures) -> DataFrame:
    return resolve.ladder(x.candidates(), x.graph_nodes(), merge=MERGE, related=RELATED, verdicts=_verdicts(x))


@query
def resolve_branches(x: Fixtures) -> DataFrame:
    return _resolved(x).select("cand_id", "branch", "decision", "target_id", "same_run_id", "creates", score())


@query
def adjudicate_ops(x: Fixtures) -> DataFrame:
    ops = resolve.operations(_resolved(x).filter(F.startswith("own", F.lit("adjudicated_"))))
    return ops.select("cand_id", "k", "op", oplog.risk(F.col("op"), F.lit("agent")).alias("risk"))


@query
def canonical_ops(x: Fixtures) -> DataFrame:
    # Candidates of entity types with a host entity: every third exists as the node two below, the others have none.
    i, fifth = F.col("node_id"), x.div(F.col("node_id"), 5)
    host = x.nodes(False).filter((i % 5 == 0) & (F.col("kind") == "entity") & (fifth % 4 == 1))
    known = fifth % 3 == 0
    titled = F.when(known & (fifth % 2 == 0), F.col("title")).otherwise(F.concat(F.lit("host "), F.col("kind"), F.lit(" "), (fifth % 7).cast("string")))
    canonical = host.select(i.alias("cand_id"), F.when(known, i + 2).alias("canonical_node_id"), titled.alias("canonical_title"))
    got = resolve.ladder(x.candidates(), x.graph_nodes(), merge=MERGE, related=RELATED, canonical=canonical, verdicts=_verdicts(x))
    return got.filter("canonical_title is not null").select("cand_id", "branch", "decision", "target_id", "same_run_id", "creates")


@query
def same_run_memo(x: Fixtures) -> DataFrame:
    return resolve.memo(x.memo()).select("run", "pos", "branch", "same_run_id")


@query
def edge_resolve(x: Fixtures) -> DataFrame:
    edges = x.edges().select("edge_id", F.col("source_id").alias("source_temp"), F.col("target_id").alias("target_temp"), "type")
    return resolve.edge_ends(edges, _resolved(x)).select("edge_id", "source_id", "target_id", "type")


@query
def scope_violations(x: Fixtures) -> DataFrame:
    ids = x.table("part").filter("p_size = 7").select(F.col("p_partkey").alias("node_id"))
    return scope.out_of_scope(ids, here(x.nodes(False)))


@query
def canonical_trigram(x: Fixtures) -> DataFrame:
    names = x.table("customer").select(F.concat("c_mktsegment", F.lit(" desk")).alias("name")).distinct()
    got = resolve.trigram_best(names, x.table("part").select(F.col("p_type").alias("title")).unionByName(x.table("customer").select(F.col("c_mktsegment").alias("title"))).distinct(), 0.1)
    return got.select("name", "title", score())


@query
def neighbors_1hop(x: Fixtures) -> DataFrame:
    return read.neighbors(here(x.nodes(False)), here(x.edges()), 8, 1)[0].select("id", "type", "status", "score", "reach")


@query
def neighbors_2hop(x: Fixtures) -> DataFrame:
    return read.neighbors(here(x.nodes(False)), here(x.edges()), 8, 2, 1000)[0].select("id", "type", "status", "score", "reach")


@query
def neighbors_capped(x: Fixtures) -> DataFrame:
    got, _ = read.grow(_start(x), here(x.edges()), 2, 5)
    return got.select("id", "reach", "hop")


@query
def recall_seeds(x: Fixtures) -> DataFrame:
    return read.seeds(here(x.nodes()), x.query()).select("node_id", "kind", "type", "title", "summary", score())


def _recall(x: Fixtures) -> tuple[DataFrame, DataFrame]:
    return read.recall(here(x.nodes()), here(x.edges()), x.query())


@query
def recall_nodes(x: Fixtures) -> DataFrame:
    return _recall(x)[0].select("id", "kind", "type", "title", "summary", "status", "confidence", score(), "reach")


@query
def recall_edges(x: Fixtures) -> DataFrame:
    return _recall(x)[1]


@query
def render_edges(x: Fixtures) -> DataFrame:
    nodes, _ = _recall(x)
    some = here(x.edges()).filter("invalid_at is null").select("source_id", "target_id", "type").distinct()
    return read.edge_lines(nodes, some)


@query
def context_text(x: Fixtures) -> DataFrame:
    nodes, edges = _recall(x)
    text = read.context_text(nodes.collect(), edges.orderBy("source_id", "target_id", "type").collect())  # max_nodes rows at most
    return x.spark.createDataFrame([(text,)], "context string")


@query
def roster(x: Fixtures) -> DataFrame:
    return read.roster(here(x.nodes(False))).select("rank", "node_id", "type", "title", F.array_join("aliases", ", ").alias("aliases"))


@query
def roster_render(x: Fixtures) -> DataFrame:
    return read.roster_lines(read.roster(here(x.nodes(False)), 60))


# Aggregations


@query
def health(x: Fixtures) -> DataFrame:
    return govern.health(*(here(t) for t in (x.nodes(), x.edges(), x.sources(), x.segments())), x.changesets())


@query
def candidate_summary(x: Fixtures) -> DataFrame:
    more = F.when(F.col("node_id") % 2 == 0, F.array("type", "kind"))
    return x.nodes(False).select("node_id", T.folded_summary(F.col("summary"), more).alias("summary"))


@query
def merged_summary(x: Fixtures) -> DataFrame:
    own = F.when(F.col("node_id") % 3 != 0, F.col("summary"))
    more = F.when(F.col("node_id") % 2 == 0, F.array(F.concat(F.lit("  "), F.col("kind")), F.lit(" "), F.col("summary"), "kind"))
    return x.nodes(False).select("node_id", read.shown_summary(own, more).alias("summary"))


@query
def cost_daily(x: Fixtures) -> DataFrame:
    return govern.cost_daily(x.runs())


@query
def run_spend(x: Fixtures) -> DataFrame:
    return govern.run_spend(x.runs().withColumn("model", F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("model"))), "user_id")


@query
def apply_metrics(x: Fixtures) -> DataFrame:
    return oplog.metrics(x.ops())


def _merged(x: Fixtures) -> DataFrame:
    return oplog.merge_fold(x.nodes(False), oplog.applied(x.ops()).filter("op = 'MERGE_NODE'"))


@query
def merge_aliases(x: Fixtures) -> DataFrame:
    return _merged(x).select("node_id", F.array_join("aliases", "|").alias("aliases"))


@query
def merge_fold(x: Fixtures) -> DataFrame:
    return _merged(x).select("node_id", F.array_join("summaries", "|").alias("summaries"), F.col("n_citations").cast("long").alias("n_citations"), F.col("n_merges").cast("long").alias("n_merges"))


# Functions


@query
def norm_title(x: Fixtures) -> DataFrame:
    return x.nodes(False).select("node_id", T.norm_title(F.col("title")).alias("norm"))


@query
def titles_match(x: Fixtures) -> DataFrame:
    a = x.nodes(False).select("node_id", "title")
    b = x.nodes(False).select((F.col("node_id") + 1).alias("node_id"), F.concat(F.element_at(F.split("title", " "), 1), F.lit(" "), F.array_join(F.slice(F.split("title", " "), 2, 3), " ")).alias("other"))
    c = a.withColumn("other", F.concat(F.lit("The "), F.array_join(F.slice(F.split("title", " "), 1, 7), " ")))
    both = a.join(b, "node_id").unionByName(c)
    return both.select("node_id", "other", T.titles_match(F.col("title"), F.col("other")).alias("matches"))


@query
def cosine_pairs(x: Fixtures) -> DataFrame:
    v = x.table("embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query
def l2_normalize(x: Fixtures) -> DataFrame:
    scaled = F.transform("embedding", lambda e: e * (F.col("vec_id") + 1))
    unit = V.l2_normalize(scaled, 64)
    return x.table("embeddings").select("vec_id", F.round(V.norm(unit), 6).alias("norm"), F.round(unit[0], 6).alias("first"))


@query
def embed_text(x: Fixtures) -> DataFrame:
    summary = F.when(F.col("node_id") % 2 == 0, F.col("summary"))
    return x.nodes(False).select("node_id", T.embed_text(F.concat(F.lit("  "), F.col("title")), summary).alias("text"))


@query
def kind_of(x: Fixtures) -> DataFrame:
    i = F.col("node_id") % 6
    label = F.when(i == 0, "loose").when(i == 2, "entity").when(i == 4, "foo/bar").otherwise(F.col("type"))
    return x.nodes(False).select("node_id", T.kind_of(label).alias("kind"))


@query
def gate_classify(x: Fixtures) -> DataFrame:
    op = F.when(F.col("seq") % 11 == 0, "EXPLODE").when(F.col("seq") % 13 == 0, "SET_LAYOUT").otherwise(F.col("op"))
    return oplog.gated(x.ops().withColumn("op", op)).select("seq", "op", "actor_kind", "risk")


# Pipeline


@query
def chunk_spans(x: Fixtures) -> DataFrame:
    return chunk.chunks(x.sources(), cut=chunk.Cut(400, 60)).select("source_id", "index", "start", "end", "text")


@query
def chunk_invariant(x: Fixtures) -> DataFrame:
    spans = chunk.chunks(x.sources(), cut=chunk.Cut(400, 60)).join(x.sources().select("source_id", "raw_content"), "source_id")
    quoted = F.substring("raw_content", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")
    per = spans.groupBy("source_id").agg(F.bool_and(quoted).alias("quoted"), F.min("start").alias("first"), F.max("end").alias("last"), (F.max("index") + 1 == F.count(F.lit(1))).alias("numbered"))
    return per.select("source_id", "quoted", "numbered", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query
def extract_batches(x: Fixtures) -> DataFrame:
    return chunk.batches(x.sources(), most=2000).select("source_id", "index", "start", "end")


@query
def extract_nodes(x: Fixtures) -> DataFrame:
    got = extract.extract(chunk.batches(x.sources()), extract.line_extractor)
    return extract.typed(got.select("source_id", F.inline("nodes")), Ontology()).select("source_id", "temp_id", "type", "kind", "title")


@query
def gate_split(x: Fixtures) -> DataFrame:
    return oplog.gated(x.ops()).groupBy("tenant_id", "op", "risk").agg(F.count(F.lit(1)).alias("n"))


#: When the lists of operations take effect.
AT = 1735689600
OTHER = "(node_id + 20 * (1 + seq % 6)) % 140"  # another node of the scope


def _log(x: Fixtures) -> DataFrame:
    """The log with its payloads."""
    u, other = F.col("node_id").cast("string"), F.expr(f"cast({OTHER} as string)")
    kinds = {"MERGE_NODE": {"node_id": u, "alias": "alias", "summary": "summary"}, "UPDATE_NODE": {"node_id": u, "title": "alias"}, "REMOVE_NODE": {"node_id": u}, "SUPERSEDE": {"new_id": other, "old_id": u}, "ADD_EDGE": {"source_id": u, "target_id": other, "type": F.lit("references")}}
    value = F.lit(None).cast("map<string,string>")
    for op, own in kinds.items():
        value = F.when(F.col("op") == op, F.create_map(*[y for k, v in own.items() for y in (F.lit(k), F.col(v) if isinstance(v, str) else v)])).otherwise(value)
    return x.ops().withColumns({"graph_id": x.graph(F.col("node_id")), "payload": value})


def _effects(x: Fixtures, ops: DataFrame) -> effects.Effects:
    """What a list of operations does to the whole graph."""
    none, time = lambda t: F.lit(None).cast(t), lambda c: F.timestamp_seconds(F.col(c))
    text = lambda c: F.col(c).cast("string").alias(c)
    nodes = x.nodes(False).select(
        "tenant_id", "graph_id", text("node_id"), "kind", "type", "title", "aliases", "summary", "summaries", F.transform("citations", lambda c: F.struct(c.cast("string").alias("source_id"), none("string").alias("run_id"))).alias("citations"),
        none("array<string>").alias("conflict_node_ids"), none("string").alias("resolved"), "status", "confidence", time("deleted_at").alias("deleted_at"), none("string").alias("layout"), time("created_at").alias("created_at"), time("updated_at").alias("updated_at"),
    )
    edges = x.edges().select("tenant_id", "graph_id", "edge_id", text("source_id"), text("target_id"), "type", F.lit("active").alias("status"), none("double").alias("confidence"), time("valid_at").alias("valid_at"), time("invalid_at").alias("invalid_at"), none("timestamp").alias("expired_at"))
    return effects.take_effect(nodes, edges, ops.select("tenant_id", "graph_id", "seq", "op", "payload"), salt="list", at=F.timestamp_seconds(F.lit(AT)))


def _states(done: effects.Effects) -> DataFrame:
    return done.nodes.select("tenant_id", F.col("node_id").cast("long").alias("node_id"), "status", "title", F.col("deleted_at").isNotNull().alias("deleted"), F.array_join("aliases", "|").alias("aliases"))


def _ends(done: effects.Effects) -> DataFrame:
    """All edges; those that an operation made go by their ends, as their ids follow from the list's."""
    made = F.concat_ws(">", "source_id", "target_id")
    return done.edges.select(F.when(F.col("type").isin("supersedes", "references", "contradicts"), made).otherwise(F.col("edge_id")).alias("name"), "type", F.col("invalid_at").isNotNull().alias("ended"))


@query
def apply_gated(x: Fixtures) -> DataFrame:
    return _states(_effects(x, oplog.applied(_log(x), F.col("seq") % 2 == 0)))


@query
def fold_nodes(x: Fixtures) -> DataFrame:
    return _states(_effects(x, oplog.applied(_log(x), F.lit(True))))


@query
def supersede_effect(x: Fixtures) -> DataFrame:
    return _ends(_effects(x, _log(x).filter("op = 'SUPERSEDE'")))


@query
def remove_effect(x: Fixtures) -> DataFrame:
    return _ends(_effects(x, _log(x).filter("op = 'REMOVE_NODE'")))


@query
def contradict_effect(x: Fixtures) -> DataFrame:
    pair = F.create_map(F.lit("new_id"), F.col("node_id").cast("string"), F.lit("old_id"), F.expr(f"cast({OTHER} as string)"), F.lit("new_title"), F.col("alias"), F.lit("old_title"), F.when(F.col("seq") % 2 == 0, F.col("summary")))
    done = _effects(x, _log(x).filter("op = 'ADD_EDGE'").withColumns({"op": F.lit("CONTRADICT"), "payload": pair}))
    return done.nodes.filter("conflict_node_ids is not null").select("tenant_id", "kind", "type", "title", F.array_join("conflict_node_ids", ",").alias("conflict_node_ids"), "resolved")


@query
def update_effect(x: Fixtures) -> DataFrame:
    return _effects(x, _log(x).filter("op = 'UPDATE_NODE'")).nodes.select(F.col("node_id").cast("long").alias("node_id"), "title", "type")


@query
def disconnect_effect(x: Fixtures) -> DataFrame:
    cut = x.ops().filter("op = 'UPDATE_NODE'").select(F.col("node_id").alias("seq"))
    ops = x.edges().join(cut, "seq", "left_semi").select("tenant_id", "graph_id", "seq", F.lit("DISCONNECT").alias("op"), F.create_map(F.lit("edge_id"), F.col("edge_id")).alias("payload"))
    return _ends(_effects(x, ops))


@query
def tenant_deleted(x: Fixtures) -> DataFrame:
    """Rows left of each table once a tenant is deleted."""
    out = None
    for name, rows in (("sources", x.sources()), ("nodes", x.nodes(False)), ("edges", x.edges()), ("segments", x.segments())):
        one = govern.without_tenant(rows, TENANT).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tenant_id") == TENANT).alias("theirs")).select(F.lit(name).alias("table_name"), "n", "theirs")
        out = one if out is None else out.unionByName(one)
    return out


@query
def without_vector(x: Fixtures) -> DataFrame:
    """What has to be embedded again: the text of every live node that has no vector."""
    rows = govern.without_vector(x.nodes())
    return rows.select("node_id", T.embed_text(F.col("title"), F.col("summary")).alias("text"))


@query
def review_transition(x: Fixtures) -> DataFrame:
    cs = x.changesets().withColumns({"reviewed_by": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp")})
    first = cs.filter("status = 'partial'").agg(F.min("changeset_id")).first()[0]
    return govern.review(cs, first, False, "ada", "2024-06-01").select("changeset_id", "status", "reviewed_by")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall around the closest nodes of a query."""
    return QUERIES["recall_nodes"](spark, sf_dir)


__all__ = ["QUERIES", "Window", "flagship"]
