"""The graph operators: every query against its SQL, and behaviours on small inputs."""

from __future__ import annotations

import math
import numbers
import random

import duckdb
import pandas as pd
import pytest
from claimgraph.api import Graph
from claimgraph.functions.text import norm_title
from claimgraph.operators import chunk, effects, extract, oplog, read, resolve
from claimgraph.plans import catalog, oracle
from claimgraph.sources.schema import ConcurrentModification, EmbeddingUnavailable, GraphError, ScopeViolation, Settings
from claimgraph.sources.store import Store
from claimgraph.tools import TOOLS, ToolServer
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    clean = lambda v: None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.all_queries()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(oracle.all_queries()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


CORPORA = ["", "word", "One sentence here.", "para one\n\npara two\n \t\npara three " * 40, "- item one\n- item two\n" * 80, "x" * 5000, "y" * 3000 + " tail", "\n\n\n\na\n\n\n\nb" * 60, "  lead and trail  \n", "é ü ß " * 300, "line\r\nline two\r\n\r\n" * 90]


@pytest.mark.parametrize("cut", [chunk.Cut(), chunk.Cut(100, 10), chunk.Cut(64, 0), chunk.Cut(5000, 1000)])
@pytest.mark.parametrize("text", CORPORA)
def test_chunks(text, cut):
    spans = list(chunk.Spans(text, cut))
    assert spans == list(chunk.Spans(text, cut))
    assert bool(spans) == bool(text.strip())
    covered = set()
    for a, b in spans:
        assert text[a:b] == text[a:b].strip() and a < b
        assert b - a <= cut.size or not any(c.isspace() for c in text[a:b])
        covered |= set(range(a, b))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert [a for a, _ in spans] == sorted({a for a, _ in spans})


@pytest.mark.parametrize("size,overlap", [(10, 10), (10, 11), (0, 0), (10, -1)])
def test_chunk_settings_are_checked(size, overlap):
    with pytest.raises(ValueError):
        chunk.Cut(size, overlap)


def test_vectors_are_never_made_up():
    assert extract.checked([[3.0, 4.0]], 1, 2) == [[0.6, 0.8]]
    for bad, n, width in (([[0.0, 0.0]], 1, 2), ([[float("nan"), 1.0]], 1, 2), ([[1.0]], 1, 2), ([[1.0, 0.0]], 2, 2), ([[]], 1, None)):
        with pytest.raises(EmbeddingUnavailable):
            extract.checked(bad, n, width)


def test_gate(spark):
    rows = [(o, a) for o in (*oplog.PRESENTATION, *oplog.ADDITIVE, *oplog.TRUTH, "OTHER") for a in ("human", "agent", None)]
    got = oplog.gated(spark.createDataFrame(rows, "op string, actor_kind string")).collect()
    for r in got:
        assert (r["risk"] == "high") == (r["op"] == "OTHER" or r["op"] in oplog.TRUTH and r["actor_kind"] != "human")
    with pytest.raises(Exception, match="unknown operation"):
        oplog.applied(spark.createDataFrame([("OTHER", "agent")], "op string, actor_kind string"), F.lit(True)).collect()


def test_fuzzy_titles_with_repeated_words_match_brute_force(spark):
    pick = random.Random(6)
    title = lambda: " ".join(pick.choice(["Ash", "ash,", "birch", "cedar", "dill", "The"]) for _ in range(pick.randint(0, 7)))
    scope = lambda: ("a", pick.choice("gh"), "k", pick.choice("tu"))
    nodes = [(n, *scope(), title(), pick.choice([None, [], [title()], [title(), None, "Ash ash"]]), n * 7 % 30) for n in range(120)]
    nodes += [(200, "a", "g", "k", "t", "elm elm", None, 9), (201, "a", "g", "k", "t", "elm", None, 5), (202, "a", "g", "k", "t", "elm", ["elm Elm"], 2), (203, "a", "g", "k", "t", "elm elm elm", None, 1)]
    cands = [(c, *scope(), title(), None, None) for c in range(150)] + [(300 + i, "a", "g", "k", "t", " ".join(["elm"] * i), None, None) for i in range(1, 5)]
    shape = "tenant_id string, graph_id string, kind string, type string, title string, aliases array<string>, created_at long"
    got = resolve.title_fuzzy(spark.createDataFrame(cands, f"cand_id long, {shape}"), spark.createDataFrame(nodes, f"node_id long, {shape}")).collect()
    words = lambda t: [w for w in (t or "").lower().replace(",", " ").split() if w != "the"]
    expected = {}
    for c, *where, asked, _, _ in cands:
        a = words(asked)
        near = [(at, n) for n, *there, name, more, at in nodes for b in map(words, [name, *(more or [])]) if where == there and a and b and a != b and 5 * len(set(a) & set(b)) >= 4 * max(len(set(a)), len(set(b)))]
        expected |= {c: min(near)[1]} if near else {}
    assert {r["cand_id"]: r["node_id"] for r in got} == expected and len(got) == len(expected)
    assert [expected[300 + i] for i in range(1, 5)] == [203, 203, 202, 203]


@pytest.fixture(scope="module")
def stuttering(tmp_path_factory):
    """Tables whose titles repeat few words, with no vectors to go by."""
    pick, folder = random.Random(7), tmp_path_factory.mktemp("stuttering")
    texts = [" ".join(pick.choice("ash birch cedar dill elm fir".split()) for _ in range(pick.randint(1, 8))) for _ in range(2000)]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "web", "n_chars": [len(t) for t in texts]}).to_parquet(folder / "documents.parquet")
    pd.DataFrame({"vec_id": [-1], "embedding": [[1.0, 0.0]]}).to_parquet(folder / "embeddings.parquet")
    con = duckdb.connect()
    for t in TABLES:
        if t not in ("documents", "embeddings"):
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["title_fuzzy", "resolve_branches", "adjudicate_ops", "edge_resolve", "canonical_ops"])
def test_repeated_words_equal_sql(spark, stuttering, name):
    folder, con = stuttering
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(oracle.all_queries()[name]).df()
    assert plain(got) == plain(want) and len(got)


@pytest.fixture(scope="module")
def far_ids(tmp_path_factory):
    """Tables whose ids lie below zero, around it, and beyond the whole numbers that doubles hold."""
    source, folder = "/root/testdata/sf0.01", tmp_path_factory.mktemp("far_ids")
    con = duckdb.connect()
    for t in TABLES:
        key = {"documents": "doc_id", "embeddings": "vec_id"}.get(t)
        if key:
            con.execute(f"copy (select * replace (CASE WHEN {key} < 350 THEN {key} - 150 ELSE {key} + {2**53} END AS {key}) from '{source}/{t}.parquet') to '{folder}/{t}.parquet' (format parquet)")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{source}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["adjudicate_ops", "canonical_ops", "edge_resolve", "resolve_branches"])
def test_far_ids_equal_sql(spark, far_ids, name):
    folder, con = far_ids
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(oracle.all_queries()[name]).df()
    assert plain(got) == plain(want) and len(got)


def altered(tmp_path_factory, name, **change):
    """A folder with the tables of sf0.01, and DuckDB's views of them; ``change`` maps a table's name to its new rows."""
    source, folder, con = "/root/testdata/sf0.01", tmp_path_factory.mktemp(name), duckdb.connect()
    for t in TABLES:
        if t in change:
            con.execute(f"copy ({change[t].format(f"'{source}/{t}.parquet'")}) to '{folder}/{t}.parquet' (format parquet)")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{source}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.fixture(scope="module")
def repeated_ids(tmp_path_factory):
    """Some ids stand twice, with the same or another text, and some titles have a capital I with a dot."""
    dotted = "select * replace (CASE WHEN doc_id % 3 = 0 THEN 'İ' || text ELSE text END AS text) from {0}"
    twice = f"{dotted} union all {dotted} where doc_id % 25 in (5, 7, 10) union all select a.* replace (b.text as text) from {{0}} a join {{0}} b on b.doc_id = a.doc_id + 10 where a.doc_id % 25 in (2, 15)"
    return altered(tmp_path_factory, "repeated_ids", documents=twice)


@pytest.mark.parametrize("name", ["title_exact", "title_fuzzy", "resolve_branches", "edge_resolve"])
def test_repeated_ids_equal_sql(spark, repeated_ids, name):
    folder, con = repeated_ids
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(oracle.all_queries()[name]).df()
    assert plain(got) == plain(want) and len(got)


def test_dotted_capital_i_has_the_key_of_the_sql(spark):
    title = "İstanbul FERİ K\u0130\u212a"
    want = duckdb.connect().execute(f"select {oracle.norm('t')} from (select '{title}' t)").fetchone()[0]
    assert spark.range(1).select(norm_title(F.lit(title))).first()[0] == want


@pytest.fixture(scope="module")
def odd_vectors(tmp_path_factory):
    """Vectors that are zero, infinite or undefined, and few others, whose last element alone tells their copies apart."""
    like = "select a.* replace (list_concat(b.embedding[1:-2], [((a.vec_id * 7919) % 500 * 1e-13)::FLOAT]) as embedding) from {0} a join {0} b on b.vec_id = a.vec_id % 60"
    kinds = {7: "0::FLOAT", 47: "CASE WHEN v > 0.1 THEN 'inf'::FLOAT ELSE v END", 15: "'nan'::FLOAT"}
    cases = " ".join(f"WHEN vec_id % 80 = {k} THEN list_transform(embedding, lambda v: {v})" for k, v in kinds.items())
    return altered(tmp_path_factory, "odd_vectors", embeddings=f"select * replace (CASE {cases} ELSE embedding END as embedding) from ({like})")


@pytest.mark.parametrize("name", ["knn_candidates", "best_candidates", "resolve_branches", "edge_resolve"])
def test_odd_vectors_equal_sql(spark, odd_vectors, name):
    folder, con = odd_vectors
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(oracle.all_queries()[name]).df()
    assert plain(got) == plain(want) and len(got)


def test_memo_matches_a_sequential_run(spark):
    rows = [(r, p, f"c{r}-{p}", ["", "alpha", "beta"][p % 3], "t", "new" if (p * 7 + r) % 3 else "merge") for r in range(3) for p in range(30)]
    df = spark.createDataFrame(rows, "run int, pos int, cand_id string, norm string, type string, own string").withColumn("creates", F.col("own") == "new")
    expected, owner = {}, {}
    for run, pos, cand, norm, kind, own in rows:
        first = owner.get((run, norm, kind)) if norm else None
        expected[cand] = first
        if first is None and own == "new":
            owner.setdefault((run, norm, kind), cand)
    assert {r["cand_id"]: r["same_run_id"] for r in resolve.memo(df).collect()} == expected
    two = df.withColumn("canonical_title", F.lit(None).cast("string"))
    assert {r["cand_id"]: r["same_run_id"] for r in resolve.memo(two).collect()} == expected


def test_memo_with_two_keys_matches_a_sequential_run(spark):
    pick = random.Random(4)
    names = ["", *(f"k{i}" for i in range(25))]
    rows = []
    for run in range(8):
        for pos in range(40):
            own = pick.choice(["new", "merge", "canonical_new", "adjudicated_same"])
            title = pick.choice([None, *names]) if own == "canonical_new" else None
            rows.append((run, pos, f"c{run}-{pos}", pick.choice(names), pick.choice(["t", "u"]), own, own == "canonical_new" or own == "new" or pick.random() < 0.3, title))
    df = spark.createDataFrame(rows, "run int, pos int, cand_id string, norm string, type string, own string, creates boolean, canonical_title string")
    expected, owner = {}, {}
    for run, _, cand, norm, kind, own, creates, title in rows:
        second = title if own == "canonical_new" else None
        first = owner.get((run, kind, norm)) if norm else None
        branch = "same_run" if first else own
        if first is None and second and (first := owner.get((run, kind, second))):
            branch = "same_run_canonical"
        if first is None and creates:
            for key in filter(None, (norm, second)):
                owner[run, kind, key] = cand
        expected[cand] = (first, branch, creates and first is None)
    got = resolve.memo(df).collect()
    assert {r["cand_id"]: (r["same_run_id"], r["branch"], r["creates"]) for r in got} == expected and len(got) == len(rows)
    assert {b for _, b, _ in expected.values()} >= {"same_run", "same_run_canonical"}


def test_context_is_cut_and_says_so():
    nodes = [{"type": "t", "title": "x" * n, "id": str(i), "summary": None} for i, n in enumerate((10, 900, 20))]
    text = read.context_text(nodes, [{"source_id": "0", "target_id": "9", "type": "affects"}], 600)
    assert "x" * 900 not in text and "x" * 20 in text and "-[affects]-> ?" in text and "1 more item(s) omitted" in text
    assert read.context_text([], []) == "No relevant context found in the graph."


def test_store_refuses_a_stale_writer(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("t", "g", "r1", None, "completed", "m", 1, 1, 1, None)], store.read("runs").schema)
    assert store.append("runs", rows) == 1 and store.read("runs").count() == 1
    with pytest.raises(ConcurrentModification):
        store.write("runs", rows, 0)
    assert store.append("runs", rows) == 2 and store.read("runs", 1).count() == 1


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    return Graph(spark, f"file://{tmp_path_factory.mktemp('store')}", embedder=extract.hash_embedder(8), extractor=extract.line_extractor, settings=Settings(dimensions=8))


TEXT = "The checkout service needs a second reviewer\nPayments are retried after seven failed attempts"


def test_restated_facts_merge_and_scope_holds(graph):
    first = graph.add("acme", "main", TEXT)
    assert first.status == "done" and first.created > 0 and first.merged == 0 and first.edges > 0, first
    again = graph.add("acme", "main", TEXT)
    assert again.status == "done" and again.created == 0 and again.merged == first.created and again.edges == 0, again
    other = graph.add("globex", "main", TEXT)
    assert other.created == first.created
    nodes, edges = graph.recall("acme", "main", "checkout", hops=1)
    rows = nodes.collect()
    assert len(rows) == first.created and edges.count() == first.edges
    for read_all in (graph.search("nobody", "main", "x"), graph.recall("nobody", "main", "x")[0], graph.neighbors("globex", "main", rows[0]["id"])[0], graph.evidence("globex", "main", rows[0]["id"]), graph.pending("nobody", "main")):
        assert read_all.count() == 0
    assert graph.evidence("acme", "main", rows[0]["id"]).count() == 2
    assert graph.health("acme", "main").first()["nodes"] == first.created


def test_tools(graph):
    server = ToolServer(graph, "acme", "main")
    assert "checkout" in server.call("search_sources", {"query": "reviewer", "tenant_id": "globex"})
    assert server.call("nothing") == "Unknown tool: nothing"
    assert server.call("recall", {}).startswith("Tool 'recall' failed")
    assert server.call("conflicts") == "No open contradictions."
    assert all(not {"tenant_id", "graph_id"} & set(t["inputSchema"]["properties"]) for t in TOOLS)


def test_failed_extraction_keeps_the_source(spark, tmp_path):
    def broken(text):
        raise RuntimeError("no answer")

    g = Graph(spark, f"file://{tmp_path}", embedder=extract.hash_embedder(8), extractor=broken, settings=Settings(dimensions=8))
    r = g.add("acme", "main", TEXT)
    assert r.status == "failed" and g.health("acme", "main").first()["sources_failed"] == 1


def in_turn(nodes, edges, ops):
    """The operations one after another: node -> (status, title, removed), edge triples -> live."""
    nodes, edges = dict(nodes), list(edges)  # edges: [id, source, target, type, live]

    def end(node, spare):
        edges[:] = [(i, s, t, k, live and not (node in (s, t) and k != spare)) for i, s, t, k, live in edges]

    def link(s, t, k):
        if s != t and not any(e[1:] == (s, t, k, True) for e in edges):
            edges.append((None, s, t, k, True))

    for op, p in ops:
        if op == "SUPERSEDE":
            nodes[p["old_id"]] = ("superseded", *nodes[p["old_id"]][1:])
            end(p["old_id"], "supersedes")
            link(p["new_id"], p["old_id"], "supersedes")
        elif op == "CONTRADICT":
            link(p["new_id"], p["old_id"], "contradicts")
        elif op == "UPDATE_NODE":
            old = nodes[p["node_id"]]
            nodes[p["node_id"]] = (p.get("status", old[0]), p.get("title", old[1]), old[2])
        elif op == "REMOVE_NODE":
            nodes[p["node_id"]] = ("rejected", nodes[p["node_id"]][1], True)
            end(p["node_id"], None)
        elif op == "DISCONNECT":
            edges[:] = [(i, s, t, k, live and i != p["edge_id"]) for i, s, t, k, live in edges]
        elif op == "ADD_EDGE":
            link(p["source_id"], p["target_id"], p["type"])
    return nodes, sorted((s, t, k, live) for _, s, t, k, live in edges)


OPS = [
    ("ADD_EDGE", {"source_id": "a", "target_id": "b", "type": "affects"}), ("SUPERSEDE", {"new_id": "c", "old_id": "a"}), ("ADD_EDGE", {"source_id": "a", "target_id": "b", "type": "affects"}),
    ("ADD_EDGE", {"source_id": "a", "target_id": "b", "type": "affects"}), ("UPDATE_NODE", {"node_id": "a", "status": "active", "title": "again"}), ("CONTRADICT", {"new_id": "d", "old_id": "b", "new_title": "D"}),
    ("ADD_EDGE", {"source_id": "d", "target_id": "d", "type": "affects"}), ("REMOVE_NODE", {"node_id": "e"}), ("DISCONNECT", {"edge_id": "e2"}), ("ADD_EDGE", {"source_id": "b", "target_id": "c", "type": "contains"}),
    ("ADD_EDGE", {"source_id": "e", "target_id": "b", "type": "contains"}), ("SUPERSEDE", {"new_id": "e", "old_id": "c"}), ("SET_LAYOUT", {"node_id": "b", "layout": "{}"}),
]
START = [("e1", "a", "b", "affects", True), ("e2", "b", "c", "contains", True), ("e3", "e", "d", "affects", True), ("e4", "a", "e", "supersedes", True), ("e5", "c", "d", "affects", False), ("e6", "c", "d", "supersedes", True)]


@pytest.mark.parametrize("ops", [OPS, OPS[::-1], OPS[4:] + OPS[:4], []])
def test_effects_equal_operations_in_turn(spark, tmp_path, ops):
    store = Store(spark, f"file://{tmp_path}")
    names = "abcde"
    rows = [{"tenant_id": "t", "graph_id": "g", "node_id": n, "title": n, "status": "active", "type": "entity/api"} for n in names]
    nodes = spark.createDataFrame([tuple(r.get(c) for c in store.read("nodes").columns) for r in rows], store.read("nodes").schema)
    now = pd.Timestamp("2024-01-01").to_pydatetime()
    lines = [{"tenant_id": "t", "graph_id": "g", "edge_id": i, "source_id": s, "target_id": d, "type": k, "status": "active", "valid_at": now, "invalid_at": None if live else now} for i, s, d, k, live in START]
    edges = spark.createDataFrame([tuple(r.get(c) for c in store.read("edges").columns) for r in lines], store.read("edges").schema)
    frame = spark.createDataFrame([("t", "g", i, o, p) for i, (o, p) in enumerate(ops)], "tenant_id string, graph_id string, seq long, op string, payload map<string,string>")
    effects.check(frame, nodes)
    got = effects.take_effect(nodes, edges, frame, salt="x")
    want_nodes, want_edges = in_turn({n: ("active", n, False) for n in names}, START, ops)
    rows = got.nodes.collect()
    assert {r["node_id"]: (r["status"], r["title"], r["deleted_at"] is not None) for r in rows if r["conflict_node_ids"] is None} == want_nodes
    assert sorted((r["source_id"], r["target_id"], r["type"], r["invalid_at"] is None) for r in got.edges.collect()) == want_edges
    assert [(r["title"], r["conflict_node_ids"]) for r in rows if r["conflict_node_ids"]] == [("Conflict: D vs existing claim", ["d", "b"])] * any(o == "CONTRADICT" for o, _ in ops)


def test_effects_refuse_unknown_operations_and_foreign_nodes(spark, tmp_path):
    nodes = Store(spark, f"file://{tmp_path}").read("nodes")
    one = lambda op, p: spark.createDataFrame([("t", "g", 0, op, p)], "tenant_id string, graph_id string, seq long, op string, payload map<string,string>")
    with pytest.raises(GraphError, match="unknown operation"):
        effects.check(one("EXPLODE", {}), nodes)
    with pytest.raises(ScopeViolation):
        effects.check(one("REMOVE_NODE", {"node_id": "elsewhere"}), nodes)


def test_review_applies_what_waited(graph):
    graph.add("acme", "gate", TEXT)
    mine = graph.recall("acme", "gate", "checkout", top_k=30)[0].collect()
    a, b = (r["id"] for r in sorted(mine, key=lambda r: r["title"])[:2])
    r = graph.apply("acme", "gate", [("SUPERSEDE", {"new_id": a, "old_id": b}), ("CONTRADICT", {"new_id": a, "old_id": b, "new_title": "A", "old_title": "B"}), ("ADD_NODE", {"type": "knowledge/insight", "title": "Stated by the host"})])
    assert (r.gated, r.created, r.edges) == (1, 2, 1)
    assert graph.conflicts("acme", "gate").first()["title"] == "Conflict: A vs B"
    waiting = graph.pending("acme", "gate").collect()
    assert [o["op"] for w in waiting for o in w["ops"]] == ["SUPERSEDE"]
    done = graph.review("acme", "gate", r.changeset_id, approve=True, reviewer_id="ada")
    assert done == {"changeset_id": r.changeset_id, "status": "applied", "gated_ops": 1, "created_nodes": 0, "merged_nodes": 0, "updated_nodes": 1, "created_edges": 0}
    left = {x["id"] for x in graph.recall("acme", "gate", "checkout", top_k=30)[0].collect()}
    assert a in left and b not in left and graph.pending("acme", "gate").count() == 0
    with pytest.raises(GraphError):
        graph.review("acme", "gate", r.changeset_id, approve=True)
    with pytest.raises(ScopeViolation):
        graph.apply("acme", "gate", [("ADD_EDGE", {"source_id": a, "target_id": "elsewhere", "type": "affects"})])


def told(graph, answers, *, prompts=None, **options):
    """A graph whose extractor answers by text, kept apart from the others."""

    def extractor(text, prompt):
        return answers[text] | {"usage": {"model": "m", "input_tokens": 100, "output_tokens": len("\n".join(prompt))}}

    return Graph(graph.spark, f"{graph.store.root}-{len(answers)}-{abs(hash(tuple(answers)))}", embedder=extract.hash_embedder(8), extractor=extractor, settings=Settings(dimensions=8, **options.pop("settings", {})), **options)


def node(title, label="entity/screen", **more):
    return {"type": label, "title": title} | more


def test_extraction_order_prompt_runs_and_folded_wording(graph):
    first = {"nodes": [node("Checkout Screen", temp_id="n_a", summary="first wording"), node("Retry rule", "knowledge/decision"), node("The checkout", summary="x", kind="custom")], "edges": [{"source_temp_id": "1", "target_temp_id": "n_a", "type": "affects"}, {"target_temp_id": "n_a"}]}
    second = {"nodes": '[{"temp_id": "q", "type": "entity/screen", "title": "checkout", "summary": "second wording", "surface_phrase": "the till"}, 7]', "edges": None}
    seen = []
    g = told(graph, {"one": first, "two": second}, meter=lambda **spent: seen.append(spent))
    a = g.add("t", "g", "one")
    assert (a.status, a.created, a.merged, a.edges) == ("done", 2, 1, 1), a  # the third has the first's key and type
    before = g.prompt("t", "g")
    assert "Checkout Screen" in before[1] and len(g.prompt("other", "g")) == 1
    b = g.add("t", "g", "two")
    assert (b.created, b.merged) == (0, 1), b
    shown = {r["title"]: r["summary"] for r in g.recall("t", "g", "x", top_k=9)[0].collect()}
    assert shown["Checkout Screen"] == "first wording · x · second wording"
    runs = {r["run_id"]: r for r in g.store.read("runs").collect()}
    assert runs[a.run_id]["status"] == runs[b.run_id]["status"] == "completed" and runs[b.run_id]["input_tokens"] == 100
    # The second prompt held the roster, so it was longer.
    assert runs[b.run_id]["output_tokens"] > runs[a.run_id]["output_tokens"] and [s["llm_calls"] for s in seen] == [1, 1]
    c = g.add("t", "g", "three")  # the extractor knows no answer
    assert c.status == "failed" and g.store.read("runs").filter("status = 'failed'").count() == 1 and len(seen) == 3
    assert g.store.read("sources").filter("extraction_status = 'failed'").first()["extraction_error"]
    with pytest.raises(ScopeViolation):
        g.restructure("other", "g", a.source_ids[0])
    again = g.restructure("t", "g", a.source_ids[0])
    assert (again.status, again.created, again.merged, again.edges) == ("done", 0, 3, 0), again


def test_hosts_entities_and_adjudication(graph):
    nodes = lambda *titles: {"nodes": [node(t) for t in titles], "edges": []}
    host = lambda graph_id, kind, title: {"title": "Orders Overview"} if title == "order list" else None
    judge = lambda new, old: ("duplicate" if "merge" in new["title"] else 1 / 0, {"model": "j", "input_tokens": 5})
    texts = {"a": nodes("alpha beta gamma delta epsilon", "order list"), "b": nodes("alpha beta gamma delta merge", "alpha beta gamma delta fails"), "c": nodes("order list")}
    g = told(graph, texts, canonical=host, adjudicator=judge)
    assert g.add("t", "g", "a").created == 2
    r = g.store.read("nodes").filter("title = 'Orders Overview'").first()
    assert r["aliases"] == ["order list"]
    b = g.add("t", "g", "b")
    assert (b.status, b.created, b.merged) == ("done", 1, 1), b  # the failure leaves a node of its own
    assert g.add("t", "g", "c").merged == 1  # by its alias
    assert g.store.read("runs").filter("llm_calls = 2").count() == 1
    made = g.apply("t", "g", [("ADD_NODE", {"type": "knowledge/insight", "title": "x"})])
    g.store.commit(("nodes", "upsert", g.store.read("nodes").filter("title = 'x'").withColumn("embedding", F.lit(None).cast("array<float>"))))
    assert made.created == 1 and g.reembed("t", "g") == 1 and g.reembed("t", "g") == 0
    g.delete_tenant("t")
    assert all(g.store.read(t).count() == 0 for t in ("sources", "segments", "nodes", "edges", "runs", "changesets"))


def test_what_is_written_is_in_proportion_to_the_change(spark, tmp_path):
    import os

    store = Store(spark, f"file://{tmp_path}")
    columns, schema = store.read("nodes").columns, store.read("nodes").schema
    row = lambda i, title: tuple({"tenant_id": "t", "graph_id": "g", "node_id": str(i), "title": title, "status": "active"}.get(c) for c in columns)
    store.append("nodes", spark.createDataFrame([row(i, f"title {i} " * 50) for i in range(5000)], schema))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs)
    before, version = size(), store.version()
    store.commit(("nodes", "upsert", spark.createDataFrame([row(7, "new"), row(9000, "more")], schema)), ("runs", "insert", spark.createDataFrame([("t", "g", "r", None, "completed", "m", 1, 1, 1, None)], store.read("runs").schema)), expected=version)
    assert size() - before < 40_000 and store.read("nodes").count() == 5001 and store.read("runs").count() == 1
    assert store.read("nodes").filter("node_id = '7'").first()["title"] == "new" and store.read("nodes", version).filter("node_id = '7'").first()["title"].startswith("title 7")
    with pytest.raises(ConcurrentModification):
        store.commit(("nodes", "upsert", spark.createDataFrame([row(7, "stale")], schema)), expected=version)
    store.compact("nodes")
    assert store.read("nodes").count() == 5001 and not store._folders("nodes", store.version())["upsert"]
    store.delete_tenant("t")
    assert store.read("nodes").count() == 0
