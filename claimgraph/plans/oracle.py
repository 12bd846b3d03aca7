"""The same queries in DuckDB's SQL.

Written from the definitions of the fixture views and the operators, not from the Spark plans.
"""

from __future__ import annotations

from ..functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
MERGE, RELATED = 0.40, 0.30


def norm(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ({_STOP}))"


def tenant(i: str) -> str:
    return f"CASE WHEN {i} % 2 = 0 THEN 'acme' ELSE 'globex' END"


def graph(i: str) -> str:
    return f"CASE WHEN ({i} // 2) % 10 = 9 THEN 'aux' ELSE 'main' END"


def cosine(a: str, b: str) -> str:
    return f"(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))))"


N = "(SELECT count(*) FROM documents)"
RISK = "CASE WHEN op IN ('SET_LAYOUT','ADD_NODE','ADD_EDGE','ADD_CITATION','MERGE_NODE','CONTRADICT') OR (op IN ('UPDATE_NODE','DISCONNECT','REMOVE_NODE','SUPERSEDE') AND actor_kind = 'human') THEN 'additive' ELSE 'high' END"


def edge_view(name: str) -> str:
    return f"""{name} AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, epoch(l_shipdate)::BIGINT) edge_id, s source_id, ((l_suppkey*37 + l_linenumber) % ({N}//2))*2 + s % 2 target_id,
 {tenant('s')} tenant_id, {graph('s')} graph_id, CASE l_returnflag WHEN 'A' THEN 'affects' WHEN 'N' THEN 'contains' ELSE 'depends_on' END "type",
 epoch(l_shipdate)::BIGINT valid_at, CASE WHEN l_linestatus = 'F' THEN epoch(l_shipdate)::BIGINT + 90*86400 END invalid_at, l_orderkey seq
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, l_partkey % {N} s FROM lineitem))"""


VIEWS = {
    "f_sources": f"f_sources AS (SELECT d.doc_id source_id, {tenant('d.doc_id')} tenant_id, {graph('d.doc_id')} graph_id, d.source origin, d.text raw_content, d.lang, CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'failed' ELSE 'pending' END extraction_status, 1704067200 + d.doc_id*60 created_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    "f_nodes": f"""f_nodes AS (SELECT d.doc_id node_id, {tenant('d.doc_id')} tenant_id, {graph('d.doc_id')} graph_id, CASE d.doc_id % 3 WHEN 0 THEN 'entity/feature' WHEN 1 THEN 'entity/screen' ELSE 'knowledge/decision' END "type",
 CASE d.doc_id % 3 WHEN 2 THEN 'knowledge' ELSE 'entity' END kind, array_to_string(string_split(text, ' ')[1:8], ' ') title, lang || '/' || source summary, CASE WHEN d.doc_id % 11 = 0 THEN ['folded ' || lang] ELSE []::VARCHAR[] END summaries,
 CASE WHEN d.doc_id % 7 = 0 THEN [array_to_string(string_split(text, ' ')[1:2], ' ')] ELSE []::VARCHAR[] END aliases,
 CASE WHEN d.doc_id % 17 = 0 THEN 'rejected' WHEN d.doc_id % 13 = 0 THEN 'superseded' ELSE 'active' END status, CASE WHEN d.doc_id % 17 = 0 THEN 1704067200 END deleted_at,
 (d.doc_id % 10) / 10.0::DOUBLE confidence, [d.doc_id, (d.doc_id + 2) % {N}, d.doc_id] citations, 1704067200 + d.doc_id*60 created_at, 1704067200 + d.doc_id*60 + ((d.doc_id*7919) % 1000)*60 updated_at, e.embedding
 FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)""",
    "f_cand": "f_cand AS (SELECT *, node_id cand_id, node_id // 100 run, node_id pos FROM f_nodes WHERE node_id % 5 = 0)",
    "f_graph": "f_graph AS (SELECT * FROM f_nodes WHERE node_id % 5 <> 0 AND status = 'active')",
    "f_edges": edge_view("f_edges"),
    "f_segments": f"f_segments AS (SELECT doc_id segment_id, doc_id source_id, {tenant('doc_id')} tenant_id, {graph('doc_id')} graph_id, text, '0-' || length(text) || ' char' locator, embedding FROM documents JOIN embeddings ON vec_id = doc_id)",
    "f_query": "f_query AS (SELECT embedding q FROM embeddings WHERE vec_id = 8)",
    "f_ops": f"""f_ops AS (SELECT event_id seq, floor(epoch(ts))::BIGINT commit_ts, {tenant('user_id')} tenant_id, user_id node_id, CASE event_type WHEN 'view' THEN 'MERGE_NODE' WHEN 'click' THEN 'ADD_EDGE' WHEN 'signup' THEN 'UPDATE_NODE' WHEN 'purchase' THEN 'SUPERSEDE' ELSE 'REMOVE_NODE' END op,
 CASE WHEN user_id % 5 = 0 THEN 'human' ELSE 'agent' END actor_kind, 'alias ' || (k % 10) alias, 'summary ' || (k % 5) summary, (user_id + k) % 150 other_id, strftime(ts, '%Y-%m-%d') AS day
 FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT k FROM events))""",
    "f_runs": "f_runs AS (SELECT event_id run_id, event_type model, k*10 input_tokens, k output_tokens, 1 llm_calls, CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END status, ts created_at, user_id FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT k FROM events))",
    "f_changesets": f"f_changesets AS (SELECT tenant_id, node_id, day, tenant_id || '/' || node_id || '/' || day changeset_id, list({{'seq': seq, 'op': op, 'risk': risk}} ORDER BY seq) ops, min(commit_ts) created_at, CASE WHEN bool_or(risk = 'high') THEN 'partial' ELSE 'applied' END status FROM (SELECT *, {RISK} risk FROM f_ops) GROUP BY tenant_id, node_id, day)",
}
NEEDS = {"f_cand": ["f_nodes"], "f_graph": ["f_nodes"], "f_changesets": ["f_ops"]}


def sql(body: str, *more: str) -> str:
    """The query after the views that it names; ``more`` are its own."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in used:
                for other in NEEDS.get(name, []):
                    need(other)
                if name not in used:
                    used.append(name)

    for text in (*more, body):
        need(text)
    parts = [VIEWS[n] for n in used] + list(more)
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


HERE = "tenant_id = 'acme' AND graph_id = 'main'"
LIVE = "status = 'active' AND deleted_at IS NULL"
ORDER = "ROW_NUMBER() OVER (ORDER BY score DESC, node_id)"


def knn(k: int = 5) -> str:
    return f"""near AS (SELECT * FROM (SELECT c.cand_id, n.node_id, n."type" node_type, c."type" AS own_type, {cosine('n.embedding', 'c.embedding')} score,
 row_number() OVER (PARTITION BY c.cand_id ORDER BY {cosine('n.embedding', 'c.embedding')} DESC, n.node_id) AS rank
 FROM f_cand c JOIN f_graph n ON c.tenant_id = n.tenant_id AND c.graph_id = n.graph_id AND c.kind = n.kind WHERE c.embedding IS NOT NULL AND n.embedding IS NOT NULL) WHERE rank <= {k})"""


BEST = "best AS (SELECT cand_id, min_by(node_id, rank) FILTER (node_type = own_type) same_id, min_by(score, rank) FILTER (node_type = own_type) same_score, min_by(node_id, rank) any_id, min_by(score, rank) any_score, min_by(node_type, rank) any_type FROM near GROUP BY cand_id)"
SURFACE = f"""surface AS (SELECT node_id, tenant_id, graph_id, "type", created_at, u s, {norm('u')} nm, list_distinct({tokens('u')}) w FROM (SELECT *, unnest(list_distinct(list_concat([title], aliases))) u FROM f_graph))"""
EXACT = f"""exact AS (SELECT cand_id, arg_min(node_id, (created_at, node_id)) node_id FROM (SELECT c.cand_id, s.node_id, s.created_at FROM f_cand c JOIN surface s ON c.tenant_id = s.tenant_id AND c.graph_id = s.graph_id AND c."type" = s."type" AND s.nm = {norm('c.title')} WHERE s.nm <> '') GROUP BY cand_id)"""
FUZZY = f"""fuzzy AS (SELECT cand_id, arg_min(node_id, (created_at, node_id)) node_id FROM (SELECT c.cand_id, s.node_id, s.created_at FROM (SELECT *, list_distinct({tokens('title')}) cw, {norm('title')} cn FROM f_cand) c
 JOIN surface s ON c.tenant_id = s.tenant_id AND c.graph_id = s.graph_id AND c."type" = s."type" WHERE len(c.cw) > 0 AND len(s.w) > 0 AND len(list_intersect(c.cw, s.w)) >= 0.8 * greatest(len(c.cw), len(s.w)) AND NOT (len(c.cw) = len(s.w) AND len(list_intersect(c.cw, s.w)) = len(c.cw) AND array_to_string(list_filter(c.cw, lambda t: true), ' ') = '') AND c.cn <> s.nm) GROUP BY cand_id)"""
VERDICT = "CASE f_cand.node_id % 20 WHEN 0 THEN 'duplicate' WHEN 5 THEN 'supersedes' WHEN 10 THEN 'contradicts' ELSE 'distinct' END"


def ladder(canonical: bool = False) -> list[str]:
    join = "LEFT JOIN canon k USING (cand_id)" if canonical else ""
    cols = ", k.canonical_node_id, k.canonical_title" if canonical else ", NULL::BIGINT canonical_node_id, NULL::VARCHAR canonical_title"
    return [
        knn(), BEST, SURFACE, EXACT, FUZZY,
        f"""l0 AS (SELECT f_cand.cand_id, run, pos, "type", {norm('title')} nm, {VERDICT} verdict, same_id, same_score, any_id, any_score, any_type, exact.node_id exact_id, fuzzy.node_id fuzzy_id {cols}
 FROM f_cand LEFT JOIN best USING (cand_id) LEFT JOIN exact USING (cand_id) LEFT JOIN fuzzy USING (cand_id) {join})""",
        f"""l1 AS (SELECT *, CASE WHEN same_score >= {MERGE} THEN 'vector_threshold' WHEN exact_id IS NOT NULL THEN 'exact_title'
 WHEN canonical_node_id IS NOT NULL AND nm <> '' AND nm = {norm('canonical_title')} THEN 'canonical_exact' WHEN canonical_node_id IS NOT NULL AND verdict = 'duplicate' THEN 'canonical_adjudicated'
 WHEN canonical_title IS NOT NULL AND canonical_node_id IS NULL THEN 'canonical_new'
 WHEN same_score >= {RELATED} THEN 'adjudicated_same' WHEN any_score >= {RELATED} THEN 'adjudicated_any' WHEN fuzzy_id IS NOT NULL THEN 'adjudicated_title' ELSE 'new' END own FROM l0)""",
        """l2 AS (SELECT *, CASE WHEN own LIKE 'adjudicated%' THEN CASE WHEN own = 'adjudicated_any' AND any_type <> "type" AND verdict = 'duplicate' THEN 'distinct' ELSE verdict END WHEN own IN ('new', 'canonical_new') THEN 'new' ELSE 'merge' END decision,
 CASE own WHEN 'vector_threshold' THEN same_id WHEN 'adjudicated_same' THEN same_id WHEN 'exact_title' THEN exact_id WHEN 'adjudicated_any' THEN any_id WHEN 'adjudicated_title' THEN fuzzy_id WHEN 'canonical_exact' THEN canonical_node_id WHEN 'canonical_adjudicated' THEN canonical_node_id END target_id,
 CASE own WHEN 'vector_threshold' THEN same_score WHEN 'adjudicated_same' THEN same_score WHEN 'adjudicated_any' THEN any_score END score FROM l1)""",
        "l3 AS (SELECT *, own IN ('new', 'canonical_new') OR (own LIKE 'adjudicated%' AND decision <> 'duplicate') makes FROM l2)",
        """l4 AS (SELECT *, CASE WHEN nm <> '' THEN first_value(CASE WHEN makes THEN cand_id END IGNORE NULLS) OVER (PARTITION BY run, "type", nm ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END same_run_id FROM l3)""",
        "resolved AS (SELECT *, CASE WHEN same_run_id IS NOT NULL THEN 'same_run' ELSE own END branch, makes AND same_run_id IS NULL creates FROM l4)",
    ]


SEEDS = f"seeds AS (SELECT * FROM (SELECT *, {cosine('embedding', 'q')} score FROM f_nodes, f_query WHERE {HERE} AND {LIVE} AND embedding IS NOT NULL) ORDER BY score DESC, node_id LIMIT 8)"
LINKS = f"links AS (SELECT * FROM f_edges WHERE {HERE} AND invalid_at IS NULL)"


def hop(k: int, before: str, frontier: str, most: int) -> list[str]:
    """One hop: the edges met, the nodes reached, and all collected."""
    return [
        f"met{k} AS (SELECT * FROM links WHERE (source_id IN (SELECT id FROM {frontier}) OR target_id IN (SELECT id FROM {frontier})) AND (SELECT count(*) FROM {before}) < {most})",
        f"ends{k} AS (SELECT id, min((edge_id, side)) spot FROM (SELECT edge_id, 0 side, source_id id FROM met{k} UNION ALL SELECT edge_id, 1, target_id FROM met{k}) WHERE id NOT IN (SELECT id FROM {before}) GROUP BY id)",
        f"new{k} AS (SELECT id, reach, hop FROM (SELECT id, (row_number() OVER (ORDER BY spot, id) + (SELECT count(*) FROM {before}))::INTEGER reach, {k} hop FROM ends{k}) WHERE reach <= {most})",
        f"all{k} AS (SELECT id, reach, hop FROM {before} UNION ALL SELECT id, reach, hop FROM new{k})",
    ]


ONE = "start AS (SELECT 8::BIGINT id, 1::INTEGER reach, 0 hop, 1.0::DOUBLE score)"
RECALL = [SEEDS, LINKS, "start AS (SELECT node_id id, (row_number() OVER (ORDER BY score DESC, node_id))::INTEGER reach, 0 hop, score FROM seeds)", *hop(1, "start", "start", 30)]


SHOWN = "array_to_string(list_concat([{0}summary], {0}summaries), ' · ')"


def found(last: str) -> str:
    return f"found AS (SELECT a.id, n.kind, n.\"type\", n.title, {SHOWN.format("n.")} summary, n.status, n.confidence, s.score, a.reach FROM {last} a JOIN f_nodes n ON n.node_id = a.id AND n.tenant_id = 'acme' AND n.graph_id = 'main' AND n.status = 'active' AND n.deleted_at IS NULL LEFT JOIN start s ON s.id = a.id)"


ROSTER = f"""roster AS (SELECT row_number() OVER (ORDER BY (kind = 'entity') DESC, updated_at DESC, node_id)::INTEGER AS rank, node_id, "type", title, list_filter(aliases, lambda a: a IS NOT NULL)[1:3] few FROM f_nodes WHERE {HERE} AND {LIVE})"""
MERGED = """m AS (SELECT tenant_id, node_id, list(alias ORDER BY seq) na, list(summary ORDER BY seq) ns, count(*) n FROM f_ops WHERE op = 'MERGE_NODE' GROUP BY tenant_id, node_id),
 j AS (SELECT f_nodes.*, coalesce(na, []::VARCHAR[]) na, list_concat(summaries, coalesce(ns, []::VARCHAR[])) ns, coalesce(n, 0) n FROM f_nodes LEFT JOIN m ON m.tenant_id = f_nodes.tenant_id AND m.node_id = f_nodes.node_id)"""
STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


LOG = f"f_log AS (SELECT *, {graph('node_id')} graph_id, (node_id + 20 * (1 + seq % 6)) % 140 other, {RISK} risk FROM f_ops)"


def states(keep: str) -> str:
    """Nodes after the operations that meet a condition."""
    return sql(
        "SELECT n.tenant_id, n.node_id, coalesce(s, n.status) status, coalesce(t, n.title) title, coalesce(gone, false) OR n.deleted_at IS NOT NULL deleted, array_to_string(list_sort(list_filter(list_distinct(list_concat(n.aliases, coalesce(more, []::VARCHAR[]))), lambda x: x <> n.title)), '|') aliases FROM f_nodes n LEFT JOIN f USING (tenant_id, node_id)",
        LOG,
        f"""f AS (SELECT tenant_id, node_id, arg_max(CASE op WHEN 'SUPERSEDE' THEN 'superseded' ELSE 'rejected' END, seq) FILTER (op IN ('SUPERSEDE', 'REMOVE_NODE')) s, arg_max(alias, seq) FILTER (op = 'UPDATE_NODE') t,
 bool_or(op = 'REMOVE_NODE') gone, list(alias) FILTER (op = 'MERGE_NODE') more FROM f_log WHERE {keep} GROUP BY tenant_id, node_id)""",
    )


def ends(op: str, made: str = "") -> str:
    hit = lambda side: f"(tenant_id, graph_id, {side}) IN (SELECT (tenant_id, graph_id, node_id) FROM f_log WHERE op = '{op}')"
    return sql(f'SELECT edge_id "name", "type", invalid_at IS NOT NULL OR {hit("source_id")} OR {hit("target_id")} ended FROM f_edges {made}', LOG)


def walked() -> list[str]:
    """The memo of a run in order, as a candidate under a host's name owns two keys."""
    return [
        f"""q AS (SELECT *, row_number() OVER (PARTITION BY run, "type" ORDER BY pos, cand_id) k, coalesce(CASE WHEN own = 'canonical_new' THEN {norm('canonical_title')} END, '') snd FROM l3)""",
        """walk AS (SELECT run, "type" tp, 0::BIGINT k, []::VARCHAR[] ks, []::BIGINT[] cs, NULL::BIGINT cand_id, NULL::BIGINT hit, NULL::VARCHAR how FROM q GROUP BY run, "type"
 UNION ALL SELECT run, tp, k, CASE WHEN a IS NULL AND b IS NULL AND makes THEN list_concat(ks, list_filter([nm, snd], lambda x: x <> '')) ELSE ks END,
 CASE WHEN a IS NULL AND b IS NULL AND makes THEN list_concat(cs, list_transform(list_filter([nm, snd], lambda x: x <> ''), lambda x: cand_id)) ELSE cs END, cand_id, coalesce(a, b), CASE WHEN a IS NOT NULL THEN 'same_run' WHEN b IS NOT NULL THEN 'same_run_canonical' END
 FROM (SELECT w.run, w.tp, q.k, ks, cs, q.cand_id, nm, snd, makes, CASE WHEN nm <> '' THEN cs[list_position(ks, nm)] END a, CASE WHEN snd <> '' THEN cs[list_position(ks, snd)] END b FROM walk w JOIN q ON q.run = w.run AND q."type" = w.tp AND q.k = w.k + 1))""",
    ]


HEAD, RELATIONS = "Relevant context (knowledge graph):", "Relationships:"
CONTEXT = [
    "near_edges AS (SELECT DISTINCT source_id, target_id, \"type\" FROM met1 WHERE source_id IN (SELECT id FROM found) AND target_id IN (SELECT id FROM found))",
    f"""items AS (SELECT row_number() OVER (ORDER BY part, o) k, room, line FROM (
 SELECT 1 part, row_number() OVER (ORDER BY coalesce(score, 0) DESC, reach) o, 5800 room, '- [' || "type" || '] ' || title || ' {{id: ' || id || '}}' || CASE WHEN coalesce(summary, '') <> '' THEN ' — ' || summary ELSE '' END line FROM found
 UNION ALL SELECT 2, 0, NULL, chr(10) || '{RELATIONS}' FROM (SELECT count(*) c FROM near_edges) WHERE c > 0
 UNION ALL SELECT 3, row_number() OVER (ORDER BY e.source_id, e.target_id, e."type"), 6000, '  ' || s.title || ' -[' || e."type" || ']-> ' || t.title FROM near_edges e JOIN found s ON s.id = e.source_id JOIN found t ON t.id = e.target_id))""",
    f"""told AS (SELECT 0::BIGINT k, {len(HEAD) + 2}::BIGINT used, '{HEAD}' || chr(10) body, 0 omitted
 UNION ALL SELECT i.k, CASE WHEN fits THEN used + length(line) + 1 ELSE used END, CASE WHEN fits THEN body || chr(10) || line ELSE body END, CASE WHEN fits THEN omitted ELSE omitted + 1 END
 FROM (SELECT i.k, used, body, omitted, line, room IS NULL OR used + length(line) <= room fits FROM told JOIN items i ON i.k = told.k + 1) i)""",
]


#: White space, as Python sees it.
_SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, WORD = f"[{_SPACE}]", f"[^{_SPACE}]"


def chunked(size: int, overlap: int) -> list[str]:
    """Chunks of every source, one after another.  Blank lines, at which chunks would end, are in none of the tables."""
    half = size // 2
    line = f"length(regexp_extract(substring(t, st + {half + 1}, {size - half}), '(?s)^.*\\n'))"
    last = f"length(regexp_extract(substring(t, st + 1, {size + 1}), '(?s)^.*{SPACE}'))"
    skip = lambda at, kind: f"({at} + length(regexp_extract(substring(t, {at} + 1), '^{kind}*')))"
    end = f"CASE WHEN n - st <= {size} THEN n WHEN {line} > 0 THEN st + {half - 1} + {line} WHEN {last} > 0 THEN st + least({size}, {last}) ELSE {skip(f'(st + {size})', WORD)} END"
    inside = f"substring(t, a, 1) <> '' AND a < n AND regexp_matches(substring(t, a, 2), '^{WORD}{WORD}')"
    return [
        "body AS (SELECT source_id, raw_content t, length(raw_content) n FROM f_sources)",
        f"""cut AS (SELECT source_id, st, {end} fin FROM (SELECT *, {skip('0', SPACE)} st FROM body) WHERE st < n
 UNION ALL SELECT source_id, st, {end} FROM (SELECT source_id, t, n, {skip('b', SPACE)} st FROM (SELECT *, CASE WHEN {inside} THEN {skip('a', WORD)} ELSE a END b
  FROM (SELECT source_id, t, n, greatest(fin - {overlap}, st + 1) a FROM cut JOIN body USING (source_id) WHERE fin < n))) WHERE st < n)""",
        f"""chunks AS (SELECT source_id, (row_number() OVER (PARTITION BY source_id ORDER BY st) - 1)::INTEGER AS "index", st::INTEGER AS "start", (st + length(c))::INTEGER AS "end", c AS text
 FROM (SELECT source_id, st, regexp_replace(substring(t, st + 1, fin - st), '{SPACE}+$', '') c FROM cut JOIN body USING (source_id)) WHERE c <> '')""",
    ]


#: What the stand-in for an extractor finds in each line of some words.
LINES = [
    r"""lines AS (SELECT source_id, "index", unnest(ls) l, unnest(range(len(ls))) i FROM (SELECT *, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') ls FROM chunks))""",
    f"worded AS (SELECT source_id, \"index\", i, w, list_filter(w, lambda x: regexp_full_match(x, '\\pL{{5,}}'))[1] long FROM (SELECT *, string_split_regex(regexp_replace(l, '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+') w FROM lines) WHERE len(w) >= 4)",
]


def uuid_of(h: str) -> str:
    return f"concat_ws('-', {h}[1:8], {h}[9:12], {h}[13:16], {h}[17:20], {h}[21:32])"


def all_queries() -> dict[str, str]:
    count = " UNION ALL ".join(f"SELECT '{n}' table_name, tenant_id, count(*) n FROM f_{n} GROUP BY tenant_id" for n in ("sources", "nodes", "edges", "segments"))
    memo = f"m AS (SELECT p_partkey % 20 run, p_partkey pos, {norm('p_name')} nm, p_type tp, CASE WHEN p_size % 4 = 0 THEN 'merge' ELSE 'new' END own FROM part)"
    canon = """canon AS (SELECT node_id cand_id, CASE WHEN (node_id//5) % 3 = 0 THEN node_id + 2 END canonical_node_id, CASE WHEN (node_id//5) % 3 = 0 AND (node_id//5) % 2 = 0 THEN title ELSE 'host ' || kind || ' ' || ((node_id//5) % 7) END canonical_title FROM f_nodes WHERE node_id % 5 = 0 AND kind = 'entity' AND (node_id//5) % 4 = 1)"""
    grams = lambda x: f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substring('  ' || lower({x}) || ' ', i, 3)))"
    out = {
        "src_capture": sql(f"SELECT 'acme' tenant_id, 'main' graph_id, {uuid_of('h')} source_id, 'web' origin, url external_ref, length(html) n_chars, 'pending' extraction_status FROM (SELECT *, sha256('run-1|' || coalesce(url, '') || '|' || sha256(coalesce(html, ''))) h FROM pages)"),
        "src_lookup": sql(f"SELECT source_id, tenant_id, graph_id, origin, ({HERE}) in_scope FROM f_sources WHERE source_id IN (8, 9)"),
        "run_latest": sql("SELECT user_id, arg_max(status, run_id) status, arg_max(model, run_id) model, max(run_id) run_id FROM f_runs GROUP BY user_id"),
        "cs_build": sql("SELECT tenant_id, node_id, day, status, len(ops)::INTEGER n_ops, array_to_string(list_transform(ops, lambda o: o.seq || ':' || o.op || ':' || o.risk), ',') ops FROM f_changesets"),
        "scoped_nodes": sql(f'SELECT node_id, "type", title, status FROM f_nodes WHERE {HERE}'),
        "tenant_row_counts": sql(count),
        "live_nodes": sql(f'SELECT node_id, kind, "type", confidence FROM f_nodes WHERE {HERE} AND {LIVE}'),
        "live_edges": sql(f'SELECT edge_id, source_id, target_id, "type", valid_at FROM f_edges WHERE {HERE} AND invalid_at IS NULL'),
        "edges_by_type": sql(f"SELECT edge_id, \"type\" FROM f_edges WHERE {HERE} AND invalid_at IS NULL AND \"type\" IN ('affects', 'contains')"),
        "node_details": sql(f'SELECT node_id, kind, "type", title, {SHOWN.format("")} summary, status, confidence FROM f_nodes WHERE {HERE} AND {LIVE} AND node_id IN (SELECT p_partkey FROM part WHERE p_size = 7)'),
        "pending_changesets": sql("SELECT changeset_id, status, array_to_string(list_transform(list_filter(ops, lambda o: o.risk = 'high'), lambda o: o.seq || ':' || o.op), ',') ops, created_at FROM f_changesets WHERE status IN ('pending_review', 'partial')"),
        "json_project": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT k FROM events",
        "evidence": sql(f"SELECT source_id, origin, left(coalesce(raw_content, ''), 2000) excerpt, lang, created_at FROM f_sources WHERE {HERE} AND source_id IN (SELECT unnest(citations) FROM f_nodes WHERE node_id = 8)"),
        "conflicts": sql("SELECT node_id open_question_id, title, node_id || ',' || (node_id + 2) conflict_node_ids, coalesce(CASE node_id % 3 WHEN 1 THEN true WHEN 2 THEN false END, false) resolved, created_at FROM f_nodes WHERE node_id % 50 = 1 AND tenant_id = 'globex' AND graph_id = 'main' AND status = 'active' AND deleted_at IS NULL"),
        "strict_types": sql("SELECT node_id, \"type\", kind, true known, true strict FROM f_nodes WHERE \"type\" IN ('entity/feature', 'knowledge/decision') UNION ALL SELECT node_id, \"type\", kind, \"type\" IN ('entity/feature', 'knowledge/decision'), false FROM f_nodes"),
        "valid_edges": sql("SELECT edge_id, source_id, target_id FROM f_edges e WHERE source_id <> target_id AND EXISTS (SELECT 1 FROM f_nodes n WHERE n.node_id = e.source_id AND n.tenant_id = e.tenant_id AND n.node_id % 3 <> 0) AND EXISTS (SELECT 1 FROM f_nodes n WHERE n.node_id = e.target_id AND n.tenant_id = e.tenant_id AND n.node_id % 3 <> 0)"),
        "layout_sanitize": sql("SELECT tenant_id, node_id, 'layout=' || arg_max(summary, seq) || ';node_id=' || node_id || ';view=' || arg_max(alias, seq) payload FROM f_ops GROUP BY tenant_id, node_id"),
        "wire_parse": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 ELSE 0 END::INTEGER n, CASE event_id % 3 WHEN 0 THEN 'a,n' || json_extract_string(props, '$.k') ELSE '' END items FROM events",
        "sources_unindexed": sql(f"SELECT source_id, origin FROM f_sources WHERE {HERE} AND coalesce(raw_content, '') <> '' AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = source_id)"),
        "edge_dedup_insert": sql('SELECT edge_id, tenant_id, graph_id, source_id, target_id, "type" FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, graph_id, source_id, target_id, "type" ORDER BY edge_id) k FROM f_edges WHERE source_id <> target_id) p WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM f_edges e WHERE e.seq % 2 = 0 AND e.invalid_at IS NULL AND e.tenant_id = p.tenant_id AND e.graph_id = p.graph_id AND e.source_id = p.source_id AND e.target_id = p.target_id AND e."type" = p."type")'),
        "edges_touching": sql('SELECT edge_id, source_id, target_id, "type" FROM links WHERE source_id IN (SELECT p_partkey FROM part WHERE p_size = 3) OR target_id IN (SELECT p_partkey FROM part WHERE p_size = 3)', LINKS),
        "knn_candidates": sql("SELECT cand_id, node_id, round(score, 6) score, rank::INTEGER AS rank FROM near", knn()),
        "best_candidates": sql("SELECT cand_id, same_id, round(same_score, 6) same_score, any_id, round(any_score, 6) any_score FROM best", knn(), BEST),
        "title_exact": sql("SELECT cand_id, node_id FROM exact", SURFACE, EXACT),
        "title_fuzzy": sql("SELECT cand_id, node_id FROM fuzzy", SURFACE, FUZZY),
        "resolve_branches": sql("SELECT cand_id, branch, decision, target_id, same_run_id, creates, round(score, 6) score FROM resolved", *ladder()),
        "adjudicate_ops": sql("SELECT cand_id, k, op, CASE WHEN op = 'SUPERSEDE' THEN 'high' ELSE 'additive' END risk FROM (SELECT cand_id, unnest(ops) op, (unnest(range(len(ops))))::INTEGER k FROM (SELECT cand_id, CASE WHEN branch = 'same_run' OR decision IN ('merge', 'duplicate') THEN ['MERGE_NODE'] WHEN decision = 'supersedes' THEN ['ADD_NODE', 'SUPERSEDE'] WHEN decision = 'contradicts' THEN ['ADD_NODE', 'CONTRADICT'] ELSE ['ADD_NODE'] END ops FROM resolved WHERE own LIKE 'adjudicated%'))", *ladder()),
        "same_run_memo": sql("SELECT run, pos, CASE WHEN same_run_id IS NOT NULL THEN 'same_run' ELSE own END branch, same_run_id FROM (SELECT *, CASE WHEN nm <> '' THEN (SELECT min(o.pos) FROM m o WHERE o.own = 'new' AND o.run = m.run AND o.tp = m.tp AND o.nm = m.nm AND o.pos < m.pos) END same_run_id FROM m)", memo),
        "edge_resolve": sql('SELECT edge_id, source_id, target_id, "type" FROM (SELECT edge_id, s.r source_id, t.r target_id, e."type" FROM f_edges e JOIN r s ON s.cand_id = e.source_id JOIN r t ON t.cand_id = e.target_id) WHERE source_id <> target_id', *ladder(), "r AS (SELECT cand_id, coalesce(same_run_id, CASE WHEN NOT creates THEN target_id END, cand_id) r FROM resolved)"),
        "scope_violations": sql(f"SELECT p_partkey node_id FROM part WHERE p_size = 7 AND p_partkey NOT IN (SELECT node_id FROM f_nodes WHERE {HERE})"),
        "canonical_trigram": f"WITH a AS (SELECT DISTINCT c_mktsegment || ' desk' AS name FROM customer), b AS (SELECT p_type title FROM part UNION SELECT c_mktsegment FROM customer), s AS (SELECT name, title, len(list_intersect(g, h)) c, len(g) n, len(h) m FROM (SELECT name, {grams('name')} g FROM a), (SELECT title, {grams('title')} h FROM b)) SELECT name, title, round(score, 6) score FROM (SELECT *, c / (n + m - c) score, row_number() OVER (PARTITION BY name ORDER BY c / (n + m - c) DESC, title) k FROM s WHERE c / (n + m - c) >= 0.1) WHERE k = 1",
        "neighbors_1hop": sql('SELECT id, "type", status, score, reach FROM found', ONE, LINKS, *hop(1, "start", "start", 30), found("all1")),
        "neighbors_2hop": sql('SELECT id, "type", status, score, reach FROM found', ONE, LINKS, *hop(1, "start", "start", 1000), *hop(2, "all1", "new1", 1000), found("all2")),
        "neighbors_capped": sql("SELECT id, reach, hop FROM all2", ONE, LINKS, *hop(1, "start", "start", 5), *hop(2, "all1", "new1", 5)),
        "recall_seeds": sql(f'SELECT node_id, kind, "type", title, {SHOWN.format("")} summary, round(score, 6) score FROM seeds', SEEDS),
        "recall_nodes": sql('SELECT id, kind, "type", title, summary, status, confidence, round(score, 6) score, reach FROM found', *RECALL, found("all1")),
        "recall_edges": sql('SELECT DISTINCT source_id, target_id, "type" FROM met1 WHERE source_id IN (SELECT id FROM found) AND target_id IN (SELECT id FROM found)', *RECALL, found("all1")),
        "render_edges": sql("SELECT e.source_id, e.target_id, e.\"type\", coalesce(s.title, '?') || ' -[' || e.\"type\" || ']-> ' || coalesce(t.title, '?') line FROM (SELECT DISTINCT source_id, target_id, \"type\" FROM links) e LEFT JOIN found s ON s.id = e.source_id LEFT JOIN found t ON t.id = e.target_id", *RECALL, found("all1")),
        "roster": sql("SELECT rank, node_id, \"type\", title, array_to_string(few, ', ') aliases FROM roster WHERE rank <= 200", ROSTER),
        "roster_render": sql("SELECT \"type\", string_agg(CASE WHEN len(few) > 0 THEN title || ' (aka: ' || array_to_string(few, ', ') || ')' ELSE title END, ' | ' ORDER BY rank) line FROM roster WHERE rank <= 60 GROUP BY \"type\"", ROSTER),
        "health": sql(f"SELECT (SELECT count(*) FROM f_nodes WHERE {HERE} AND {LIVE}) AS nodes, (SELECT count(*) FROM f_nodes WHERE {HERE} AND {LIVE} AND embedding IS NULL) nodes_without_embedding, (SELECT count(*) FROM f_edges WHERE {HERE} AND invalid_at IS NULL) active_edges, (SELECT count(*) FROM f_sources WHERE {HERE} AND extraction_status = 'pending') sources_pending, (SELECT count(*) FROM f_sources WHERE {HERE} AND extraction_status = 'failed') sources_failed, (SELECT count(*) FROM f_changesets WHERE status IN ('pending_review', 'partial')) changesets_awaiting_review, (SELECT count(*) FROM f_sources WHERE {HERE} AND raw_content <> '' AND source_id NOT IN (SELECT vec_id FROM embeddings)) sources_unindexed"),
        "candidate_summary": sql("SELECT node_id, trim(summary || chr(10) || CASE WHEN node_id % 2 = 0 THEN \"type\" || chr(10) || kind ELSE '' END, chr(10)) summary FROM f_nodes"),
        "merged_summary": sql("SELECT node_id, nullif(CASE WHEN node_id % 3 <> 0 AND node_id % 2 = 0 THEN summary || ' · ' || kind WHEN node_id % 3 <> 0 THEN summary WHEN node_id % 2 = 0 THEN kind || ' · ' || summary ELSE '' END, '') summary FROM f_nodes"),
        "cost_daily": sql("SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, model, count(*) runs, sum(input_tokens)::BIGINT input_tokens, sum(output_tokens)::BIGINT output_tokens, sum(llm_calls)::BIGINT llm_calls FROM f_runs GROUP BY 1, 2"),
        "run_spend": sql("SELECT user_id, sum(input_tokens)::BIGINT input_tokens, sum(output_tokens)::BIGINT output_tokens, count(*) llm_calls, arg_max(model, run_id) FILTER (run_id % 4 <> 0) model FROM f_runs GROUP BY user_id"),
        "apply_metrics": sql(f"SELECT tenant_id, count(*) FILTER (risk = 'additive' AND op = 'ADD_NODE') created, count(*) FILTER (risk = 'additive' AND op = 'MERGE_NODE') merged, count(*) FILTER (risk = 'additive' AND op IN ('ADD_EDGE', 'ADD_CITATION')) edges, count(*) FILTER (risk = 'high') gated FROM (SELECT *, {RISK} risk FROM f_ops) GROUP BY tenant_id"),
        "merge_aliases": sql("SELECT node_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(aliases, na)), lambda a: a <> title)), '|') aliases FROM j", MERGED),
        "merge_fold": sql("SELECT node_id, coalesce((SELECT string_agg(s, '|' ORDER BY spot) FROM (SELECT s, min(k) spot FROM (SELECT unnest(ns) s, unnest(range(len(ns))) k) WHERE s <> summary GROUP BY s)), '') summaries, (3 + n)::BIGINT n_citations, n::BIGINT n_merges FROM j", MERGED),
        "norm_title": sql(f"SELECT node_id, {norm('title')} norm FROM f_nodes"),
        "titles_match": sql(f"SELECT node_id, other, len(a) > 0 AND len(b) > 0 AND (na = nb OR len(list_intersect(a, b)) >= 0.8 * greatest(len(a), len(b))) AS matches FROM (SELECT node_id, other, list_distinct({tokens('title')}) a, list_distinct({tokens('other')}) b, {norm('title')} na, {norm('other')} nb FROM p)", "p AS (SELECT n.node_id, n.title, string_split(o.title, ' ')[1] || ' ' || array_to_string(string_split(o.title, ' ')[2:4], ' ') other FROM f_nodes n JOIN f_nodes o ON o.node_id + 1 = n.node_id UNION ALL SELECT node_id, title, 'The ' || array_to_string(string_split(title, ' ')[1:7], ' ') FROM f_nodes)"),
        "cosine_pairs": f"SELECT a.vec_id, round({cosine('a.embedding', 'b.embedding')}, 6) score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "l2_normalize": "SELECT vec_id, 1.0::DOUBLE norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
        "embed_text": sql("SELECT node_id, " + STRIP("'  ' || title || chr(10) || CASE WHEN node_id % 2 = 0 THEN summary ELSE '' END") + " AS text FROM f_nodes"),
        "kind_of": sql("SELECT node_id, CASE node_id % 6 WHEN 0 THEN 'knowledge' WHEN 2 THEN 'entity' WHEN 4 THEN 'knowledge' ELSE kind END kind FROM f_nodes"),
        "gate_classify": sql(f"SELECT seq, op, actor_kind, {RISK} risk FROM (SELECT seq, actor_kind, CASE WHEN seq % 11 = 0 THEN 'EXPLODE' WHEN seq % 13 = 0 THEN 'SET_LAYOUT' ELSE op END op FROM f_ops)"),
        "chunk_invariant": sql(r"SELECT source_id, true quoted, true numbered, length(raw_content) - length(ltrim(raw_content, E' \t\n\r')) AS first, length(rtrim(raw_content, E' \t\n\r')) AS last FROM f_sources WHERE trim(raw_content, E' \t\n\r') <> ''"),
        "gate_split": sql(f"SELECT tenant_id, op, risk, count(*) n FROM (SELECT *, {RISK} risk FROM f_ops) GROUP BY ALL"),
        "apply_gated": states("risk = 'additive' OR seq % 2 = 0"),
        "fold_nodes": states("true"),
        "supersede_effect": ends("SUPERSEDE", "UNION ALL SELECT DISTINCT other || '>' || node_id, 'supersedes', false FROM f_log WHERE op = 'SUPERSEDE'"),
        "remove_effect": ends("REMOVE_NODE"),
        "contradict_effect": sql("SELECT tenant_id, 'knowledge' kind, 'knowledge/open_question' AS \"type\", 'Conflict: ' || alias || ' vs ' || CASE WHEN seq % 2 = 0 THEN summary ELSE 'existing claim' END title, node_id || ',' || other conflict_node_ids, 'false' resolved FROM f_log WHERE op = 'ADD_EDGE'", LOG),
        "update_effect": sql("SELECT n.node_id, coalesce(u.t, n.title) title, n.\"type\" FROM f_nodes n LEFT JOIN (SELECT tenant_id, node_id, arg_max(alias, seq) t FROM f_ops WHERE op = 'UPDATE_NODE' GROUP BY 1, 2) u ON u.tenant_id = n.tenant_id AND u.node_id = n.node_id"),
        "disconnect_effect": sql("SELECT edge_id \"name\", \"type\", invalid_at IS NOT NULL OR seq IN (SELECT node_id FROM f_ops WHERE op = 'UPDATE_NODE') ended FROM f_edges"),
        "tenant_deleted": sql(" UNION ALL ".join(f"SELECT '{n}' table_name, count(*) n, 0::BIGINT theirs FROM f_{n} WHERE tenant_id <> 'acme'" for n in ("sources", "nodes", "edges", "segments"))),
        "without_vector": sql(f"SELECT node_id, {STRIP("title || chr(10) || summary")} AS text FROM f_nodes WHERE {LIVE} AND embedding IS NULL"),
        "canonical_ops": sql("SELECT q.cand_id, coalesce(how, own) branch, decision, target_id, hit same_run_id, makes AND hit IS NULL creates FROM q JOIN walk ON walk.cand_id = q.cand_id WHERE canonical_title IS NOT NULL", canon, *ladder(True)[:-2], *walked()),
        "context_text": sql("SELECT CASE WHEN (SELECT count(*) FROM found) = 0 THEN 'No relevant context found in the graph.' ELSE body || CASE WHEN omitted > 0 THEN chr(10) || chr(10) || '[... ' || omitted || ' more item(s) omitted for length]' ELSE '' END END AS context FROM told ORDER BY k DESC LIMIT 1", *RECALL, found("all1"), *CONTEXT),
        "chunk_spans": sql('SELECT source_id, "index", "start", "end", text FROM chunks', *chunked(400, 60)),
        "extract_batches": sql('SELECT source_id, "index", "start", "end" FROM chunks', *chunked(2000, 100)),
        "seg_index": sql('SELECT source_id, "index", "start", "end", 64 AS width FROM chunks', *chunked(1200, 150)),
        "extract_nodes": sql("SELECT source_id, \"index\" || ':c' || i temp_id, 'knowledge/insight' AS \"type\", 'knowledge' kind, array_to_string(w[1:8], ' ') title FROM worded UNION ALL SELECT source_id, \"index\" || ':e' || i, 'entity/component', 'entity', long FROM worded WHERE long IS NOT NULL", *chunked(200_000, 2_000), *LINES),
        "review_transition": sql("SELECT changeset_id, CASE WHEN changeset_id = f THEN 'rejected' ELSE status END status, CASE WHEN changeset_id = f THEN 'ada' END reviewed_by FROM f_changesets, (SELECT min(changeset_id) f FROM f_changesets WHERE status = 'partial')"),
    }
    searched = f"hit AS (SELECT * FROM (SELECT segment_id, s.source_id, s.text, s.locator, {cosine('s.embedding', 'q')} score FROM f_segments s, f_query WHERE {HERE}) ORDER BY score DESC, segment_id LIMIT 10)"
    origin = f"JOIN (SELECT source_id, origin FROM f_sources WHERE {HERE}) o USING (source_id)"
    out["search_segments"] = sql(f"SELECT segment_id, source_id, hit.text, hit.locator, round(score, 6) score, origin FROM hit {origin}", searched)
    out["search_min_score"] = sql(f"SELECT segment_id, source_id, round(score, 6) score, origin FROM hit {origin} WHERE score >= 0.15", searched)
    return out
