"""Secret scanning through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is parsed once on the driver into a Boolean query over trigrams that any match must
contain, in disjunctive form: a list of trigram sets.  The index holds a posting (trigram, document key) for every
trigram that some rule asks for and some document contains.  A query's conjunction is met by the documents that
are in all its postings; only these candidates are verified with the expression itself.  A rule from which no
trigram follows, such as a bare run of hexadecimal digits, scans every document.

Trigrams are compared in lower case, which can only add candidates.  Document keys are hashes of the row's id and
text; equal keys can only add candidates, too.  Candidates come back to their documents by a broadcast join while
their counted number is below ``BROADCAST_CANDIDATES``, and by a shuffled join beyond it.

Offsets count code points; a span is the whole match.  Matches are leftmost and do not overlap within a rule, and
one that fails its rule's length is dropped after matching, as it has consumed its characters.

Defined cases: a null text has no spans and the digest of an empty string; null and repeated ids are kept, each
row scanned for itself; an empty table gives no rows; other columns are ignored, or pass through where texts are
masked, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, id_text, written

try:  # the parser behind re has moved between versions
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p

BROADCAST_CANDIDATES = 500_000
#: Beyond these a regular expression's exact strings, or its query, are simplified to weaker ones.
MOST_STRINGS = 64
MOST_CLASS = 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    #: Characters of the group, once verified, that the match needs at least; matching itself ignores it.


#: The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Public formats of well-known credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# From an expression to a query.  A query is a set of conjunctions, each a set of trigrams; ALL has the empty
# conjunction, which every document meets.

Query = frozenset[frozenset[str]]
ALL: Query = frozenset([frozenset()])


def _least(q: Query) -> Query:
    return frozenset(x for x in q if not any(y < x for y in q))


def _and(a: Query, b: Query) -> Query:
    both = _least(frozenset(x | y for x in a for y in b))
    return both if len(both) <= MOST_STRINGS else min(a, b, key=len)


def _or(a: Query, b: Query) -> Query:
    both = _least(a | b)
    return both if len(both) <= MOST_STRINGS else ALL


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _strings(q: set[str]) -> Query:
    return _least(frozenset(_grams(s) for s in q))


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is _c.LITERAL:
            out.add(chr(value).lower())
        elif op is _c.RANGE and value[1] - value[0] < 64:
            out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
        if len(out) > MOST_CLASS:
            return None
    return out


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The exact strings that the nodes match, if few, and a query that every match meets."""
    run: set[str] | None = {""}
    query = ALL
    for op, value in nodes:
        exact, inner = None, ALL
        if op is _c.LITERAL:
            exact = {chr(value).lower()}
        elif op is _c.IN:
            exact = _class(value)
        elif op is _c.SUBPATTERN:
            exact, inner = _walk(value[-1])
        elif op is _c.BRANCH:
            exact, inner = set(), frozenset()
            for branch in value[1]:
                e, q = _walk(branch)
                exact = exact | e if exact is not None and e is not None and len(exact | e) <= MOST_STRINGS else None
                inner = _or(inner, q if e is None else _and(q, _strings(e)))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, getattr(_c, "POSSESSIVE_REPEAT", None)):
            low, high, body = value
            e, q = _walk(body)
            if e is not None and high == 1:
                exact = e | {""} if low == 0 else e
            elif e is not None and low == high and len(e) ** low <= MOST_STRINGS:
                exact = {"".join(x) for x in itertools.product(e, repeat=low)}
            elif low:
                inner = q if e is None else _and(q, _strings(e))
        elif op is _c.AT:
            exact = {""}
        if exact is not None and run is not None and len(exact) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            if op is not _c.BRANCH:
                query = _and(query, inner)
        else:
            query = _and(_and(query, _strings(run or {""})), inner)
            run = exact if exact is not None and len(exact) <= MOST_STRINGS else {""}
            if op is _c.BRANCH and exact is not None:
                query = _and(query, ALL)
    whole = query == ALL and all(op in (_c.LITERAL, _c.IN, _c.SUBPATTERN, _c.BRANCH, _c.MAX_REPEAT, _c.AT) for op, _ in nodes)
    if whole and run is not None and _is_exact(nodes):
        return run, ALL
    return None, _and(query, _strings(run or {""}))


def _is_exact(nodes) -> bool:
    """Whether the nodes match only the strings that _walk lists."""
    for op, value in nodes:
        if op is _c.IN and _class(value) is None:
            return False
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and not (value[1] == 1 or value[0] == value[1]) or op is _c.ANY:
            return False
        inner = [value[-1]] if op is _c.SUBPATTERN else value[1] if op is _c.BRANCH else [value[2]] if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) else []
        if not all(_is_exact(x) for x in inner):
            return False
    return True


def trigram_query(pattern: str) -> Query:
    """The Boolean query of an expression, in lower case: any one of the trigram sets must be contained whole."""
    exact, query = _walk(_p.parse(pattern))
    return query if exact is None else _and(query, _strings(exact))


# The index and its use.


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, key), for the trigrams that the rules ask for."""
    low = docs.select("key", F.lower("text").alias("low"))
    found = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    return low.select("key", F.explode(found).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the documents that meet a rule's query, by intersecting postings."""
    spark = index.sparkSession
    terms = [(kind, i, len(c), t) for kind, q in queries.items() for i, c in enumerate(sorted(map(sorted, q))) for t in c]
    wanted = spark.createDataFrame(terms, "kind string, conjunction int, size int, trigram string")  # fixed by the rules
    met = index.join(F.broadcast(wanted), "trigram").groupBy("key", "kind", "conjunction").agg(F.count_distinct("trigram").alias("n"), F.first("size").alias("size"))
    return met.filter("n = size").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often its result refers to it, also within functions of arrays."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, start: int, f) -> Column:
    """What ``f`` folds of the values before each, in about the square root of their number of blocks: a list that grows
    by one value at a time is copied each time, so blocks keep the work near linear."""

    def before(items: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(f(acc["at"], x).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))
        return F.aggregate(items, F.struct(first.alias("at"), F.array().cast("array<int>").alias("seen")), step, lambda acc: acc["seen"])

    def of_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(start), f))
        return F.flatten(F.zip_with(blocks, before(whole, F.lit(start)), before))

    return bound(blocks_of(values), of_blocks)


def blocks_of(values: Column) -> Column:
    """An array in blocks of about the square root of its size; one empty block if it is empty."""

    def cut(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / width)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * width + 1, width))

    return bound(values, cut)


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches, from the texts between them.  The group is found again within each
    match, which is the same match as no rule looks beyond its own."""
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.length if not rule.group else lambda w: F.length(F.regexp_extract(w, rule.pattern, rule.group))
    sizes = F.filter(F.zip_with(between, whole, lambda gap, w: F.struct(gap.alias("gap"), F.length(w).alias("size"), tested(w).alias("tested"))), lambda x: x["size"].isNotNull())

    def placed(sizes: Column) -> Column:
        start = running(F.transform(sizes, lambda x: x["gap"] + x["size"]), 0, lambda at, x: at + x)
        spans = F.zip_with(start, sizes, lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["tested"].alias("tested")))
        return F.filter(spans, lambda x: x["tested"] >= rule.least)

    return bound(sizes, placed)


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def index(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written postings of a corpus, for the trigrams of these rules; ``scan`` takes it for any rules with no others."""
    keyed = docs.select(_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = sorted({t for q in _indexed(rules).values() for c in q for t in c})
    return written(postings(keyed, wanted), "secret-postings") if wanted else docs.sparkSession.createDataFrame([], "trigram string, key long")


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _indexed(rules: tuple[Rule, ...]) -> dict[str, Query]:
    """The queries of the rules that have mandatory trigrams."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    return {k: q for k, q in queries.items() if frozenset() not in q}


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, id_col: str = "doc_id", text_col: str = "text", trigrams: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Every row, all columns, with an array of (start, rank, kind, end) in order, and that column's name."""
    key, kinds, text, spans = free_names(docs, "secret_key", "secret_kinds", "secret_text", "secret_spans")
    base = docs.withColumns({key: _key(id_col, text_col), text: F.coalesce(F.col(text_col).cast("string"), F.lit(""))})
    indexed = _indexed(rules)
    if indexed:
        trigrams = index(docs, rules, id_col=id_col, text_col=text_col) if trigrams is None else trigrams
        found = written(candidates(trigrams, indexed).select(F.col("key").alias(key), F.col("kinds").alias(kinds)), "secret-candidates")
        few = found.count() <= BROADCAST_CANDIDATES
        base = base.join(F.broadcast(found) if few else found, key, "left")
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    all_spans = []
    for rank, rule in enumerate(rules):
        own = _named(_spans(F.col(text), rule), rank, rule.kind)
        due = F.array_contains(kinds, rule.kind) if rule.kind in indexed else F.col(text).rlike(rule.pattern)
        all_spans.append(F.when(due, own).otherwise(none))
    out = base.withColumn(spans, F.array_sort(F.concat(*all_spans)))
    return out.select(*docs.columns, spans), spans


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, the counts of the base kinds, the digest of the base spans, and all spans."""
    found, spans = scan(id_text(docs, id_col, text_col), **options)
    base_kinds = [r.kind for r in BASE]
    base = F.filter(spans, lambda s: s["kind"].isin(base_kinds))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base_kinds], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with its spans replaced, overlapping ones as one.  A substring is found from the text's beginning, so the
    text is cut into about the square root of the number of spans of blocks first."""

    def cover(spans: Column) -> Column:
        covered = running(F.transform(spans, lambda s: s["end"]), 0, lambda at, x: F.greatest(at, x))
        tagged = F.zip_with(spans, covered, lambda s, c: F.struct(s["start"].alias("start"), c.alias("covered")))
        first = F.filter(tagged, lambda x: x["start"] >= x["covered"])  # the text from covered to start stays, then comes a mask
        rest = text.substr(F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(blocks_of(first), block), ""), rest)

    def block(own: Column) -> Column:
        at, stop = own[0]["covered"], F.element_at(own, -1)["start"]
        kept = lambda part: F.transform(own, lambda x: F.concat(part.substr(x["covered"] - at + 1, x["start"] - x["covered"]), F.lit(mask)))
        return F.array_join(bound(text.substr(at + 1, stop - at), kept), "")

    return bound(spans, cover)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", chars_col: str | None = None, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The same rows and columns; every span of the text is replaced, overlapping ones as one; ``chars_col`` follows its length."""
    found, spans = scan(docs, rules, id_col=id_col, text_col=text_col)
    (masked,) = free_names(found, "secret_masked")
    hit = F.size(spans) > 0
    out = found.withColumn(masked, F.when(hit, _masked(F.col(text_col), F.col(spans), mask)).otherwise(F.col(text_col)))
    if chars_col:
        out = out.withColumn(chars_col, F.when(hit, F.length(masked).cast("long")).otherwise(F.col(chars_col)))
    return out.withColumn(text_col, F.col(masked)).select(*docs.columns)
