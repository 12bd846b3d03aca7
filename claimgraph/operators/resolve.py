"""Entity resolution: candidates, the ladder, and the memo of one run.

Candidates and graph nodes have (tenant_id, graph_id, kind, type, title, aliases, embedding, created_at); candidates
also run and pos.  All steps against the graph are independent per candidate, as operations apply only after the
whole run resolves; the memo is a window over them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import OVERLAP, norm_title, title_tokens
from ..functions.vectors import knn

SCOPE = ["tenant_id", "graph_id"]


def surfaces(rows: DataFrame, id_col: str, *more: str) -> DataFrame:
    """One row per title or alias that has a key."""
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    out = rows.select(*SCOPE, "type", id_col, *more, F.explode(F.array_distinct(names)).alias("surface"))
    return out.withColumn("norm", norm_title(F.col("surface"))).filter("norm <> ''")


def title_exact(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cand_id, node_id): the earliest node of the type with the candidate's key among its titles and aliases, once for
    candidates of equal id."""
    keyed = candidates.select(*SCOPE, "type", "cand_id", norm_title(F.col("title")).alias("norm")).filter("norm <> ''")
    key = [*SCOPE, "type", "norm"]
    earliest = surfaces(nodes, "node_id", "created_at").groupBy(*key).agg(F.min(F.struct("created_at", "node_id")).alias("found"))
    return _once(keyed.join(earliest, key))


def _once(found: DataFrame) -> DataFrame:
    return found.groupBy("cand_id").agg(F.min("found").alias("found")).select("cand_id", F.col("found.node_id").alias("node_id"))


def title_fuzzy(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cand_id, node_id): the earliest node with a surface that shares enough words, but not the key.

    Two word sets that share four fifths of the larger one share a word among the rarest few of each, so only those
    words are joined on and common words gather no pairs.  Keys that differ in repeated words only have equal word lists;
    there the earliest node of a list and the earliest under another key answer for all keys.
    """
    words = lambda c: F.array_distinct(title_tokens(c))
    key = [*SCOPE, "type", "words"]
    # Word lists that many share count once, with the earliest of their nodes.
    asked = candidates.select("cand_id", *SCOPE, "type", norm_title(F.col("title")).alias("norm"), words(F.col("title")).alias("words")).filter(F.size("words") > 0)
    a = asked.select(*key).distinct().select(*key, F.lit(True).alias("mine"), F.lit(None).cast(nodes.schema["created_at"].dataType).alias("created_at"), F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id"))
    keyed = surfaces(nodes, "node_id", "created_at").withColumn("words", words(F.col("surface"))).groupBy(*key, "norm").agg(F.min(F.struct("created_at", "node_id")).alias("e"))
    k = F.row_number().over(Window.partitionBy(*key).orderBy("e", "norm"))
    nth = lambda n, c: F.max(F.when(F.col("k") == n, F.col(c)))
    b = keyed.withColumn("k", k).filter("k <= 2").groupBy(*key).agg(nth(1, "e").alias("e"), nth(1, "norm").alias("e_norm"), nth(2, "e").alias("other"))
    both = a.unionByName(b.select(*key, F.lit(False).alias("mine"), "e.created_at", "e.node_id"))
    tokens = both.select("*", F.explode("words").alias("word"))
    often = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(often, "word").withColumn("k", F.row_number().over(Window.partitionBy(*key, "mine").orderBy("n", "word")))
    rare = ranked.filter(F.col("k") <= F.size("words") - F.ceil(F.size("words") * OVERLAP - 1e-9) + 1)
    left = rare.filter("mine").select(*SCOPE, "type", "word", F.col("words").alias("x"))
    right = rare.filter("not mine").select(*SCOPE, "type", "word", "node_id", "created_at", F.col("words").alias("y"))
    share = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"))
    met = left.join(right, [*SCOPE, "type", "word"]).filter((share >= OVERLAP) & (F.col("x") != F.col("y")))
    best = met.groupBy(*SCOPE, "type", F.col("x").alias("words")).agg(F.min(F.struct("created_at", "node_id")).alias("near"))
    repeated = F.when(F.col("e_norm") != F.col("norm"), F.col("e")).otherwise(F.col("other"))
    found = asked.join(best, key, "left").join(b, key, "left").withColumn("found", F.least("near", repeated))
    return _once(found.filter("found is not null"))


def nearest_nodes(candidates: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(cand_id, node_id, score, rank): the k closest live nodes of the candidate's kind."""
    return knn(candidates, nodes, k, on=[*SCOPE, "kind"], query_id="cand_id", row_id="node_id")


def best_candidates(candidates: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """The closest of the candidate's own type within the k, and the closest of any; the cut by kind comes first."""
    near = nearest_nodes(candidates, nodes, k)
    typed = near.join(nodes.select("node_id", F.col("type").alias("node_type")), "node_id").join(candidates.select("cand_id", "type"), "cand_id")
    own = F.when(F.col("node_type") == F.col("type"), F.col("rank"))
    pick = lambda c, by: F.min_by(c, by)
    return typed.groupBy("cand_id").agg(
        pick("node_id", own).alias("same_id"), pick("score", own).alias("same_score"),
        pick("node_id", F.col("rank")).alias("any_id"), pick("score", F.col("rank")).alias("any_score"), pick("node_type", F.col("rank")).alias("any_type"),
    )


def ladder(candidates: DataFrame, nodes: DataFrame, *, merge: float = 0.90, related: float = 0.74, k: int = 5, canonical: DataFrame | None = None, verdicts: DataFrame | None = None, adjudicate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per candidate: run, pos, branch, target_id, score, decision and whether it creates a node.

    ``canonical`` has (cand_id, canonical_node_id, canonical_title, exact); ``verdicts`` (cand_id, verdict) is the
    adjudicator's table, distinct where it has no row.  Or ``adjudicate`` takes the nominated pairs (cand_id, node_id) and
    gives (cand_id, verdict): first of those with a node of the host's, then of the others' nominees.  An empty title key never merges through the memo.
    """
    best = best_candidates(candidates, nodes, k)
    exact = title_exact(candidates, nodes).withColumnRenamed("node_id", "exact_id")
    fuzzy = title_fuzzy(candidates, nodes).withColumnRenamed("node_id", "fuzzy_id")
    rows = candidates.select("cand_id", "run", "pos", *SCOPE, "type", norm_title(F.col("title")).alias("norm"))
    for more in (best, exact, fuzzy):
        rows = rows.join(more, "cand_id", "left")
    node_kind = nodes.schema["node_id"].dataType
    rows = rows.join(canonical, "cand_id", "left") if canonical is not None else rows.withColumns({"canonical_node_id": F.lit(None).cast(node_kind), "canonical_title": F.lit(None).cast("string")})
    rows = rows.join(verdicts, "cand_id", "left") if verdicts is not None else rows.withColumn("verdict", F.lit(None).cast("string"))
    has_node = F.col("canonical_node_id").isNotNull()
    same_key = (norm_title(F.col("canonical_title")) == F.col("norm")) & (F.col("norm") != "")
    rows = rows.withColumns({"verdict": F.coalesce("verdict", F.lit("distinct")), "hosted": F.coalesce("verdict", F.lit("distinct"))})
    if adjudicate is not None:
        sure = lambda c: F.coalesce(c, F.lit(False))
        settled = sure(F.col("same_score") >= merge) | F.col("exact_id").isNotNull() | sure(has_node & same_key) | (F.col("canonical_title").isNotNull() & ~has_node)
        nominee = F.when(F.col("same_score") >= related, F.col("same_id")).when(F.col("any_score") >= related, F.col("any_id")).otherwise(F.col("fuzzy_id"))
        told = adjudicate(rows.filter(~settled & has_node).select("cand_id", F.col("canonical_node_id").alias("node_id"))).select("cand_id", F.col("verdict").alias("hosted"))
        rows = rows.drop("hosted").join(told, "cand_id", "left")
        told = adjudicate(rows.filter(~settled & nominee.isNotNull() & ~F.col("hosted").eqNullSafe("duplicate")).select("cand_id", nominee.alias("node_id"))).select("cand_id", "verdict")
        rows = rows.drop("verdict").join(told, "cand_id", "left").withColumns({"verdict": F.coalesce("verdict", F.lit("distinct")), "hosted": F.coalesce("hosted", F.lit("distinct"))})
    branch = (
        F.when(F.col("same_score") >= merge, "vector_threshold")
        .when(F.col("exact_id").isNotNull(), "exact_title")
        .when(has_node & same_key, "canonical_exact")
        .when(has_node & (F.col("hosted") == "duplicate"), "canonical_adjudicated")
        .when(F.col("canonical_title").isNotNull() & ~has_node, "canonical_new")
        .when(F.col("same_score") >= related, "adjudicated_same")
        .when(F.col("any_score") >= related, "adjudicated_any")
        .when(F.col("fuzzy_id").isNotNull(), "adjudicated_title")
        .otherwise("new")
    )
    rows = rows.withColumn("own", branch)
    target = F.when(F.col("own").isin("vector_threshold", "adjudicated_same"), F.col("same_id")).when(F.col("own") == "exact_title", F.col("exact_id"))
    target = target.when(F.col("own").isin("canonical_exact", "canonical_adjudicated"), F.col("canonical_node_id")).when(F.col("own") == "adjudicated_any", F.col("any_id")).when(F.col("own") == "adjudicated_title", F.col("fuzzy_id"))
    score = F.when(F.col("own").isin("vector_threshold", "adjudicated_same"), F.col("same_score")).when(F.col("own") == "adjudicated_any", F.col("any_score"))
    rows = rows.withColumns({"target_id": target, "score": score})
    decision = adjudicated(F.col("verdict"), (F.col("own") == "adjudicated_any") & (F.col("any_type") != F.col("type")))
    asked = F.startswith("own", F.lit("adjudicated_"))
    rows = rows.withColumn("decision", F.when(asked, decision).when(F.col("own").isin("new", "canonical_new"), "new").otherwise("merge"))
    creates = F.col("own").isin("new", "canonical_new") | (asked & (F.col("decision") != "duplicate"))
    rows = rows.withColumn("creates", creates)
    return memo(rows if canonical is not None else rows.drop("canonical_title", "canonical_node_id"))


def adjudicated(verdict: Column, cross_type: Column) -> Column:
    """The adjudicator reads text, not types: a duplicate of another type is refused."""
    return F.when(cross_type & (verdict == "duplicate"), "distinct").when(verdict.isin("duplicate", "supersedes", "contradicts", "gate"), verdict).otherwise("distinct")


def memo(rows: DataFrame) -> DataFrame:
    """Within a run, a later candidate with the key and type of one that created a node merges into it.

    ``rows`` has run, pos, norm, type, cand_id, own, creates.  The owner of a key is the first that creates a node;
    as it has none before it, one window settles all.  A candidate created under a canonical title owns two keys and
    may itself be folded by either, which is settled in order within its run and type.
    """
    if "canonical_title" in rows.columns:
        return _memo_in_order(rows)
    alone = F.when(F.col("norm") == "", F.col("cand_id").cast("string"))  # rows without a key fold with none
    key = Window.partitionBy("run", "type", "norm", alone).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.when(F.col("norm") != "", F.first(F.when(F.col("creates"), F.col("cand_id")), ignorenulls=True).over(key))
    return _folded(rows.withColumn("same_run_id", prior), F.lit("same_run"))


def _folded(rows: DataFrame, label) -> DataFrame:
    hit = F.col("same_run_id").isNotNull()
    return rows.withColumns({"branch": F.when(hit, label).otherwise(F.col("own")), "creates": F.col("creates") & ~hit})


def _memo_in_order(rows: DataFrame) -> DataFrame:
    kind = rows.schema["cand_id"].dataType.simpleString()
    rows = rows.withColumn("second", F.when(F.col("own") == "canonical_new", F.nullif(norm_title(F.col("canonical_title")), F.lit(""))))
    # Only a candidate with two different keys ties one key's owner to another's; all other keys are settled by a window, in
    # which such a candidate also stands, beside, under its second key.
    two = F.col("second").isNotNull() & (F.col("second") != F.col("norm"))
    under = lambda key, beside: F.struct(F.col(key).alias("key"), F.lit(beside).alias("beside"))
    rows = rows.withColumn("entry", F.explode(F.when(two, F.array(under("norm", False), under("second", True))).otherwise(F.array(under("norm", False)))))
    alone = F.when(F.col("entry.key") == "", F.col("cand_id").cast("string"))
    key = Window.partitionBy("run", "type", "entry.key", alone)
    first = F.first(F.when(F.col("creates") & ~F.col("entry.beside"), F.col("cand_id")), ignorenulls=True).over(key.orderBy("pos", "cand_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"tied": F.max(two).over(key), "prior": F.when(F.col("norm") != "", first)}).filter("not entry.beside").drop("entry")
    own = rows.filter("tied").select("run", "type", "pos", "cand_id", "norm", "creates", "second")

    def settle(pdf):
        owner: dict[str, object] = {}
        prior, how = [], []
        pdf = pdf.sort_values(["pos", "cand_id"])
        for cand, norm, creates, second in zip(pdf["cand_id"], pdf["norm"], pdf["creates"], pdf["second"], strict=True):
            first, by = (owner.get(norm), "same_run") if norm else (None, None)
            if first is None and second:
                first, by = owner.get(second), "same_run_canonical"
            if first is None and creates:
                for key in filter(None, (norm, second)):
                    owner[key] = cand
            prior.append(first)
            how.append(by)
        out = pdf[["cand_id"]].copy()
        out["same_run_id"], out["how"] = prior, how
        return out[out["same_run_id"].notna()]

    found = own.groupBy("run", "type").applyInPandas(settle, f"cand_id {kind}, same_run_id {kind}, how string")
    rows = rows.join(found, "cand_id", "left").withColumns({"same_run_id": F.when(F.col("tied"), F.col("same_run_id")).otherwise(F.col("prior")), "how": F.when(F.col("tied"), F.col("how")).otherwise("same_run")})
    return _folded(rows, F.col("how")).drop("how", "second", "tied", "prior")


def branch_label(branch: Column) -> Column:
    """The branch as it is recorded with a merge."""
    return F.when(branch == "canonical_exact", "exact_title").when(F.startswith(branch, F.lit("adjudicated_")), "adjudicated").when(branch == "canonical_new", "new").otherwise(branch)


def operations(resolved: DataFrame) -> DataFrame:
    """The operations of each resolved candidate, in order: (cand_id, k, op, risk)."""
    merges = F.startswith("branch", F.lit("same_run")) | (F.col("decision").isin("merge", "duplicate"))
    follow = F.when(F.col("decision") == "supersedes", F.array(F.lit("ADD_NODE"), F.lit("SUPERSEDE"))).when(F.col("decision") == "contradicts", F.array(F.lit("ADD_NODE"), F.lit("CONTRADICT"))).otherwise(F.array(F.lit("ADD_NODE")))
    ops = F.when(merges, F.array(F.lit("MERGE_NODE"))).otherwise(follow)
    return resolved.select("cand_id", "branch", "decision", F.posexplode(ops).alias("k", "op"))


def edge_ends(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Extracted edges with real ids; those with an unresolved end, and loops, go."""
    real = resolved.select("cand_id", F.coalesce("same_run_id", F.when(~F.col("creates"), F.col("target_id")), "cand_id").alias("real"))
    side = lambda s: real.select(F.col("cand_id").alias(f"{s}_temp"), F.col("real").alias(f"{s}_id"))
    both = edges.join(side("source"), "source_temp", "left").join(side("target"), "target_temp", "left")
    return both.filter("source_id is not null and target_id is not null and source_id <> target_id")


def trigram_best(names: DataFrame, targets: DataFrame, least: float = 0.3) -> DataFrame:
    """(name, title, score): the most similar title by shared character trigrams, joined on trigrams that both have."""
    def grams(c: Column) -> Column:
        padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))

    # Sets as alike as that share a member among the rarest few of each, so common trigrams gather no pairs.
    both = names.select(F.col("name").alias("x"), F.lit(True).alias("mine")).unionByName(targets.select(F.col("title").alias("x"), F.lit(False).alias("mine"))).distinct().withColumn("g", grams(F.col("x")))
    each = both.select("*", F.explode("g").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(often, "t").withColumn("k", F.row_number().over(Window.partitionBy("x", "mine").orderBy("n", "t")))
    rare = ranked.filter(F.col("k") <= F.size("g") - F.ceil(F.size("g") * least - 1e-9) + 1)
    met = rare.filter("mine").select("t", F.col("x").alias("name"), F.col("g").alias("a")).join(rare.filter("not mine").select("t", F.col("x").alias("title"), F.col("g").alias("b")), "t").drop("t").distinct()
    common = F.size(F.array_intersect("a", "b"))
    scored = met.withColumn("score", common / (F.size("a") + F.size("b") - common))
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), "title"))
    return scored.filter(F.col("score") >= least).withColumn("k", best).filter("k = 1").select("name", "title", "score")
