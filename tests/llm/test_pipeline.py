"""The pipeline's stages against plain Python over the whole small table."""

from __future__ import annotations

import corpus_pipeline
from claimgraph.llm import entry, quality
from claimgraph.llm.common import owned

from .test_operators import SF, contamination_expected, near_expected, secret_spans


def redacted(text):
    out, at = [], 0
    for start, _, _, end in secret_spans(text):
        if start >= at:
            out.append(text[at:start] + "[SECRET]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hot = docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "array_join(reverse(split(text, ' ')), ' ') || ' token=abcdefgh12345678' as text", "lang", "source", "n_chars")
    docs = docs.unionByName(hot)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            break
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality":
            rows = {i: r for i, r in rows.items() if quality.judge((r["text"] or "").encode(), model)[2]}
        elif name == "near_duplicates":
            keep = {c for _, c in near_expected([(i, r["text"]) for i, r in rows.items()])}
            rows = {i: r for i, r in rows.items() if i in keep}
        elif name == "decontamination":
            bad = {e[0] for e in contamination_expected([(i, r["text"]) for i, r in rows.items()], items) if e[5]}
            rows = {i: r for i, r in rows.items() if i not in bad}
        elif name == "secrets":
            for r in rows.values():
                new = redacted(r["text"])
                if new != r["text"]:
                    r["n_chars"] = len(new)
                r["text"] = new
            assert any("[SECRET]" in r["text"] for r in rows.values())
        assert {r["doc_id"]: r.asDict() for r in docs.collect()} == rows, name
    placed = out.collect()
    assert {r["doc_id"] for r in placed} == set(rows)
    fill = {}
    for r in placed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_results_outlive_a_pipeline_run_and_owners_clean_up(spark):
    import os

    held = {name: entry.queries()[name](spark, SF) for name in ("op2_secrets", "op5_repeats", "op7_simhash")}
    before = {name: sorted(map(repr, df.collect())) for name, df in held.items()}
    with owned(spark) as own:
        assert corpus_pipeline.run(spark, SF).count() > 0
        folders = [f.removeprefix("file://") for f in own.folders]
        assert any(map(os.path.exists, folders))
    assert not any(map(os.path.exists, folders))
    assert {name: sorted(map(repr, df.collect())) for name, df in held.items()} == before


def test_stages_on_odd_rows(spark):
    """Every stage keeps nulls, clashing names, repeated rows and long texts as it says, and takes an empty table."""
    long = "plain words of a text that goes on " * 20_000
    texts = [(1, None), (2, ""), (None, "password: hunter2hunter2 and more words here"), (5, long), (5, long), (8, "é" * 120)]
    df = spark.createDataFrame([(i, t, "a", "b", 1, "x", "y") for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long, row_key string, secret_spans string")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality", "near_duplicates", "decontamination", "secrets"):
        out = stages[name](spark, df, SF)
        assert out.columns == df.columns and stages[name](spark, df.limit(0), SF).count() == 0
        rows = out.collect()
        assert all((r["row_key"], r["secret_spans"]) == ("x", "y") for r in rows)
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
        if name == "quality":
            assert not any(r["text"] in (None, "") for r in rows)
        elif name == "near_duplicates":
            assert ids == [(False, 1), (False, 5), (False, 8), (True, 0)]  # 2 is as wordless as 1
        else:
            assert len(rows) == len(texts)
        if name == "secrets":
            assert {r["text"] for r in rows if r["doc_id"] is None} == {"[SECRET] and more words here"} and None in {r["text"] for r in rows}
    placed = stages["packing"](spark, df, SF).collect()
    assert sum(r["doc_id"] == 1 for r in placed) == 1 and next(r["length"] for r in placed if r["doc_id"] == 1) == 1
    assert stages["packing"](spark, df.limit(0), SF).count() == 0
