"""A corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of documents: stages drop whole rows, or change texts
in place.

* ``quality`` drops texts that fail the count rules or the calibrated classifier.
* ``near_duplicates`` keeps one document of each SimHash group: five-word shingles, a similarity of about 0.8 or more.
* ``decontamination`` drops texts that hold a window of the benchmark.
* ``secrets`` replaces every secret by a mark and keeps the document.
* ``packing`` places the pieces of all that is left in sequences.

Defined cases: a null or empty text has no words, so ``quality`` drops it; the other stages, given one, keep it (null
stays null) and ``packing`` makes a piece of the end id alone of it.  Null ids are kept; ``near_duplicates`` keeps one
row of a group, that with the least id, and of repeated rows one.  Very long texts are judged whole.  Columns of any
name pass through all but the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimgraph.llm import decontaminate, near_copies, packing, quality, secrets
from claimgraph.llm.common import delete, owned, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, chars_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written and read again; what a stage made on the way is deleted once they are, and its
    rows once the next stage's are.  Only the last stage's rows stay, for the caller (or an ``owned`` block around)."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        with owned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
