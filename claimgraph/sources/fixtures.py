"""The knowledge graph's tables as views over the synthetic test tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_docs(self) -> int:
        return self.table("documents").count()

    @cached_property
    def n_vectors(self) -> int:
        return self.table("embeddings").count()

    @staticmethod
    def tenant(i):
        return F.when(i % 2 == 0, "acme").otherwise("globex")

    @staticmethod
    def div(i, by: int):
        """The whole quotient, in integers, as doubles do not tell large ids apart."""
        return F.call_function("div", i, F.lit(by))

    @classmethod
    def graph(cls, i):
        return F.when(cls.div(i, 2) % 10 == 9, "aux").otherwise("main")

    def sources(self) -> DataFrame:
        labels = self.table("labels").select("doc_id", "quality")
        d, i = self.table("documents").join(labels, "doc_id", "left"), F.col("doc_id")
        status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").otherwise("pending")
        return d.select(i.alias("source_id"), self.tenant(i).alias("tenant_id"), self.graph(i).alias("graph_id"), F.col("source").alias("origin"), F.col("text").alias("raw_content"), "lang", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"), status.alias("extraction_status"), (EPOCH + i * 60).alias("created_at"))

    def nodes(self, vectors: bool = True) -> DataFrame:
        d, i, n = self.table("documents"), F.col("doc_id"), self.n_docs
        words = F.split("text", " ")
        kind = F.when(i % 3 == 0, "entity/feature").when(i % 3 == 1, "entity/screen").otherwise("knowledge/decision")
        status = F.when(i % 17 == 0, "rejected").when(i % 13 == 0, "superseded").otherwise("active")
        none = F.array().cast("array<string>")
        out = d.select(
            i.alias("node_id"), self.tenant(i).alias("tenant_id"), self.graph(i).alias("graph_id"), kind.alias("type"), F.when(i % 3 == 2, "knowledge").otherwise("entity").alias("kind"),
            F.array_join(F.slice(words, 1, 8), " ").alias("title"), F.concat_ws("/", "lang", "source").alias("summary"), F.when(i % 11 == 0, F.array(F.concat(F.lit("folded "), "lang"))).otherwise(none).alias("summaries"), F.when(i % 7 == 0, F.array(F.array_join(F.slice(words, 1, 2), " "))).otherwise(none).alias("aliases"),
            status.alias("status"), F.when(i % 17 == 0, F.lit(EPOCH)).alias("deleted_at"), ((i % 10) / 10).alias("confidence"), F.array(i, (i + 2) % n, i).alias("citations"),
            (EPOCH + i * 60).alias("created_at"), (EPOCH + i * 60 + (i * 7919 % 1000) * 60).alias("updated_at"),
        )
        if not vectors:
            return out
        return out.join(self.table("embeddings").select(F.col("vec_id").alias("node_id"), "embedding"), "node_id", "left")

    def candidates(self) -> DataFrame:
        i = F.col("node_id")
        return self.nodes().filter(i % 5 == 0).withColumns({"cand_id": i, "run": self.div(i, 100), "pos": i})

    def graph_nodes(self) -> DataFrame:
        return self.nodes().filter((F.col("node_id") % 5 != 0) & (F.col("status") == "active"))

    def edges(self) -> DataFrame:
        n = self.n_docs
        parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"]
        rows = self.table("lineitem").select(*parts).distinct()
        source = F.col("l_partkey") % n
        rows = rows.withColumn("source_id", source)
        kind = F.when(F.col("l_returnflag") == "A", "affects").when(F.col("l_returnflag") == "N", "contains").otherwise("depends_on")
        valid = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
        s = F.col("source_id")
        return rows.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", valid).alias("edge_id"), "source_id",
            (((F.col("l_suppkey") * 37 + F.col("l_linenumber")) % (n // 2)) * 2 + s % 2).alias("target_id"), self.tenant(s).alias("tenant_id"), self.graph(s).alias("graph_id"),
            kind.alias("type"), valid.alias("valid_at"), F.when(F.col("l_linestatus") == "F", valid + 90 * 86400).alias("invalid_at"), F.col("l_orderkey").alias("seq"),
        )

    def segments(self) -> DataFrame:
        v = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        d, i = self.table("documents").join(v, "doc_id"), F.col("doc_id")
        return d.select(i.alias("segment_id"), i.alias("source_id"), self.tenant(i).alias("tenant_id"), self.graph(i).alias("graph_id"), "text", F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit("char").alias("unit")).alias("locator"), "embedding")

    def query(self, vec_id: int = 8) -> list[float]:
        return self.table("embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]

    def ops(self) -> DataFrame:
        k, u = F.get_json_object("props", "$.k").cast("long"), F.col("user_id")
        op = F.when(F.col("event_type") == "view", "MERGE_NODE").when(F.col("event_type") == "click", "ADD_EDGE").when(F.col("event_type") == "signup", "UPDATE_NODE").when(F.col("event_type") == "purchase", "SUPERSEDE").otherwise("REMOVE_NODE")
        return self.table("events").select(
            F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("commit_ts"), self.tenant(u).alias("tenant_id"), u.alias("node_id"), op.alias("op"),
            F.when(u % 5 == 0, "human").otherwise("agent").alias("actor_kind"), F.concat(F.lit("alias "), k % 10).alias("alias"), F.concat(F.lit("summary "), k % 5).alias("summary"), ((u + k) % 150).alias("other_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        )

    def runs(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("model"), (k * 10).alias("input_tokens"), k.alias("output_tokens"), F.lit(1).alias("llm_calls"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("ts").alias("created_at"), "user_id", F.col("event_id").alias("seq"))

    def changesets(self) -> DataFrame:
        from ..operators.oplog import gated

        ops = gated(self.ops())
        own = F.array_sort(F.collect_list(F.struct("seq", "op", "risk")))
        cs = ops.groupBy("tenant_id", "node_id", "day").agg(own.alias("ops"), F.min("commit_ts").alias("created_at"))
        risky = F.exists("ops", lambda o: o["risk"] == "high")
        return cs.withColumns({"changeset_id": F.concat_ws("/", "tenant_id", "node_id", "day"), "status": F.when(risky, "partial").otherwise("applied")})

    def memo(self) -> DataFrame:
        from ..functions.text import norm_title

        p = F.col("p_partkey")
        own = F.when(F.col("p_size") % 4 == 0, "merge").otherwise("new")
        return self.table("part").select((p % 20).alias("run"), p.alias("pos"), p.alias("cand_id"), norm_title(F.col("p_name")).alias("norm"), F.col("p_type").alias("type"), own.alias("own"), (own == "new").alias("creates"))

    def open_questions(self) -> DataFrame:
        i = F.col("node_id")
        rows = self.nodes(False).filter(i % 50 == 1).withColumn("type", F.lit("knowledge/open_question"))
        resolved = F.when(i % 3 == 1, "true").when(i % 3 == 2, "false")
        return rows.withColumns({"conflict_node_ids": F.array(i, i + 2), "resolved": resolved})
