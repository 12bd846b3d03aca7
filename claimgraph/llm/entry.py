"""The thin queries on these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, packing, quality, repeats, secrets, simhash, token_files, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.round_trip(rows)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict:
    own = [op1_warc, op2_secrets, op3_packing, op4_toxicity, op5_repeats, op6_token_files, op7_simhash, op8_decontamination, op9_chat, op10_quality]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Those whose whole result SQL can express; for the others see the brute-force tests."""
    return {
        "op1_warc": OP1,
        "op8_decontamination": OP8,
        "op9_chat": OP9,
    }


#: Base 32 digits of a SHA-1, five bits each.
_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {5 * (i // 4) + 1}, 5))::BIGINT >> {15 - 5 * (i % 4)} & 31)::INTEGER, 1)" for i in range(32)
)
OP1 = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) h FROM pages), g AS (SELECT b, max(page_id) w FROM p GROUP BY b)
SELECT page_id, octet_length(p.b) payload_bytes, {_DIGITS} payload_digest, CASE WHEN page_id = w THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> w THEN w END refers_to FROM p JOIN g ON p.b = g.b"""

_WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: t <> '')"
OP8 = f"""WITH i AS (SELECT item_id, {_WORDS} w FROM benchmark), x AS (SELECT item_id, w, least(10, len(w)) n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k + 1 : k + n], ' ') s FROM (SELECT *, unnest(range(len(w) - n + 1)) k FROM x)),
d AS (SELECT doc_id, row_number() OVER () r, {_WORDS} w FROM documents), sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT r, n, k, array_to_string(w[k + 1 : k + n], ' ') s FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, p.n, k, item_id FROM p JOIN win ON p.s = win.s AND p.n = win.n),
cov AS (SELECT r, count(DISTINCT q) n_hit FROM (SELECT r, unnest(range(k, k + n)) q FROM (SELECT DISTINCT r, k, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r),
spot AS (SELECT item, item_id, n, j, array_to_string(w[j + 1 : j + n], ' ') s FROM (SELECT *, unnest(range(len(w) - n + 1)) j FROM (SELECT *, row_number() OVER () item FROM x))),
met AS (SELECT r, k, p.n, item, item_id, j, k - row_number() OVER (PARTITION BY r, item, p.n, k - j ORDER BY k) run FROM p JOIN spot ON p.s = spot.s AND p.n = spot.n),
long AS (SELECT r, min(k) k, item_id, min(j) j, max(n) + count(*) - 1 size FROM met GROUP BY r, item, item_id, n, k - j, run),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY size DESC, k, item_id NULLS LAST, j) o FROM long) WHERE o = 1)
SELECT doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated,
 coalesce(size, 0) longest, k longest_word, item_id longest_item, j longest_item_word FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r) LEFT JOIN best USING (r)"""

_TIMES = "(length(t) - length(replace(t, '{0}', ''))) // length('{0}')"
OP9 = f"""WITH a AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') t FROM conversations UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
c AS (SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t) said, coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '') learned,
 sum(15 - 1 + length(role) + length(t) + {_TIMES.format("### ")} + {_TIMES.format("</turn>")} + length(t) - length(replace(t, chr(92), '')))::BIGINT formatted_chars FROM a GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) turns_sha256, length(learned) loss_chars, sha256(learned) loss_sha256, formatted_chars FROM c"""
