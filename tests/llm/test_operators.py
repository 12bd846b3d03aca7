"""Each operator against brute force over the whole small tables, and on the cases its docstring defines."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from claimgraph.llm import chat, decontaminate, entry, near_copies, packing, quality, repeats, secrets, simhash, suffix_sort, token_files, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, DOC_ID2 string, n_words string, fingerprint string"


def rows_of(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = ("lorem ipsum dolor " * 40_000) + "token=abcdefgh12345678"
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (None, "password: hunter2hunter2 and more words here"), (5, long), (5, long), (6, long[:-1]), (7, "x" * 200), (8, "x" * 200), (8, "é" * 120 + "a"), (9, "a" * 49), (10, "a" * 50), (11, "a" * 51)]
    return spark.createDataFrame([(i, t, "z", "z", "z") for i, t in texts], DOC), texts


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def key(rows):
    return sorted(map(tuple, rows), key=repr)


# 1


def warc_expected(pages):
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[(html or "").encode()].append(i)
    out = []
    for i, _, html in pages:
        p = (html or "").encode()
        win = max((x for x in groups[p] if x is not None), default=None)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == win else "revisit", None if i == win else win))
    return key(out)


def test_warc_query(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in rows_of(spark, "pages")]
    assert key(entry.op1_warc(spark, SF).collect()) == warc_expected(pages)


def test_warc_odd_rows(spark):
    pages = [(1, None, None), (2, "http://a/\r\nb", ""), (None, "http://c", "x"), (3, "http://d", "x"), (3, "http://d", "x"), (4, "http://e", "y" * 300_000), (5, "http://é", "\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*p, 1, "q") for p in pages], "page_id long, url string, html string, sha int, winner string")
    index = warc.archive(df)
    got = warc.read_records(index).collect()
    assert key((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == warc_expected(pages)
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in pages}
    one = warc.read_records(index.filter("page_id = 4")).collect()
    assert len(one) == 1 and len(one[0]["payload"]) == 300_000
    assert warc.read_records(warc.archive(df.limit(0))).count() == 0
    alone = warc.read_records(warc.archive(df, min_revisit_bytes=2)).collect()
    assert Counter(r["record_type"] for r in alone) == {"response": 7}


def test_warc_ranges_coalesce():
    assert list(warc.ranges([(0, 10), (10, 5), (100, 5), (10**8, 1)])) == [(0, 105, [0, 1, 2]), (10**8, 10**8 + 1, [3])]


# 2


def secret_spans(text):
    t = text or ""
    out = []
    for rank, r in enumerate(secrets.BASE + secrets.MORE):
        for m in re.finditer(r.pattern, t):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, r.kind, m.end()))
    return sorted(out)


def secret_row(i, text):
    spans = secret_spans(text)
    n = Counter(s[2] for s in spans)
    join = lambda x: ",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in x)
    base = [s for s in spans if s[1] < 3]
    return i, n["assign"], n["access"], n["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(spans)


def literal_base(text):
    """The three rules as they are stated, written out anew."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_secrets_query(spark):
    docs = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert key(entry.op2_secrets(spark, "/root/testdata/sf0.01").collect()) == key(secret_row(r["doc_id"], r["text"]) for r in docs)
    assert sum(len(secret_spans(r["text"])) for r in docs) > 0
    for r in docs:
        assert sorted((k, a, b) for a, rank, k, b in secret_spans(r["text"]) if rank < 3) == sorted(literal_base(r["text"]))


def test_secrets_odd_rows(spark):
    df, texts = odd_docs(spark)
    more = ["token=secret: abcdefghij", "token: secret: abcdefghij", "é€\U0001f600 PassWord  =  'abcdefgh'", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "f" * 31, "0" * 33 + "g" + "a" * 32,
            "ghp_" + "a1B2" * 9, "xoxb-1234567890-abc", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.sig", "AIza" + "x" * 35, "api_key=12345678 apikey: abcdefg", "secret" * 50]
    texts += [(100 + i, t) for i, t in enumerate(more)]
    df = df.unionByName(spark.createDataFrame([(100 + i, t, "a", "b", "c") for i, t in enumerate(more)], DOC))
    assert key(secrets.report(df).collect()) == key(secret_row(i, t) for i, t in texts)
    assert secrets.report(empty_docs(spark)).count() == 0
    for _, t in texts:
        assert sorted((k, a, b) for a, rank, k, b in secret_spans(t) if rank < 3) == sorted(literal_base(t or ""))
    red = {(r["doc_id"], r["text"]) for r in secrets.redact(df).collect()}
    assert (102, "é€\U0001f600 [SECRET]'") in red and (1, None) in red and (9, "[SECRET]") in red and (100, "token=secret: abcdefghij") in red
    assert secrets.redact(df).columns == df.columns


def test_secrets_shuffled_candidates_clashing_names_and_a_reused_index(spark, monkeypatch):
    df, texts = odd_docs(spark)
    expected = key(secret_row(i, t) for i, t in texts)
    trigrams = secrets.index(df)
    monkeypatch.setattr(secrets, "BROADCAST_CANDIDATES", 0)
    assert key(secrets.report(df).collect()) == expected
    some = (secrets.MORE[0], secrets.BASE[0])
    plain, _ = secrets.scan(df, some)
    again, spans = secrets.scan(df, some, trigrams=trigrams)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, again.collect())) and spans in again.columns
    named = df.selectExpr("*", "1 as secret_key", "2 as SECRET_KINDS", "3 as secret_text", "4 as secret_spans", "5 as secret_masked", "6 as __secret_key")
    red = secrets.redact(named)
    assert red.columns == named.columns and {tuple(r)[-6:] for r in red.collect()} == {(1, 2, 3, 4, 5, 6)}


def test_secrets_of_one_text_with_very_many(spark):
    parts = [f"token=abcdefgh{k:08d}" if k % 3 else f"secret: password=abcdefgh{k:08d} é" for k in range(30_000)]
    df = spark.createDataFrame([(1, " ".join(parts)), (2, "none")], "doc_id long, text string")
    assert key(secrets.report(df).collect()) == key(secret_row(*r) for r in df.collect())
    text, at, out = " ".join(parts), 0, []
    for start, _, _, end in secret_spans(text):
        if start >= at:
            out.append(text[at:start] + "[SECRET]")
        at = max(at, end)
    assert secrets.redact(df).filter("doc_id = 1").first()["text"] == "".join(out) + text[at:]


def test_trigram_queries_are_necessary():
    for rule in secrets.BASE + secrets.MORE:
        q = secrets.trigram_query(rule.pattern)
        for t in ["password=abcdefgh", "PASSWD: abcdefgh", "Api_Key=abcdefgh", "apikey=abcdefgh", "secret=12345678", "token='12345678", "AKIA" + "Z" * 12, "ghp_" + "a" * 36, "xoxp-" + "1" * 10, "-----BEGIN PRIVATE KEY-----", "AIza" + "y" * 35]:
            if re.search(rule.pattern, t):
                assert any(all(g in t.lower() for g in c) for c in q), (rule.kind, t)
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ALL
    q = secrets.trigram_query("(foo|ba?rs)x+")
    assert frozenset() not in q and all(any(all(g in t for g in c) for c in q) for t in ("foox", "fooxx", "barsx", "brsxxx"))
    assert not any(all(g in t for g in c) for c in q for t in ("fox", "brx"))


# 3 and 6


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    from claimgraph.llm.tokens import default_tokenizer

    return Tokenizer.from_file(default_tokenizer())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(placed, texts, tokenizer, cap):
    expected = []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        expected += [(i, k, s, len(ids[s : s + cap.tokens]), crc(ids[s : s + cap.tokens])) for k, s in enumerate(range(0, len(ids), cap.tokens))]
    assert key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == key(expected)
    bins = defaultdict(list)
    for r in placed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(own) <= cap.documents and sum(n * n for _, n in own) <= cap.attention
    return len(bins), sum(e[3] for e in expected)


def test_packing_query(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark, "documents")]
    bins, total = check_packing(entry.op3_packing(spark, SF).collect(), docs, tokenizer, packing.Capacities())
    assert bins <= -(-total // 2048) + 2


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_odd_rows_and_tight_capacities(spark, tokenizer, score):
    df, texts = odd_docs(spark)
    cap = packing.Capacities(512, 3, 300_000, score=score)
    check_packing(packing.pack(df, cap).collect(), texts, tokenizer, cap)
    assert packing.pack(empty_docs(spark)).count() == 0


def test_packing_plan_keeps_every_constraint():
    rng = np.random.default_rng(5)
    for score in ("norm", "dot"):
        for _ in range(30):
            cap = packing.Capacities(64, int(rng.integers(2, 9)), int(rng.integers(4096, 5000)), score=score)
            counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 65, 12)}
            bins = defaultdict(list)
            for length, first, last, seq, copies, used in packing.plan(counts, cap):
                for r in range(first, last):
                    bins[seq + (r - first) // copies].append((used + (r - first) % copies * length, length))
            assert Counter(n for b in bins.values() for _, n in b) == counts
            for own in bins.values():
                own.sort()
                assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
                assert sum(n for _, n in own) <= 64 and len(own) <= cap.documents and sum(n * n for _, n in own) <= cap.attention


def test_packing_dot_takes_the_bin_most_alike_in_shape():
    cap = packing.Capacities(100, 3, 10_000, weights=(1.0, 1.0, 0.0), score="dot")
    steps = packing.plan({60: 1, 45: 1, 15: 1, 38: 1}, cap)
    where = {length: seq for length, _, _, seq, _, _ in steps}

    def alike(length, used, docs):
        spare, need = np.array([(100 - used) / 100, (3 - docs) / 3]), np.array([length / 100, 1 / 3])
        return spare @ need / np.sqrt(spare @ spare)

    assert where[60] != where[45]
    best = max((alike(38, 60, 1), where[60]), (alike(38, 45, 1), where[45]))
    assert where[38] == best[1]


def token_rows(texts, tokenizer):
    out, at = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, np.array(tokenizer.encode(x[1] or "", add_special_tokens=False).ids + [1], "<u2").tobytes())):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    return key(out)


def test_token_files_query(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark, "documents")]
    assert key(entry.op6_token_files(spark, SF).collect()) == token_rows(docs, tokenizer)


def test_token_files_odd_rows(spark, tokenizer, monkeypatch):
    df, texts = odd_docs(spark)
    texts += [(50 + i, t) for i, t in enumerate(["<|endoftext|> a<|startoftext|>b", "a b　c\x1cd", "İ ß’s don't I'LL"])]
    df = df.unionByName(spark.createDataFrame([(i, t, "", "", "") for i, t in texts[-3:]], DOC))
    monkeypatch.setattr(token_files, "DOCS_PER_RANGE", 4)
    assert key(token_files.round_trip(df).collect()) == token_rows(texts, tokenizer)
    assert token_files.round_trip(empty_docs(spark)).count() == 0


def test_a_tokenizer_that_is_not_by_words_is_used_on_whole_texts(tmp_path):
    from claimgraph.llm.tokens import WordEncoder
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}
    other = Tokenizer(models.BPE(vocab=vocab | {"Ġa": 300}, merges=[("Ġ", "a")]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(str(tmp_path / "t.json"))
    own = WordEncoder(str(tmp_path / "t.json"))
    text = "One  a a, Two\n a é"
    assert own.whole and own.ids(text.encode()).tolist() == other.encode(text).ids
    assert not WordEncoder().whole


@pytest.mark.parametrize("cached", [20, 800_000])
def test_texts_of_a_batch_are_encoded_together(tokenizer, cached):
    import pyarrow as pa
    from claimgraph.llm.tokens import WordEncoder

    class Counting:
        """Passes everything on, and counts calls and texts."""

        def __init__(self, inner):
            self.inner, self.calls, self.texts = inner, 0, 0

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **options):
            self.calls, self.texts = self.calls + 1, self.texts + len(texts)
            return self.inner.encode_batch_fast(texts, **options)

    rng = np.random.default_rng(6)
    syllables = ["an", "ti", "qu", "\u00e9r", "\u00fcb", "sch", "\u00c9", "\u4f60", "\u0958", "\u0130", "\u1112\u1161", "O", "e\u0301", "\u00aa"]
    ends = ["", "", "", ",", ".", ",***", "'s", "7", "|", "\u00a0x", "\x1c", "\u200d"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 6))) + str(rng.choice(ends)) for _ in range(6_000)]
    texts = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
    texts += [None, "", " \n\t ", " a  b\x0b\x0cc\r\n", "A<|endoftext|>B <|startoftext|> C <|", "<|END a<b", "\u0301 a \u0301b", texts[0], "x" * 300]
    own = WordEncoder(cached=cached)
    own.tokenizer = counting = Counting(own.tokenizer)
    for kind in (pa.string(), pa.large_string()):
        got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode_all(pa.array(texts, kind))]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        if kind == pa.string():  # one text and one call after another before
            assert counting.texts < len(set(words)) / 4 and counting.calls < len(texts) / 20
    sliced = pa.array(texts)[5:9]
    assert own.encode_all(sliced) == [own.encode((t or "").encode()) for t in texts[5:9]]
    assert own.encode_all(pa.array([], pa.string())) == [] and own.encode_all(pa.array([None, ""], pa.string())) == [b"", b""]


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, u in [(0, 1), (1, 1), (1, 10**9), (1000, 1), (1000, 1000), (5000, 10**12), (700, 3)]:
        v = np.sort(rng.integers(0, u, n))
        e, _ = token_files.EliasFano.load(token_files.EliasFano.of(v).dump())
        assert (e.decode(0, n) == v).all()
        for i in rng.integers(0, n, 30) if n else []:
            assert e.select(int(i)) == v[i]
            j = int(rng.integers(i, n)) + 1
            assert (e.decode(int(i), j) == v[i:j]).all()
        if n:
            assert len(e.low) + len(e.high) <= (n * (2 + max(0, np.log2(u / n))) + 64) / 8 + n / 8


# 4


def test_toxicity(spark):
    got = entry.op4_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r["expected_severity"] <= toxicity.GRADES - 1 for r in got)
    hit = [(r["toxic"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels]
    assert sum(t for t, y in hit if y) >= 0.8 * sum(y for _, y in hit)
    assert sum(t for t, y in hit if not y) <= 0.05 * len(hit)


def test_toxicity_held_out():
    import duckdb

    rows = [(t.encode(), y) for t, y in duckdb.sql("select text, toxic from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by hash(doc_id)").fetchall()]
    model = toxicity.fit(rows[:3000])
    assert (np.diff(model.thresholds) > 0).all()
    hashes = toxicity.WordHashes()
    x = [float((model.weights[b] * v).sum()) for b, v in (toxicity.vector(t, hashes) for t, _ in rows[3000:])]
    risk, y = 1 - model.probabilities(np.array(x))[:, 0], np.array([y for _, y in rows[3000:]])
    assert (risk[y == 1] >= toxicity.TOXIC_AT).mean() > 0.7 and (risk[y == 0] >= toxicity.TOXIC_AT).mean() < 0.05


def test_toxicity_equals_its_formula(spark):
    """Every score anew in plain Python from the model's weights and thresholds."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    grams = lambda t: [w for w in re.split(rb"[^0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)) if w]
    bucket = lambda x: ((x * 0x9E3779B97F4A7C15) % 2**64) >> (64 - toxicity.BITS)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        w = grams(texts[r["doc_id"]])
        h = [zlib.crc32(x) for x in w]
        n = Counter(map(bucket, [*h, *((a << 32) ^ b for a, b in itertools.pairwise(h)), *(zlib.crc32(x[:k]) + (k << 40) for k in toxicity.BEGINNINGS for x in w)]))
        x = sum(float(model.weights[b]) * np.log1p(c) for b, c in n.items())
        below = [1 / (1 + np.exp(x - t)) for t in model.thresholds] if w else [1.0] * 3
        p = np.diff([0, *below, 1])
        assert abs(r["expected_severity"] - p @ np.arange(4)) < 1e-4 and abs(r["p_toxic"] - (1 - below[0])) < 1e-4
        assert r["toxic"] == (r["p_toxic"] >= toxicity.TOXIC_AT)


def test_toxicity_grades_order_held_out_texts():
    """Severity of held-out toxic texts follows the grades made for them, and each threshold is calibrated in order."""
    import duckdb

    rows = [(t.encode(), y) for t, y in duckdb.sql("select text, toxic from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by hash(doc_id)").fetchall()]
    model, grade = toxicity.fit(rows[:2500]), toxicity.grades(rows)[2500:]
    hashes = toxicity.WordHashes()
    x = np.array([float((model.weights[b] * v).sum()) for b, v in (toxicity.vector(t, hashes) for t, _ in rows[2500:])])
    p = model.probabilities(x)
    mean = [float((p @ np.arange(4))[grade == g].mean()) for g in range(4)]
    rank = lambda v: np.argsort(np.argsort(v))
    rho = float(np.corrcoef(rank((p @ np.arange(4))[grade > 0]), grade[grade > 0])[0, 1])
    print("mean severity by grade", np.round(mean, 2), "rank correlation among toxic", round(rho, 2), "above thresholds", [(round(float(p[:, k:].sum(axis=1).mean()), 3), round(float((grade >= k).mean()), 3)) for k in (1, 2, 3)])
    assert mean == sorted(mean) and rho > 0.7


def test_toxicity_odd_rows(spark):
    df, texts = odd_docs(spark)
    model = toxicity.fit([(b"nice words here", 0), (b"bad idiot here", 1)] * 10)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(texts) and not any(r["toxic"] for r in got if not r["doc_id"] or r["doc_id"] < 4)
    assert toxicity.fit([(b"a", 0)]) is None and toxicity.score(df, None).filter("toxic or expected_severity > 0").count() == 0
    assert toxicity.score(empty_docs(spark), model).count() == 0


# 5


def test_repeats_query(spark):
    docs = [(r["doc_id"], r["text"].encode()) for r in rows_of(spark, "documents")]
    expected = repeats.brute_force(docs)
    assert sum(e[2] for e in expected) > 0
    assert key(entry.op5_repeats(spark, SF).collect()) == key(expected)


def test_repeats_odd_rows(spark, monkeypatch):
    df, texts = odd_docs(spark)
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 100, 400).astype(np.uint8)).decode()
    more = [(20 + i, base[a : a + n] + base[b : b + n]) for i, (a, b, n) in enumerate(zip(rng.integers(0, 300, 30), rng.integers(0, 300, 30), rng.integers(20, 100, 30), strict=True))]
    texts = [(i, t if len(t or "") < 3000 else t[:2000]) for i, t in texts + more]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts], DOC)
    for window, slice_bytes in ((50, 64 << 20), (20, 2000)):
        monkeypatch.setattr(repeats, "SLICE_BYTES", slice_bytes)
        expected = [x for x in repeats.brute_force([(i, (t or "").encode()) for i, t in texts if i is not None], window)]
        expected += [(None, len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts if i is None]
        assert key(repeats.report(df, window=window).collect()) == key(expected)
    assert repeats.report(empty_docs(spark)).count() == 0


def _covered(texts, window):
    """Bytes that a shard of these documents covers, two documents a batch."""
    shard = repeats.Shard()
    for k in range(0, len(texts), 2):
        ids, held = np.array([i for i, _ in texts[k : k + 2]]), [t for _, t in texts[k : k + 2]]
        doc, start, length, anchor = repeats.segments(held, window)
        if len(doc):
            pieces = [held[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            shard.add(repeats._row(ids, np.zeros(len(ids), np.int32), doc, start, pieces, anchor))
    gone = {i: bytearray(len(t)) for i, t in texts}
    for ids, _, starts, stops in shard.covered(window) if shard.at else ():
        for i, a, b in zip(ids.tolist(), starts.tolist(), stops.tolist(), strict=True):
            gone[i][a:b] = b"\1" * (b - a)
    shard.close()
    return {i: bytes(g) for i, g in gone.items()}


@pytest.mark.parametrize("slice_bytes", [1, 600, 5_000, repeats.SLICE_BYTES])
@pytest.mark.parametrize("window", [17, 50])
def test_repeats_divide_a_hot_anchor(monkeypatch, slice_bytes, window):
    monkeypatch.setattr(repeats, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(repeats, "OCCURRENCES", 7)
    rng = np.random.default_rng(5)
    grams = [bytes(rng.integers(97, 123, repeats.GRAM).astype(np.uint8)) for _ in range(3000)]
    hot = min(grams, key=lambda g: int(repeats._hashes(np.frombuffer(g, np.uint8), 0)[0]))
    words = [bytes(rng.integers(97, 101, 9).astype(np.uint8)) for _ in range(12)]
    texts = []
    for i in rng.permutation(60).tolist():
        parts = [words[j] for j in rng.integers(0, len(words), 14).tolist()]
        for at in (3, 7, 11):  # one anchor among many contexts
            parts.insert(at, hot)
        texts.append((i, b" ".join(parts)))
    texts += [(60, texts[0][1]), (61, texts[1][1] * 2), (62, b"-" * 200), (63, b"-" * 300), (64, b""), (65, b"short")]
    levels = []
    split = repeats.Shard._split
    monkeypatch.setattr(repeats.Shard, "_split", lambda self, n, window: levels.append(self.level) or split(self, n, window))
    got = _covered(texts, window)
    for i, n, removed, spans, _ in repeats.brute_force(texts, window):
        assert (len(got[i]), sum(got[i]), len([x for x in got[i].split(b"\0") if x])) == (n, removed, spans)
    assert sum(sum(g) for g in got.values()) > 1000
    assert bool(levels) == (slice_bytes < repeats.SHARD_TEXT_BYTES) and max(levels, default=0) < repeats.MOST_LEVELS


@pytest.mark.parametrize("memory", [200, suffix_sort.MEMORY])
def test_suffix_order(memory):
    rng = np.random.default_rng(1)
    for _ in range(60):
        parts = [bytes(rng.integers(1, 1 + int(rng.integers(1, 4)), size=int(rng.integers(1, 60))).astype(np.uint8)) for _ in range(int(rng.integers(1, 6)))]
        text, window = b"\0".join([*parts, parts[0]]) + b"\0", int(rng.choice([3, 8, 10, 50]))
        got = [(int(p), int(n)) for ps, ns in suffix_sort.suffix_order(np.frombuffer(text, np.uint8), window, memory) for p, n in zip(ps, ns, strict=True)]
        assert sorted(p for p, _ in got) == [i for i, c in enumerate(text) if c]
        for (a, _), (b, n) in itertools.pairwise(got):
            x, y = text[a : a + window], text[b : b + window]
            assert y <= x and n == next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))


def test_repeats_in_very_long_texts_and_a_shuffled_join(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = rng.choice([f"w{k}" for k in range(5000)], 120_000).tolist()
    texts = [(1, " ".join(words)), (2, " ".join(words[50_000:50_100]) + " own"), (3, "x " + " ".join(words[::-1])), (4, " ".join(words[:60_000]))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", -1)
    assert key(repeats.report(df).collect()) == key(repeats.brute_force([(i, t.encode()) for i, t in texts]))


# 7


def fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=3):
    """Component labels by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def simhash_expected(docs):
    fps = [fingerprint(t) for _, t in docs]
    label = linked(fps)
    least = {}
    for c, (i, _) in zip(label, docs, strict=True):
        least.setdefault(c, None)
        if i is not None:
            least[c] = i if least[c] is None else min(least[c], i)
    return key((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(docs, fps, label, strict=True))


def test_simhash_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark, "documents")]
    assert key(entry.op7_simhash(spark, SF).collect()) == simhash_expected(docs)


def test_simhash_odd_rows(spark, monkeypatch):
    df, texts = odd_docs(spark)
    texts.append((70, " ".join(f"w{k * k % 997}" for k in range(100_000))))
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts], DOC)
    assert key(simhash.near_duplicates(df).collect()) == simhash_expected(texts)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    expected = Counter(c for _, _, c in simhash_expected(texts))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({c: 1 for c in expected})
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", -1)
    named = df.selectExpr("*", "'mine' as row_key", "'its' as __row_key")
    kept = simhash.keep_one(named)
    assert kept.columns == named.columns and {(r["row_key"], r["__row_key"]) for r in kept.collect()} == {("mine", "its")}
    assert Counter(r["doc_id"] for r in simhash.keep_one(named).collect()) == Counter({c: 1 for c in expected})


@pytest.mark.parametrize("slice_", [500, 2_000_000])
def test_ball_hashing_finds_all_links(spark, slice_, monkeypatch):
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {0, 1, (1 << 64) - 1}
    for s in seeds.tolist():
        at = s
        for _ in range(int(rng.integers(2, 9))):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False).tolist():
                at ^= 1 << b
            fps.add(at)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "SLICE", slice_)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    expected = {f: c for f, c in zip(signed, linked(fps), strict=True)}
    assert {r["fp"]: r["component_id"] for r in simhash.group(df).collect()} == expected


def wide_fingerprint(text):
    """160 bits by a plain loop over the distinct five-word shingles."""
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ones = [0] * 160
    for h in {xxhash.xxh64_intdigest(g.encode(), 42) for g in grams}:
        wide, full = 0, (1 << 64) - 1
        for _ in range(3):
            wide = wide << 64 | h
            h = (h + 0x9E3779B97F4A7C15) & full
            h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & full
            h = ((h ^ h >> 27) * 0x94D049BB133111EB) & full
            h ^= h >> 31
        for b in range(160):
            ones[b] += wide >> (191 - b) & 1
    return sum(1 << (159 - b) for b in range(160) if 2 * ones[b] > len(grams))


def near_expected(docs):
    """(id, component) of each text."""
    prints = {t: wide_fingerprint(t) for t in {t for _, t in docs}}
    label = linked([prints[t] for _, t in docs], 24)
    least = {c: min((i for (i, _), d in zip(docs, label, strict=True) if c == d and i is not None), default=None) for c in set(label)}
    return [(i, least[c]) for (i, _), c in zip(docs, label, strict=True)]


def near_texts():
    """Texts with a chain and a crowd of edited copies, which differ in 1 to 60 of 200 words."""
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(5000)}"
    texts = []
    for size, edits in ((40, 2), (12, 8), (6, 20), (6, 60), (30, None)):
        base = [word() for _ in range(200)]
        for n in range(size):
            copy = list(base) if edits else base
            for at in rng.choice(200, edits or 3, replace=False):
                copy[at] = word()
            texts.append(" ".join(copy))
    return list(enumerate(texts)) + [(1000 + i, " ".join(word() for _ in range(3 + i))) for i in range(40)]


@pytest.mark.parametrize(("slice_", "small", "per_task"), [(2_000_000, 8, 64_000_000), (3_000, 2, 10_000)])
def test_near_copies(spark, slice_, small, per_task, monkeypatch):
    for name, value in (("SLICE", slice_), ("SMALL", small), ("PER_TASK", per_task), ("BLOCK", 64 if small == 2 else 1 << 20)):
        monkeypatch.setattr(near_copies, name, value)
    texts = near_texts()
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts], DOC)
    expected = near_expected(texts)
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in expected}
    of = dict(expected)
    assert len({of[i] for i in range(40)}) == 1 and sum(of[i] == i for i in range(1000, 1040)) == 40


def test_near_copies_odd_rows(spark):
    df, texts = odd_docs(spark)
    assert [near_copies.fingerprint((t or "").encode()).hex() for _, t in texts] == [f"{wide_fingerprint(t):040x}" for _, t in texts]
    expected = Counter({c: 1 for _, c in near_expected(texts)})
    assert Counter(r["doc_id"] for r in near_copies.keep_one(df).collect()) == expected
    assert near_copies.keep_one(empty_docs(spark)).count() == 0


# 8


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_expected(docs, items, window=10):
    windows, spots, listed = defaultdict(set), defaultdict(list), []
    for i, t in items:
        w = item_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
            spots[tuple(w[k : k + n])].append((len(listed), k))
        listed.append((i, w))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = item_words(t)
        hit, found, longest = [0] * len(w), set(), []
        for n in sizes:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [1] * n
                    found |= owners
                    for at, j in spots[tuple(w[k : k + n])]:
                        i, other = listed[at]
                        size = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(w[k:], other[j:], strict=False)))
                        longest.append((-size, k, i is None, i or 0, j))
        names = sorted(str(x) for x in found if x is not None)
        best = min(longest, default=None)
        last = (-best[0], best[1], None if best[2] else best[3], best[4]) if best else (0, None, None, None)
        out.append((d, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0, *last))
    return key(out)


def test_decontamination_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark, "documents")]
    items = [(r["item_id"], r["text"]) for r in rows_of(spark, "benchmark")]
    expected = contamination_expected(docs, items)
    assert sum(e[5] for e in expected) > 0
    assert key(entry.op8_decontamination(spark, SF).collect()) == expected


def test_decontamination_odd_rows(spark, monkeypatch):
    df, texts = odd_docs(spark)
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(rng.choice(["a", "B", "cé", "d9"], n))
    items = [(1, None), (2, "..."), (3, "one"), (None, say(4)), (4, say(12)), (5, say(30)), (5, say(5)), (6, say(3))]
    items.append((7, items[4][1]))
    more = [(30 + i, say(int(rng.integers(1, 80)))) for i in range(40)] + [(90, say(20) + ", " + re.sub("[a-z]", lambda m: m[0].upper(), items[5][1]) + "-x")]
    texts += more
    df = df.unionByName(spark.createDataFrame([(i, t, "a", "b", "c") for i, t in more], DOC))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, TEXT2 int")
    expected = contamination_expected(texts, items)
    for block, shard in ((8 << 20, 8 << 20), (20, 300)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        assert key(decontaminate.contamination(df, bench).collect()) == expected
    clean = Counter((e[0], e[1]) for e in expected if not e[5])
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], len(item_words(r["text"]))) for r in kept.collect()) == clean
    assert decontaminate.contamination(empty_docs(spark), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert (90, 0, 5, 0, 30) in {(m["doc_id"], m["doc_word"] - 20, m["item_id"], m["item_word"], m["length"]) for m in decontaminate.matches(df, bench).collect()}


def matches_expected(docs, items, window=10):
    """Every suffix of every item against every place."""
    out = []
    for i, t in items:
        w = item_words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            common = [(sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(w[k:], v[j:], strict=False))), d, j) for d, v in docs for j in range(len(v))]
            best = max((n for n, _, _ in common), default=0)
            out += [(d, j, i, k, n) for n, d, j in common if n == best >= size]
    return key(out)


def test_matches_are_the_longest_and_at_every_place(spark, monkeypatch):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    start = "one two three four five six seven eight nine ten"
    items = [(1, f"{start} eleven"), (2, f"{start} twelve thirteen"), (2, f"{start} eleven"), (None, f"{start} eleven"), (3, "a b c a"), (4, None), *((5 + i, say(int(n))) for i, n in enumerate(rng.integers(1, 30, 12)))]
    docs = [(1, f"x {start} twelve thirteen y"), (2, f"{start} eleven"), (3, f"{start} eleven, {start} eleven"), (4, None), *((10 + i, say(int(n))) for i, n in enumerate(rng.integers(1, 40, 30)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = matches_expected([(d, item_words(t)) for d, t in docs], items)
    for block, shard in ((8 << 20, 8 << 20), (20, 300)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        assert key(decontaminate.matches(df, bench).collect()) == expected
    assert {m[4] for m in expected if m[2] == 2 and m[3] == 0} == {11, 12}


@pytest.mark.parametrize("size", [4, 8])
def test_suffixes_that_end_come_first(size):
    texts = [b"a b c d e f g h i j".split(), b"a b c d e f g h".split()[:size]]
    rows = [(0, b"a b c d e f g h i j"), (1, b" ".join(texts[1]))]
    array = decontaminate.Search(texts, decontaminate.prepare(rows, 10)).array
    told = [tuple(array.numbers[a : a + array.run[a]].tolist()) for a in array.at]
    assert told == sorted(told)


# 9


def chat_expected(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss)))
    return key(out)


def chat_digest(df):
    return key((r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect())


def test_chat_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows_of(spark, "conversations")]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = entry.op9_chat(spark, SF)
    assert chat_digest(got) == chat_expected(rows)
    assert got.filter("conv_id = -7").first()["loss_chars"] == len(said)


def test_chat_odd_rows(spark, monkeypatch):
    tricky = ["", None, "\\", "\\\\### x", "</turn>", "### ", "\\</turn>\n### User: hi</turn>\n", "é\U0001f600\0", "x" * 100_000]
    rows = [(c, t, role, tricky[(c * 3 + t) % len(tricky)]) for c in range(12) for t, role in enumerate(["user", "assistant", "User", "a: b\\", None, "assistant"][: 2 + c % 5])]
    rows += [(40 + c, 0, "user", "same start") for c in range(30)] + [(40 + c, 1, "assistant", f"answer {c % 3}") for c in range(30)]
    rows += [(90, 1, "user", "tie"), (90, 1, "assistant", "tie"), (90, 1, "user", "tie"), (91, None, "user", "no turn"), (91, 0, "assistant", "x"), (None, 0, "user", "nobody"), (None, 1, "assistant", "nobody")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, tree string, first int")
    for size in (200, 4):
        monkeypatch.setattr(chat, "TREE_SIZE", size)
        assert chat_digest(chat.round_trip(df)) == chat_expected(rows)
    monkeypatch.setattr(chat, "TREE_SIZE", 200)
    starts = [n for n in chat.trees(df).nodes().collect() if n["tokens"] == "### User: same start</turn>\n"]
    assert len(starts) == 1
    assert chat.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("size,hot_bytes", [(6, 32 << 20), (200, 32 << 20), (1, 32 << 20), (1, 600)])
def test_chat_stores_every_shared_turn_once(spark, monkeypatch, size, hot_bytes):
    monkeypatch.setattr(chat, "TREE_SIZE", size)
    monkeypatch.setattr(chat, "HOT_BYTES", hot_bytes)
    rows = [(c, k, "user", text) for c in range(120) for k, text in enumerate(["system", f"topic {c % 30}", f"detail {c % 60}", f"own {c}"])]
    rows += [(200 + c, k, "user", text) for c in range(40) for k, text in enumerate(["system", "busy", f"detail {c % 10}", f"own {c}"])]
    rows += [(300 + c, k, "user", text) for c in range(5) for k, text in enumerate(["system", "copied"])]
    rows += [(c, k, "user", text) for c in [None, *range(400, 419)] for k, text in enumerate(["system", "copied often"])]
    rows += [(500 + c, k, "user" if k % 2 else "assistant", f"long {k}") for c in range(3) for k in range(300 - c)]
    rows += [(600 + c, 0, "user", text) for c in range(3) for text in ("tie b", "tie a", f"tie {c % 2}")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    told = chat.trees(df)
    nodes = told.nodes().collect()
    text = {(n["tree"], n["node"]): chat.parse(n["tokens"])[0][1] for n in nodes}
    tops = {n["tree"]: n["above"] for n in nodes if n["parent"] == -1}
    above = {(n["tree"], n["node"]): (n["tree"], n["parent"]) if n["parent"] >= 0 else (tops[n["tree"]], 0) for n in nodes}

    def path(at):
        out = []
        while at in text:
            out.append(text[at])
            at = above[at]
        return tuple(reversed(out))

    by = defaultdict(list)
    for c, k, role, t in rows:
        by[c].append((k, role, t))
    shared = Counter(p for turns in ([t for _, _, t in sorted(x)] for x in by.values()) for p in {tuple(turns[:k]) for k in range(1, len(turns) + 1)})
    assert Counter(path(at) for at in text) == Counter(set(shared))
    # In its sequence a node stands after its parent, its ancestors' intervals are theirs, and depth comes first.
    for tree in tops:
        own = sorted((n for n in nodes if n["tree"] == tree), key=lambda n: n["node"])
        assert [n["node"] for n in own] == list(range(len(own))) and [n["first"] for n in own] == [0, *(n["last"] for n in own[:-1])]
        stack = []
        for n in own:
            while stack and stack[-1] != n["parent"]:
                stack.pop()
            assert (stack[-1] if stack else -1) == n["parent"]
            covered = sorted(x for a, b in zip(n["ancestors"][::2], n["ancestors"][1::2], strict=True) for x in range(a, b))
            assert covered == sorted(x for s in stack for x in range(own[s]["first"], own[s]["last"]))
            stack.append(n["node"])
    assert chat_digest(chat.read_back(told)) == chat_expected(rows)


def test_chat_with_one_common_beginning(spark):
    rows = [(c, k, "user", text) for c in range(1000) for k, text in enumerate(["system", f"own {c}"])]
    told = chat.trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [n["tokens"] for n in told.nodes().collect()].count("### User: system</turn>\n") == 1
    assert chat_digest(chat.read_back(told)) == chat_expected(rows)


# 10


def quality_expected(i, text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    again = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def test_quality_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(spark, "documents")]
    got = entry.op10_quality(spark, SF).collect()
    assert key(tuple(r)[:7] for r in got) == key(quality_expected(*d) for d in docs)
    assert all(r["kept"] == (not r["base_failed"] and r["quality"] >= quality.KEEP_AT) for r in got)
    # The probability anew from the weights: each family's mean weight, words and pairs of words, 3 and 5 characters.
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    bucket = lambda x: ((x * 0x9E3779B97F4A7C15) % 2**64) >> (64 - quality.BITS)
    texts = dict(docs)
    for r in got:
        t = texts[r["doc_id"]] or ""
        h = [zlib.crc32(w) for w in t.encode().split()]
        grams = [h, [(a << 32) ^ b for a, b in itertools.pairwise(h)]]
        for n in (3, 5):
            grams.append([])
            for k in range(len(t) - n + 1):
                x = n
                for c in t[k : k + n]:
                    x = (x * 0x9E3779B1 + ord(c)) % 2**64
                grams[-1].append(x)
        s = model.bias + sum(float(np.mean([model.weights[(f << quality.BITS) + bucket(x)] for x in g])) for f, g in enumerate(grams) if g)
        assert abs(r["quality"] - 1 / (1 + np.exp(-model.slope * s - model.offset))) < 1e-3


def test_quality_held_out():
    import duckdb

    rows = [(t.encode(), y) for t, y in duckdb.sql("select text, quality from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by hash(doc_id)").fetchall()]
    model = quality.fit(rows[:1200])
    p, y = np.array([model.probability(t, t.split()) for t, _ in rows[1200:2200]]), np.array([y for _, y in rows[1200:2200]])
    assert (p[y == 1] >= quality.KEEP_AT).mean() > 0.97 and (p[y == 0] >= quality.KEEP_AT).mean() < 0.35
    assert abs(p.mean() - y.mean()) < 0.05


def test_quality_is_fitted_on_4000_rows(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id) as text")
    assert len(quality.labelled(docs, docs.selectExpr("doc_id", "1 as quality"), "quality")) == 4000


def test_quality_odd_rows(spark):
    df, texts = odd_docs(spark)
    more = [(60, "a b c d e f g h " * 5), (61, "a b c d e f g h x a b c d e f g h"), (62, "l\nl\n \n \nl\r\nl"), (63, "w " * 19), (64, " ".join(f"w{i}" for i in range(20)))]
    texts += more
    df = df.unionByName(spark.createDataFrame([(i, t, "a", "b", "c") for i, t in more], DOC))
    got = quality.assess(df, None).collect()
    assert key(tuple(r)[:7] for r in got) == key(quality_expected(*d) for d in texts)
    assert all(r["kept"] != r["base_failed"] for r in got)
    model = quality.fit([(b"good clean words " * 9, 1), (b"###$$$ %%% &&&" * 9, 0)] * 10)
    kept = quality.keep(df, model)
    assert kept.columns == df.columns and kept.count() <= sum(not quality_expected(*d)[6] for d in texts)
    assert quality.assess(empty_docs(spark), model).count() == 0 and quality.fit([]) is None


def test_near_copies_meet_in_bounded_memory():
    """Fingerprints of one task with 2.6 million variants: an executor has several such tasks beside its heap."""
    import tracemalloc

    raw = np.random.default_rng(5).integers(0, 256, 5000 * 20, dtype=np.uint8)
    prints = near_copies._parts(raw)
    values, left, who = prints[:, 0].astype(np.uint64) << np.uint64(32), np.full(5000, 2), np.arange(5000)
    tracemalloc.start()
    assert not list(near_copies.links_of(prints, values, left, who, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
