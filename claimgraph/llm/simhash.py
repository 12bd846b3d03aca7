"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints a and b that differ in at most 3 bits meet at some value within half that radius of each: at distance
1 from both if they differ in 1 or 2 bits, and at distance 1 from one and 2 from the other if they differ in 3.
Since 3 is odd, the two then have different parities, so every fingerprint emits its ball of radius 1 and the odd
ones that of radius 2.  Collisions at a value that some fingerprint reaches with one flip or none are always links;
two odd ones that meet only at distance 2 from both either meet again closer by or differ in 4 bits.

Variants are shuffled by their leading bits and expanded behind the shuffle: a fingerprint goes once to each
leading value that its flips can reach, with the flips it has left, and the task makes and sorts the variants in
slices of at most ``SLICE`` at a time, splitting by further bits.  A value's members are linked as a star and each
slice keeps a spanning forest, so a dense group costs as many links as it has members, not their pairs.

Components over the links: every round points a fingerprint to the least one among its neighbours, in the
alternating large-star and small-star form, until nothing changes; each round is a written table.

Words are lower-cased for A to Z only; a fingerprint bit is 1 if it is set in over half of the shingles' hashes.

Defined cases: a null text, or one without words, has fingerprint 0 and is linked like any other; null ids never
become representatives unless a component has no other, then component_id is null; repeated rows are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, free_names, id_text, row_key, to_batch, tune, written

RADIUS = 3
SLICE = 2_000_000
#: Variants that a task should expect; it sets the number of leading bits.
PER_TASK = 8_000_000
MOST_LEADING = 20
#: Tasks that share one component.
SALTS = 32


def shingle_hashes(text: bytes, words_per_shingle: int, seed: int = 42) -> np.ndarray:
    """Of one text in UTF-8, in order and with repeats."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    shingles = [joined[a:b] for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """Of one text in UTF-8."""
    return majority(shingle_hashes(text, words_per_shingle, seed))


def majority(hashes: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits += np.unpackbits(hashes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(key, doc_id, fp): fp is the fingerprint's 64 bits as a signed long, key names the row's values."""
    tune(docs.sparkSession)
    keyed = id_text(docs, id_col, text_col).select(row_key("doc_id", "text").alias("key"), "doc_id", "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.array([fingerprint(t, words, seed) for t in as_bytes(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(fps)], names=["key", "doc_id", "fp"])

    return keyed.mapInArrow(run, "key string, doc_id long, fp long")


# Variants.


def reach(fps: np.ndarray, left: np.ndarray, bit: int, value: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which can have ``value`` at ``bit`` (from the top), flipping it at need: their index, bits and flips left."""
    mask = np.uint64(1 << (63 - bit))
    same = ((fps & mask) != 0) == bool(value)
    i = np.flatnonzero(same | (left > 0))
    out = np.where(same[i], fps[i], fps[i] ^ mask)
    return i, out, left[i] - ~same[i]


def choose(n: int, k: int) -> int:
    return [1, 1 + n, 1 + n + n * (n - 1) // 2][k]


def variants(fps: np.ndarray, left: np.ndarray, bit: int, low: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values that flips of the bits from ``bit`` on, save the last ``low``, reach: value, which, flips left."""
    free = np.uint64(1) << np.arange(low, 64 - bit, dtype=np.uint64)
    who = np.arange(len(fps))
    values, which, rest = [fps], [who], [left]
    one = np.flatnonzero(left >= 1)
    if len(one) and len(free):
        values.append((fps[one, None] ^ free).ravel())
        which.append(np.repeat(one, len(free)))
        rest.append(np.repeat(left[one] - 1, len(free)))
    two = np.flatnonzero(left >= 2)
    if len(two) and len(free) > 1:
        a, b = np.triu_indices(len(free), 1)
        pairs = free[a] | free[b]
        values.append((fps[two, None] ^ pairs).ravel())
        which.append(np.repeat(two, len(pairs)))
        rest.append(np.repeat(left[two] - 2, len(pairs)))
    return np.concatenate(values), np.concatenate(which), np.concatenate(rest)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (the least member) of a graph on n nodes."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def links_of(fps: np.ndarray, left: np.ndarray, original: np.ndarray, bit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the fingerprints that meet below one leading value; ``original`` are they before any flip."""
    most = sum(int((left == k).sum()) * choose(64 - bit, k) for k in range(3))
    if len(fps) < 2:
        return
    if most > SLICE and bit < 64:
        for value in (0, 1):
            i, out, rest = reach(fps, left, bit, value)
            yield from links_of(out, rest, original[i], bit + 1)
        return
    values, which, rest = variants(fps, left, bit)
    # Flips used; an even fingerprint starts with one flip, an odd one with two.
    odd = np.bitwise_count(original).astype(np.int64) & 1
    used = (1 + odd[which]) - rest
    order = np.lexsort((used, values))
    v, w, u = values[order], which[order], used[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    take = ~new & (u[first] <= 1)
    a, b = w[first[take]], w[take]
    if not len(a):
        return
    close = np.bitwise_count(original[a] ^ original[b]) <= RADIUS  # true by construction; the values are checked all the same
    a, b = a[close], b[close]
    label = forest(len(fps), a, b)
    member = np.flatnonzero(label != np.arange(len(fps)))
    if len(member):
        yield original[label[member]], original[member]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within the radius."""
    n, odd = fps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.bit_count("fp") % 2), F.lit(0))).first()
    leading = min(MOST_LEADING, max(2, int(((n - odd) * 65 + odd * 2081) // PER_TASK).bit_length()))
    parts = 1 << leading

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("part int, fp long, left int, original long")
        for batch in it:
            original = batch.column("fp").to_numpy().view(np.uint64)
            state = [(original, 1 + (np.bitwise_count(original).astype(np.int64) & 1), np.arange(len(original)))]
            for bit in range(leading):
                split = [reach(f, k, bit, value) + (i,) for f, k, i in state for value in (0, 1)]
                state = [(out, rest, i[j]) for j, out, rest, i in split]
            for out, rest, i in state:
                if len(i):
                    part = (out >> np.uint64(64 - leading)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(out.view(np.int64)), pa.array(rest.astype(np.int32)), pa.array(original[i].view(np.int64))], schema=schema)

    dealt = fps.select("fp").mapInArrow(spread, "part int, fp long, left int, original long").repartitionById(parts, "part")

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("fp").to_numpy(), b.column("left").to_numpy(), b.column("original").to_numpy()) for b in it]
        if found:
            fp, left, original = (np.concatenate(x) for x in zip(*found, strict=True))
            for a, b in links_of(fp.view(np.uint64), left.astype(np.int64), original.view(np.uint64), leading):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        yield to_batch(arrow_schema("a long, b long"), [])

    met = dealt.mapInArrow(meet, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's component, for nodes with links.  ``edges`` is a written table."""
    while True:
        # Large star: a node's greater neighbours take its least neighbour (or itself).
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        large = written(large, "large-star")
        # Small star: a node and its smaller neighbours take the least of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        small = written(small.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "small-star")
        if edges.exceptAll(small).isEmpty() and small.exceptAll(edges).isEmpty():
            return small.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(small.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        edges = small


def group(prints: DataFrame, links_of_nodes: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of a written table: the least id reachable."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = written(links_of_nodes(nodes), "simhash-links")
    of = components(edges)
    linked = written(nodes.join(of.withColumnRenamed("node", "fp"), "fp"), "simhash-components")
    # A component may hold a third of all fingerprints: its id goes to SALTS places, and a fingerprint to one of them.
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = ids.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = linked.select("*", salt).join(ids, ["component", "salt"]).select("fp", "component_id")
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return written(named.unionByName(alone), "simhash-groups")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = written(fingerprints(docs, **options).select("doc_id", "fp"), "simhash-prints")
    named = prints.join(group(prints), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Rows to drop that are sent to all executors; beyond it the join is shuffled.
BROADCAST_KEYS = 200_000


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prints_of: Callable[..., DataFrame] = fingerprints, links_of_nodes: Callable[[DataFrame], DataFrame] = links, **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each group: the one with the least id, of rows with that id any one."""
    prints = written(prints_of(docs, id_col=id_col, text_col=text_col, **options), "simhash-keys")
    groups = group(prints.select("doc_id", "fp"), links_of_nodes)
    rows = prints.groupBy("fp", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.join(groups, "fp"), "simhash-rows")
    # Of the rows with the representative's id, one text's; null ids stand for a group only if it has no others.
    chosen = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("fp", "component_id").agg(F.min("key").alias("keep"))
    chosen = chosen.groupBy("component_id").agg(F.min("keep").alias("keep")).filter("component_id is not null").select("keep").unionByName(chosen.filter("component_id is null").select("keep"))
    chosen = written(chosen, "simhash-chosen")
    dropped = written(rows.join(chosen, rows["key"] == chosen["keep"], "left_anti").select("key").distinct(), "simhash-dropped")
    repeated = rows.filter("n > 1").join(chosen, rows["key"] == chosen["keep"], "left_semi").select("key").distinct()
    repeated = written(repeated, "simhash-repeated")

    (name,) = free_names(docs, "row_key")
    keyed = docs.withColumn(name, row_key_of(id_col, text_col))
    few = dropped.count() <= BROADCAST_KEYS
    drop = dropped.withColumnRenamed("key", name)
    kept = keyed.join(F.broadcast(drop) if few else drop, name, "left_anti")
    if not repeated.isEmpty():
        again = repeated.withColumnRenamed("key", name)
        once = kept.join(again, name, "left_semi").dropDuplicates([name])
        kept = kept.join(again, name, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def row_key_of(id_col: str, text_col: str):
    """The key of ``fingerprints``, computed from a table's own columns."""
    a, b = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return F.concat_ws("-", F.hex(F.xxhash64(a, b)), F.hex(F.xxhash64(F.lit("second"), b, a)))
