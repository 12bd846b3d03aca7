"""Chat formatting as a prefix tree.

Conversations that share their first turns are merged: a node of the tree is a turn, its path the turns before it.
Trees are emitted as sequences in depth-first order in which every shared turn's tokens stand once.  Each token has
the position it would have in its own conversation, so siblings start at the same position, and each node lists the
intervals of its ancestors in its sequence, which with its own tokens, and those of the node ``above`` its sequence,
are all it may attend to.

Tokens are the Unicode code points of the formatted text, kept as a string, so nothing is lost in reading them back.

The template marks turns: ``### Role: text</turn>`` and a line feed.  In roles and texts a backslash is put before
every backslash and every control string (``### `` and ``</turn>``) and in roles also before the colon, so that
removing single backslashes restores them and no text can end a turn or open one.  The loss mask covers the text
of assistant turns.

A node that more than ``limit`` conversations share (``TREE_SIZE``, or more where the texts of such nodes could
exceed ``HOT_BYTES``) is a sequence of its own, and what follows it begins new sequences that name it as the node
``above``.  So a sequence holds at most ``limit`` conversations, however many share a beginning, and a shared turn is
still stored once.  As each of those nodes stands more than ``limit`` times in the input, their texts take less than
``HOT_BYTES`` in all, which is what is broadcast.

Three passes: digests of the turns alone give how many conversations share each path; one shuffle of the texts by
conversation lays those that share nothing straight into files, turn by turn; only the others are dealt once more, by
sequence, in depth-first order.  Every task streams: it holds one path of a tree, never a whole conversation or tree.
Files are read back in the order in which they were written, without a shuffle.

Defined cases: a null text or role is empty; turns are ordered by number (null first), then role and text; rows with a
null id form one conversation; equal rows are turns of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, opened, published, shared_dir, to_batch, tune, written

TREE_SIZE = 200
HOT_BYTES = 32 << 20
#: Rows of a file's row group, and what its texts hold at most before it is written.
GROUP_ROWS, GROUP_CHARS = 4_000, 4 << 20
#: The template.
OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>"
#: Rows of the files: nodes in depth-first order; after a node, a row without tokens for each conversation that ends there.
NODE = "tree string, node int, parent int, above string, first long, last long, position long, loss_first long, loss_last long, ancestors array<long>, tokens string, conversation long"
_CONTROL, _ROLE = re.compile(r"\\|### |</turn>"), re.compile(r"\\|### |</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends."""
    head = _head(role)
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


@lru_cache(maxsize=256)
def _head(role: str) -> str:
    return OPEN + escape(_shown(role), True) + SEPARATOR


def _shown(role: str) -> str:
    """Common roles are shown with a capital; any other is shown as it is, after a mark."""
    return role.capitalize() if role in ("user", "assistant", "system") else "=" + role


def _read_role(shown: str) -> str:
    return shown[1:] if shown.startswith("=") else shown.lower()


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((_read_role(unescape(m[1])), unescape(m[2])))
        at = m.end()
    return out


def parse_turn(tokens: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if "\\" in tokens:
        (turn,) = parse(tokens)
        return turn
    head, found, body = tokens.partition(SEPARATOR)
    if not found or not head.startswith(OPEN) or not body.endswith(CLOSE + "\n"):
        raise ValueError("not a turn")
    return _read_role(head[len(OPEN) :]), body[: -len(CLOSE) - 1]


# Paths: the digest of a turn and all before it.


def _path(before: bytes, turn: bytes) -> bytes:
    return hashlib.md5(before + turn, usedforsecurity=False).digest()


def _rows(it: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    plain = rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return plain.withColumn("digest", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))))


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, path) of every turn, from digests; texts are moved only where number and role tie."""
    ties = written(turns.groupBy("conv_id", "turn", "role").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "chat-ties")
    keys = turns.select("conv_id", "turn", "role", "digest", F.lit("").alias("tie"))
    if not ties.isEmpty():
        names = ties.select(*[F.col(c).alias(f"_{c}") for c in ties.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ties.columns]
        keys = turns.join(names, same, "left").select("conv_id", "turn", "role", "digest", F.when(F.col("_role").isNotNull(), F.col("text")).alias("tie"))

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, depth, path = (), 0, b""
        for conv, digest in _rows(it, "conv_id", "digest"):
            if (conv,) != last:
                last, depth, path = (conv,), 0, b""
            path = _path(path, digest)
            yield conv, depth, path
            depth += 1

    return map_rows(keys.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie"), walk, "conv_id long, depth int, path binary")


def _shared_levels(turns: DataFrame) -> DataFrame:
    """(conv_id, sharers): for conversations that share their first turn, how many have each of the shared levels."""
    paths = written(_paths(turns), "chat-paths")
    shared = written(paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "chat-shared")
    levels = paths.join(shared, "path").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("levels"))
    return written(levels.select("conv_id", F.transform("levels", lambda x: x["n"]).alias("sharers")), "chat-levels")


# Sequences.


class Sequence:
    """Numbers the nodes of one sequence, which come in depth-first order."""

    def __init__(self, tree: str, above: str | None):
        self.tree, self.above, self.number, self.at = tree, above, 0, 0
        self.path: list[tuple[int, tuple]] = []  # number and intervals, by depth

    def node(self, depth: int, position: int, tokens: str, loss: tuple[int, int]) -> tuple:
        """The row of the next node, ``depth`` levels below the first."""
        del self.path[depth:]
        parent, spans = self.path[-1] if self.path else (-1, ())
        first, last = self.at, self.at + len(tokens)
        row = (self.tree, self.number, parent, self.above, first, last, position, first + loss[0], first + loss[1], [x for s in spans for x in s], tokens, None)
        joined = (*spans[:-1], (spans[-1][0], last)) if spans and spans[-1][1] == first else (*spans, (first, last))
        self.path.append((self.number, joined))
        self.number, self.at = self.number + 1, last
        return row

    def end(self, conversation: int | None) -> tuple:
        """A conversation ends at the node that came last."""
        return (self.tree, self.number - 1, None, None, None, None, None, None, None, None, None, conversation)


def _mask(role: str, start: int, end: int) -> tuple[int, int]:
    return (start, end) if role == "assistant" else (start, start)


def _file(path: str, rows: Iterator[tuple]) -> None:
    """Rows of ``NODE``, streamed to one file of the shared folder."""
    schema = arrow_schema(NODE)
    with published(path) as out, pq.ParquetWriter(out, schema, compression="zstd") as writer:
        held, chars = [], 0
        for row in rows:
            held.append(row)
            chars += len(row[10] or "")
            if len(held) >= GROUP_ROWS or chars >= GROUP_CHARS:
                writer.write_batch(to_batch(schema, held))
                held, chars = [], 0
        if held:
            writer.write_batch(to_batch(schema, held))


LAID = "kind string, tree string, above string, sort binary, depth int, path binary, position long, loss_first int, loss_last int, tokens string, ended boolean, conversation long"


def _lay(turns: DataFrame, levels: DataFrame, limit: int, folder: str) -> DataFrame:
    """Conversations that share nothing go to files below ``folder``; the turns of the others come back as rows of
    ``LAID``, kind ``hot`` for the nodes that are sequences of their own and ``turn`` for all below them."""
    known = levels.select("conv_id", F.lit(0).alias("kind"), "sharers", F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], F.lit(None).cast("binary").alias("digest"))
    told = turns.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("array<long>").alias("sharers"), "turn", "role", "text", "digest")
    dealt = known.unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")

    def lay(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Streams the conversations of a task; rows for its own file are told from the others by their kind."""
        seen: set[bytes] = set()  # hot nodes that this task has given out
        last, sharers, held, above = (), None, None, None
        depth, position, path, run, root, hot, own = 0, 0, b"", b"", None, None, None
        for conv, kind, some, role, text, digest in _rows(it, "conv_id", "kind", "sharers", "role", "text", "digest"):
            if (conv,) != last:
                if held is not None:
                    yield held[:-2] + (True, last[0])
                elif own is not None:
                    yield own.end(last[0])
                elif hot is not None:
                    yield ("end", hot.hex(), *[None] * 8, True, last[0])
                last, sharers, held, above = (conv,), None, None, None
                depth, position, path, run, root, hot, own = 0, 0, b"", b"", None, None, None
            if kind == 0:
                sharers = some
                continue
            path = _path(path, digest)
            tokens, a, b = formatted(role, text)
            a, b = _mask(role, a, b)
            if sharers is None:
                own = own or Sequence(path.hex(), None)
                yield own.node(depth, position, tokens, (a, b))
            elif (n := sharers[depth] if depth < len(sharers) else 1) > limit:
                if path not in seen:
                    seen.add(path)
                    yield "hot", path.hex(), hot and hot.hex(), None, depth, path, position, a, b, tokens, False, None
                hot = path
            else:
                if held is not None:
                    yield held
                if root is None:
                    root, above, run, start, many = path, hot and hot.hex(), path[:8], depth, n
                elif n != many:  # fewer share this turn than the one before: the tree branches here, or one ended
                    run, many = run + path[:8], n
                held = ("turn", root.hex(), above, run, depth - start, path, position, a, b, tokens, False, None)
            depth, position = depth + 1, position + len(tokens)
        if held is not None:
            yield held[:-2] + (True, last[0])
        elif own is not None:
            yield own.end(last[0])
        elif hot is not None:
            yield ("end", hot.hex(), *[None] * 8, True, last[0])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows, path = lay(it), f"{folder}/alone-{TaskContext.get().partitionId():06d}.parquet"
        moved: list[tuple] = []

        def mine() -> Iterator[tuple]:
            """Rows of the task's file until some others have gathered."""
            for row in rows:
                if row[0] in ("turn", "hot", "end"):
                    moved.append(row)
                    if len(moved) >= 500:
                        return
                else:
                    yield row

        part = 0
        while True:
            first = next(own := mine(), None)
            if first is not None:
                _file(path.replace(".parquet", f"-{part:05d}.parquet"), _after(first, own))
                yield ("file", path.replace(".parquet", f"-{part:05d}.parquet"), *[None] * 10)
                part += 1
            elif not moved:
                return
            yield from moved
            moved.clear()

    return map_rows(dealt, run, LAID, 500)


def _after(first: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rows


def _merge(laid: DataFrame, folder: str) -> DataFrame:
    """The files of the sequences that several conversations share: equal turns, which come together, are one node."""
    dealt = laid.filter("kind = 'turn'").repartition("tree").sortWithinPartitions("tree", "sort", "depth", "path")

    def merged(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, last = None, None
        for tree, above, depth, path, position, a, b, tokens, ended, conv in _rows(it, "tree", "above", "depth", "path", "position", "loss_first", "loss_last", "tokens", "ended", "conversation"):
            if now is None or tree != now.tree:
                now, last = Sequence(tree, above), None
            if path != last:
                yield now.node(depth, position, tokens, (a, b))
                last = path
            if ended:
                yield now.end(conv)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = merged(it)
        first = next(rows, None)
        if first is not None:
            path = f"{folder}/shared-{TaskContext.get().partitionId():06d}.parquet"
            _file(path, _after(first, rows))
            yield (path,)

    return map_rows(dealt, run, "file string")


@dataclass
class Trees:
    """What was written: ``files`` (file) with rows of ``NODE``; ``hot``, the nodes that are sequences of their own,
    likewise; ``ends`` (tree, conversation), the conversations that end at those."""

    files: DataFrame
    hot: DataFrame
    ends: DataFrame
    folder: str

    def nodes(self) -> DataFrame:
        """All nodes, in no order."""
        spark = self.files.sparkSession
        own = spark.read.schema(NODE).parquet(self.folder) if not self.files.isEmpty() else spark.createDataFrame([], NODE)
        return own.filter("tokens is not null").unionByName(self.hot).drop("conversation")


def trees(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Trees:
    """The prefix trees of all conversations, written to the shared folder."""
    spark = rows.sparkSession
    tune(spark)
    turns = _turns(rows, id_col, turn_col, role_col, text_col)
    levels = _shared_levels(turns)
    size = turns.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("role") + 24), F.lit(0))).first()[0]
    folder = shared_dir(spark, "chat-trees")
    laid = written(_lay(turns, levels, max(TREE_SIZE, -(-size // HOT_BYTES)), folder), "chat-laid", compression="zstd")
    merged = written(_merge(laid, folder), "chat-merged")
    files = merged.unionByName(laid.filter("kind = 'file'").select(F.col("tree").alias("file")))
    hot = laid.filter("kind = 'hot'").dropDuplicates(["tree"]).select(
        "tree", F.lit(0).alias("node"), F.lit(-1).alias("parent"), "above", F.lit(0).cast("long").alias("first"), F.length("tokens").cast("long").alias("last"), "position",
        F.col("loss_first").cast("long").alias("loss_first"), F.col("loss_last").cast("long").alias("loss_last"), F.array().cast("array<long>").alias("ancestors"), "tokens", "conversation",
    )
    return Trees(files, written(hot, "chat-hot"), laid.filter("kind = 'end'").select("tree", "conversation"), folder)


# Reading.


CONVERSATION = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Read:
    """What a conversation holds up to a node; each node extends a copy of its parent's."""

    __slots__ = ("chars", "learned", "loss", "said", "turns")

    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def after(self, tokens: str, a: int, b: int) -> Read:
        """With one more turn, whose loss mask covers tokens a to b."""
        new = Read.__new__(Read)
        role, body = parse_turn(tokens)
        learned = unescape(tokens[a:b])
        new.turns, new.chars, new.loss = self.turns + 1, self.chars + len(tokens), self.loss + len(learned)
        new.said, new.learned = self.said.copy(), self.learned
        new.said.update(f"{role}\n{body}\n".encode())
        if learned:
            new.learned = self.learned.copy()
            new.learned.update(learned.encode())
        return new

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


class Above:
    """The hot nodes by the name of their sequence, and what is read up to each."""

    def __init__(self, sent: Broadcast):
        self.sent, self.known = sent, {None: Read()}

    def __getitem__(self, tree: str | None) -> Read:
        todo = []
        while tree not in self.known:
            todo.append(tree)
            tree = self.sent.value[tree][0]
        for name in reversed(todo):
            above, position, a, b, tokens = self.sent.value[name]
            if self.known[above].chars != position:
                raise ValueError(f"the node {name} is not at position {position}")
            self.known[name] = self.known[above].after(tokens, a, b)
            tree = name
        return self.known[tree]


def _nodes(path: str) -> Iterator[tuple]:
    with opened(path) as f:
        yield from _rows(pq.ParquetFile(f).iter_batches(GROUP_ROWS), *arrow_schema(NODE).names)


def read_back(written_trees: Trees) -> DataFrame:
    """Per conversation, from what was written: what its tokens, ancestors and loss intervals hold."""
    files, hot = written_trees.files, written_trees.hot
    spark = files.sparkSession
    found = {r["tree"]: (r["above"], r["position"], r["loss_first"], r["loss_last"], r["tokens"]) for r in hot.toLocalIterator()}  # less than HOT_BYTES
    sent = spark.sparkContext.broadcast(found)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        above = Above(sent)
        for (path,) in _rows(it, "file"):
            now, levels = None, []  # of the present path: number, first, last, what is read
            for tree, node, parent, over, first, last, position, a, b, ancestors, tokens, conv in _nodes(path):
                if tokens is None:
                    yield conv, *levels[-1][3].row()
                    continue
                if tree != now:
                    now, levels, base = tree, [], above[over]
                while levels and levels[-1][0] != parent:
                    levels.pop()
                before = levels[-1][3] if levels else base
                seen = sum(ancestors[1::2]) - sum(ancestors[::2])
                if before.chars != position or base.chars + seen != position or last - first != len(tokens):
                    raise ValueError(f"node {node} of {tree} attends to other than {position} tokens")
                levels.append((node, first, last, before.after(tokens, a - first, b - first)))

    n = max(1, spark.sparkContext.defaultParallelism * 4)
    own = map_rows(files.repartition(n, "file"), read, CONVERSATION)

    def read_hot(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        above = Above(sent)
        for tree, conv in _rows(it, "tree", "conversation"):
            yield conv, *above[tree].row()

    return own.unionByName(map_rows(written_trees.ends, read_hot, CONVERSATION)) if found else own


def round_trip(rows: DataFrame, **options) -> DataFrame:
    return read_back(trees(rows, **options))
