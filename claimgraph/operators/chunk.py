"""Cutting a text into overlapping spans that can be cited: text[start:end] is the chunk."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILL = 0.5
_BLANK_LINE = re.compile(r"\n[ \t]*\n")


@dataclass(frozen=True)
class Cut:
    size: int = 1200
    overlap: int = 150

    def __post_init__(self):
        if self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError("a chunk needs a size of at least 1 and an overlap from 0 to below its size")


class Spans:
    """The spans of one text."""

    def __init__(self, text: str, cut: Cut):
        self.text, self.cut = text, cut

    def __iter__(self) -> Iterator[tuple[int, int]]:
        text, n = self.text, len(self.text)
        start = self._past_space(0)
        while start < n:
            end = n if n - start <= self.cut.size else self._end(start)
            stop = end
            while stop > start and text[stop - 1].isspace():
                stop -= 1
            if stop > start:
                yield start, stop
            if end >= n:
                return
            start = self._word(max(end - self.cut.overlap, start + 1))

    def _past_space(self, i: int) -> int:
        while i < len(self.text) and self.text[i].isspace():
            i += 1
        return i

    def _past_word(self, i: int) -> int:
        while i < len(self.text) and not self.text[i].isspace():
            i += 1
        return i

    def _word(self, i: int) -> int:
        """The first word that begins at or after i; from inside a word, the next one."""
        inside = i > 0 and i < len(self.text) and not self.text[i].isspace() and not self.text[i - 1].isspace()
        return self._past_space(self._past_word(i) if inside else i)

    def _end(self, start: int) -> int:
        """Where a full chunk ends: a blank line, else a line, else a word, else the end of an overlong word."""
        limit, floor = start + self.cut.size, start + int(self.cut.size * FILL)
        blank = max((m.start() for m in _BLANK_LINE.finditer(self.text, start, min(len(self.text), limit + self.cut.size)) if m.start() <= limit), default=-1)
        if blank > start and blank >= floor:
            return blank
        line = self.text.rfind("\n", floor, limit)
        if line > start:
            return line
        for i in range(limit, start, -1):
            if i == len(self.text) or self.text[i].isspace() or self.text[i - 1].isspace():
                return i
        return self._past_word(limit)


def chunks(rows: DataFrame, *, id_col: str = "source_id", text_col: str = "raw_content", cut: Cut = Cut()) -> DataFrame:  # noqa: B008
    """(id, index, start, end, text): the chunks of every row's text; offsets count code points."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(i, k, a, b, text[a:b]) for k, (a, b) in enumerate(Spans(text or "", cut))]
            ids = pa.array([x[0] for x in out], batch.column(0).type)
            numbers = [pa.array([x[k] for x in out], pa.int32()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array([x[4] for x in out], pa.string())], names=[id_col, "index", "start", "end", "text"])

    return rows.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, index int, start int, end int, text string")


def batches(rows: DataFrame, *, id_col: str = "source_id", text_col: str = "raw_content", most: int = 200_000) -> DataFrame:
    """The same for extraction: a text within the ceiling whole, a longer one in large chunks."""
    return chunks(rows, id_col=id_col, text_col=text_col, cut=Cut(most, min(2000, most // 20)))
