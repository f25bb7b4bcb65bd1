"""Problem 5: cut oversized texts at natural boundaries, with an overlap between consecutive pieces.

Atomic segments (sentences within lines) are merged agglomeratively: all adjacent pairs wait in a heap and the pair with
the weakest boundary between it merges first, as long as the merged size plus the overlap fits.

Cases: a null, empty or blank text has no pieces; a text within the limit is one piece, whole; a run without any boundary
is cut by count; repeated rows are cut alike; extra columns pass through, and one with an output's name gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.llm.columns import VALUE, carried, restored

#: Boundary strengths, weakest first: inside a sentence (a forced cut), a sentence end, a line end, a blank line.
FORCED, SENTENCE, LINE, PARAGRAPH = range(4)
_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?…][\"'”’“‘»«›‹)\]}]*\Z")

PIECE = T.StructType([
    T.StructField("piece_no", T.IntegerType(), False),
    T.StructField("first_word", T.IntegerType(), False),
    T.StructField("n_words", T.IntegerType(), False),
    T.StructField("n_overlap", T.IntegerType(), False),
    T.StructField("boundary", T.IntegerType(), False),
    T.StructField("piece", T.StringType(), False),
])


def boundaries(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the words, and the strength of the boundary after each word but the last."""
    spans = [m.span() for m in _WORD.finditer(text)]
    after = []
    for (start, end), (following, _) in zip(spans, spans[1:]):
        lines = text.count("\n", end, following)
        if lines:
            after.append(PARAGRAPH if lines > 1 else LINE)
        else:
            after.append(SENTENCE if _END.search(text, max(start, end - 8), end) else FORCED)
    return spans, after


def longest_run(after: list[int]) -> int:
    """The most words that follow each other without a natural boundary."""
    longest = run = 1
    for strength in after:
        run = run + 1 if strength == FORCED else 1
        longest = max(longest, run)
    return longest


def merge_segments(after: list[int], limit: int, overlap: int) -> list[int]:
    """First words of the pieces of a text with ``len(after) + 1`` words."""
    total = len(after) + 1
    starts = [0]
    core = limit - overlap
    for i, strength in enumerate(after, 1):
        if strength != FORCED or i - starts[-1] >= (core if starts[-1] else limit):
            starts.append(i)
    n = len(starts)
    size = [b - a for a, b in zip(starts, [*starts[1:], total])]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    version = [0] * n

    def entry(i: int) -> tuple[int, int, int, int, int]:
        j = right[i]
        return after[starts[j] - 1], size[i] + size[j], i, version[i], version[j]

    heap = [entry(i) for i in range(n - 1)]
    heapify(heap)
    while heap:
        _, together, i, vi, vj = heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or version[i] != vi or version[j] != vj:
            continue
        if together + (overlap if starts[i] else 0) > limit:
            continue
        alive[j] = False
        size[i] = together
        version[i] += 1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            heappush(heap, entry(i))
        if left[i] >= 0:
            heappush(heap, entry(left[i]))
    return [starts[i] for i in range(n) if alive[i]]


def split_text(text: str | None, limit: int, overlap: int) -> tuple[int, list[dict]]:
    """The longest run without a boundary, and the pieces."""
    if not text:
        return 0, []
    spans, after = boundaries(text)
    if not spans:
        return 0, []
    if len(spans) <= limit:
        return longest_run(after), [{"piece_no": 1, "first_word": 0, "n_words": len(spans), "n_overlap": 0, "boundary": PARAGRAPH, "piece": text}]
    starts = merge_segments(after, limit, overlap)
    pieces, before = [], 0
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(spans)])):
        first = max(before, a - overlap) if k else 0
        pieces.append({
            "piece_no": k + 1, "first_word": first, "n_words": b - first, "n_overlap": a - first,
            "boundary": after[a - 1] if k else PARAGRAPH, "piece": text[spans[first][0]:spans[b - 1][1]],
        })
        before = first
    return longest_run(after), pieces


def split_oversized(
    df: DataFrame, text_col: str = "text", limit: int = 400, overlap: int = 40, pieces_col: str = "pieces", run_col: str = "longest_run",
) -> DataFrame:
    """``df`` without its text, plus ``pieces_col`` array<PIECE> and ``run_col`` int. One narrow Arrow stage.

    ``boundary`` of a piece is the strength of the cut before it. Each piece after the first starts with the last
    ``overlap`` words of the piece before it (all of them, where that piece is shorter).
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    source, kept = carried(df, text_col, [pieces_col, run_col], leave_out=text_col)
    piece = pa.struct([("piece_no", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("n_overlap", pa.int32()), ("boundary", pa.int32()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [split_text(t, limit, overlap) for t in batch.column(VALUE).to_pylist()]
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(piece))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), run_col, pieces_col])

    schema = T.StructType([*kept, T.StructField(run_col, T.IntegerType(), False), T.StructField(pieces_col, T.ArrayType(PIECE, False), False)])
    return restored(source.mapInArrow(run, schema), kept)


def oversized(df: DataFrame, text_col: str = "text", limit: int = 400) -> DataFrame:
    """Rows that can have more than ``limit`` words: that many words need twice as many characters, less one."""
    return df.filter(F.length(text_col) >= 2 * limit + 1)
