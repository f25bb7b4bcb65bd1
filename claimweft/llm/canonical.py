"""Problem 4: map freely typed values to the closest entry of a reference list.

A BK-tree over the entries' forms under the Levenshtein distance (a true metric) gives every entry within the threshold
of a value; the triangle inequality prunes the rest. Swapped neighbours are one slip of the keys but two edits, so the
tree is asked for twice the allowed edits, among forms whose length differs by no more than the allowed ones, and what it
gives is counted again with swaps as one. Forms are compared without regard to case, width, accents,
look-alike letters of other scripts, marks and spaces. A value is tried as typed, then without what stands around an
entry in such fields (lead-ins before a colon, bracketed or barred additions, words of ``dressing``), and with its words
rotated, as in "Ledger, The Example".

Cases: a null or blank value gives no row; a value within the threshold of no entry gives ref id 0; entries at the same
distance are decided for the lowest id and flagged as ambiguous; an empty reference list leaves all values unmatched;
null names and aliases are skipped; repeated rows are mapped alike; extra columns pass
through, and one with an output's name gives way to it.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.llm.columns import VALUE, carried, restored
from claimweft.session import cut_lineage

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = str.maketrans("абвгдезікмнопрстухьјѕԁӏαβεικνορτυχ", "a6brdeзikmhoпpctyxbjsdlabeikvoptux")
#: Words that stand around ratings and publisher names without being part of them.
DRESSING = frozenset(
    "verdict rating ruling our urteil bewertung conclusion this is check checks see full updated team via by www news redaktion online verified"
    " inc gmbh ev e v sl s l ltd llc sa bv srl".split()
)
MEMO = 200_000
_SPACE = re.compile(r"[\s_/\\.,;:!?*\"'“”„‘’«»()\[\]{}|<>+=~^@#®©™★☆❌✅✔✘×•·–—−-]+")
_SIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")


def repaired(word: str) -> str:
    """A word whose UTF-8 bytes were once read as a Western one-byte code, read rightly; any other word as it is."""
    try:
        return word.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return word


def plain(text: str) -> str:
    """Lower-case Latin skeleton of a string; words are divided by single spaces."""
    if "&" in text:
        text = html.unescape(text)
    if any(c in text for c in "ÃÂâ"):
        text = " ".join(map(repaired, text.split(" ")))
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(LOOK_ALIKE)
    return _SPACE.sub(" ", text).strip()


def forms(text: str, longest: int = 1 << 30) -> list[tuple[str, int]]:
    """What a value may mean, each with a cost: as typed first, then undressed. Words are rotated where the whole has up to
    ``longest`` letters; beyond the longest entry and its edits no rotation can match."""
    whole = plain(text)
    out = {whole.replace(" ", ""): 0}

    def add(words: list[str], cost: int) -> None:
        if words:
            out.setdefault("".join(words), cost)

    def undress(words: list[str]) -> None:
        a, b = 0, len(words)
        while a < b and words[a] in DRESSING:
            a += 1
        while b > a and words[b - 1] in DRESSING:
            b -= 1
        for part in (words, words[:b], words[a:], words[a:b]):
            add(part, 1)

    for variant in (text, _SIDE.sub(" ", text)):
        undress(plain(variant).split())
        for mark in ("|", "–", "—", " - "):
            for part in variant.split(mark) if mark in variant else ():
                undress(plain(part).split())
        if ":" in variant:
            undress(plain(variant.partition(":")[2]).split())
    words = whole.split()
    if sum(map(len, words)) <= longest:
        for k in range(1, len(words)):
            add(words[k:] + words[:k], 2)
    return [(f, c) for f, c in out.items() if f]


def distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors: one step of a few word operations for each letter of ``b``."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    n = len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score, top, full = (1 << n) - 1, 0, n, 1 << (n - 1), (1 << n) - 1
    for c in b:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 | 1, down << 1
        plus, minus = down & full | (full & ~(xv | up)), up & xv & full
    return score


def typing_distance(a: str, b: str) -> int:
    """Edits where swapped neighbours count once: at least half the Levenshtein distance, but no metric."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


class BKTree:
    """Nodes are [form, entries, children by distance, shortest and longest form of the subtree]."""

    def __init__(self, metric: Callable[[str, str], int] = distance):
        self.metric, self.root = metric, None

    def add(self, form: str, entry) -> None:
        n = len(form)
        if self.root is None:
            self.root = [form, {entry}, {}, n, n]
            return
        node = self.root
        while True:
            node[3], node[4] = min(node[3], n), max(node[4], n)
            d = self.metric(form, node[0])
            if d == 0:
                node[1].add(entry)
                return
            if d not in node[2]:
                node[2][d] = [form, {entry}, {}, n, n]
                return
            node = node[2][d]

    def within(self, form: str, threshold: int, slack: int | None = None) -> list[tuple[int, str, object]]:
        """Every (distance, form, entry) with a distance of at most ``threshold`` and lengths at most ``slack`` apart (by
        default ``threshold``, which leaves out nothing). The triangle inequality prunes children by distance; subtrees
        without a form of a fitting length aren't entered."""
        slack = threshold if slack is None else slack
        least, most = len(form) - slack, len(form) + slack
        out, stack = [], [self.root] if self.root else []
        while stack:
            name, entries, children, low, high = stack.pop()
            if low > most or high < least:
                continue
            d = self.metric(form, name)
            if d <= threshold and least <= len(name) <= most:
                out += [(d, name, e) for e in entries]
            for k in range(d - threshold, d + threshold + 1):
                if k in children:
                    stack.append(children[k])
        return out


def tolerance(form: str, share: float, most: int) -> int:
    """Edits allowed for a form: a share of its length, none for forms of up to two letters."""
    return min(most, int(len(form) * share + 0.5)) if len(form) > 2 else 0


class Mapper:
    """Entries are (ref id, names, codes): codes, such as short names, must agree exactly."""

    def __init__(self, entries: list[tuple[int, list[str], list[str]]], share: float, most: int):
        self.share, self.most = share, most
        self.tree, self.exact = BKTree(), {}
        for ref, names, codes in entries:
            for name in names:
                if name and plain(name):
                    self.exact.setdefault(plain(name).replace(" ", ""), set()).add(ref)
                    self.tree.add(plain(name).replace(" ", ""), ref)
            for code in codes:
                if code and plain(code):
                    self.exact.setdefault(plain(code).replace(" ", ""), set()).add(ref)
        self.longest = max(map(len, self.exact), default=0) + most
        self.memo: dict[str, tuple[int, int | None, bool, float]] = {}

    def best(self, value: str) -> tuple[int, int | None, bool, float]:
        """(ref id or 0, distance or null, whether another entry is as close, rank of the match: less is closer)."""
        got = self.memo.get(value)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[value] = self._best(value)
        return got

    def _best(self, value: str) -> tuple[int, int | None, bool, float]:
        tried = forms(value, self.longest)
        for form, cost in tried:
            if form in self.exact:
                refs = self.exact[form]
                return min(refs), 0, len(refs) > 1, cost / 8 - 1
        near: list[tuple[float, int, int]] = []
        for form, cost in tried:
            limit = tolerance(form, self.share, self.most)
            if limit:
                for d, name, e in self.tree.within(form, 2 * limit, limit):
                    d = typing_distance(form, name) if d > 1 else d
                    if d <= min(limit, tolerance(name, self.share, self.most)):
                        near.append((d + cost / 8, d, e))
        if not near:
            return 0, None, False, math.inf
        rank, d, ref = min(near, key=lambda x: (x[0], x[2]))
        return ref, d, len({e for r, _, e in near if r == rank}) > 1, rank


def map_to_canonical(
    df: DataFrame, value_col: str, reference: DataFrame, ref_id: str, names: list[str | Column], codes: list[str | Column] = (),
    share: float = 0.25, most: int = 3, ref_col: str = "ref_id", distance_col: str = "distance", ambiguous_col: str = "ambiguous",
    shard_entries: int = 50_000,
) -> DataFrame:
    """``df`` without null or blank values, plus ref id (0: none), edit distance and ambiguity.

    ``names`` and ``codes`` are string or array<string> columns of ``reference``. A list of up to ``shard_entries`` entries
    is one tree, sent to all executors, and the mapping is narrow. A longer list is cut into shards of that size: each
    distinct value meets one shard's tree at a time, the closest of the shards' winners is kept, and rows take it over by
    a join on the value. Values repeat, so each Python worker keeps a bounded memo of them.
    """
    def texts(columns) -> Column:
        arrays = []
        for c in columns:
            c = reference[c] if isinstance(c, str) else c
            kind = reference.select(c).schema[0].dataType
            arrays.append(F.coalesce(c, F.array().cast("array<string>")) if isinstance(kind, T.ArrayType) else F.array(c))
        return F.concat(*arrays) if arrays else F.array().cast("array<string>")

    listed = reference.select(F.col(ref_id).cast("int").alias("ref"), texts(names).alias("names"), texts(codes).alias("codes"))
    spark = df.sparkSession
    source, kept = carried(df, value_col, [ref_col, distance_col, ambiguous_col])
    source = source.filter(F.col(VALUE).rlike(r"(?U)[^\s\x{200b}\x{feff}]"))
    outputs = [T.StructField(ref_col, T.IntegerType()), T.StructField(distance_col, T.IntegerType()), T.StructField(ambiguous_col, T.BooleanType()), T.StructField("_rank", T.DoubleType())]

    def mapped(rows: DataFrame, entries: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(entries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mapper = Mapper(shared.value, share, most)
            for batch in batches:
                got = [mapper.best(v) for v in batch.column(VALUE).to_pylist()]
                kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([g[k] for g in got], t) for k, t in enumerate(kinds))], [*batch.schema.names, *(f.name for f in outputs)])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *outputs]))

    names_out = [f.name for f in kept] + [ref_col, distance_col, ambiguous_col]
    # The list comes to the driver shard by shard: one is held while the next is read, and each goes out before the next.
    shards = _shards(listed, shard_entries)
    first, second = next(shards, []), next(shards, None)
    if second is None:
        return restored(mapped(source, first).select(*names_out), kept)
    values = cut_lineage(source.select(VALUE).distinct())
    found = reduce(DataFrame.unionByName, (mapped(values, s) for s in chain((first, second), shards)))
    least = found.groupBy(VALUE).agg(F.min_by(F.struct(ref_col, distance_col, ambiguous_col), F.struct("_rank", ref_col)).alias("_best"))
    ranks = found.filter(F.col(distance_col).isNotNull()).groupBy(VALUE, "_rank").agg(F.count("*").alias("_same"))
    tied = ranks.groupBy(VALUE).agg(F.min_by("_same", "_rank").alias("_ties"))
    won = least.join(tied, VALUE, "left").select(VALUE, f"_best.{ref_col}", f"_best.{distance_col}", (F.col(f"_best.{ambiguous_col}") | (F.coalesce("_ties", F.lit(0)) > 1)).alias(ambiguous_col))
    return restored(source.join(won, VALUE).select(*names_out), kept)


def _shards(listed: DataFrame, size: int) -> Iterator[list[tuple]]:
    shard: list[tuple] = []
    for row in listed.toLocalIterator():
        shard.append((row["ref"], list(row["names"]), list(row["codes"])))
        if len(shard) == size:
            yield shard
            shard = []
    if shard:
        yield shard
