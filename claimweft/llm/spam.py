"""Problem 8: pages of repeated keywords, tags or links instead of sentences.

An n-gram model is trained on prose and gives each text two perplexities; both tails are abnormal.

* Over function words and word classes (trigrams): a content word's class says how many content words have followed each
  other without a function word. Lists of keywords, tags and links, with whatever marks between them, run on without one,
  which prose doesn't: their perplexity is abnormally high.
* Over content words (a cache model: a word is as likely as its share in the ``STRETCH`` content words around it): text
  that turns a few keywords over and over is abnormally predictable, though its classes may be those of prose: its
  perplexity is abnormally low.

Both bounds come from the prose. The first is judged for each segment (a sentence, or lines that follow each other
without an end mark), the second for each stretch; means of few words are drawn to those of prose, so that small pieces
need stronger signs and no length is left out. A page is a case where most of its words lie in abnormal pieces.

The model is fitted on all distinct rows of the tables of prose, in passes over them: function words, classes, trigram
counts, bounds. What reaches the driver are classes, their trigrams and a line for each length of a stretch, so its size
follows the number of classes, not of rows. Everything else is computed per text.

Cases: null, empty and blank texts are no case and give no row; a text of one very long line is one segment per sentence
end; repeated rows are scored alike; extra columns are ignored. Languages without samples have no function words and look
like lists: give samples of every language that the texts are in.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweft.session import cut_lineage

_PARTS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[^\w\s]|_+")
_LINK = re.compile(r"https?:|www\.|[\w-]+\.[a-z]{2,}/|href=", re.I)
_LETTERS = re.compile(r"[^\W_]+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NUMBER = re.compile(r"\d[\d.,:%]*\Z")
END, OPEN, BREAK = ".", "<open>", "\n"  # the marks that end a sentence, the end of a line without one, and what leads a segment
#: Whitespace tokens kept per Python worker.
MEMO = 300_000
#: Texts that are scored together.
SLICE = 512
#: Sums over prose are of values rounded to so much, a power of two, so that they are exact and don't depend on the order.
GRAIN = 2.0**-20
#: Least probability of a class: a single odd mark can't make a sentence odd.
FLOOR = 1e-4
#: Content words that follow each other without a function word are told apart up to this many.
RUN = 24
#: Classes that count in such a run.
RUNNING = ("<word>", "<name>", "<mixed>", "<number>")
#: Content words that are looked at together for the low side; the cache's weight; words that a new one is drawn from.
STRETCH, CACHE, VOCABULARY = 100, 0.9, 20_000
#: Classes and content words of prose that are added to every mean.
PRIOR, WORD_PRIOR = 8, 10
#: The bounds: standard deviations above the mean of the prose's segments, and the part of the prose's least word cost.
HIGH, LOW = 7.0, 0.9


def repaired(token: str) -> str:
    """A token whose UTF-8 bytes were once read as a Western one-byte code, read rightly; any other token as it is."""
    data = bytearray()
    for c in token:
        try:
            data += c.encode("cp1252")
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return token
            data.append(ord(c))
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return token


def classes_of(token: str, function_words: frozenset[str]) -> list[str]:
    """Word classes of a token without white space, its marks included; emphasis marks and symbols are left out."""
    if not token.isascii():
        token = unicodedata.normalize("NFC", repaired(token) if any(c in token for c in "ÃÂâ") else token)
    if _LINK.search(token):
        return ["<link>"] * max(1, len(_LETTERS.findall(token)))
    if len(token) > 1 and token[0] == "#" and token[1].isalpha():
        return ["<tag>"]
    out = []
    for part in _PARTS.findall(token):
        low = part.lower()
        if low in function_words:
            out.append(low)
        elif _NUMBER.match(part):
            out.append("<number>")
        elif part in "*_~`" or unicodedata.category(part[0]) in ("So", "Sk", "Co", "Cn", "Cf", "Cc", "Mn"):
            continue
        elif not part[0].isalnum():
            out.append({"!": ".", "?": ".", "…": ".", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": '"', "’": '"'}.get(part, part))
        elif any(c.isdigit() for c in part):
            out.append("<mixed>")
        else:
            out.append("<name>" if part[0].isupper() else "<word>")
    return out


def function_words_of(sentences: DataFrame, top: int = 45) -> frozenset[str]:
    """The words found in most sentences (lang, text) of each language; ties go to the first in the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                n.update((lang, w) for w in {w.lower() for w in _WORDS.findall(text)} if len(w) <= 6)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(n.values(), pa.int64())], ["lang", "word", "n"])

    counted = sentences.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, word string, n long")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    ranked = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter("n > 1").withColumn("rank", F.row_number().over(first))
    return frozenset(r[0] for r in ranked.filter(F.col("rank") <= top).select("word").collect())


def kinds_of(prose: DataFrame, function_words: frozenset[str]) -> list[str]:
    """All classes of the texts, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        kinds: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                new = set(text.split()) - seen
                kinds.update(c for token in new for c in classes_of(token, function_words))
                seen |= new
                if len(seen) > MEMO:
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(sorted(kinds), pa.string())], ["kind"])

    return sorted({r[0] for r in prose.mapInArrow(run, "kind string").distinct().collect()} | {END, OPEN, BREAK, *RUNNING})


class ProseModel:
    """Interpolated (Witten-Bell) trigrams over classes, as sorted keys and costs in numpy, and the bounds of both tails."""

    def __init__(self, function_words: frozenset[str], kinds: list[str]):
        self.function_words = function_words
        self.raw = {c: i + 1 for i, c in enumerate(kinds)}  # 0: a class that prose doesn't have
        self.running = np.array([False, *(c in RUNNING for c in kinds)])
        self.resets = np.array([False, *(c == BREAK or c in function_words for c in kinds)])
        self.size = (len(kinds) + 1) * (RUN + 1)
        self.learn(np.empty(0, np.int64), np.empty(0, np.int64))
        self.bound(np.empty((0, 5)))

    def learn(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Costs from how often each trigram occurs; ``keys`` are sorted."""
        total = max(1, int(n.sum()))
        one = np.bincount(keys % self.size, n, self.size)
        self.p1 = np.where(one > 0, one, 0.05) / total
        self.k2, at = np.unique(keys % self.size**2, return_inverse=True)
        two, before = np.bincount(at, n, len(self.k2)), self.k2 // self.size
        after, kinds_after = np.bincount(before, two, self.size), np.bincount(before, minlength=self.size)
        self.back2 = np.where(kinds_after > 0, kinds_after / np.maximum(1, after + kinds_after), 1.0)
        self.v2 = two / (after + kinds_after)[before]
        self.kb, at = np.unique(keys // self.size, return_inverse=True)
        pair, kinds_pair = np.bincount(at, n, len(self.kb)), np.bincount(at, minlength=len(self.kb))
        self.vb = kinds_pair / (pair + kinds_pair)
        self.k3, self.v3 = keys, n / (pair + kinds_pair)[at]
        self.mean = float((self.nats(keys) * n).sum() / total)

    def bound(self, sums: np.ndarray) -> None:
        """Both bounds from the lines of ``sums_of``, added up for each length."""
        length, n, total, squares, least = sums.T
        held = length > 0
        self.word_mean = -math.log((1 - CACHE) / VOCABULARY)
        if held.any():
            self.word_mean = float(total[held].sum() / (length * n)[held].sum())
        self.low = LOW * float(((least + WORD_PRIOR * self.word_mean) / (length + WORD_PRIOR))[held].min(initial=self.word_mean))
        self.high = self.mean
        if not held.all():
            mean, square = (float(x[~held].sum() / n[~held].sum()) for x in (total, squares))
            self.high = mean + HIGH * math.sqrt(max(0.0, square - mean * mean))

    def sums_of(self, pages: Pages) -> list[np.ndarray]:
        """The columns of ``SUMS``. Under length 0: the number of segments, the sums of their means and of the squares of
        these. Under each length of a stretch: the number of such stretches, the sum of their costs, and the least."""
        means, stretch = self.class_means(pages), np.bincount(pages.stretch, pages.word_costs())
        each = np.append(np.zeros(len(means), np.int64), np.bincount(pages.stretch))
        length, at, n = np.unique(each, return_inverse=True, return_counts=True)
        total, squares = (np.bincount(at, np.rint(x / GRAIN) * GRAIN, len(length)) for x in (np.append(means, stretch), np.append(means * means, np.zeros(len(stretch)))))
        least = np.full(len(length), np.inf)
        np.minimum.at(least, at, np.append(means, stretch))
        return [length, n, total, squares, least]

    def class_means(self, pages: Pages) -> np.ndarray:
        """Nats a class of each segment, drawn to those of prose."""
        return (pages.by_segment(self.costs(pages)) + PRIOR * self.mean) / (pages.by_segment(~pages.leads) + PRIOR)

    def stretch_means(self, pages: Pages) -> np.ndarray:
        """Nats a content word of each stretch, drawn to those of prose."""
        n = np.bincount(pages.stretch)
        return (np.bincount(pages.stretch, pages.word_costs()) + WORD_PRIOR * self.word_mean) / (n + WORD_PRIOR)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, at: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(at), default)
        slot = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[slot] == at, values[slot], default)

    def keys(self, pages: Pages) -> np.ndarray:
        """Each class with the two before it, as one number."""
        c = pages.ids
        a, b = np.append([0, 0], c)[:len(c)], np.append(0, c)[:len(c)]
        return (a * self.size + b) * self.size + c

    def nats(self, key: np.ndarray) -> np.ndarray:
        """Nats of a class after the two before it."""
        c, b, ab = key % self.size, key // self.size % self.size, key // self.size
        p2 = self._look(self.k2, self.v2, b * self.size + c, 0.0) + self.back2[b] * self.p1[c]
        p3 = self._look(self.k3, self.v3, key, 0.0) + self._look(self.kb, self.vb, ab, 1.0) * p2
        return -np.log(np.maximum(p3, FLOOR))

    def costs(self, pages: Pages) -> np.ndarray:
        """Nats per class; the two breaks that lead each segment cost nothing."""
        key, back = np.unique(self.keys(pages), return_inverse=True)
        return np.where(pages.leads, 0.0, self.nats(key)[back])


class Pages(NamedTuple):
    """Texts as the model reads them, one after the other.

    Of each class: its id, its segment, whether it is a break that leads a line or sentence. Of each segment: its text and
    words. Of each content word: its id, its segment, its stretch; ``first``: where each stretch begins among them, and
    ``around``: where the words begin that its own are compared with."""

    ids: np.ndarray
    segment: np.ndarray
    leads: np.ndarray
    text: np.ndarray
    words: np.ndarray
    content: np.ndarray
    content_segment: np.ndarray
    stretch: np.ndarray
    first: np.ndarray
    around: np.ndarray

    def by_segment(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.segment, values, len(self.words))

    def word_costs(self) -> np.ndarray:
        """Nats of each content word, by its share among the others of its stretch. The last stretch of a longer text is
        filled up with the words before it."""
        end = np.append(self.first[1:], len(self.content))
        n = end - self.around
        base = int(self.content.max(initial=0)) + 1
        member = np.repeat(np.arange(len(n)), n) * base + self.content[spans(self.around, n)]
        key, count = np.unique(member, return_counts=True)
        own = count[np.searchsorted(key, self.stretch * base + self.content)]
        return -np.log(CACHE * (own - 1) / np.maximum(1, n - 1)[self.stretch] + (1 - CACHE) / VOCABULARY)


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] ... start[0] + n[0] - 1, start[1] ..."""
    return np.repeat(start - np.append(0, n.cumsum()[:-1]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


class Reader:
    """A token's classes are looked up in a bounded memo."""

    def __init__(self, model: ProseModel):
        self.raw, self.running, self.resets, self.function_words = model.raw, model.running, model.resets, model.function_words
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.contents: dict[str, int] = {"": 0}
        self.classes: list[int] = []
        self.first, self.n, self.content, self.ends = ([] for _ in range(4))

    def _add(self, token: str) -> None:
        names = classes_of(token, self.function_words)
        content = names and names[0] in ("<word>", "<name>", "<mixed>") or "<word>" in names or "<name>" in names
        word = "".join(c for c in token.lower() if c.isalnum()) if content else ""
        self.at[token] = len(self.at)
        self.first.append(len(self.classes))
        self.classes += [self.raw.get(c, 0) for c in names]
        self.n.append(len(names))
        self.content.append(self.contents.setdefault(word, len(self.contents)))
        self.ends.append(bool(names) and (names[-1] == END or len(names) > 1 and names[-1] in "\")]" and names[-2] == END))

    def pages(self, texts: list[str]) -> Pages:
        if len(self.at) > MEMO:
            self._forget()
        tokens: list[str] = []
        per_line, lines = [], []
        for text in texts:
            before = len(per_line)
            for line in text.split("\n"):
                part = line.split()
                if part:
                    tokens += part
                    per_line.append(len(part))
            lines.append(len(per_line) - before)
        for token in set(tokens).difference(self.at):
            self._add(token)
        token = np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))
        per_line = np.array(per_line, np.int64)
        text = np.repeat(np.repeat(np.arange(len(texts)), lines), per_line)
        ends, n = np.array(self.ends, bool)[token], np.array(self.n, np.int64)[token]
        closes = ends.copy()
        closes[per_line.cumsum() - 1] = True
        opens = np.append(True, closes[:-1])[:len(token)]
        # A piece is a sentence or the rest of a line; lines without an end mark that follow each other are one segment.
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes)
        starts_line = np.zeros(len(token), bool)
        starts_line[per_line.cumsum() - per_line] = True
        bare = starts_line[begin] & ~ends[end]
        same = np.append(False, text[begin][1:] == text[begin][:-1])[:len(begin)]
        joins = bare & np.append(False, bare[:-1])[:len(bare)] & same
        segment = np.repeat((~joins).cumsum() - 1, end - begin + 1)
        # The classes, with two breaks before each piece and a mark at an open end.
        lead, last = 2 * opens, closes & ~ends
        size = lead + n + last
        first = size.cumsum() - size
        ids = np.full(size.sum(), self.raw[BREAK])
        ids[spans(first + lead, n)] = np.array(self.classes, np.int64)[spans(np.array(self.first, np.int64)[token], n)]
        ids[(first + size - 1)[last]] = self.raw[OPEN]
        leads = np.zeros(len(ids), bool)
        leads[spans(first[opens], np.full(opens.sum(), 2))] = True
        running = self.running[ids]
        so_far = running.cumsum()
        run = np.minimum(so_far - np.maximum.accumulate(np.where(self.resets[ids], so_far, 0)), RUN)
        # Content words and their stretches, which begin anew with each text.
        content = np.array(self.content, np.int64)[token]
        held = content > 0
        per_text = np.bincount(text[held], minlength=len(texts))
        stretches = -(-per_text // STRETCH)
        of_text = np.repeat(np.arange(len(texts)), stretches)
        text_first = per_text.cumsum() - per_text
        number = np.arange(stretches.sum()) - np.repeat(stretches.cumsum() - stretches, stretches)
        s_first = text_first[of_text] + number * STRETCH
        s_end = np.minimum(s_first + STRETCH, (text_first + per_text)[of_text])
        return Pages(
            ids * (RUN + 1) + np.where(running, run, 0), np.repeat(segment, size), leads,
            text[begin][~joins], np.bincount(segment) if len(segment) else segment,
            content[held], segment[held], np.repeat(np.arange(len(s_first)), s_end - s_first), s_first, np.maximum(text_first[of_text], s_end - STRETCH),
        )


OUT = {"n_words": pa.int32(), "odd_share": pa.float64(), "high_share": pa.float64(), "low_share": pa.float64(), "nats": pa.float64(), "word_nats": pa.float64()}


class Scorer:
    def __init__(self, model: ProseModel):
        self.model, self.reader = model, Reader(model)

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        """The columns of ``OUT``: words, shares of words in abnormal segments, on either side and at all, nats per class
        and per content word."""
        model, pages = self.model, self.reader.pages(texts)
        m = len(texts)

        def share(odd: np.ndarray) -> np.ndarray:
            return np.bincount(pages.text, pages.words * odd, m) / np.maximum(1, n)

        n = np.bincount(pages.text, pages.words, m).astype(np.int64)
        high, low = model.class_means(pages) > model.high, np.zeros(len(pages.words), bool)
        word_nats = np.full(m, model.word_mean)
        if len(pages.content):
            flat = (model.stretch_means(pages) < model.low)[pages.stretch]
            per_segment = np.bincount(pages.content_segment, minlength=len(low))
            low = 2 * np.bincount(pages.content_segment, flat, len(low)) > per_segment
            of_text = pages.text[pages.content_segment]
            held = np.bincount(of_text, minlength=m)
            word_nats = np.where(held, np.bincount(of_text, pages.word_costs(), m) / np.maximum(1, held), word_nats)
        of_class = pages.text[pages.segment]
        nats = np.bincount(of_class, model.costs(pages), m) / np.maximum(1, np.bincount(of_class, ~pages.leads, m))
        return [n, share(high | low), share(high), share(low), nats, word_nats]


SUMS = {"length": pa.int64(), "n": pa.int64(), "total": pa.float64(), "squares": pa.float64(), "least": pa.float64()}


def over_prose(prose: DataFrame, model: ProseModel, of: Callable[[ProseModel, Pages], list[np.ndarray]], columns: dict[str, pa.DataType]) -> DataFrame:
    """What ``of`` gives for each slice of texts, as rows of ``columns``."""
    shared = prose.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in (big.slice(a, SLICE) for big in batches for a in range(0, big.num_rows, SLICE)):
            values = of(shared.value, reader.pages(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(values, columns.values())], list(columns))

    return prose.mapInArrow(run, ", ".join(f"{name} {'long' if kind == pa.int64() else 'double'}" for name, kind in columns.items()))


def trigrams_of(model: ProseModel, pages: Pages) -> list[np.ndarray]:
    return list(np.unique(model.keys(pages)[~pages.leads], return_counts=True))


def fit_prose_model(samples: DataFrame, passages: DataFrame | None = None, sentences: DataFrame | None = None) -> ProseModel:
    """``samples``: lang, text of right-labelled sentences; ``passages``: text whose first line is an instruction;
    ``sentences``: text of further prose. All rows of each are used, repeated ones once."""
    rows = samples.select("lang", "text").filter("text is not null").distinct()
    prose = rows.select("text")
    if passages is not None:
        whole = passages.select("text").filter("text is not null").distinct()
        prose = prose.unionByName(whole.select(F.expr(r"substr(text, length(substring_index(text, '\n', 1)) + 2)").alias("text")))
    if sentences is not None:
        prose = prose.unionByName(sentences.select("text").filter("text is not null").distinct())
    prose = cut_lineage(prose)  # read three times below
    function_words = function_words_of(rows)
    model = ProseModel(function_words, kinds_of(prose, function_words))
    counted = over_prose(prose, model, trigrams_of, {"key": pa.int64(), "n": pa.int64()}).groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    model.learn(counted.column("key").to_numpy(), counted.column("n").to_numpy())
    sums = over_prose(prose, model, ProseModel.sums_of, SUMS).groupBy("length").agg(F.sum("n"), F.sum("total"), F.sum("squares"), F.min("least"))
    model.bound(np.array([list(r) for r in sums.orderBy("length").collect()], float).reshape(-1, len(SUMS)))
    return model


def find_stuffed(docs: DataFrame, model: ProseModel, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every text with a word: doc_id, n_words, the share of words in abnormal pieces (odd_share) and on either
    side (high_share, low_share), nats per class and per content word. Narrow, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    id_type = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in (big.slice(a, SLICE) for big in batches for a in range(0, big.num_rows, SLICE)):
            columns = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(columns, OUT.values()))], ["doc_id", *OUT])

    outputs = ", ".join(f"{name} {'int' if kind == pa.int32() else 'double'}" for name, kind in OUT.items())
    return source.mapInArrow(run, f"doc_id {id_type}, {outputs}").filter(F.col("n_words") > 0)
