"""Problem 3: keep only the article of each page.

A page is a sequence of leaves, one for each line of its markdown. A leaf is read as a tag path (what the markup and the
shape of the line say) and a vector of hashed words; a bidirectional LSTM in numpy reads the whole sequence and labels
every leaf with the context of its document. Lines of the plain text are the same leaves without markup, in the same
order, and take over their labels; plain lines that match no leaf are labelled from a reading of the text itself.

Cases: null and empty fields have no lines; blank lines are never reported; a page of one line and a page of many thousand
lines are read alike (long sequences in overlapping windows); repeated pages are labelled alike; null markdown falls back
to the text alone; extra columns are ignored, or pass through ``article_text``, where one named like its output gives way.
"""

from __future__ import annotations

import io
import math
import pkgutil
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.llm.columns import VALUE, carried, restored

BLANK, ARTICLE, FURNITURE = -1, 0, 1
BUCKETS, WORD_DIM, HIDDEN = 8192, 16, 28
#: Leaves of one reading, and the overlap of consecutive readings of a longer page.
WINDOW, OVERLAP = 192, 32
#: Lines whose vectors are kept per Python worker.
MEMO = 100_000

_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_MARK = re.compile(r"^\s*(?:#{1,6}|>+)\s+")
_ITEM = re.compile(r"^(?:[-*+•]|\d+[.)])\s+")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_UPPER, _DIGIT, _MARKS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"\d"), re.compile(r"[|/·»›>–•]")
_STOP = re.compile(r"[.!?…][”»“\"’)]*(?:\s|\Z)")


def plain_line(line: str, squeeze: bool = True) -> str:
    """A line of markdown as the text field has it: link labels kept, marks of headings, quotes and emphasis dropped."""
    if "[" in line:
        line = _LINK.sub(r"\1", _IMAGE.sub(" ", line))
    if line[:1] in "#> \t":
        line = _MARK.sub("", line)
    if "*" in line or "_" in line or "~" in line or "`" in line:
        for c in "*_~`":
            line = line.replace(c, "")
    return " ".join(line.split()) if squeeze else line.strip()


def bare_line(line: str, squeeze: bool = True) -> str:
    """A plain line without the mark of a list item."""
    return _ITEM.sub("", plain_line(_ITEM.sub("", line.strip()), squeeze))


def tag_path(line: str) -> list[float]:
    """What markup and shape say about a line, without its neighbours."""
    s = line.strip()
    heading = len(s) - len(s.lstrip("#")) if s.startswith("#") else 0
    item = _ITEM.match(s)
    rest = s[item.end():] if item else s
    links = _LINK.findall(s) if "](" in s else []
    linked = sum(map(len, links))
    text = plain_line(s)
    n = len(text.split())
    stops = len(_STOP.findall(text))
    size = max(1, len(text))
    upper = len(_UPPER.findall(text)) / size
    digits = len(_DIGIT.findall(text)) / size
    marks = len(_MARKS.findall(text))
    return [
        heading == 1, heading == 2, heading > 2, bool(item) and s[0] in "-+•", bool(item) and s[0] == "*", bool(item) and s[0].isdigit(),
        bool(links), bool(links) and linked >= 0.9 * len(plain_line(rest)), len(links) > 1, s.startswith("!["), s.startswith("**") and s.endswith("**"),
        s.startswith(">"), s.startswith("+++"), bool(stops) and bool(_STOP.search(text[-4:])), stops == 0, stops == 1, stops > 1, min(n, 40) / 20,
        n <= 1, n <= 3, n <= 8, n > 25, upper > 0.6, upper, digits, marks > 0, min(marks, 8) / 4, "©" in s, s.endswith(":"), ":" in s[:60],
        "   " in s, s[:1] in "“„«\"‘", "?" in text, text[:1].islower(),
    ]


TAGS = len(tag_path("x"))
AROUND = 8
#: First words of a line that are also read for themselves ("Read also: ...").
LEAD = 3
INPUT = 2 * WORD_DIM + TAGS + AROUND


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Reader:
    """Turns pages into leaves: hashed words, tag paths and positions. Lines repeat, so their vectors are kept for a while."""

    def __init__(self):
        self.memo: dict[str, tuple[np.ndarray, list[float]]] = {}
        self.slots: dict[str, int] = {}

    def slot(self, word: str) -> int:
        got = self.slots.get(word)
        if got is None:
            if len(self.slots) > 4 * MEMO:
                self.slots.clear()
            got = self.slots[word] = zlib.crc32((word if word.isalpha() else "0" * len(word)).encode()) % BUCKETS
        return got

    def line(self, line: str) -> tuple[np.ndarray, list[float]]:
        got = self.memo.get(line)
        if got is None:
            words = _WORD.findall(plain_line(line).lower())
            got = np.array([self.slot(w) for w in words], np.int32), tag_path(line)
            if len(line) < 200:
                if len(self.memo) > MEMO:
                    self.memo.clear()
                self.memo[line] = got
        return got

    def page(self, text: str) -> tuple[list[int], list[np.ndarray], np.ndarray]:
        """Numbers of the lines that aren't blank (from 0), their words and the rest of their input."""
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if x and not x.isspace()]
        rows = [self.line(lines[i]) for i in at]
        n = len(at)
        if not n:
            return [], [], np.empty((0, TAGS + AROUND), np.float32)
        tags = np.array([r[1] for r in rows], np.float32)
        number = np.array(at)
        place = np.arange(n)
        near = np.diff(number) == 1
        around = np.stack([
            place == 0, place == n - 1, place / max(1, n - 1), np.minimum(place, 20) / 20, np.minimum(n - 1 - place, 20) / 20,
            np.append(False, near), np.append(near, False), np.full(n, min(n, 60) / 60),
        ], 1).astype(np.float32)
        return at, [r[0] for r in rows], np.concatenate([tags, around], 1)


class BlockLabeller:
    """Weights: word table, forward and backward LSTM, output layer."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    @classmethod
    def shipped(cls) -> BlockLabeller:
        with np.load(io.BytesIO(pkgutil.get_data("claimweft.llm", "blocks.npz"))) as stored:
            return cls(dict(stored))

    @classmethod
    def load(cls, path: str) -> BlockLabeller:
        with np.load(path) as stored:
            return cls(dict(stored))

    def inputs(self, words: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
        size = np.array([len(w) for w in words])
        sums, leads = np.zeros((len(words), WORD_DIM), np.float32), np.zeros((len(words), WORD_DIM), np.float32)
        full = np.flatnonzero(size)
        if len(full):
            flat = self.w["table"][np.concatenate([words[i] for i in full])]
            starts = np.append(0, size[full].cumsum()[:-1])
            sums[full] = np.add.reduceat(flat, starts, 0) / np.sqrt(size[full])[:, None]
            for k in range(LEAD):
                longer = size[full] > k
                leads[full[longer]] += flat[starts[longer] + k]
        return np.concatenate([sums, leads, rest], 1)

    def _run(self, x: np.ndarray, way: str, keep: bool = False):
        """x: time, batch, input, already in reading order."""
        wx, wh, b = self.w[f"wx_{way}"], self.w[f"wh_{way}"], self.w[f"b_{way}"]
        steps, batch = x.shape[:2]
        pre = x.reshape(-1, x.shape[2]) @ wx
        pre = pre.reshape(steps, batch, -1) + b
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        hs, kept = np.empty((steps, batch, HIDDEN), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ wh
            gates = sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                kept.append((i, f, o, g, before, tc, h))
            h = o * tc
            hs[t] = h
        return hs, kept

    @staticmethod
    def _turned(x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Each sequence reversed within its own length; padding stays behind it."""
        at = np.arange(x.shape[0])[:, None]
        source = np.where(at < length, length - 1 - at, at)
        return np.take_along_axis(x, source[:, :, None], 0)

    def scores(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of furniture for every leaf of every sequence. Sequences of similar length share a batch."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
        begin = 0
        while begin < len(order):
            end = begin + 1
            shortest = len(sequences[order[begin]])
            while end < len(order) and end - begin < 256 and len(sequences[order[end]]) <= shortest * 1.25 + 4:
                end += 1
            group = order[begin:end]
            length = np.array([len(sequences[i]) for i in group])
            x = np.zeros((length.max(), len(group), INPUT), np.float32)
            for k, i in enumerate(group):
                x[:length[k], k] = sequences[i]
            ahead = self._run(x, "f")[0]
            back = self._turned(self._run(self._turned(x, length), "b")[0], length)
            z = np.concatenate([ahead, back, x], 2) @ self.w["wo"] + self.w["bo"]
            p = sigmoid(z[:, :, 0])
            for k, i in enumerate(group):
                out[i] = p[:length[k], k]
            begin = end
        return out

    def pages(self, reader: Reader, texts: list[str | None]) -> list[tuple[list[int], np.ndarray]]:
        """Per page: numbers of its lines that aren't blank, and their probabilities of being furniture."""
        read = [reader.page(t or "") for t in texts]
        sizes = [len(r[0]) for r in read]
        words = [w for r in read for w in r[1]]
        if not words:
            return [(r[0], np.empty(0, np.float32)) for r in read]
        x = self.inputs(words, np.concatenate([r[2] for r in read if len(r[0])]))
        parts, where, first = [], [], 0
        for page, n in enumerate(sizes):
            for a in range(0, max(1, n - OVERLAP), WINDOW - OVERLAP) if n > WINDOW else (0,) if n else ():
                parts.append(x[first + a:first + min(n, a + WINDOW)])
                where.append((page, a))
            first += n
        result = [np.zeros(n, np.float32) for n in sizes]
        for (page, a), p in zip(where, self.scores(parts)):
            skip = OVERLAP // 2 if a else 0
            result[page][a + skip:a + len(p)] = p[skip:]
        return [(r[0], p) for r, p in zip(read, result)]


def handed_down(markdown: str, at: list[int], furniture: np.ndarray, text: str) -> list[tuple[int, float | None]]:
    """For each line of the text that isn't blank, its number and the label of the leaf it came from, or none."""
    lines = markdown.split("\n")
    places: dict[str, list[int]] = {}
    for k, i in enumerate(at):
        places.setdefault(" ".join(plain_line(lines[i]).split()), []).append(k)
    out, j = [], 0
    for number, line in enumerate(text.split("\n")):
        if not line or line.isspace():
            continue
        want = " ".join(line.replace("*", "").replace("_", "").replace("~", "").replace("`", "").split())
        own = places.get(want, ())
        n = bisect_left(own, j) if own else 0
        if n < len(own):
            out.append((number, float(furniture[own[n]])))
            j = own[n] + 1
        else:
            out.append((number, None))
    return out


def label_batch(model: BlockLabeller, reader: Reader, markdown: list[str | None], text: list[str | None]) -> tuple[list, list]:
    """Per page the (line number from 0, probability) of the markdown and of the text."""
    from_markdown = model.pages(reader, markdown)
    texts: list[list] = []
    again = []
    for k, ((at, p), m, t) in enumerate(zip(from_markdown, markdown, text)):
        rows = handed_down(m or "", at, p, t or "")
        if any(r[1] is None for r in rows):
            again.append(k)
        texts.append(rows)
    for k, (at, p) in zip(again, model.pages(reader, [text[k] for k in again])):
        own = dict(zip(at, p.tolist()))
        texts[k] = [(n, own.get(n, 0.0) if q is None else q) for n, q in texts[k]]
    return [list(zip(at, p.tolist())) for at, p in from_markdown], texts


def find_furniture(
    pages: DataFrame, page_id: str = "page_id", markdown_col: str = "markdown", text_col: str = "text", threshold: float = 0.5,
) -> DataFrame:
    """One row (page_id, text_lines, markdown_lines) a page: the numbers, from 1, of the lines that aren't the article."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(markdown_col).alias("markdown"), F.col(text_col).alias("text"))
    numbers = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([source.schema["page_id"], T.StructField("text_lines", numbers, False), T.StructField("markdown_lines", numbers, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = BlockLabeller.shipped(), Reader()
        for big in batches:
            for begin in range(0, big.num_rows, 512):
                batch = big.slice(begin, 512)
                marked, plain = label_batch(model, reader, batch.column("markdown").to_pylist(), batch.column("text").to_pylist())
                lists = [pa.array([[n + 1 for n, p in rows if p > threshold] for rows in part], pa.list_(pa.int32())) for part in (plain, marked)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), *lists], ["page_id", "text_lines", "markdown_lines"])

    return source.mapInArrow(run, schema)


def article_text(pages: DataFrame, text_col: str = "text", out_col: str = "article", markdown_col: str = "markdown") -> DataFrame:
    """``pages`` with the article's lines alone in ``out_col``; other columns pass through."""
    source, kept_fields = carried(pages.withColumn(VALUE, F.struct(F.col(f"`{markdown_col}`").alias("m"), F.col(f"`{text_col}`").alias("t"))), VALUE, [out_col], leave_out=VALUE)
    schema = T.StructType([*kept_fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = BlockLabeller.shipped(), Reader()
        for big in batches:
            for begin in range(0, big.num_rows, 512):
                batch = big.slice(begin, 512)
                pair = batch.column(VALUE)
                texts = pair.field("t").to_pylist()
                plain = label_batch(model, reader, pair.field("m").to_pylist(), texts)[1]
                kept = []
                for t, rows in zip(texts, plain):
                    lines = (t or "").split("\n")
                    kept.append(None if t is None else "\n".join(lines[n] for n, p in rows if p <= 0.5))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.string())], [*(f.name for f in kept_fields), out_col])

    return restored(source.mapInArrow(run, schema), kept_fields)


def fit(pages: list[tuple[str, list[int]]], epochs: int = 10, batch: int = 48, rate: float = 4e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights from (text, label of each line) by backpropagation through time with Adam; weak labels are smoothed a little."""
    rng = np.random.default_rng(seed)
    reader = Reader()

    def init(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)

    w = {"table": 0.3 * rng.standard_normal((BUCKETS, WORD_DIM)).astype(np.float32), "wo": init(2 * HIDDEN + INPUT, 1), "bo": np.zeros(1, np.float32)}
    for way in "fb":
        w |= {f"wx_{way}": init(INPUT, 4 * HIDDEN), f"wh_{way}": init(HIDDEN, 4 * HIDDEN), f"b_{way}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"b_{way}"][HIDDEN:2 * HIDDEN] = 1
    model = BlockLabeller(w)
    w = model.w
    read = []
    for text, labels in pages:
        at, words, rest = reader.page(text)
        for a in range(0, len(at), 96):
            read.append((words[a:a + 96], rest[a:a + 96], np.array([labels[i] for i in at[a:a + 96]], np.float32)))
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(read))
        order = np.concatenate([s[np.argsort([len(read[i][0]) for i in s])] for s in np.array_split(order, max(1, len(order) // (batch * 16)))])
        groups = [order[a:a + batch] for a in range(0, len(order), batch)]
        total = leaves = 0.0
        for g in rng.permutation(len(groups)):
            items = [read[i] for i in groups[g]]
            length = np.array([len(i[0]) for i in items])
            steps = length.max()
            x = np.zeros((steps, len(items), INPUT), np.float32)
            y = np.zeros((steps, len(items)), np.float32)
            for k, (words, rest, label) in enumerate(items):
                x[:length[k], k], y[:length[k], k] = model.inputs(words, rest), label
            real = np.arange(steps)[:, None] < length
            turned = model._turned(x, length)
            ahead, kept_f = model._run(x, "f", True)
            raw, kept_b = model._run(turned, "b", True)
            both = np.concatenate([ahead, model._turned(raw, length), x], 2)
            p = sigmoid((both @ w["wo"] + w["bo"])[:, :, 0])
            goal = y * 0.98 + 0.01
            total -= float((np.log(np.where(y > 0, p, 1 - p) + 1e-9) * real).sum())
            leaves += real.sum()
            dz = ((p - goal) * real / real.sum())[:, :, None].astype(np.float32)
            grad = {"wo": both.reshape(-1, both.shape[2]).T @ dz.reshape(-1, 1), "bo": dz.sum((0, 1))}
            dboth = dz @ w["wo"].T
            dx = dboth[:, :, 2 * HIDDEN:].copy()
            for way, kept, seen, dh_all in (("f", kept_f, x, dboth[:, :, :HIDDEN]), ("b", kept_b, turned, model._turned(dboth[:, :, HIDDEN:2 * HIDDEN], length))):
                dpre = np.empty((steps, len(items), 4 * HIDDEN), np.float32)
                dh, dc = np.zeros((len(items), HIDDEN), np.float32), np.zeros((len(items), HIDDEN), np.float32)
                gh = np.zeros_like(w[f"wh_{way}"])
                for t in range(steps - 1, -1, -1):
                    i, f, o, c_in, before, tc, h_before = kept[t]
                    d = dh_all[t] + dh
                    dc = dc + d * o * (1 - tc * tc)
                    dpre[t] = np.concatenate([dc * c_in * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - c_in * c_in)], 1)
                    gh += h_before.T @ dpre[t]
                    dh, dc = dpre[t] @ w[f"wh_{way}"].T, dc * f
                grad |= {f"wh_{way}": gh, f"wx_{way}": seen.reshape(-1, INPUT).T @ dpre.reshape(-1, 4 * HIDDEN), f"b_{way}": dpre.sum((0, 1))}
                part = dpre @ w[f"wx_{way}"].T
                dx += part if way == "f" else model._turned(part, length)
            table = np.zeros_like(w["table"])
            for k, (words, _, _) in enumerate(items):
                for t, slots in enumerate(words):
                    if len(slots):
                        np.add.at(table, slots, dx[t, k, :WORD_DIM] / math.sqrt(len(slots)))
                        np.add.at(table, slots[:LEAD], dx[t, k, WORD_DIM:2 * WORD_DIM])
            grad["table"] = table
            step += 1
            for k, value in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * value
                second[k] = 0.999 * second[k] + 0.001 * value * value
                w[k] -= rate * (0.5 ** (epoch / 3)) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        print(f"epoch {epoch + 1}: {total / leaves:.4f} nats a leaf", flush=True)
    return w
