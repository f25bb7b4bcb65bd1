"""Problem 1: the language of documents and of their lines, with a confidence.

Error-correcting output codes: every language has a codeword, one bit for each way to part the languages that the code
holds. A linear classifier over hashed letter n-grams predicts each bit; decoding takes the codeword with the least
loss-weighted distance from the predicted margins, and the distance to the second one tells how sure that is. All bits of
a word are one vector, so a text's margins are the mean of its words' vectors and words are looked up, not recomputed.

Cases: null, empty and blank texts, and texts without letters, have no language (null, confidence 0); texts whose two best
codewords are about as near are flagged as ambiguous; repeated rows are decided alike; very long texts are read whole;
unknown declared labels count as missing; extra columns pass through, and one with an output's name gives way to it.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.llm.columns import VALUE, carried, restored
from claimweft.llm.samples import bounded_sample

BUCKETS = 1 << 14
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
MEMO = 300_000
#: Least confidence at which a decision isn't ambiguous.
SURE = 0.3

#: Names under which a language is declared, besides its two- and three-letter codes.
DECLARED = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands vlaams flemish",
}
_BY_NAME = {name: code for code, names in DECLARED.items() for name in names.split()}


def declared_language(label: str | None) -> str | None:
    """The two-letter code of a declared label in any usual spelling; of a label that names no language, null. A code of
    another language is kept, so that it differs from all found ones."""
    if not label:
        return None
    head = re.split(r"[-_.;,(/ ]", label.strip().lower(), maxsplit=1)[0]
    if head in _BY_NAME:
        return _BY_NAME[head]
    if head in ("und", "mul", "zxx", "mis", "xx", "xxx", "n", "na", "auto", "unknown", "none", "null", "") or not re.fullmatch(r"[a-z]{2,3}", head):
        return None
    return head


def grams(word: str) -> list[int]:
    """Buckets of the word, its letter n-grams of one to four, with marks for its ends."""
    marked = f"<{word}>"
    parts = {marked}
    for n in (1, 2, 3, 4):
        parts.update(marked[i:i + n] for i in range(len(marked) - n + 1))
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def codewords(n: int, balanced_bits: int = 10) -> np.ndarray:
    """Rows of +1 and -1: one bit for each language against the rest, and the bits that part the languages in halves."""
    single = [[1 if i == k else -1 for i in range(n)] for k in range(n)]
    halves = [[1 if i in chosen else -1 for i in range(n)] for chosen in itertools.combinations(range(n), n // 2) if 0 in chosen or n % 2]
    return np.array(single + halves[:: max(1, len(halves) // balanced_bits)], np.float32).T


@dataclass
class LanguageCode:
    """Languages, their codewords and the bits' weights by bucket."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, rows: Iterable[tuple[str, str]], rounds: int = 120, rate: float = 2.0, decay: float = 2e-5, parts: int = 9) -> LanguageCode:
        """Logistic regression for all bits at once, by full gradient steps over whole texts and short stretches of them."""
        rows = [(lang, [w.lower() for w in _WORD.findall(text)]) for lang, text in rows if lang and text]
        languages = sorted({lang for lang, _ in rows})
        code = codewords(len(languages))
        samples = [(lang, words[a:a + parts]) for lang, words in rows for a in range(0, max(1, len(words) - parts // 2), parts)]
        slots: dict[str, np.ndarray] = {}
        for _, words in samples:
            for w in words:
                if w not in slots:
                    slots[w] = np.array(grams(w))
        own = sorted(slots)
        at = {w: i for i, w in enumerate(own)}
        # Two sparse steps: bucket -> word (mean of its n-grams) -> sample (mean of its words).
        gram_word = np.concatenate([np.full(len(slots[w]), at[w]) for w in own])
        gram_slot = np.concatenate([slots[w] for w in own])
        gram_size = np.array([len(slots[w]) for w in own], np.float32)
        word_sample = np.concatenate([np.full(len(words), k) for k, (_, words) in enumerate(samples)]).astype(np.int64)
        word_at = np.concatenate([[at[w] for w in words] for _, words in samples]).astype(np.int64)
        size = np.array([len(words) for _, words in samples], np.float32)
        target = code[[languages.index(lang) for lang, _ in samples]]
        share = np.bincount([languages.index(lang) for lang, _ in samples], minlength=len(languages))
        balance = (1 / share)[[languages.index(lang) for lang, _ in samples]][:, None].astype(np.float32) * (len(samples) / len(languages))
        weights, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        speed = np.zeros_like(weights)

        def adder(index: np.ndarray, source: np.ndarray, n: int):
            """Sums of the rows ``source`` by ``index``; the order is worked out once for all rounds."""
            order = np.argsort(index, kind="stable")
            ids, start = np.unique(index[order], return_index=True)
            source = source[order]

            def add(values: np.ndarray) -> np.ndarray:
                out = np.zeros((n, values.shape[1]), np.float32)
                out[ids] = np.add.reduceat(values[source], start, 0)
                return out

            return add

        to_words, to_samples = adder(gram_word, gram_slot, len(own)), adder(word_sample, word_at, len(samples))
        back_to_words, back_to_slots = adder(word_at, word_sample, len(own)), adder(gram_slot, gram_word, BUCKETS)
        for _ in range(rounds):
            by_word = to_words(weights) / gram_size[:, None]
            margin = to_samples(by_word) / size[:, None] * 8 + bias
            slope = -target / (1 + np.exp(np.clip(target * margin, -30, 30))) * balance / len(samples)
            word_slope = back_to_words(slope * 8 / size[:, None]) / gram_size[:, None]
            slot_slope = back_to_slots(word_slope)
            speed += slot_slope * slot_slope
            weights -= rate * (slot_slope / (np.sqrt(speed) + 1e-6) * 0.1 + decay * weights)
            bias -= 0.5 * slope.sum(0)
        return cls(languages, code, weights, bias)


class Detector:
    """Decides texts; word vectors are kept in a bounded table."""

    def __init__(self, code: LanguageCode):
        self.code = code
        self.at: dict[str, int] = {}
        self.table = np.empty((1024, code.words.shape[1]), np.float32)

    def _index(self, word: str) -> int:
        k = len(self.at)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[k] = self.code.weights[grams(word)].mean(0)
        self.at[word] = k
        return k

    def words(self, text: str) -> list[int]:
        if len(self.at) > MEMO:
            self.at.clear()
        get, index = self.at.get, self._index
        out = []
        for w in _WORD.findall(text.lower()):
            k = get(w)
            out.append(index(w) if k is None else k)
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword by loss-weighted distance for each row, and the confidence in it, from 0 to 1.

        The loss of a bit is that of its classifier, log(1 + exp(-bit * margin)): bits that are sure weigh most."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code.words[None]).mean(2)
        order = np.argsort(loss, 1)
        best, second = np.take_along_axis(loss, order[:, :2], 1).T
        return order[:, 0], 1 - np.exp(-(second - best) * 4)

    def texts(self, texts: list[str | None]) -> list[tuple[str | None, float, int]]:
        """(language or null, confidence, words) of each text."""
        rows = [self.words(t) if t else [] for t in texts]
        size = np.array([len(r) for r in rows], np.int64)
        out: list[tuple[str | None, float, int]] = [(None, 0.0, 0)] * len(rows)
        full = np.flatnonzero(size)
        if not len(full):
            return out
        flat = self.table[np.fromiter(itertools.chain.from_iterable(rows), np.int64, size.sum())]
        start = np.append(0, size[full].cumsum()[:-1])
        margins = np.add.reduceat(flat, start, 0) / size[full][:, None] * 8 + self.code.bias
        best, sure = self.decode(margins)
        for k, b, s in zip(full.tolist(), best.tolist(), sure.tolist()):
            out[k] = self.code.languages[b], s, int(size[k])
        return out

    def document(self, lines: list[str]) -> tuple[str | None, float, list[tuple[str | None, float, int]]]:
        """Language of most words of the lines, its share of the sure words, and each line's own decision."""
        each = self.texts(lines)
        weight: dict[str, float] = {}
        for lang, sure, n in each:
            if lang:
                weight[lang] = weight.get(lang, 0.0) + n * max(sure, 0.01)
        if not weight:
            return None, 0.0, each
        lang = max(sorted(weight), key=weight.get)
        return lang, weight[lang] / sum(weight.values()), each


def detect_column(df: DataFrame, code: LanguageCode, text_col: str, lang_col: str = "found_lang", sure_col: str = "found_sure") -> DataFrame:
    """``df`` plus the language of ``text_col`` and the confidence in it. Narrow, no shuffle."""
    source, kept = carried(df, text_col, [lang_col, sure_col])
    shared = df.sparkSession.sparkContext.broadcast(code)
    outputs = [T.StructField(lang_col, T.StringType()), T.StructField(sure_col, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(shared.value)
        for batch in batches:
            got = detector.texts(batch.column(VALUE).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [f.name for f in (*kept, *outputs)])

    return restored(source.mapInArrow(run, T.StructType([*kept, *outputs])), kept)


def detect_lines(df: DataFrame, code: LanguageCode, key: str, text_col: str = "text") -> DataFrame:
    """One row (key, line_no from 1, lang, sure, ambiguous) for each line that has letters."""
    lines = df.select(key, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    found = detect_column(lines.filter(F.col("line").rlike(r"\p{L}")), code, "line", "lang", "sure")
    return found.select(key, (F.col("pos") + 1).alias("line_no"), "lang", "sure", (F.col("sure") < SURE).alias("ambiguous"))


def declared(column: str):
    """The declared label as a code, on the JVM; the rules of ``declared_language``."""
    head = F.lower(F.split(F.trim(column), r"[-_.;,(/ ]").getItem(0))
    names = F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair])
    nothing = head.isin("und", "mul", "zxx", "mis", "xx", "xxx", "n", "na", "auto", "unknown", "none", "null", "")
    return F.coalesce(names[head], F.when(~nothing & head.rlike("^[a-z]{2,3}$"), head))


def fit_language_code(samples: DataFrame, more: DataFrame | None = None, max_rows: int = 4_000) -> LanguageCode:
    """From rows lang, text with right labels, of each table the first ``max_rows`` by the hash of the text."""
    def labelled(df: DataFrame) -> list[tuple[str, str]]:
        return [(r[0], r[1]) for r in bounded_sample(df.filter("lang is not null"), ["lang", "text"], max_rows)]

    return LanguageCode.fit(labelled(samples) + (labelled(more) if more is not None else []))
