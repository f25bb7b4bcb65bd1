"""Choosing passages of a page: strategies over its chunks, each page within its own row.

A page's chunks come with the page, so a selection is a narrow step: no shuffle, and the largest group is one page.
Strategies: ``mmr`` (TF-IDF importance with diversity), ``textrank`` (PageRank importance with diversity), ``topics``
(one of each star cluster, then the most important of the rest).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.models.ports import STOP_WORDS

#: Frequent words of all languages.
STOPS = frozenset(w for s in STOP_WORDS.values() for w in s.split())
_TOKEN = re.compile(r"[^\W]{2,}")


def term_matrix(chunks: list[str], min_df: int = 2, max_share: float = 0.95) -> np.ndarray:
    """TF-IDF rows of unit length over words and word pairs; no term left: a matrix without columns."""
    bags = []
    for chunk in chunks:
        words = _TOKEN.findall(chunk.lower())
        bag: dict[str, int] = {}
        for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            bag[t] = bag.get(t, 0) + 1
        bags.append(bag)
    df: dict[str, int] = {}
    for bag in bags:
        for t in bag:
            df[t] = df.get(t, 0) + 1
    n = len(chunks)
    kept = {t: i for i, t in enumerate(sorted(t for t, d in df.items() if d >= min_df and d <= max_share * n))}
    m = np.zeros((n, len(kept)))
    for i, bag in enumerate(bags):
        for t, c in bag.items():
            if t in kept:
                m[i, kept[t]] = c * (np.log((1 + n) / (1 + df[t])) + 1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def similarity(m: np.ndarray) -> np.ndarray:
    return m @ m.T if m.shape[1] else np.zeros((len(m), len(m)))


def page_rank(sim: np.ndarray, damping: float = 0.85, tolerance: float = 1e-5, rounds: int = 50) -> np.ndarray:
    """Of the weighted similarity graph with its self loops; after ``rounds`` steps the ranks stand as they are."""
    n = len(sim)
    total = sim.sum(1)
    moves = np.divide(sim, total[:, None], out=np.zeros_like(sim), where=total[:, None] > 0)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        after = (1 - damping) / n + damping * (rank @ moves + rank[total == 0].sum() / n)
        moved = np.abs(after - rank).sum()
        rank = after
        if moved < n * tolerance:
            break
    return rank


def marginal_relevance(imp: np.ndarray, sim: np.ndarray, n: int, balance: float = 0.5) -> list[int]:
    """The most important first; then whatever is best by importance and by distance from all that is chosen."""
    if n <= 0 or not len(imp):
        return []
    if n >= len(imp):
        return list(range(len(imp)))
    chosen = [int(np.argmax(np.round(imp, 12)))]
    far = 1 - sim[:, chosen[0]]
    while len(chosen) < n:
        score = np.round(balance * imp + (1 - balance) * far, 12)
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
        far = np.minimum(far, 1 - sim[:, chosen[-1]])
    return chosen


def stars(sim: np.ndarray, threshold: float) -> list[list[int]]:
    """The first remaining item with all remaining ones that are near it, again and again."""
    left, out = list(range(len(sim))), []
    while left:
        seed = left[0]
        near = [i for i in left if i == seed or sim[seed, i] >= threshold]
        out.append(near)
        left = [i for i in left if i not in set(near)]
    return out


def without_stops(text: str, stops: frozenset[str] = STOPS) -> str:
    """Words without frequent ones; marks become blanks."""
    return " ".join(w for w in re.sub(r"[^\w\s]", " ", text.lower()).split() if w not in stops)


def long_words(text: str, stops: frozenset[str] = STOPS, least: int = 3) -> str:
    """Words as they stand, of ``least`` letters or more, without frequent ones."""
    return " ".join(w for w in text.lower().split() if len(w) >= least and w not in stops)


#: What chunks are reduced to before terms are counted; a lemmatiser or compound splitter is registered under a name.
PREPROCESSORS: dict[str, Callable[[str], str]] = {"none": str, "stops": without_stops, "long_words": long_words}


def by_mmr(chunks: list[str], n: int, balance: float) -> tuple[list[int], np.ndarray]:
    m = term_matrix(chunks)
    imp = m.sum(1)
    return marginal_relevance(imp, similarity(m), n, balance), imp


def by_textrank(chunks: list[str], n: int, balance: float) -> tuple[list[int], np.ndarray]:
    sim = similarity(term_matrix(chunks, min_df=1, max_share=0.9))
    imp = page_rank(sim)
    return marginal_relevance(imp, sim, n, balance), imp


def by_topics(chunks: list[str], n: int, threshold: float) -> tuple[list[int], np.ndarray]:
    sim = similarity(term_matrix(chunks, min_df=1, max_share=0.9))
    imp = page_rank(sim)
    if n >= len(chunks):
        return list(range(len(chunks))), imp
    groups = sorted(stars(sim, threshold), key=lambda g: (-len(g), -round(float(imp[g[0]]), 12), g[0]))
    chosen = [min(g, key=lambda i: (-round(float(imp[i]), 12), i)) for g in groups[:n]]
    rest = sorted(set(range(len(chunks))) - set(chosen), key=lambda i: (-round(float(imp[i]), 12), i))
    return chosen + rest[:max(0, n - len(chosen))], imp


STRATEGIES: dict[str, Callable[[list[str], int, float], tuple[list[int], np.ndarray]]] = {"mmr": by_mmr, "textrank": by_textrank, "topics": by_topics}
CHOICE = T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("importance", T.DoubleType()), T.StructField("chunk", T.StringType())]))


def select_chunks(pages: DataFrame, key: str, chunks_col: str, n: int, strategy: str = "mmr", parameter: float = 0.5, preprocess: str = "none") -> DataFrame:
    """(key, rank, pos, importance, chunk) of the ``n`` chosen chunks of every page. ``parameter`` is the balance of the
    first two strategies and the threshold of the third; ``preprocess`` names what chunks are reduced to before they are
    compared. The chunks themselves come out as they were."""
    choose, reduce = STRATEGIES[strategy], PREPROCESSORS[preprocess]
    kind = pa.list_(pa.struct([("rank", pa.int32()), ("pos", pa.int32()), ("importance", pa.float64()), ("chunk", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunks in batch.column(chunks_col).to_pylist():
                chunks = [c for c in chunks or [] if c is not None]
                picks, imp = choose([reduce(c) for c in chunks], n, parameter) if chunks else ([], np.empty(0))
                rows.append([{"rank": r + 1, "pos": i, "importance": round(float(imp[i]), 6), "chunk": chunks[i]} for r, i in enumerate(picks)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, kind)], [key, "chosen"])

    schema = T.StructType([pages.schema[key], T.StructField("chosen", CHOICE)])
    return pages.select(key, chunks_col).mapInArrow(run, schema).select(key, F.inline("chosen"))
