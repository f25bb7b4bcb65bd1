"""Problem 7: passages of held-out items inside a training corpus.

Word 4-grams of the items are the seeds. A document and an item that share enough seeds on nearby diagonals are aligned
by Smith-Waterman over words, and the pair is a case where the alignment covers enough consecutive words of the passage
with few edits.

No seed counts as too frequent: a passage that was copied into a third of all documents, or that many items share, is
found in each of them and for each of them. Items of the same words are aligned once and reported one by one. The corpus
isn't shuffled: items go to the documents, in blocks of a bounded number of words; the blocks don't change the result.

Cases: null, empty and blank texts hold nothing; an item's first line is its instruction and doesn't count; an item of
fewer words than ``min_words`` can't be found; repeated documents and repeated items are all reported; very long texts
are searched whole; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DROP = re.compile("[̀-ͯ­​-‏⁠﻿'’‘`´]")
_WORDS = re.compile(r"[^\W_]+").findall
SEED = 4
#: Documents that are looked at together; their number has 15 bits in a group's key.
SLICE = 8192
_BASE = np.int64(1_000_003)


def words_of(text: str | None) -> list[str]:
    """Words without regard to typesetting: entities, case, accents, apostrophes and invisible characters fall away."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
        return _WORDS(_DROP.sub("", text).lower())
    return _WORDS(text.replace("'", "").replace("`", "").lower())


@dataclass
class Items:
    """A block of passages: the items that hold each, ids of their words, and their seeds in sorted order."""

    ids: list[list]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: np.ndarray
    starts: np.ndarray
    item_of: np.ndarray
    pos_of: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[object, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        alike: dict[tuple[int, ...], list] = {}
        for key, text in rows:
            passage = (text or "").partition("\n")[2] or ""
            alike.setdefault(tuple(vocabulary.setdefault(w, len(vocabulary)) for w in words_of(passage)), []).append(key)
        ids, words = list(alike.values()), [np.array(w, np.int64) for w in alike]
        keys, item_of, pos_of = [], [], []
        for i, w in enumerate(words):
            k = _seeds(w)[0]
            keys.append(k)
            item_of.append(np.full(len(k), i, np.int64))
            pos_of.append(np.arange(len(k), dtype=np.int64))
        key = np.concatenate([*keys, np.empty(0, np.int64)])
        order = np.argsort(key, kind="stable")
        key, item, pos = key[order], np.concatenate([*item_of, np.empty(0, np.int64)])[order], np.concatenate([*pos_of, np.empty(0, np.int64)])[order]
        seeds, first = np.unique(key, return_index=True)
        starts = np.append(first, len(key))
        return cls(ids, words, vocabulary, seeds, starts, item, pos)


def _seeds(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the word n-grams, and whether all words of each are known (-1 is an unknown word)."""
    n = len(w) - SEED + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, bool)
    key, known = np.zeros(n, np.int64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            part = w[k:k + n]
            key = key * _BASE + part + 1
            known &= part >= 0
    return key, known


def candidates(doc_of: np.ndarray, pos: np.ndarray, words: np.ndarray, items: Items, min_seeds: int, slack: int) -> list[tuple[int, int, int, int]]:
    """Rows (document, item, diagonal low, diagonal high) with enough seeds on nearby diagonals."""
    key, known = _seeds(words)
    n = len(key)
    if not n or not len(items.seeds):
        return []
    at = np.flatnonzero(known & (doc_of[:n] == doc_of[SEED - 1:SEED - 1 + n]))
    slot = np.searchsorted(items.seeds, key[at])
    slot[slot == len(items.seeds)] = 0
    hit = items.seeds[slot] == key[at]
    at, slot = at[hit], slot[hit]
    if not len(at):
        return []
    count = items.starts[slot + 1] - items.starts[slot]
    entry = np.repeat(items.starts[slot] - np.cumsum(count) + count, count) + np.arange(count.sum())
    at = np.repeat(at, count)
    item, ipos = items.item_of[entry], items.pos_of[entry]
    doc, diagonal = doc_of[at], pos[at] - ipos
    # One key of 15 bits of the document in its batch, 22 of the item and 26 of the bin of diagonals.
    base, width, out = doc << 48 | item << 26, 2 * slack, []
    for shift in (0, slack):  # two overlapping rows of bins, so that diagonals within the slack share one of them
        key = base | (diagonal + shift + (1 << 20)) // width
        order = np.lexsort((ipos, key))
        key, place = key[order], ipos[order]
        fresh = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(fresh)
        fresh[1:] |= place[1:] != place[:-1]
        good = np.add.reduceat(fresh.astype(np.int64), start) >= min_seeds
        end = np.append(start[1:], len(key))
        for s, e in zip(start[good], end[good]):
            d = diagonal[order[s:e]]
            out.append((doc[order[s]], item[order[s]], d.min(), d.max()))
    merged: dict[tuple[int, int], list[list[int]]] = {}
    for d, i, low, high in sorted(map(tuple, np.array(out, np.int64).reshape(-1, 4).tolist())):
        spans = merged.setdefault((d, i), [])
        if spans and low <= spans[-1][1] + width:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [(d, i, low, high) for (d, i), spans in merged.items() for low, high in spans]


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -2, gap: int = -1) -> list[tuple[int, int]]:
    """Best local alignment as pairs of positions, -1 for a gap. Rows of the matrix are whole numpy vectors."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1), np.int32)
    ramp = -gap * np.arange(1, m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        t = np.maximum(np.maximum(h[i - 1, :-1] + np.where(b == a[i - 1], match, mismatch), h[i - 1, 1:] + gap), 0)
        h[i, 1:] = np.maximum.accumulate(t + ramp) - ramp
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    path = []
    while i > 0 and j > 0 and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            path.append((int(i), int(j)))
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
            path.append((int(i), -1))
        else:
            j -= 1
            path.append((-1, int(j)))
    return path[::-1]


def best_window(path: list[tuple[int, int]], a: np.ndarray, b: np.ndarray, min_words: int, max_edits: float) -> tuple[int, int]:
    """The most item words in a stretch of the alignment whose edits stay under ``max_edits`` a word, and its edits."""
    word = np.array([i >= 0 for i, _ in path], np.float64)
    edit = np.array([i < 0 or j < 0 or a[i] != b[j] for i, j in path], np.float64)
    words, edits = np.append(0, word.cumsum()), np.append(0, edit.cumsum())
    if words[-1] < min_words:
        return 0, 0
    balance = edits - max_edits * words  # a stretch s..e is good where balance[e] <= balance[s]
    best = (0, 0)
    for s in range(len(path)):
        if words[-1] - words[s] < max(min_words, best[0] + 1):
            break
        good = np.flatnonzero(balance[s:] <= balance[s] + 1e-9)
        e = s + int(good[-1])
        if words[e] - words[s] > best[0]:
            best = int(words[e] - words[s]), int(edits[e] - edits[s])
    return best if best[0] >= min_words else (0, 0)


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_words: int = 20, max_edits: float = 0.125, min_seeds: int = 8, slack: int = 6, block_words: int = 2_000_000,
) -> DataFrame:
    """One row (doc_id, item_id, n_words, n_edits) per document and item whose passage it holds.

    A passage of n words with e edits keeps at least n - 3 - 4e seeds, so 20 words with two edits keep nine.
    ``items`` is read to the driver block by block, ``block_words`` words at most in each; a block is packed into its
    broadcast and let go before the next is read. Every block takes one pass over the documents, and is unpacked by the
    tasks of its own pass alone.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") >= 2 * min_words - 1)
    id_types = dict(docs.select(doc_id).dtypes)[doc_id], dict(items.select(item_id).dtypes)[item_id]
    found = None
    for rows in _blocks(items.select(item_id, item_text), block_words):
        shared = spark.sparkContext.broadcast(Items.build(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            get = known.vocabulary.get
            for batch in (big.slice(a, SLICE) for big in batches for a in range(0, big.num_rows, SLICE)):
                keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                parts = [np.fromiter((get(w, -1) for w in words_of(t)), np.int64) for t in texts]
                size = np.array([len(p) for p in parts], np.int64)
                first = np.append(0, size.cumsum())
                doc_of = np.repeat(np.arange(len(parts)), size)
                pos = np.arange(first[-1]) - first[doc_of]
                rows_out: dict[tuple[int, int], tuple[int, int]] = {}
                for d, i, low, high in candidates(doc_of, pos, np.concatenate([*parts, np.empty(0, np.int64)]), known, min_seeds, slack):
                    a = known.words[i]
                    start = max(0, low - 2 * slack)
                    b = parts[d][start:high + len(a) + 2 * slack]
                    n, edits = best_window(smith_waterman(a, b), a, b, min_words, max_edits)
                    if n > rows_out.get((d, i), (0, 0))[0]:
                        rows_out[d, i] = n, edits
                yield pa.RecordBatch.from_arrays([
                    pa.array([keys[d] for d, i in rows_out for _ in known.ids[i]], batch.schema.field("doc_id").type),
                    pa.array([x for _, i in rows_out for x in known.ids[i]], item_arrow),
                    pa.array([v[0] for (_, i), v in rows_out.items() for _ in known.ids[i]], pa.int32()),
                    pa.array([v[1] for (_, i), v in rows_out.items() for _ in known.ids[i]], pa.int32()),
                ], ["doc_id", "item_id", "n_words", "n_edits"])

        item_arrow = pa.int64() if id_types[1] in ("bigint", "int", "smallint", "tinyint") else pa.string()
        part = source.mapInArrow(run, f"doc_id {id_types[0]}, item_id {'bigint' if item_arrow == pa.int64() else 'string'}, n_words int, n_edits int")
        found = part if found is None else found.unionByName(part)
    return found


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """Items in blocks of a bounded number of words; one block is held at a time. No items are one empty block."""
    block, size, any_block = [], 0, False
    for row in items.toLocalIterator():
        n = len((row[1] or "").split())
        if block and size + n > block_words:
            yield block
            block, size, any_block = [], 0, True
        block.append((row[0], row[1]))
        size += n
    if block or not any_block:
        yield block
