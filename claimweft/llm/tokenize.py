"""Problem 6: encode and decode a whole corpus with a public tokenizer.

Cases: null and empty texts get an empty id list (and empty offsets); blank text is encoded like any other text;
strings that look like special tokens are ordinary text; repeated rows are encoded alike; very long texts are encoded
whole; extra columns pass through, and one with an output's name gives way to it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from claimweft.llm.columns import VALUE, carried, restored

#: Where the vocabulary files are; a parameter of every function below.
TOKENIZER_DIR = os.environ.get("CLAIMWEFT_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens kept per Python worker, and the longest one that is kept: about 60 MB at most.
MEMO_ENTRIES = 200_000
MEMO_CHARS = 48


class PieceEncoder:
    """Byte-level BPE by the tokenizers library, with a bounded memo of pre-tokens.

    Merges never cross a pre-token, so a text's ids are those of its pre-tokens in order. Each pre-token that the memo
    doesn't hold goes to the library, all of a text at once.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        cut = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        if self.tokenizer.normalizer is not None or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path}: texts of this vocabulary aren't cut by the byte-level pattern")
        self.memo: dict[str, list[int]] = {}
        # Fixed value: the published split pattern of this vocabulary family.
        self.split = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall

    def _ids_of(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = self.split(text)
        memo = self.memo
        unseen = [p for p in set(pieces) if p not in memo]
        if not unseen:
            return list(chain.from_iterable(map(memo.__getitem__, pieces)))
        if len(memo) + len(unseen) > MEMO_ENTRIES:
            memo.clear()
            unseen = list(set(pieces))
        found = dict(zip(unseen, self._ids_of(unseen), strict=True))
        memo.update((p, ids) for p, ids in found.items() if len(p) <= MEMO_CHARS)
        get = memo.get
        return list(chain.from_iterable(get(p) or found[p] for p in pieces))


def byte_table() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PieceDecoder:
    """Ids -> text and character offsets, through the bytes that each id stands for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        back = byte_table()
        self.pieces: dict[int, bytes] = {}
        for word, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=False).items():
            self.pieces[i] = bytes(back[c] for c in word)

    def decode(self, ids) -> str:
        """A character split over several ids is joined again; bytes that are no text become U+FFFD."""
        return b"".join(self.pieces[int(i)] for i in ids).decode("utf-8", "replace")

    def offsets(self, ids) -> list[tuple[int, int]]:
        """Per id the code points [start, end) that its bytes touch; ids that share a split character overlap."""
        data = [self.pieces[int(i)] for i in ids]
        starts, chars = [], -1
        for b in b"".join(data):
            chars += (b & 0xC0) != 0x80
            starts.append(max(chars, 0))
        out, at = [], 0
        for d in data:
            out.append((starts[at], starts[at + len(d) - 1] + 1) if d else (0, 0))
            at += len(d)
        return out


_LOADED: dict[tuple[str, str], object] = {}


def _loaded(kind: type, path: str):
    if (kind.__name__, path) not in _LOADED:
        _LOADED[kind.__name__, path] = kind(path)
    return _LOADED[kind.__name__, path]


def _path(vocabulary: str, folder: str | None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{vocabulary}.json")


def encode_documents(
    df: DataFrame, text_col: str = "text", out_col: str = "ids", vocabulary: str = "byte_bpe_50k",
    tokenizer_dir: str | None = None, with_offsets: bool = False, offsets_col: str = "offsets",
) -> DataFrame:
    """``df`` plus ``out_col`` array<int>; with offsets also ``offsets_col`` array<struct<start,end>> in code points.

    One narrow Arrow stage, no shuffle; a batch of texts is held as Python strings and lists of ids while it is encoded.
    """
    path = _path(vocabulary, tokenizer_dir)
    span = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
    fields = [T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)]
    if with_offsets:
        fields.append(T.StructField(offsets_col, T.ArrayType(span, False), False))
    source, kept = carried(df, text_col, [f.name for f in fields])
    names = [f.name for f in (*kept, *fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(PieceEncoder, path)
        decoder = _loaded(PieceDecoder, path) if with_offsets else None
        for batch in batches:
            rows = [encoder.encode(t) for t in batch.column(VALUE).to_pylist()]
            ends = [0]
            for r in rows:
                ends.append(ends[-1] + len(r))
            flat = pa.array(chain.from_iterable(rows), pa.int32(), size=ends[-1])
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            if decoder:
                spans = [decoder.offsets(r) for r in rows]
                parts = [pa.array([s[k] for r in spans for s in r], pa.int32()) for k in (0, 1)]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "end"])))
            yield pa.RecordBatch.from_arrays(columns, names)

    return restored(source.mapInArrow(run, T.StructType([*kept, *fields])), kept)


def decode_documents(
    df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str | None = None,
) -> DataFrame:
    """``df`` plus the text of ``ids_col``; a null or empty list gives an empty text."""
    path = _path(vocabulary, tokenizer_dir)
    source, kept = carried(df, ids_col, [out_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _loaded(PieceDecoder, path)
        for batch in batches:
            texts = [decoder.decode(ids or ()) for ids in batch.column(VALUE).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*(f.name for f in kept), out_col])

    return restored(source.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.StringType(), False)])), kept)
