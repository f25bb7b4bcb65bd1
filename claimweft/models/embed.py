"""Embedding port, with hashed term frequencies as the offline stand-in."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"[^\W]{2,}")


def instructed(query: Column, task: str = "find passages about this statement") -> Column:
    """Queries carry an instruction, documents don't."""
    return F.concat(F.lit(f"Task: {task}\nQuery: "), query)


class HashedEncoder:
    """Unit vectors of signed, damped counts of hashed words; an empty text is the zero vector."""

    def __init__(self, width: int = 64):
        self.width, self.slots = width, {}

    def encode(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for row, text in enumerate(texts):
            counts: dict[int, int] = {}
            for word in _TOKEN.findall((text or "").lower()):
                slot = self.slots.get(word)
                if slot is None:
                    if len(self.slots) > 500_000:
                        self.slots.clear()
                    slot = self.slots[word] = zlib.crc32(word.encode())
                counts[slot] = counts.get(slot, 0) + 1
            for slot, n in counts.items():
                out[row, slot % self.width] += (1 if slot & 1 << 20 else -1) * np.log1p(n)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding", encoder=HashedEncoder) -> DataFrame:
    """``df`` plus vectors. The encoder is made once a task and fed whole Arrow batches; any class with ``encode`` serves."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for batch in batches:
            m = model.encode(batch.column(text_col).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out_col])

    return df.mapInArrow(run, schema)
