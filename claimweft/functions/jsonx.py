"""Tolerant JSON: finding the value in a model's answer, and the objects of an array that is still growing."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.functions.text import drop_thoughts

_FENCE = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.I)


def balanced(text: str, start: int) -> int:
    """Where the bracket at ``start`` closes, counting only its own kind and not inside strings; -1 where it doesn't."""
    opener = text[start]
    closer = "}" if opener == "{" else "]"
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == opener:
            depth += 1
        elif c == closer:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def json_value(text: str | None) -> str | None:
    """The first object or array of a text, of its fenced block if it has one; null where it isn't closed."""
    if not text:
        return None
    fence = _FENCE.search(text)
    body = fence[1] if fence else text
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    end = balanced(body, start)
    return body[start:end + 1] if end >= 0 else None


def closed_objects(text: str | None) -> list[str]:
    """Objects of the first array that are complete, in document order; numbers and strings aren't taken."""
    if not text or "[" not in text:
        return []
    out, i = [], text.index("[") + 1
    while i < len(text):
        if text[i] == "{":
            end = balanced(text, i)
            if end < 0:
                break
            try:
                json.loads(text[i:end + 1])
                out.append(text[i:end + 1])
            except ValueError:
                pass
            i = end
        elif text[i] == "]":
            break
        elif text[i] == '"':
            m = re.compile(r'"(?:[^"\\]|\\.)*"').match(text, i)
            if not m:
                break
            i = m.end() - 1
        i += 1
    return out


@F.pandas_udf(T.StringType())
def _json_value(texts: pd.Series) -> pd.Series:
    return texts.map(json_value)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _closed_objects(texts: pd.Series) -> pd.Series:
    return texts.map(closed_objects)


def extract_json(column: Column) -> Column:
    return _json_value(drop_thoughts(column))


def parse_json(column: Column, schema: str) -> Column:
    """Null where the answer holds no valid value."""
    return F.from_json(extract_json(column), schema, {"mode": "PERMISSIVE"})


def array_objects(column: Column) -> Column:
    return _closed_objects(column)


#: Path of the text in stream events, by the shape of the event.
DELTA_PATHS = {
    "choices": "$.choices[0].delta.content", "delta": "$.delta.text", "candidates": "$.candidates[0].content.parts[0].text", "message": "$.message.content",
}


def delta_text(column: Column, shape: str) -> Column:
    return F.get_json_object(column, DELTA_PATHS[shape])
