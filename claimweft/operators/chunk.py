"""Cutting texts into lines, sentences and chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweft.functions.text import word_count


def lines(df: DataFrame, keys: list[str], text_col: str = "text", out: str = "chunk") -> DataFrame:
    """(keys, pos, chunk): the lines that aren't blank, with their place counted from 0 over all lines."""
    exploded = df.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("pos", out))
    return exploded.filter(F.trim(F.regexp_replace(out, "[\\t\\r\\u00a0]", " ")) != "")


def page_gate(df: DataFrame, text_col: str = "text", least: int = 80) -> DataFrame:
    return df.filter((F.col(text_col) != "") & (word_count(text_col) >= least))


def long_chunks(df: DataFrame, chunk: str = "chunk", least: int = 250) -> DataFrame:
    """Chunks of more than ``least`` characters: the splitter keeps ``least`` or more and its users more than that."""
    return df.filter(F.length(chunk) > least)


_LEVELS = [re.compile(p) for p in (r"\n[ \t]*\n", r"\n", r"(?<=[.!?…])\s+", r"\s+")]


def cut(text: str, limit: int, level: int = 0) -> list[str]:
    """Pieces of at most ``limit`` characters: at blank lines, else lines, sentences, words, and at last by count."""
    text = text.strip()
    if len(text) <= limit:
        return [text] if text else []
    if level == len(_LEVELS):
        return [text[i:i + limit] for i in range(0, len(text), limit)]
    joint = ("\n\n", "\n", " ", " ")[level]
    out, held = [], ""
    for part in _LEVELS[level].split(text):
        for piece in cut(part, limit, level + 1) if len(part) > limit else [part.strip()]:
            if not piece:
                continue
            if held and len(held) + len(joint) + len(piece) <= limit:
                held += joint + piece
            else:
                if held:
                    out.append(held)
                held = piece
    return [*out, held] if held else out


def split_markdown(text: str | None, limit: int = 500, least: int = 250) -> list[str]:
    return [c for c in cut(text or "", limit) if len(c) >= least]


def markdown_chunks(column: Column, limit: int = 500, least: int = 250) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_markdown(t, limit, least))

    return run(column)
