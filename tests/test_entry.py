from __future__ import annotations

import ast
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from brute import BRUTE

DATA = Path("/root/testdata/sf0.001")
CORE = sorted(k for k in entry.queries() if not (k[0] == "p" and k[1].isdigit()))


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return round(float(v), 4) + 0.0
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CORE)
def test_query_against_sql(spark, name):
    got = entry.queries()[name](spark, str(DATA))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        BRUTE[name](spark, str(DATA), got)
        return
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_needs_the_optional_part():
    root = Path(entry.__file__).parent / "claimweft"
    for file in root.rglob("*.py"):
        if "llm" in file.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("claimweft.llm" in n for n in names), file
