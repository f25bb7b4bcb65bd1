"""Framing of model streams: server-sent events and newline-delimited JSON, in batch form and over a stream of deltas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimweft.functions.jsonx import closed_objects


def _until_end(df: DataFrame, keys: list[str], ended: Column) -> DataFrame:
    """Frames before the first one that ends the stream."""
    first = F.min(F.when(ended, F.col("pos"))).over(Window.partitionBy(*keys))
    return df.withColumn("_end", first).filter(F.col("_end").isNull() | (F.col("pos") < F.col("_end"))).drop("_end")


def sse_frames(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, pos, data): events end at a blank line, what follows the last one is dropped; an event's first ``data:`` line
    counts; ``[DONE]`` ends the stream; data that isn't JSON is skipped."""
    parts = F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n")
    events = bodies.select(*keys, F.posexplode(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "event"))
    data = F.trim(F.regexp_replace(F.get(F.filter(F.split("event", "\n"), lambda x: x.startswith("data:")), 0), "^data:", ""))
    lines = events.select(*keys, "pos", data.alias("data")).filter("data is not null")
    return _until_end(lines, keys, F.col("data") == "[DONE]").filter(F.expr("try_parse_json(data) is not null"))


def ndjson_frames(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """(keys, pos, data): one object a line, the last one also without a line end; ``"done": true`` ends the stream."""
    lines = bodies.select(*keys, F.posexplode(F.split(body, "\n")).alias("pos", "data")).filter(F.trim("data") != "")
    good = lines.filter(F.expr("try_parse_json(data) is not null"))
    return _until_end(good, keys, F.get_json_object("data", "$.done") == "true")


def claim_stream(deltas: DataFrame, key: str, n: int = 5, text: str = "text", idle: str | None = None) -> DataFrame:
    """(key, claim_id, claim) from a stream of text deltas, each claim as soon as its object is closed.

    The deltas of a micro-batch are put in order before they are read. The unread rest of the buffer is the state, so that
    no delta is scanned twice; a text that was seen doesn't come again; after ``n`` claims a key is silent, and its buffer
    is empty. With ``idle`` ("30 minutes") the state of a key that gets no delta for so long is dropped."""
    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer, seen, count = state.get if state.exists else ("", "[]", 0)
        known = json.loads(seen)
        out = []
        if count < n:
            buffer += "".join(d or "" for d in pd.concat(list(parts)).sort_values("seq", kind="stable")[text])
            for item in closed_objects(buffer):
                claim = json.loads(item).get("text")
                if isinstance(claim, str) and claim.strip() and claim.strip() not in known and count < n:
                    count += 1
                    known.append(claim.strip())
                    out.append((k[0], f"c{count}", claim.strip()))
                buffer = "[" + buffer[buffer.index(item) + len(item):]
        state.update(("" if count >= n else buffer, json.dumps(known), count))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[key, "claim_id", "claim"])

    kind = dict(deltas.dtypes)[key]
    return deltas.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, claim_id string, claim string", "buffer string, seen string, n int", "append",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
