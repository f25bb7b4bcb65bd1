"""Ordered folds over event logs, as streams of sorted rows.

A key's events are brought together and sorted by Spark, then read once in order with a small state, batch after batch:
a hot key is long but never held in memory. Before that, keys are cut where the fold forgets: an event that comes
``gap`` or more after its predecessor is emitted whatever came before, so such stretches are independent and a hot key
spreads over many tasks. A stretch that itself never pauses is still read by one task, in constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweft.functions.time import micros


def stretches(events: DataFrame, keys: list[str], gap_ms: int, time: str = "ts", tie: str = "event_id", out: str = "stretch", bucket_s: int = 86_400) -> DataFrame:
    """Number of the stretch that an event belongs to: a new one begins ``gap_ms`` or more after the event before.

    Windows run over a key's events of one stretch of the clock (``bucket_s``) only, so a hot key is many tasks; the few
    rows a key and bucket (last time, number of beginnings) are then put in order to join the buckets up."""
    place = F.floor(micros(time) / (bucket_s * 1_000_000))
    placed = events.withColumn("_us", micros(time)).withColumn("_b", place)
    w = Window.partitionBy(*keys, "_b").orderBy("_us", tie)
    before = F.lag("_us").over(w)
    inner = placed.withColumn("_new", F.when(before.isNull(), 0).otherwise((F.col("_us") - before >= gap_ms * 1000).cast("int")))
    inner = inner.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    by = inner.groupBy(*keys, "_b").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max("_n").alias("_inside"))
    order = Window.partitionBy(*keys).orderBy("_b")
    last = F.lag("_last").over(order)
    by = by.withColumn("_fresh", (last.isNull() | (F.col("_first") - last >= gap_ms * 1000)).cast("int"))
    by = by.withColumn("_base", F.sum(F.col("_fresh") + F.col("_inside")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inside"))
    met = inner.join(by.select(*keys, "_b", "_base"), [*keys, "_b"])
    return met.withColumn(out, F.col("_base") + F.col("_n")).select(*events.columns, out)


def thin_out(events: DataFrame, keys: list[str], gap_ms: int = 3_000, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events of which the last emitted one of the same key is at least ``gap_ms`` old."""
    cut = stretches(events, keys, gap_ms, time, tie)
    placed = cut.withColumn("_us", micros(time)).withColumn("_key", F.xxhash64(*keys, "stretch"))
    ordered = placed.repartition(F.col("_key")).sortWithinPartitions("_key", *keys, "stretch", "_us", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            names = [*keys, "stretch"]
            group = list(zip(*(batch.column(c).to_pylist() for c in names)))
            keep = []
            for g, t in zip(group, batch.column("_us").to_pylist()):
                if g != current:
                    current, last = g, None
                emit = last is None or t - last >= gap_ms * 1000
                if emit:
                    last = t
                keep.append(emit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema).drop("_us", "_key", "stretch")


def last_rows(events: DataFrame, n: int = 200, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last ``n`` rows of all, by a top-n that each partition cuts first."""
    return events.orderBy(F.desc(time), F.desc(tie)).limit(n)


def backlog(events: DataFrame, now: str, n: int = 200, max_age_s: int = 60, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """What a late subscriber gets at the time ``now``: the last ``n`` rows, those over ``max_age_s`` old left out."""
    at = F.to_timestamp_ntz(F.lit(now))
    return last_rows(events.filter(F.col(time) <= at), n, time, tie).filter(F.col(time) >= at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_s)))


def settled(events: DataFrame, keys: list[str], gap_ms: int, value: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Debounce: the last value of each stretch of changes, and when it had settled."""
    cut = stretches(events, keys, gap_ms, time, tie)
    last = F.max_by(F.struct(time, value), F.struct(time, tie))
    return cut.groupBy(*keys, "stretch").agg(last.alias("_l"), F.count("*").alias("changes")).select(*keys, "stretch", f"_l.{time}", f"_l.{value}", "changes")


def elapsed(events: DataFrame, keys: list[str], gap_ms: int, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Whole seconds since the first event of the stretch."""
    cut = stretches(events, keys, gap_ms, time, tie)
    start = F.min(micros(time)).over(Window.partitionBy(*keys, "stretch"))
    return cut.withColumn("elapsed_s", F.floor((micros(time) - start) / 1_000_000).cast("bigint"))


def active_count(events: DataFrame, keys: list[str], change: str, time: str = "ts", tie: str = "event_id", out: str = "active") -> DataFrame:
    """Running sum of ``change`` that never falls under 0: the plain sum less its least value so far, where that is negative."""
    w = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    plain = events.withColumn("_sum", F.sum(change).over(w))
    return plain.withColumn(out, F.col("_sum") - F.least(F.min("_sum").over(w), F.lit(0))).drop("_sum")


STATE = T.StructType([
    T.StructField("phase", T.StringType()), T.StructField("claims", T.ArrayType(T.StringType())), T.StructField("verifying", T.IntegerType()), T.StructField("done", T.IntegerType()),
    T.StructField("errors", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("progress", T.DoubleType()),
])


def empty_state() -> dict:
    return {"phase": "idle", "order": [], "status": {}, "error": None, "errors": 0, "progress": 0.0}


def step(state: dict, kind: str, claim: str | None, message: str | None, value: float | None) -> None:
    """One event. A claim is inserted once; an error ends it, later results open it again; verifying it anew clears it;
    unknown claims are ignored; an error of the page is kept as its last one."""
    known = claim in state["status"]
    if kind == "start":
        state.update(empty_state(), phase="extracting")
    elif kind == "phase":
        state["phase"] = message or state["phase"]
    elif kind == "progress":
        state["progress"] = min(1.0, max(0.0, value or 0.0))
    elif kind == "claim":
        if claim is not None and not known:
            state["order"].append(claim)
            state["status"][claim] = "found"
    elif kind in ("verify", "results"):
        if known:
            state["status"][claim] = "verifying"
    elif kind == "verdict":
        if known:
            state["status"][claim] = "done"
    elif kind == "error":
        state["errors"] += 1
        if claim is None:
            state["error"] = message
        elif known:
            state["status"][claim] = "done"
    elif kind == "log" and message and message.startswith("error"):
        state["error"] = message
    elif kind == "finish":
        state["phase"], state["progress"] = "done", 1.0


def view(state: dict) -> dict:
    status = list(state["status"].values())
    return {
        "phase": state["phase"], "claims": list(state["order"]), "verifying": status.count("verifying"), "done": status.count("done"),
        "errors": state["errors"], "error": state["error"], "progress": state["progress"],
    }


def fold_states(events: DataFrame, session: str, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """(session, n_events, STATE): the state that each session's events lead to. ``events`` has kind, claim, message, value."""
    ordered = events.select(session, micros(time).alias("_us"), tie, "kind", "claim", "message", "value").repartition(F.col(session)).sortWithinPartitions(session, "_us", tie)
    schema = T.StructType([events.schema[session], T.StructField("n_events", T.LongType()), *STATE.fields])
    kind = pa.schema([("phase", pa.string()), ("claims", pa.list_(pa.string())), ("verifying", pa.int32()), ("done", pa.int32()), ("errors", pa.int32()), ("error", pa.string()), ("progress", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, state, key_type, out = None, 0, empty_state(), None, []

        def ready() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pylist([view(s) for _, _, s in out], schema=kind)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in out], key_type), pa.array([c for _, c, _ in out], pa.int64()), *rows.columns], [session, "n_events", *rows.schema.names])

        for batch in batches:
            key_type = batch.schema.field(session).type
            for row in zip(*(batch.column(c).to_pylist() for c in (session, "kind", "claim", "message", "value"))):
                if n and row[0] != current:
                    out.append((current, n, state))
                    n, state = 0, empty_state()
                current = row[0]
                n += 1
                step(state, *row[1:])
            if len(out) > 1000:
                yield ready()
                out = []
        if n:
            out.append((current, n, state))
        if out:
            yield ready()

    return ordered.mapInArrow(run, schema)


def throttle(events: DataFrame, key: str, amount: str, over: float, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events at which more than ``over`` of ``amount`` has come together since the last one that was let through."""
    ordered = events.withColumn("_us", micros(time)).repartition(F.col(key)).sortWithinPartitions(key, "_us", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, 0.0
        for batch in batches:
            keep = []
            for k, a in zip(batch.column(key).to_pylist(), batch.column(amount).to_pylist()):
                if k != current:
                    current, total = k, 0.0
                total += a or 0.0
                keep.append(total > over)
                if keep[-1]:
                    total = 0.0
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema).drop("_us")
