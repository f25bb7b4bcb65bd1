"""Event logs as streams: thinning, debouncing, session states, and the fan-out to sinks.

Event time counts, with a watermark; a micro-batch is put in order before it is folded. Rows behind the watermark are
dropped, which arrival-time processing has no notion of. A table that is run through a stream once has no late rows:
``replay`` hands it over in the order of time and closes what is open at its end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimweft.operators.eventlog import empty_state, step, view


def event_stream(spark: SparkSession, folder: str, schema: str | T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def replay(events: DataFrame, folder: str, time: str = "ts", files: int = 8, per_batch: int = 8, close_after_s: int | None = None) -> DataFrame:
    """A bounded table as a stream in the order of ``time``, whatever its files were: ``files`` slices of the clock, read
    ``per_batch`` to a micro-batch, so no row comes behind the watermark.

    ``close_after_s``, more than the delay and the longest gap, adds one row of that much later and else nulls. It moves
    the watermark past the end of all windows but its own, which never closes and so never leaves."""
    spark = events.sparkSession
    kept = events
    if close_after_s is not None:
        last = events.agg(F.max(time).alias("_last")).filter("_last is not null")
        row = last.select(*[(F.col("_last") + F.expr(f"interval {close_after_s} seconds")).cast(t).alias(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
        kept = events.unionByName(row)
    kept.repartitionByRange(files, time).write.parquet(folder)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-"))
    begin = fs.getFileStatus(path).getModificationTime() - 1_000 * len(names)
    for k, name in enumerate(names):  # the source takes files by their time; the parts are numbered by range
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(path, name), begin + 1_000 * k, -1)
    return event_stream(spark, folder, events.schema, per_batch)


def thin_out_stream(events: DataFrame, keys: list[str], gap_ms: int = 3_000, delay: str = "10 minutes") -> DataFrame:
    """Streaming form of ``eventlog.thin_out``: the last emitted time of each key is the state. It expires once the
    watermark has passed it by the gap, so keys that fall silent cost nothing."""
    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        keep = []
        for us in rows.ts.astype("int64") // 1_000 if rows.ts.dtype == "datetime64[ns]" else rows.ts.astype("datetime64[us]").astype("int64"):
            emit = last is None or us - last >= gap_ms * 1000
            last = us if emit else last
            keep.append(emit)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) // 1000 + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    late = events.withWatermark("ts", delay)
    return late.groupBy(*keys).applyInPandasWithState(run, events.schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def settled_stream(events: DataFrame, keys: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    """Debounce: the last value of each session of changes, once the watermark shows that it has settled. At the end of a
    table the last sessions stay open, unless ``replay`` closes them."""
    window = F.session_window("ts", gap)
    # Time and id in one number: a struct as order isn't planned with session windows.
    at = F.expr("cast(unix_micros(ts) as decimal(18, 0)) * cast('10000000000000000000' as decimal(20, 0)) + cast(event_id as decimal(19, 0))")
    ordered = events.withColumn("_at", at).withWatermark("ts", delay)
    return ordered.groupBy(*keys, window).agg(F.max_by("value", "_at").alias("value"), F.count("*").alias("changes")).select(
        *keys, F.col("session_window.start").alias("start"), "value", "changes")


def state_stream(events: DataFrame, session: str, idle: str | None = None) -> DataFrame:
    """The state of each session after every micro-batch that touches it. With ``idle`` ("30 minutes") the state of a session
    without events for so long is dropped."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, n = (json.loads(state.get[0]), state.get[1]) if state.exists else (empty_state(), 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        clean = rows.astype(object).where(rows.notna(), None)
        for r in clean[["kind", "claim", "message", "value"]].itertuples(index=False):
            step(held, *r)
        n += len(rows)
        state.update((json.dumps(held), n))
        if idle:
            state.setTimeoutDuration(idle)
        seen = view(held)
        yield pd.DataFrame([{session: key[0], "n_events": n, "phase": seen["phase"], "n_claims": len(seen["claims"]), "done": seen["done"], "errors": seen["errors"]}])

    kind = dict(events.dtypes)[session]
    return events.groupBy(session).applyInPandasWithState(
        run, f"{session} {kind}, n_events bigint, phase string, n_claims int, done int, errors int", "state string, n bigint", "update", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def fan_out(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Every sink gets every micro-batch; a batch is computed once for all of them."""
    def deliver(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for sink in sinks:
                sink(held, number)
        finally:
            held.unpersist()

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(deliver).start()


def parquet_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """One folder a micro-batch, overwritten when the batch is repeated, so that a retry adds nothing twice."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
