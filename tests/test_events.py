from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from claimweft.operators import eventlog
from claimweft.session import shared_folder
from claimweft.streaming.frames import claim_stream, ndjson_frames, sse_frames
from claimweft.streaming.live import event_stream, fan_out, parquet_sink, thin_out_stream

T0 = dt.datetime(2024, 1, 1, 23, 59, 58)


def log(spark, millis, key="a"):
    rows = [(i, T0 + dt.timedelta(milliseconds=m), key) for i, m in enumerate(millis)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, k string")


def thinned(millis, gap=3000):
    out, last = [], None
    for m in millis:
        if last is None or m - last >= gap:
            out.append(m)
            last = m
    return out


@pytest.mark.parametrize("millis", [[0, 1000, 2999, 3000, 5999, 6000], [0], [], [0, 0, 0], list(range(0, 20000, 700)), [0, 90_000_000, 90_000_001, 180_000_000]])
def test_thinning(spark, millis):
    got = eventlog.thin_out(log(spark, millis), ["k"]).collect()
    assert sorted(int((r.ts - T0).total_seconds() * 1000) for r in got) == thinned(millis)


def test_stretches_across_buckets(spark):
    events = log(spark, [0, 1000, 2500, 9000, 100_000_000, 100_001_000])
    got = eventlog.stretches(events, ["k"], 3000, bucket_s=2).orderBy("event_id").collect()
    assert [r.stretch for r in got] == [1, 1, 1, 2, 3, 3]


def test_settled_and_elapsed(spark):
    events = log(spark, [0, 100, 200, 5000]).withColumn("value", F.col("event_id") * 10)
    assert sorted((r.stretch, r.value, r.changes) for r in eventlog.settled(events, ["k"], 400, "value").collect()) == [(1, 20, 3), (2, 30, 1)]
    assert [r.elapsed_s for r in eventlog.elapsed(events, ["k"], 60_000).orderBy("event_id").collect()] == [0, 0, 0, 5]


def test_active_count(spark):
    events = log(spark, range(6)).withColumn("c", F.array(*map(F.lit, [1, -1, -1, 1, 1, -1]))[F.col("event_id").cast("int")])
    assert [r.active for r in eventlog.active_count(events, ["k"], "c").orderBy("event_id").collect()] == [1, 0, 0, 1, 2, 1]


def test_backlog(spark):
    events = log(spark, [i * 100 for i in range(250)])
    assert eventlog.last_rows(events).count() == 200
    assert eventlog.backlog(events, "2024-01-02 00:00:23").count() == 200
    assert eventlog.backlog(events, "2024-01-02 00:03:00").count() == 0


def test_states(spark):
    kinds = [("start", None, None, None), ("claim", "c1", None, None), ("claim", "c1", None, None), ("verify", "c9", None, None), ("verify", "c1", None, None), ("error", "c1", "x", None),
             ("results", "c1", None, None), ("log", None, "error: y", None), ("progress", None, None, 7.0)]
    rows = [(i, T0 + dt.timedelta(seconds=i), "s", *k) for i, k in enumerate(kinds)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, s string, kind string, claim string, message string, value double")
    got = eventlog.fold_states(events, "s").first()
    assert (got.n_events, got.claims, got.verifying, got.done, got.errors, got.error, got.progress) == (9, ["c1"], 1, 0, 1, "error: y", 1.0)
    assert eventlog.fold_states(events.limit(0), "s").count() == 0


def test_frames(spark):
    sse = 'data: {"d":"a"}\n\ndata: oops\n\n: ping\n\ndata: [DONE]\n\ndata: {"d":"b"}\n\n'
    body = spark.createDataFrame([("s", sse)], "k string, body string")
    assert [r.data for r in sse_frames(body, ["k"]).collect()] == ['{"d":"a"}']
    nd = spark.createDataFrame([("s", '{"m":"a"}\n{"m":"b"}'), ("t", '{"m":"a"}\n{"done":true}\n{"m":"c"}'), ("u", "")], "k string, body string")
    assert sorted((r.k, r.data) for r in ndjson_frames(nd, ["k"]).collect()) == [("s", '{"m":"a"}'), ("s", '{"m":"b"}'), ("t", '{"m":"a"}')]


def test_streams_equal_batches(spark):
    base = shared_folder(spark, "test")
    millis = list(range(0, 60000, 900))
    events = log(spark, millis).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        events.filter((F.col("event_id") >= i * 23) & (F.col("event_id") < (i + 1) * 23)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.05)
    stream = event_stream(spark, f"{base}/in", "event_id long, ts timestamp, k string")
    fan_out(thin_out_stream(stream, ["k"]), f"{base}/check", parquet_sink(f"{base}/one"), parquet_sink(f"{base}/two")).awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(f"{base}/one/batch=*").collect())
    want = thinned(millis)
    assert [millis[i] for i in got] == want
    assert spark.read.parquet(f"{base}/two/batch=*").count() == len(want)


def test_claims_come_as_they_close(spark):
    base = shared_folder(spark, "claims")
    parts = ['[{"text": "a"}, {"te', 'xt": "a"}, {"text": " b "}', ', 5, {"x": 1}, {"text": "c"}, {"text": "d"}]']
    for i, t in enumerate(parts):  # one file and so one micro-batch each, in order of time
        spark.createDataFrame([("p", i, t)], "page string, seq int, text string").coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(0.05)
    stream = event_stream(spark, f"{base}/in", "page string, seq int, text string")
    fan_out(claim_stream(stream, "page", n=3), f"{base}/check", parquet_sink(f"{base}/out")).awaitTermination()
    assert sorted((r.claim_id, r.claim) for r in spark.read.parquet(f"{base}/out/batch=*").collect()) == [("c1", "a"), ("c2", "b"), ("c3", "c")]


def test_log_streams_are_whole_over_many_unordered_files(spark):
    from claimweft.catalog.relational import GAP
    from claimweft.catalog.streams import log_settled_stream, log_thin_stream

    base = shared_folder(spark, "many")
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2] if i % 11 else "c", float(i), "{}") for i in range(600)]
    rows += [(1_000 + i, T0 + dt.timedelta(minutes=7 * i, milliseconds=GAP // 2), i % 3, "ab"[i % 2] if i % 11 else "c", float(i), "{}") for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.withColumn("_o", F.xxhash64("event_id")).repartition(20, "_o").drop("_o").write.parquet(f"{base}/events.parquet")
    assert len(spark.read.parquet(f"{base}/events.parquet").inputFiles()) > 16
    got = sorted(r.event_id for r in log_thin_stream(spark, base).collect())
    assert got == sorted(r.event_id for r in eventlog.thin_out(events, ["event_type", "user_id"], GAP).collect())
    want = sorted((r.event_type, r.user_id, r.value, r.changes) for r in eventlog.settled(events, ["event_type", "user_id"], 3_600_000, "value").collect())
    assert sorted((r.event_type, r.user_id, r.value, r.changes) for r in log_settled_stream(spark, base).collect()) == want
    assert sum(n for *_, n in want) == len(rows)
