"""Frames of model streams, and event logs run through Structured Streaming and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweft.catalog import ORACLES, query
from claimweft.catalog.relational import GAP, session_events
from claimweft.functions.time import micros
from claimweft.session import shared_folder
from claimweft.sources.tables import read_table
from claimweft.streaming.frames import claim_stream, ndjson_frames, sse_frames
from claimweft.streaming.live import fan_out, parquet_sink, replay, settled_stream, state_stream, thin_out_stream


def _bodies(spark: SparkSession, d: str, before: str, after: str, joint: str, end: str) -> DataFrame:
    """Events of each user as one stream body. The event of the type ``error`` isn't JSON, and ``purchase`` ends it."""
    events = read_table(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    line = F.when(F.col("event_type") == "error", "oops").when(F.col("event_type") == "purchase", F.lit(end)).otherwise(F.col("props"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", F.concat(F.lit(before), line, F.lit(after)).alias("x"))))
    return events.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda s: s["x"]), joint).alias("body"))


_UNTIL = """WITH e AS (SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
x AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN pos END) OVER (PARTITION BY user_id) AS stop FROM e)
SELECT user_id, pos, props AS data FROM x WHERE event_type NOT IN ('error', 'purchase') AND (stop IS NULL OR pos < stop)"""


@query(_UNTIL + " AND pos < n - 1")
def sse_events(spark: SparkSession, d: str) -> DataFrame:
    """The last event has no blank line after it, so it is dropped."""
    bodies = _bodies(spark, d, "data: ", "", "\n\n", "[DONE]")
    return sse_frames(bodies, ["user_id"]).select("user_id", F.col("pos").cast("bigint").alias("pos"), "data")


@query(_UNTIL)
def ndjson_events(spark: SparkSession, d: str) -> DataFrame:
    bodies = _bodies(spark, d, "", "", "\n", '{"done": true}')
    return ndjson_frames(bodies, ["user_id"]).select("user_id", F.col("pos").cast("bigint").alias("pos"), "data")


def _source(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of one file; micro-batches follow the files of the table."""
    path = f"{d}/events.parquet"
    schema = read_table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path if _is_folder(spark, path) else f"{d}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _in_order(spark: SparkSession, d: str, close_after_s: int | None = None) -> DataFrame:
    """The events as a stream of one pass in the order of time; as many files a micro-batch as ``_source`` takes."""
    events = read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return replay(events, f"{shared_folder(spark, 'replay')}/events", files=max(8, len(events.inputFiles())), close_after_s=close_after_s)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _run(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    out = shared_folder(spark, "stream")
    done = fan_out(stream, f"{out}/checkpoint", parquet_sink(f"{out}/rows"), mode=mode)
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows/batch=*")


@query("""WITH RECURSIVE e AS (SELECT event_type, user_id, epoch_us(ts) AS us, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_type, user_id, event_id, k, us AS last, true AS emitted FROM e WHERE k = 1
UNION ALL SELECT e.event_type, e.user_id, e.event_id, e.k, CASE WHEN e.us - f.last >= GAP THEN e.us ELSE f.last END, e.us - f.last >= GAP FROM f JOIN e ON e.event_type = f.event_type AND e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id FROM f WHERE emitted""".replace("GAP", str(GAP * 1000)))
def log_thin_stream(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, thin_out_stream(_in_order(spark, d), ["event_type", "user_id"], GAP)).select("event_id")


@query("""WITH e AS (SELECT event_type, user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS stretch FROM e)
SELECT event_type, user_id, epoch_us(min(ts)) AS start_us, arg_max(value, (ts, event_id)) AS value, count(*) AS changes FROM s GROUP BY event_type, user_id, stretch""")
def log_settled_stream(spark: SparkSession, d: str) -> DataFrame:
    """All stretches, those at the end of the table too: they are closed by a row of two days later."""
    out = _run(spark, settled_stream(_in_order(spark, d, 2 * 86_400), ["event_type", "user_id"], "1 hour"))
    return out.select("event_type", "user_id", micros("start").alias("start_us"), "value", "changes")


@query(ORACLES["session_states"].replace("round(progress, 6) AS progress, ", "").replace(", coalesce(verifying, 0) AS verifying", ""))
def session_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each session, after all micro-batches."""
    out = _run(spark, state_stream(session_events(spark, d, _source(spark, d)), "user_id"), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n_claims", "done", "errors"), "n_events").alias("s"), F.max("n_events").alias("n_events"))
    long = lambda c: F.col(f"s.{c}").cast("bigint").alias(c)
    return last.select("user_id", "n_events", long("errors"), long("n_claims"), long("done"))


@query("""WITH t AS (SELECT user_id, event_type || ' ' || json_extract_string(props, '$.k') AS claim, min(event_id) AS first FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS n FROM t) SELECT user_id, 'c' || n AS claim_id, claim FROM r WHERE n <= 5""")
def claim_delta_stream(spark: SparkSession, d: str) -> DataFrame:
    """Claims of an answer that comes in pieces: each event is one object of its user's growing array."""
    deltas = _source(spark, d).select(
        "user_id", F.col("event_id").alias("seq"), F.concat(F.lit('[{"text": "'), F.col("event_type"), F.lit(" "), F.get_json_object("props", "$.k"), F.lit('"},')).alias("text"))
    return _run(spark, claim_stream(deltas, "user_id"))
