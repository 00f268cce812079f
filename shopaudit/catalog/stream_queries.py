"""Streaming jobs run to completion over the event table, next to the batch statement of their result."""
from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history
from ..operators.monitor import PROCESSED, STARTED
from ..session import shared_folder
from ..sources import adapters as a
from ..streaming import intake, jobs
from . import history_queries


def _stream(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # The file's clock columns carry no zone; watermarks need instants.
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def _finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there and read what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def request_counts(spark, d):
    requests = _stream(spark, d).select(F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("requester"), "ts")
    out = _finished(jobs.request_counts(requests))
    return out.select("requester", F.date_format("day", "yyyy-MM-dd").alias("day"), "used", "limited")


def first_deliveries(spark, d):
    """Every event is delivered twice; each counts once."""
    events = _stream(spark, d).select("event_id", "event_type", "ts")
    twice = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    out = _finished(jobs.first_deliveries(twice))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


DELIVERIES = 3


def _deliveries(rows: DataFrame, when: str, newest_first: bool = False) -> list[DataFrame]:
    """Rows cut by time into as many deliveries."""
    low, high = rows.agg(F.min(F.unix_micros(when)), F.max(F.unix_micros(when))).first()
    part = F.least(F.floor((F.unix_micros(when) - (low or 0)) * DELIVERIES / F.lit((high or 0) - (low or 0) + 1)), F.lit(DELIVERIES - 1))
    order = range(DELIVERIES)
    return [rows.filter(part == i) for i in (reversed(order) if newest_first else order)]


def _replayed(rows: DataFrame, when: str, build) -> DataFrame:
    """Deliver rows one part after the other to a stream that stops after each and goes on from its checkpoint."""
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in _deliveries(rows, when):
        part.write.mode("append").parquet(f"{base}/in")
        out = build(lambda: spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        query = (out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def unprocessed_rescans(spark, d):
    """Re-scans with the processing event of the next fourteen days; those that waited in vain appear once that time is over."""
    log = a.events(spark, d).filter(F.col("type").isin(STARTED, PROCESSED)).select("event_id", "type", "entity_id", "created_at")

    def build(stream) -> DataFrame:
        started = stream().filter(F.col("type") == STARTED).select("event_id", "entity_id", F.col("created_at").alias("ts"))
        processed = stream().filter(F.col("type") == PROCESSED).select("entity_id", F.col("created_at").alias("done_at"))
        return jobs.unprocessed(started, processed)
    out = _replayed(log, "created_at", build)
    return out.select("event_id", "entity_id", _stamp("ts").alias("started_at"), _stamp("done_at").alias("done_at"))


def timed_out_scans(spark, d):
    """Every signup starts a scan; two of three end after some minutes, the others never."""
    rows = a.table(spark, d, "events").filter("event_type = 'signup'").select(
        F.col("event_id").alias("scan_id"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    ends = rows.filter("scan_id % 3 <> 0").select("scan_id", F.lit("finished").alias("kind"), (F.col("ts") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.col("k") % 17)).alias("ts"))
    log = rows.select("scan_id", F.lit("started").alias("kind"), "ts").unionByName(ends)
    out = _replayed(log, "ts", lambda stream: jobs.scan_timeouts(stream()))
    return out.select("scan_id", _stamp("started_at").alias("started_at"), "outcome")


NOTE_SCHEMA = ("org_id int, site_id long, code string, fingerprint string, state string, note string, updated_at timestamp, "
               "seq struct<order_line:long,part:long,supp:long>")


def notes_intake(spark, d):
    """Notes taken in batch by batch, newest first; one batch fails between writing and publishing and is delivered again."""
    base = f"{shared_folder(spark)}/intake-{uuid.uuid4().hex}"
    notes = a.notes(spark, d).withColumn("org_id", F.col("org_id").cast("int"))
    table = intake.ChangeTable(spark, f"{base}/notes", NOTE_SCHEMA, history.NOTE_KEY, [F.col("updated_at").desc(), F.col("seq").desc()])
    failed = []

    def fails_once(batch: int) -> None:
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost between write and publication")
    for part in _deliveries(notes, "updated_at", newest_first=True):
        part.write.mode("append").parquet(f"{base}/in")
        stream = history.accepted_notes(spark.readStream.schema(notes.schema).parquet(f"{base}/in"))
        try:
            table.take_in(stream, f"{base}/state", fails_once)
        except StreamingQueryException:
            table.take_in(stream, f"{base}/state", fails_once)
    # A batch whose end was not recorded by the stream comes again under its number.
    table.upsert(history.accepted_notes(notes.withColumn("note", F.lit("again"))), DELIVERIES - 1)
    return table.rows().select(*history.NOTE_KEY, "state", "note")


QUERIES = {f.__name__: f for f in (request_counts, first_deliveries, unprocessed_rescans, timed_out_scans, notes_intake)}
ORACLES = {
    "request_counts": """WITH e AS (SELECT 'r'||(user_id%50) requester, date_trunc('day', ts) dy, count(*) used FROM events GROUP BY 1,2),
        m AS (SELECT max(ts) - INTERVAL 1 HOUR w FROM events)
        SELECT requester, strftime(dy,'%Y-%m-%d') "day", used, used>=3 limited FROM e, m WHERE dy + INTERVAL 1 DAY <= w""",
    "unprocessed_rescans": """WITH e AS (SELECT *, user_id*100 + CAST(json_extract(props,'$.k') AS BIGINT)%100 entity_id FROM events),
        b AS (SELECT * FROM e WHERE event_type='signup'), p AS (SELECT * FROM e WHERE event_type='purchase'),
        m AS (SELECT least((SELECT max(ts) FROM b), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR w)
        SELECT b.event_id, b.entity_id, strftime(b.ts, '%Y-%m-%d %H:%M:%S.%f') started_at, strftime(p.ts, '%Y-%m-%d %H:%M:%S.%f') done_at
        FROM m, b LEFT JOIN p ON p.entity_id=b.entity_id AND p.ts >= b.ts AND p.ts <= b.ts + INTERVAL 14 DAY
        WHERE p.ts IS NOT NULL OR b.ts + INTERVAL 14 DAY < w""",
    "timed_out_scans": """WITH s AS (SELECT event_id scan_id, ts, CASE WHEN event_id%3<>0 THEN ts + to_minutes(CAST(json_extract(props,'$.k') AS BIGINT)%17) END ended
          FROM events WHERE event_type='signup'), m AS (SELECT greatest(max(ts), max(ended)) - INTERVAL 1 MINUTE w FROM s)
        SELECT scan_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') started_at, CASE WHEN ended < ts + INTERVAL 10 MINUTE THEN 'finished' ELSE 'failed' END outcome
        FROM s, m WHERE ended IS NOT NULL OR ts + INTERVAL 10 MINUTE < w""",
    "first_deliveries": "SELECT event_type, count(*) n FROM events GROUP BY 1",
}
ORACLES["notes_intake"] = history_queries.ORACLES["notes_latest"]
