"""Streams that stop, fail and go on; the change table; stored days; running totals."""
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shopaudit.session import running_totals
from shopaudit.sources import pages
from shopaudit.streaming import intake, jobs

SCHEMA = "k long, seq long, v string"


def table_of(spark, path):
    return intake.ChangeTable(spark, path, SCHEMA, ["k"], [F.col("seq").desc()], buckets=4)


def state(table):
    return {(r["k"], r["seq"], r["v"]) for r in table.rows().collect()}


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_change_table(spark, tmp_path):
    table = table_of(spark, str(tmp_path / "t"))
    assert state(table) == set() and table.ledger() == {"batch": -1, "versions": {}}
    table.upsert(rows(spark, (1, 1, "a"), (2, 1, "b"), (1, 2, "c")), 0)
    assert state(table) == {(1, 2, "c"), (2, 1, "b")}
    # An older change and one of a new key; then the same batch number again, which changes nothing.
    table.upsert(rows(spark, (1, 1, "old"), (3, 1, "d")), 1)
    table.upsert(rows(spark, (1, 9, "again")), 1)
    table.upsert(rows(spark, (2, 9, "again")), 0)
    assert state(table) == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}
    table.upsert(rows(spark), 2)
    assert state(table_of(spark, str(tmp_path / "t"))) == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")} and table.ledger()["batch"] == 2


def test_failure_before_publication_is_not_seen(spark, tmp_path):
    table = table_of(spark, str(tmp_path / "t"))
    table.upsert(rows(spark, (1, 1, "a")), 0)

    def lost(batch):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        table.upsert(rows(spark, (1, 5, "half"), (2, 5, "half")), 1, lost)
    assert state(table) == {(1, 1, "a")}
    table.upsert(rows(spark, (1, 6, "whole")), 1)
    assert state(table) == {(1, 6, "whole")}
    with pytest.raises(Exception, match="another writer"):
        table._publish({"batch": 1, "versions": {}})


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    table, folder = table_of(spark, str(tmp_path / "t")), str(tmp_path / "in")
    seen = []

    def fails_once(batch):
        seen.append(batch)
        if seen == [0]:
            raise RuntimeError("lost")
    rows(spark, (1, 1, "a"), (2, 2, "b")).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    with pytest.raises(StreamingQueryException):
        table.take_in(stream, str(tmp_path / "c"), fails_once)
    assert state(table) == set()
    table.take_in(stream, str(tmp_path / "c"), fails_once)
    assert state(table) == {(1, 1, "a"), (2, 2, "b")} and seen == [0, 0]


def test_scan_that_ends_after_its_time(spark, tmp_path):
    """A late end is a failure whether it comes with its start or a batch later, and reports once."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, "started", "2024-01-01 00:00:00"), (2, "started", "2024-01-01 00:00:00"), (2, "finished", "2024-01-01 00:10:00"),
                (3, "started", "2024-01-01 00:25:00")],
               [(1, "finished", "2024-01-01 00:30:00"), (3, "finished", "2024-01-01 00:34:59")], [(9, "other", "2024-01-03 00:00:00")], [(9, "other", "2024-01-05 00:00:00")]]
    for data in batches:
        events = spark.createDataFrame(data, "scan_id long, kind string, t string").select("scan_id", "kind", F.col("t").cast("timestamp").alias("ts"))
        events.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.scan_timeouts(spark.readStream.schema(events.schema).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start().awaitTermination()
    assert sorted((r["scan_id"], r["outcome"]) for r in spark.read.parquet(out).collect()) == [(1, "failed"), (2, "failed"), (3, "finished")]


def test_stored_days(spark, tmp_path):
    path = str(tmp_path / "findings")
    scans = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-02")], "scan_id long, d string").select(
        "scan_id", F.col("d").cast("date").alias("scan_date"))
    found = spark.createDataFrame([(1, "a", "pass"), (2, "a", "fail"), (3, "a", "warn")], "scan_id long, code string, status string")
    pages.write_findings(found, scans, path, "scan_id")
    # The second of January again: its rows are replaced, the first stays.
    pages.write_findings(found.filter("scan_id = 2").withColumn("status", F.lit("unknown")), scans, path, "scan_id")
    schema = StructType.fromDDL("scan_id long, code string, status string, fingerprint string, scan_date date")
    every = pages.read_days(spark, path, schema, "2024-01-01", "2024-01-31").collect()
    assert sorted((r["scan_id"], r["status"], str(r["scan_date"])) for r in every) == [(1, "pass", "2024-01-01"), (2, "unknown", "2024-01-02")]
    day = pages.read_days(spark, path, schema, "2024-01-02")
    assert [r["scan_id"] for r in day.collect()] == [2]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scan_date" in plan and plan.count("Exchange") == 0


def test_stored_documents_and_events(spark, tmp_path):
    docs = spark.createDataFrame([("s", 1, "x" * 3000)], "site string, page_id long, text string")
    scans = spark.createDataFrame([("s", 7)], "site string, scan_id long").withColumn("scan_date", F.lit("2024-02-03").cast("date"))
    pages.write_documents(docs, scans, str(tmp_path / "d"))
    pages.write_documents(docs, scans, str(tmp_path / "d"))
    assert [(r["scan_id"], len(r["text_excerpt"])) for r in spark.read.parquet(str(tmp_path / "d")).collect()] == [(7, 1000)]
    events = spark.createDataFrame([(1, "agent", "a"), (2, "stranger", "a"), (3, "user", None), (4, "cron", "b")], "event_id long, actor string, type string")
    events = events.withColumn("created_at", F.lit("2024-02-03 23:59:59").cast("timestamp"))
    pages.write_events(events, str(tmp_path / "e"))
    pages.write_events(events.filter("event_id = 4"), str(tmp_path / "e"))
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "e")).collect()) == [1, 4, 4]


def test_running_totals(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 13).alias("a"), (F.col("id") % 5).alias("v"))
    found = running_totals(df, [F.col("a").asc_nulls_first(), F.col("id").desc()], total=F.col("v"), n=F.lit(1))
    expected, total = {}, 0
    order = sorted(range(1000), key=lambda i: (i % 7 != 0, i % 13 if i % 7 else 0, -i))
    for n, i in enumerate(order, 1):
        total += i % 5
        expected[i] = (total, n)
    assert {r["id"]: (r["total"], r["n"]) for r in found.collect()} == expected
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    assert running_totals(df.limit(0), [F.col("id")], n=F.lit(1)).count() == 0
