"""Scan timeouts that keep many scans in one group of state."""
from pyspark.sql import functions as F

from shopaudit.streaming import jobs


def test_many_scans_share_a_group_of_state(spark, tmp_path):
    """Three groups for 60 scans over three batches; ids beyond 2^53 stay exact, a scan without an id is one scan."""
    big = 2 ** 60
    start, late = "2024-01-01 00:00:00", "2024-01-01 00:00:50"
    first = [(big + i, "started", start) for i in range(60)] + [(big + i, "finished", "2024-01-01 00:05:00") for i in range(20)] + [(None, "started", start)]
    second = [(big + i, "finished", "2024-01-01 00:09:59") for i in range(20, 30)] + [(big + i, "finished", "2024-01-01 00:10:00") for i in range(30, 40)]
    second += [(big + 100 + i, "finished", "2024-01-01 00:05:00") for i in range(5)] + [(big + 200, None, late)]
    third, fourth = [(1, "other", "2024-01-01 03:00:00")], [(1, "other", "2024-01-03 03:00:00")]
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    groups = set()
    for rows in (first, second, third, fourth):
        events = spark.createDataFrame(rows, "scan_id long, kind string, t string").select("scan_id", "kind", F.col("t").cast("timestamp").alias("ts"))
        events.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.scan_timeouts(spark.readStream.schema(events.schema).parquet(folder), groups=3)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        groups.update(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    got = sorted((r["scan_id"] or 0, r["outcome"], r["started_at"] is None) for r in spark.read.parquet(out).collect())
    expected = [(big + i, "finished" if i < 30 else "failed", False) for i in range(60)] + [(0, "failed", False)] + [
        (big + 100 + i, "finished", True) for i in range(5)]
    assert got == sorted(expected)
    assert max(groups) <= 4 and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
