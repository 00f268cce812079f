import importlib

from pyspark.sql import functions as F

from shopaudit.operators import crawl, history
from shopaudit.session import positions
from shopaudit.streaming import jobs


def test_differences_cover_every_branch(spark):
    before = {"a": ("pass", "1"), "b": ("fail", "1"), "c": ("warn", "1"), "d": ("fail", "1"), "f": ("pass", "1"), "g": ("fail", "1"), "h": ("warn", "1")}
    after = {"a": ("fail", "2"), "b": ("pass", "1"), "c": ("warn", "2"), "d": ("warn", "1"), "e": ("warn", "1"), "f": ("pass", "1"), "h": ("unknown", "1")}
    rows = [(scan, code, s, p, "t", "low", 0) for scan, side in ((1, before), (2, after)) for code, (s, p) in side.items()]
    findings = spark.createDataFrame(rows, "scan_id int, code string, status string, fingerprint string, title string, severity string, position int")
    pairs = spark.createDataFrame([(9, 2, 1)], "site_id int, latest int, previous int")
    got = {r["code"]: r["change"] for r in history.differences(pairs, findings).collect()}
    assert got == {"a": "new", "b": "resolved", "c": "changed", "d": "changed", "e": "new", "f": "unchanged", "g": "resolved", "h": "changed"}


def test_positions_of_a_cut_group_equal_the_plain_rank(spark):
    df = spark.range(0, 500).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("k"), (F.col("id") * F.col("id")).alias("o"))
    got = {(r["k"], r["o"]): r["position"] for r in positions(df, ["k"], "o", target=20).collect()}
    groups = {}
    for k, o in sorted(got):
        groups.setdefault(k, []).append(o)
    assert all(got[k, o] == i for k, os in groups.items() for i, o in enumerate(os)) and len(got) == 500


def test_an_address_takes_one_slot_and_a_full_slot_uses_none_up(spark):
    rows = [("s", "terms", "u1", 0, 0), ("s", "terms", "u2", 0, 1), ("s", "privacy", "u1", 0, 2), ("s", "privacy", "u2", 0, 3)]
    rows += [("s", "product", f"p{i}", 1, i) for i in range(30)]
    got = crawl.fill_slots(spark.createDataFrame(rows, "site string, slot string, url string, o1 long, o2 long")).orderBy("rank").collect()
    assert [(r["slot"], r["url"]) for r in got] == [("terms", "u1"), ("privacy", "u2")] + [("product", f"p{i}") for i in range(4)]


def test_scan_timeouts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "started", "2024-01-01 00:00:00"), (1, "finished", "2024-01-01 00:05:00"), (2, "started", "2024-01-01 00:01:00"), (9, "other", "2024-01-01 02:00:00")]
    events = spark.createDataFrame(rows, "scan_id long, kind string, t string").select("scan_id", "kind", F.col("t").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(folder)
    stream = jobs.scan_timeouts(spark.readStream.schema(events.schema).parquet(folder))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["scan_id"], r["outcome"]) for r in spark.read.parquet(out).collect()} == {(1, "finished"), (2, "failed")}


def test_scan_that_ends_before_it_starts(spark, tmp_path):
    """The end arrives one batch before the start, both within the delay: one row, finished."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, "finished", "2024-01-01 00:05:00")], [(1, "started", "2024-01-01 00:04:30")], [(9, "other", "2024-01-01 02:00:00")],
               [(9, "other", "2024-01-01 03:00:00")]]
    for rows in batches:
        events = spark.createDataFrame(rows, "scan_id long, kind string, t string").select("scan_id", "kind", F.col("t").cast("timestamp").alias("ts"))
        events.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.scan_timeouts(spark.readStream.schema(events.schema).parquet(folder))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [(r["scan_id"], r["outcome"], r["started_at"] is not None) for r in spark.read.parquet(out).collect()] == [(1, "finished", True)]


def test_slug_expands_ligatures(spark):
    from shopaudit.functions import text
    rows = spark.createDataFrame([("ﬁsh & Chips",), ("½ price ﬁ ol",), ("Straße",)], "t string").select(text.slug(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["fish-chips", "1-2-price-fi-ol", "stra-e"]


def test_every_statement_belongs_to_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
