"""Page source and the document, finding and event sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars, urls
from ..session import positions

EXCERPT_CHARS = 1000
# Files of one date are cut into so many parts at most.
DAY_FILES = 16


def read_pages(raw: DataFrame) -> DataFrame:
    """A table of fetched pages (page_id, url, html and optionally final_url, status_code, content_type, site,
    position) in the columns the extraction reads. Non-HTML answers are left out; a missing status means 200.
    """
    have = set(raw.columns)
    pages = raw
    if "content_type" in have:
        kind = F.lower(F.coalesce("content_type", F.lit("")))
        pages = pages.filter((kind == "") | kind.contains("text/html") | kind.contains("application/xhtml"))
    final = F.col("final_url") if "final_url" in have else F.col("url")
    pages = pages.withColumns({
        "final_url": final,
        "status_code": F.col("status_code") if "status_code" in have else F.lit(200)})
    if "site" not in have:
        pages = pages.withColumn("site", urls.site_key(urls.parse(F.col("final_url"))))
    if "position" not in have:
        # Rank the narrow keys, then bring the rank to the pages: the markup is not sorted.
        ranks = positions(pages.select("site", "page_id"), ["site"], "page_id")
        pages = pages.join(ranks.select("page_id", "position"), "page_id")
    return pages.select("page_id", "site", F.col("position").cast("long").alias("position"), "url", "final_url",
                        "status_code", "html")


def with_order(raw: DataFrame) -> DataFrame:
    """Like ``read_pages`` with page_id itself as the order: no rank is computed, so the job stays narrow."""
    return read_pages(raw.withColumn("position", F.col("page_id")))


def document_rows(documents: DataFrame) -> DataFrame:
    """Stored form of documents: the first 1,000 characters of text instead of all of it."""
    return documents.withColumn("text_excerpt", F.substring("text", 1, EXCERPT_CHARS)).drop("text")


def _write_days(rows: DataFrame, path: str) -> None:
    """Write rows by ``scan_date``. The dates they hold are replaced, others stay, so a job that runs again leaves one copy.

    Rows are dealt by date and, since one date may hold most of them, by ``DAY_FILES`` further parts.
    """
    spread = rows.withColumn("_part", F.pmod(F.xxhash64(*[c for c in rows.columns if c in ("scan_id", "site", "page_id")]), F.lit(DAY_FILES)))
    (spread.repartition("scan_date", "_part").drop("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("scan_date").parquet(path))


def read_days(spark: SparkSession, path: str, schema: StructType, first: str, last: str | None = None) -> DataFrame:
    """Stored rows of the dates from ``first`` to ``last``; folders of other dates are not listed or read."""
    return spark.read.schema(schema).parquet(path).filter(
        F.col("scan_date").between(F.lit(first).cast("date"), F.lit(last or first).cast("date")))


def write_documents(documents: DataFrame, scans: DataFrame, path: str) -> None:
    """Documents by the date of their scan. ``scans``: (site, scan_id, scan_date)."""
    _write_days(document_rows(documents).join(scans, "site"), path)


def finding_rows(findings: DataFrame, scans: DataFrame, key: str = "site") -> DataFrame:
    """Findings as stored: scan, report position and fingerprint. ``scans``: (site, scan_id, scan_date), or by ``key``."""
    rows = findings.join(scans, key)
    if "fingerprint" not in findings.columns:
        rows = rows.withColumn("fingerprint", F.lit(None).cast("string"))
    if "evidence" in findings.columns:
        rows = rows.withColumn("fingerprint", F.coalesce("fingerprint", scalars.fingerprint(F.col("code"), F.col("status"), F.col("evidence.url"))))
    return rows


def write_findings(findings: DataFrame, scans: DataFrame, path: str, key: str = "site") -> None:
    """Findings by the date of their scan; the dates of ``scans`` are replaced."""
    _write_days(finding_rows(findings, scans, key), path)


ACTORS = ["agent", "user", "system", "cron", "webhook"]


def event_rows(events: DataFrame) -> DataFrame:
    """Valid rows of the append-only event log; actors outside the known list are not logged."""
    return events.filter(F.col("actor").isin(*ACTORS) & F.col("type").isNotNull())


def write_events(events: DataFrame, path: str) -> None:
    """Events are only ever added, in folders by the UTC day they were created."""
    rows = event_rows(events).withColumn("event_day", F.to_date("created_at"))
    rows.repartition("event_day", F.pmod("event_id", F.lit(DAY_FILES))).write.mode("append").partitionBy("event_day").parquet(path)
