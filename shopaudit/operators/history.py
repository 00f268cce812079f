"""Operators over scan history: summaries, latest scans, trends, open issues, differences, notes, reports."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trim_all
from ..session import first_by, positions
from ..vocab import copy

STATUSES = ["pass", "fail", "warn", "unknown"]
NOTE_STATES = ["open", "fixed", "not_applicable"]
NOTE_CHARS = 1000

# Fixed order of checks as a column, and its inverse.
_RANK = {code: i for i, code in enumerate(copy.CODES)}


def code_rank(code: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), _RANK.items(), F.when(F.lit(False), 0)).otherwise(len(_RANK))


def weight(severity: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(severity == kv[0], kv[1]), copy.WEIGHT.items(), F.when(F.lit(False), 0)).otherwise(0)


def summaries(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """Counts per status and the weighted sum of fails; one partial aggregation over four columns."""
    status = F.col("status")
    count = lambda s: F.count_if(status == s)
    return findings.groupBy(key).agg(
        count("fail").alias("issues"), count("warn").alias("warnings"), count("unknown").alias("unknowns"),
        count("pass").alias("passes"),
        F.sum(F.when(status == "fail", weight(F.col("severity"))).otherwise(0)).cast("long").alias("weighted_score"))


def verdict(status: Column, issues: Column, warnings: Column, unknowns: Column) -> Column:
    """``struct<tone,label>`` of a scan: its state while it runs, else the worst status in it."""
    many = lambda n, one: F.when(n == 1, F.lit(one)).otherwise(F.lit(one + "s"))
    pair = lambda tone, label: F.struct(F.lit(tone).alias("tone"), (label if isinstance(label, Column) else F.lit(label)).alias("label"))
    return (F.when(status == "queued", pair("pending", "Queued")).when(status == "running", pair("pending", "Running"))
            .when(status == "failed", pair("muted", "Scan failed")).when(issues.isNull(), pair("muted", "No result"))
            .when(issues > 0, pair("fail", many(issues, "Issue"))).when(warnings > 0, pair("warn", many(warnings, "Warning")))
            .when(unknowns > 0, pair("unknown", "Unknowns")).otherwise(pair("pass", "No issues found")))


def trend(score: Column, warnings: Column, before_score: Column, before_warnings: Column) -> Column:
    """better / worse / same / none: weighted score first, then warnings."""
    now, before = F.struct(score, warnings), F.struct(before_score, before_warnings)
    return (F.when(score.isNull() | before_score.isNull(), "none").when(now < before, "better")
            .when(now > before, "worse").otherwise("same"))


def _newest_first() -> list[Column]:
    return [F.col("finished_at").desc_nulls_last(), F.col("created_at").desc(), F.col("scan_id").desc()]


def finished_scans(scans: DataFrame) -> DataFrame:
    return scans.filter(F.col("site_id").isNotNull() & (F.col("status") == "done"))


def latest_finished(scans: DataFrame, count: int = 2) -> DataFrame:
    """The latest finished scans of every site with their place ``rn``. Tasks prune to ``count`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("org_id", "site_id").orderBy(*_newest_first()))
    return finished_scans(scans).withColumn("rn", rank).filter(F.col("rn") <= count)


def latest_pair(scans: DataFrame) -> DataFrame:
    """One row per site: latest and previous finished scan."""
    pick = lambda n: F.max(F.when(F.col("rn") == n, F.col("scan_id")))
    return latest_finished(scans, 2).groupBy("org_id", "site_id").agg(pick(1).alias("latest"), pick(2).alias("previous"))


def trends(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Trend of every site between its two latest finished scans."""
    pairs = latest_pair(scans)
    wanted = pairs.select(F.explode(F.array("latest", "previous")).alias("scan_id")).filter(F.col("scan_id").isNotNull())
    # Only findings of the scans in question are aggregated.
    sums = summaries(findings.join(wanted, "scan_id", "left_semi")).select("scan_id", "weighted_score", "warnings")
    side = lambda name, p: sums.select(F.col("scan_id").alias(name), F.col("weighted_score").alias(f"{p}score"),
                                       F.col("warnings").alias(f"{p}warnings"))
    return (pairs.join(side("latest", ""), "latest", "left").join(side("previous", "before_"), "previous", "left")
            .withColumn("trend", trend(F.col("score"), F.col("warnings"), F.col("before_score"), F.col("before_warnings"))))


def open_fails(scans: DataFrame, findings: DataFrame, notes: DataFrame, severities=("high",)) -> DataFrame:
    """Fails in the latest finished scan of each site that no note marks as fixed or not applicable."""
    latest = latest_finished(scans, 1).select("org_id", "site_id", "scan_id")
    fails = findings.filter((F.col("status") == "fail") & F.col("severity").isin(*severities))
    settled = notes.filter(F.col("state") != "open")
    return fails.join(latest, "scan_id").join(settled, ["org_id", "site_id", "code", "fingerprint"], "left_anti")


def open_fail_counts(scans: DataFrame, findings: DataFrame, notes: DataFrame, severities=("high",)) -> DataFrame:
    return open_fails(scans, findings, notes, severities).groupBy("org_id").agg(F.count("*").alias("open_fails"))


def scan_findings(scans: DataFrame, findings: DataFrame, org) -> DataFrame:
    """Findings of the scans of one tenant in report order; ``org`` None means anonymous scans."""
    own = scans.filter(tenant(F.col("org_id"), F.lit(org).cast(scans.schema["org_id"].dataType)))
    return findings.join(own.select("scan_id"), "scan_id", "left_semi").orderBy("scan_id", "position")


def tenant(column: Column, org: Column) -> Column:
    return column.eqNullSafe(org)


# ---- differences between scans ----------------------------------------------------------------------------------

def first_per_check(findings: DataFrame) -> DataFrame:
    """The first finding of each check in a scan, by position."""
    return first_by(findings, ["scan_id", "code"], [F.col("position")])


def is_problem(status: Column) -> Column:
    return F.coalesce(status.isin("fail", "warn"), F.lit(False))


def differences(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Check-by-check change between two scans. ``pairs``: (site_id, latest, previous).

    new: a problem that was none; resolved: a problem that passes or is gone; changed: the status moved otherwise or
    a problem has other evidence; unchanged: the rest.
    """
    keys = pairs.filter(F.col("latest").isNotNull() & F.col("previous").isNotNull()).select("site_id", "latest", "previous")
    sides = keys.select("site_id", "latest", F.explode(F.array(
        F.struct(F.col("latest").alias("scan_id"), F.lit("after").alias("side")),
        F.struct(F.col("previous").alias("scan_id"), F.lit("before").alias("side")))).alias("s")).select("site_id", "latest", "s.*")
    # Both sides of a pair meet in one aggregation per (site, check) instead of a full join of two tables.
    rows = first_per_check(findings.join(sides.select("scan_id").distinct(), "scan_id", "left_semi")).join(sides, "scan_id")
    value = F.struct("status", "fingerprint", "title", "severity")
    joined = rows.groupBy("site_id", F.col("latest").alias("scan_id"), "code").agg(
        F.max(F.when(F.col("side") == "before", value)).alias("b"), F.max(F.when(F.col("side") == "after", value)).alias("a"))
    b, a = F.col("b.status"), F.col("a.status")
    change = (F.when(~is_problem(b) & is_problem(a), "new")
              .when(is_problem(b) & ((a == "pass") | a.isNull()), "resolved")
              .when(F.col("b").isNull() | F.col("a").isNull(), "unchanged")
              .when((a != b) | (is_problem(a) & (F.col("b.fingerprint") != F.col("a.fingerprint"))), "changed")
              .otherwise("unchanged"))
    return joined.select("site_id", "scan_id", "code", F.coalesce("a.title", "b.title").alias("title"),
                         F.coalesce("a.severity", "b.severity").alias("severity"), b.alias("before"), a.alias("after"),
                         change.alias("change"))


def change_counts(diff: DataFrame) -> DataFrame:
    kinds = ["new", "resolved", "changed", "unchanged"]
    return (diff.groupBy("site_id", "scan_id").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds])
            .withColumn("has_changes", F.col("new") + F.col("resolved") + F.col("changed") > 0))


# ---- reports ----------------------------------------------------------------------------------------------------

def report_matrix(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """All nine checks of every finished scan; a missing one has no status, a passing EU signal shows as info.

    Each scan's findings meet in one aggregation that emits nine rows, so no scan-by-check product is shuffled.
    """
    done = scans.filter(F.col("status") == "done").select("scan_id")
    codes = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("code"), F.lit(copy.TITLES[c]).alias("title"))
                      for i, c in enumerate(copy.CODES)])
    first = findings.groupBy("scan_id", "code").agg(F.max_by("status", "position").alias("status"))
    per_scan = first.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("code", "status"))).alias("by_code"))
    rows = done.join(per_scan, "scan_id", "left").select("scan_id", "by_code", F.explode(codes).alias("c"))
    status = F.element_at("by_code", F.col("c.code"))
    return rows.select("scan_id", "c.position", "c.code", "c.title", status.alias("status"), F.when(
        (F.col("c.code") == "eu_targeting") & (status == "pass"), "info").otherwise(status).alias("shown"))


def reports(scans: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Scan with its pages (at most one crawl plan) and findings (nine), both in order."""
    page_list = pages.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("position", "url", "kind"))).alias("pages"))
    found = findings.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("position", "code", "status"))).alias("findings"))
    return scans.join(page_list, "scan_id", "left").join(found, "scan_id", "left")


def report_rows(scans: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages and findings of each scan as a long table: (scan_id, part, place, url, code, status), for scans of any size."""
    own = scans.select("scan_id")
    page_rows = pages.select(
        "scan_id", F.lit("page").alias("part"), F.col("position").cast("long").alias("order"), "url",
        F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("status"))
    found = findings.select(
        "scan_id", F.lit("finding").alias("part"), F.col("position").cast("long").alias("order"), F.lit(None).cast("string").alias("url"), "code", "status")
    ranked = positions(page_rows.unionByName(found).join(own, "scan_id", "left_semi"), ["scan_id", "part"], "order", "place")
    return ranked.select("scan_id", "part", "place", "url", "code", "status")


def newest(rows: DataFrame, keys: list[str], limit: int, order: str = "created_at", tie: str = "scan_id") -> DataFrame:
    """Newest-first listing per key, cut to ``limit``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie).desc()))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= limit)


# ---- notes ------------------------------------------------------------------------------------------------------

NOTE_KEY = ["org_id", "site_id", "code", "fingerprint"]


def _note_problem() -> Column:
    text = F.coalesce(trim_all(F.col("note")), F.lit(""))
    return (F.when(~F.coalesce(F.col("state").isin(*NOTE_STATES), F.lit(False)), "state").when(F.length(text) > NOTE_CHARS, "too_long")
            .when((F.col("state") == "not_applicable") & (text == ""), "reason_missing"))


def rejected_notes(changes: DataFrame) -> DataFrame:
    return changes.withColumn("problem", _note_problem()).filter(F.col("problem").isNotNull())


def accepted_notes(changes: DataFrame) -> DataFrame:
    """Valid changes as they are kept: blank text is no text. Works on batches and streams."""
    return changes.filter(_note_problem().isNull()).withColumn("note", F.nullif(trim_all(F.col("note")), F.lit("")))


def merged_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes after valid changes: the last one per finding of a site wins, blank text is no text."""
    valid = changes.filter(_note_problem().isNull())
    text = F.nullif(trim_all(F.col("note")), F.lit(""))
    both = notes.unionByName(valid.select(*notes.columns)).withColumn("note", text)
    return first_by(both, NOTE_KEY, [F.col("updated_at").desc(), F.col("seq").desc()])


def carried_notes(scans: DataFrame, findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Findings of site scans with the note their check and fingerprint carry over."""
    own = findings.join(scans.select("scan_id", "org_id", "site_id"), "scan_id")
    return own.join(notes.select(*NOTE_KEY, "state", "note"), NOTE_KEY, "left")


CLAIMS = "array<struct<url:string,quote:string,source:string,rule:string,reason:string,rewording:string>>"


def stated_claims(findings: DataFrame) -> DataFrame:
    """Findings of an audit with the ``claims`` their metadata lists; NULL for checks other than the environmental one."""
    meta = F.from_json("meta", f"v struct<claims:{CLAIMS}>")
    return findings.withColumn("claims", F.when(F.col("code") == "green_claims", meta["v"]["claims"]))


def claim_origins(findings: DataFrame) -> DataFrame:
    """Evidence of environmental claims with who flagged it, matched by place and equal quote.

    ``claims``: array<struct<quote,source,reason>> in the order of ``evidence``, as ``stated_claims`` reads them.
    """
    claim = F.get("claims", F.col("o"))
    aligned = (F.col("code") == "green_claims") & (claim["quote"] == F.col("e.quote"))
    owner = "scan_id" if "scan_id" in findings.columns else "site"
    return findings.select(owner, "code", F.posexplode("evidence").alias("o", "e"), "claims").select(
        owner, "code", "o", "e.url", "e.quote",
        F.when(aligned, F.when(claim["source"] == "rule", "rule").otherwise("model")).alias("source"),
        F.when(aligned, claim["reason"]).alias("reason"))


