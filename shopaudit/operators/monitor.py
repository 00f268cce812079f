"""Re-scan planning, outcomes, alerts and digests. ``now`` is an argument of every operator that needs the time."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import next_run, payload_text, scan_time
from ..session import first_by, positions, running_totals
from . import history
from .limits import MOST_MONITORED, plan_limit

# Due sites per run, re-scans per run, days a started re-scan is waited for, minutes until a scan is stale.
DUE_LIMIT = 100
STARTS_PER_RUN = 5
PENDING_DAYS = 14
STALE_MINUTES = 10
STARTED = "monitor.scan_started"
PROCESSED = "monitor.scan_processed"


def instant(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def due_sites(sites: DataFrame, scans: DataFrame, now: str, limit: int | None = DUE_LIMIT) -> DataFrame:
    """Monitored sites never scanned, or whose last scan ended at least their interval ago; oldest first."""
    last = scans.select(F.col("scan_id").alias("last_scan_id"), "status",
                        scan_time(F.col("finished_at"), F.col("started_at"), F.col("created_at")).alias("scanned_at"),
                        F.lit(True).alias("found"))
    old = F.col("scanned_at") <= instant(now) - F.make_dt_interval(F.col("monitor_interval_days"))
    due = (sites.filter("monitor_enabled").join(last, "last_scan_id", "left")
           .filter(F.col("found").isNull() | (F.col("status").isin("done", "failed") & old)).drop("found"))
    if limit is None:
        return due
    return due.orderBy(F.col("scanned_at").asc_nulls_first(), F.col("created_at"), F.col("site_id")).limit(limit)


def eligible_sites(sites: DataFrame, orgs: DataFrame) -> DataFrame:
    """The oldest monitored sites of each organisation, as many as its plan covers."""
    rank = F.row_number().over(Window.partitionBy("org_id").orderBy("created_at", "site_id"))
    # The widest plan prunes every task before the shuffle; each organisation's own plan cuts afterwards.
    ranked = sites.filter("monitor_enabled").withColumn("rn", rank).filter(F.col("rn") <= MOST_MONITORED)
    plans = orgs.select("org_id", plan_limit(F.col("plan"), "monitored_sites").alias("covered"))
    return ranked.join(plans, "org_id").filter(F.col("rn") <= F.col("covered")).drop("rn", "covered")


def pending_rescans(events: DataFrame, scans: DataFrame, since: str) -> DataFrame:
    """Re-scans started since a date and not processed yet, with the state of their scan."""
    started = events.filter((F.col("type") == STARTED) & (F.col("entity_type") == "scan") & (F.col("created_at") >= instant(since))
                            & F.col("org_id").isNotNull())
    processed = events.filter(F.col("type") == PROCESSED).select("entity_id")
    return (started.join(processed, "entity_id", "left_anti")
            .select("org_id", F.col("entity_id").alias("scan_id"), payload_text(F.col("input"), "previousScanId").alias("previous_scan_id"),
                    F.col("created_at").alias("started_event_at"))
            .join(scans.select(F.col("scan_id"), "site_id", "status"), "scan_id"))


def tick_plan(due: DataFrame, eligible: DataFrame, pending: DataFrame, starts: int = STARTS_PER_RUN) -> DataFrame:
    """What a run does with each due site, oldest first: start it, or the first reason not to.

    Any number of due sites is ranked: the order is cut into ranges, so no task sees them all.
    """
    busy = pending.filter(F.col("status").isin("queued", "running")).select("site_id").distinct().withColumn("busy", F.lit(True))
    covered = eligible.select("site_id").distinct().withColumn("covered", F.lit(True))
    joined = due.join(busy, "site_id", "left").join(covered, "site_id", "left")
    free = F.col("busy").isNull() & F.col("covered").isNotNull()
    order = [F.col("scanned_at").asc_nulls_first(), F.col("created_at"), F.col("site_id")]
    numbered = running_totals(joined, order, n=free.cast("int"), due_rank=F.lit(1))
    return numbered.withColumn("action", F.when(F.col("busy").isNotNull(), "scan_in_progress").when(
        F.col("covered").isNull(), "over_plan_limit").when(F.col("n") > starts, "per_run_cap").otherwise("start"))


def outcomes(pending: DataFrame, scans: DataFrame, sites: DataFrame, orgs: DataFrame, counts: DataFrame,
             owners: DataFrame) -> DataFrame:
    """Outcome of each re-scan that ended. ``counts``: ``history.change_counts`` by scan; ``owners``: (org_id, email)."""
    done = pending.filter(F.col("status").isin("done", "failed"))
    previous = scans.select(F.col("scan_id").cast("string").alias("previous_scan_id"), F.col("status").alias("previous_status"))
    known_site = sites.select("org_id", "site_id", F.lit(True).alias("has_site"))
    plans = orgs.select("org_id", "plan", F.lit(True).alias("has_org"))
    joined = (done.join(known_site, ["org_id", "site_id"], "left").join(plans, "org_id", "left")
              .join(previous, "previous_scan_id", "left").join(counts.drop("site_id"), "scan_id", "left")
              .join(owners, "org_id", "left"))
    mailed = (F.col("plan") == "pro") & F.col("email").isNotNull()
    return joined.withColumn("outcome", F.when(F.col("has_site").isNull() | F.col("has_org").isNull(), "site_deleted")
                             .when(F.col("status") == "failed", "scan_failed")
                             .when(F.coalesce("previous_status", F.lit("")) != "done", "baseline")
                             .when(~F.coalesce("has_changes", F.lit(False)), "unchanged")
                             .when(mailed, "alerted").otherwise("alerted_no_email"))


def change_lists(diff: DataFrame) -> DataFrame:
    """(scan_id, new_list, resolved_list, changed_list): the changes of a re-scan by kind, in the order of the checks.

    A scan has at most one change per check, so each list is short.
    """
    change = F.struct(history.code_rank(F.col("code")).alias("r"), "code", "title", "severity", "before", "after")
    bare = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == kind, change))), lambda c: F.struct(
        c["code"], c["title"], c["severity"], c["before"], c["after"])).alias(f"{kind}_list")
    return diff.groupBy("scan_id").agg(bare("new"), bare("resolved"), bare("changed"))


def alerts(outcome: DataFrame, diff: DataFrame, sites: DataFrame) -> DataFrame:
    """Alert rows with a JSON payload for changed and failed re-scans.

    The payload of a changed one names both scans and the host, counts the changes and lists them by kind. ``diff``:
    ``history.differences`` of the re-scans with the scans before them.
    """
    changed = F.col("outcome").isin("alerted", "alerted_no_email")
    mail = F.when(F.col("outcome") == "alerted", "sent").when(F.col("plan") == "pro", "no_owner_email").otherwise("free_plan")
    told = (outcome.filter(changed | (F.col("outcome") == "scan_failed")).join(change_lists(diff), "scan_id", "left")
            .join(sites.select("org_id", "site_id", "hostname"), ["org_id", "site_id"], "left"))
    keep_nulls = {"ignoreNullFields": "false"}
    full = F.to_json(F.struct(
        F.col("scan_id").alias("scan"), F.col("previous_scan_id").cast("long").alias("previousScan"), "hostname",
        F.struct("new", "resolved", "changed").alias("counts"), F.col("new_list").alias("new"), F.col("resolved_list").alias("resolved"),
        F.col("changed_list").alias("changed"), mail.alias("email")), keep_nulls)
    failed = F.to_json(F.struct(F.col("scan_id").alias("scan"), "hostname"), keep_nulls)
    return told.select("org_id", "site_id", "scan_id", F.when(changed, "scan_diff").otherwise("scan_failed").alias("kind"),
                       F.when(changed, full).otherwise(failed).alias("payload"))


def outbox(outcome: DataFrame, mails: DataFrame) -> DataFrame:
    """Mails to send for re-scans with changes: (org_id, scan_id, to_email, subject, text). ``mails``: ``digests`` by scan."""
    return outcome.filter(F.col("outcome") == "alerted").select("org_id", "scan_id", F.col("email").alias("to_email")).join(
        mails.select("scan_id", "subject", "text"), "scan_id", "left")


def status_label(status: Column) -> Column:
    return (F.when(status == "fail", "issue").when(status == "warn", "warning").when(status.isin("unknown", "pass"), status)
            .otherwise("not reported"))


def digests(diff: DataFrame, sites: DataFrame) -> DataFrame:
    """Subject and text of the alert for each site with changes; a site has at most one line per check."""
    line = F.format_string("- %s (%s): %s → %s", "title", "code", status_label(F.col("before")), status_label(F.col("after")))
    lines = (diff.filter(F.col("change") != "unchanged")
             .groupBy("site_id", "scan_id", "change").agg(
                 F.count("*").alias("n"),
                 F.array_sort(F.collect_list(F.struct(history.code_rank(F.col("code")).alias("r"), line.alias("line"))))["line"].alias("lines"))
             .groupBy("site_id", "scan_id").agg(F.map_from_entries(F.collect_list(F.struct("change", F.struct("n", "lines")))).alias("m")))
    part = lambda k: F.element_at("m", k)
    counts = F.array_join(F.array_compact(F.array(*[
        F.when(part(k).isNotNull(), F.concat(part(k)["n"].cast("string"), F.lit(f" {k}"))) for k in ("new", "resolved", "changed")])), ", ")
    sections = F.array_compact(F.array(*[
        F.when(part(k).isNotNull(), F.concat(F.lit(k.capitalize() + ":\n"), F.array_join(part(k)["lines"], "\n")))
        for k in ("new", "resolved", "changed")]))
    return lines.join(sites.select("site_id", "hostname"), "site_id").select(
        "site_id", "scan_id", F.concat("hostname", F.lit(": "), counts, F.lit(" since the last scan")).alias("subject"),
        F.array_join(sections, "\n\n").alias("text"))


def expire_stale(scans: DataFrame, now: str) -> DataFrame:
    """Queued or running scans older than ten minutes count as failed."""
    since = F.coalesce("started_at", "created_at")
    stale = F.col("status").isin("queued", "running") & (since <= instant(now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(STALE_MINUTES)))
    return scans.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "expired": stale})


def purged_scans(scans: DataFrame, days: int, now: str) -> DataFrame:
    """Anonymous scans past their retention."""
    return scans.filter(F.col("org_id").isNull() & (F.col("created_at") < instant(now) - F.make_dt_interval(F.lit(days))))


def retained(scans: DataFrame, children: DataFrame, days: int, now: str) -> tuple[DataFrame, DataFrame]:
    """Scans that stay, and the child rows of these."""
    gone = purged_scans(scans, days, now).select("scan_id")
    keep = ~(F.col("org_id").isNull() & (F.col("created_at") < instant(now) - F.make_dt_interval(F.lit(days))))
    return scans.filter(keep), children.join(gone, "scan_id", "left_anti")


def delete_sites(gone: DataFrame, scans: DataFrame, notes: DataFrame, alert_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After deleting sites: scans stay without their site, notes and alerts go."""
    ids = gone.select("site_id").distinct().withColumn("deleted", F.lit(True))
    kept = scans.join(ids, "site_id", "left").withColumn(
        "site_id", F.when(F.col("deleted").isNull(), F.col("site_id"))).drop("deleted")
    drop = ids.select("site_id")
    return kept, notes.join(drop, "site_id", "left_anti"), alert_rows.join(drop, "site_id", "left_anti")


def attach_sites(scans: DataFrame, sites: DataFrame) -> DataFrame:
    """Site of a scanned address by organisation and host name."""
    by_host = first_by(sites.select("org_id", "hostname", F.col("site_id").alias("found_site")), ["org_id", "hostname"], [F.col("found_site")])
    return scans.join(by_host, ["org_id", "hostname"], "left")


def advance_pointers(sites: DataFrame, scans: DataFrame) -> DataFrame:
    """Sites with ``last_scan_id`` at the scan that finished last."""
    last = (scans.filter(F.col("finished_at").isNotNull() & F.col("site_id").isNotNull())
            .groupBy("org_id", "site_id").agg(F.max(F.struct("finished_at", "scan_id"))["scan_id"].alias("newest")))
    return sites.join(last, ["org_id", "site_id"], "left").withColumn(
        "last_scan_id", F.coalesce("newest", "last_scan_id")).drop("newest")


def overview(sites: DataFrame, orgs: DataFrame, scans: DataFrame, now: str) -> DataFrame:
    """Every site with its two latest scans, monitor state and next run."""
    covered = eligible_sites(sites, orgs).select("site_id", F.lit(True).alias("covered"))
    last = scans.select(F.col("scan_id").alias("last_scan_id"),
                        scan_time(F.col("finished_at"), F.col("started_at"), F.col("created_at")).alias("scanned_at"))
    state = F.when(~F.col("monitor_enabled"), "off").when(F.col("covered"), "on").otherwise("paused")
    return (sites.join(history.latest_pair(scans), ["org_id", "site_id"], "left").join(covered, "site_id", "left")
            .join(last, "last_scan_id", "left").withColumn("monitor", state)
            .withColumn("next_run", F.when(F.col("monitor") == "on", next_run(
                F.col("scanned_at"), F.col("monitor_interval_days"), instant(now)))))


def dashboard(over: DataFrame, orgs: DataFrame, findings: DataFrame, open_counts: DataFrame, quota: DataFrame) -> DataFrame:
    """One row per organisation: monitors, open issues, warnings, scans this month, next re-scan."""
    latest = over.filter(F.col("latest").isNotNull()).select("org_id", F.col("latest").alias("scan_id"))
    warnings = (findings.filter(F.col("status") == "warn").join(latest, "scan_id")
                .groupBy("org_id").agg(F.count("*").alias("warnings")))
    per_org = over.groupBy("org_id").agg(
        F.count_if(F.col("monitor") == "on").alias("active_monitors"), F.count_if("monitor_enabled").alias("monitors_on"),
        F.min(F.when(F.col("next_run").isNotNull(), F.struct("next_run", "hostname")))["hostname"].alias("next_site"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    return (orgs.select("org_id", "plan").join(per_org, "org_id", "left").join(warnings, "org_id", "left")
            .join(open_counts, "org_id", "left").join(quota.select("org_id", "used"), "org_id", "left")
            .select("org_id", zero("active_monitors"), plan_limit(F.col("plan"), "monitored_sites").alias("monitor_limit"),
                    zero("monitors_on"), zero("open_fails"), zero("warnings"), zero("used"), "next_site"))


def owner_emails(memberships: DataFrame) -> DataFrame:
    """Address of the earliest owner of each organisation."""
    return (memberships.filter(F.col("role") == "owner").groupBy("org_id")
            .agg(F.min(F.struct("created_at", "email"))["email"].alias("email")))


def call_totals(calls: DataFrame, key: str) -> DataFrame:
    """Model-call metadata of a scan in one row: distinct models in first-use order, first prompt version, sums."""
    first = calls.groupBy(key, "model").agg(F.min("seq").alias("seq"))
    models = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "model")))["model"], ",").alias("model"))
    sums = calls.groupBy(key).agg(F.min_by("prompt_version", "seq").alias("prompt_version"), *[
        F.sum(c).cast("long").alias(c) for c in ("tokens_in", "tokens_out", "latency_ms", "attempts")])
    return sums.join(models, key)


def model_rows(calls: DataFrame, key: str) -> DataFrame:
    """Models of a scan's calls in the order of first use as a long table: (key, place, model, calls)."""
    used = calls.groupBy(key, "model").agg(F.min("seq").alias("seq"), F.count("*").alias("calls"))
    return positions(used, [key], "seq", "place").select(key, "place", "model", "calls")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once although they should be unique. Keys with a NULL never clash."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that name a parent which is not there. Rows without a parent's name are none."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def integrity(sites: DataFrame, notes: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """(rule, key, n): what the keys of the stored tables forbid. One row per clash of a unique key, one per missing parent.

    Unique are organisation and host name of a site, the place of a note, and the public id of a scan; findings need their
    scan, scans and notes their site.
    """
    def clash(rule: str, df: DataFrame, keys: list[str]) -> DataFrame:
        return duplicates(df, keys).select(F.lit(rule).alias("rule"), F.concat_ws("|", *keys).alias("key"), "n")

    def missing(rule: str, children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        return orphans(children, parents, key).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(
            F.lit(rule).alias("rule"), "key", "n")
    return (clash("site_host", sites, ["org_id", "hostname"]).unionByName(clash("note", notes, history.NOTE_KEY))
            .unionByName(clash("public_id", scans, ["public_id"])).unionByName(missing("finding_scan", findings, scans, "scan_id"))
            .unionByName(missing("scan_site", scans, sites, "site_id")).unionByName(missing("note_site", notes, sites, "site_id")))


