"""Queries over scan history: orders as scans, lineitem as findings, customer as sites, nation as organisations."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars
from ..operators import history, limits, monitor
from ..session import new_path, stored
from ..sources import adapters as a
from ..sources import pages
from ..vocab import copy

NOW = "2001-08-01 12:00:00"
QUOTA_NOW = "2001-07-20 00:00:00"
SINCE = "2001-07-01 00:00:00"

CODES = "['" + "','".join(copy.CODES) + "']"
SEVERITIES = "['" + "','".join(copy.SEVERITY[c] for c in copy.CODES) + "']"
TITLES = "['" + "','".join(copy.TITLES[c] for c in copy.CODES) + "']"
PRINT = "substr(replace(replace(base64(unhex(sha256('[\"'||code||'\",\"'||status||'\",[\"'||url||'\"]]'))),'+','-'),'/','_'),1,22)"
# The engine's tables, restated in SQL.
TABLES = f"""
WITH scans AS (SELECT o_orderkey scan_id, CASE WHEN c_nationkey<>0 THEN c_nationkey END org_id,
   CASE WHEN c_nationkey<>0 THEN o_custkey END site_id,
   CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END status, o_orderdate created_at,
   CASE WHEN o_orderkey%5<>0 THEN o_orderdate + INTERVAL 1 MINUTE END started_at,
   CASE WHEN o_orderstatus<>'O' AND o_orderkey%7<>0 THEN o_orderdate + INTERVAL 5 MINUTE END finished_at
   FROM orders JOIN customer ON o_custkey=c_custkey),
orgs AS (SELECT n_nationkey org_id, n_name AS name, CASE WHEN n_nationkey%3=0 THEN 'pro' ELSE 'free' END plan,
   CASE WHEN n_nationkey%2=0 THEN 'sub_'||n_nationkey END subscription_id,
   CASE WHEN n_nationkey%5<>0 THEN 'cus_'||n_nationkey END customer_id FROM nation WHERE n_nationkey<>0),
sites AS (SELECT c_custkey site_id, c_nationkey org_id, 'shop'||c_custkey||'.example' hostname,
   c_mktsegment IN ('BUILDING','MACHINERY') monitor_enabled, CASE WHEN c_mktsegment='BUILDING' THEN 30 ELSE 7 END gap,
   (SELECT o_orderkey FROM orders WHERE o_custkey=c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) last_scan_id,
   TIMESTAMP '1994-01-01' + to_days(CAST(c_custkey%365 AS INTEGER)) created_at FROM customer WHERE c_nationkey<>0),
raw_findings AS (SELECT l_orderkey scan_id, {CODES}[l_linenumber] code,
   CASE l_returnflag WHEN 'A' THEN 'fail' WHEN 'N' THEN 'pass' ELSE 'warn' END status, {SEVERITIES}[l_linenumber] severity,
   {TITLES}[l_linenumber] title, l_linenumber::BIGINT*1000000000+l_partkey*1000+l_suppkey%1000 AS "position",
   'https://shop.example/p/'||(l_partkey%10) url, l_linenumber line, l_partkey part, l_suppkey supp FROM lineitem),
findings AS (SELECT *, {PRINT} fingerprint FROM raw_findings),
raw_notes AS (SELECT s.org_id, s.site_id, code, fingerprint, ['open','fixed','not_applicable'][supp%3+1] state,
   CASE WHEN supp%5<>2 THEN 'note '||supp END note, created_at updated_at, scan_id*8+line k1, part k2, supp k3
   FROM findings JOIN scans s USING (scan_id) WHERE part%7=0 AND s.site_id IS NOT NULL),
notes AS (SELECT * FROM raw_notes WHERE state<>'not_applicable' OR note IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY org_id,site_id,code,fingerprint ORDER BY updated_at DESC,k1 DESC,k2 DESC,k3 DESC)=1),
done AS (SELECT *, row_number() OVER (PARTITION BY org_id,site_id ORDER BY finished_at DESC NULLS LAST, created_at DESC, scan_id DESC) rn
   FROM scans WHERE site_id IS NOT NULL AND status='done'),
pairs AS (SELECT org_id, site_id, max(CASE WHEN rn=1 THEN scan_id END) latest, max(CASE WHEN rn=2 THEN scan_id END) previous
   FROM done WHERE rn<=2 GROUP BY ALL),
sums AS (SELECT scan_id, count(*) FILTER (status='fail') issues, count(*) FILTER (status='warn') warnings,
   count(*) FILTER (status='unknown') unknowns, count(*) FILTER (status='pass') passes,
   CAST(sum(CASE WHEN status<>'fail' THEN 0 WHEN severity='high' THEN 3 WHEN severity='medium' THEN 2 ELSE 1 END) AS BIGINT) weighted_score
   FROM findings GROUP BY scan_id),
firsts AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY scan_id, code ORDER BY "position")=1),
eligible AS (SELECT site_id, org_id FROM (SELECT s.*, plan, row_number() OVER (PARTITION BY s.org_id ORDER BY created_at, site_id) r
   FROM sites s JOIN orgs USING (org_id) WHERE monitor_enabled) WHERE r <= CASE plan WHEN 'pro' THEN 10 ELSE 1 END),
site_last AS (SELECT t.*, sc.status, sc.scan_id found, coalesce(sc.finished_at, sc.started_at, sc.created_at) scanned_at
   FROM sites t LEFT JOIN scans sc ON sc.scan_id=t.last_scan_id),
due AS (SELECT * FROM site_last WHERE monitor_enabled AND (found IS NULL OR (status IN ('done','failed')
   AND scanned_at <= TIMESTAMP '{NOW}' - to_days(gap)))),
log_previous AS (SELECT *, last_value(CASE WHEN status='done' THEN scan_id END IGNORE NULLS) OVER (PARTITION BY site_id
   ORDER BY created_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prev FROM scans WHERE site_id IS NOT NULL),
pending AS (SELECT * FROM log_previous WHERE scan_id%3=0 AND scan_id%9<>0 AND created_at >= TIMESTAMP '{SINCE}'),
diff AS (SELECT p.site_id, p.latest scan_id, coalesce(x.code,y.code) code, coalesce(y.title,x.title) title,
   coalesce(y.severity,x.severity) severity, x.status before, y.status AS after,
   CASE WHEN coalesce(x.status,'') NOT IN ('fail','warn') AND coalesce(y.status,'') IN ('fail','warn') THEN 'new'
        WHEN coalesce(x.status,'') IN ('fail','warn') AND (y.status IS NULL OR y.status='pass') THEN 'resolved'
        WHEN x.status IS NULL OR y.status IS NULL THEN 'unchanged'
        WHEN x.status<>y.status OR (y.status IN ('fail','warn') AND x.fingerprint<>y.fingerprint) THEN 'changed' ELSE 'unchanged' END change
   FROM (SELECT site_id, latest, previous, unnest({CODES}) c FROM pairs WHERE previous IS NOT NULL) p
   LEFT JOIN firsts x ON x.scan_id=previous AND x.code=c LEFT JOIN firsts y ON y.scan_id=latest AND y.code=c
   WHERE x.code IS NOT NULL OR y.code IS NOT NULL)
"""


def _tables(spark, d):
    return a.scans(spark, d), a.orgs(spark, d), a.sites(spark, d), a.findings(spark, d)


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def site_summary(spark, d):
    return history.summaries(a.findings(spark, d))


def scan_verdict(spark, d):
    scans = a.scans(spark, d).join(history.summaries(a.findings(spark, d)), "scan_id", "left")
    v = history.verdict(F.col("status"), F.col("issues"), F.col("warnings"), F.col("unknowns"))
    return scans.select("scan_id", v["tone"].alias("tone"), v["label"].alias("label"))


def latest_scans(spark, d):
    return history.latest_finished(a.scans(spark, d), 3).select("site_id", "scan_id", F.col("rn").cast("long").alias("rn"))


def latest_two_scans(spark, d):
    return history.latest_pair(a.scans(spark, d))


def trend(spark, d):
    return history.trends(a.scans(spark, d), a.findings(spark, d)).select("site_id", "latest", "previous", "trend")


def _notes(spark, d):
    raw = a.notes(spark, d)
    return history.merged_notes(raw.limit(0), raw)


def open_fails(spark, d):
    return history.open_fail_counts(a.scans(spark, d), a.findings(spark, d), _notes(spark, d))


def tenant_findings(spark, d):
    """Findings of anonymous scans."""
    return history.scan_findings(a.scans(spark, d), a.findings(spark, d), None).select("scan_id", "code", "status", "position")


def scan_diff(spark, d):
    return history.differences(history.latest_pair(a.scans(spark, d)), a.findings(spark, d))


def scan_diff_counts(spark, d):
    return history.change_counts(scan_diff(spark, d))


def report_matrix(spark, d):
    return history.report_matrix(a.scans(spark, d), a.findings(spark, d)).withColumn("position", F.col("position").cast("long"))


def reports(spark, d):
    """Every scan with its findings in order."""
    scans = a.scans(spark, d)
    f = history.first_per_check(a.findings(spark, d))
    pages = f.select("scan_id", F.col("position"), F.get("urls", 0).alias("url"), F.lit("other").alias("kind"))
    r = history.reports(scans.select("scan_id"), pages, f)
    return r.select("scan_id", F.coalesce(F.to_json(F.col("findings.code")), F.lit("[]")).alias("codes"),
                    F.coalesce(F.to_json(F.col("pages.url")), F.lit("[]")).alias("urls"))


def report_rows(spark, d):
    """The same as rows: pages and findings of each scan with their place."""
    f = history.first_per_check(a.findings(spark, d))
    pages_ = f.select("scan_id", "position", F.get("urls", 0).alias("url"))
    return history.report_rows(a.scans(spark, d), pages_, f)


def newest_scans(spark, d):
    scans = a.scans(spark, d).filter(F.col("org_id").isNotNull())
    return history.newest(scans, ["org_id"], scalars.clamp_limit(None)).select("org_id", "scan_id", F.col("rn").cast("long").alias("rn"))


def notes_latest(spark, d):
    return _notes(spark, d).select("org_id", "site_id", "code", "fingerprint", "state", "note")


def notes_rejected(spark, d):
    return history.rejected_notes(a.notes(spark, d)).groupBy("org_id", "problem").agg(F.count("*").alias("n"))


def notes_carry(spark, d):
    return history.carried_notes(a.scans(spark, d), a.findings(spark, d), _notes(spark, d)).filter(
        F.col("state").isNotNull()).select("scan_id", "code", "position", "state", "note")


def due_sites(spark, d):
    scans, _, sites, _ = _tables(spark, d)
    return monitor.due_sites(sites, scans, NOW, None).select("site_id", stamp("scanned_at").alias("scanned_at"))


def eligible_sites(spark, d):
    _, orgs, sites, _ = _tables(spark, d)
    return monitor.eligible_sites(sites, orgs).select("org_id", "site_id")


def _pending(spark, d):
    return monitor.pending_rescans(a.rescan_log(spark, d), a.scans(spark, d), SINCE)


def pending_rescans(spark, d):
    return _pending(spark, d).select("org_id", "scan_id", "site_id", "previous_scan_id", "status", stamp("started_event_at").alias("started_at"))


def tick_plan(spark, d):
    scans, orgs, sites, _ = _tables(spark, d)
    plan = monitor.tick_plan(monitor.due_sites(sites, scans, NOW, None), monitor.eligible_sites(sites, orgs), _pending(spark, d))
    return plan.select("site_id", F.col("due_rank").cast("long").alias("due_rank"), "action")


def _pending_diff(spark, d):
    pairs = _pending(spark, d).select("site_id", F.col("scan_id").alias("latest"), F.col("previous_scan_id").cast("long").alias("previous"))
    return history.differences(pairs, a.findings(spark, d))


def _outcomes(spark, d, diff=None):
    scans, orgs, sites, _ = _tables(spark, d)
    counts = history.change_counts(_pending_diff(spark, d) if diff is None else diff)
    # Some sites were deleted after their re-scan began.
    kept = sites.join(a.deleted_sites(spark, d), "site_id", "left_anti")
    return monitor.outcomes(_pending(spark, d), scans, kept, orgs, counts, monitor.owner_emails(a.memberships(spark, d)))


def rescan_outcomes(spark, d):
    return _outcomes(spark, d).select("scan_id", "outcome", "email")


def alerts(spark, d):
    diff = stored(_pending_diff(spark, d), "pending_diff")
    return monitor.alerts(_outcomes(spark, d, diff), diff, a.sites(spark, d))


def outbox(spark, d):
    diff = stored(_pending_diff(spark, d), "pending_diff")
    return monitor.outbox(_outcomes(spark, d, diff), monitor.digests(diff, a.sites(spark, d))).select(
        "org_id", "scan_id", "to_email", "subject", F.md5("text").alias("text"))


def listings(spark, d):
    """Newest first, at most fifty: sites, scans that are done, and alerts of each organisation, and done scans of each site."""
    scans, _, sites, _ = _tables(spark, d)
    done = scans.filter((F.col("status") == "done") & F.col("org_id").isNotNull())
    warned = _outcomes(spark, d).filter(F.col("outcome").isin("alerted", "alerted_no_email", "scan_failed")).join(
        scans.select("scan_id", "created_at"), "scan_id")
    most = scalars.clamp_limit(None)
    rows = [("site", sites.withColumn("scan_id", F.col("site_id")), "org_id"), ("done", done, "org_id"), ("alert", warned, "org_id"), ("site_done", done, "site_id")]
    parts = [history.newest(df.select(F.col(owner).cast("long").alias("owner"), "scan_id", "created_at"), ["owner"], most).select(
        F.lit(kind).alias("kind"), "owner", F.col("scan_id").alias("id"), F.col("rn").cast("long").alias("rn")) for kind, df, owner in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def integrity(spark, d):
    """Clashes of unique keys and rows without their parent, where host names are shared, ids reused and sites deleted."""
    scans, _, sites, findings = _tables(spark, d)
    shared = sites.withColumn("hostname", F.concat(F.lit("shop"), (F.col("site_id") % 500).cast("string"), F.lit(".example")))
    named = scans.withColumn("public_id", F.concat(F.lit("r"), F.floor(F.col("scan_id") / 5).cast("string")))
    left = shared.join(a.deleted_sites(spark, d), "site_id", "left_anti")
    kept = named.filter("status <> 'failed'")
    notes = history.accepted_notes(a.notes(spark, d))
    return monitor.integrity(left, notes, kept, findings)


def alert_digest(spark, d):
    return monitor.digests(scan_diff(spark, d), a.sites(spark, d))


def scan_quota(spark, d):
    q = limits.scan_quota(a.orgs(spark, d), a.scans(spark, d), QUOTA_NOW)
    return q.select("org_id", "used", "limit", "remaining", stamp("resets_at").alias("resets_at"), "may_start")


def monitor_capacity(spark, d):
    _, orgs, sites, _ = _tables(spark, d)
    return limits.may_enable_monitoring(sites, limits.monitor_capacity(orgs, sites)).select("site_id", "used", "limit", "may_enable")


def _requests(spark, d):
    e = a.table(spark, d, "events").select("event_id", "ts", "user_id")
    at = F.col("ts").cast("timestamp")
    address = F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 50).cast("string"))
    return e.select(F.col("event_id").alias("request_id"), scalars.requester_hash(address, at).alias("requester_hash"), at.alias("created_at"))


def anonymous_limit(spark, d):
    return limits.anonymous_usage(_requests(spark, d).withColumn("org_id", F.lit(None).cast("int")))


def accepted_requests(spark, d):
    return limits.accepted_requests(_requests(spark, d)).select("request_id", "requester_hash")


def retention(spark, d):
    scans, f = a.scans(spark, d), a.findings(spark, d)
    kept, children = monitor.retained(scans, f, 30, NOW)
    purged = monitor.purged_scans(scans, 30, NOW)
    return kept.agg(F.count("*").alias("kept")).crossJoin(children.agg(F.count("*").alias("children"))).crossJoin(
        purged.agg(F.count("*").alias("purged")))


def stale_scans(spark, d):
    s = monitor.expire_stale(a.scans(spark, d), "1998-06-01 00:00:30")
    return s.select("scan_id", "status", "expired")


def next_run(spark, d):
    last = a.scans(spark, d).filter(F.col("scan_id") % 10 != 3).select("scan_id", scalars.scan_time(
        F.col("finished_at"), F.col("started_at"), F.col("created_at")).alias("t"))
    every = a.scans(spark, d).select("scan_id").join(last, "scan_id", "left")
    run = scalars.next_run(F.col("t"), (F.col("scan_id") % 40 + 1).cast("int"), F.lit("1998-03-05 07:30:00").cast("timestamp"))
    return every.select("scan_id", stamp(run).alias("next_run"))


def site_overview(spark, d):
    scans, orgs, sites, _ = _tables(spark, d)
    o = monitor.overview(sites, orgs, scans, NOW)
    return o.select("site_id", "latest", "previous", "monitor", stamp("next_run").alias("next_run"))


def dashboard(spark, d):
    scans, orgs, sites, findings = _tables(spark, d)
    quota = limits.scan_quota(orgs, scans, QUOTA_NOW)
    counts = history.open_fail_counts(scans, findings, _notes(spark, d))
    return monitor.dashboard(monitor.overview(sites, orgs, scans, NOW), orgs, findings, counts, quota)


def site_deletion(spark, d):
    scans, _, sites, _ = _tables(spark, d)
    gone = sites.filter(F.col("site_id") % 13 == 0)
    notes = _notes(spark, d)
    kept, left, _ = monitor.delete_sites(gone, scans, notes, notes)
    counts = kept.groupBy().agg(F.count("*").alias("scans"), F.count("site_id").alias("with_site"))
    return counts.crossJoin(left.groupBy().agg(F.count("*").alias("notes")))


def site_by_host(spark, d):
    sites = a.sites(spark, d)
    scans = a.scans(spark, d).filter(F.col("org_id").isNotNull()).withColumn("hostname", F.concat(
        F.lit("shop"), (F.col("site_id") + F.col("scan_id") % 2).cast("string"), F.lit(".example")))
    return monitor.attach_sites(scans, sites).select("scan_id", "found_site")


def uniqueness_audit(spark, d):
    f = a.findings(spark, d)
    return monitor.duplicates(f, ["scan_id", "code"])


def owner_contact(spark, d):
    return monitor.owner_emails(a.memberships(spark, d))


def subscription_match(spark, d):
    return limits.match_organisations(a.subscription_events(spark, d), a.orgs(spark, d)).select("event_id", "org_id")


def plan_sync(spark, d):
    c = limits.plan_changes(a.subscription_events(spark, d), a.orgs(spark, d))
    return c.select("event_id", "org_id", "result", "plan", "changed")


def synced_plans(spark, d):
    orgs = a.orgs(spark, d)
    return limits.synced_organisations(orgs, limits.plan_changes(a.subscription_events(spark, d), orgs)).select(
        "org_id", "plan", "subscription_id", "customer_id")


def _calls(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    calls = a.table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("model"), F.col("event_id").alias("seq"), F.lit("v1").alias("prompt_version"),
        k.alias("tokens_in"), (k * 2).alias("tokens_out"), (k % 10).alias("latency_ms"), F.lit(1).alias("attempts"))
    return calls


def call_totals(spark, d):
    return monitor.call_totals(_calls(spark, d), "user_id")


def call_models(spark, d):
    return monitor.model_rows(_calls(spark, d), "user_id")


def site_pointers(spark, d):
    return monitor.advance_pointers(a.sites(spark, d), a.scans(spark, d)).select("site_id", "last_scan_id")


def claim_origins(spark, d):
    rows = a.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    quote = lambda i: F.concat(F.lit("q"), (F.col("l_partkey") + i).cast("string"))
    url = F.lit("https://shop.example/")
    claims = F.array(*[F.struct(F.when(F.col("l_partkey") % (3 + i) != 0, quote(i)).otherwise("other").alias("quote"),
                                F.when(F.col("l_partkey") % 2 == i, "rule").otherwise("classifier").alias("source"),
                                F.concat(F.lit("r"), F.lit(i).cast("string")).alias("reason")) for i in (0, 1)])
    f = rows.select(F.col("l_orderkey").alias("scan_id"), F.when(F.col("l_linenumber") == 3, "green_claims").otherwise("other").alias("code"),
                    F.array(*[F.struct(url.alias("url"), quote(i).alias("quote")) for i in (0, 1, 2)]).alias("evidence"), claims.alias("claims"))
    return history.claim_origins(f).groupBy("code", F.col("o").cast("long").alias("place"), "source", "reason").agg(F.count("*").alias("n"))


def event_log(spark, d):
    """Rows the append-only event sink accepts."""
    from ..sources.pages import event_rows
    return event_rows(a.events(spark, d)).groupBy("type").agg(F.count("*").alias("n"), F.count("org_id").alias("owned"))


FINDING_SCHEMA = ("scan_id long, code string, status string, severity string, title string, position long, urls array<string>, "
                  "fingerprint string, scan_date date")


def stored_findings(spark, d):
    """Findings stored by month, failed scans first as unknown and then, with all others, by a second run; read back by month."""
    path = new_path(spark, "findings")
    found = a.findings(spark, d)
    dates = a.scans(spark, d).select("scan_id", "status", F.trunc("created_at", "month").alias("scan_date"))
    first = found.join(dates.filter("status = 'failed'").select("scan_id"), "scan_id").withColumn("status", F.lit("unknown"))
    pages.write_findings(first, dates.drop("status"), path, "scan_id")
    pages.write_findings(found, dates.drop("status"), path, "scan_id")
    stored_ = pages.read_days(spark, path, StructType.fromDDL(FINDING_SCHEMA), "1900-01-01", "2100-01-01")
    return stored_.select("scan_id", "code", "status", "position", "fingerprint", F.date_format("scan_date", "yyyy-MM-dd").alias("scan_date"))


QUERIES = {f.__name__: f for f in (
    stored_findings, site_summary, scan_verdict, latest_scans, latest_two_scans, trend, open_fails, tenant_findings, scan_diff, scan_diff_counts,
    report_matrix, reports, report_rows, newest_scans, notes_latest, notes_rejected, notes_carry, due_sites, eligible_sites,
    pending_rescans, tick_plan, rescan_outcomes, alerts, outbox, listings, integrity, alert_digest, scan_quota, monitor_capacity, anonymous_limit,
    accepted_requests, retention, stale_scans, next_run, site_overview, dashboard, site_deletion, site_by_host,
    uniqueness_audit, owner_contact, subscription_match, plan_sync, synced_plans, call_totals, call_models, site_pointers, claim_origins,
    event_log)}

_HASH = "sha256('10.0.0.'||(user_id%50)||'|'||strftime(ts,'%Y-%m-%d'))"
_PENDING_DIFF = f"""
, owner AS (SELECT c_nationkey org_id, arg_min('user'||c_custkey||'@mail.example',
     TIMESTAMP '1993-01-01' + to_days(CAST(c_custkey*7%365 AS INTEGER)) + to_seconds(0) + to_minutes(CAST(c_custkey AS INTEGER))) email
     FROM customer WHERE c_mktsegment='HOUSEHOLD' AND c_nationkey%4<>0 GROUP BY 1),
pdiff AS (SELECT p.scan_id, p.c code, coalesce(y.title,x.title) title, coalesce(y.severity,x.severity) severity, x.status before, y.status AS after, CASE WHEN coalesce(x.status,'') NOT IN ('fail','warn') AND coalesce(y.status,'') IN ('fail','warn') THEN 'new'
        WHEN coalesce(x.status,'') IN ('fail','warn') AND (y.status IS NULL OR y.status='pass') THEN 'resolved'
        WHEN x.status IS NULL OR y.status IS NULL THEN 'unchanged'
        WHEN x.status<>y.status OR (y.status IN ('fail','warn') AND x.fingerprint<>y.fingerprint) THEN 'changed' ELSE 'unchanged' END change
   FROM (SELECT scan_id, prev, unnest({CODES}) c FROM pending WHERE prev IS NOT NULL) p
   LEFT JOIN firsts x ON x.scan_id=prev AND x.code=c LEFT JOIN firsts y ON y.scan_id=p.scan_id AND y.code=c
   WHERE x.code IS NOT NULL OR y.code IS NOT NULL),
pcount AS (SELECT scan_id, count(*) FILTER (change='new') n, count(*) FILTER (change='resolved') r, count(*) FILTER (change='changed') c
   FROM pdiff GROUP BY 1),
outcome AS (SELECT p.scan_id, p.org_id, p.site_id, p.prev, o.plan, w.email, n, r, c,
   CASE WHEN gone.c_custkey IS NOT NULL THEN 'site_deleted' WHEN p.status='failed' THEN 'scan_failed' WHEN p.prev IS NULL THEN 'baseline'
        WHEN coalesce(n+r+c,0)=0 THEN 'unchanged' WHEN o.plan='pro' AND w.email IS NOT NULL THEN 'alerted' ELSE 'alerted_no_email' END outcome
   FROM pending p JOIN orgs o USING (org_id) LEFT JOIN pcount USING (scan_id) LEFT JOIN owner w USING (org_id)
   LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal<0) gone ON gone.c_custkey=p.site_id
   WHERE p.status IN ('done','failed'))
"""
_LABEL = "CASE {0} WHEN 'fail' THEN 'issue' WHEN 'warn' THEN 'warning' ELSE coalesce({0},'not reported') END"
_SUBS = """, ev AS (SELECT s_suppkey event_id, CASE WHEN s_suppkey%4=0 THEN s_nationkey END hint,
  CASE WHEN s_suppkey%3=0 THEN 'sub_x'||s_suppkey ELSE 'sub_'||s_nationkey END sub, 'cus_'||s_nationkey cus,
  CASE WHEN s_suppkey%5<3 THEN 'pro' ELSE 'free' END plan FROM supplier),
matched AS (SELECT ev.*, coalesce(a.org_id, b.org_id, c.org_id) org_id FROM ev LEFT JOIN orgs a ON a.org_id=hint
  LEFT JOIN orgs b ON b.subscription_id=sub LEFT JOIN orgs c ON c.customer_id=cus),
effect AS (SELECT m.event_id, m.org_id, m.plan, m.sub, m.cus, CASE WHEN m.org_id IS NULL OR (o.subscription_id IS NOT NULL AND o.subscription_id<>m.sub
  AND m.plan='free') THEN 'ignored' ELSE 'synced' END result, o.plan oplan, o.subscription_id osub, o.customer_id ocus
  FROM matched m LEFT JOIN orgs o ON o.org_id=m.org_id)"""

ORACLES = {
    "stored_findings": TABLES + """SELECT scan_id, code, f.status, "position", fingerprint, strftime(date_trunc('month', created_at), '%Y-%m-%d') scan_date
        FROM findings f JOIN scans s USING (scan_id)""",
    "site_summary": TABLES + "SELECT * FROM sums",
    "scan_verdict": TABLES + """SELECT scan_id, CASE s.status WHEN 'running' THEN 'pending' WHEN 'failed' THEN 'muted' ELSE
        CASE WHEN issues IS NULL THEN 'muted' WHEN issues>0 THEN 'fail' WHEN warnings>0 THEN 'warn' ELSE 'pass' END END tone,
        CASE s.status WHEN 'running' THEN 'Running' WHEN 'failed' THEN 'Scan failed' ELSE CASE WHEN issues IS NULL THEN 'No result'
        WHEN issues=1 THEN 'Issue' WHEN issues>1 THEN 'Issues' WHEN warnings=1 THEN 'Warning' WHEN warnings>1 THEN 'Warnings'
        ELSE 'No issues found' END END AS label FROM scans s LEFT JOIN sums USING (scan_id)""",
    "latest_scans": TABLES + "SELECT site_id, scan_id, rn FROM done WHERE rn<=3",
    "latest_two_scans": TABLES + "SELECT * FROM pairs",
    "trend": TABLES + """SELECT site_id, latest, previous, CASE WHEN c.scan_id IS NULL OR p.scan_id IS NULL THEN 'none'
        WHEN c.weighted_score<p.weighted_score THEN 'better' WHEN c.weighted_score>p.weighted_score THEN 'worse'
        WHEN c.warnings<p.warnings THEN 'better' WHEN c.warnings>p.warnings THEN 'worse' ELSE 'same' END trend
        FROM pairs LEFT JOIN sums c ON c.scan_id=latest LEFT JOIN sums p ON p.scan_id=previous""",
    "open_fails": TABLES + """SELECT d.org_id, count(*) open_fails FROM findings f JOIN done d USING (scan_id) WHERE rn=1 AND f.status='fail'
        AND severity='high' AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.org_id=d.org_id AND n.site_id=d.site_id AND n.code=f.code
        AND n.fingerprint=f.fingerprint AND n.state<>'open') GROUP BY 1""",
    "tenant_findings": TABLES + """SELECT scan_id, code, f.status, "position" FROM findings f JOIN scans s USING (scan_id) WHERE org_id IS NULL""",
    "scan_diff": TABLES + "SELECT * FROM diff",
    "scan_diff_counts": TABLES + """SELECT site_id, scan_id, count(*) FILTER (change='new') "new", count(*) FILTER (change='resolved') resolved,
        count(*) FILTER (change='changed') changed, count(*) FILTER (change='unchanged') "unchanged", bool_or(change<>'unchanged') has_changes
        FROM diff GROUP BY 1,2""",
    "report_matrix": TABLES + f"""SELECT scan_id, c.i-1 AS "position", c.code, {TITLES}[c.i] title, f.status, f.status AS shown
        FROM (SELECT scan_id, unnest(range(1,10)) i FROM scans WHERE status='done') s
        JOIN (SELECT unnest(range(1,10)) i, unnest({CODES}) code) c ON c.i=s.i
        LEFT JOIN (SELECT scan_id, code, arg_max(status, "position") status FROM findings GROUP BY 1,2) f USING (scan_id, code)""",
    "reports": TABLES + """SELECT s.scan_id, coalesce('['||string_agg('"'||code||'"', ',' ORDER BY "position")||']','[]') codes,
        coalesce('['||string_agg('"'||url||'"', ',' ORDER BY "position")||']','[]') urls
        FROM scans s LEFT JOIN firsts f USING (scan_id) GROUP BY 1""",
    "report_rows": TABLES + """, r AS (SELECT scan_id, code, f.status, url, row_number() OVER (PARTITION BY scan_id ORDER BY "position")-1 place FROM firsts f JOIN scans USING (scan_id))
        SELECT scan_id, 'page' part, place, url, NULL code, NULL status FROM r UNION ALL SELECT scan_id, 'finding', place, NULL, code, status FROM r""",
    "newest_scans": TABLES + """SELECT org_id, scan_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, scan_id DESC) rn
        FROM scans WHERE org_id IS NOT NULL) WHERE rn<=50""",
    "notes_latest": TABLES + "SELECT org_id, site_id, code, fingerprint, state, note FROM notes",
    "notes_rejected": TABLES + "SELECT org_id, 'reason_missing' problem, count(*) n FROM raw_notes WHERE state='not_applicable' AND note IS NULL GROUP BY 1",
    "notes_carry": TABLES + """SELECT scan_id, f.code, "position", state, note FROM findings f JOIN scans s USING (scan_id) JOIN notes n
        ON n.org_id=s.org_id AND n.site_id=s.site_id AND n.code=f.code AND n.fingerprint=f.fingerprint""",
    "due_sites": TABLES + "SELECT site_id, strftime(scanned_at,'%Y-%m-%d %H:%M:%S') scanned_at FROM due",
    "eligible_sites": TABLES + "SELECT org_id, site_id FROM eligible",
    "pending_rescans": TABLES + """SELECT org_id, scan_id, site_id, prev::VARCHAR previous_scan_id, status,
        strftime(created_at,'%Y-%m-%d %H:%M:%S') started_at FROM pending""",
    "tick_plan": TABLES + """, top AS (SELECT *, row_number() OVER (ORDER BY scanned_at NULLS FIRST, created_at, site_id) due_rank FROM due),
        marked AS (SELECT *, site_id IN (SELECT site_id FROM pending WHERE status='running') busy,
          site_id IN (SELECT site_id FROM eligible) covered FROM top)
        SELECT site_id, due_rank, CASE WHEN busy THEN 'scan_in_progress' WHEN NOT covered THEN 'over_plan_limit'
          WHEN sum(CASE WHEN covered AND NOT busy THEN 1 ELSE 0 END) OVER (ORDER BY due_rank) > 5 THEN 'per_run_cap' ELSE 'start' END "action" FROM marked""",
    "rescan_outcomes": TABLES + _PENDING_DIFF + "SELECT scan_id, outcome, email FROM outcome",
    "alerts": TABLES + _PENDING_DIFF + f""", lists AS (SELECT scan_id, {", ".join(
          f"coalesce(list({{'code':code,'title':title,'severity':severity,'before':before,'after':after}} ORDER BY list_position({CODES}, code)) FILTER (change='{k}'), []) l_{k}"
          for k in ("new", "resolved", "changed"))} FROM pdiff GROUP BY 1)
        SELECT org_id, site_id, scan_id, CASE WHEN outcome='scan_failed' THEN outcome ELSE 'scan_diff' END kind,
        CASE WHEN outcome='scan_failed' THEN '{{"scan":'||scan_id||',"hostname":"shop'||site_id||'.example"}}' ELSE
        to_json({{'scan':scan_id,'previousScan':prev,'hostname':'shop'||site_id||'.example','counts':{{'new':n,'resolved':r,'changed':c}},
          'new':l_new,'resolved':l_resolved,'changed':l_changed,'email':CASE WHEN outcome='alerted' THEN 'sent' WHEN plan='pro' THEN 'no_owner_email' ELSE 'free_plan' END}})::VARCHAR END payload
        FROM outcome LEFT JOIN lists USING (scan_id) WHERE outcome IN ('scan_failed','alerted','alerted_no_email')""",
    "outbox": TABLES + _PENDING_DIFF + f""", lines AS (SELECT scan_id, change, count(*) n,
          string_agg('- '||title||' ('||code||'): '||{_LABEL.format('before')}||' → '||{_LABEL.format('after')}, chr(10)
          ORDER BY list_position({CODES}, code)) body FROM pdiff WHERE change<>'unchanged' GROUP BY 1,2),
        mail AS (SELECT scan_id, string_agg(n||' '||change, ', ' ORDER BY list_position(['new','resolved','changed'],change))||' since the last scan' tail,
          string_agg(upper(change[1])||change[2:]||':'||chr(10)||body, chr(10)||chr(10) ORDER BY list_position(['new','resolved','changed'],change)) body FROM lines GROUP BY 1)
        SELECT org_id, scan_id, email to_email, 'shop'||site_id||'.example: '||tail subject, md5(body) AS "text" FROM outcome JOIN mail USING (scan_id) WHERE outcome='alerted'""",
    "listings": TABLES + _PENDING_DIFF + """, every AS (SELECT 'site' kind, org_id::BIGINT AS "owner", site_id id, created_at FROM sites
          UNION ALL SELECT 'done', org_id, scan_id, created_at FROM scans WHERE status='done' AND org_id IS NOT NULL
          UNION ALL SELECT 'alert', o.org_id, scan_id, s.created_at FROM outcome o JOIN scans s USING (scan_id) WHERE outcome IN ('scan_failed','alerted','alerted_no_email')
          UNION ALL SELECT 'site_done', site_id, scan_id, created_at FROM scans WHERE status='done' AND org_id IS NOT NULL)
        SELECT kind, "owner", id, row_number() OVER (PARTITION BY kind, "owner" ORDER BY created_at DESC, id DESC) rn FROM every
        QUALIFY row_number() OVER (PARTITION BY kind, "owner" ORDER BY created_at DESC, id DESC)<=50""",
    "integrity": TABLES + """, gone AS (SELECT c_custkey FROM customer WHERE c_acctbal<0),
        t AS (SELECT site_id, org_id, 'shop'||(site_id%500)||'.example' hostname FROM sites WHERE site_id NOT IN (SELECT c_custkey FROM gone)),
        k AS (SELECT *, 'r'||(scan_id//5) public_id FROM scans WHERE status<>'failed'),
        n AS (SELECT * FROM raw_notes WHERE state<>'not_applicable' OR note IS NOT NULL)
        SELECT 'site_host' AS "rule", org_id||'|'||hostname AS "key", count(*) n FROM t GROUP BY org_id, hostname HAVING count(*)>1
        UNION ALL SELECT 'note', org_id||'|'||site_id||'|'||code||'|'||fingerprint, count(*) FROM n GROUP BY org_id, site_id, code, fingerprint HAVING count(*)>1
        UNION ALL SELECT 'public_id', public_id, count(*) FROM k GROUP BY 1, 2 HAVING count(*)>1
        UNION ALL SELECT 'finding_scan', scan_id::VARCHAR, count(*) FROM findings WHERE scan_id NOT IN (SELECT scan_id FROM k) GROUP BY 1, 2
        UNION ALL SELECT 'scan_site', site_id::VARCHAR, count(*) FROM k WHERE site_id IS NOT NULL AND site_id NOT IN (SELECT site_id FROM t) GROUP BY 1, 2
        UNION ALL SELECT 'note_site', site_id::VARCHAR, count(*) FROM n WHERE site_id NOT IN (SELECT site_id FROM t) GROUP BY 1, 2""",
    "alert_digest": TABLES + f""", lines AS (SELECT site_id, scan_id, change, count(*) n,
          string_agg('- '||title||' ('||code||'): '||{_LABEL.format('before')}||' → '||{_LABEL.format('after')}, chr(10)
          ORDER BY list_position({CODES}, code)) body FROM diff WHERE change<>'unchanged' GROUP BY 1,2,3)
        SELECT l.site_id, scan_id, any_value(hostname)||': '||string_agg(n||' '||change, ', ' ORDER BY list_position(['new','resolved','changed'],change))
          ||' since the last scan' subject, string_agg(upper(change[1])||change[2:]||':'||chr(10)||body, chr(10)||chr(10)
          ORDER BY list_position(['new','resolved','changed'],change)) AS "text" FROM lines l JOIN sites USING (site_id) GROUP BY 1,2""",
    "scan_quota": TABLES + f"""SELECT o.org_id, count(s.scan_id) used, CASE plan WHEN 'free' THEN 5::BIGINT END "limit",
        CASE plan WHEN 'free' THEN greatest(0, 5-count(s.scan_id)) END remaining, '2001-08-01 00:00:00' resets_at,
        plan='pro' OR count(s.scan_id)<5 may_start FROM orgs o LEFT JOIN scans s ON s.org_id=o.org_id AND s.status<>'failed'
        AND s.created_at>=date_trunc('month', TIMESTAMP '{QUOTA_NOW}') GROUP BY o.org_id, plan""",
    "monitor_capacity": TABLES + """, cap AS (SELECT o.org_id, count(*) FILTER (monitor_enabled) used, CASE plan WHEN 'pro' THEN 10 ELSE 1 END::BIGINT lim
        FROM orgs o LEFT JOIN sites s USING (org_id) GROUP BY o.org_id, plan)
        SELECT site_id, used, lim "limit", used-monitor_enabled::INT < lim may_enable FROM sites JOIN cap USING (org_id)""",
    "anonymous_limit": f"SELECT {_HASH} requester_hash, count(*) used, count(*)>=3 limited FROM events GROUP BY 1",
    "accepted_requests": f"""SELECT event_id request_id, {_HASH} requester_hash FROM events
        QUALIFY row_number() OVER (PARTITION BY {_HASH} ORDER BY ts, event_id)<=3""",
    "retention": TABLES + f""", gone AS (SELECT scan_id FROM scans WHERE org_id IS NULL AND created_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY)
        SELECT (SELECT count(*) FROM scans)-(SELECT count(*) FROM gone) kept,
        (SELECT count(*) FROM findings WHERE scan_id NOT IN (SELECT scan_id FROM gone)) children, (SELECT count(*) FROM gone) purged""",
    "stale_scans": TABLES + """, t AS (SELECT *, status='running' AND coalesce(started_at,created_at) <= TIMESTAMP '1998-05-31 23:50:30' e FROM scans)
        SELECT scan_id, CASE WHEN e THEN 'failed' ELSE status END status, e expired FROM t""",
    "next_run": TABLES + """, t AS (SELECT scan_id, greatest(TIMESTAMP '1998-03-05 07:30:00', coalesce(CASE WHEN scan_id%10<>3 THEN
          coalesce(finished_at,started_at,created_at) END + to_days(CAST(scan_id%40+1 AS INTEGER)), TIMESTAMP '1998-03-05 07:30:00')) f FROM scans)
        SELECT scan_id, strftime(CASE WHEN date_trunc('day',f) + INTERVAL 6 HOUR < f THEN date_trunc('day',f) + INTERVAL 30 HOUR
          ELSE date_trunc('day',f) + INTERVAL 6 HOUR END, '%Y-%m-%d %H:%M:%S') next_run FROM t""",
    "site_overview": TABLES + f""", o AS (SELECT l.site_id, p.latest, p.previous, CASE WHEN NOT monitor_enabled THEN 'off'
          WHEN l.site_id IN (SELECT site_id FROM eligible) THEN 'on' ELSE 'paused' END monitor,
          greatest(TIMESTAMP '{NOW}', coalesce(scanned_at + to_days(gap), TIMESTAMP '{NOW}')) f FROM site_last l LEFT JOIN pairs p USING (site_id))
        SELECT site_id, latest, previous, monitor, CASE WHEN monitor='on' THEN strftime(CASE WHEN date_trunc('day',f)+INTERVAL 6 HOUR < f
          THEN date_trunc('day',f)+INTERVAL 30 HOUR ELSE date_trunc('day',f)+INTERVAL 6 HOUR END,'%Y-%m-%d %H:%M:%S') END next_run FROM o""",
    "dashboard": TABLES + f""", runs AS (SELECT l.org_id, hostname, greatest(TIMESTAMP '{NOW}', coalesce(scanned_at + to_days(gap), TIMESTAMP '{NOW}')) f
          FROM site_last l WHERE site_id IN (SELECT site_id FROM eligible)),
        nexts AS (SELECT org_id, hostname FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY CASE WHEN date_trunc('day',f)+INTERVAL 6 HOUR < f
          THEN date_trunc('day',f)+INTERVAL 30 HOUR ELSE date_trunc('day',f)+INTERVAL 6 HOUR END, hostname) r FROM runs) WHERE r=1),
        opens AS (SELECT d.org_id, count(*) n FROM findings f JOIN done d USING (scan_id) WHERE rn=1 AND f.status='fail' AND severity='high'
          AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.org_id=d.org_id AND n.site_id=d.site_id AND n.code=f.code
          AND n.fingerprint=f.fingerprint AND n.state<>'open') GROUP BY 1),
        warns AS (SELECT p.org_id, count(*) n FROM findings f JOIN pairs p ON p.latest=f.scan_id WHERE f.status='warn' GROUP BY 1),
        used AS (SELECT org_id, count(*) n FROM scans WHERE status<>'failed' AND created_at>=TIMESTAMP '2001-07-01' GROUP BY 1)
        SELECT o.org_id, (SELECT count(*) FROM eligible e WHERE e.org_id=o.org_id) active_monitors, CASE plan WHEN 'pro' THEN 10 ELSE 1 END monitor_limit,
          (SELECT count(*) FROM sites s WHERE s.org_id=o.org_id AND monitor_enabled) monitors_on, coalesce(opens.n,0) open_fails,
          coalesce(warns.n,0) warnings, coalesce(used.n,0) used, nexts.hostname next_site FROM orgs o LEFT JOIN nexts USING (org_id)
          LEFT JOIN opens USING (org_id) LEFT JOIN warns USING (org_id) LEFT JOIN used USING (org_id)""",
    "site_deletion": TABLES + """SELECT (SELECT count(*) FROM scans) scans, (SELECT count(*) FROM scans WHERE site_id%13<>0) with_site,
        (SELECT count(*) FROM notes WHERE site_id%13<>0) notes""",
    "site_by_host": TABLES + """SELECT scan_id, t.site_id found_site FROM scans s LEFT JOIN sites t ON t.org_id=s.org_id
        AND t.hostname='shop'||(s.site_id+scan_id%2)||'.example' WHERE s.org_id IS NOT NULL""",
    "uniqueness_audit": TABLES + "SELECT scan_id, code, count(*) n FROM findings GROUP BY 1,2 HAVING count(*)>1",
    "owner_contact": TABLES + _PENDING_DIFF + "SELECT * FROM owner",
    "subscription_match": TABLES + _SUBS + "SELECT event_id, org_id FROM matched",
    "plan_sync": TABLES + _SUBS + """SELECT event_id, org_id, result, plan, result='synced' AND (plan IS DISTINCT FROM oplan OR sub IS DISTINCT FROM osub
        OR cus IS DISTINCT FROM ocus) changed FROM effect""",
    "synced_plans": TABLES + _SUBS + """, last AS (SELECT org_id, arg_max(plan,event_id) p, arg_max(sub,event_id) s, arg_max(cus,event_id) c FROM effect
        WHERE result='synced' GROUP BY 1) SELECT o.org_id, coalesce(p,plan) plan, coalesce(s,subscription_id) subscription_id,
        coalesce(c,customer_id) customer_id FROM orgs o LEFT JOIN last USING (org_id)""",
    "call_models": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id))-1 place, event_type model, count(*) calls
        FROM events GROUP BY user_id, event_type""",
    "call_totals": """WITH c AS (SELECT *, CAST(json_extract(props,'$.k') AS BIGINT) k FROM events),
        f AS (SELECT user_id, event_type, min(event_id) s FROM c GROUP BY 1,2)
        SELECT c.user_id, 'v1' prompt_version, sum(k)::BIGINT tokens_in, sum(2*k)::BIGINT tokens_out, sum(k%10)::BIGINT latency_ms, count(*) attempts,
        (SELECT string_agg(event_type, ',' ORDER BY s) FROM f WHERE f.user_id=c.user_id) model FROM c GROUP BY 1""",
    "site_pointers": TABLES + """SELECT t.site_id, coalesce(n.scan_id, last_scan_id) last_scan_id FROM sites t LEFT JOIN
        (SELECT site_id, scan_id FROM scans WHERE finished_at IS NOT NULL AND site_id IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY finished_at DESC, scan_id DESC)=1) n USING (site_id)""",
    "claim_origins": """WITH e AS (SELECT CASE WHEN l_linenumber=3 THEN 'green_claims' ELSE 'other' END code, l_partkey p, unnest([0,1,2]) o FROM lineitem),
        m AS (SELECT *, code='green_claims' AND o<2 AND p%(3+o)<>0 hit FROM e)
        SELECT code, o::BIGINT place, CASE WHEN hit THEN CASE WHEN p%2=o THEN 'rule' ELSE 'model' END END "source", CASE WHEN hit THEN 'r'||o END reason,
        count(*) n FROM m GROUP BY ALL""",
    "event_log": """SELECT CASE event_type WHEN 'signup' THEN 'monitor.scan_started' WHEN 'purchase' THEN 'monitor.scan_processed' ELSE event_type END "type",
        count(*) n, count(*) FILTER (user_id%11<>0) owned FROM events GROUP BY 1""",
}
