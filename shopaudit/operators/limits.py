"""Plan limits: scan quotas, monitor capacity, anonymous requests; plans from subscription states."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import month_start, next_month_start
from ..session import first_by

# Limits per plan (None is unlimited) and anonymous scans per requester and day.
LIMITS = {"free": {"scans_per_month": 5, "monitored_sites": 1}, "pro": {"scans_per_month": None, "monitored_sites": 10}}
# The most sites any plan covers; a plan without limit would lift it.
MOST_MONITORED = max(limit["monitored_sites"] or 1 << 31 for limit in LIMITS.values())
ANONYMOUS_PER_DAY = 3
PAID_STATES = ["active", "trialing", "past_due"]


def plan_limit(plan: Column, name: str) -> Column:
    return (F.when(plan == "pro", F.lit(LIMITS["pro"][name]).cast("int"))
            .when(plan == "free", F.lit(LIMITS["free"][name]).cast("int")))


def scan_quota(orgs: DataFrame, scans: DataFrame, now: str) -> DataFrame:
    """Scans of the UTC month that did not fail, limit, remaining, reset date, and whether another may start."""
    at = F.lit(now).cast("timestamp")
    used = (scans.filter((F.col("created_at") >= month_start(at)) & (F.col("status") != "failed") & F.col("org_id").isNotNull())
            .groupBy("org_id").agg(F.count("*").alias("used")))
    limit = plan_limit(F.col("plan"), "scans_per_month")
    return (orgs.select("org_id", "plan").join(used, "org_id", "left")
            .withColumn("used", F.coalesce("used", F.lit(0).cast("long"))).withColumn("limit", limit.cast("long"))
            .withColumn("remaining", F.when(F.col("limit").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("limit") - F.col("used"))))
            .withColumn("resets_at", next_month_start(at))
            .withColumn("may_start", F.col("remaining").isNull() | (F.col("remaining") > 0)))


def monitor_capacity(orgs: DataFrame, sites: DataFrame) -> DataFrame:
    """Monitored sites and limit per organisation."""
    used = sites.filter("monitor_enabled").groupBy("org_id").agg(F.count("*").alias("used"))
    return (orgs.select("org_id", "plan").join(used, "org_id", "left")
            .select("org_id", F.coalesce("used", F.lit(0).cast("long")).alias("used"),
                    plan_limit(F.col("plan"), "monitored_sites").cast("long").alias("limit")))


def may_enable_monitoring(sites: DataFrame, capacity: DataFrame) -> DataFrame:
    """Whether monitoring may be on for each site: the organisation's other monitored sites are below the limit."""
    others = F.col("used") - F.col("monitor_enabled").cast("int")
    return sites.join(capacity, "org_id").withColumn("may_enable", others < F.col("limit"))


def anonymous_usage(scans: DataFrame) -> DataFrame:
    """Anonymous scans per requester hash (any state) and whether the day's limit is reached."""
    return (scans.filter(F.col("org_id").isNull() & F.col("requester_hash").isNotNull())
            .groupBy("requester_hash").agg(F.count("*").alias("used"))
            .withColumn("limited", F.col("used") >= ANONYMOUS_PER_DAY))


def accepted_requests(requests: DataFrame, tie: str = "request_id") -> DataFrame:
    """The requests the limit lets through: the first three of each requester hash. The hash holds the day."""
    rank = F.row_number().over(Window.partitionBy("requester_hash").orderBy("created_at", tie))
    return requests.withColumn("rn", rank).filter(F.col("rn") <= ANONYMOUS_PER_DAY).drop("rn")


def match_organisations(lookups: DataFrame, orgs: DataFrame) -> DataFrame:
    """Organisation of a subscription event: explicit id, else subscription id, else customer id.

    ``lookups``: (event_id, org_hint, subscription_id, customer_id); keys of ``orgs`` are unique.
    """
    by = lambda key, name: orgs.filter(F.col(key).isNotNull()).select(F.col(key).alias(f"k_{name}"), F.col("org_id").alias(name))
    joined = (lookups.join(by("org_id", "by_id"), F.col("org_hint") == F.col("k_by_id"), "left")
              .join(by("subscription_id", "by_subscription"), F.col("subscription_id") == F.col("k_by_subscription"), "left")
              .join(by("customer_id", "by_customer"), F.col("customer_id") == F.col("k_by_customer"), "left"))
    return joined.withColumn("org_id", F.coalesce("by_id", "by_subscription", "by_customer")).drop(
        "k_by_id", "k_by_subscription", "k_by_customer", "by_id", "by_subscription", "by_customer")


def plan_for_state(state: Column) -> Column:
    return F.when(state.isin(*PAID_STATES), "pro").otherwise("free")


def plan_changes(subscriptions: DataFrame, orgs: DataFrame) -> DataFrame:
    """Effect of subscription states on plans: synced or ignored, the plan, and whether anything changes."""
    matched = match_organisations(subscriptions, orgs)
    current = orgs.select("org_id", F.col("plan").alias("old_plan"), F.col("subscription_id").alias("old_subscription"),
                          F.col("customer_id").alias("old_customer"))
    joined = matched.join(current, "org_id", "left").withColumn("plan", plan_for_state(F.col("state")))
    older = F.col("old_subscription").isNotNull() & (F.col("old_subscription") != F.col("subscription_id")) & (F.col("plan") == "free")
    result = F.when(F.col("org_id").isNull() | F.coalesce(older, F.lit(False)), "ignored").otherwise("synced")
    moved = ~(F.col("old_plan").eqNullSafe(F.col("plan")) & F.col("old_customer").eqNullSafe(F.col("customer_id"))
              & F.col("old_subscription").eqNullSafe(F.col("subscription_id")))
    return joined.withColumn("result", result).withColumn("changed", (result == "synced") & moved)


def synced_organisations(orgs: DataFrame, changes: DataFrame, order: str = "event_id") -> DataFrame:
    """Organisations after the last effective subscription event of each; replayed events lead to the same rows."""
    last = first_by(changes.filter(F.col("result") == "synced"), ["org_id"], [F.col(order).desc()]).select(
        "org_id", F.col("plan").alias("new_plan"), F.col("subscription_id").alias("new_subscription"),
        F.col("customer_id").alias("new_customer"))
    return orgs.join(last, "org_id", "left").select(*[
        F.coalesce({"plan": "new_plan", "subscription_id": "new_subscription", "customer_id": "new_customer"}[c], c).alias(c)
        if c in ("plan", "subscription_id", "customer_id") else c for c in orgs.columns])
