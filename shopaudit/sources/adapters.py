"""Views of the driver's tables as the engine's tables. Every rule is a projection of the given rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..vocab import copy


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """orders as scans: F is done, O running, P failed; nation 0 stands for anonymous requests."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    owners = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    created = F.col("o_orderdate").cast("timestamp")
    return orders.join(owners, "o_custkey").select(
        F.col("o_orderkey").alias("scan_id"), F.when(F.col("c_nationkey") != 0, F.col("c_nationkey")).alias("org_id"),
        F.when(F.col("c_nationkey") != 0, F.col("o_custkey")).alias("site_id"), state.alias("status"), created.alias("created_at"),
        F.when(F.col("o_orderkey") % 5 != 0, created + F.expr("interval 1 minute")).alias("started_at"),
        F.when((state != "running") & (F.col("o_orderkey") % 7 != 0), created + F.expr("interval 5 minutes")).alias("finished_at"))


def orgs(spark: SparkSession, folder: str) -> DataFrame:
    """nation as organisations: every third one pays, some have a subscription and a customer id."""
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").filter(key != 0).select(
        key.alias("org_id"), F.col("n_name").alias("name"), F.when(key % 3 == 0, "pro").otherwise("free").alias("plan"),
        F.when(key % 2 == 0, F.concat(F.lit("sub_"), key.cast("string"))).alias("subscription_id"),
        F.when(key % 5 != 0, F.concat(F.lit("cus_"), key.cast("string"))).alias("customer_id"))


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """customer as sites of organisations; the pointer is the customer's newest order."""
    last = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("last_scan_id"))
    key = F.col("c_custkey")
    rows = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").filter(F.col("c_nationkey") != 0)
    return rows.join(last, "c_custkey", "left").select(
        key.alias("site_id"), F.col("c_nationkey").alias("org_id"), F.concat(F.lit("shop"), key.cast("string"), F.lit(".example")).alias("hostname"),
        (F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("monitor_enabled"),
        F.when(F.col("c_mktsegment") == "BUILDING", 30).otherwise(7).alias("monitor_interval_days"), "last_scan_id",
        (F.lit("1994-01-01").cast("timestamp") + F.make_dt_interval(key % 365)).alias("created_at"))


def deleted_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Sites that were deleted: customers in debt."""
    return table(spark, folder, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("site_id"))


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as findings of the first seven checks; the part is the evidence page."""
    code = F.element_at(F.array(*[F.lit(c) for c in copy.CODES]), F.col("l_linenumber"))
    status = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "N", "pass").otherwise("warn")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in copy.SEVERITY.items() for x in kv]), F.col("code"))
    title = F.element_at(F.create_map(*[F.lit(x) for kv in copy.TITLES.items() for x in kv]), F.col("code"))
    url = F.concat(F.lit("https://shop.example/p/"), (F.col("l_partkey") % 10).cast("string"))
    return (rows.withColumn("code", code).withColumn("status", status).select(
        F.col("l_orderkey").alias("scan_id"), "code", "status", severity.alias("severity"), title.alias("title"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("position"),
        F.array(url).alias("urls"))
        .withColumn("fingerprint", scalars.fingerprint(F.col("code"), F.col("status"), F.col("urls"))))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes on findings of every seventh part, from done scans of organisations."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey").filter(
        F.col("l_partkey") % 7 == 0)
    code = F.element_at(F.array(*[F.lit(c) for c in copy.CODES]), F.col("l_linenumber"))
    status = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "N", "pass").otherwise("warn")
    url = F.concat(F.lit("https://shop.example/p/"), (F.col("l_partkey") % 10).cast("string"))
    state = F.element_at(F.array(F.lit("open"), F.lit("fixed"), F.lit("not_applicable")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    owner = scans(spark, folder).filter(F.col("site_id").isNotNull()).select("scan_id", "org_id", "site_id", "created_at")
    text = F.when(F.col("l_suppkey") % 5 != 2, F.concat(F.lit(" note "), F.col("l_suppkey").cast("string"))).otherwise(F.lit("  "))
    return (rows.join(owner, rows["l_orderkey"] == owner["scan_id"]).select(
        "org_id", "site_id", code.alias("code"), scalars.fingerprint(code, status, F.array(url)).alias("fingerprint"),
        state.alias("state"), text.alias("note"), F.col("created_at").alias("updated_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order_line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
        .withColumn("seq", F.struct("order_line", "part", "supp")).drop("order_line", "part", "supp"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """events as the agent log: signup starts a re-scan, purchase processes it; the user is the entity."""
    rows = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "props")
    kind = (F.when(F.col("event_type") == "signup", "monitor.scan_started")
            .when(F.col("event_type") == "purchase", "monitor.scan_processed").otherwise(F.col("event_type")))
    started = F.col("event_type") == "signup"
    # The entity is one of the user's recent activities, so that only some started scans are processed.
    entity = F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long") % 100
    previous = F.when(started, F.concat(F.lit('{"previousScanId": "'), (F.col("user_id")).cast("string"), F.lit('"}')))
    return rows.select("event_id", F.when(F.col("user_id") % 11 != 0, F.col("user_id") % 24 + 1).alias("org_id"),
                       F.lit("cron").alias("actor"), kind.alias("type"), F.lit("scan").alias("entity_type"),
                       entity.alias("entity_id"), F.coalesce(previous, "props").alias("input"), F.col("ts").cast("timestamp").alias("created_at"))


def rescan_log(spark: SparkSession, folder: str) -> DataFrame:
    """Re-scan events of site scans: every third scan was started by the job, every ninth is processed already."""
    from pyspark.sql.window import Window
    own = scans(spark, folder).filter(F.col("site_id").isNotNull())
    before = Window.partitionBy("site_id").orderBy("created_at", "scan_id").rowsBetween(Window.unboundedPreceding, -1)
    previous = own.withColumn("previous", F.last(F.when(F.col("status") == "done", F.col("scan_id")), ignorenulls=True).over(before))
    started = previous.filter(F.col("scan_id") % 3 == 0).select(
        "org_id", F.lit("monitor.scan_started").alias("type"), F.lit("scan").alias("entity_type"), F.col("scan_id").alias("entity_id"),
        F.to_json(F.struct(F.col("site_id").cast("string").alias("siteId"), F.col("previous").cast("string").alias("previousScanId"))).alias("input"),
        "created_at")
    done = own.filter(F.col("scan_id") % 9 == 0).select(
        "org_id", F.lit("monitor.scan_processed").alias("type"), F.lit("scan").alias("entity_type"), F.col("scan_id").alias("entity_id"),
        F.lit(None).cast("string").alias("input"), "created_at")
    return started.unionByName(done)


def memberships(spark: SparkSession, folder: str) -> DataFrame:
    """customer as members of organisations; the household segment owns, except in every fourth organisation."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").select(
        F.col("c_nationkey").alias("org_id"), F.concat(F.lit("user"), key.cast("string"), F.lit("@mail.example")).alias("email"),
        F.when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_nationkey") % 4 != 0), "owner").otherwise("member").alias("role"),
        (F.lit("1993-01-01").cast("timestamp") + F.make_dt_interval(key * 7 % 365, F.lit(0), key)).alias("created_at"))


def subscription_events(spark: SparkSession, folder: str) -> DataFrame:
    """supplier as subscription events: the organisation is named by id, subscription or customer."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    states = F.array(*[F.lit(s) for s in ("active", "trialing", "past_due", "canceled", "unpaid")])
    return table(spark, folder, "supplier").select(
        k.alias("event_id"), F.when(k % 4 == 0, n).alias("org_hint"),
        F.when(k % 3 == 0, F.concat(F.lit("sub_x"), k.cast("string"))).otherwise(F.concat(F.lit("sub_"), n.cast("string"))).alias("subscription_id"),
        F.concat(F.lit("cus_"), n.cast("string")).alias("customer_id"), F.element_at(states, (k % 5 + 1).cast("int")).alias("state"))
