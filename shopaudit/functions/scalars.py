"""Hash, date and small typed helpers as column expressions. ``now`` is always an argument, never the clock."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence of more pages than any single report can hold is fingerprinted in two steps (see ``fingerprint``).
DIRECT_URLS = 1000


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def fingerprint(code: Column, status: Column, urls: Column) -> Column:
    """Identity of a finding across scans: 22 base64url characters of SHA-256 over check, status and evidence pages."""
    distinct = F.array_sort(F.array_distinct(F.coalesce(urls, F.array().cast("array<string>"))))
    text = F.concat(F.lit('["'), code, F.lit('","'), status, F.lit('",'), F.to_json(distinct), F.lit("]"))
    digest = F.base64(F.unhex(F.sha2(text, 256)))
    return F.substring(F.translate(digest, "+/=\r\n", "-_"), 1, 22)


def client_address(forwarded: Column, real: Column) -> Column:
    """First forwarded address, else the real one, else ``unknown``."""
    first = F.trim(F.get(F.split(forwarded, ","), 0))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(real), F.lit("")), F.lit("unknown"))


def requester_hash(address: Column, at: Column) -> Column:
    """SHA-256 of address and UTC day: counts requests per day without keeping the address."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(address)), F.date_format(at, "yyyy-MM-dd")), 256)


def month_start(now: Column) -> Column:
    return F.date_trunc("month", now)


def next_month_start(now: Column) -> Column:
    return F.add_months(F.date_trunc("month", now), 1).cast("timestamp")


def next_midnight(now: Column) -> Column:
    return F.date_trunc("day", now) + F.make_dt_interval(F.lit(1))


# Fixed value: the daily job runs at 06:00 UTC.
RUN_HOUR = 6


def next_run(last: Column, interval_days: Column, now: Column) -> Column:
    """First daily run at or after ``last`` plus the interval, and not in the past. Never scanned: from now on."""
    start = F.greatest(F.coalesce(last + F.make_dt_interval(interval_days), now), now)
    run = F.date_trunc("day", start) + F.make_dt_interval(F.lit(0), F.lit(RUN_HOUR))
    return F.when(run < start, run + F.make_dt_interval(F.lit(1))).otherwise(run)


def scan_time(finished: Column, started: Column, created: Column) -> Column:
    return F.coalesce(finished, started, created)


def long_date(at: Column) -> Column:
    return F.date_format(at, "d MMMM yyyy")


def applies_phrase(now: Column, start: Column) -> Column:
    return F.when(now < start, F.concat(F.lit("applies from "), long_date(start))).otherwise(
        F.concat(F.lit("has applied since "), long_date(start)))


def local_date(at: Column, zone: Column, pattern: str = "d MMM yyyy") -> Column:
    """Date in the organisation's zone. ``zone`` comes from ``known_zone``; a missing date shows as a dash."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), pattern), F.lit("—"))


def known_zone(zone: Column, zones: Column) -> Column:
    """The zone if it is one of ``zones`` (array of names), else UTC."""
    return F.when(F.array_contains(zones, F.coalesce(zone, F.lit(""))), zone).otherwise(F.lit("UTC"))


def payload_text(payload: Column, field: str) -> Column:
    """Text field of a JSON payload, NULL when it is missing or not a string."""
    return F.when(payload.rlike(rf'"{field}"\s*:\s*"'), F.get_json_object(payload, f"$.{field}"))


PRODUCT_TYPE = r"(?i)(?:^|[/:])product(?:group)?\z"
# Fixed value: how many arrays and objects a type may lie in.
JSON_DEPTH = 6


def describes_product(block: Column) -> Column:
    """A JSON-LD block that parses and names a Product or ProductGroup type, at most ``JSON_DEPTH`` levels below its root.

    The parsed value is walked level by level: each level is the list of all values inside the arrays and objects of the one
    above, so text that only looks like a type, inside a string or a key, does not count.
    """
    nothing = F.array().cast("array<variant>")
    inside = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"),
                                  F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), nothing)

    def typed(v: Column) -> Column:
        several = F.coalesce(F.try_variant_get(v, "$['@type']", "array<variant>"), nothing)
        names = F.concat(F.array(F.try_variant_get(v, "$['@type']", "string")),
                         F.transform(several, lambda t: F.try_variant_get(t, "$", "string")))
        return F.exists(names, lambda n: F.coalesce(n.rlike(PRODUCT_TYPE), F.lit(False)))

    def step(seen: Column, _: Column) -> Column:
        return F.struct((seen["found"] | F.exists(seen["level"], typed)).alias("found"),
                        F.flatten(F.transform(seen["level"], inside)).alias("level"))
    start = F.struct(F.lit(False).alias("found"), F.array(F.try_parse_json(block)).alias("level"))
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(JSON_DEPTH)), start, step, lambda seen: seen["found"])
    # Blocks that cannot name the type, escaped or not, are not parsed.
    return F.when(block.rlike(r"(?i)product|\\u"), F.coalesce(walked, F.lit(False))).otherwise(False)


def clamp_limit(limit: float | None, fallback: int = 50, most: int = 200) -> int:
    """Length of a listing: ``fallback`` when no valid limit is given, never more than ``most``."""
    if not limit or limit != limit or limit in (float("inf"), float("-inf")) or limit < 1:
        return fallback
    return min(int(limit), most)
