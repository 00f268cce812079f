"""Streaming forms of the event-driven operators. Each takes and returns streaming DataFrames."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import ANONYMOUS_PER_DAY
from ..operators.monitor import PENDING_DAYS, STALE_MINUTES


def request_counts(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Requests (requester, ts) per requester and UTC day, with the limit flag; a day is emitted once it is closed."""
    counted = requests.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "requester").agg(F.count("*").alias("used"))
    return counted.select("requester", F.col("window.start").alias("day"), "used", (F.col("used") >= ANONYMOUS_PER_DAY).alias("limited"))


def unprocessed(started: DataFrame, processed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Started re-scans (entity_id, ts) and the processed event (entity_id, done_at) within fourteen days, if any."""
    left = started.withWatermark("ts", delay)
    right = processed.withWatermark("done_at", delay).withColumnRenamed("entity_id", "done_id")
    near = F.expr(f"done_id = entity_id AND done_at >= ts AND done_at <= ts + interval {PENDING_DAYS} days")
    return left.join(right, near, "leftOuter")


TIMEOUT_SCHEMA = "scan_id long, started_at timestamp, outcome string"
#: Hours a reported scan is remembered, so that an end that comes after all reports nothing more.
ANSWERED_HOURS = 24
#: Scans are dealt to so many groups of state by a hash of their id; fixed for the life of a checkpoint.
SCAN_GROUPS = 1024
_STATE = np.dtype([("scan", "i8"), ("started", "i8"), ("over", "i8"), ("answered", "?"), ("due", "i8")])
_NO_START, _NO_END = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The open scans of one group: remember their starts, forget those that end, report as failed what runs for ten minutes.

    Event times decide, not the order of arrival: an end ten minutes after the start or later is a failure, whether it
    comes before or after the watermark has passed that point. An end that comes before its start is remembered until the
    watermark has passed it. A scan that is in the batch is judged by it and expires in a later one.
    """
    now = state.getCurrentWatermarkMs()
    old = np.frombuffer(state.get[0], _STATE) if state.exists else np.zeros(0, _STATE)
    new = pd.DataFrame({"scan_id": [], "kind": [], "ts": []}) if state.hasTimedOut else pd.concat(list(batches))
    times = new["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
    ids, at = np.unique(np.concatenate([old["scan"], new["scan_id"].to_numpy(np.int64)]), return_inverse=True)
    was, came = at[:len(old)], at[len(old):]
    scans = np.zeros(len(ids), _STATE)
    scans["scan"], scans["started"], scans["over"] = ids, _NO_START, _NO_END
    scans[was] = old
    touched = np.zeros(len(ids), bool)
    touched[came] = True
    begin, end = (new["kind"] == "started").to_numpy(), (new["kind"] == "finished").to_numpy()
    np.minimum.at(scans["started"], came[begin], times[begin])
    np.maximum.at(scans["over"], came[end], times[end])

    begun, ended, answered = scans["started"] != _NO_START, scans["over"] != _NO_END, scans["answered"]
    expired = ~touched & (scans["due"] < now)
    both = ~answered & begun & ended
    orphans, failures = ~answered & ~begun & ended & expired, ~answered & begun & ~ended & expired
    in_time = orphans.copy()
    in_time[both] = scans["over"][both] - scans["started"][both] < STALE_MINUTES * 60_000_000
    told = both | orphans | failures
    if told.any():
        yield pd.DataFrame({
            "scan_id": pd.array(scans["scan"][told] if key[0] >= 0 else [None] * int(told.sum()), "Int64"),
            "started_at": pd.Series(np.where(begun, scans["started"], np.iinfo(np.int64).min)[told].astype("datetime64[us]")),
            "outcome": np.where(in_time[told], "finished", "failed")})

    stays = (begun | ended) & ~both & ~orphans & ~(answered & expired)
    answered = scans["answered"] = answered | failures
    # Milliseconds, rounded down as Spark's own clock is.
    due = np.where(answered, scans["started"] // 1000 + ANSWERED_HOURS * 3_600_000, np.where(
        begun, scans["started"] // 1000 + STALE_MINUTES * 60_000, scans["over"] // 1000 + 1))
    scans["due"] = np.where(touched | failures, np.maximum(due, now + 1), scans["due"])
    scans = scans[stays]
    if len(scans):
        state.update((scans.tobytes(),))
        state.setTimeoutTimestamp(int(scans["due"].min()))
    elif state.exists:
        state.remove()


def scan_timeouts(events: DataFrame, delay: str = "1 minute", groups: int = SCAN_GROUPS) -> DataFrame:
    """Scan events (scan_id, kind started/finished, ts): finished scans, and failures of those that never end.

    A group's state holds its scans that are open or were reported within a day, so one call of Python serves many scans.
    """
    known = F.col("scan_id").isNotNull()
    dealt = events.filter(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        F.when(known, F.pmod(F.xxhash64("scan_id"), F.lit(groups))).otherwise(-1).alias("dealt"),
        F.coalesce(F.col("scan_id").cast("long"), F.lit(0)).alias("scan_id"), F.coalesce("kind", F.lit("")).alias("kind"), "ts")
    return dealt.groupBy("dealt").applyInPandasWithState(
        _watch, TIMEOUT_SCHEMA, "scans binary", "append", GroupStateTimeout.EventTimeTimeout)


def first_deliveries(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
