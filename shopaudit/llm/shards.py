"""Contiguous shards of pages with the smallest possible largest shard, as DataFrame operations only."""
from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIECES = 50_000


def _parts(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt to ranges of ``order``, numbered in ``part``, and written once so that the ranges stay."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id()), "ranges")


def running_ends(groups: DataFrame) -> DataFrame:
    """``groups`` (key, first_id, size) with ``end``, the total size up to and with each group in order of first_id.

    Ranges are summed on their own; only one number of each range is summed up over all of them.
    """
    parts = _parts(groups, "first_id", "key")
    sums = parts.groupBy("part").agg(F.sum("size").alias("part_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("first_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    # One row per range, so the starts may be broadcast.
    return stored(parts.join(F.broadcast(starts), "part").withColumn("end", F.col("start") + F.sum("size").over(inside))
                  .select("key", "first_id", "size", "end"), "ends")


class Steps:
    """What is known of the sums at which groups end: spans that hold some of them, of which only both ends are exact."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.lows = [low for low, _ in self.spans]

    def span(self, x: int):
        at = bisect.bisect_right(self.lows, x) - 1
        return self.spans[at] if at >= 0 else (0, 0)

    def below(self, x: int) -> int:
        """A group's end at or below x: not more than the largest one."""
        low, high = self.span(x)
        return high if high <= x else low

    def above(self, x: int) -> int:
        """At least the largest group's end at or below x, and not more than x."""
        _, high = self.span(x)
        return min(high, x)


def walk(capacity: int, shards: int, reach) -> list[int]:
    """Where greedy shards of ``capacity`` end, by ``reach``."""
    ends, at = [], 0
    for _ in range(shards):
        at = reach(at + capacity)
        ends.append(at)
    return ends


def smallest(total: int, low: int, shards: int, reach) -> int:
    """Binary search of the smallest capacity whose greedy shards take everything."""
    high = max(low, total)
    while low < high:
        middle = (low + high) // 2
        if walk(middle, shards, reach)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def _spans(ends: DataFrame, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The smallest and largest end in each of at most about PIECES equal pieces of the wanted ranges."""
    width = max(1, sum(high - low + 1 for low, high in wanted) // PIECES)
    out = F.col("end")
    piece = None
    for i, (low, high) in enumerate(wanted):
        inside = out.between(low, high)
        value = F.struct(F.lit(i).alias("i"), F.floor((out - low) / width).cast("long").alias("k"))
        piece = F.when(inside, value) if piece is None else piece.when(inside, value)
    found = ends.select(piece.alias("piece"), "end").filter("piece is not null").groupBy("piece").agg(
        F.min("end").alias("low"), F.max("end").alias("high"))
    return [(r["low"], r["high"]) for r in found.select("low", "high").collect()]


def cuts(ends: DataFrame, shards: int) -> list[int]:
    """The ends of greedy shards of the smallest feasible capacity.

    The search runs on a bounded digest of the group ends: ranges of which the smallest and largest end are known. That
    bounds the capacity from both sides; the ranges that the walks between the bounds touch are then read more finely,
    until the bounds meet and the walk is exact.
    """
    total, largest = ends.agg(F.max("end"), F.max("size")).first()
    if not total:
        return []
    steps = Steps(_spans(ends, [(0, total)]))
    least = max(-(-total // shards), largest)
    while True:
        high, low = (smallest(total, least, shards, reach) for reach in (steps.below, steps.above))
        sure, hoped = walk(low, shards, steps.below), walk(high, shards, steps.above)
        if low == high and sure == hoped:
            return sure
        looked = [(a + low, b + high) for a, b in zip([0] + sure[:-1], [0] + hoped[:-1])]
        unsure = {s for s in steps.spans if s[0] < s[1] and any(s[0] <= b and a <= s[1] for a, b in looked)}
        merged: list[list[int]] = []
        for a, b in sorted(unsure):
            if merged and not any(merged[-1][1] < s < a for s in steps.lows[bisect.bisect(steps.lows, merged[-1][1]):][:1]):
                merged[-1][1] = b
            else:
                merged.append([a, b])
        kept = [s for s in steps.spans if s not in unsure]
        steps = Steps(kept + _spans(ends, [tuple(m) for m in merged]))


def shard_pages(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Deal the pages of ``documents`` (page_id, text) to ``shards`` shards of nearly equal bytes.

    A page's size is its text's UTF-8 bytes (null: none) plus one. Pages with equal texts (null as empty) are one atomic
    group; groups are ordered by their smallest page_id. Shards are runs of groups whose largest size is the smallest
    possible, found by binary search over capacities with greedy checks (see ``cuts``).

    Returns one row per row with a page_id: page_id, size, text_crc32, shard (from 0), slot (gapless from 0 in a shard, by
    page_id). Group sizes are added up before they are shuffled, so a text with a third of all rows is one small row.
    Rows that repeat count as rows. Other columns are ignored; an empty table gives no rows. Only the digest of at most
    about PIECES rows is collected.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = stored(documents.select(F.col("page_id").cast("long").alias("page_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")).filter("page_id is not null"), "sizes")
    groups = rows.groupBy("key").agg(F.min("page_id").alias("first_id"), F.sum("size").alias("size"))
    ends = running_ends(groups)
    places = ends.select("key", shard_of(F.col("end"), cuts(ends, shards)).alias("shard"))
    dealt = _parts(rows.join(places, "key").drop("key"), "shard", "page_id", "text_crc32")
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part", "shard").orderBy("page_id", "text_crc32")
    # At most one row per range and shard, so the starts may be broadcast.
    return dealt.join(F.broadcast(starts), ["shard", "part"]).select(
        "page_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"))


def shard_of(end: Column, ends: list[int]) -> Column:
    """The number of the shard that holds a group with this end."""
    known = F.array(*[F.lit(x) for x in ends]).cast("array<bigint>") if ends else F.array().cast("array<bigint>")
    return F.size(F.filter(known, lambda x: x < end))
