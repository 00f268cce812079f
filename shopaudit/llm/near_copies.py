"""Near copies of page texts by HyperMinHash registers, banding and verification on whole shingle sets."""
from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, small_batches, stored, worker_cache
from .graph import components

SHINGLE_WORDS = 5
BAND_ROWS = 3
MANTISSA_BITS = 10
#: Chance that a pair at the threshold meets in no band, and that its estimate keeps it from verification.
LOSS = 1e-9
#: Members of a block: with sketches alone, and with whole sets.
SKETCH_BLOCK, BLOCK = 256, 64
CACHE_WORDS = 400_000
#: Expected share of equal registers of unrelated large sets at 10 mantissa bits (HyperMinHash, section on collisions).
COLLISION = 0.169919487159739 / 2 ** MANTISSA_BITS

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose bits are independent of each other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text with fewer words has its whole sequence
    as one shingle; one without words has none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known = worker_cache().setdefault("word hashes", {})
    if len(known) > CACHE_WORDS:
        known.clear()
    codes = []
    for part in parts:
        code = known.get(part)
        if code is None:
            code = known[part] = xxhash.xxh64_intdigest(part)
        codes.append(code)
    codes = np.array(codes, dtype=np.uint64)
    take = min(words, len(codes))
    if not take:
        return np.zeros(0, np.uint64)
    total = np.full(len(codes) - take + 1, take * 0x2545F4914F6CDD1D % 2 ** 64, np.uint64)
    for k in range(take):
        total = mixed(total * np.uint64(_ODD[k % 5]) + codes[k:k + len(total)])
    return np.unique(total)


def band_count(percent: int) -> int:
    """Bands such that a pair at the threshold shares no bucket with probability LOSS at most."""
    alike = min((percent / 100) ** BAND_ROWS, 1 - 1e-12)
    return max(1, math.ceil(math.log(LOSS) / math.log(1 - alike)))


@functools.cache
def least_estimates(percent: int, count: int) -> np.ndarray:
    """For every number of used registers, up to ``count``, the corrected estimate below which a pair is not verified.

    Equal registers of a pair at the threshold are binomial at worst; fewer than k of them come with probability LOSS at
    most. Where even none is that likely, every pair is verified.
    """
    p, floors = percent / 100, np.zeros(count + 1)
    for used in range(1, count + 1):
        below, k = 0.0, 0
        while k < used and below + math.comb(used, k) * p ** k * (1 - p) ** (used - k) <= LOSS:
            below += math.comb(used, k) * p ** k * (1 - p) ** (used - k)
            k += 1
        floors[used] = max(0.0, (k - used * COLLISION) / (used - used * COLLISION) - 1e-12) if k else 0.0
    return floors


def registers(hashes: np.ndarray, count: int) -> np.ndarray:
    """One 16-bit register per bucket, of ``count``: leading zeros of the smallest hash in it (6 bits) above its next
    MANTISSA_BITS bits, plus one; 0 is an empty bucket.

    The bucket comes from one mix of the hash, zeros and mantissa from another.
    """
    out = np.zeros(count, np.uint16)
    if not len(hashes):
        return out
    bucket = (mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(count)).astype(np.int64)
    value = mixed(hashes + np.uint64(0x14057B7EF767814F))
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, value)
    filled = np.zeros(count, bool)
    filled[bucket] = True
    zeros = 63 - np.floor(np.log2(np.maximum(least, np.uint64(1)).astype(np.longdouble))).astype(np.int64)
    zeros = np.clip(zeros, 0, 62)
    rest = least << np.minimum(zeros + 1, 63).astype(np.uint64)
    mantissa = (rest >> np.uint64(64 - MANTISSA_BITS)).astype(np.int64)
    out[filled] = ((zeros << MANTISSA_BITS) + mantissa + 1)[filled].astype(np.uint16)
    return out


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (last axis), corrected for registers that are equal by chance."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    equal = ((a == b) & (a > 0)).sum(axis=-1)
    chance = used * COLLISION
    return np.where(used > 0, np.clip((equal - chance) / np.maximum(used - chance, 1e-9), 0, 1), 0.0)


def likely(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether estimates leave a pair a chance of being similar enough."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    return estimated(a, b) >= least_estimates(percent, a.shape[-1])[used]


def band_keys(line: np.ndarray) -> list[int]:
    """A 64-bit key for every band with a filled register."""
    keys = []
    for band in range(len(line) // BAND_ROWS):
        part = line[band * BAND_ROWS:(band + 1) * BAND_ROWS]
        if part.any():
            keys.append(xxhash.xxh64_intdigest(part.tobytes(), seed=band) - 2 ** 63)
    return keys


def _set_key(codes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(codes.tobytes()) if len(codes) else None


def text_key() -> Column:
    """A key of the column ``text``; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def sketches(documents: DataFrame, percent: int) -> DataFrame:
    """(page_id, text_key, n_shingles, set_key, registers) of every row with a page_id: one narrow pass over the texts."""
    small_batches(documents.sparkSession)
    count = BAND_ROWS * band_count(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.binary()),
                 pa.array([registers(s, count).tobytes() for s in sets], pa.binary())],
                ["page_id", "text_key", "n_shingles", "set_key", "registers"])

    texts = keyed(documents, "page_id", "text").select(F.col("page_id").cast("long").alias("page_id"), text_key().alias("text_key"), "text")
    return texts.mapInArrow(task, "page_id long, text_key binary, n_shingles long, set_key binary, registers binary")


def _bands(lines: Column | str) -> Column:
    @F.pandas_udf("array<long>")
    def keys(column: pd.Series) -> pd.Series:
        return pd.Series([band_keys(np.frombuffer(x, np.uint16)) for x in column])

    return keys(lines)


def _whole_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted classes (node, page_id, set_key), packed as 64-bit numbers, one row each.

    A page_id may be on several rows, so a text counts only if its set is the class's.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                codes = shingles(text.as_py())
                if _set_key(codes) == key:
                    nodes.append(node)
                    sets.append(codes.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = keyed(documents, "page_id", "text").withColumn("page_id", F.col("page_id").cast("long"))
    # One plan at every size: sorted by page_id, never a broadcast that stops fitting.
    own = texts.join(wanted.hint("merge"), "page_id").select("node", "set_key", "text")
    return own.mapInArrow(task, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _sizes_fit(percent: int, n: Column, m: Column) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _likely(percent: int, a: Column, b: Column) -> Column:
    """Whether registers leave a pair a chance."""
    @F.pandas_udf("boolean")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        rows = [np.frombuffer(b"".join(c), np.uint16).reshape(len(c), -1) for c in (x, y)]
        return pd.Series(likely(*rows, percent))

    return test(a, b)


def holds(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    least, most = sorted((len(p), len(q)))
    if not least or 100 * least < percent * most:
        return False
    at = np.minimum(np.searchsorted(p, q), len(p) - 1)
    both = int((p[at] == q).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _similar(percent: int, a: Column, b: Column) -> Column:
    """Whether 100 * intersection >= percent * union, on whole sets."""
    @F.pandas_udf("boolean")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([holds(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y)], dtype=bool)

    return test(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("u", "v"))
    return pairs.join(a, "u").join(b, "v").filter(_similar(percent, F.col("set_u"), F.col("set_v"))).select("u", "v")


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with their component so far, which is the node itself where it has no links."""
    return nodes.join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))


def _to_hubs(members: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Pairs of every bucket member with the bucket's hub, its member with the most neighbours in all buckets."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = members.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = members.join(weight, "node")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("low")))["low"].alias("low"))
    pairs = members.join(hubs.select("bucket", (-F.col("low")).alias("hub")), "bucket").filter("node <> hub")
    pairs = pairs.select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
    a, b = (lines.select(F.col("node").alias(c), F.col("registers").alias(f"line_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in ("u", "v"))
    return pairs.join(a, "u").join(b, "v").filter(_sizes_fit(percent, F.col("n_u"), F.col("n_v"))).filter(
        _likely(percent, F.col("line_u"), F.col("line_v"))).select("u", "v")


def _meetings(members: DataFrame, lines: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(rows_a, rows_b): pairs of blocks of members (bucket, node, component) of one bucket, with ``columns`` of lines.

    A bucket's members are dealt to blocks of about ``block``: those of a large component to blocks of their own, the others
    to mixed ones by component. Only blocks that can hold different components meet, so a group of copies that is one
    component costs nothing, and no task gets a whole bucket.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    # One row per bucket with several components; everything else is settled.
    several = counts.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") < block, F.col("n")).otherwise(0)).alias("loose")) \
        .filter("kinds > 1")
    dealt = members.join(counts, ["bucket", "component"]).join(several, "bucket")
    own = F.col("n") > block - 1
    dealt = dealt.select(
        "bucket", "node", "component", F.when(own, F.col("component")).otherwise(F.lit(None).cast("long")).alias("group"),
        F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)))
        .otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.greatest("loose", F.lit(1)) / block))).alias("block"))
    blocks = dealt.join(lines, "node").groupBy("bucket", "group", "block").agg(
        F.collect_list(F.struct("node", "component", "n_shingles", "registers", *columns)).alias("rows"))
    a = blocks.select("bucket", F.col("group").alias("group_a"), F.col("block").alias("block_a"), F.col("rows").alias("rows_a"))
    b = blocks.select("bucket", F.col("group").alias("group_b"), F.col("block").alias("block_b"), F.col("rows").alias("rows_b"))
    place_a, place_b = (F.struct(F.coalesce(F.col(f"group_{x}"), F.lit(-2 ** 63)), F.col(f"block_{x}")) for x in "ab")
    return a.join(b, "bucket").filter((place_a <= place_b) & (F.col("group_a").isNull() | F.col("group_b").isNull() | (
        F.col("group_a") != F.col("group_b")))).select("rows_a", "rows_b")


def _joined(meetings: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Edges (u, v) that join what the likely pairs of different components in each pair of blocks join; ``whole``: the
    pairs that hold on whole sets instead. Each pair of blocks gives at most as many edges as it has members.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for sides in zip(batch.column(0), batch.column(1)):
                ids, kinds, sizes, rows, sets = [], [], [], [], []
                for side in (x.values for x in sides):
                    for out, name in ((ids, "node"), (kinds, "component"), (sizes, "n_shingles")):
                        out.append(side.field(name).to_numpy(zero_copy_only=False))
                    rows.append(np.frombuffer(b"".join(side.field("registers").to_pylist()), np.uint16).reshape(len(ids[-1]), -1))
                    if whole:
                        sets.append([np.frombuffer(x, np.uint64) for x in side.field("shingles").to_pylist()])
                small, large = (f(sizes[0][:, None], sizes[1][None, :]) for f in (np.minimum, np.maximum))
                good = (kinds[0][:, None] != kinds[1][None, :]) & (100 * small >= percent * large)
                for at in range(0, len(ids[0]) if good.any() else 0, BLOCK):
                    part = slice(at, at + BLOCK)
                    good[part] &= likely(rows[0][part, None, :], rows[1][None, :, :], percent)
                found = [(i, j) for i, j in np.argwhere(good).tolist() if not whole or holds(sets[0][i], sets[1][j], percent)]
                if found:
                    # Smallest member reached inside the blocks: the edges to it join the same members as all pairs do.
                    every = np.concatenate(ids)
                    i, j = np.array(found).T
                    j = j + len(ids[0])
                    low = every.copy()
                    before = None
                    while before is None or (low != before).any():
                        before = low.copy()
                        least = np.minimum(low[i], low[j])
                        np.minimum.at(low, i, least)
                        np.minimum.at(low, j, least)
                    moved = np.flatnonzero(low != every)
                    us += every[moved].tolist()
                    vs += low[moved].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return meetings.mapInArrow(task, "u long, v long").distinct()


def _grouped(documents: DataFrame, percent: int) -> DataFrame:
    """(page_id, text_key, n_shingles, lowest): every row with the smallest page_id it reaches, and ``group``, its component.

    Rows without words have no group. See ``near_copies``.
    """
    rows = stored(sketches(documents, percent), "sketches")
    # Classes are numbered once they are stored: a page_id may be on rows of several classes.
    classes = stored(rows.filter("set_key is not null").groupBy("set_key").agg(
        F.min("page_id").alias("page_id"), F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles")), "classes")
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "numbered")
    nodes = classes.select("node", "registers", "n_shingles")
    bands = nodes.select("node", F.explode(_bands("registers")).alias("bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    members = stored(bands.join(full, "bucket"), "members")
    ids = members.select("node").distinct()
    lines = stored(nodes.join(ids, "node", "left_semi"), "lines")
    texts = classes.select("node", "page_id", "set_key")
    pairs = stored(_to_hubs(members, lines, percent), "pairs")
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = stored(_whole_sets(documents, texts.join(wanted, "node", "left_semi")), "sets")
    links = stored(_verified(pairs, sets, percent), "links")
    joined = stored(_labelled(ids, components(links)), "joined")
    chances = stored(_joined(_meetings(members.join(joined, "node"), lines, [], SKETCH_BLOCK), percent, False), "likely")
    families = stored(components(chances).select("node", F.col("component").alias("bucket")), "families")
    rest = families.join(sets, "node", "left_anti").select("node")
    sets = sets.union(stored(_whole_sets(documents, texts.join(rest, "node", "left_semi")), "sets"))
    meetings = _meetings(families.join(joined, "node"), lines.join(sets, "node"), ["shingles"], BLOCK)
    links = links.union(stored(_joined(meetings, percent, True), "links"))
    joined = stored(_labelled(ids, components(links)), "joined")
    placed = _labelled(classes.select("set_key", "page_id", "node"), joined).select("set_key", "page_id", F.col("component").alias("group"))
    lowest = placed.groupBy("group").agg(F.min("page_id").alias("lowest"))
    return rows.drop("registers").join(placed.join(lowest, "group").drop("page_id"), "set_key", "left").drop("set_key")


def near_copies(documents: DataFrame, percent: int = 80) -> DataFrame:
    """Classes of near copies among the texts of ``documents`` (page_id, text).

    Two pages link when 100 * intersection >= ``percent`` * union of their sets of five-word shingles; words are runs of
    anything but ASCII white space with A-Z in lower case. A shorter text is one shingle; null texts and texts without
    words have none and link with nothing.

    1. One pass over the texts gives each page a key of its whole set and a HyperMinHash sketch: registers that hold the
       leading zeros and mantissa bits of the smallest hash of their bucket. Rows with equal sets are one class from here on.
    2. Bands of BAND_ROWS registers are bucket keys; there are so many that a pair at the threshold shares no bucket with
       probability LOSS at most (22 bands at 85, 29 at 80).
    3. Bucket members are paired with their bucket's hub; pairs whose collision-corrected estimate is not too low are
       verified on whole sets. How low is too low follows from the threshold and the registers in use: a pair at the
       threshold is turned down with probability LOSS at most. The links' components join most groups at once, however
       many copies they have.
    4. Members of one bucket that are still in different components are compared by their estimates, block by block. What
       likely pairs join is a family; the members of a family that are in different components are compared on whole
       sets, again block by block. So a link between components is left untested with probability 2 * LOSS at most, and
       blocks give edges, not pairs.

    Returns one row per row with a page_id: page_id, n_shingles, component_id (the smallest page_id reachable, itself
    included), kept (page_id = component_id). Rows that repeat a page_id stay separate rows, each with the links of its own
    text. Other columns are ignored; an empty table gives no rows. Intermediate tables go to the shared folder; links are
    never collected.
    """
    return _grouped(documents, percent).select(
        "page_id", "n_shingles", F.coalesce("lowest", "page_id").alias("component_id")).withColumn("kept", F.col("page_id") == F.col("component_id"))


def surplus_copies(documents: DataFrame, percent: int = 80) -> DataFrame:
    """(page_id, text_key) of the texts that go when one of each group of near copies stays: the one with the smallest
    page_id and, of several under it, with the smallest key. Rows without words are in no group and stay.
    """
    grouped = stored(_grouped(documents, percent).filter("group is not null").select("page_id", "text_key", "group").distinct(), "grouped")
    first = grouped.groupBy("group").agg(F.min(F.struct("page_id", "text_key")).alias("first"))
    return grouped.join(first, "group").filter(F.struct("page_id", "text_key") != F.col("first")).select("page_id", "text_key")
