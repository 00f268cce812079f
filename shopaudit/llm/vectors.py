"""All pairs of vectors above a cosine, by cover trees traversed in pairs."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored
from .graph import components, star_edges

BLOCK = 2048
#: A block has this many vectors at most, whatever their hashes; a class is numbered by its block times this, plus its place.
LIMIT = BLOCK + BLOCK // 4
#: Bytes of a block of wide vectors in double precision; those of up to 1,024 components have BLOCK vectors.
BODY = 2 ** 24
PIVOTS = 512
LEVELS = 7
#: Rows of one matrix product: its results stay in a core's cache while they are compared.
STRIP = 256
#: Sums of links that a task holds before it puts those of equal vectors together.
HELD = 2 ** 20
#: Slack of the pruning bounds against rounding; links themselves are decided by the cosine in double precision.
SLACK = 1e-6


def cover_tree(points: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, list[dict]]:
    """A nested cover of unit vectors: (order, levels), the points of every node being a range of ``order``.

    Level k has the covering radius 2 ** -k: every node's points lie that close to its centre, which is one of them, and
    nodes of a level nest in those above. Each level is a dict of arrays: centre (a place in the order), start, stop,
    radius (the farthest own point) and parent.
    """
    groups, nodes = [np.arange(len(points))], []
    parents = np.zeros(1, int)
    for k in range(levels):
        if k:
            split, parents = [], []
            for number, group in enumerate(groups):
                for part in _covered(points, group, 2.0 ** -k):
                    split.append(part)
                    parents.append(number)
            groups, parents = split, np.array(parents)
        sizes = np.array([len(g) for g in groups])
        stop = np.cumsum(sizes)
        radius = np.array([math.sqrt(max(0.0, 2 - 2 * (points[g] @ points[g[0]]).min())) if len(g) > 1 else 0.0 for g in groups])
        nodes.append({"start": stop - sizes, "stop": stop, "radius": radius, "parent": parents, "first": [g[0] for g in groups]})
    order = np.concatenate(groups)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    for level in nodes:
        level["centre"] = place[level.pop("first")]
    return order, nodes


def _covered(points: np.ndarray, group: np.ndarray, radius: float) -> list[np.ndarray]:
    """Greedy parts of ``group``, each within ``radius`` of its first point; the parent's centre stays a centre."""
    parts, rest, near = [], group, 1 - radius * radius / 2
    while len(rest) > 1:
        inside = points[rest] @ points[rest[0]] >= near
        inside[0] = True
        parts.append(rest[inside])
        rest = rest[~inside]
    return parts + ([rest] if len(rest) else [])


def packed_tree(nodes: list[dict]) -> tuple[bytes, bytes]:
    """A cover tree in few bytes: for every place the first level with a node that starts there, as one byte, and the radii
    of the nodes of more than one point. Nodes nest and begin with their centre, so nothing else is needed."""
    first = np.full(nodes[0]["stop"][0], len(nodes), np.uint8)
    for k in reversed(range(len(nodes))):
        first[nodes[k]["start"]] = k
    return first.tobytes(), np.concatenate([x["radius"][x["stop"] - x["start"] > 1] for x in nodes]).tobytes()


def unpacked_tree(first: np.ndarray, radii: np.ndarray, levels: int = LEVELS) -> list[dict]:
    """The levels of ``cover_tree`` from the two arrays of ``packed_tree``."""
    nodes, above, used = [], np.zeros(1, int), 0
    for k in range(levels):
        start = np.flatnonzero(first <= k)
        stop = np.append(start[1:], len(first))
        radius, wide = np.zeros(len(start)), stop - start > 1
        radius[wide] = radii[used:used + wide.sum()]
        used += wide.sum()
        nodes.append({"start": start, "stop": stop, "radius": radius, "centre": start,
                      "parent": np.searchsorted(above, start, "right") - 1})
        above = start
    return nodes


def _near(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of ``x`` and j of ``y`` whose product is at least ``least`` of row i, and the products, strip by strip."""
    found = []
    for s in range(0, len(x), STRIP):
        dots = x[s:s + STRIP] @ y.T
        some = np.flatnonzero(dots.max(axis=1) >= least[s:s + STRIP])
        if len(some):
            dots = dots[some]
            i, j = np.nonzero(dots >= least[s + some][:, None])
            found.append((s + some[i], j, dots[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))


def linked(a: tuple, b: tuple, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places (i, j) with cosine at least ``cosine`` between two trees (points in tree order, levels).

    Both trees are descended together, level by level; a pair of nodes goes on only if its centres are within both
    radii and the distance of ``cosine``, until both are single points. Products are taken in single precision; where its
    rounding could matter, a pair goes on, and the cosine of two points is taken again in double precision. ``same``:
    both are one tree, and each pair comes once.
    """
    (p, nodes_p), (q, nodes_q) = a, b
    p_single, q_single = p.astype(np.float32), q.astype(np.float32)
    rounding = (p.shape[1] + 8) * 2.0 ** -23
    far = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    left = right = np.zeros(1, int)
    sure, close = [], []
    for x, y in zip(nodes_p, nodes_q):
        # The children of what is left, and which of them have parents that are left as a pair.
        above_x, above_y = np.unique(left), np.unique(right)
        both = np.zeros((len(above_x), len(above_y)), bool)
        both[np.searchsorted(above_x, left), np.searchsorted(above_y, right)] = True
        rows, columns = (np.flatnonzero(np.isin(z["parent"], w)) for z, w in ((x, above_x), (y, above_y)))
        parent_x, parent_y = np.searchsorted(above_x, x["parent"][rows]), np.searchsorted(above_y, y["parent"][columns])
        reach = x["radius"][rows] + y["radius"][columns].max() + far
        i, j, dots = _near(p_single[x["centre"][rows]], q_single[y["centre"][columns]], 1 - reach * reach / 2 - rounding)
        reach = x["radius"][rows[i]] + y["radius"][columns[j]] + far
        good = (dots >= 1 - reach * reach / 2 - rounding) & both[parent_x[i], parent_y[j]]
        left, right, dots = rows[i[good]], columns[j[good]], dots[good]
        if same:
            good = left <= right
            left, right, dots = left[good], right[good], dots[good]
        single = (x["stop"][left] - x["start"][left] == 1) & (y["stop"][right] - y["start"][right] == 1)
        i, j, dots = x["start"][left[single]], y["start"][right[single]], dots[single]
        above = dots >= cosine + rounding
        sure.append((i[above], j[above]))
        near = ~above & (dots >= cosine - rounding)
        close.append((i[near], j[near]))
        left, right = left[~single], right[~single]
        if not len(left):
            break
    i, j = (np.concatenate(c) for c in zip(*close))
    for s in range(0, len(i), 2 ** 16):
        m, n = i[s:s + 2 ** 16], j[s:s + 2 ** 16]
        good = np.einsum("ij,ij->i", p[m], q[n]) >= cosine
        sure.append((m[good], n[good]))
    for u, v in zip(left, right):
        s, t = x["start"][u], y["start"][v]
        m, n = np.nonzero(p[s:x["stop"][u]] @ q[t:y["stop"][v]].T >= cosine)
        sure.append((m + s, n + t))
    i, j = (np.concatenate(c) for c in zip(*sure))
    return (i[i < j], j[i < j]) if same else (i, j)


def smallest_in_reach(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every place the smallest id it reaches over the pairs (i, j)."""
    low = ids.copy()
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        if (low == before).all():
            break
    return low


def unit(vectors: list) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.array(vectors, dtype=float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def together(ids: np.ndarray, links: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partial sums put together: every id once, with the sum of its links and the smallest id it reaches over all rows."""
    nodes, at = np.unique(ids, return_inverse=True)
    total, least = np.zeros(len(nodes), np.int64), nodes.copy()
    np.add.at(total, at, links)
    moved, smallest = star_edges(ids, low)
    least[np.searchsorted(nodes, moved)] = smallest
    return nodes, total, least


def _keyed(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a key of their vector (null: links with nothing); components in single precision stay so."""
    v = F.col("vector")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    body = v if vectors.schema["vector"].dataType.elementType == T.FloatType() else v.cast("array<double>")
    return vectors.select("vector_id", "vector").filter("vector_id is not null").select("vector_id", body.alias("vector"), F.when(
        usable, F.struct(F.xxhash64(F.lit(1), v).alias("a"), F.xxhash64(F.lit(2), v).alias("b"), F.size(v).alias("width"))).alias("key"))


def _size(width: int) -> int:
    """Vectors of a block."""
    return max(1, min(BLOCK, BODY // (8 * width)))


def _pivots(vectors: DataFrame, rows: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors by width: those of the smallest hashes, one for each block that the width fills, PIVOTS at most.

    Only the 64 commonest widths have pivots; the others share one, are rare and cut by salt all the same.
    """
    keys = rows.filter("key is not null").select("key").distinct()
    chosen = []
    for row in keys.groupBy("key.width").count().orderBy(F.desc("count"), "width").limit(64).collect():
        wanted = min(PIVOTS, math.ceil(row["count"] / _size(row["width"])))
        chosen += keys.filter(F.col("key.width") == row["width"]).orderBy("key").limit(wanted).collect()
    if not chosen:
        return {}
    wanted = F.broadcast(vectors.sparkSession.createDataFrame(chosen, keys.schema))
    found = vectors.join(wanted, "key").groupBy("key").agg(F.first("vector").alias("vector")).collect()
    by_width = {}
    for row in sorted(found, key=lambda r: tuple(r["key"])):
        by_width.setdefault(row["key"]["width"], []).append(row["vector"])
    return {width: unit(points) for width, points in by_width.items()}


def _taken(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """The vectors at these places, all of one width, as rows of a matrix."""
    return column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)


def _blocks(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """Blocks of about BLOCK different vectors near the same pivot (number, width, copies, key_a, key_b, points and its cover
    tree); a pivot with more vectors is cut into several blocks.

    Vectors are shuffled once, to their block. Equal ones have one block, as it follows from the vector; they become one row
    there, after those that meet in an Arrow batch have become one already. The sizes, which the cuts need, come from keys alone.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(_pivots(vectors, rows))

    def nearest(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("place", pa.array(np.arange(batch.num_rows)))
            table = table.group_by(["a", "b", "width"], use_threads=False).aggregate([("place", "min"), ("copies", "sum")])
            at, widths = table["place_min"].to_numpy(), table["width"].to_numpy()
            pivot = np.zeros(len(at), np.int32)
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                if width in shared.value:
                    pivot[own] = np.argmax(unit(_taken(batch.column("vector"), at[own])) @ shared.value[width].T, axis=1)
            columns = {"a": table["a"], "b": table["b"], "width": table["width"], "pivot": pa.array(pivot)}
            if bodies:
                columns |= {"copies": table["copies_sum"], "vector": batch.column("vector").take(pa.array(at))}
            yield from pa.table(columns).combine_chunks().to_batches()

    kind = vectors.schema["vector"].dataType.simpleString()
    flat = vectors.filter("key is not null").select("key.*", F.lit(1).cast("long").alias("copies"), "vector")
    keys = flat.mapInArrow(lambda batches: nearest(batches, False), "a long, b long, width int, pivot int")
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BODY // 8) / F.col("width"))))
    # Neighbouring pivots with few vectors stay blocks of their own: their radius is what prunes.
    sizes = stored(keys.groupBy("width", "pivot").agg(F.ceil(F.approx_count_distinct("a", 0.02) / size).alias("salts")), "sizes")
    placed = flat.mapInArrow(lambda batches: nearest(batches, True), f"a long, b long, width int, pivot int, copies long, vector {kind}")
    # As many rows as there are pivots, and one for each rare width.
    salted = placed.join(F.broadcast(sizes), ["width", "pivot"]).withColumn("salt", F.pmod("b", F.col("salts"))).drop("salts")

    def body(group: pa.Table) -> pa.Table:
        width, kept, n = group["width"][0].as_py(), [], group.num_rows
        for part in np.array_split(np.arange(n), math.ceil(n / min(LIMIT, 2 * _size(width)))):
            found = group.take(pa.array(part)).combine_chunks()
            raw = _taken(found["vector"].chunk(0), np.arange(len(part)))
            points = unit(raw)
            order, nodes = cover_tree(points)
            first, radii = packed_tree(nodes)
            kept.append({"width": width, "points": raw[order].tobytes(), "first": first, "radii": radii, "centre": points[order[0]].tolist(),
                         "radius": float(nodes[0]["radius"][0]), "copies": found["copies"].to_numpy()[order].tolist(),
                         "key_a": found["a"].to_numpy()[order].tolist(), "key_b": found["b"].to_numpy()[order].tolist()})
        return pa.Table.from_pylist(kept, schema=shape)

    longs = pa.list_(pa.int64())
    shape = pa.schema([("width", pa.int32()), ("points", pa.binary()), ("first", pa.binary()), ("radii", pa.binary()), ("centre", pa.list_(pa.float64())),
                       ("radius", pa.float64()), ("copies", longs), ("key_a", longs), ("key_b", longs)])
    names = "width int, points binary, first binary, radii binary, centre array<double>, radius double, copies array<long>, key_a array<long>, key_b array<long>"
    # A tree costs much for few bytes, so the blocks are dealt to all tasks. Equal vectors meet there without another shuffle.
    dealt = salted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "width", "pivot", "salt")
    classes = dealt.groupBy("width", "pivot", "salt", "a", "b").agg(F.sum("copies").alias("copies"), F.first("vector").alias("vector"))
    return stored(classes.groupBy("width", "pivot", "salt").applyInArrow(body, names).withColumn("number", F.monotonically_increasing_id()), "blocks")


def _met(blocks: DataFrame, cosine: float, single: bool) -> DataFrame:
    """(class_id, links, component so far): partial sums of all pairs of blocks that the roots' radii do not part.

    Every task reads two parts of the stored blocks and joins them (a Cartesian product), so no block is shuffled or written
    again, however many others it meets. A pair of blocks is met in one of its two orders, by a hash, so tasks have equal shares.
    """
    spark = blocks.sparkSession
    far = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    dot = F.aggregate(F.zip_with("centre", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reach = F.col("radius") + F.col("radius_b") + far
    i, j = F.col("number"), F.col("number_b")
    once = (i == j) | (F.when(F.pmod(F.xxhash64(F.least(i, j), F.greatest(i, j)), F.lit(2)) == 0, i < j).otherwise(i > j) & (2 - 2 * dot <= reach * reach))
    body = ["number", "width", "points", "first", "radii", "copies", "centre", "radius"]
    other = blocks.select([F.col(c).alias(f"{c}_b") for c in body])
    pairs = blocks.select(body).join(other.hint("shuffle_replicate_nl"), (F.col("width") == F.col("width_b")) & once)

    def side(batch: pa.RecordBatch, row: int, end: str) -> tuple:
        value = lambda name: batch.column(name + end)[row]
        points = np.frombuffer(value("points").as_buffer(), np.float32 if single else np.float64).reshape(-1, value("width").as_py())
        tree = unpacked_tree(np.frombuffer(value("first").as_buffer(), np.uint8), np.frombuffer(value("radii").as_buffer()))
        return value("number").as_py() * LIMIT + np.arange(len(points)), value("copies").values.to_numpy(), (unit(points), tree)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = left = None
        held, n = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("number")[row] == batch.column("number_b")[row]
                if left is None or batch.column("number")[row].as_py() != number:
                    number, left = batch.column("number")[row].as_py(), side(batch, row, "")
                (ids, copies, a), (ids_b, copies_b, b) = left, left if same else side(batch, row, "_b")
                i, j = linked(a, b, cosine, same)
                if not len(i):
                    continue
                every, weight = (ids, copies) if same else (np.concatenate([ids, ids_b]), np.concatenate([copies, copies_b]))
                j = j if same else j + len(ids)
                links = np.zeros(len(every), np.int64)
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                low = smallest_in_reach(i, j, every)
                hit = np.flatnonzero(links)
                held.append((every[hit], links[hit], low[hit]))
                n += len(hit)
                if n >= HELD:
                    held = [together(*(np.concatenate(c) for c in zip(*held)))]
                    n = len(held[0][0])
                    if n >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["class_id", "links", "low"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in together(*(np.concatenate(c) for c in zip(*held)))], ["class_id", "links", "low"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    return pairs.drop("centre", "centre_b", "radius", "radius_b").mapInArrow(task, "class_id long, links long, low long")


def similar_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Links of all ``vectors`` (vector_id, vector: an array of numbers) whose cosine is at least ``cosine``.

    The reference keeps no vectors, so this works on any such table (say, embeddings of claims or pages). Unit vectors
    link when their distance is at most sqrt(2 - 2 * cosine). Equal vectors are one class. Classes are dealt to blocks
    around pivots; each block gets a cover tree of nested levels with halving radii. Pairs of blocks, then pairs of nodes
    level by level, are dropped when their centres are farther apart than both radii and that distance; what is left
    is decided by the cosine in double precision. So every pair is found and none below. Blocks have a bounded size and are
    stored once; the vectors are shuffled once. So disk grows as the table, also where no pair of blocks is dropped and time
    grows as its square.

    Returns one row per row with a vector_id: vector_id, n_links (other rows linked directly), component_id (the smallest
    vector_id reachable, itself included), kept (vector_id = component_id). Vectors that are null, empty, all zero or
    hold a component that is null or not finite link with nothing, as do vectors of different widths. Rows that repeat
    a vector_id count as rows, each with the links of its own vector. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    vectors = _keyed(vectors)
    rows = stored(vectors.select("vector_id", "key"), "rows")
    blocks = _blocks(vectors, rows)
    met = stored(_met(blocks, cosine, vectors.schema["vector"].dataType.elementType == T.FloatType()), "met")
    small_batches(spark)
    reach = components(met.select(F.col("class_id").alias("u"), F.col("low").alias("v"))).withColumnRenamed("node", "class_id")
    links = met.groupBy("class_id").agg(F.sum("links").alias("links"))
    # Classes are numbered by block and place: a vector_id may be on rows of several classes.
    classes = blocks.select("number", "width", F.posexplode(F.arrays_zip("copies", "key_a", "key_b")).alias("place", "c")).select(
        F.struct(F.col("c.key_a").alias("a"), F.col("c.key_b").alias("b"), "width").alias("key"), (F.col("number") * LIMIT + F.col("place")).alias("class_id"),
        F.col("c.copies").alias("copies"))
    smallest = rows.filter("key is not null").groupBy("key").agg(F.min("vector_id").alias("vector_id"))
    placed = classes.join(smallest, "key").join(links, "class_id", "left").join(reach, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    lowest = placed.groupBy("component").agg(F.min("vector_id").alias("component_id"))
    # Equal vectors that rounding dealt to two pivots are two classes with the same links, which hold each other.
    found = placed.join(lowest, "component").groupBy("key").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min("component_id").alias("component_id"))
    own = F.col("vector_id")
    return rows.join(found, "key", "left").select(
        "vector_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", own).alias("component_id"),
        (F.coalesce("component_id", own) == own).alias("kept"))
