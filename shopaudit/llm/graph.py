"""Connected components of a large, sparse graph by alternating stars over edges that each task has shortened."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Edges a task holds at once (16 bytes each).
CHUNK = 2 ** 20


def star_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the smallest of its component in these edges, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[:len(u)], at[len(u):]
    low = np.arange(len(nodes))
    before = None
    while before is None or (low != before).any():
        before = low.copy()
        least = np.minimum(before[i], before[j])
        for ends in (i, j, before[i], before[j]):
            np.minimum.at(low, ends, least)
        low = low[low]
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]


def _shortened(edges: DataFrame) -> DataFrame:
    """Edges (u > v) with the same components: each task joins what its own edges join, CHUNK of them at a time."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, n = [], [], 0
        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
            n += len(us[-1])
            if n >= CHUNK:
                u, v = star_edges(np.concatenate(us), np.concatenate(vs))
                if len(u) >= CHUNK // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u, v = u[:0], v[:0]
                us, vs, n = [u], [v], len(u)
        if n:
            u, v = star_edges(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(task, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """The upper ends of a node's edges go to its own smallest neighbour, where that is smaller than the node."""
    low = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return edges.join(low, F.col("v") == F.col("node"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The lower ends of a node's edges, and the node, go to the smallest of them."""
    low = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    moved = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return low.select(moved.alias("e")).select("e.u", "e.v").filter("u <> v")


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two different lower ends, or a lower end and an upper one."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("low")).union(edges.select("v", F.lit(None).cast("long")))
    found = ends.groupBy("node").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.count_if(F.col("low").isNull()).alias("n"))
    return bool(found.filter((F.col("a") != F.col("b")) | (F.col("a").isNotNull() & (F.col("n") > 0))).agg(F.count("*")).first()[0])


def _settled(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Stored edges, shortened by one task for each CHUNK of them, and whether every node has one edge at most, to the
    smallest node of its component. What one task holds whole needs no further look.
    """
    tasks = max(1, math.ceil(edges.count() / CHUNK))
    edges = stored(_shortened(edges.coalesce(tasks)), "edges")
    return edges, tasks == 1 or not _unsettled(edges)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its smallest node.

    Each round writes its edges to the shared folder, so a lost executor costs one round at most. Between rounds tasks join
    what their own edges join, so that few rounds are left. Null ends and loops are ignored; an empty edge table gives an
    empty result.
    """
    edges, done = _settled(stored(_shortened(edges.filter("u <> v")), "edges"))
    while not done:
        edges, done = _settled(stored(_small_star(_large_star(edges)), "edges"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
