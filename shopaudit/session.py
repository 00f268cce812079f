"""Session settings and the few job-level helpers every operator shares."""
from __future__ import annotations

import functools
import atexit
import uuid
import weakref
from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Nested pruning would repeat a struct's whole expression for each of its fields below an explode.
    "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
    # Case mapping by the JVM: the same results here and several times faster than ICU.
    "spark.sql.icu.caseMappings.enabled": "false",
    # JSON-LD blocks that repeat a key are still read.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


_FOLDERS: set[str] = set()

# Call-site capture makes every column function several times slower to call; only a new session can turn it off.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on. Partition counts stay with the cluster's own configuration."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This session's folder in a place all executors see: spark.checkpoint.dir or, where that is unset, the warehouse.

    What a session has written there goes when its driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/stages-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_removed, spark, folder)
    return folder


def _removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables through Spark's own file system; nothing to do once the session is gone."""
    if spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back: cuts lineage, and later passes read only their columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def built_once(build: Callable) -> Callable:
    """Keep what ``build`` returns for the running JVM.

    The column expressions of the extraction and the checks have thousands of nodes, and creating one node from Python
    takes a round trip; they depend on nothing but column names and vocabularies.
    """
    kept: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

    @functools.wraps(build)
    def wrapper(*args):
        own = kept.setdefault(SparkContext._gateway, {})
        if repr(args) not in own:
            own[repr(args)] = build(*args)
        return own[repr(args)]
    return wrapper


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), 0)


def derive(df: DataFrame, **columns: Column) -> DataFrame:
    """Add computed columns behind a generator of one row.

    Filters and join conditions on the new columns stay above it, where plain columns would be copied, with their
    whole expression, into every pushed-down predicate.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spread(df: DataFrame, column: str) -> DataFrame:
    """Deal rows to as many tasks as a shuffle has, before a step that costs much for few bytes; adaptive execution goes by
    bytes and would put them into one or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(column))


def positions(df: DataFrame, keys: Sequence[str], order: str, name: str = "position",
              target: int = 1_000_000) -> DataFrame:
    """Dense 0-based rank of ``order`` (a unique number) within ``keys``, safe for one huge group.

    A group larger than ``target`` is cut into ranges of ``order``; rows are ranked inside their range and the sizes
    of the earlier ranges are added. The cut depends on the data alone, so a recomputed task cuts the same way. Groups that
    are cut, and their ranges, number one for each ``target`` rows or so; they are sent to all tasks, so the rows themselves
    are shuffled and sorted once.
    """
    keys = list(keys)
    spread = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count("*").alias("_n"))
    big = spread.filter(F.col("_n") > target).withColumn("_cuts", F.ceil(F.col("_n") / target))
    width = (F.col("_hi") - F.col("_lo") + 1) / F.col("_cuts")
    cut = df.join(F.broadcast(big.select(*keys, "_lo", width.alias("_w"))), keys, "left").withColumn(
        "_range", F.coalesce(F.floor((F.col(order) - F.col("_lo")) / F.col("_w")), F.lit(0)))
    sizes = cut.filter(F.col("_w").isNotNull()).groupBy(*keys, "_range").count()
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    # Only groups that were cut need an offset, so the join side stays small and empty in the usual case.
    offsets = offsets.filter(F.col("_range") > 0)
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    ranked = cut.withColumn("_row", F.row_number().over(inside) - 1)
    return (ranked.join(F.broadcast(offsets), keys + ["_range"], "left")
            .withColumn(name, F.col("_row") + F.coalesce("_offset", F.lit(0)))
            .drop("_lo", "_w", "_range", "_row", "_offset"))


def running_totals(df: DataFrame, order: Sequence[Column], **values: Column) -> DataFrame:
    """Running sums of ``values`` over the whole table in a total order of any columns, without gathering it in one task.

    Rows are dealt to ranges of the order by quantiles and stored, so that every later pass sees the same ranges; each
    range is summed on its own, and the totals of the ranges before it, one row per range, are added.
    """
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.select("*", *[v.cast("long").alias(f"_{n}") for n, v in values.items()])
                   .repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted(dealt.groupBy("_range").agg(*[F.sum(f"_{n}").alias(n) for n in values]).collect())
    before = {n: 0 for n in values}
    offsets = []
    for row in sums:
        offsets.append((row["_range"], *before.values()))
        before = {n: before[n] + (row[n] or 0) for n in values}
    small = spark.createDataFrame(offsets, "_range int, " + ", ".join(f"_before_{n} long" for n in values))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = {n: F.sum(f"_{n}").over(inside) + F.col(f"_before_{n}") for n in values}
    # As many rows as there are ranges.
    return dealt.join(F.broadcast(small), "_range").withColumns(totals).drop(
        "_range", *[f"_{n}" for n in values], *[f"_before_{n}" for n in values])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_first") -> DataFrame:
    """The first row of every key group. Spark prunes each task to one row per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) == 1).drop(name)
