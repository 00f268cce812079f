"""Intake that converges: a stream of changes kept as a table of newest rows, however often a batch is delivered.

A table is a folder of buckets. A batch rewrites the buckets its keys fall into, each as a new version beside the old one,
and then publishes which version of every bucket counts by one small file that is either there or not. Readers see the
state before the batch or after it; files of a batch that failed in between are seen by nobody and written anew.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import first_by

BUCKETS = 16


class ChangeTable:
    """Newest row per key of a stream of changes, in the folder ``path``.

    ``order`` says which of two rows of a key is newer; it must not tie between different rows. The number of buckets is
    fixed when the table is first written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[Column], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path.rstrip("/"), schema, list(keys), list(order), buckets

    def _files(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def ledger(self) -> dict:
        """The newest entry: the last batch that counts, and the version of every bucket."""
        place, files = self._files()
        found = sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []
        found = [x for x in found if x.endswith(".json")]
        if not found:
            return {"batch": -1, "versions": {}}
        stream = files.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, found[-1]))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, entry: dict) -> None:
        """Add an entry by a rename, which cannot replace one that is there."""
        place, files = self._files()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        name = f"{entry['batch']:012d}.json"
        draft, final = path(place, f".{name}"), path(place, name)
        stream = files.create(draft, True)
        stream.write(json.dumps(entry).encode())
        stream.close()
        if not files.rename(draft, final):
            raise RuntimeError(f"entry {name} of {self.path} was published by another writer")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as of its last entry, or the rows of some buckets."""
        versions = {int(b): v for b, v in self.ledger()["versions"].items()}
        wanted = sorted(versions if buckets is None else set(versions) & set(buckets))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/batch={versions[b]}/bucket={b}" for b in wanted])

    def upsert(self, changes: DataFrame, batch: int, after_write: Callable[[int], None] = lambda batch: None) -> None:
        """Apply one batch. A batch that counts already changes nothing; ``after_write`` runs before the entry is published."""
        entry = self.ledger()
        if batch <= entry["batch"]:
            return
        rows = changes.select(*StructType.fromDDL(self.schema).fieldNames()).withColumn("bucket", self._bucket()).persist()
        try:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
            both = rows.unionByName(self.rows(touched).withColumn("bucket", self._bucket()))
            newest = first_by(both, self.keys, self.order)
            folder = f"{self.path}/batch={batch}"
            newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        finally:
            rows.unpersist()
        after_write(batch)
        self._publish({"batch": batch, "versions": entry["versions"] | {str(b): batch for b in touched}})

    def take_in(self, stream: DataFrame, checkpoint: str, after_write: Callable[[int], None] = lambda batch: None) -> None:
        """Run a stream of changes into the table over everything that is there."""
        query = (stream.writeStream.foreachBatch(lambda changes, batch: self.upsert(changes, batch, after_write))
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
