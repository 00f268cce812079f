"""What the operators share: code shipped with the tasks, caches of a worker, and arrays in binary columns."""
from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, stored

# Functions of this subpackage travel with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for models read from files."""
    return sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache")).__dict__


def small_batches(spark: SparkSession, records: int = 1000, size: str = "16m") -> None:
    """Bound the Arrow batches a Python stage gets, so that very long rows do not meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def keyed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The named columns of the rows whose key is known; other columns, whatever their names, stay out."""
    return df.select(F.col(key), *columns).filter(F.col(key).isNotNull())


def held_out(key, folds: int, fold: int):
    """Whether a row belongs to the fold that is never learned from: crc32 of the key as text."""
    return F.crc32(key.cast("string").cast("binary")) % folds == fold


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


__all__ = ["held_out", "keyed", "new_path", "shared_folder", "small_batches", "stored", "worker_cache"]
