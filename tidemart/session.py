"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ON_HEAP = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"

_JOIN_FORMAT = "spark.sql.streaming.join.stateFormatVersion"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffles are cut fine and put together to partitions of the advisory size, so that a task's share does not grow with the input.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "800",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # Catalyst only splits a skewed join if that adds no shuffle; a hot key costs more than a shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # A commit writes what a micro-batch changed, not the store; a row is put without a look whether it was there.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # A joined partition has one store, not four.
    _JOIN_FORMAT: "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A record that repeats a key is valid; the later value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "tidemart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; keyword names use `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session built elsewhere; all of them can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Writes begun inside keep up to `most` files open in a task, one per partition of the folder.

    With one open file, Spark sorts all rows of a task by the folder's partitions first, through disk if they are many.
    """
    with _set(spark, "spark.sql.maxConcurrentOutputFileWriters", str(most)):
        yield


@contextmanager
def heap_state(spark: SparkSession) -> Iterator[None]:
    """Streams begun inside keep their state as rows on the executors' heap; a row costs a third of what RocksDB takes.

    For state that the watermark holds to a few micro-batches, whatever the input; other state does not fit there.
    """
    # One store for all tables of a joined partition is RocksDB's.
    with _set(spark, "spark.sql.streaming.stateStore.providerClass", ON_HEAP), _set(spark, _JOIN_FORMAT, "2"):
        yield


@contextmanager
def swept_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside delete their shuffle files as they end, not when the driver happens to collect garbage."""
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under `spark.checkpoint.dir`.

    On a cluster that setting names storage all executors share, and must be set. Only a session
    that runs in one process (local runs and tests) may do with a machine-local folder instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder all executors share; the master is {master!r}")
        root = os.path.join(tempfile.gettempdir(), "tidemart-work")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
