"""Settings and stored steps shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.session import tune, work_dir

SETTINGS = {
    # Texts cross to Python in batches bounded by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # A join of all texts with some of their ids drops most texts before the shuffle, whatever their size.
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    # However large the table of ids is; the filter itself is bounded by Spark, and by default made for a million ids.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "100g",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    # A state store per partition must not reserve disk it does not need.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Folders made by the step that is being recorded.
_recorded: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path for what a step keeps between its own jobs; `recording` remembers it."""
    path = work_dir(spark, name)
    for folders in _recorded:
        folders.append(path)
    return path


@contextmanager
def recording() -> Iterator[list[str]]:
    """The folders made within, for `drop_folders` when what was read from them has been written elsewhere."""
    folders: list[str] = []
    _recorded.append(folders)
    try:
        yield folders
    finally:
        # By identity: lists with the same folders are equal.
        _recorded[:] = [f for f in _recorded if f is not folders]


def drop_folders(spark: SparkSession, folders: Iterable[str], still_read: DataFrame | None = None) -> list[str]:
    """Delete folders, but for those `still_read` is read from; gives what is left."""
    files = still_read.inputFiles() if still_read is not None else []
    left = []
    for folder in folders:
        if any(folder.rsplit("/", 1)[-1] in f for f in files):
            left.append(folder)
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return left


def stored(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(frame.sparkSession, name)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """`row`, its number `seq` and the `file` it was read from, stored together.

    The number is drawn in the write only. Another scan of the same files may cut them otherwise, since splits depend
    on the cores registered when it is planned, and would give the number to another row.
    """
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("seq"), F.input_file_name().alias("file"))
    return stored(rows, "numbered-rows", compression="zstd")


WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text):
    """A-Z lower-cased, all else as it is; null counts as empty. Pure ASCII text takes the faster `lower`."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
