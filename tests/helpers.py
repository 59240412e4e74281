"""Streams over small literal tables: one file per micro-batch, then everything is drained."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import functions as F

from tidemart.sources.connectors import stream_files
from tidemart.streaming.sinks import drain, to_files

_n = itertools.count()


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def stream_of(spark, folder, batches, schema):
    """A stream whose micro-batches are `batches`, in order."""
    path = f"{folder}/in{next(_n)}"
    for i, rows in enumerate(batches):
        part = f"{path}-tmp{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        os.makedirs(path, exist_ok=True)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.link(f"{part}/{name}", f"{path}/{i:04d}.parquet")
        os.utime(f"{path}/{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    typed = spark.createDataFrame([], schema).schema
    return stream_files(spark, path, typed, max_files=1)


def run(spark, folder, stream, mode="append"):
    out = f"{folder}/out{next(_n)}"
    drain(to_files(stream, out, f"{out}-check").outputMode(mode), timeout=120)
    return spark.read.parquet(out)


def ts(text):
    return F.to_timestamp(F.lit(text))
