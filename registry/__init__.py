"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemart.session import swept_shuffles, tune, work_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder by attribute name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = tune(spark), folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


_layers: dict[tuple[str, str, str], str] = {}


def layer_path(t: Tables, name: str, write: Callable[[str], None]) -> str:
    """Where a layer of the warehouse is stored, written on first use.

    As in a running warehouse, a layer is worked out once from the whole tables and read by all jobs
    above it. It lives in the session's shared folder and lasts as long as the application.
    """
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _layers:
        path = work_dir(t.spark, name)
        with swept_shuffles(t.spark):
            write(path)
        _layers[key] = path
    return _layers[key]


def layer_parts(t: Tables, name: str, parts: Sequence[str], write: Callable[[str, list[str]], None]) -> dict[str, list[str]]:
    """Where the parts of a layer are stored: folder -> its parts. Those not stored yet are written together, in one pass."""
    key = lambda part: (t.spark.sparkContext.applicationId, t.folder, f"{name}/{part}")
    missing = [p for p in parts if key(p) not in _layers]
    if missing:
        path = work_dir(t.spark, name)
        with swept_shuffles(t.spark):
            write(path, missing)
        _layers.update({key(p): path for p in missing})
    found: dict[str, list[str]] = {}
    for p in parts:
        found.setdefault(_layers[key(p)], []).append(p)
    return found


def layer(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return t.spark.read.parquet(layer_path(t, name, lambda path: build().write.option("compression", "zstd").parquet(path)))


def query(sql: str | None = None, name: str | None = None):
    """Register a function of `Tables`, under its own name, with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return register


def load() -> None:
    from registry import dwd, dws, operators, order_streams, stores, streams  # noqa: F401
