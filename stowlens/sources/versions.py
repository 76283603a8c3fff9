"""A log table whose compaction replaces it as a whole, or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _store(spark: SparkSession, folder: str):
    context = spark.sparkContext
    make = context._jvm.org.apache.hadoop.fs.Path
    return make(folder).getFileSystem(context._jsc.hadoopConfiguration()), make


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The table as it stands; a swap that was cut short is undone first."""
    store, path = _store(spark, folder)
    live, old = path(f"{folder}/live"), path(f"{folder}/rollback")
    if store.exists(old):
        if not store.exists(live):
            store.rename(old, live)
        else:
            store.delete(old, True)
    return spark.read.parquet(f"{folder}/live")


def create(df: DataFrame, folder: str) -> None:
    df.write.parquet(f"{folder}/live")


def compact(spark: SparkSession, folder: str, rewrite: Callable[[DataFrame], DataFrame]) -> None:
    """Writes rewrite(table) beside the table, then swaps them; until the swap is done the old table can be restored."""
    store, path = _store(spark, folder)
    live, new, old = (path(f"{folder}/{k}") for k in ("live", "new", "rollback"))
    table = current(spark, folder)
    store.delete(new, True)
    rewrite(table).write.parquet(f"{folder}/new")
    if not store.rename(live, old):
        raise OSError(f"{live} can't be set aside")
    if not store.rename(new, live):
        store.rename(old, live)
        raise OSError(f"{new} can't take the place of {live}")
    store.delete(old, True)
