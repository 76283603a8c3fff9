"""Helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word class [^\x20\x09-\x0D]+ (fixed values).
SPACES = " \t\n\x0b\x0c\r"
#: Rows handed to Python at once; a batch of whole texts then stays in tens of MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a session on one machine (tests) may leave it unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stowlens-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    return stored(df, shared_folder(df.sparkSession))


class Scratch:
    """Tables in the shared folder that go together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables = spark, shared_folder(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        return stored(df, f"{self.path}/{self.tables}")

    def clear(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def _package() -> str:
    """A zip of this package in a folder of the driver, from where Spark sends it."""
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="stowlens-")) / "stowlens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    return str(path)


@functools.cache
def _ship(application: str) -> None:
    SparkSession.active().sparkContext.addPyFile(_package())


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once for each application."""
    _ship(spark.sparkContext.applicationId)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """fn over slices of at most so many rows of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def whole_text(column: str = "text") -> F.Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))
