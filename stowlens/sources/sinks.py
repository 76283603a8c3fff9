"""Writers: text, JSON, CSV, manifests, metrics in exposition format, and system tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exposition(name: Column, labels: dict[str, Column], value: Column) -> Column:
    """A line 'name{label="value",...} number'."""
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), v.cast("string"), F.lit('"')) for k, v in labels.items()])
    return F.concat(name, F.lit("{"), shown, F.lit("} "), value.cast("string"))


def exposition_lines(metrics: DataFrame, help_texts: dict[str, str]) -> DataFrame:
    """`line`s of (metric, line) rows with HELP and TYPE once before each metric's lines, in order."""
    spark = metrics.sparkSession
    heads = [(k, i, t) for k, v in help_texts.items() for i, t in enumerate((f"# HELP {k} {v}", f"# TYPE {k} gauge"))]
    head = spark.createDataFrame(heads, "metric string, pos int, line string").join(metrics.select("metric").distinct(), "metric", "left_semi")
    return head.unionByName(metrics.select("metric", F.lit(2).alias("pos"), "line")).orderBy("metric", "pos", "line").select("line")


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_manifest(files: DataFrame, path: str) -> None:
    """file_id|size|crc32 as eight hex digits|create_ts|has_metadata|metadata_file."""
    rows = files.select("file_id", "size", F.lpad(F.hex("crc32"), 8, "0").alias("crc"), "create_ts", F.col("has_metadata").cast("int").alias("has_metadata"), "metadata_file")
    rows.write.mode("overwrite").option("sep", "|").option("emptyValue", "").csv(path)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """A system table as Parquet, by partition columns that later scans prune on; a new version replaces the old one."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_sync_matrix(ts: DataFrame, servers: list[str], path: str) -> None:
    """(group_name, src_id, dest_id, ts) as one line for each source with a column for each destination."""
    ts.groupBy("group_name", "src_id").pivot("dest_id", servers).agg(F.first("ts")).na.fill(0).write.mode("overwrite").csv(path)


def write_sections(df: DataFrame, section: Column, path: str) -> None:
    """Each row as a section of 'key=value' lines, an empty line after it; null values are left out."""
    lines = [F.when(F.col(k).isNotNull(), F.concat(F.lit(k + "="), F.col(k).cast("string"))) for k in df.columns]
    df.select(F.concat(F.concat_ws("\n", F.concat(F.lit("["), section, F.lit("]")), *lines), F.lit("\n"))).write.mode("overwrite").text(path)
