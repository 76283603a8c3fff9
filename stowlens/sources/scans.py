"""Readers of the text formats of storage telemetry. Lines keep their file and position where order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowlens.functions.scalars import decode_trunk, key_value

__all__ = ["access_log", "benchmark_json", "byte_range", "change_log", "cluster_file", "config_file", "decode_trunk", "directory", "file_list", "manifest", "membership_log", "quota_rules", "sections", "server_log", "space_log", "stat_files", "sync_matrix"]

c = F.col


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("line"))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """file_id of each line; empty lines and comments are skipped."""
    return _lines(spark, path).where(~c("line").rlike(r"^(#|$)")).select(c("line").alias("file_id"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """line, file and line_no: the order within the files that replays need.

    Lines are numbered within their file by the byte order of the splits, so a file is read as it is.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("at", F.monotonically_increasing_id())
    return lines.select(F.regexp_replace("value", r"[\r\n]+$", "").alias("line"), c("file_path").alias("file"), F.struct("file_path", "file_block_start", "at").alias("line_no"))


def change_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, op, filename, src of 'ts op filename[ src]'; shorter lines are skipped."""
    p = F.split("line", " ", 4)
    rows = numbered(spark, path).withColumn("p", p).where(F.size("p") >= 3)
    return rows.select(c("p")[0].try_cast("long").alias("ts"), c("p")[1].alias("op"), c("p")[2].alias("filename"), F.get("p", F.lit(3)).alias("src"), "line_no").where("ts is not null")


def space_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, op and six numbers of each line of eight columns; others are skipped."""
    names = ["store_path", "sub_high", "sub_low", "id", "offset", "size"]
    rows = numbered(spark, path).withColumn("p", F.split("line", " ")).where(F.size("p") == 8)
    return rows.select(c("p")[0].try_cast("long").alias("ts"), c("p")[1].alias("op"), *[c("p")[i + 2].try_cast("long").alias(n) for i, n in enumerate(names)], "line_no")


_TOOL_LINE = r"^\[([^\]]+)\] (\S+) (\S+) (\S+) (\d+) (\d+) (\d+)\s*$"


def access_log(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, operation: str | None = None) -> DataFrame:
    """'[ts] op file_id client_ip size resp_ms status' as columns; other lines are skipped. Time range and operation are optional filters."""
    def part(i: int) -> Column:
        return F.regexp_extract("line", _TOOL_LINE, i)

    log = _lines(spark, path).where(c("line").rlike(_TOOL_LINE)).select(
        F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), part(2).alias("operation"), part(3).alias("file_id"), part(4).alias("client_ip"), part(5).cast("long").alias("bytes"),
        part(6).cast("long").alias("response_ms"), part(7).cast("int").alias("status"),
    ).withColumn("is_error", c("status") >= 400)
    asked = [(since, c("ts") >= F.lit(since).cast("timestamp")), (until, c("ts") <= F.lit(until).cast("timestamp")), (operation, c("operation") == operation)]
    for on, condition in asked:
        log = log.where(condition) if on else log
    return log


def server_log(spark: SparkSession, path: str) -> DataFrame:
    """'client_ip action filename status time_used req_len resp_len' as columns."""
    names = [("client_ip", "string"), ("action", "string"), ("filename", "string"), ("status", "int"), ("time_used", "long"), ("req_len", "long"), ("resp_len", "long")]
    rows = _lines(spark, path).withColumn("p", F.split("line", r"\s+")).where(F.size("p") == len(names))
    return rows.select(*[c("p")[i].try_cast(t).alias(n) for i, (n, t) in enumerate(names)])


def config_file(spark: SparkSession, path: str) -> DataFrame:
    """key, value and line_no of 'key = value' lines; blank lines, comments and sections are skipped."""
    rows = numbered(spark, path).where(~F.trim("line").rlike(r"^(#|;|\[|$)")).withColumn("kv", key_value(c("line")))
    return rows.where("kv is not null").select("kv.key", "kv.value", c("line_no").alias("line"))


def quota_rules(spark: SparkSession, path: str) -> DataFrame:
    """TYPE identifier soft hard warn crit "description"; lines that lack a part or have warn above crit are skipped."""
    from stowlens.functions.scalars import parse_size

    form = r'^\s*(\w+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\d+)(?:\s+"?([^"]*)"?)?\s*$'
    rows = _lines(spark, path).where(c("line").rlike(form) & ~c("line").startswith("#"))
    parts = [F.regexp_extract("line", form, i) for i in range(1, 8)]
    out = rows.select(F.upper(parts[0]).alias("type"), parts[1].alias("identifier"), parse_size(parts[2]).alias("soft"), parse_size(parts[3]).alias("hard"), parts[4].cast("int").alias("warn"), parts[5].cast("int").alias("crit"), parts[6].alias("description"))
    return out.where("soft is not null and hard is not null and warn <= crit")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file_id|size|crc32 hex|create_time|has_metadata|metadata_file."""
    raw = spark.read.csv(path, sep="|", comment="#", schema="file_id string, size long, crc string, create_ts long, has_metadata int, metadata_file string")
    return raw.select("file_id", "size", F.conv("crc", 16, 10).cast("long").alias("crc32"), "create_ts", (c("has_metadata") == 1).alias("has_metadata"), "metadata_file")


def directory(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, size and modification time of files, without metadata files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(~c("path").endswith(".meta")).select("path", c("length").alias("size"), "modificationTime")


def cluster_file(spark: SparkSession, path: str) -> DataFrame:
    """group and store path of 'group:path' lines."""
    rows = file_list(spark, path).where(c("file_id").contains(":"))
    return rows.select(F.trim(F.substring_index("file_id", ":", 1)).alias("group_name"), F.trim(F.regexp_replace("file_id", "^[^:]*:", "")).alias("path")).distinct()


def benchmark_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def sync_matrix(spark: SparkSession, path: str, servers: list[str]) -> DataFrame:
    """group, src_id and one time for each destination, as rows (group_name, src_id, dest_id, ts)."""
    wide = spark.read.csv(path, schema=", ".join(["group_name string", "src_id string", *(f"`{x}` long" for x in servers)]))
    return wide.unpivot(["group_name", "src_id"], servers, "dest_id", "ts").where("src_id <> dest_id")


def membership_log(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered(spark, path).withColumn("p", F.split("line", " ")).where(F.size("p") >= 4)
    return rows.select(c("p")[0].try_cast("long").alias("ts"), c("p")[1].alias("group_name"), c("p")[2].alias("server_id"), c("p")[3].try_cast("int").alias("status"), F.get("p", F.lit(4)).alias("arg"))


def stat_files(spark: SparkSession, pattern: str) -> DataFrame:
    """id, total, success, time_ms of per-process files; the header is skipped."""
    rows = file_list(spark, pattern).withColumn("p", F.split("file_id", r"\s+")).where(F.size("p") == 4)
    return rows.select(c("p")[0].alias("id"), *[c("p")[i + 1].cast("long").alias(n) for i, n in enumerate(("total", "success", "time_ms"))])


def byte_range(content: Column, offset: int, length: int) -> Column:
    """Bytes from an offset; length 0 means to the end."""
    return F.substring(content, offset + 1, length or (1 << 31) - 1)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """section and a map of its 'key=value' lines, for sections with an empty line after each."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    pairs = F.filter(F.transform(F.split("value", "\n"), key_value), lambda p: p.isNotNull())
    return raw.select(F.regexp_extract("value", r"\[([^\]]*)\]", 1).alias("section"), F.map_from_entries(pairs).alias("entries"))


def recovery_parts(log: DataFrame, parts: int) -> DataFrame:
    """A change log dealt out to recovery workers: records of one source name, or of one name without source, have one `worker`."""
    return log.withColumn("worker", F.pmod(F.crc32(F.coalesce("src", "filename").cast("binary")), F.lit(parts)).cast("int"))
