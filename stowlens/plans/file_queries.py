"""Queries that write the driver's tables in the text formats of storage telemetry, and read them back.

Every sink and every scan has one: what a scan returns of what a sink or a line format wrote is held against SQL
over the table that it came from.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowlens.operators import config_rules
from stowlens.operators import reports as R
from stowlens.plans import bindings as B
from stowlens.plans.catalog import _CRC, _CRC_TABLE, _space_log, query
from stowlens.sources import scans, sinks, versions

c = F.col


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which a cluster must set; on one machine a temporary folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stowlens-files-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def lines(df: DataFrame, *line) -> str:
    """Lines of text made of rows: several for each row, null ones left out."""
    at = folder(df.sparkSession)
    sinks.write_text(df.select(F.explode(F.array_compact(F.array(*line))).alias("line")), "line", at)
    return at


@query("S1_file_list", "select path as file_id from files")
def s1(s, d):
    at = lines(B.files(s, d), F.concat(F.lit("# "), "path"), F.lit(""), F.concat("path", F.lit("\r")))
    return scans.file_list(s, at)


@query("S5_change_log", "select ts, op, cast(filename as varchar) as filename, cast(src as varchar) as src from changes")
def s5(s, d):
    at = lines(B.changes(s, d), F.concat_ws(" ", c("ts"), c("op"), c("filename"), c("src")), F.lit("short line"))
    return scans.change_log(s, at).drop("line_no")


@query("S6_space_log", "select ts, case when op = 'D' then 'D' else 'A' end as op, filename % 50 as store_path, line_no % 40 as id, (line_no % 5) * 64 as \"offset\", line_no % 7 as size from changes")
def s6(s, d):
    x = _space_log(s, d)
    at = lines(x, F.concat_ws(" ", c("ts"), c("op"), c("path"), F.lit(0), F.lit(1), c("id"), c("offset"), c("size")), F.concat_ws(" ", c("ts"), c("op"), c("path")))
    return scans.space_log(s, at).select("ts", "op", "store_path", "id", "offset", "size")


@query("S7_access_log", "select date_trunc('second', ts) as ts, operation, 'f' || file_id as file_id, bytes, case when is_error then 500 else 200 end as status, is_error from log where operation <> 'view'")
def s7(s, d):
    x = B.log(s, d)
    status = F.when(c("is_error"), 500).otherwise(200)
    shown = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    at = lines(x, F.concat(F.lit("["), shown, F.lit("] "), F.concat_ws(" ", c("operation"), F.concat(F.lit("f"), "file_id"), F.lit("10.0.0.1"), c("bytes"), F.lit(12), status)), F.lit("[2025] noise"))
    found = scans.access_log(s, at).where("operation <> 'view'")
    return found.select(c("ts").cast("timestamp_ntz").alias("ts"), "operation", "file_id", "bytes", "status", "is_error")


@query("S7_server_log", "select cast(user_id % 200 as varchar) || '.0.0.1' as client_ip, event_type as action, 'M00/' || event_id as filename, cast(event_id % 3 as int) as status, event_id % 50 as time_used from events")
def s7s(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    at = lines(e, F.concat_ws(" ", F.concat(c("user_id") % 200, F.lit(".0.0.1")), c("event_type"), F.concat(F.lit("M00/"), "event_id"), c("event_id") % 3, c("event_id") % 50, F.lit(10), F.lit(20)), F.lit("too short"))
    return scans.server_log(s, at).select("client_ip", "action", "filename", "status", "time_used")


@query("S8_config_file", "select 'k' || p_partkey as key, p_type || ' x' as value from part")
def s8(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    at = lines(p, F.lit("[section]"), F.concat(F.lit("# "), "p_name"), F.concat(F.lit(" k"), "p_partkey", F.lit(' = "'), "p_type", F.lit(' x"')), F.lit("no assignment"))
    return scans.config_file(s, at).select("key", "value")


@query("S9_quota_rules", "select case when s_suppkey % 2 = 0 then 'GROUP' else 'USER' end as type, 'g' || s_suppkey as identifier, s_suppkey * 1024 as soft, s_suppkey * 1048576 as hard, cast(s_suppkey % 90 as int) as warn, 90 as crit, s_name as description from supplier where s_suppkey % 7 <> 0")
def s9(s, d):
    x = s.read.parquet(f"{d}/supplier.parquet")
    k = c("s_suppkey")
    kind = F.when(k % 2 == 0, "group").otherwise("USER")
    good = F.concat_ws(" ", kind, F.concat(F.lit("g"), k), F.concat(k, F.lit("K")), F.concat(k, F.lit("MB")), k % 90, F.lit(90), F.concat(F.lit('"'), "s_name", F.lit('"')))
    bad = F.concat_ws(" ", kind, F.concat(F.lit("g"), k), F.lit("1K"), F.lit("2K"), F.lit(95), F.lit(90))
    return scans.quota_rules(s, lines(x, F.when(k % 7 != 0, good).otherwise(bad), F.lit("# comment")))


@query("S10_K5_manifest", f"with {_CRC_TABLE} select path as file_id, size, cast({_CRC.format('path')} as bigint) as crc32, create_ts, file_id % 2 = 0 as has_metadata from files, tab")
def s10(s, d):
    at = folder(s)
    x = B.files(s, d)
    sinks.write_manifest(x.select(c("path").alias("file_id"), "size", F.crc32(c("path").cast("binary")).alias("crc32"), "create_ts", (c("file_id") % 2 == 0).alias("has_metadata"), F.lit("").alias("metadata_file")), at)
    return scans.manifest(s, at).drop("metadata_file")


@query("S11_directory", "select cast(n_name as varchar) as name, cast(length(n_name) + 1 as bigint) as size from nation")
def s11(s, d):
    """A folder for each nation, with a file of its name in it."""
    at = folder(s)
    n = s.read.parquet(f"{d}/nation.parquet").select(c("n_name").alias("name"), c("n_name").alias("value"))
    n.repartition(4, "name").write.partitionBy("name").text(at)
    found = scans.directory(s, at, recursive=True).where(c("path").endswith(".txt"))
    return found.select(F.url_decode(F.regexp_extract("path", "name=([^/]*)/", 1)).alias("name"), "size")


@query("S12_cluster_file", "select r_name as group_name, count(distinct n_name) as n_paths from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def s12(s, d):
    at = lines(B.servers(s, d), F.concat("group_name", F.lit(": /data/"), "ip"), F.lit("# group:path"), F.lit("neither"))
    return scans.cluster_file(s, at).groupBy("group_name").agg(F.count("*").alias("n_paths"))


@query("S13_K1_benchmark_json", "select event_type as operation, count(*) as total_ops, round(avg(value), 6) as mean_ms, round(max(value), 6) as max_ms from events group by 1")
def s13(s, d):
    x = B.samples(s, d).groupBy("operation").agg(F.count("*").alias("ops"), F.avg("latency_ms").alias("mean"), F.max("latency_ms").alias("max"))
    at = folder(s)
    sinks.write_json(x.select("operation", F.struct(F.struct(c("ops").alias("total")).alias("throughput"), F.struct("mean", "max").alias("latency_ms")).alias("metrics")).repartition(5, "operation"), at)
    found = s.read.schema("operation string, metrics struct<throughput: struct<total: long>, latency_ms: struct<mean: double, max: double>>").json(at)
    return found.select("operation", c("metrics.throughput.total").alias("total_ops"), F.round("metrics.latency_ms.mean", 6).alias("mean_ms"), F.round("metrics.latency_ms.max", 6).alias("max_ms"))


@query("S14_sections", "select group_name, n_servers, total_mb, case when n_servers % 2 = 0 then free_mb end as free_mb from (select group_name, count(*) as n_servers, cast(sum(total_mb) as bigint) as total_mb, cast(sum(free_mb) as bigint) as free_mb from servers group by 1)")
def s14(s, d):
    g = B.servers(s, d).groupBy("group_name").agg(F.count("*").alias("n_servers"), F.sum("total_mb").alias("total_mb"), F.sum("free_mb").alias("free_mb"))
    at = folder(s)
    sinks.write_sections(g.withColumn("free_mb", F.when(c("n_servers") % 2 == 0, c("free_mb"))), F.concat(F.lit("Group "), "group_name"), at)
    e = c("entries")
    return scans.sections(s, at).select(e["group_name"].alias("group_name"), *[e[k].cast("long").alias(k) for k in ("n_servers", "total_mb", "free_mb")])


@query("S14_system_table", "select group_name, server_id, free_mb from servers where group_name = 'ASIA'")
def s14t(s, d):
    at = folder(s)
    sinks.write_table(B.servers(s, d).select("group_name", "server_id", "free_mb"), at, "group_name")
    return s.read.parquet(at).where("group_name = 'ASIA'").select("group_name", "server_id", "free_mb")


@query("S14_sync_matrix", "with n as (select r_name as group_name, n_name, n_nationkey % 5 as k, n_nationkey from nation join region on n_regionkey = r_regionkey) select a.group_name, a.n_name as src_id, 's' || k.k as dest_id, cast(a.n_nationkey * 100 + k.k as bigint) as ts from n a, (select unnest(range(5)) as k) k")
def s14m(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").join(s.read.parquet(f"{d}/region.parquet"), F.expr("n_regionkey = r_regionkey"))
    servers = [f"s{k}" for k in range(5)]
    x = n.select(c("r_name").alias("group_name"), c("n_name").alias("src_id"), "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    at = folder(s)
    sinks.write_sync_matrix(x.select("group_name", "src_id", F.concat(F.lit("s"), "k").alias("dest_id"), (c("n_nationkey") * 100 + c("k")).alias("ts")), servers, at)
    return scans.sync_matrix(s, at, servers)


@query("S16_stat_files", "select cast(event_id % 10 as varchar) as id, count(*) as total, count(*) filter (event_type <> 'error') as success from events group by 1, event_id % 4")
def s16(s, d):
    """A file for each of four processes, with a header; read by a pattern over their folders."""
    x = B.log(s, d).groupBy((c("id") % 10).alias("stat"), (c("id") % 4).alias("process")).agg(F.count("*").alias("total"), F.count_if(~c("is_error")).alias("success"))
    at = folder(s)
    rows = x.select("process", F.explode(F.array(F.lit("#id total success time_ms"), F.concat_ws(" ", "stat", "total", "success", F.lit(7)))).alias("value"))
    rows.write.partitionBy("process").text(at)
    return scans.stat_files(s, f"{at}/process=*").select("id", "total", "success")


@query("K1_text", "select group_name || ' ' || server_id as line from servers")
def k1(s, d):
    at = folder(s)
    sinks.write_text(B.servers(s, d).select(F.concat_ws(" ", "group_name", "server_id").alias("line")), "line", at)
    return s.read.text(at).select(c("value").alias("line"))


@query("K2_csv", "select server_id, group_name || ', \"' || ip || '\"' as place, free_mb from servers")
def k2(s, d):
    at = folder(s)
    sinks.write_csv(B.servers(s, d).select("server_id", F.concat("group_name", F.lit(', "'), "ip", F.lit('"')).alias("place"), "free_mb"), at)
    return s.read.csv(at, header=True, schema="server_id long, place string, free_mb long", escape="\\")


@query("K4_exposition_lines", "with m as (select 'free_mb' as metric union all select 'total_mb'), l as (select '# HELP ' || metric || ' of a server' as line from m union all select '# TYPE ' || metric || ' gauge' from m union all select m.metric || '{server=\"' || server_id || '\"} ' || case m.metric when 'free_mb' then free_mb else total_mb end from servers, m) select line from l")
def k4l(s, d):
    long = B.servers(s, d).unpivot(["server_id"], ["total_mb", "free_mb"], "metric", "value")
    rows = long.select("metric", sinks.exposition(c("metric"), {"server": c("server_id")}, c("value")).alias("line"))
    return sinks.exposition_lines(rows, {"total_mb": "of a server", "free_mb": "of a server"})


@query("L5_recovery_parts", f"with {_CRC_TABLE}, k as (select *, cast(coalesce(src, filename) as varchar) as name from changes), h as (select name, cast({_CRC.format('name')} as bigint) % 8 as worker from (select distinct name from k), tab) select line_no, cast(worker as int) as worker from k join h using (name) where filename % 4 = 1")
def l5(s, d):
    """The log of one path, dealt out to eight workers."""
    x = B.changes(s, d).where(c("filename") % 4 == 1)
    return scans.recovery_parts(x.select("line_no", c("filename").cast("string").alias("filename"), c("src").cast("string").alias("src")), 8).select("line_no", "worker")


@query("L2_compacted_log", "with r as (select filename % 50 as path, line_no % 40 as id, (line_no % 5) * 64 as \"offset\", ts, line_no, case when op = 'D' then 'D' else 'A' end as op, row_number() over (partition by filename % 50, line_no % 40, line_no % 5 order by ts desc, line_no desc) as k from changes) select path, id, \"offset\", line_no % 7 as size, 'A' as op from r where k = 1 and op = 'A'")
def l2(s, d):
    """A log rewritten to what its replay leaves, by a swap that can be undone."""
    at = folder(s)
    versions.create(_space_log(s, d), at)
    versions.compact(s, at, lambda log: R.live_blocks(log, ["path", "id", "offset"], B.STORED).withColumn("op", F.lit("A")))
    return versions.current(s, at).select("path", "id", "offset", "size", "op")


#: Configurations of supplier numbers: (key, value) by the supplier's key k, as Spark SQL and DuckDB both read it.
_KEYS = {
    "base_path": "case when k % 11 = 0 then null else '/data' || (k % 6) end", "max_connections": "case when k % 5 = 0 then null else cast(k % 7 * 400 as varchar(9)) end", "work_threads": "cast(k % 40 as varchar(9))",
    "accept_threads": "cast(1 + k % 2 as varchar(9))", "buff_size": "cast(k % 5 * 128 as varchar(9))", "log_level": "case when k % 3 = 0 then 'debug' else 'info' end", "connect_timeout": "cast(k % 60 as varchar(9))",
    "network_timeout": "cast(k % 200 as varchar(9))", "store_lookup": "cast(k % 4 as varchar(9))", "reserved_storage_space": "case k % 4 when 0 then null when 1 then '4GB' when 2 then (k % 20) || '%' else '100' end",
    "use_trunk_file": "case when k % 2 = 0 then 'true' else 'no' end", "slot_max_size": "cast(k % 3 * 1000000 as varchar(9))", "download_server": "cast(k % 3 as varchar(9))", "disk_rw_separated": "case k % 3 when 0 then '1' when 1 then 'false' end",
    "disk_reader_threads": "cast(k % 4 as varchar(9))", "disk_writer_threads": "cast(k % 3 as varchar(9))", "store_path_count": "cast(k % 3 as varchar(9))", "store_path0": "'/data' || (k % 7)", "store_path1": "case when k % 2 = 0 then '/data1' end",
    "sync_interval": "cast(k % 2 as varchar(9))", "fsync_after_written_bytes": "cast(k % 3 as varchar(9))", "use_connection_pool": "case k % 3 when 0 then 'true' when 1 then 'false' end", "subdir_count_per_path": "cast(k % 3 * 150 as varchar(9))",
    "tracker_server": "case when k % 4 > 0 then 'a:1' end",
}
_CONFIGS = " union all ".join([f"select k, '{key}' as key, {value} as value, {i} as line from base" for i, (key, value) in enumerate(_KEYS.items())] + ["select k, 'tracker_server', 'b:1', 100 from base where k % 4 > 1", "select k, 'buff_size', '9999', 101 from base"])
_PATHS = [("/data0", True), ("/data1", True), ("/data2", False), ("/data3", True), ("/data6", True)]


def _configs(s, d):
    s.read.parquet(f"{d}/supplier.parquet").select(c("s_suppkey").alias("k")).createOrReplaceTempView("config_base")
    return s.sql(_CONFIGS.replace(" from base", " from config_base")).where("value is not null").withColumnRenamed("k", "config"), s.createDataFrame(_PATHS, "path string, writable boolean")


_WIDE = "with base as (select s_suppkey as k from supplier), e as (" + _CONFIGS + "), paths as (select * from (values " + ", ".join(f"('{p}', {w})" for p, w in _PATHS) + ") p(path, writable)), w as (select k as config, " + ", ".join(
    [f"coalesce(try_cast(arg_min(value, line) filter (key = '{k}' and value is not null) as int), {v}) as {k}" for k, v in config_rules.DEFAULTS.items()] + [f"arg_min(value, line) filter (key = '{k}' and value is not null) as {k}" for k in config_rules.TEXTS]
    + ["count(*) filter (key = 'tracker_server' and value is not null) as n_trackers"]) + " from e group by 1), x as (select w.*, writable from w left join paths on path = base_path) "
_COMMON = {
    "base_path": "case when base_path is null or writable is null or not writable then 'ERROR' else 'OK' end", "max_connections": "case when max_connections < 1024 then 'WARNING' else 'OK' end",
    "work_threads": "case when work_threads < 4 or work_threads > 16 then 'WARNING' else 'OK' end", "accept_threads": "case when accept_threads > 1 and max_connections < 10000 then 'WARNING' else 'OK' end",
    "buff_size": "case when buff_size < 256 then 'WARNING' else 'OK' end", "log_level": "case when log_level = 'debug' then 'WARNING' end", "connect_timeout": "case when connect_timeout > 30 then 'WARNING' end",
    "network_timeout": "case when network_timeout > 120 then 'WARNING' end",
}
_TRACKER = _COMMON | {
    "store_lookup": "case when store_lookup in (0, 2) then 'OK' when store_lookup = 1 then 'WARNING' end",
    "reserved_storage_space": "case when reserved_storage_space is null then 'WARNING' when contains(reserved_storage_space, 'G') then 'OK' when contains(reserved_storage_space, '%') and cast(replace(reserved_storage_space, '%', '') as int) < 10 then 'WARNING' end",
    "use_trunk_file": "case when use_trunk_file in ('true', '1') then 'OK' end", "slot_max_size": "case when use_trunk_file in ('true', '1') and slot_max_size < 1048576 then 'OK' end", "download_server": "case when download_server in (0, 1) then 'OK' end",
}
_STORAGE = _COMMON | {
    "disk_rw_separated": "case when disk_rw_separated in ('true', '1') then 'OK' else 'WARNING' end", "disk_reader_threads": "case when disk_reader_threads < 2 then 'WARNING' else 'OK' end", "disk_writer_threads": "case when disk_writer_threads < 1 then 'ERROR' else 'OK' end",
    "store_path_count": "'OK'", "sync_interval": "case when sync_interval > 0 then 'WARNING' else 'OK' end", "fsync_after_written_bytes": "case when fsync_after_written_bytes = 0 then 'WARNING' else 'OK' end",
    "use_connection_pool": "case when use_connection_pool is null or use_connection_pool in ('false', '0') then 'WARNING' else 'OK' end", "tracker_server": "case when n_trackers = 0 then 'ERROR' when n_trackers = 1 then 'WARNING' else 'OK' end",
    "subdir_count_per_path": "case when subdir_count_per_path < 256 then 'WARNING' end",
}
_rows = lambda rules: " union all ".join(f"select config, '{k}' as rule, {v} as level from x" for k, v in rules.items())


@query("C18_tracker_config", _WIDE + "select * from (" + _rows(_TRACKER) + ") where level is not null")
def c18t(s, d):
    return config_rules.validated(*_configs(s, d), storage=False, cpus=8)


@query("C18_storage_config", _WIDE + ", s as (select config, unnest(range(store_path_count)) as i from w), g as (select s.config, 'store_path' || i as rule, (select arg_min(value, line) from e where e.k = s.config and e.key = 'store_path' || i and value is not null) as p from s) select * from (" + _rows(_STORAGE) + ") where level is not null union all select g.config, rule, case when p is null or writable is null or not writable then 'ERROR' else 'OK' end from g left join paths on path = p")
def c18s(s, d):
    return config_rules.validated(*_configs(s, d), storage=True, cpus=8)


@query("C18_A22_levels", _WIDE + "select level, count(*) as n from (" + _rows(_TRACKER) + ") where level is not null group by 1")
def c18l(s, d):
    return config_rules.validated(*_configs(s, d), storage=False, cpus=8).groupBy("level").agg(F.count("*").alias("n"))
