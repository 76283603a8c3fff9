"""Queries over the bound tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowlens.functions import scalars as S
from stowlens.operators import classify as C
from stowlens.operators import ordered as W
from stowlens.operators import predicates as P
from stowlens.operators import reports as R
from stowlens.plans import bindings as B

NOW = B.NOW
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; the SQL's {views} that it names are put before it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            views = [k for k in B.VIEWS if re.search(rf"\b{k}\b", sql)]
            head = "with " + ", ".join(f"{k} as ({B.VIEWS[k]})" for k in views) if views else ""
            body = sql.strip()
            ORACLES[name] = head + (", " + body[5:] if head and body.startswith("with ") else " " + body)
        return f

    return keep


c = F.col


@query("A3_size_buckets", """
with b as (select case when size >= 1073741824 then '>1GB' when size >= 524288000 then '500MB-1GB' when size >= 104857600 then '100MB-500MB' when size >= 52428800 then '50MB-100MB'
  when size >= 10485760 then '10MB-50MB' when size >= 1048576 then '1MB-10MB' when size >= 102400 then '100KB-1MB' when size >= 10240 then '10KB-100KB' when size >= 1024 then '1KB-10KB' else '0-1KB' end as bucket, size from files)
select bucket, count(*) as n_files, cast(sum(size) as bigint) as total_size, round(count(*) * 100 / (select count(*) from b), 4) as pct from b group by bucket""")
def a3(s, d):
    return R.size_buckets(B.files(s, d))


@query("A1_file_stats", "select count(*) as n_files, cast(sum(size) as bigint) as total_size, min(size) as min_size, max(size) as max_size, cast(sum(size) // count(*) as bigint) as avg_size, min(create_ts) as oldest, max(create_ts) as newest from files")
def a1(s, d):
    return R.file_stats(B.files(s, d))


@query("A2_by_extension", "select ext, count(*) as n_files, cast(sum(size) as bigint) as total_size from files group by ext")
def a2(s, d):
    return R.by_key(B.files(s, d), "ext")


@query("O1_top_extensions", "select ext, count(*) as n_files, cast(sum(size) as bigint) as total_size from files group by ext order by total_size desc, ext limit 20")
def o1(s, d):
    return R.top(R.by_key(B.files(s, d), "ext"), 20, F.desc("total_size"), F.asc("ext"))


@query("A4_duplicates", "select signature, size, count(*) as n_files, size * (count(*) - 1) as savings from files group by signature, size having count(*) > 1")
def a4(s, d):
    return R.duplicates(B.files(s, d), "signature")


@query("A4_duplicate_totals", "with g as (select signature, size, count(*) as n from files group by 1, 2) select cast(sum(n) as bigint) as n_files, cast(sum(n - 1) as bigint) as n_duplicates, cast(sum(size * (n - 1)) as bigint) as savings, round(sum(size * (n - 1)) * 100.0 / sum(size * n), 6) as rate_pct from g")
def a4t(s, d):
    return R.duplicate_totals(B.files(s, d), "signature")


@query("W6_first_seen", "select file_id, row_number() over (partition by signature, size order by file_id) > 1 as is_duplicate from files")
def w6(s, d):
    return R.first_seen(B.files(s, d), "signature", "file_id").select("file_id", "is_duplicate")


OPS = ["view", "click", "error", "purchase", "signup"]


@query("A5_access_stats", "select file_id, count(*) as n_access, " + ", ".join(f"count(*) filter (operation = '{o}') as n_{o}" for o in OPS) + ", count(*) filter (is_error) as n_errors, min(ts) as first_access, max(ts) as last_access, cast(sum(bytes) as bigint) as bytes, round(avg(response_ms), 6) as avg_ms from log group by file_id")
def a5(s, d):
    return R.access_stats(B.log(s, d), OPS)


@query("A5_by_hour", "select cast(hour(ts) as int) as hour, count(*) as n_access from log group by 1")
def a5h(s, d):
    return R.histogram(B.log(s, d), "hour")


@query("A5_by_weekday", "select cast(dayofweek(ts) as int) as weekday, count(*) as n_access from log group by 1")
def a5w(s, d):
    return R.histogram(B.log(s, d), "weekday")


@query("A6_log_totals", "select count(*) as n_entries, count(*) filter (is_error) as n_errors, count(distinct file_id) as n_files, min(ts) as first_ts, max(ts) as last_ts from log")
def a6(s, d):
    return R.log_totals(B.log(s, d))


@query("O2_top_files", "select file_id, count(*) as n_access from log group by file_id order by n_access desc, file_id limit 10")
def o2(s, d):
    return R.top(B.log(s, d).groupBy("file_id").agg(F.count("*").alias("n_access")), 10, F.desc("n_access"), F.asc("file_id"))


@query("C5_temperature", "with f as (select file_id, count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 0.1) as per_day from log group by file_id) select file_id, round(per_day, 6) as per_day, case when per_day >= 10 then 'hot' when per_day <= 0.1 then 'cold' else 'warm' end as temperature from f")
def c5(s, d):
    return R.frequency(B.log(s, d)).select("file_id", F.round("per_day", 6).alias("per_day"), C.temperature(c("per_day")).alias("temperature"))


@query("C6_anomalies", "with f as (select file_id, count(*) as n, count(*) filter (is_error) as e from log group by 1), b as (select avg(n) + 3 * stddev_pop(n) as bound from f) select file_id, 'high_access' as kind, cast(0.7 as double) as severity from f, b where n > bound union all select file_id, 'high_errors', cast(0.8 as double) from f where e / n > 0.1")
def c6(s, d):
    return R.anomalies(B.log(s, d))


_LAT = """with r as (select *, row_number() over (partition by operation order by latency_ms) - 1 as r, count(*) over (partition by operation) as n from samples where success),
p as (select operation, max(latency_ms) filter (r = least(floor(n * 0.9), n - 1)) as p90_ms, max(latency_ms) filter (r = least(floor(n * 0.95), n - 1)) as p95_ms, max(latency_ms) filter (r = least(floor(n * 0.99), n - 1)) as p99_ms, max(latency_ms) filter (r = least(floor(n * 0.999), n - 1)) as p999_ms from r group by 1),
a as (select operation, count(*) as n, count(*) filter (success) as n_ok, count(*) filter (not success) as n_failed, round(avg(latency_ms) filter (success), 6) as mean_ms, min(latency_ms) filter (success) as min_ms, max(latency_ms) filter (success) as max_ms, round(stddev_pop(latency_ms) filter (success), 6) as stddev_ms, round(quantile_cont(latency_ms, 0.5) filter (success), 6) as median_ms from samples group by 1)
select a.*, p90_ms, p95_ms, p99_ms, p999_ms from a left join p using (operation)"""


@query("A15_latency_stats", _LAT)
def a15(s, d):
    return R.latency_stats(B.samples(s, d), ["operation"])


@query("W2_percentiles", "with r as (select operation, latency_ms, row_number() over (partition by operation order by latency_ms) - 1 as r, count(*) over (partition by operation) as n from samples) select operation, max(latency_ms) filter (r = least(floor(n * 0.5), n - 1)) as p50, max(latency_ms) filter (r = least(floor(n * 0.75), n - 1)) as p75 from r group by 1")
def w2(s, d):
    return R.index_percentiles(B.samples(s, d), "latency_ms", {"p50": 0.5, "p75": 0.75}, ["operation"])


@query("A16_throughput", "select operation, round(sum(bytes) / 1048576.0 / 2592000, 9) as mb_per_s, round(count(*) / 2592000.0, 9) as ops_per_s, round(count(*) filter (not is_error) * 100.0 / count(*), 6) as success_pct from log group by 1")
def a16(s, d):
    return B.log(s, d).groupBy("operation").agg(F.round(F.sum("bytes") / 1048576.0 / 2592000, 9).alias("mb_per_s"), F.round(F.count("*") / F.lit(2592000.0), 9).alias("ops_per_s"), F.round(S.ratio(F.sum((~c("is_error")).cast("int")) * 100, F.count("*")), 6).alias("success_pct"))


@query("A25_running_stats", "select operation, count(*) as n, count(*) filter (success) as n_ok, round(sum(latency_ms), 4) as sum_ms, min(latency_ms) as min_ms, max(latency_ms) as max_ms from samples group by 1")
def a25(s, d):
    return B.samples(s, d).groupBy("operation").agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.round(F.sum("latency_ms"), 4).alias("sum_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))


@query("A27_C20_ping", "select operation, count(*) filter (success) as n_ok, count(*) filter (not success) as n_failed, round(avg(latency_ms) filter (success), 6) as avg_ms, case when count(*) filter (success) = 0 then 'ERROR' when count(*) filter (not success) > 0 or avg(latency_ms) filter (success) > 100 then 'WARNING' else 'OK' end as status from samples group by 1")
def a27(s, d):
    a = B.samples(s, d).groupBy("operation").agg(F.count_if("success").alias("n_ok"), F.count_if(~c("success")).alias("n_failed"), F.avg(F.when(c("success"), c("latency_ms"))).alias("avg_ms"))
    return a.select("operation", "n_ok", "n_failed", F.round("avg_ms", 6).alias("avg_ms"), C.diagnostics(c("n_ok"), c("n_failed"), c("avg_ms")).alias("status"))


@query("A17_merged_stats", "select cast(id % 10 as bigint) as stat_id, count(*) as n, count(*) filter (success) as n_ok, round(sum(latency_ms) / 4, 4) as avg_time from samples group by 1")
def a17(s, d):
    parts = B.samples(s, d).groupBy((c("id") % 10).alias("stat_id"), (c("id") % 4).alias("process")).agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.sum("latency_ms").alias("ms"))
    return parts.groupBy("stat_id").agg(F.sum("n").alias("n"), F.sum("n_ok").alias("n_ok"), F.round(F.sum("ms") / 4, 4).alias("avg_time"))


@query("A18_marginals", "select lang, ext, count(*) as n_files, cast(sum(size) as bigint) as total_size from files group by grouping sets ((lang), (ext))")
def a18(s, d):
    return B.files(s, d).groupingSets([[c("lang")], [c("ext")]], "lang", "ext").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))


@query("S2_list_groups", "select group_name, count(*) as n_servers, cast(sum(total_mb) as bigint) as total_mb, cast(sum(free_mb) as bigint) as free_mb from servers group by 1")
def s2(s, d):
    return B.servers(s, d).groupBy("group_name").agg(F.count("*").alias("n_servers"), F.sum("total_mb").alias("total_mb"), F.sum("free_mb").alias("free_mb"))


@query("S3_F12_one_group", "select server_id, group_name, free_mb from servers where group_name = 'ASIA'")
def s3(s, d):
    return B.servers(s, d).where(c("group_name") == "ASIA").select("server_id", "group_name", "free_mb")


@query("S4_servers_of_group", "select server_id, ip, status from servers where group_name = 'EUROPE' and server_id = 3")
def s4(s, d):
    return B.servers(s, d).where((c("group_name") == "EUROPE") & (c("server_id") == 3)).select("server_id", "ip", "status")


@query("F1_tracker_filter", "select server_id, writable as leader from servers where not writable and (writable or 1706745600 - heartbeat <= 3)")
def f1(s, d):
    return B.servers(s, d).where(P.tracker_filter(c("writable"), F.lit(NOW) - c("heartbeat"), only_leader=False, only_active=True)).select("server_id", c("writable").alias("leader"))


@query("F2_status_filter", "select server_id, status from servers where status <> 7 and writable")
def f2(s, d):
    return B.servers(s, d).where(P.status_is(c("status"), "!", 7) & c("writable")).select("server_id", "status")


@query("F3_P3_volumes", "select server_id, case when writable then greatest(free_mb - 1000, 0) else 0 end as available_mb, round((total_mb - free_mb) * 100.0 / total_mb, 6) as used_pct from servers where free_mb > 1000")
def f3(s, d):
    v = B.servers(s, d).where(P.has_space(c("free_mb"), c("total_mb"), 1000))
    return v.select("server_id", P.available_mb(c("free_mb"), F.lit(1000), c("writable")).cast("long").alias("available_mb"), F.round(S.ratio((c("total_mb") - c("free_mb")) * 100, c("total_mb")), 6).alias("used_pct"))


@query("F4_search", "select file_id, concat_ws(',', case when size >= 100000 and size <= 5000000 then 'size' end, case when lower(ext) = 'src3' then 'extension' end, case when regexp_full_match(split_part(path, '/', -1), '1.*src[0-9]') then 'pattern' end) as reason from files where (size >= 100000 and size <= 5000000) or lower(ext) = 'src3' or regexp_full_match(split_part(path, '/', -1), '1.*src[0-9]')")
def f4(s, d):
    k = P.file_criteria(size=c("size"), min_size=100000, max_size=5000000, name=c("path"), extension="SRC3", pattern="1*src[0-9]")
    return B.files(s, d).where(P.combine([*k.values()], any_of=True)).select("file_id", P.match_reason(k).alias("reason"))


@query("F5_cleanup", "select file_id from files where 1700040000 - create_ts >= 20000 and size >= 1000000 and split_part(path, '/', -1) like '%.src1%'")
def f5(s, d):
    k = P.file_criteria(size=c("size"), min_size=1000000, time=c("create_ts"), before=1700020000, name=c("path"), pattern="*.src1*")
    return B.files(s, d).where(P.combine([*k.values()])).select("file_id")


@query("F6_tags_all", "select file_id from files where list_has_all([lang, ext, group_name], ['en', 'src1'])")
def f6(s, d):
    return B.files(s, d).where(P.tags_match(F.array("lang", "ext", "group_name"), ["en", "src1"], every=True)).select("file_id")


@query("F6_tags_any", "select file_id from files where list_has_any([lang, ext], ['fr', 'src1'])")
def f6a(s, d):
    return B.files(s, d).where(P.tags_match(F.array("lang", "ext"), ["fr", "src1"], every=False)).select("file_id")


@query("F7_reserved_space", "select server_id, cast(floor(total_mb * 0.3) as bigint) as reserved, case when total_mb = 0 then false else free_mb / total_mb > 0.3 end as has_space from servers")
def f7(s, d):
    return B.servers(s, d).select("server_id", P.reserved_mb(c("total_mb"), 0.3).alias("reserved"), P.has_space(c("free_mb"), c("total_mb"), 0.3).alias("has_space"))


@query("F8_need_sync", "select line_no, filename, op from changes where op in ('C', 'D') or (op = 'c' and filename % 2 = 0 and ts <= 4000)")
def f8(s, d):
    return B.changes(s, d).where(P.needs_sync(c("op"), c("ts"), F.lit(4000), c("filename") % 2 == 0)).select("line_no", "filename", "op")


@query("F9_readable", "select server_id, writable or update_ts < 1706745600 - 86400 or synced_ts > update_ts or (synced_ts + 1 >= update_ts and 1706745600 - update_ts > 300) as readable from servers")
def f9(s, d):
    return B.servers(s, d).select("server_id", P.readable(c("writable"), c("update_ts"), c("synced_ts"), F.lit(NOW)).alias("readable"))


@query("F10_expiry", "select server_id, cast(case when status = 7 and 1706745600 - heartbeat > 60 then 6 else status end as int) as status from servers")
def f10(s, d):
    return B.servers(s, d).select("server_id", P.expired_status(c("status"), c("heartbeat"), F.lit(NOW), 60).cast("int").alias("status"))


@query("F11_skip_until", "select line_no, ts, op from changes where ts >= 4000")
def f11(s, d):
    return B.changes(s, d).where(c("ts") >= 4000).select("line_no", "ts", "op")


@query("P1_usage", "select server_id, total_mb - free_mb as used_mb, round((total_mb - free_mb) * 100.0 / total_mb, 6) as used_pct from servers")
def p1(s, d):
    return B.servers(s, d).select("server_id", (c("total_mb") - c("free_mb")).alias("used_mb"), F.round(S.ratio((c("total_mb") - c("free_mb")) * 100, c("total_mb")), 6).alias("used_pct"))


@query("P2_success_rate", "select server_id, case when uploads = 0 then 0.0 else round(ok_uploads * 100.0 / uploads, 6) end as success_pct from servers")
def p2(s, d):
    return B.servers(s, d).select("server_id", F.round(S.ratio(c("ok_uploads") * 100, c("uploads")), 6).alias("success_pct"))


@query("P4_metrics", "select 'storage_' || m as metric, group_name, server_id, v as value from (select group_name, server_id, unnest(['total_mb', 'free_mb', 'uploads', 'ok_uploads', 'deletes']) as m, unnest([total_mb, free_mb, uploads, ok_uploads, deletes]) as v from servers)")
def p4(s, d):
    names = ["total_mb", "free_mb", "uploads", "ok_uploads", "deletes"]
    long = B.servers(s, d).unpivot(["group_name", "server_id"], names, "m", "value")
    return long.select(F.concat(F.lit("storage_"), "m").alias("metric"), "group_name", "server_id", "value")


@query("K4_exposition", "with m as (select group_name, server_id, unnest(['total_mb', 'free_mb']) as m, unnest([total_mb, free_mb]) as v from servers) select m as metric, server_id, 'storage_' || m || '{group=\"' || group_name || '\",server=\"' || server_id || '\"} ' || v as line from m")
def k4(s, d):
    from stowlens.sources.sinks import exposition

    long = B.servers(s, d).unpivot(["group_name", "server_id"], ["total_mb", "free_mb"], "metric", "value")
    return long.select("metric", "server_id", exposition(F.concat(F.lit("storage_"), "metric"), {"group": c("group_name"), "server": c("server_id")}, c("value")).alias("line"))


@query("J1_groups_servers", "select group_name, n, server_id from servers join (select group_name, count(*) as n from servers group by 1) using (group_name)")
def j1(s, d):
    x = B.servers(s, d)
    return x.join(x.groupBy("group_name").agg(F.count("*").alias("n")), "group_name").select("group_name", "n", "server_id")


_RULES = "rules as (select 'group0' as group_name, 30000000 as soft, 40000000 as hard, 80 as warn, 90 as crit union all select 'group1', 0, 0, 80, 90 union all select 'group9', 1, 2, 80, 90)"
_QUOTA = "case when base = 0 then 'UNKNOWN' when used >= hard then 'EXCEEDED' when pct >= crit then 'CRITICAL' when pct >= warn then 'WARNING' else 'OK' end"


def _rules(s):
    return s.createDataFrame([("group0", 30000000, 40000000, 80, 90), ("group1", 0, 0, 80, 90), ("group9", 1, 2, 80, 90)], "group_name string, soft bigint, hard bigint, warn int, crit int")


def _quota(s, d, how):
    used = B.files(s, d).groupBy("group_name").agg(F.sum("size").alias("used"))
    j = used.join(_rules(s), "group_name", how)
    status = F.when(c("hard").isNull(), "UNKNOWN").otherwise(C.quota(c("used"), c("hard"), F.lit(10**9), c("warn"), c("crit")))
    return j.select("group_name", "used", status.alias("status"))


_QSQL = f"with {_RULES}, u as (select group_name, cast(sum(size) as bigint) as used from files group by 1), q as (select u.group_name, used, hard, warn, crit, case when hard > 0 then hard else 1000000000 end as base, used * 100.0 / case when hard > 0 then hard else 1000000000 end as pct from u %s join rules using (group_name)) select group_name, used, case when hard is null then 'UNKNOWN' else {_QUOTA} end as status from q"


@query("J2_C1_quota_all", _QSQL % "inner")
def j2(s, d):
    return _quota(s, d, "inner")


@query("J2_C1_quota_left", _QSQL % "left")
def j2l(s, d):
    return _quota(s, d, "left")


@query("A21_quota_summary", (_QSQL % "left").replace(") select group_name, used, case", "), z as (select case") .replace(" as status from q", " as status from q) select count(*) as checked, count(*) filter (status = 'EXCEEDED') as exceeded, count(*) filter (status in ('WARNING', 'CRITICAL')) as warning from z"))
def a21(s, d):
    return _quota(s, d, "left").agg(F.count("*").alias("checked"), F.count_if(c("status") == "EXCEEDED").alias("exceeded"), F.count_if(c("status").isin("WARNING", "CRITICAL")).alias("warning"))


def _configs(s, d):
    """Both sides over all of part, a key for each row: its size and brand say which sides have it, and some keys have a second line on side one."""
    p = s.read.parquet(f"{d}/part.parquet")
    key = F.concat(F.lit("k"), c("p_partkey").cast("string")).alias("key")
    one = p.where("p_size % 10 <> 0").select(key, F.concat("p_type", F.lit(" "), "p_size").alias("value"), c("p_partkey").alias("line"))
    again = p.where("p_size % 10 <> 0 and p_size % 4 = 1").select(key, F.lit("again").alias("value"), (-c("p_partkey") - 1).alias("line"))
    two = p.where("p_brand <> 'Brand#1'").select(key, F.concat("p_type", F.lit("  "), F.greatest("p_size", F.lit(20))).alias("value"), c("p_partkey").alias("line"))
    return one.unionByName(again), two


_CONF = """with one as (select 'k' || p_partkey as key, p_type || ' ' || p_size as value, p_partkey as line from part where p_size % 10 <> 0
  union all select 'k' || p_partkey, 'again', -p_partkey - 1 from part where p_size % 10 <> 0 and p_size % 4 = 1),
a as (select key, arg_min(value, line) as old_value from one group by 1),
b as (select 'k' || p_partkey as key, p_type || '  ' || greatest(p_size, 20) as new_value from part where p_brand <> 'Brand#1'),
j as (select coalesce(a.key, b.key) as key, old_value, new_value, case when a.key is null then 'ADDED' when b.key is null then 'REMOVED' when regexp_replace(old_value, '\\s', '', 'g') <> regexp_replace(new_value, '\\s', '', 'g') then 'MODIFIED' else 'UNCHANGED' end as change from a full join b on a.key = b.key) """


@query("J3_config_diff", _CONF + "select * from j where change <> 'UNCHANGED'")
@query("J3_config_diff_whole", _CONF + "select * from j where change <> 'UNCHANGED'")
def j3w(s, d):
    return R.config_diff(*_configs(s, d), ignore_space=True).where("change <> 'UNCHANGED'")


@query("A22_diff_counts", _CONF + "select change, count(*) as n from j group by 1")
@query("A22_diff_counts_whole", _CONF + "select change, count(*) as n from j group by 1")
def a22w(s, d):
    return R.config_diff(*_configs(s, d), ignore_space=True).groupBy("change").agg(F.count("*").alias("n"))


@query("U8_one_sided_keys", _CONF + "select key, change from j where change in ('ADDED', 'REMOVED')")
@query("U8_one_sided_keys_whole", _CONF + "select key, change from j where change in ('ADDED', 'REMOVED')")
def u8w(s, d):
    one, two = (x.select("key").distinct() for x in _configs(s, d))
    return one.join(two, "key", "left_anti").select("key", F.lit("REMOVED").alias("change")).unionByName(two.join(one, "key", "left_anti").select("key", F.lit("ADDED").alias("change")))


_REP = "with r as (select l_partkey as file_id, l_suppkey as server_id, l_linenumber < 7 as present, l_partkey * 10 + case when l_linenumber = 6 then 1 else 0 end as size, l_partkey + case when l_linenumber = 5 and l_suppkey % 4 = 0 then 1 else 0 end as crc, l_orderkey % 50 as create_ts from lineitem qualify row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate) = 1), f as (select file_id, arg_min(size, case when present then server_id end) as z, arg_min(crc, case when present then server_id end) as k, arg_min(create_ts, case when present then server_id end) as t from r group by 1) "


def _replicas(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"))
    x = li.groupBy(c("l_partkey").alias("file_id"), c("l_suppkey").alias("server_id")).agg(first.alias("x"))
    n = c("x.l_linenumber")
    return x.select("file_id", "server_id", (n < 7).alias("present"), (c("file_id") * 10 + F.when(n == 6, 1).otherwise(0)).alias("size"), (c("file_id") + F.when((n == 5) & (c("server_id") % 4 == 0), 1).otherwise(0)).alias("crc"), (c("x.l_orderkey") % 50).alias("create_ts"))


_REPS = "s as (select r.file_id, case when bool_or(not present) then 'MISSING' when bool_or(present and crc <> k) then 'CRC_MISMATCH' when bool_or(present and size <> z) then 'SIZE_MISMATCH' else 'OK' end as status, max(abs(create_ts - t)) filter (present) as lag from r join f using (file_id) group by 1) "


@query("J4_C13_consistency", _REP.rstrip() + ", " + _REPS + "select * from s")
def j4(s, d):
    return R.replicas_checked(_replicas(s, d))


@query("A24_consistency_totals", _REP.rstrip() + ", " + _REPS + "select status, count(*) as n from s group by 1")
def a24(s, d):
    return R.replicas_checked(_replicas(s, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("J5_J6_source_server", "select file_id, server_id, ip from files left join servers on server_id = file_id % 120")
def j5(s, d):
    return B.files(s, d).withColumn("server_id", c("file_id") % 120).join(B.servers(s, d), "server_id", "left").select("file_id", F.when(c("ip").isNotNull(), c("server_id")).alias("server_id"), "ip")


@query("J7_X20_baseline", "with m as (select operation, avg(latency_ms) filter (id % 2 = 0) as a, avg(latency_ms) filter (id % 2 = 1) as b from samples group by 1) select operation, case when a = 0 then 0.0 else round((b - a) * 100 / a, 6) end as change_pct from m")
def j7(s, d):
    x = B.samples(s, d)
    old, new = (x.where(c("id") % 2 == k).groupBy("operation").agg(F.avg("latency_ms").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return old.join(new, "operation").select("operation", F.round(S.percent_change(c("a"), c("b")), 6).alias("change_pct"))


@query("J8_reference_counts", "select signature, size, min(file_id) as kept_id, count(*) as refs from files group by 1, 2")
def j8(s, d):
    return B.files(s, d).groupBy("signature", "size").agg(F.min("file_id").alias("kept_id"), F.count("*").alias("refs"))


@query("J9_not_listed", "select file_id from files where lang not in (select case when file_id % 2 = 0 then 'en' else 'de' end from files)")
def j9(s, d):
    x = B.files(s, d)
    return x.join(x.select(F.when(c("file_id") % 2 == 0, "en").otherwise("de").alias("lang")).distinct(), "lang", "left_anti").select("file_id")


@query("J10_sync_delay", "with p as (select a.group_name, a.server_id, a.synced_ts, max(b.update_ts) as latest from servers a left join servers b on a.group_name = b.group_name and a.server_id <> b.server_id group by 1, 2, 3) select group_name, server_id, cast(case when latest is null or latest = 0 then 0 when synced_ts = 0 then -1 else greatest(latest - synced_ts, 0) end as bigint) as delay from p")
def j10(s, d):
    return R.sync_delay(B.servers(s, d))


@query("J11_overlaps", "with b as (select path, id, \"offset\", size + (\"offset\" % 3) * 32 as size from blocks), m as (select *, max(\"offset\" + size) over (partition by path, id order by \"offset\" rows between unbounded preceding and 1 preceding) as covered_to from b) select path, id, \"offset\", size, covered_to from m where covered_to > \"offset\"")
def j11(s, d):
    b = B.blocks(s, d).withColumn("size", c("size") + c("offset") % 3 * 32)
    return R.overlapping_blocks(b, ["path", "id"], ["size"])


@query("J12_resume", "select file_id, size from files f where not exists (select 1 from files g where g.path = f.path and g.size = f.size and g.file_id % 3 = 0)")
def j12(s, d):
    x = B.files(s, d)
    return x.join(x.where("file_id % 3 = 0").select("path", "size"), ["path", "size"], "left_anti").select("file_id", "size")


@query("A7_group_files", "select group_name, cast(sum(ok_uploads - deletes) as bigint) as n_files, cast(sum(ok_uploads) as bigint) as n_uploads from servers group by 1")
def a7(s, d):
    return B.servers(s, d).groupBy("group_name").agg(F.sum(c("ok_uploads") - c("deletes")).alias("n_files"), F.sum("ok_uploads").alias("n_uploads"))


@query("A8_min_free", "select group_name, server_id, free_mb, total_mb from servers where writable qualify row_number() over (partition by group_name order by free_mb, server_id) = 1")
def a8(s, d):
    return R.min_free(B.servers(s, d))


@query("A9_synced_ts", "select group_name, min(synced_ts) filter (synced_ts > 0 and active) as synced_min, max(synced_ts) filter (synced_ts > 0) as synced_max from servers group by 1")
def a9(s, d):
    t = c("synced_ts")
    return B.servers(s, d).groupBy("group_name").agg(F.min(F.when((t > 0) & c("active"), t)).alias("synced_min"), F.max(F.when(t > 0, t)).alias("synced_max"))


@query("A10_volume_summary", "select cast(sum(total_mb) as bigint) as total_mb, cast(sum(free_mb) as bigint) as free_mb, bool_or(writable) as any_writable, bool_or(active) as any_active from servers")
def a10(s, d):
    return B.servers(s, d).agg(F.sum("total_mb").alias("total_mb"), F.sum("free_mb").alias("free_mb"), F.bool_or("writable").alias("any_writable"), F.bool_or("active").alias("any_active"))


@query("A11_rollup", "select group_name, ip, cast(sum(total_mb) as bigint) as total_mb, round(sum(total_mb - free_mb) * 100.0 / sum(total_mb), 6) as used_pct from servers group by rollup (group_name, ip)")
def a11(s, d):
    return B.servers(s, d).rollup("group_name", "ip").agg(F.sum("total_mb").alias("total_mb"), F.round(S.ratio(F.sum(c("total_mb") - c("free_mb")) * 100, F.sum("total_mb")), 6).alias("used_pct"))


_REPL = "with l as (select *, update_ts - synced_ts as lag, case when not active then 'FAILED' when synced_ts = 0 then 'UNKNOWN' when 1706745600 - update_ts > 3600 then 'STALLED' when update_ts - synced_ts >= 3600 then 'FAILED' when update_ts - synced_ts >= 300 then 'LAGGING' when update_ts - synced_ts < 0 then 'UNKNOWN' else 'HEALTHY' end as state, case when update_ts - synced_ts > 0 and uploads > 0 then (update_ts - synced_ts) // 10 else 0 end as pending from servers) "


def _repl(s, d):
    lag = c("update_ts") - c("synced_ts")
    return B.servers(s, d).withColumns({"lag": lag, "state": C.replication(lag, c("synced_ts"), c("update_ts"), c("active"), F.lit(NOW)), "pending": C.pending(lag, c("uploads"))})


@query("C2_C4_replication", _REPL + "select server_id, lag, state, cast(pending as bigint) as pending from l")
def c2(s, d):
    return _repl(s, d).select("server_id", "lag", "state", "pending")


@query("A12_C3_replication_groups", _REPL + "select group_name, count(*) filter (state = 'FAILED') as failed, count(*) filter (state = 'STALLED') as stalled, count(*) filter (state = 'LAGGING') as lagging, count(*) filter (state = 'HEALTHY') as healthy, max(lag) as max_lag, cast(sum(lag) filter (lag > 0) // count(*) filter (lag > 0) as bigint) as mean_lag, cast(sum(pending) as bigint) as pending, case when failed > 0 then 'FAILED' when stalled > 0 then 'STALLED' when lagging > 0 then 'LAGGING' when healthy = count(*) then 'HEALTHY' else 'UNKNOWN' end as state from l group by 1")
def a12(s, d):
    n = {k.lower(): F.count_if(c("state") == k).alias(k.lower()) for k in ("FAILED", "STALLED", "LAGGING", "HEALTHY")}
    g = _repl(s, d).groupBy("group_name").agg(*n.values(), F.max("lag").alias("max_lag"), F.expr("sum(if(lag > 0, lag, 0)) div nullif(count_if(lag > 0), 0)").alias("mean_lag"), F.sum("pending").alias("pending"), F.count("*").alias("n"))
    return g.withColumn("state", C.replication_of_group(c("failed"), c("stalled"), c("lagging"), c("healthy"), c("n"))).drop("n")


@query("A13_C12_balance", "with g as (select group_name, min(free_mb) as lo, max(free_mb) as hi, avg(free_mb) as mean, case when avg(free_mb) = 0 then 0 else (max(free_mb) - min(free_mb)) * 100 / avg(free_mb) end as imb from servers where active group by 1) select group_name, lo, hi, round(mean, 6) as mean, round(imb, 6) as imbalance, case when imb < 10 then 'balanced' when imb < 30 then 'slight imbalance' else 'imbalanced' end as label from g")
def a13(s, d):
    g = B.servers(s, d).where("active").groupBy("group_name").agg(F.min("free_mb").alias("lo"), F.max("free_mb").alias("hi"), F.avg("free_mb").alias("m"))
    g = g.withColumn("i", S.ratio((c("hi") - c("lo")) * 100, c("m")))
    return g.select("group_name", "lo", "hi", F.round("m", 6).alias("mean"), F.round("i", 6).alias("imbalance"), C.balance(c("i")).alias("label"))


@query("A14_imbalance", "with g as (select group_name, sum(total_mb - free_mb) * 100.0 / sum(total_mb) as u from servers where active group by 1) select case when count(*) < 2 then 0.0 else round((max(u) - min(u)) / avg(u), 6) end as imbalance from g")
def a14(s, d):
    g = B.servers(s, d).where("active").groupBy("group_name").agg(S.ratio(F.sum(c("total_mb") - c("free_mb")) * 100, F.sum("total_mb")).alias("u"))
    return g.agg(F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.round(S.ratio(F.max("u") - F.min("u"), F.avg("u")), 6)).alias("imbalance"))


@query("O5_source_target", "with g as (select group_name, sum(total_mb - free_mb) / sum(total_mb) as u, sum(free_mb) as f from servers group by 1) select a.group_name as source_group, b.group_name as target_group from (select * from g order by u desc, group_name desc limit 1) a, (select * from g where f > 1024 order by u, group_name limit 1) b where a.group_name <> b.group_name")
def o5(s, d):
    g = B.servers(s, d).groupBy("group_name").agg((F.sum(c("total_mb") - c("free_mb")) / F.sum("total_mb")).alias("usage"), F.sum("free_mb").alias("free"))
    return R.source_and_target(g, 1024)


@query("A19_averages", "select round(avg(m), 6) as mean_ms, cast(sum(n) as bigint) as total_ops from (select operation, avg(latency_ms) as m, count(*) as n from samples group by 1)")
def a19(s, d):
    return B.samples(s, d).groupBy("operation").agg(F.avg("latency_ms").alias("m"), F.count("*").alias("n")).agg(F.round(F.avg("m"), 6).alias("mean_ms"), F.sum("n").alias("total_ops"))


_HEALTH = "case when not active then 'CRIT' when 1706745600 - heartbeat > 60 then 'CRIT' when free_mb * 100 // total_mb < 10 then 'CRIT' when free_mb * 100 // total_mb < 20 then 'WARN' when uploads > 100 and (uploads - ok_uploads) / uploads > 0.1 then 'WARN' else 'OK' end"


def _health(s, d):
    return B.servers(s, d).withColumn("health", C.storage_health(c("active"), F.lit(NOW) - c("heartbeat"), c("free_mb"), c("total_mb"), c("uploads"), c("uploads") - c("ok_uploads")))


@query("C14_health", f"select server_id, {_HEALTH} as health from servers")
def c14(s, d):
    return _health(s, d).select("server_id", "health")


@query("A20_health_tally", f"with h as (select group_name, {_HEALTH} as health from servers) select group_name, count(*) filter (health = 'OK') as ok, count(*) filter (health = 'WARN') as warn, count(*) filter (health = 'CRIT') as crit, bool_and(health = 'OK') as healthy from h group by 1")
def a20(s, d):
    return _health(s, d).groupBy("group_name").agg(*[F.count_if(c("health") == k).alias(k.lower()) for k in ("OK", "WARN", "CRIT")], F.every(c("health") == "OK").alias("healthy"))


@query("A23_outcomes", "select case when size % 7 = 0 then 'failed' when size % 5 = 0 then 'skipped' else 'done' end as status, count(*) as n, cast(sum(size) as bigint) as bytes from files group by 1")
def a23(s, d):
    status = S.chain((c("size") % 7 == 0, "failed"), (c("size") % 5 == 0, "skipped"), otherwise="done")
    return B.files(s, d).groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_HIST = "with h as (select o_orderpriority as group_name, datediff('day', date '1990-01-01', cast(o_orderdate as date)) as day, cast(sum(floor(o_totalprice)) over (partition by o_orderpriority order by o_orderdate, o_orderkey) as double) as used from orders), g as (select group_name, count(*) as n, coalesce(regr_slope(used, day), 0) as per_day, max(used) as used from h group by 1) "


def _growth(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(c("o_orderpriority").alias("group_name"), "o_orderdate", "o_orderkey", F.floor("o_totalprice").alias("bytes"))
    h = W.running_sum(o, ["group_name"], F.date_trunc("month", c("o_orderdate")), ["o_orderdate", "o_orderkey"], c("bytes"), "used")
    h = h.select("group_name", F.datediff(c("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("day"), c("used").cast("double").alias("used"))
    return h.groupBy("group_name").agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("used", "day"), F.lit(0.0)).alias("per_day"), F.max("used").alias("used"))


_HIST = _HIST.replace("order by o_orderdate, o_orderkey) as double", "order by o_orderdate, o_orderkey rows unbounded preceding) as double")


@query("A26_growth", _HIST + "select group_name, n, round(per_day, 3) as per_day from g")
def a26(s, d):
    return _growth(s, d).select("group_name", "n", F.round("per_day", 3).alias("per_day"))


_PLAN = "p as (select group_name, used, per_day, 2 * used as total, case when used >= 1.6 * used then 0.0 when per_day <= 0 then -1.0 else (1.6 * used - used) / per_day end as to_warning, case when per_day <= 0 then -1.0 else used / per_day end as to_full from g) "


@query("C7_C8_C9_C10_projection", _HIST.rstrip() + ", " + _PLAN + "select group_name, round(to_warning, 3) as to_warning, round(to_full, 3) as to_full, round(least(greatest(used + 365 * per_day, 0), total) / 1000000, 3) as in_a_year, case when least(greatest(used + 365 * per_day, 0), total) * 100 / total >= 90 then 'critical' when least(greatest(used + 365 * per_day, 0), total) * 100 / total >= 80 then 'warning' else 'ok' end as alert, case when to_full >= 0 and to_full <= 30 then 1 when to_full >= 0 and to_full <= 90 then 2 when to_full < 0 then 2 else 3 end as priority from p")
def c8(s, d):
    g = _growth(s, d).withColumn("total", c("used") * 2)
    year = F.least(F.greatest(c("used") + 365 * c("per_day"), F.lit(0)), c("total"))
    full = C.projected_days(c("total"), c("used"), c("per_day"))
    return g.select("group_name", F.round(C.projected_days(1.6 * c("used"), c("used"), c("per_day")), 3).alias("to_warning"), F.round(full, 3).alias("to_full"), F.round(year / 1000000, 3).alias("in_a_year"), C.alert_level(year * 100 / c("total")).alias("alert"), C.priority(full).alias("priority"))


@query("C11_rebalance", "with p as (select server_id, group_name, (total_mb - free_mb) * 100.0 / total_mb as pct, total_mb - free_mb as used, total_mb from servers), m as (select group_name, avg(pct) as mean from p group by 1) select server_id, case when pct >= 80 then 'overloaded' when pct <= 60 then 'underloaded' else 'balanced' end as state, cast(greatest(floor(used - mean * total_mb / 100), 0) as bigint) as to_move from p join m using (group_name)")
def c11(s, d):
    p = B.servers(s, d).withColumns({"used": c("total_mb") - c("free_mb"), "pct": S.ratio((c("total_mb") - c("free_mb")) * 100, c("total_mb"))})
    m = p.groupBy("group_name").agg(F.avg("pct").alias("mean"))
    return p.join(m, "group_name").select("server_id", C.rebalance(c("pct")).alias("state"), F.greatest(F.floor(c("used") - c("mean") * c("total_mb") / 100), F.lit(0)).cast("long").alias("to_move"))


@query("C15_space_check", "select server_id, case when u >= 95 then 'FAIL' when u >= 85 then 'WARN' else 'OK' end as state, case when u > 95 then 'FAIL' when u > 85 then 'WARN' else 'OK' end as strict_state from (select server_id, (total_mb - free_mb) * 100.0 / total_mb as u from servers where total_mb > 0)")
def c15(s, d):
    u = S.ratio((c("total_mb") - c("free_mb")) * 100, c("total_mb"))
    return B.servers(s, d).where("total_mb > 0").select("server_id", C.space_check(u).alias("state"), C.space_check(u, strict=True).alias("strict_state"))


@query("W4_C16_network", "with o as (select *, sum(cast(success as int)) over (partition by operation order by ts, id) as k from samples), w as (select *, avg(latency_ms) filter (success) over (partition by operation order by k range between 999 preceding and current row) as m, sum(1 - cast(success as int)) over (partition by operation, k order by ts, id) as f from o) select id, round(m + 0.0000001, 3) as moving_ms, cast(f as bigint) as failures_in_row, case when f >= 3 then 'DOWN' when m >= 500 then 'CRITICAL' when m >= 100 then 'WARNING' else 'OK' end as state from w")
def w4(s, d):
    m = W.moving_average(B.samples(s, d), ["operation"], F.date_trunc("hour", c("ts")))
    return m.select("id", F.round(c("moving_ms") + 1e-7, 3).alias("moving_ms"), c("failures_in_row").cast("long").alias("failures_in_row"), C.network(c("failures_in_row"), F.lit(0), c("moving_ms")).alias("state"))


@query("C17_C21_verify", "select file_id, case when file_id % 11 = 0 then 'MISSING' when size % 13 <> size % 17 and file_id % 5 = 0 then 'CORRUPTED' else 'OK' end as verified, case when file_id % 11 = 0 and file_id % 2 = 1 then 'FAILED' when file_id % 11 = 0 then 'MISSING' when file_id % 2 = 0 and size % 13 <> size % 17 then 'CORRUPTED' else 'OK' end as repair from files")
def c17(s, d):
    here, kept = c("file_id") % 11 != 0, c("file_id") % 2 == 0
    return B.files(s, d).select("file_id", C.verification(here, F.when(c("file_id") % 5 == 0, c("size") % 13).otherwise(c("size") % 17), c("size") % 17).alias("verified"), C.repair(here, c("size") % 13, kept, c("size") % 17).alias("repair"))


@query("C19_labels", "select server_id, case status when 7 then 'ACTIVE' when 5 then 'ONLINE' when 6 then 'OFFLINE' else 'UNKNOWN' end as label from servers")
def c19(s, d):
    return B.servers(s, d).select("server_id", C.status_label(c("status")).alias("label"))


@query("C22_profiles", "select server_id, cast(least(greatest((server_id % 40) * 2, 2), 32) as int) as threads from servers")
def c22(s, d):
    return B.servers(s, d).select("server_id", C.worker_profile(c("server_id") % 40, 32).alias("threads"))


@query("X24_disks", "select group_name, n as disks, cast(ceil(used / (n * 1000.0)) as bigint) as servers_needed from (select group_name, sum(total_mb - free_mb) as used from servers group by 1), (select unnest([1, 2, 4, 8, 16]) as n) where ceil(used / (n * 1000.0)) between 1 and 100")
def x24(s, d):
    g = B.servers(s, d).groupBy("group_name").agg(F.sum(c("total_mb") - c("free_mb")).alias("used")).withColumn("disks", F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16)))))
    return g.select("group_name", "disks", F.ceil(c("used") / (c("disks") * 1000.0)).alias("servers_needed")).where("servers_needed between 1 and 100")


@query("W1_merged_blocks", "with l as (select *, case when lag(\"offset\" + size) over w = \"offset\" then 0 else 1 end as n from blocks window w as (partition by path, id order by \"offset\")), i as (select *, sum(n) over (partition by path, id order by \"offset\") as k from l) select path, id, min(\"offset\") as \"offset\", max(\"offset\" + size) - min(\"offset\") as size, count(*) as n_blocks from i group by path, id, k")
def w1(s, d):
    return R.merged_blocks(B.listed_blocks(s, d), ["path", "id"])


@query("W3_retention", "with r as (select o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank, datediff('day', cast(o_orderdate as date), date '2002-01-01') as age from orders) select id, cast(rank as int) as rank, rank > 3 or age > 1500 as \"drop\" from r")
def w3(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(c("o_orderkey").alias("id"), c("o_custkey").alias("owner"), c("o_orderdate").alias("ts"))
    return R.retained(o, 3, 1500, F.lit("2002-01-01").cast("date"), ["owner"]).select("id", "rank", "drop")


_ALERTS = "with recursive m as (select event_type || (user_id % 20) as message, cast(floor(epoch(ts)) as bigint) as t from events), x as (select message, min(t) as ts from m group by 1 union all select message, nxt from (select x.message, (select min(t) from m where m.message = x.message and m.t >= x.ts + 86400) as nxt from x) where nxt is not null) select message, ts from x"


@query("W5_suppressed_alerts", _ALERTS)
def w5(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return R.suppressed(e.select(F.concat("event_type", c("user_id") % 20).alias("message"), F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1000000).alias("ts")), 86400)


@query("W7_rate", "with c as (select id, operation, ts, (id * 13) % 997 as v, lag((id * 13) % 997) over (partition by operation order by ts, id) as p from log), s as (select operation, ts, case when p is null then 0 when v >= p then v - p else v end as step from c) select operation, cast(floor(floor(epoch(ts)) / 86400) * 86400 as bigint) as window_start, round(sum(step) / 86400.0, 9) as per_second from s group by 1, 2")
def w7(s, d):
    x = B.log(s, d).withColumn("counter", c("id") * 13 % 997).withColumn("ts", c("ts").cast("timestamp"))
    return W.rates(x, ["operation"], 86400).select("operation", "window_start", F.round("per_second", 9).alias("per_second"))


@query("O3_max_free_group", "select group_name, server_id, free_mb from servers where writable order by free_mb desc, server_id limit 1")
def o3(s, d):
    return R.top(B.servers(s, d).where("writable").select("group_name", "server_id", "free_mb"), 1, F.desc("free_mb"), F.asc("server_id"))


@query("O4_store_server", "select group_name, server_id from servers qualify row_number() over (partition by group_name order by uploads % 7, server_id) = 1")
def o4(s, d):
    return B.servers(s, d).groupBy("group_name").agg(F.min_by("server_id", F.struct(c("uploads") % 7, c("server_id"))).alias("server_id"))


@query("O6_leader", "select server_id from servers order by writable desc, uploads % 13 desc, deletes % 5, ip desc, server_id desc limit 1")
def o6(s, d):
    t = B.servers(s, d).select("server_id", c("writable").alias("is_leader"), (c("uploads") % 13).alias("running_time"), (c("deletes") % 5).alias("restart_interval"), "ip", c("server_id").alias("port"))
    return R.leader(t).select("server_id")


@query("O7_best_fit", "with m as (select path, id, \"offset\", size + (\"offset\" // 64 % 9) * 64 as size from blocks) select path, id, \"offset\", size, size - 256 as left_size from m where size >= 256 order by size, path, id, \"offset\" limit 1")
def o7(s, d):
    b = B.blocks(s, d).withColumn("size", c("size") + F.floor(c("offset") / 64) % 9 * 64)
    return R.best_fit(b, 200, 64)


@query("O8_trunk_server", "select group_name, max_by(server_id, struct_pack(a := uploads % 101, b := server_id)) as server_id from servers group by 1")
def o8(s, d):
    return B.servers(s, d).groupBy("group_name").agg(F.max_by("server_id", F.struct(c("uploads") % 101, c("server_id"))).alias("server_id"))


@query("O9_sorted_servers", "select row_number() over (order by group_name, server_id) as pos, group_name, server_id from servers")
def o9(s, d):
    found = W.positions(B.servers(s, d).select("group_name", "server_id"), ["server_id"], [c("group_name"), F.floor(c("server_id") / 10_000)])
    return found.select("pos", "group_name", "server_id")


@query("O10_sorted_metadata", "select file_id, 'ext=' || ext || ';group=' || group_name || ';lang=' || lang as metadata from files")
def o10(s, d):
    m = F.map_entries(F.create_map(F.lit("lang"), c("lang"), F.lit("group"), c("group_name"), F.lit("ext"), c("ext")))
    return B.files(s, d).select("file_id", F.array_join(F.transform(F.array_sort(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


@query("U1_U2_tag_sets", "select file_id, lang || ',' || ext || case when lang = 'en' then '' else ',en' end as merged, case when lang = 'en' then ext else lang || ',' || ext end as removed from files")
def u1(s, d):
    tags = F.array("lang", "ext")
    return B.files(s, d).select("file_id", F.array_join(R.merged_tags(tags, F.array(F.lit("en"), c("ext"))), ",").alias("merged"), F.array_join(F.array_except(tags, F.array(F.lit("en"))), ",").alias("removed"))


@query("U3_U4_metadata_merge", "select file_id, 'a=1;b=' || ext || ';c=' || lang as merged, case when file_id % 2 = 0 then 'b=' || ext || ';c=' || lang else '' end as overwritten from files")
def u3(s, d):
    new = F.create_map(F.lit("b"), c("ext"), F.lit("c"), c("lang"))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    merged = R.merged_map(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("old")), new)
    return B.files(s, d).select("file_id", text(merged).alias("merged"), F.when(c("file_id") % 2 == 0, text(new)).otherwise("").alias("overwritten"))


@query("U5_U6_log_union", "with u as (select filename, ts, line_no from changes where ts < 4000 union all select filename, ts, line_no from changes where ts >= 4000) select filename, min(line_no) as line_no from u group by 1")
def u5(s, d):
    x = B.changes(s, d).select("filename", "ts", "line_no")
    return x.where("ts < 4000").unionByName(x.where("ts >= 4000")).groupBy("filename").agg(F.min("line_no").alias("line_no"))


@query("U7_unique_servers", "select distinct ip from servers")
def u7(s, d):
    return B.servers(s, d).select("ip").dropDuplicates(["ip"])


@query("L1_live_blocks", "with r as (select filename % 50 as path, line_no % 40 as id, ts, line_no, case when op = 'D' then 'D' else 'A' end as op, row_number() over (partition by filename % 50, line_no % 40 order by ts desc, line_no desc) as k from changes) select path, id, line_no % 7 as size from r where k = 1 and op = 'A'")
def l1(s, d):
    x = B.changes(s, d).select((c("filename") % 50).alias("path"), (c("line_no") % 40).alias("id"), "ts", "line_no", F.when(c("op") == "D", "D").otherwise("A").alias("op"), (c("line_no") % 7).alias("size"), *B.STORED)
    return R.live_blocks(x, ["path", "id"], B.STORED)


@query("L1_replay_warnings", "with r as (select filename % 500 as id, ts, line_no, case when op = 'D' then 'D' else 'A' end as op from changes), w as (select *, lag(op) over (partition by id order by ts, line_no) as p from r) select id, line_no, case when op = 'A' then 'duplicate_add' else 'missing_delete' end as warning from w where (op = 'A' and p = 'A') or (op = 'D' and (p is null or p = 'D'))")
def l1w(s, d):
    x = B.changes(s, d).select((c("filename") % 500).alias("id"), "ts", "line_no", F.when(c("op") == "D", "D").otherwise("A").alias("op"), *B.STORED)
    return R.replay_warnings(x, ["id"], B.STORED).select("id", "line_no", "warning")


@query("L3_live_files", "with e as (select filename, ts, line_no, case when op = 'D' then 'D' else 'C' end as op from changes union all select src, ts, line_no, 'D' from changes where src is not null and upper(op) = 'R') select filename, max(ts) as last_ts from e group by 1 having arg_max(op, struct_pack(a := ts, b := line_no)) = 'C'")
def l3(s, d):
    return R.live_files(B.changes(s, d), B.STORED)


@query("L6_membership_log", "select server_id, heartbeat, status from servers where heartbeat >= 1706745540 and group_name = 'ASIA'")
def l6(s, d):
    return B.servers(s, d).where((c("heartbeat") >= 1706745540) & (c("group_name") == "ASIA")).select("server_id", "heartbeat", "status")


@query("S15_one_path", "select line_no, filename, op from changes where filename % 4 = 1")
def s15(s, d):
    return B.changes(s, d).where(c("filename") % 4 == 1).select("line_no", "filename", "op")


@query("S17_byte_range", "select doc_id, cast(encode(text)[101:150] as blob) as part, octet_length(encode(text)[101:]) as rest from documents")
def s17(s, d):
    from stowlens.sources.scans import byte_range

    x = s.read.parquet(f"{d}/documents.parquet").withColumn("b", c("text").cast("binary"))
    return x.select("doc_id", byte_range(c("b"), 100, 50).alias("part"), F.length(byte_range(c("b"), 100, 0)).cast("long").alias("rest"))


@query("X1_parse_size", "select file_id, cast(floor((file_id % 100) * 1.5 * case file_id % 4 when 0 then 1 when 1 then 1024 when 2 then 1048576 else 1073741824 end) as bigint) as bytes from files")
def x1(s, d):
    unit = F.element_at(F.array(*map(F.lit, ("", "k", "MB", "G"))), (c("file_id") % 4 + 1).cast("int"))
    return B.files(s, d).select("file_id", S.parse_size(F.concat(F.format_string("%.1f", c("file_id") % 100 * 1.5), unit)).alias("bytes"))


@query("X5_X8_X14_names", "select file_id, lower(ext) as ext, group_name as grp, path[length(group_name) + 2:] as rest from files")
def x5(s, d):
    return B.files(s, d).select("file_id", S.extension_of_name(c("path")).alias("ext"), S.group_of(c("path")).alias("grp"), S.split_id(c("path"))["path"].alias("rest"))


@query("X3_X4_dates", "select o_orderkey as id, cast(epoch(o_orderdate) as bigint) as ts, case when o_orderkey % 10 = 0 then 'Unknown' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as shown from orders")
def x3(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").withColumn("t", S.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select(c("o_orderkey").alias("id"), c("t").alias("ts"), S.format_timestamp(F.when(c("o_orderkey") % 10 == 0, 0).otherwise(c("t"))).alias("shown"))


@query("X16_tags", "select event_id, 'a,' || event_type as tags from events")
def x16(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.array_join(S.split_tags(F.concat(F.lit(" a ,, "), "event_type", F.lit(" ,"))), ",").alias("tags"))


@query("X17_key_value", "select event_id, event_type as k, cast(user_id as varchar) as v from events")
def x17(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("kv", S.key_value(F.concat(F.lit(" "), "event_type", F.lit(' = "'), "user_id", F.lit('" '))))
    return e.select("event_id", c("kv.key").alias("k"), c("kv.value").alias("v"))


@query("X19_durations", "select file_id, case when size < 60 then size || 's' when size < 3600 then size // 60 || 'm ' || size % 60 || 's' when size < 86400 then size // 3600 || 'h ' || size % 3600 // 60 || 'm' else size // 86400 || 'd ' || size % 86400 // 3600 || 'h' end as shown from files")
def x19(s, d):
    return B.files(s, d).select("file_id", S.format_duration(c("size")).alias("shown"))


@query("X21_export_path", "select file_id, '/out/' || replace(path, '/', '_') as target from files")
def x21(s, d):
    return B.files(s, d).select("file_id", S.export_path("/out/", c("path")).alias("target"))


@query("X26_tokens", "select file_id, md5(path || 'secret' || cast(create_ts as varchar)) as token, create_ts >= 1700010000 as valid from files")
def x26(s, d):
    t = S.access_token(c("path"), "secret", c("create_ts"))
    return B.files(s, d).select("file_id", t.alias("token"), S.token_valid(c("path"), "secret", c("create_ts"), t, F.lit(1700010600), 600).alias("valid"))


@query("X27_parameters", "select event_id, event_type as found, cast(null as varchar) as lacking from events")
def x27(s, d):
    q = F.concat(F.lit("x=1&op="), "event_type", F.lit("&op=other"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", S.first_parameter(q, "op").alias("found"), S.first_parameter(q, "y").alias("lacking"))


@query("X23_X28_content_type", "select file_id, coalesce(t, 'application/octet-stream') as content_type from files left join (select 'src1' as e, 'text/plain' as t union all select 'src2', 'image/png') on e = ext")
def x23(s, d):
    types = s.createDataFrame([("src1", "text/plain"), ("src2", "image/png")], "ext string, t string")
    return B.files(s, d).join(types, "ext", "left").select("file_id", F.coalesce("t", F.lit("application/octet-stream")).alias("content_type"))


@query("X30_ratios", "select file_id, case when size = 0 then 0.0 else round((size // 3) / size, 9) end as ratio, round(size * 8 / 2000000.0, 6) as mbps from files")
def x30(s, d):
    return B.files(s, d).select("file_id", F.round(S.ratio(F.expr("size div 3"), c("size")), 9).alias("ratio"), F.round(S.bandwidth_mbps(c("size"), F.lit(2)), 6).alias("mbps"))


@query("X9_round_trip", "select file_id, file_id % 1000 as source, create_ts, size, size % 4294967296 as crc32, 'normal' as kind from files")
def x9(s, d):
    ident = S.encode_id(c("group_name"), F.lit("M00/00/00"), c("file_id") % 1000, c("create_ts"), c("size"), c("size") % F.lit(1 << 32), F.concat(F.lit("."), "ext"))
    return B.files(s, d).select("file_id", S.decode_id(ident).alias("x")).select("file_id", "x.*")


@query("X11_trunk_round_trip", "select file_id, file_id as trunk_id, file_id * 64 as \"offset\", size from files")
def x11(s, d):
    return B.files(s, d).select("file_id", S.decode_trunk(S.encode_trunk(c("file_id"), c("file_id") * 64, c("size"))).alias("x")).select("file_id", "x.*")


@query("X18_metadata", "select file_id, 'ext=' || ext || ',lang=' || lang as back from files")
def x18(s, d):
    m = S.unpack_metadata(S.pack_metadata(F.create_map(F.lit("lang"), c("lang"), F.lit("ext"), c("ext"))))
    return B.files(s, d).select("file_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("back"))


#: crc32 over the bytes of a text, and the PJW hash over the characters of a name, as DuckDB folds.
_CRC_TABLE = "tab as materialized (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t)"
_CRC = """xor(list_reduce(list_transform(range(octet_length(encode({0}))), lambda i: (position(substring(hex(encode({0})), 2 * i + 1, 1) in '0123456789ABCDEF') - 1) * 16 + position(substring(hex(encode({0})), 2 * i + 2, 1) in '0123456789ABCDEF') - 1),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""
_PJW = """list_reduce(list_transform(range(length({0})), lambda i: unicode(substring({0}, i + 1, 1))),
  lambda h, x: case when (((h << 4) + x) & 4026531840) <> 0 then xor(((h << 4) + x) & 268435455, (((h << 4) + x) & 4026531840) >> 24) & 268435455 else (((h << 4) + x) & 4294967295) end, 0)"""


@query("X13_X12_X29_hashes", f"with {_CRC_TABLE}, n as (select doc_id, text, 'M00/00/00/abcdefghijklmnopqrs' || doc_id as stem from documents), h as (select doc_id, text, stem, cast({_PJW.format("(stem || '.jpg')")} as bigint) % 65536 as h from n) select doc_id, cast(case when text = '' then 0 else {_CRC.format('text')} end as bigint) as crc32, cast(h >> 8 as int) as high, cast(h & 255 as int) as low, stem || '_150.jpg' as slave from h, tab")
def x13(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.lit("M00/00/00/abcdefghijklmnopqrs"), "doc_id", F.lit(".jpg"))
    return docs.select("doc_id", F.crc32(c("text").cast("binary")).alias("crc32"), S.path_hash(name).alias("at"), S.slave_name(name, F.lit("_150"), F.lit(None).cast("string")).alias("slave")).select("doc_id", "crc32", "at.*", "slave")


@query("X2_format_bytes", "select file_id, size, size < 1024 as plain from files")
def x2(s, d):
    shown = S.format_bytes(c("size"))
    return B.files(s, d).select("file_id", "size", shown.rlike(r"^\d+ B$").alias("plain"))


@query("B_dashboard", "select cast(sum(total_mb) as bigint) as total_mb, round(sum(free_mb) * 100.0 / sum(total_mb), 6) as free_pct, count(*) as n_servers, max(1706745600 - heartbeat) as heartbeat_delay from servers")
def dashboard(s, d):
    return B.servers(s, d).agg(F.sum("total_mb").alias("total_mb"), F.round(S.ratio(F.sum("free_mb") * 100, F.sum("total_mb")), 6).alias("free_pct"), F.count("*").alias("n_servers"), F.max(F.lit(NOW) - c("heartbeat")).alias("heartbeat_delay"))


@query("X2_format_bytes_text", "select file_id, case when n >= 1099511627776 then printf('%.2f TB', n / 1099511627776.0) when n >= 1073741824 then printf('%.2f GB', n / 1073741824.0) when n >= 1048576 then printf('%.2f MB', n / 1048576.0) when n >= 1024 then printf('%.2f KB', n / 1024.0) else n || ' B' end as shown from (select file_id, case file_id % 5 when 0 then file_id when 1 then size when 2 then size * 1024 + 512 when 3 then size * 1048576 else size * 1073741824 end as n from files)")
def x2t(s, d):
    """The text itself, in all units."""
    k = c("file_id") % 5
    n = S.chain((k == 0, c("file_id")), (k == 1, c("size")), (k == 2, c("size") * 1024 + 512), (k == 3, c("size") * (1 << 20)), otherwise=c("size") * (1 << 30))
    return B.files(s, d).select("file_id", S.format_bytes(n).alias("shown"))


@query("X6_X7_X25_extensions", "with n as (select file_id, case file_id % 4 when 0 then path when 1 then path || '.tar.Gz' when 2 then replace(path, '.', '_') else path || '.averylongone' end as p from files) select file_id, case when contains(p, '.') then split_part(p, '.', -1) else 'no_ext' end as whole, case when contains(p, '.') then left(split_part(p, '.', -1), 6) else '' end as short, case when contains(right(p, 6), '.') then split_part(p, '.', -1) end as near from n")
def x6(s, d):
    k = c("file_id") % 4
    p = S.chain((k == 0, c("path")), (k == 1, F.concat("path", F.lit(".tar.Gz"))), (k == 2, F.replace("path", F.lit("."), F.lit("_"))), otherwise=F.concat("path", F.lit(".averylongone")))
    return B.files(s, d).withColumn("p", p).select("file_id", S.extension_of_id(c("p")).alias("whole"), S.extension_short(c("p")).alias("short"), S.extension_near_end(c("p")).alias("near"))


@query("U5_U6_trunk_files", "with u as (select l_suppkey % 40 as path, l_partkey % 60 as id, l_orderkey * 10 + l_linenumber as line_no from lineitem), f as (select path, id, min(line_no) as line_no from u where line_no % 3 = 0 group by 1, 2) select path, id, line_no, 'first' as source from f union all select path, id, line_no, 'appended' from u where line_no % 3 = 1")
def u5f(s, d):
    """The first record of each (path, id) of one log, then all of another appended."""
    x = s.read.parquet(f"{d}/lineitem.parquet").select((c("l_suppkey") % 40).alias("path"), (c("l_partkey") % 60).alias("id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("line_no"))
    return R.rebuilt_log(x.where("line_no % 3 = 0"), x.where("line_no % 3 = 1"), ["path", "id"])


@query("L1_live_blocks_by_offset", "with r as (select filename % 50 as path, line_no % 40 as id, (line_no % 5) * 64 as \"offset\", ts, line_no, case when op = 'D' then 'D' else 'A' end as op, row_number() over (partition by filename % 50, line_no % 40, line_no % 5 order by ts desc, line_no desc) as k from changes) select path, id, \"offset\", line_no % 7 as size from r where k = 1 and op = 'A'")
def l1o(s, d):
    return R.live_blocks(_space_log(s, d), ["path", "id", "offset"], B.STORED)


def _space_log(s, d):
    x = B.changes(s, d)
    return x.select((c("filename") % 50).alias("path"), (c("line_no") % 40).alias("id"), (c("line_no") % 5 * 64).alias("offset"), "ts", "line_no", F.when(c("op") == "D", "D").otherwise("A").alias("op"), (c("line_no") % 7).alias("size"), *B.STORED)


_RENAMES = "n as (select filename, ts, line_no, case when line_no % 11 = 0 then 'R' else op end as op, case when line_no % 11 = 0 then filename - 1 end as src from changes), "


@query("L3_live_files_renamed", f"with {_RENAMES} e as (select filename, ts, line_no, case when upper(op) = 'D' then 'D' else 'C' end as op from n union all select src, ts, line_no, 'D' from n where op = 'R') select filename, max(ts) as last_ts from e group by 1 having arg_max(op, struct_pack(a := ts, b := line_no)) = 'C'")
def l3r(s, d):
    """Renames among the changes end the old names' lives."""
    x = B.changes(s, d)
    renamed = c("line_no") % 11 == 0
    return R.live_files(x.select("filename", "ts", "line_no", F.when(renamed, "R").otherwise(c("op")).alias("op"), F.when(renamed, c("filename") - 1).alias("src"), *B.STORED), B.STORED)


@query("L6_membership_changes", "with m as (select ts, line_no, 'group' || (filename % 4) as group_name, filename % 97 as server_id, cast(5 + line_no % 3 as int) as status from changes), k as (select *, lag(status) over (partition by group_name, server_id order by ts, line_no) as before from m) select ts, line_no, group_name, server_id, before, status from k where before is distinct from status and ts >= 4000")
def l6c(s, d):
    """From a time on, the entries of a membership log that change a server's status."""
    x = B.changes(s, d).select("ts", "line_no", F.concat(F.lit("group"), c("filename") % 4).alias("group_name"), (c("filename") % 97).alias("server_id"), (c("line_no") % 3 + 5).cast("int").alias("status"))
    return R.status_changes(x, ["group_name", "server_id"]).where("ts >= 4000")
