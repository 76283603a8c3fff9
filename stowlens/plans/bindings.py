"""The driver's tables in the roles of storage telemetry: an analogy, no real cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of checked queries, as epoch seconds (2024-02-01).
NOW = 1706745600

#: Columns of changes() in the order in which entries are stored; files in any fixed order, by a number short to sort.
STORED = ["file", "row"]

#: The same roles as DuckDB SQL, put before each query's SQL.
VIEWS = {
    "files": "select doc_id as file_id, 'group' || (doc_id % 4) as group_name, 'group' || (doc_id % 4) || '/M00/' || lang || '/' || doc_id || '.' || source as path, n_chars * 997 as size, 1700000000 + doc_id * 37 as create_ts, lang, source as ext, md5(text) as signature from documents",
    "servers": "select s_suppkey as server_id, r_name as group_name, n_name as ip, 10000 + (s_suppkey * 37) % 5000 as total_mb, cast(floor(abs(s_acctbal)) as bigint) as free_mb, cast(5 + s_suppkey % 3 as int) as status, s_suppkey % 3 = 2 as active, s_suppkey % 5 <> 0 as writable, s_suppkey * 11 as uploads, s_suppkey * 10 as ok_uploads, s_suppkey * 3 as deletes, 1706740000 + (s_suppkey * 131) % 6000 as update_ts, case when s_suppkey % 7 = 0 then 0 else 1706738000 + (s_suppkey * 173) % 8000 end as synced_ts, 1706745600 - (s_suppkey * 7) % 120 as heartbeat from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "log": "select event_id as id, ts, user_id as file_id, event_type as operation, cast(floor(value * 100) as bigint) as bytes, value as response_ms, event_type = 'error' as is_error from events",
    "samples": "select event_id as id, ts, event_type as operation, value as latency_ms, event_type <> 'error' or event_id % 3 <> 0 as success from events",
    "changes": "select l_orderkey as filename, datediff('day', date '1990-01-01', cast(l_shipdate as date)) as ts, l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 as line_no, case l_returnflag when 'A' then 'C' when 'N' then 'c' else 'D' end as op, case when l_linenumber = 7 then l_orderkey - 1 end as src from lineitem",
    "blocks": "select distinct l_suppkey as path, l_linenumber as id, (l_partkey % 500) * 64 as \"offset\", 64 as size from lineitem",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    doc = _t(spark, d, "documents")
    group = F.concat(F.lit("group"), F.col("doc_id") % 4)
    return doc.select(F.col("doc_id").alias("file_id"), group.alias("group_name"), F.concat(group, F.lit("/M00/"), "lang", F.lit("/"), "doc_id", F.lit("."), "source").alias("path"),
                      (F.col("n_chars") * 997).alias("size"), (F.col("doc_id") * 37 + 1700000000).alias("create_ts"), "lang", F.col("source").alias("ext"), F.md5(F.col("text").cast("binary")).alias("signature"))


def servers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    joined = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.expr("s_nationkey = n_nationkey")).join(_t(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    return joined.select(
        k.alias("server_id"), F.col("r_name").alias("group_name"), F.col("n_name").alias("ip"), (k * 37 % 5000 + 10000).alias("total_mb"), F.floor(F.abs("s_acctbal")).alias("free_mb"),
        (k % 3 + 5).cast("int").alias("status"), (k % 3 == 2).alias("active"), (k % 5 != 0).alias("writable"), (k * 11).alias("uploads"), (k * 10).alias("ok_uploads"), (k * 3).alias("deletes"),
        (k * 131 % 6000 + 1706740000).alias("update_ts"), F.when(k % 7 == 0, 0).otherwise(k * 173 % 8000 + 1706738000).alias("synced_ts"), (F.lit(NOW) - k * 7 % 120).alias("heartbeat"),
    )


def log(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("file_id"), F.col("event_type").alias("operation"), F.floor(F.col("value") * 100).alias("bytes"),
                                         F.col("value").alias("response_ms"), (F.col("event_type") == "error").alias("is_error"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.col("event_type") != "error") | (F.col("event_id") % 3 != 0)
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("operation"), F.col("value").alias("latency_ms"), ok.alias("success"))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """The change log; the columns STORED tell where an entry is stored, since several may have one (ts, line_no)."""
    op = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "N", "c").otherwise("D")
    line = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("filename"), F.datediff(F.col("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("ts"), line.alias("line_no"), op.alias("op"),
                                           F.when(F.col("l_linenumber") == 7, F.col("l_orderkey") - 1).alias("src"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return listed_blocks(spark, d).distinct()


def listed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks, some of them listed several times."""
    return _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 500 * 64).alias("offset"), F.lit(64).cast("long").alias("size"))
