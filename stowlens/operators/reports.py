"""Aggregates, joins, windows, top-k and set operations over storage telemetry.

Every function takes DataFrames with the column names it states and returns one; nothing is
collected, and a side is broadcast only by Spark's own size check.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowlens.functions.scalars import chain, ratio
from stowlens.operators import ordered
from stowlens.operators.classify import consistency

#: Size buckets, half-open (fixed values).
BUCKETS = [("0-1KB", 0), ("1KB-10KB", 1 << 10), ("10KB-100KB", 10 << 10), ("100KB-1MB", 100 << 10), ("1MB-10MB", 1 << 20), ("10MB-50MB", 10 << 20),
           ("50MB-100MB", 50 << 20), ("100MB-500MB", 100 << 20), ("500MB-1GB", 500 << 20), (">1GB", 1 << 30)]


def file_stats(files: DataFrame) -> DataFrame:
    """n_files, total, smallest, largest, whole average of `size`; oldest and newest `create_ts`."""
    s = F.col("size")
    return files.agg(F.count("*").alias("n_files"), F.sum(s).alias("total_size"), F.min(s).alias("min_size"), F.max(s).alias("max_size"), F.expr("sum(size) div count(*)").alias("avg_size"),
                     F.min("create_ts").alias("oldest"), F.max("create_ts").alias("newest"))


def by_key(files: DataFrame, key: str) -> DataFrame:
    return files.groupBy(key).agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def size_buckets(files: DataFrame) -> DataFrame:
    """bucket, n_files, total_size and per cent of files; empty buckets are left out."""
    name = chain(*[(F.col("size") >= lo, label) for label, lo in reversed(BUCKETS)])
    counted = files.where("size >= 0").groupBy(name.alias("bucket")).agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"))
    total = counted.agg(F.sum("n_files").alias("all_files"))
    return counted.crossJoin(total).select("bucket", "n_files", "total_size", F.round(F.col("n_files") * 100 / F.col("all_files"), 4).alias("pct"))


def duplicates(files: DataFrame, signature: str, min_size: int = 0) -> DataFrame:
    """Groups of equal signature and size: n_files, and bytes saved by keeping one."""
    grouped = files.where(F.col("size") >= min_size).groupBy(signature, "size").agg(F.count("*").alias("n_files"))
    return grouped.where("n_files > 1").withColumn("savings", F.col("size") * (F.col("n_files") - 1))


def duplicate_totals(files: DataFrame, signature: str) -> DataFrame:
    grouped = files.groupBy(signature, "size").agg(F.count("*").alias("n"))
    return grouped.agg(F.sum("n").alias("n_files"), F.sum(F.col("n") - 1).alias("n_duplicates"), F.sum(F.col("size") * (F.col("n") - 1)).alias("savings"),
                       F.round(ratio(F.sum(F.col("size") * (F.col("n") - 1)) * 100, F.sum(F.col("size") * F.col("n"))), 6).alias("rate_pct"))


def first_seen(files: DataFrame, signature: str, order: str) -> DataFrame:
    """Rows with is_duplicate: all but the first of equal signature and size."""
    w = Window.partitionBy(signature, "size").orderBy(order)
    return files.withColumn("is_duplicate", F.row_number().over(w) > 1)


def access_stats(log: DataFrame, operations: list[str]) -> DataFrame:
    """By file_id over (file_id, ts, operation, bytes, response_ms, is_error): counts, span, bytes and mean time."""
    per = [F.sum((F.col("operation") == o).cast("long")).alias(f"n_{o}") for o in operations]
    return log.groupBy("file_id").agg(F.count("*").alias("n_access"), *per, F.sum(F.col("is_error").cast("long")).alias("n_errors"), F.min("ts").alias("first_access"), F.max("ts").alias("last_access"),
                                      F.sum("bytes").alias("bytes"), F.round(F.avg("response_ms"), 6).alias("avg_ms"))


def histogram(log: DataFrame, part: str) -> DataFrame:
    """Accesses by hour of day or by weekday (Sunday is 0)."""
    key = F.hour("ts") if part == "hour" else F.dayofweek("ts") - 1
    return log.groupBy(key.cast("int").alias(part)).agg(F.count("*").alias("n_access"))


def log_totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n_entries"), F.sum(F.col("is_error").cast("long")).alias("n_errors"), F.countDistinct("file_id").alias("n_files"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def frequency(log: DataFrame) -> DataFrame:
    """Accesses a day of each file over its span, which counts as a tenth of a day at least."""
    per = log.groupBy("file_id").agg(F.count("*").alias("n_access"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = F.greatest((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 86_400_000_000, F.lit(0.1))
    return per.select("file_id", "n_access", (F.col("n_access") / days).alias("per_day"))


def anomalies(log: DataFrame, sigmas: float = 3.0, error_rate: float = 0.1) -> DataFrame:
    """file_id, kind and severity: accesses beyond mean + sigmas * stddev, and error rates above a bound; a file may have both."""
    per = log.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(F.col("is_error").cast("long")).alias("e"))
    limits = per.agg((F.avg("n") + sigmas * F.stddev_pop("n")).alias("bound"))
    found = per.crossJoin(limits).select("file_id", F.explode(F.array_compact(F.array(
        F.when(F.col("n") > F.col("bound"), F.struct(F.lit("high_access").alias("kind"), F.lit(0.7).alias("severity"))),
        F.when(F.col("e") / F.col("n") > error_rate, F.struct(F.lit("high_errors").alias("kind"), F.lit(0.8).alias("severity"))),
    ))).alias("x"))
    return found.select("file_id", "x.kind", "x.severity")


def index_percentiles(samples: DataFrame, value: str, ps: dict[str, float], by: list[str]) -> DataFrame:
    """The value at zero-based rank floor(n * p) of each sorted group."""
    return ordered.values_at_ranks(samples, value, by, {k: lambda n, p=p: F.least(F.floor(n * p), n - 1) for k, p in ps.items()})


def latency_stats(samples: DataFrame, by: list[str]) -> DataFrame:
    """Over latency_ms and success: counts, mean, min, max, population stddev, median of the middle pair, p90 to p99.9."""
    x = F.when(F.col("success"), F.col("latency_ms"))
    basic = samples.groupBy(*by).agg(F.count("*").alias("n"), F.count(x).alias("n_ok"), F.sum((~F.col("success")).cast("long")).alias("n_failed"), F.round(F.avg(x), 6).alias("mean_ms"), F.min(x).alias("min_ms"),
                                     F.max(x).alias("max_ms"), F.round(F.stddev_pop(x), 6).alias("stddev_ms"))
    at = {k: lambda n, p=p: F.least(F.floor(n * p), n - 1) for k, p in {"p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99, "p999_ms": 0.999}.items()}
    at |= {"low_": lambda n: F.floor((n - 1) / 2), "high_": lambda n: F.ceil((n - 1) / 2)}
    ranks = ordered.values_at_ranks(samples.where("success"), "latency_ms", by, at)
    median = F.round(F.col("low_") + (F.col("high_") - F.col("low_")) * 0.5, 6).alias("median_ms")
    return basic.join(ranks.select(*by, median, "p90_ms", "p95_ms", "p99_ms", "p999_ms"), by, "left")


def slope(history: DataFrame, day: str, used: str, by: list[str]) -> DataFrame:
    """Ordinary least squares growth of `used` a day; 0 below two points."""
    return history.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope(used, day), F.lit(0.0)).alias("per_day"))


def merged_blocks(blocks: DataFrame, key: list[str], whole: int = 0) -> DataFrame:
    """Free blocks (key, offset, size) merged where one ends where the next begins, a block listed twice counting once; a merged block that fills a whole file may be dropped.

    One sort serves all: of each merged block only its first and last part stay, and the first looks ahead to the last.
    """
    c, w = F.col, Window.partitionBy(*key).orderBy("offset", "size")
    again = (F.row_number().over(w) > 1) & F.lag("offset").over(w).eqNullSafe(c("offset")) & F.lag("size").over(w).eqNullSafe(c("size"))
    once = blocks.withColumn("again_", again).where("not again_").withColumn("end_", c("offset") + c("size"))
    parts = once.withColumns({"before_": F.lag("end_").over(w), "next_": F.lead("offset").over(w), "nth_": F.row_number().over(w)})
    joined = F.coalesce(c("before_") == c("offset"), F.lit(False))
    parts = parts.withColumns({"first_": ~joined, "last_": ~F.coalesce(c("end_") == c("next_"), F.lit(False)), "reach_": F.greatest("end_", F.when(joined, c("offset")))})
    ends = parts.where("first_ or last_").withColumns({"reach_": F.when(c("last_"), c("reach_")).otherwise(F.lead("reach_").over(w)), "upto_": F.when(c("last_"), c("nth_")).otherwise(F.lead("nth_").over(w))})
    out = ends.where("first_").select(*key, "offset", (c("reach_") - c("offset")).alias("size"), (c("upto_") - c("nth_") + 1).cast("long").alias("n_blocks"))
    return out.where(~((c("offset") == 0) & (c("size") == whole) & (c("n_blocks") > 1))) if whole else out


def overlapping_blocks(blocks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Blocks that begin before the furthest end of those sorted before them: one sort, no self-join."""
    w = Window.partitionBy(*key).orderBy("offset", *order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("covered_to", F.max(F.col("offset") + F.col("size")).over(w)).where("covered_to > offset")


def retained(snapshots: DataFrame, keep_count: int, keep_days: int, now: Column, by: list[str]) -> DataFrame:
    """Newest first, with `drop`: beyond keep_count, or older than keep_days."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id"))
    return snapshots.withColumn("rank", F.row_number().over(w)).withColumn("drop", (F.col("rank") > keep_count) | (F.datediff(now, F.col("ts")) > keep_days))


def config_diff(one: DataFrame, two: DataFrame, ignore_space: bool = False) -> DataFrame:
    """(key, value, line) of two files: key, both values and ADDED, REMOVED, MODIFIED or UNCHANGED; the first of equal keys counts."""
    def first(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("key").agg(F.min_by("value", "line").alias(name))

    plain = (lambda c: F.regexp_replace(c, r"\s", "")) if ignore_space else (lambda c: c)
    both = first(one, "old_value").withColumn("in_one", F.lit(True)).join(first(two, "new_value").withColumn("in_two", F.lit(True)), "key", "full")
    change = chain((F.col("in_one").isNull(), "ADDED"), (F.col("in_two").isNull(), "REMOVED"), (plain(F.col("old_value")) != plain(F.col("new_value")), "MODIFIED"), otherwise="UNCHANGED")
    return both.select("key", "old_value", "new_value", change.alias("change"))


def sync_delay(servers: DataFrame) -> DataFrame:
    """For each server how far its sync lags behind the latest update of its peers.

    The greatest value of the others is the group's greatest, or the second greatest for the server
    that has it, so a group is aggregated once and not joined with itself. -1 if it never synced.
    """
    tops = servers.groupBy("group_name").agg(F.max(F.struct("update_ts", "server_id")).alias("top"))
    rest = servers.join(tops, "group_name").where(F.col("server_id") != F.col("top.server_id")).groupBy("group_name").agg(F.max("update_ts").alias("second"))
    peers = servers.join(tops, "group_name").join(rest, "group_name", "left")
    latest = F.when(F.col("server_id") == F.col("top.server_id"), F.col("second")).otherwise(F.col("top.update_ts"))
    delay = chain((latest.isNull() | (latest == 0), 0), (F.col("synced_ts") == 0, -1), otherwise=F.greatest(latest - F.col("synced_ts"), F.lit(0)))
    return peers.select("group_name", "server_id", delay.cast("long").alias("delay"))


def min_free(servers: DataFrame) -> DataFrame:
    """Each group's writable server with the least free space; the lowest id of equal ones."""
    pick = F.min_by(F.struct("server_id", "free_mb", "total_mb"), F.struct("free_mb", "server_id"))
    return servers.where("writable").groupBy("group_name").agg(pick.alias("x")).select("group_name", "x.server_id", "x.free_mb", "x.total_mb")


def replicas_checked(replicas: DataFrame) -> DataFrame:
    """By file over (file_id, server_id, present, size, crc, create_ts): against the first present replica.

    One of the present replicas differs from the first if and only if they are not all the same, so one
    aggregation says all.
    """
    here = lambda name: F.when(F.col("present"), F.col(name))
    out = replicas.groupBy("file_id").agg(
        F.bool_or(~F.col("present")).alias("missing"), F.min(here("crc")).alias("crc_lo"), F.max(here("crc")).alias("crc_hi"), F.min(here("size")).alias("size_lo"), F.max(here("size")).alias("size_hi"),
        F.min(here("create_ts")).alias("ts_lo"), F.max(here("create_ts")).alias("ts_hi"), F.min_by("create_ts", here("server_id")).alias("ts"),
    )
    differs = lambda k: F.coalesce(F.col(f"{k}_lo") < F.col(f"{k}_hi"), F.lit(False))
    lag = F.greatest(F.col("ts_hi") - F.col("ts"), F.col("ts") - F.col("ts_lo"))
    return out.select("file_id", consistency(F.col("missing"), differs("crc"), differs("size")).alias("status"), F.when(F.col("ts_lo").isNotNull(), lag).alias("lag"))


def last_entries(log: DataFrame, key: list[str], stored: Sequence[str] = ()) -> DataFrame:
    """Each key's last entry by (ts, line_no); of equal ones the one that sorts first by the columns `stored`."""
    w = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("line_no"), *stored)
    return log.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def live_blocks(log: DataFrame, key: list[str], stored: Sequence[str] = ()) -> DataFrame:
    """Blocks whose last operation in the log (ts, line_no, op A or D) adds them; `stored` as for last_entries()."""
    return last_entries(log, key, stored).where("op = 'A'").select(*key, "size")


def live_files(log: DataFrame, stored: Sequence[str] = ()) -> DataFrame:
    """Files that a change log leaves: the last create or delete of each name decides, and a rename ends the old name's life.

    A source operation is in capitals, a replica's in small letters; both change the set of files alike. `stored`
    are columns that tell entries of one (ts, line_no) apart.
    """
    made = log.select("filename", "ts", "line_no", *stored, F.when(F.upper("op") == "D", "D").otherwise("C").alias("op"), F.lit(0).alias("renamed_"))
    gone = log.where((F.upper("op") == "R") & F.col("src").isNotNull()).select(F.col("src").alias("filename"), "ts", "line_no", *stored, F.lit("D").alias("op"), F.lit(1).alias("renamed_"))
    last = last_entries(made.unionByName(gone), ["filename"], ["renamed_", *stored])
    return last.where("op = 'C'").select("filename", F.col("ts").alias("last_ts"))


def replay_warnings(log: DataFrame, key: list[str], stored: Sequence[str] = ()) -> DataFrame:
    """Additions of a block that is there and deletions of one that isn't: an operation equal to the one before, or a first deletion.

    The replay ends with what last_entries() takes for the last, so of equal entries the one first by `stored` comes last.
    """
    w = Window.partitionBy(*key).orderBy("ts", "line_no", *map(F.desc, stored))
    before = F.lag("op").over(w)
    kind = chain(((F.col("op") == "A") & (before == "A"), "duplicate_add"), ((F.col("op") == "D") & (before.isNull() | (before == "D")), "missing_delete"))
    return log.withColumn("warning", kind).where("warning is not null")


def best_fit(blocks: DataFrame, size: int, align: int) -> DataFrame:
    """The smallest free block that holds an aligned size, and what is left of it."""
    need = -(-size // align) * align
    pick = blocks.where(F.col("size") >= need).orderBy("size", *[c for c in blocks.columns if c != "size"]).limit(1)
    return pick.withColumn("left_size", F.col("size") - need)


def leader(trackers: DataFrame) -> DataFrame:
    """The tracker that sorts last by leadership, running time, restart interval (descending), address."""
    return trackers.orderBy(F.desc("is_leader"), F.desc("running_time"), F.asc("restart_interval"), F.desc("ip"), F.desc("port")).limit(1)


def source_and_target(groups: DataFrame, min_free: int) -> DataFrame:
    """The group of the highest usage and the one of the lowest with enough free space; no row if they are the same."""
    source = groups.agg(F.max_by("group_name", F.struct("usage", "group_name")).alias("source_group"))
    target = groups.where(F.col("free") > min_free).agg(F.min_by("group_name", F.struct("usage", "group_name")).alias("target_group"))
    return source.crossJoin(target).where("source_group <> target_group")


def merged_tags(old: Column, new: Column) -> Column:
    return F.array_distinct(F.concat(old, new))


def merged_map(old: Column, new: Column) -> Column:
    """Both maps, the new one's values first."""
    return F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))


def suppressed(alerts: DataFrame, cooldown: int) -> DataFrame:
    """Alerts (message, ts) that are sent: the first, and each that comes a cooldown or more after the last one sent.

    Which alert is sent depends on the one sent before, so each message's alerts are read in time
    order, sorted within their partition; only the message and its last sent time are carried along.
    Repeated times count once, null times not at all.
    """
    ordered = alerts.where("ts is not null").select("message", F.col("ts").cast("bigint").alias("ts")).repartition("message").sortWithinPartitions("message", "ts")
    gap = max(cooldown, 1)  # equal times are one alert

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        message, due = None, None  # due: from when on the message is sent again; None before the first row
        for batch in batches:
            times = batch.column(1).to_numpy()
            runs = batch.column(0).dictionary_encode("encode")
            codes = runs.indices.to_numpy()
            bounds = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)] if len(codes) else []
            sent = []
            for a, b in itertools.pairwise(bounds):
                own = runs.dictionary[int(codes[a])].as_py()
                if due is None or own != message:
                    message, due = own, int(times[a])
                at = a + int(np.searchsorted(times[a:b], due))
                while at < b:
                    sent.append(at)
                    due = int(times[at]) + gap
                    at += int(np.searchsorted(times[at:b], due))
            yield batch.take(pa.array(sent, pa.int64()))

    return ordered.mapInArrow(fold, ordered.schema)


def rebuilt_log(old: DataFrame, appended: DataFrame, key: list[str]) -> DataFrame:
    """The first record (line_no) of each key of one log, then the records of another one, with their source."""
    first = old.groupBy(*key).agg(F.min("line_no").alias("line_no")).withColumn("source", F.lit("first"))
    return first.unionByName(appended.select(*key, "line_no", F.lit("appended").alias("source")))


def status_changes(log: DataFrame, key: list[str]) -> DataFrame:
    """Entries (ts, line_no, status) of a log that differ from the key's entry before, with that one's status."""
    before = F.lag("status").over(Window.partitionBy(*key).orderBy("ts", "line_no"))
    return log.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("status"))).select("ts", "line_no", *key, "before", "status")
