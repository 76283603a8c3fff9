"""Validation of server configurations: rules over (config, key, value, line) rows, each giving a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowlens.functions.scalars import chain

c = F.col
OK, WARNING, ERROR = "OK", "WARNING", "ERROR"
#: Numbers that stand where a configuration has none (fixed values).
DEFAULTS = {
    "max_connections": 256, "work_threads": 4, "accept_threads": 1, "buff_size": 64, "connect_timeout": 30, "network_timeout": 60, "store_lookup": 2, "download_server": 0, "slot_max_size": 16384,
    "disk_reader_threads": 1, "disk_writer_threads": 1, "store_path_count": 1, "sync_interval": 0, "fsync_after_written_bytes": 0, "subdir_count_per_path": 256,
}
TEXTS = ["base_path", "log_level", "reserved_storage_space", "use_trunk_file", "disk_rw_separated", "use_connection_pool"]


def _level(*cases: tuple[Column, str], otherwise: str | None = OK) -> Column:
    """The first case that holds; a null case doesn't."""
    return chain(*[(F.coalesce(k, F.lit(False)), v) for k, v in cases], otherwise=otherwise)


def _path(value: Column, state: Column) -> Column:
    """A path must be set, exist and be writable; state is a path's row, null if it doesn't exist."""
    return _level((value.isNull(), ERROR), (state.isNull(), ERROR), (~state, ERROR))


def common_rules(cpus: int) -> dict[str, Column]:
    work, most = c("work_threads"), c("max_connections")
    return {
        "base_path": _path(c("base_path"), c("base_writable")),
        "max_connections": _level((most < 1024, WARNING)),
        "work_threads": _level((work < cpus // 2, WARNING), (work > cpus * 2, WARNING)),
        "accept_threads": _level(((c("accept_threads") > 1) & (most < 10000), WARNING)),
        "buff_size": _level((c("buff_size") < 256, WARNING)),
        "log_level": _level((c("log_level") == "debug", WARNING), otherwise=None),
        "connect_timeout": _level((c("connect_timeout") > 30, WARNING), otherwise=None),
        "network_timeout": _level((c("network_timeout") > 120, WARNING), otherwise=None),
    }


def tracker_rules(cpus: int) -> dict[str, Column]:
    space = c("reserved_storage_space")
    percent = F.coalesce(F.regexp_extract(space, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    trunk = F.coalesce(c("use_trunk_file").isin("true", "1"), F.lit(False))
    return common_rules(cpus) | {
        "store_lookup": _level((c("store_lookup").isin(0, 2), OK), (c("store_lookup") == 1, WARNING), otherwise=None),
        "reserved_storage_space": _level((space.isNull(), WARNING), (space.contains("G"), OK), (space.contains("%") & (percent < 10), WARNING), otherwise=None),
        "use_trunk_file": _level((trunk, OK), otherwise=None),
        "slot_max_size": _level((trunk & (c("slot_max_size") < 1 << 20), OK), otherwise=None),
        "download_server": _level((c("download_server").isin(0, 1), OK), otherwise=None),
    }


def storage_rules(cpus: int) -> dict[str, Column]:
    return common_rules(cpus) | {
        "disk_rw_separated": _level((c("disk_rw_separated").isin("true", "1"), OK), otherwise=WARNING),
        "disk_reader_threads": _level((c("disk_reader_threads") < 2, WARNING)),
        "disk_writer_threads": _level((c("disk_writer_threads") < 1, ERROR)),
        "store_path_count": F.lit(OK),
        "sync_interval": _level((c("sync_interval") > 0, WARNING)),
        "fsync_after_written_bytes": _level((c("fsync_after_written_bytes") == 0, WARNING)),
        "use_connection_pool": _level((c("use_connection_pool").isNull() | c("use_connection_pool").isin("false", "0"), WARNING)),
        "tracker_server": _level((c("n_trackers") == 0, ERROR), (c("n_trackers") == 1, WARNING)),
        "subdir_count_per_path": _level((c("subdir_count_per_path") < 256, WARNING), otherwise=None),
    }


def validated(configs: DataFrame, paths: DataFrame, storage: bool, cpus: int) -> DataFrame:
    """config, rule and level of each rule that says something.

    configs: (config, key, value, line), the first of equal keys counts. paths: (path, writable) of the paths that exist.
    """
    first = lambda k: F.min_by("value", F.when(c("key") == k, c("line")))
    numbers = [F.coalesce(first(k).try_cast("int"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()]
    wide = configs.groupBy("config").agg(*numbers, *[first(k).alias(k) for k in TEXTS], F.count_if(c("key") == "tracker_server").alias("n_trackers"))
    base = paths.select(c("path").alias("base_path"), c("writable").alias("base_writable"))
    rules = (storage_rules if storage else tracker_rules)(cpus)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("level")) for k, v in rules.items()]))
    wide = wide.join(base, "base_path", "left")
    out = wide.select("config", rows.alias("x")).select("config", "x.rule", "x.level")
    if storage:
        wanted = wide.where("store_path_count > 0").select("config", F.explode(F.sequence(F.lit(0), c("store_path_count") - 1)).alias("i")).select("config", F.concat(F.lit("store_path"), "i").alias("key"))
        given = configs.groupBy("config", "key").agg(F.min_by("value", "line").alias("path"))
        stores = wanted.join(given, ["config", "key"], "left").join(paths, "path", "left")
        out = out.unionByName(stores.select("config", c("key").alias("rule"), _path(c("path"), c("writable")).alias("level")))
    return out.where("level is not null")
