"""Computations in slices against plain loops, and the swap of a compacted table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stowlens.operators import config_rules, ordered
from stowlens.sources import versions

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(k, rng.choice("ab"), START + dt.timedelta(minutes=rng.randrange(3000)), rng.choice([1.0, 2.5, 7.25, rng.random() * 1e4, -3.0]), rng.random() < 0.7) for k in range(800)]
    return [*out, *((800 + k, "c", START + dt.timedelta(hours=k), 1.0, False) for k in range(5))]


@pytest.fixture(scope="module")
def samples(spark, rows):
    return spark.createDataFrame(rows, "id long, operation string, ts timestamp, latency_ms double, success boolean")


def grouped(rows):
    for g in "abc":
        yield g, sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize(("last", "block"), [(5, 7), (5, 1000), (50, 60)])
def test_moving_average(rows, samples, last, block):
    got = {r.id: (r.moving_ms, r.failures_in_row) for r in ordered.moving_average(samples, ["operation"], F.date_trunc("hour", "ts"), last, block).collect()}
    assert len(got) == len(rows)
    for _, own in grouped(rows):
        good, bad = [], 0
        for k, _, _, x, success in own:
            if success:
                good.append(x)
            bad = 0 if success else bad + 1
            want = sum(good[-last:]) / len(good[-last:]) if good else None
            assert got[k] == ((pytest.approx(want), bad) if good else (None, bad))


def test_running_sum_and_positions(rows, samples):
    got = {r.id: r.total for r in ordered.running_sum(samples, ["operation"], F.date_trunc("hour", "ts"), ["ts", "id"], F.col("id"), "total").collect()}
    for _, own in grouped(rows):
        total = 0
        for r in own:
            total += r[0]
            assert got[r[0]] == total
    place = {r.id: r.pos for r in ordered.positions(samples.select("operation", "id"), ["id"], [F.col("operation"), F.floor(F.col("id") / 50)]).collect()}
    assert place == {k: i + 1 for i, (_, k) in enumerate(sorted((r[1], r[0]) for r in rows))}


@pytest.mark.parametrize("value", ["latency_ms", "same"])
def test_values_at_ranks(rows, samples, value):
    asked = {"first": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "last": lambda n: n - 1}
    got = {r.operation: (r.first, r.middle, r.last) for r in ordered.values_at_ranks(samples.withColumn("same", F.lit(4.0)), value, ["operation"], asked).collect()}
    for g, own in grouped(rows):
        v = sorted(r[3] if value == "latency_ms" else 4.0 for r in own)
        assert got[g] == (v[0], v[len(v) // 2], v[-1])


def test_rates_take_the_last_value_of_the_window_before(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [(1, "a", at(1), 10), (2, "a", at(2), 30), (3, "a", at(25), 35), (4, "a", at(26), 5), (5, "a", at(100), 6), (6, "b", at(1), 1)]
    df = spark.createDataFrame(rows, "id long, operation string, ts timestamp, counter long")
    got = {(r.operation, r.window_start % 86400, r.per_second * 86400) for r in ordered.rates(df, ["operation"], 86400).collect()}
    assert got == {("a", 0, 20.0), ("a", 0, 10.0), ("a", 0, 1.0), ("b", 0, 0.0)}


def test_a_compaction_that_fails_leaves_the_table(spark, tmp_path):
    at = str(tmp_path / "log")
    versions.create(spark.range(10), at)
    with pytest.raises(Exception, match="no_such_column"):
        versions.compact(spark, at, lambda df: df.select("no_such_column"))
    assert versions.current(spark, at).count() == 10
    (tmp_path / "log" / "live").rename(tmp_path / "log" / "rollback")  # cut short between the two renames
    assert versions.current(spark, at).count() == 10
    versions.compact(spark, at, lambda df: df.where("id < 3"))
    assert versions.current(spark, at).count() == 3 and not (tmp_path / "log" / "rollback").exists()


def test_config_rules_on_little(spark):
    rows = [("t", "base_path", "/d", 1), ("t", "base_path", "/other", 2), ("t", "work_threads", "many", 3), ("e", "x", None, 1)]
    df = spark.createDataFrame(rows, "config string, key string, value string, line int")
    paths = spark.createDataFrame([("/d", True)], "path string, writable boolean")
    got = {(r.config, r.rule): r.level for r in config_rules.validated(df, paths, True, 8).collect()}
    assert got["t", "base_path"] == "OK" and got["e", "base_path"] == "ERROR" and got["t", "work_threads"] == "OK" and got["t", "store_path0"] == "ERROR" and got["t", "tracker_server"] == "ERROR"
    assert ("t", "log_level") not in got
    assert config_rules.validated(df.limit(0), paths, False, 8).count() == 0
