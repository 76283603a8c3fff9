"""Streams: windowed counts with late records, the daily window, suppressed alerts, restarts from a checkpoint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stowlens.streaming import streams


def run(df, name, at, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(at)).start()
    q.processAllAvailable()
    return q


def test_windowed_counts_drop_what_is_too_late(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    base = 1_700_000_040  # on a minute
    (folder / "1").write_text("".join(f"{base + k} {'CD'[k // 10 % 2]} f{k}\n" for k in range(0, 120, 10)))
    q = run(streams.windowed_counts(streams.change_log_stream(spark, str(folder), 1)), "counts", tmp_path / "ck")
    for name, text in (("2", f"{base + 3600} C far\n"), ("3", f"{base + 1} C late\n{base + 3601} C far\n"), ("4", f"{base + 7200} C end\n")):
        (folder / name).write_text(text)
        q.processAllAvailable()
    q.stop()
    got = {(r.start.replace(tzinfo=dt.UTC).timestamp() - base, r.op): r.n for r in spark.table("counts").collect()}
    assert got[0, "C"] == got[0, "D"] == got[60, "C"] == got[60, "D"] == 3 and got[3600, "C"] == 2


@pytest.mark.parametrize(("start", "end", "want"), [("09:00", "17:00", [False, True, False]), ("22:00", "06:00", [True, False, True])])
def test_daily_window_may_pass_midnight(spark, start, end, want):
    df = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, h, 30)) for k, h in enumerate((3, 12, 23))], "k int, ts timestamp")
    assert [r.inside for r in df.select("k", streams.in_daily_window(F.col("ts"), start, end).alias("inside")).orderBy("k").collect()] == want


def test_suppressed_alerts_over_batches_and_a_restart(spark, tmp_path):
    folder, out = tmp_path / "in", []
    folder.mkdir()

    def alerts():
        lines = spark.readStream.option("maxFilesPerTrigger", 1).schema("message string, ts long").csv(str(folder))
        return streams.suppressed_stream(lines, 10)

    for k, rows in enumerate(["a,0\na,5\nb,3\n", "a,9\na,10\nb,14\n", "a,19\na,20\nb,15\n"]):
        (folder / str(k)).write_text(rows)
        if k == 0:
            q = run(alerts(), "alerts0", tmp_path / "ck")
        elif k == 1:
            q.processAllAvailable()
            q.stop()
            out += spark.table("alerts0").collect()
        else:
            q = alerts().writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
            q.processAllAvailable()
            q.stop()
    assert sorted((r.message, r.ts) for r in out) == [("a", 0), ("a", 10), ("a", 20), ("b", 3), ("b", 14)]
