"""Structured Streaming over change logs and alerts; positions live in the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def change_log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """ts, op, filename, src of log files as they appear in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumn("p", F.split(F.rtrim("value"), " ", 4)).where(F.size("p") >= 3)
    return lines.select(F.timestamp_seconds(c("p")[0].try_cast("long")).alias("ts"), c("p")[1].alias("op"), c("p")[2].alias("filename"), F.get("p", F.lit(3)).alias("src"))


def without_repeats(stream: DataFrame, key: str = "filename", within: str = "3 seconds") -> DataFrame:
    """The first of equal keys within a time."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "op").agg(F.count("*").alias("n")).select(c("window.start").alias("start"), "op", "n")


def in_daily_window(ts, start: str, end: str):
    """Whether a time of day lies in a daily window, which may pass midnight."""
    now = F.date_format(ts, "HH:mm")
    return now.between(start, end) if start <= end else (now >= start) | (now <= end)


def suppressed_stream(alerts: DataFrame, cooldown: int) -> DataFrame:
    """Alerts (message, ts as epoch seconds) that are sent: each message's last sent time is the state."""

    def send(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        sent = []
        for t in sorted(t for f in frames for t in f["ts"].tolist()):
            if last is None or t - last >= cooldown:
                sent.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"message": [key[0]] * len(sent), "ts": sent})

    return alerts.groupBy("message").applyInPandasWithState(send, "message string, ts long", "last long", "append", GroupStateTimeout.NoTimeout)
