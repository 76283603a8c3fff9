"""Ordered computations over few large groups, without one task for each group.

Rows are cut into slices of their order (hours, ranges of ids); windows run within slices, and what a slice
needs of those before it comes from a small table with one row a slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
RUNNING = (Window.unboundedPreceding, 0)


def running_sum(df: DataFrame, by: list[str], slices: Column, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with `name`, the sum of `value` over the rows of its group up to and including each; `slices` must not fall along the order."""
    cut = df.withColumn("slice_", slices)
    totals = cut.groupBy(*by, "slice_").agg(F.sum(value).alias("total_"))
    before = F.sum("total_").over(Window.partitionBy(*by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select(*by, "slice_", F.coalesce(before, F.lit(0)).alias("base_"))
    within = cut.withColumn("in_", F.sum(value).over(Window.partitionBy(*by, "slice_").orderBy(*order).rowsBetween(*RUNNING)))
    return within.join(base, [*by, "slice_"]).withColumn(name, c("base_") + c("in_")).drop("slice_", "in_", "base_")


def positions(df: DataFrame, order: list[str], slices: list[Column], name: str = "pos") -> DataFrame:
    """df with each row's position, from 1, in the order of all rows; `slices` are columns that order rows alike, more coarsely."""
    keys = [f"slice{i}_" for i in range(len(slices))]
    cut = df.withColumns(dict(zip(keys, slices, strict=True)))
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("n_"))
    base = sizes.withColumn("base_", F.coalesce(F.sum("n_").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    within = cut.withColumn("in_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return within.join(base, keys).withColumn(name, (c("base_") + c("in_")).cast("long")).drop(*keys, "in_", "base_")


def octave(value: Column, parts: int = 1024) -> Column:
    """A number that grows with the value, `parts` of them for each doubling: an order in few thousand steps."""
    return F.signum(value) * F.floor(F.log2(1 + F.abs(value)) * parts)


def values_at_ranks(samples: DataFrame, value: str, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Of each group the values at zero-based ranks, which are functions of the group's size n.

    Counts of the steps of octave() tell in which step each rank lies; only the distinct values of those steps are
    sorted, so no group is sorted as a whole.
    """
    some = samples.where(c(value).isNotNull()).select(*by, c(value).alias("v_"), octave(c(value)).alias("step_"))
    steps = some.groupBy(*by, "step_").agg(F.count("*").alias("n_"))
    group = Window.partitionBy(*by)
    steps = steps.withColumns({"all_": F.sum("n_").over(group), "before_": F.coalesce(F.sum("n_").over(group.orderBy("step_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(c("all_")).cast("long").alias("rank")) for k, f in ranks.items()]))
    wanted = steps.withColumn("a_", asked).where("a_.rank >= before_ and a_.rank < before_ + n_").select(*by, "step_", c("a_.name").alias("name_"), (c("a_.rank") - c("before_")).alias("rank_"))
    values = some.join(wanted.select(*by, "step_").distinct(), [*by, "step_"], "left_semi").groupBy(*by, "step_", "v_").agg(F.count("*").alias("n_"))
    values = values.withColumn("before_", F.coalesce(F.sum("n_").over(Window.partitionBy(*by, "step_").orderBy("v_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hits = values.join(wanted, [*by, "step_"]).where("rank_ >= before_ and rank_ < before_ + n_")
    return hits.groupBy(*by).agg(*[F.max(F.when(c("name_") == k, c("v_"))).alias(k) for k in ranks])


def moving_average(samples: DataFrame, by: list[str], slices: Column, last: int = 1000, block: int = 20_000) -> DataFrame:
    """Mean latency_ms of the last successful samples (success, ts, id), and failures in a row so far.

    Samples are numbered by the successes up to them; blocks of these numbers overlap by `last`, so that a
    mean is the difference of two running sums within its block.
    """
    ok = c("success").cast("int")
    cut = samples.withColumn("slice_", slices)
    order = Window.partitionBy(*by, "slice_").orderBy("ts", "id").rowsBetween(*RUNNING)
    rows = cut.withColumns({"ok_": F.sum(ok).over(order), "bad_": F.sum(1 - ok).over(order)})
    rows = rows.withColumn("bad_at_ok_", F.max(F.when(c("success"), c("bad_"))).over(order))
    # of each slice its successes, failures, and failures before its last success
    ends = rows.groupBy(*by, "slice_").agg(F.max("ok_").alias("oks_"), F.max("bad_").alias("bads_"), F.max("bad_at_ok_").alias("settled_"))
    past = Window.partitionBy(*by).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"ok_before_": F.coalesce(F.sum("oks_").over(past), F.lit(0)), "bad_before_": F.coalesce(F.sum("bads_").over(past), F.lit(0))})
    ends = ends.withColumn("settled_before_", F.coalesce(F.max(c("bad_before_") + c("settled_")).over(past), F.lit(0)))
    rows = rows.join(ends.select(*by, "slice_", "ok_before_", "bad_before_", "settled_before_"), [*by, "slice_"])
    settled = F.coalesce(c("bad_before_") + c("bad_at_ok_"), c("settled_before_"))
    rows = rows.withColumns({"no_": c("ok_before_") + c("ok_"), "failures_in_row": c("bad_before_") + c("bad_") - settled}).drop("slice_", "ok_", "bad_", "bad_at_ok_", "ok_before_", "bad_before_", "settled_before_")
    own = F.floor(c("no_") / block)
    near = F.when(c("success") & (c("no_") % block > block - last), F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("own_", own).withColumn("block_", F.explode(near))
    upto = Window.partitionBy(*by, "block_").orderBy("no_")
    x, now, then = F.when(c("success"), c("latency_ms")), upto.rangeBetween(*RUNNING), upto.rangeBetween(Window.unboundedPreceding, -last)
    gone = lambda s: F.coalesce(s.over(then), F.lit(0))
    n = F.count(x).over(now) - gone(F.count(x))
    rows = rows.withColumn("moving_ms", F.when(n > 0, (F.sum(x).over(now) - gone(F.sum(x))) / n))
    return rows.where("block_ = own_").drop("block_", "own_", "no_")


def rates(series: DataFrame, by: list[str], seconds: int) -> DataFrame:
    """Increase of a counter (counter, ts, id) a second in windows of `seconds`, a fall counting as a reset; a window's first step is from the last value before it."""
    cut = series.withColumn("window_start", F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    ends = cut.groupBy(*by, "window_start").agg(F.max_by("counter", F.struct("ts", "id")).alias("end_"))
    ends = ends.select(*by, "window_start", F.lag("end_").over(Window.partitionBy(*by).orderBy("window_start")).alias("end_"))
    inside = Window.partitionBy(*by, "window_start").orderBy("ts", "id")
    before = F.coalesce(F.lag("counter").over(inside), c("end_"))
    step = F.when(before.isNull(), 0).when(c("counter") >= before, c("counter") - before).otherwise(c("counter"))
    return cut.join(ends, [*by, "window_start"]).withColumn("step_", step).groupBy(*by, "window_start").agg((F.sum("step_") / seconds).alias("per_second"))
