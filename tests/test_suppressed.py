"""Suppressed alerts against plain Python."""

import random

from stowlens.operators import reports as R


def brute_suppressed(rows, cooldown):
    last, sent = {}, []
    for m, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (str(r[0]), r[1])):
        if m not in last or t - last[m] >= cooldown:
            last[m] = t
            sent.append((m, t))
    return sorted(sent, key=str)


def test_suppressed_alerts_are_not_gathered_into_one_row(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "", None]), rng.randrange(-500, 3000)) for _ in range(4000)] + [("hot", t) for t in range(40_000)] + [("a", None), ("one", 7), ("one", 7)]
    df = spark.createDataFrame(rows, "message string, ts long")
    for cooldown in (0, 1, 10, 700):
        out = R.suppressed(df, cooldown)
        assert sorted(map(tuple, out.collect()), key=str) == brute_suppressed(rows, cooldown)
    assert "collect_set" not in out._jdf.queryExecution().toString()
