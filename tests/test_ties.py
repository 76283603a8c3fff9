"""Entries of one time and line number: the one stored first is the last to happen."""

import random

import duckdb
import pytest

from stowlens.operators import reports as R
from stowlens.plans import catalog

#: l_orderkey, l_linenumber, l_partkey, l_returnflag (A, N: made, R: deleted) in stored order; one day, so equal first three tie.
ROWS = [(1, 1, 10, "R"), (2, 1, 10, "A"), (3, 1, 10, "A"), (3, 2, 10, "R"), (2, 1, 10, "R"), (4, 1, 10, "N"), (3, 2, 10, "N"), (1, 1, 10, "A"), (4, 1, 10, "R"), (5, 1, 10, "N"), (5, 1, 20, "A")]


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """A folder with lineitem: ROWS, then other orders in pairs of equal entries far apart."""
    rng = random.Random(3)
    more = [(100 + k // 2 % 3000, k % 2 + 1, 10) for k in range(6000)]
    rows = ROWS + [(*r, rng.choice("ANR")) for r in more] + [(*r, rng.choice("ANR")) for r in more]
    folder = tmp_path_factory.mktemp("tied")
    values = ", ".join(f"({a}, {b}, {p}, '{f}')" for a, b, p, f in rows)
    table = "select a::bigint as l_orderkey, p::bigint as l_partkey, b::int as l_linenumber, f as l_returnflag, timestamp '1995-05-05' as l_shipdate"
    duckdb.sql(f"copy ({table} from (values {values}) t(a, b, p, f)) to '{folder}/lineitem.parquet'")
    return str(folder), rows


def from_sql(name, folder):
    con = duckdb.connect()
    con.sql("set threads = 1")
    con.sql(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    want = con.sql(catalog.ORACLES[name])
    return want.columns, sorted(want.fetchall())


def from_spark(spark, name, folder, columns):
    return sorted(map(tuple, catalog.QUERIES[name](spark, folder).select(*columns).collect()))


@pytest.mark.parametrize("name", ["L3_live_files", "L3_live_files_renamed"])
def test_the_first_stored_of_equal_changes_decides(spark, tied, name):
    folder, _ = tied
    columns, want = from_sql(name, folder)
    assert from_spark(spark, name, folder, columns) == want


def plain_replay(rows):
    """(warnings, live) of ROWS-like entries by key l_orderkey % 500, all of one day."""
    warnings, state = [], {}
    for (order, n, part, flag), _ in sorted(zip(rows, range(len(rows), 0, -1), strict=True), key=lambda r: (r[0][0] * 100 + r[0][1] * 10 + r[0][2] % 10, r[1])):
        key, line, op = order % 500, order * 100 + n * 10 + part % 10, "D" if flag == "R" else "A"
        if op == state.get(key, "D"):
            warnings.append((key, line, "duplicate_add" if op == "A" else "missing_delete"))
        state[key] = op
    return sorted(warnings), {k for k, op in state.items() if op == "A"}


def test_replay_warnings_follow_one_order(spark, tied):
    folder, rows = tied
    assert from_spark(spark, "L1_replay_warnings", folder, ["id", "line_no", "warning"]) == plain_replay(rows)[0]


def test_the_replay_ends_with_the_live_blocks(spark, tied):
    _, rows = tied
    log = [(r[0] % 500, 1, r[0] * 100 + r[1] * 10 + r[2] % 10, "D" if r[3] == "R" else "A", 1, k) for k, r in enumerate(rows)]
    df = spark.createDataFrame(log, "id long, ts long, line_no long, op string, size long, row long").repartition(7)
    assert {r.id for r in R.live_blocks(df, ["id"], ["row"]).collect()} == plain_replay(rows)[1]
    assert sorted(map(tuple, R.replay_warnings(df, ["id"], ["row"]).select("id", "line_no", "warning").collect())) == plain_replay(rows)[0]
