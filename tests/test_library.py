"""Functions, readers, writers and streams on small fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stowlens.functions import scalars as S
from stowlens.operators import classify as C
from stowlens.operators import predicates as P
from stowlens.operators import reports as R
from stowlens.sources import scans, sinks
from stowlens.streaming import streams


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").orderBy("i").select(column).collect()]


def test_sizes(spark):
    v = F.col("v")
    assert values(spark, ["10", "1.5K", "2 GB", "x", "3kb", "1T"], S.parse_size(v)) == [10, 1536, 2 << 30, None, 3072, 1 << 40]
    assert values(spark, ["512", "1536", "1073741824"], S.format_bytes(v.cast("long"))) == ["512 B", "1.50 KB", "1.00 GB"]


def test_names(spark):
    v = F.col("v")
    names = ["clip.webm", "a.b.log", "Makefile", "x.properties", ".env", "", "end.", "ноты.аудиофайл", "v1.2/readme"]
    assert values(spark, names, S.extension_short(v)) == ["webm", "log", "", "proper", "env", "", "", "аудиоф", "2/read"]
    assert values(spark, ["g/pic.PNG", "g.x/a", "g/.env", "g/end."], S.extension_of_name(v)) == ["png", "no_ext", "env", "no_ext"]
    assert values(spark, ["g/pic.PNG", "g.x/a"], S.extension_of_id(v)) == ["PNG", "x/a"]
    assert values(spark, ["abc.12345", "abc.123456", "none", "x."], S.extension_near_end(v)) == ["12345", None, None, ""]
    ids = ["g7/M01/0A/FF/clip.webm", "", "g7", "/M01/clip.webm", "g7/", "seventeen_letters/M01/a", "sixteen_letters_/M01/a"]
    assert [x is not None for x in values(spark, ids, S.split_id(v))] == [True, False, False, False, False, False, True]
    assert values(spark, ["ab1.txt", "b1.txt"], S.glob(v, "a?[0-9].t*")) == [True, False]


def test_metadata_keeps_the_last_of_equal_names(spark):
    packed = "codec\x02opus\x01rate\x0248000\x01codec\x02vorbis\x01\x02no name\x01lone"
    assert values(spark, [packed, ""], S.unpack_metadata(F.col("v"))) == [{"codec": "vorbis", "rate": "48000"}, {}]


def test_path_hash(spark):
    def pjw(text):
        h = 0
        for c in text:
            h = ((h << 4) + ord(c)) & 0xFFFFFFFF
            if h & 0xF0000000:
                h = (h ^ ((h & 0xF0000000) >> 24)) & 0x0FFFFFFF
        return h % 65536

    names = ["a", "abcdefghijkl", "M00/00/00/xyz.jpg"]
    assert [(r.high << 8) + r.low for r in values(spark, names, S.path_hash(F.col("v")))] == [pjw(n) for n in names]


def test_quota_order_of_rules(spark):
    rows = [(0, 0, 0), (10, 10, 100), (95, 0, 100), (81, 100, 200), (91, 100, 200), (5, 100, 200)]
    df = spark.createDataFrame(rows, "used long, hard long, total long")
    got = [r[0] for r in df.select(C.quota(F.col("used"), F.col("hard"), F.col("total"), F.lit(80), F.lit(90))).collect()]
    assert got == ["UNKNOWN", "EXCEEDED", "EXCEEDED", "WARNING", "CRITICAL", "OK"]


def test_no_criteria_match_nothing(spark):
    assert spark.range(3).where(P.combine([])).count() == 0


def test_scans(spark, tmp_path):
    (tmp_path / "list").write_text("#c\n\ng7/M01/a.webm\r\n")
    assert [r.file_id for r in scans.file_list(spark, str(tmp_path / "list")).collect()] == ["g7/M01/a.webm"]
    (tmp_path / "log").write_text("1700000000 C M00/a\nbad\n1700000001 L M00/b M00/a\n")
    assert [(r.op, r.src) for r in scans.change_log(spark, str(tmp_path / "log")).orderBy("line_no").collect()] == [("C", None), ("L", "M00/a")]
    (tmp_path / "space").write_text("1700000000 A 0 0 1 7 0 256\n1 A 2\n")
    assert scans.space_log(spark, str(tmp_path / "space")).count() == 1
    (tmp_path / "access").write_text("[2025-01-15 10:30:45] download group1/a.jpg 10.0.0.5 1024 12 200\nnoise\n[2025-01-16 10:30:45] upload g/b 1.1.1.1 1 1 500\n")
    log = scans.access_log(spark, str(tmp_path / "access"), operation="upload")
    assert [(r.ts, r.is_error) for r in log.collect()] == [(dt.datetime(2025, 1, 16, 10, 30, 45), True)]
    (tmp_path / "conf").write_text("# c\n[s]\nport = 23000\nname='x'\n")
    assert {(r.key, r.value) for r in scans.config_file(spark, str(tmp_path / "conf")).collect()} == {("port", "23000"), ("name", "x")}
    (tmp_path / "quota").write_text('GROUP group1 80GB 100GB 80 90 "main"\nGROUP g 1GB\nUSER u 1K 2K 95 90\n')
    assert [(r.identifier, r.hard, r.description) for r in scans.quota_rules(spark, str(tmp_path / "quota")).collect()] == [("group1", 100 << 30, "main")]
    (tmp_path / "server").write_text("10.0.0.5 download M00/a 0 12 120 4096\n")
    assert scans.server_log(spark, str(tmp_path / "server")).first().resp_len == 4096


def test_manifest_round_trip(spark, tmp_path):
    rows = [("group1/M00/00/00/a.jpg", 10, 0xABCD, 1700000000, False, "")]
    df = spark.createDataFrame(rows, "file_id string, size long, crc32 long, create_ts long, has_metadata boolean, metadata_file string")
    sinks.write_manifest(df, str(tmp_path / "m"))
    back = scans.manifest(spark, str(tmp_path / "m")).first()
    assert (back.file_id, back.size, back.crc32, back.has_metadata) == (rows[0][0], 10, 0xABCD, False)


def test_merged_block_that_fills_a_file_is_dropped(spark):
    df = spark.createDataFrame([(1, 0, 50), (1, 50, 50), (2, 0, 10), (2, 20, 10)], "id long, offset long, size long")
    assert {(r.id, r.offset, r.size) for r in R.merged_blocks(df, ["id"], whole=100).collect()} == {(2, 0, 10), (2, 20, 10)}


def test_rename_ends_the_old_name(spark):
    df = spark.createDataFrame([("a", 1, 1, "C", None), ("b", 2, 2, "R", "a"), ("c", 3, 3, "c", None), ("c", 4, 4, "d", None)], "filename string, ts long, line_no long, op string, src string")
    assert [r.filename for r in R.live_files(df).collect()] == ["b"]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1").write_text("1700000000 C a\n1700000001 C a\n1700000002 D b\n")
    out = streams.without_repeats(streams.change_log_stream(spark, str(folder)))
    q = out.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.filename for r in spark.table("firsts").collect()) == ["a", "b"]


def plain_merged(rows):
    """Runs of blocks where one ends where the one sorted before it began, as islands of a loop."""
    out = []
    for k in sorted({r[0] for r in rows}):
        end = None
        for _, at, size in sorted({r for r in rows if r[0] == k}):
            if at == end:
                out[-1][2], out[-1][3] = max(out[-1][2], at + size), out[-1][3] + 1
            else:
                out.append([k, at, at + size, 1])
            end = at + size
    return sorted((k, at, end - at, n) for k, at, end, n in out)


def test_merged_blocks_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(6), rng.randrange(60) * 8, rng.choice([0, 8, 8, 8, 16])) for _ in range(900)] + [(9, 64, 64), (8, 0, 0), (8, 0, 0), (10, 5, 1), (10, 6, 1), (10, 6, 1)]
    df = spark.createDataFrame(rows, "id long, offset long, size long")
    out = R.merged_blocks(df, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "HashAggregate" not in plan
    assert sorted(map(tuple, out.collect())) == plain_merged(rows)
    assert out.schema["n_blocks"].dataType.simpleString() == "bigint"
