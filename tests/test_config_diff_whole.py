"""The configuration diff over whole tables."""

from stowlens.plans import catalog

SMALL, LARGER = (f"/root/testdata/sf{k}" for k in ("0.001", "0.01"))


def test_config_diff_grows_with_the_table(spark):
    counts = [{r.change: r.n for r in catalog.QUERIES["A22_diff_counts_whole"](spark, d).collect()} for d in (SMALL, LARGER)]
    for c in counts:
        assert set(c) == {"ADDED", "REMOVED", "MODIFIED", "UNCHANGED"}
    assert all(counts[1][k] > 3 * counts[0][k] for k in counts[0])
    one_sided = catalog.QUERIES["U8_one_sided_keys_whole"](spark, LARGER).count()
    assert one_sided == counts[1]["ADDED"] + counts[1]["REMOVED"]
    assert catalog.QUERIES["J3_config_diff_whole"](spark, LARGER).count() == one_sided + counts[1]["MODIFIED"]
