"""EM on synthetic votes with known accuracies, and a sample that partitions don't change."""

from collections import Counter

import numpy as np
import pytest

from stowlens.llm import quality_model as Q

BAD = np.array([0.5, 0.3, 0.3, 0.2, 0.1, 0.25, 0.05, 0.1, 0.15])
GOOD = np.array([0.002, 0.001, 0.004, 0.003, 0.001, 0.002, 0.001, 0.97, 0.95])


def drawn(n, share_bad, seed, abstain=0.0):
    rng = np.random.default_rng(seed)
    bad = rng.random(n) < share_bad
    votes = (rng.random((n, len(Q.LABELLERS))) < np.where(bad[:, None], BAD, GOOD)).astype(int)
    votes[rng.random(votes.shape) < abstain] = 2
    return bad, [int("".join(map(str, v)), 3) for v in votes]


@pytest.mark.parametrize(("share_bad", "abstain"), [(0.15, 0.0), (0.4, 0.0), (0.15, 0.3)])
def test_em_finds_the_accuracies_and_the_classes(share_bad, abstain):
    bad, codes = drawn(40_000, share_bad, 2, abstain)
    posteriors, rates = Q.em(Counter(codes))
    assert rates[0] == pytest.approx(BAD, abs=0.06) and rates[1] == pytest.approx(GOOD, abs=0.02)
    post = np.array([posteriors[c] for c in codes])
    assert abs((1 - post).mean() - share_bad) < 0.03
    digits = np.array([Q.votes_of(c) for c in codes])  # as right as one who knows the true rates
    logs = [((digits == 1) * np.log(r) + (digits == 0) * np.log(1 - r)).sum(axis=1) + np.log(s) for r, s in ((BAD, share_bad), (GOOD, 1 - share_bad))]
    assert ((post < 0.5) == bad).mean() >= ((logs[0] > logs[1]) == bad).mean() - 0.003


def test_posteriors_are_bayes_by_hand():
    _, codes = drawn(5000, 0.2, 3, 0.2)
    counts = Counter(codes)
    posteriors, rates = Q.em(counts, 200)  # converged: one more round changes nothing
    share = sum(posteriors[c] * n for c, n in counts.items()) / 5000
    for code in list(counts)[:50]:
        good, bad = share, 1 - share
        for v, g, b in zip(Q.votes_of(code), rates[1], rates[0], strict=True):
            if v < 2:
                good, bad = good * (g if v else 1 - g), bad * (b if v else 1 - b)
        assert posteriors[code] == pytest.approx(good / (good + bad), abs=1e-3)


def test_patterns_to_base_three():
    code = Q.pattern("One two three four five six seven eight. " * 9)
    assert Q.votes_of(code)[:4] == [0, 0, 0, 0] and Q.votes_of(code)[7] == 1
    assert set(Q.votes_of(Q.pattern(""))) == {2} and set(Q.votes_of(Q.pattern("two words"))) <= {0, 2}


def test_the_model_depends_on_rows_not_on_partitions(spark):
    rows = [(k % 700, ("CLICK HERE!! ### $$$ " if k % 5 == 0 else "a plain sentence of some words, number %d. " % k) * (3 + k % 7)) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (Q.fit(df.repartition(n), 300) for n in (1, 7))
    assert one["posteriors"] == two["posteriors"] and (one["w"] == two["w"]).all() and one["b"] == two["b"]
    out = {(r.doc_id, r.text): r.quality_kept for r in Q.classify(df, one).collect()}
    assert all(kept == (k % 5 != 0) for k, (row, kept) in enumerate((r, out[r]) for r in rows))


def test_one_id_on_most_rows_stays_within_the_bound(spark):
    df = spark.createDataFrame([(1, f"text {k}") for k in range(2000)], "doc_id long, text string")
    assert Q.fit(df, 50)["w"].shape == (Q.DIMENSIONS + 1,)
