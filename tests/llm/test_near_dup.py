"""Near-duplicates with repeated ids, templates and stars, against brute force."""

import random
from collections import defaultdict

import pytest

from stowlens.llm import near_dup
from stowlens.llm.common import Scratch, written
from tests.llm.test_contracts import WORD

WORDS = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def prose(rng, n):
    return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def brute_rows(rows, size, percent):
    """Of each row its set's size and component, rows of an id with words being one document."""
    sets, at = defaultdict(list), {}
    for k, text in rows:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        s = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
        at[k, text] = s
        if s and k is not None:
            sets[k].append(s)
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return sorted((str(k), len(at[k, t]), top(k) if at[k, t] and k is not None else k) for k, t in rows)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    a, b, c = (prose(rng, 120) for _ in range(3))
    like = lambda w: " ".join(changed(rng, w, 1))
    out = [(1, like(a)), (5, like(a)), (5, like(b)), (7, like(b)), (7, like(b)), (9, like(c)), (9, None), (9, ""), (None, like(c)), (None, like(c)), (20, "one"), (21, "one"), (22, None), (22, None)]
    out += [out[0], out[5]]
    base = prose(rng, 200)
    for k in range(40):  # a chain of small changes
        base = changed(rng, base, 3)
        out.append((100 + k, " ".join(base)))
    template = prose(rng, 60)
    out += [(200 + k, " ".join(template + prose(rng, rng.randrange(2, 12)))) for k in range(40)]
    return out


@pytest.mark.parametrize("partitions", [1, 2, 3, 211])
def test_repeated_ids_give_one_answer(spark, rows, partitions):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    out = near_dup.near_duplicates(df, 3, 85).collect()
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in out)
    assert got == brute_rows(rows, 3, 85)
    assert {r.component_id for r in out if r.doc_id in (1, 5, 7) and r.n_shingles} == {1}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_one_row_of_each_group_stays(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), str(r.text)) for r in near_dup.one_of_each(df, 3, 85).collect())
    brute = brute_rows(rows, 3, 85)
    alone = [k for k, n, _ in brute if not n or k == "None"]
    assert sorted(k for k, _ in kept) == sorted([*alone, *map(str, {c for k, n, c in brute if n and k != "None"})])
    again = near_dup.one_of_each(df.repartition(7), 3, 85).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in again) == kept


def test_pages_of_one_template_make_few_pairs(spark):
    """Pages that share a template but are not similar: the pairs compared grow with the pages, not with their square."""
    counts = {}
    for pages in (300, 600):
        rng = random.Random(pages)
        template, work = prose(rng, 400), Scratch(spark)
        texts = [(k, " ".join(template + prose(rng, 75))) for k in range(pages)]
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
        signed = written(near_dup.signatures(df, 5))
        sets = near_dup.sets_of(df, 5, near_dup.np.full(64, -1, near_dup.np.int64)).withColumnRenamed("doc_id", "id")
        some = signed.selectExpr("doc_id as id", "doc_id as c")
        counts[pages] = near_dup.prefix_pairs(some, sets, 80, work).count()
        work.clear()
    assert counts[600] <= 2 * counts[300] + 100


def test_prefixes_lose_no_link(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        base = prose(rng, rng.randrange(6, 90))
        texts += [" ".join(changed(rng, base, rng.randrange(0, 1 + len(base) // 12))) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_dup.sets_of(df, 3, near_dup.np.full(64, -1, near_dup.np.int64)).withColumnRenamed("doc_id", "id")
    full = {r.id: set(r.shingles) for r in sets.collect()}
    work = Scratch(spark)
    pairs = near_dup.prefix_pairs(sets.selectExpr("id", "id as c"), sets, 80, work)
    found = {tuple(r) for r in near_dup.confirmed(pairs, sets, 80).collect()}
    work.clear()
    want = {(a, b) for a in full for b in full if a < b and 100 * len(full[a] & full[b]) >= 80 * len(full[a] | full[b])}
    assert found == want and len(want) > 10


def test_components_of_a_star_and_a_chain(spark):
    edges = [(1000, k) for k in range(400)] + [(k, k + 1) for k in range(2000, 2040)]
    work = Scratch(spark)
    out = {r.id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long"), work).collect()}
    work.clear()
    assert all(out[k] == 0 for k in [*range(1, 400), 1000]) and all(out[k] == 2000 for k in range(2001, 2041))
