"""The pipeline stage by stage against plain Python over the small documents."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from stowlens.llm import near_dup, quality_model, tokens  # noqa: E402
from stowlens.llm.common import table, written  # noqa: E402
from tests.llm.test_contracts import brute_components  # noqa: E402

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = written(table(spark, DIR, "documents"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, DIR))
        kept[name] = before, docs
        if name != "packing":
            assert docs.columns == columns

    def texts(df):
        return {r.doc_id: r.text or "" for r in df.collect()}

    before, after = map(texts, kept["quality"])
    model = quality_model.fit(kept["quality"][0].select("doc_id", "text"))
    assert set(after) == {k for k, t in before.items() if round(quality_model.score(t, model["w"], model["b"]), 6) >= quality_model.THRESHOLD}

    before, after = map(texts, kept["near_dedup"])
    assert set(after) == {k for k, (_, c) in brute_components(before, near_dup.SHINGLE, near_dup.PERCENT).items() if c == k}

    before, after = map(texts, kept["pii"])
    assert set(before) == set(after)

    before, after = kept["mixing"]
    assert {r.doc_id for r in after.collect()} <= set(texts(before))

    before, after = kept["packing"]
    vocabulary = tokens.encoder(tokens.vocabulary_file())
    want = Counter()
    for r in before.collect():
        want[r.doc_id] += len(vocabulary.encode([r.text or ""])[0]) // 2 + 1
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == want


def odd_rows():
    texts = [None, "", " \n ", "one", "Mr John Smith wrote to john@mail.com, +49 30 1234567. " * 3, "A plain sentence of some words, again and again. " * 9, "ünïcödé 漢字 \U0001f600 текст " * 5, "Long words of a long text go on. " * 30_000]
    out = [(k, t, None if k % 2 else "en", None if k % 3 else "web", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*out, out[4], out[5], (50, texts[5], "en", "web", 9), (5, "Quite another text under an id that is taken, with some words. " * 4, "de", "web", 1), (None, "no id at all but words enough for a set of them", None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("kind", ["plain", "clashing", "empty"])
def test_stages_on_odd_rows(spark, kind):
    """Nulls, empty and long texts, repeated rows and ids, columns named like results, no rows at all."""
    docs = spark.createDataFrame(odd_rows() if kind != "empty" else [], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if kind == "clashing":
        for name in ("kept", "rate", "p", "n_tokens", "quality_score", "n_replaced", "component_id", "dup_uid", "dup_row", "pii_uid", "mix_copy", "uid", "ord", "length"):
            docs = docs.withColumn(name, F.lit("own"))
    docs = written(docs)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, DIR))
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}
            continue
        gone = {"dup_uid", "dup_row", "pii_uid", "mix_copy", "kept", "rate", "p", "n_tokens", "quality_score", "n_replaced", "component_id"} & set(columns) - set(docs.columns)
        assert not gone, (name, gone)
        assert docs.columns == columns
        if name == "near_dedup" and kind != "empty":
            ids = Counter(r.doc_id for r in docs.collect())
            assert ids[5] == 1 and not ids[50] and ids[4] == 1 and ids[None] >= 1
        if kind == "empty":
            assert docs.count() == 0
