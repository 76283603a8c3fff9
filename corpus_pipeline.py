"""A training corpus from `documents`: filter, dedup, hide personal data, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Further columns pass
through them whatever their names are. Null and empty texts stay in all stages: the quality classifier sees
no defect in them, they are nobody's copies, hold no entities, and are packed as one end id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowlens.llm import mixing, near_dup, packing, pii, quality_model, tokens
from stowlens.llm.common import table, written
from stowlens.llm.queries import PII_KEY, domains

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Toxic text's share of the tokens; the other domains keep their proportions.
WEIGHTS = {"toxic": 0.02}


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs, of which those that aren't of documents are renamed meanwhile."""
    names = [c if c in COLUMNS else f"further_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    model = quality_model.fit(docs.select("doc_id", "text"))
    return _apart(docs, lambda d: quality_model.classify(d, model).where("quality_kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return _apart(docs, near_dup.one_of_each)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    return _apart(docs, lambda d: pii.replace_entities(d, PII_KEY))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its rate says."""
    labels = domains(table(spark, sf_dir, "labels"))
    return _apart(docs, lambda d: mixing.copies(mixing.mix(d, labels, WEIGHTS)[0]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their places in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, tokens.vocabulary_file()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", private),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
