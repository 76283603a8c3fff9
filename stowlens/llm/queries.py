"""Queries over the ten operators of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowlens.llm import audio, html_text, mixing, near_dup, packing, pii, quality_model, quality_rules, tokens, toxicity, wavelet
from stowlens.llm.common import table

#: The key that surrogates are drawn with; a deployment gives its own.
PII_KEY = b"stowlens surrogates"
#: Shares of tokens that the mix is fitted to (other domains keep their proportions), and its size against the input.
MIX_WEIGHTS, MIX_GROWTH = {"low": 0.05, "toxic": 0.03}, 1.0


def domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled rows: toxic before low quality before clean; rows without any label are left out."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") > 0, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(audio.store(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(docs, quality_model.fit(docs)).select("doc_id", "weak_label", "quality_score", F.col("quality_kept").alias("kept"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit_table(pages))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = toxicity.classify(docs, toxicity.fit(docs, labels.where("doc_id is not null").where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "clause_weight")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *quality_rules.FEATURES, "base_failed", "kept")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mixed, model = mixing.mix(docs.select("doc_id", "text"), domains(labels), MIX_WEIGHTS, MIX_GROWTH, ["doc_id"])
    return mixed.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model["domains"])], "rate")


def op9_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_and_read(table(spark, sf_dir, "documents"), tokens.vocabulary_file())


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokens.vocabulary_file()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio_features": op1_audio_features,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_html_extraction": op4_html_extraction,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mixing": op8_source_mixing,
    "op9_wavelet_output": op9_wavelet_output,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: The features of every text counted from its words and lines, and the verdict of all rules (which no order changes).
_OP7_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
each_word as (select r, unnest(w) as word, unnest(range(len(w))) as i from words),
windows as (select r, i, word as a, lead(word, 1) over t as b, lead(word, 2) over t as c from each_word window t as (partition by r order by i)),
repeated as (select r, i from windows where c is not null qualify count(*) over (partition by r, a, b, c) > 1),
covered as (select r, count(distinct i + k) as n from repeated cross join (values (0), (1), (2)) v(k) group by r),
each_line as (select r, unnest(string_split(text, chr(10))) as line from docs),
lines as (select r, count(*) - count(distinct line) as dups from each_line where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
features as (
  select doc_id, text, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(dups, 0) as bigint) as n_dup_lines,
    cast(coalesce(n, 0) as bigint) as n_repeat_words
  from words left join lines using (r) left join covered using (r)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from features)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 12 * n_words
    or 10 * n_dup_lines > 3 * len(string_split(text, chr(10))) or 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars
    or 10 * len(regexp_extract_all(text, '!!')) > n_words or n_words >= 100 and len(regexp_extract_all(text, '[.!?]')) = 0) as kept
from judged
"""

ORACLES: dict[str, str] = {"op7_quality_rules": _OP7_SQL}
