"""Quality rules as a short-circuit cascade, in SQL expressions only.

Every rule is a condition under which a text fails; the base rule is one of them. On a sample drawn by a
hash each rule's cost (seconds a row) and selectivity (share of texts that it rejects) are measured; the cascade
then tries rules by rejections per second, highest first, and a text that one rule rejects meets no further rule.
A cost is the time of a job that evaluates the rule REPEATS times on every row of the sample, less that of a
job that does the same without a rule, so that a job's own time doesn't count. The verdict doesn't depend on the
order, only the work and `rejected_by` do.

Defined results: a null or empty text has no words, so it fails the base rule; repeated rows are
kept; further columns pass through untouched unless they bear the name of a result column, which
then gives way; an empty table gives an empty table.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]+"
#: Rows that costs and selectivities are measured on, at most, and how often each is evaluated.
SAMPLE_ROWS, REPEATS = 400, 100

_TEXT = "coalesce(text, '')"
_STRIPPED = r"btrim(coalesce(text, ''), ' \t\n\u000B\u000C\r')"
_WORDS = f"split({_STRIPPED}, '{SPACE}')"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Words covered by 3-word windows that occur twice or more: windows sorted by hash, those with an
#: equal neighbour kept, and of each kept window the words up to the next kept one counted.
_COVERED = _let(
    "array_sort(transform(h, (x, i) -> struct(x as h, i as p)))",
    "s",
    _let(
        "array_sort(transform(filter(transform(s, (e, i) -> if((i > 0 and get(s, i - 1).h = e.h) or get(s, i + 1).h <=> e.h, e.p, -1)), p -> p >= 0), p -> p))",
        "q",
        "aggregate(transform(q, (p, i) -> least(3, coalesce(get(q, i + 1) - p, 3))), 0L, (a, b) -> a + b)",
    ),
)
_REPEATED = _let(
    "transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))",
    "h",
    f"if(size(array_distinct(h)) = size(h), 0L, {_COVERED})",
)

#: The base features of a text, as SQL over a column `text`.
FEATURES: dict[str, str] = {
    "n_words": f"if({_STRIPPED} = '', 0L, cast(size({_WORDS}) as bigint))",
    "word_chars": r"cast(char_length(translate(coalesce(text, ''), ' \t\n\u000B\u000C\r', '')) as bigint)",
    "n_symbols": f"cast(char_length({_TEXT}) - char_length(translate({_TEXT}, '#*$%&|<>', '')) as bigint)",
    "n_dup_lines": _let(
        rf"filter(split({_TEXT}, '\n'), l -> length(btrim(l, ' \t\n\u000B\u000C\r')) > 0)", "l", "cast(size(l) - size(array_distinct(l)) as bigint)"
    ),
    "n_repeat_words": _let(_WORDS, "w", f"if(size(w) < 4, 0L, {_REPEATED})"),
}
BASE = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
#: What further rules reject, over `text` and the base features.
RULES: dict[str, str] = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
    "line_repeats": f"10 * n_dup_lines > 3 * size(split({_TEXT}, '\\n'))",
    "capitals": f"2 * regexp_count({_TEXT}, '[A-Z]') > word_chars",
    "shouting": f"10 * regexp_count({_TEXT}, '!!') > n_words",
    "no_sentence": f"n_words >= 100 and regexp_count({_TEXT}, '[.!?]') = 0",
}


def with_features(docs: DataFrame, names: dict[str, str] = FEATURES) -> DataFrame:
    clash = [c for c in docs.columns if c.lower() in names or c.lower() in ("base_failed", "kept")]
    return docs.drop(*clash).withColumns({k: F.expr(v) for k, v in names.items()})


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` texts with their features, of those with the least hashes of id and text."""
    n = docs.count()
    share = min(1.0, 2.0 * rows / max(1, n))
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h"))
    return with_features(hashed.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("h").limit(rows)).drop("h")


def measure(docs: DataFrame, rules: dict[str, str], rows: int = SAMPLE_ROWS, repeats: int = REPEATS) -> dict[str, tuple[float, float]]:
    """Each rule's (seconds a row, share rejected) on a sample."""
    sample = sampled(docs, rows).cache()
    n = max(1, sample.count())
    # one task's work, again and again; counting keeps the optimizer from testing each row once only
    again = sample.coalesce(1).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def timed(condition: str) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            hits = again.agg(F.count_if(F.expr(condition))).first()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits

    idle, _ = timed("again > 0")
    out = {}
    for name, rule in rules.items():
        took, hits = timed(f"again > 0 and ({rule})")
        out[name] = (max(1e-9, (took - idle) / (n * repeats)), hits / (n * repeats))
    sample.unpersist()
    return out


def ordered(costs: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejections per second, most first."""
    return sorted(costs, key=lambda k: (-costs[k][1] / costs[k][0], costs[k][0], k))


def cascade(rules: dict[str, str], order: list[str]) -> Column:
    """The first rule in the order that rejects a row, null if none does; later rules aren't computed."""
    first = F.when(F.expr(rules[order[0]]), F.lit(order[0]))
    for name in order[1:]:
        first = first.when(F.expr(rules[name]), F.lit(name))
    return first


def apply_rules(docs: DataFrame, rules: dict[str, str] = RULES, sample: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the base features, base_failed, rejected_by (null if kept) and kept."""
    rules = {"base": BASE, **rules}
    order = ordered(measure(docs.select("doc_id", "text"), rules, sample))
    out = with_features(docs).withColumn("base_failed", F.expr(BASE))
    return out.withColumn("rejected_by", cascade(rules, order)).withColumn("kept", F.col("rejected_by").isNull())
