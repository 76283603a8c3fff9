"""Mixing sources to target weights by soft membership, in DataFrame and SQL expressions only.

A labelled table (doc_id, domain) fits a naive Bayes classifier on binned features of the text; it
gives every document its posterior of each domain. With p the posterior, n the tokens and r the
rate of a document, the expected tokens of domain d are sum(n p_d r). Projected gradient descent on least
squares finds rates whose expected totals meet the targets. Its gradient steps add up in y = 1 + p . v, where
each step adds to v the residual target - total, scaled by the inverse of sum(n p p^T) over documents within
bounds (shortened where the dual objective would fall); rates are y's projection on [FLOOR, CEILING]. So
descent ends at the rates nearest to 1 (in squares weighed by tokens) that meet the targets: nothing is
changed more than needed, and no document's rate is 0. Rates depend on a document only through p, so totals
are one distributed aggregation over the distinct posteriors, which the bins bound.

Targets that no rates within the bounds meet are approached from the totals that the corpus has, as many
quarters of the way as the bounds allow; `reached` says how far, and with 0 all rates stay 1.

Defined results: a null or empty text has no tokens and the features of an empty text; its rate
counts for nothing. Repeated rows count each. Of several labels of a document the least domain is
taken; without labels there is one domain for all. Further columns pass through unless they bear a
result's name. On an empty table no step is taken and no row returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowlens.llm.common import written

STEPS, TOLERANCE = 15, 1e-5
#: Bounds of rates.
FLOOR, CEILING = 0.05, 8.0
#: Shares of the way to the targets that are tried.
WAYS = (1.0, 0.75, 0.5, 0.25)
#: Labelled rows that the word list is drawn from, at most; words in it.
LEXICON_ROWS, LEXICON = 6000, 80

_TEXT = "coalesce(text, '')"
#: Binned features over (text, w), w being the text's lower-case words; bins count from 0 (fixed rule: the bounds below).
BINS: dict[str, tuple[str, list[float]]] = {
    "f_symbols": (f"(char_length({_TEXT}) - char_length(translate({_TEXT}, '#*$%&|<>', ''))) / greatest(1, n_tokens)", [0.01, 0.1, 0.5]),
    "f_shouts": (f"regexp_count({_TEXT}, '!') / greatest(1, n_tokens)", [0.01, 0.1, 0.5]),
    "f_capitals": (f"(octet_length({_TEXT}) - octet_length(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) / greatest(1, octet_length({_TEXT}))", [0.02, 0.2]),
    "f_length": ("n_tokens", [30, 200, 1000]),
    "f_variety": ("size(array_distinct(w)) / greatest(1, n_tokens)", [0.2, 0.5, 0.8]),
    "f_words": ("size(array_intersect(w, lexicon))", [1, 2, 4]),
}


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_of(text: str = _TEXT) -> str:
    """Lower-case words with the marks at their ends taken off."""
    return rf"split(btrim(lower({text}), ' \t\n\u000B\u000C\r.,!?#*$%&|<>'), '[\\x20\\x09-\\x0D.,!?#*$%&|<>]+')"


def _bin(value: str, bounds: list[float]) -> str:
    return _let(value, "v", " + ".join(f"int(v >= {b})" for b in bounds))


def featured(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """docs with n_tokens and one small int for each feature, from one reading of the text."""
    words = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in lexicon)
    fields = ", ".join(f"'{k}', {_bin(v.replace('n_tokens', 'size(w)').replace('lexicon', f'array({words})' if words else 'cast(array() as array<string>)'), b)}" for k, (v, b) in BINS.items())
    made = _let(words_of(), "w", f"named_struct('n_tokens', if(element_at(w, 1) = '', 0L, cast(size(w) as bigint)), {fields})")
    drop = [c for c in docs.columns if c in BINS or c == "n_tokens" or c == "mix_features"]
    return docs.drop(*drop).withColumn("mix_features", F.expr(made))


def word_list(docs: DataFrame, labels: DataFrame, rows: int = LEXICON_ROWS, size: int = LEXICON) -> list[str]:
    """Words that tell domains apart, by the largest log-odds of their document counts, from at most `rows` labelled documents."""
    some = labels.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    named = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    words = named.select("doc_id", "domain", F.explode(F.array_distinct(F.expr(words_of()))).alias("word")).where("word <> ''")
    per = words.groupBy("word", "domain").count()
    totals = some.groupBy("domain").agg(F.count("*").alias("docs"))
    all_docs = some.count()
    per = per.join(F.broadcast(totals), "domain").withColumn("all", F.sum("count").over(_by("word")))
    odds = F.log((F.col("count") + 0.5) / (F.col("docs") + 1)) - F.log((F.col("all") - F.col("count") + 0.5) / (F.lit(all_docs) - F.col("docs") + 1))
    rest = F.lit(all_docs) - F.col("docs") > 0
    best = per.where((F.col("count") >= 4) & rest).withColumn("odds", odds).where("odds >= 2").groupBy("word").agg(F.max(F.col("odds") * F.sqrt("count")).alias("weight"))
    return [r.word for r in best.orderBy(F.desc("weight"), "word").limit(size).collect()]


def _by(name: str):
    from pyspark.sql import Window

    return Window.partitionBy(name)


def fit_classifier(features: DataFrame, labels: DataFrame) -> dict:
    """Naive Bayes: domains, log priors and log rates of every bin, counted over all labelled rows."""
    one = labels.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = features.select("doc_id", "mix_features.*").join(one, "doc_id")
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("bin")) for k in BINS]))
    counts = known.select("domain", long.alias("x")).groupBy("domain", "x.feature", "x.bin").count().collect()
    domains = sorted({r.domain for r in counts}) or ["all"]
    total = {d: sum(r["count"] for r in counts if r.domain == d and r.feature == next(iter(BINS))) for d in domains}
    seen = {(r.domain, r.feature, r.bin): r["count"] for r in counts}
    n = sum(total.values())
    rates = {
        k: [[math.log((seen.get((d, k, b), 0) + 0.5) / (total[d] + 0.5 * (len(bounds) + 1))) for b in range(len(bounds) + 1)] for d in domains]
        for k, (_, bounds) in BINS.items()
    }
    return {"domains": domains, "priors": [math.log((total[d] + 1) / (n + len(domains))) for d in domains], "rates": rates}


def posteriors(model: dict) -> Column:
    """The posterior of each domain as an array, over mix_features."""
    logs = []
    for i in range(len(model["domains"])):
        terms = [f"element_at(array({', '.join(f'{x!r}D' for x in model['rates'][k][i])}), mix_features.{k} + 1)" for k in BINS]
        logs.append(" + ".join([f"{model['priors'][i]!r}D", *terms]))
    odds = _let(f"array({', '.join(logs)})", "l", "transform(l, x -> exp(x - array_max(l)))")
    return F.expr(_let(odds, "e", "transform(e, x -> round(x / aggregate(e, 0D, (a, b) -> a + b), 9))"))


def _y(v: list[float]) -> str:
    """1 + p . v as SQL."""
    return " + ".join(["1D", *(f"{x!r}D * p[{i}]" for i, x in enumerate(v))])


def rate(v: list[float]) -> Column:
    """r of a document with posteriors p."""
    return F.expr(f"least({CEILING!r}D, greatest({FLOOR!r}D, {_y(v)}))")


def _solve(m: list[list[float]], v: list[float]) -> list[float]:
    """M^-1 v by elimination, a hair added to the diagonal."""
    k = len(v)
    top = max((m[i][i] for i in range(k)), default=0.0) or 1.0
    a = [[*row, x] for row, x in zip(m, v, strict=True)]
    for i in range(k):
        a[i][i] += 1e-12 * top
    for i in range(k):
        at = max(range(i, k), key=lambda j: abs(a[j][i]))
        a[i], a[at] = a[at], a[i]
        for j in range(k):
            if j != i and a[i][i]:
                f = a[j][i] / a[i][i]
                a[j] = [x - f * y for x, y in zip(a[j], a[i], strict=True)]
    return [a[i][k] / a[i][i] if a[i][i] else 0.0 for i in range(k)]


def fit_rates(scored: DataFrame, domains: list[str], weights: dict[str, float], growth: float = 1.0, steps: int = STEPS, tolerance: float = TOLERANCE) -> dict:
    """v of rate(), whose totals are weights[d] * growth * (all tokens) for each domain, or `reached` of the way there from what the corpus has.

    scored has p and n_tokens. Weights are scaled to sum to one; a domain without a weight keeps its share.
    targets are the totals that were aimed at in the end, wanted those that the weights ask for.
    """
    k = len(domains)
    cells = written(scored.groupBy("p").agg(F.sum("n_tokens").alias("n")).where("n > 0"))

    def at(v: list[float]) -> dict:
        """All tokens, the totals, sum(n p p^T) over rates within bounds, and the dual's part that has no target."""
        r = rate(v)
        spot = cells.withColumns({"r": r, "z": F.expr(_y(v)) - 1}).withColumn("free", F.expr(f"if(z + 1 > {FLOOR!r}D and z + 1 < {CEILING!r}D, n, 0)"))
        sums = [F.sum(F.col("n") * F.col("r") * F.col("p")[i]).alias(f"t{i}") for i in range(k)]
        sums += [F.sum(F.col("free") * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]
        row = spot.agg(F.sum("n").alias("n"), F.sum(F.expr("n * (r * z - (r - 1) * (r - 1) / 2)")).alias("dual"), *sums).first()
        if not row.n:
            return {"n": 0}
        return {"n": row.n, "dual": row.dual, "totals": [row[f"t{i}"] for i in range(k)], "m": [[row[f"m{i}_{j}"] for j in range(k)] for i in range(k)]}

    begin = at([0.0] * k)
    n = begin["n"]
    if not n:
        return {"v": [0.0] * k, "wanted": [0.0] * k, "targets": [0.0] * k, "totals": [0.0] * k, "reached": 1.0, "steps": 0}
    have = begin["totals"]
    share = [weights.get(d, have[i] / n) for i, d in enumerate(domains)]
    wanted = [growth * n * s / sum(share) for s in share]
    taken = 0
    for way in WAYS:
        targets = [a + way * (b - a) for a, b in zip(have, wanted, strict=True)]
        value = lambda v, spot: sum(x * y for x, y in zip(v, targets, strict=True)) - spot["dual"]  # noqa: B023, E731
        v, spot = [0.0] * k, begin
        for _ in range(steps):
            gap = [a - b for a, b in zip(targets, spot["totals"], strict=True)]
            if max(map(abs, gap)) <= tolerance * n:
                return {"v": v, "wanted": wanted, "targets": targets, "totals": spot["totals"], "reached": way, "steps": taken}
            step, length = _solve(spot["m"], gap), 1.0
            while length > 1e-3:
                ahead = [a + length * b for a, b in zip(v, step, strict=True)]
                there, taken = at(ahead), taken + 1
                if value(ahead, there) > value(v, spot):
                    break
                length /= 4
            else:
                break  # no step helps: out of reach, or as near as numbers allow
            v, spot = ahead, there
    return {"v": [0.0] * k, "wanted": wanted, "targets": have, "totals": have, "reached": 0.0, "steps": taken}


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], growth: float = 1.0, columns: list[str] | None = None) -> tuple[DataFrame, dict]:
    """docs (or some of its columns) with n_tokens, p (by model["domains"]) and rate; and the model with its targets and totals.

    Features are computed once and written with the columns.
    """
    lexicon = word_list(docs, labels)
    drop = {"mix_features", "n_tokens", "p", "rate", *BINS}
    columns = [c for c in columns or docs.columns if c not in drop]
    features = written(featured(docs, lexicon).select(*columns, "mix_features"))
    model = fit_classifier(features, labels)
    scored = features.select(posteriors(model).alias("p"), "mix_features.n_tokens")
    model |= fit_rates(scored, model["domains"], weights, growth) | {"lexicon": lexicon}
    out = features.withColumn("p", posteriors(model)).withColumn("rate", F.round(rate(model["v"]), 6))
    return out.withColumn("n_tokens", F.col("mix_features.n_tokens")).drop("mix_features"), model


def copies(mixed: DataFrame) -> DataFrame:
    """Each row floor(rate) times, and once more with the chance of the rest, by a hash of its id."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(1 << 20)
    rows = mixed.withColumn("mix_copy", F.floor(F.col("rate") + chance).cast("int")).where("mix_copy > 0")
    return rows.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copy"))))
