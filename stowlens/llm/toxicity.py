"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and each word of a clause is a symbol: insult, threat, target, negation,
reporting verb, or other. Five small transducers read the symbols and weigh the insults and threats
they pass. Two are patterns that a clause matches or not: insult (an insult aimed at a target, before or after
it, is a whole match, one without a target a faint match only) and threat (a threat counts where a target has
been named before it or comes after it). Three weigh context: a negation within reach lessens
what follows, reported speech lessens it to the end of the clause, and a target that is addressed more than
once strengthens the clause. Their composition is one machine over the product of their states. Arcs carry
factors; what a later target decides is settled by the factor of the final state, for insults and threats apart.
The weights of all matched clauses of the whole text add up, and a logistic curve makes them a score.

Which words are insults and threats, and how much they weigh, is learned from labelled texts: words
and beginnings of words by their log-odds in toxic and other texts; a learned word of the threat list stays
a threat. The short lists of targets, negations, reporting verbs and threats below are fixed.

Defined results: a null or empty text has no clause and scores as a text without matches; equal
texts score equally; repeated rows are kept; further columns are ignored; without labels there is
no lexicon and every text gets the prior's score. Words are cut at blanks and at the marks that end clauses.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowlens.llm.common import map_batches, whole_text, written

#: Labelled texts that the lexicon and the curve are learned from, at most; entries of the lexicon, at most.
LABELLED_ROWS, LEXICON = 20_000, 3000
#: Texts that must have an entry, the least log-odds of an entry, and lengths of beginnings of words.
SUPPORT, ODDS, PREFIXES = 4, 2.5, (3, 4, 5, 6, 8)

#: Fixed word lists.
TARGETS = set("you your you're youre yourself u they them he she him her du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes tus".split())
NEGATIONS = set("not no never isn't aren't wasn't don't doesn't nobody nicht kein keine keinen nie pas jamais ne aucun nunca jamás ningún".split())
REPORTING = set("said says say called calls wrote claimed quoted quote alleged sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split())
THREATS = set("kill hurt destroy murder beat töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
CLAUSE = re.compile(r"[.!?;:\n,()\"“”«»]+")
EDGE = re.compile(r"^\W+|\W+$")

#: What a final state makes of the clause's insults and of its threats.
Final = tuple[float, float]
#: A transducer: from (state, symbol) to (next state, factor on the weight of the word read); and the factors of final states.
Machine = tuple[dict[tuple[int, int], tuple[int, float]], dict[int, Final]]


def _over(states: int, step: Callable[[int, int], tuple[int, float]], finals: list[Final]) -> Machine:
    """A machine from its step function."""
    return {(k, s): step(k, s) for k in range(states) for s in range(6)}, dict(enumerate(finals))


def insult(faint: float = 0.6) -> Machine:
    """State 1: a target was named. Insults of a clause without one match faintly."""
    return _over(2, lambda k, s: (int(k or s == TARGET), 1.0), [(faint, 1.0), (1.0, 1.0)])


def threat(aimless: float = 0.2) -> Machine:
    """State 1: a target was named. Threats of a clause without one hardly match."""
    return _over(2, lambda k, s: (int(k or s == TARGET), 1.0), [(1.0, aimless), (1.0, 1.0)])


def target(factor: float = 1.3) -> Machine:
    """State k: so many targets were named, 2 at most."""
    return _over(3, lambda k, s: (min(2, k + (s == TARGET)), 1.0), [(1.0, 1.0), (1.0, 1.0), (factor, factor)])


def negation(reach: int = 3, factor: float = 0.5) -> Machine:
    """State k > 0: a negation stood reach - k + 1 words before."""
    lessens = lambda k, s: factor if k and s in (INSULT, THREAT) else 1.0
    return _over(reach + 1, lambda k, s: (reach if s == NEGATION else max(0, k - 1), lessens(k, s)), [(1.0, 1.0)] * (reach + 1))


def reported(factor: float = 0.6) -> Machine:
    """State 1: a reporting verb was read."""
    return _over(2, lambda k, s: (int(k or s == REPORT), factor if k and s in (INSULT, THREAT) else 1.0), [(1.0, 1.0)] * 2)


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines in step: states are pairs, factors multiply."""
    width = len(b[1])
    arcs = {(x * width + y, s): (p * width + b[0][y, s][0], f * b[0][y, s][1]) for (x, s), (p, f) in a[0].items() for y in b[1]}
    return arcs, {x * width + y: (f[0] * g[0], f[1] * g[1]) for x, f in a[1].items() for y, g in b[1].items()}


MACHINES = [insult(), threat(), target(), negation(), reported()]
GRAMMAR = functools.reduce(compose, MACHINES)


class Symbols(dict):
    """Raw words to (symbol, weight); None for words that are nothing. Emptied when it holds many."""

    def __init__(self, lexicon: dict[str, float], limit: int = 300_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, raw: str) -> tuple[int, float] | None:
        if len(self) >= self.limit:
            self.clear()
        word = EDGE.sub("", raw)
        found = max([self.lexicon.get(f, 0.0) for f in features_of(word)], default=0.0)
        if word in THREATS:
            out = (THREAT, found or 1.0)
        elif found:
            out = (INSULT, found)
        else:
            out = None
        self[raw] = out
        return out


def features_of(word: str) -> list[str]:
    """The whole word, marked, and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) > k)] if word else []


def symbol_of(raw: str, symbols: Symbols) -> tuple[int, float]:
    """A word's symbol and weight."""
    if hit := symbols[raw]:
        return hit
    word = EDGE.sub("", raw)
    return TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTING else OTHER, 0.0


def clause_weight(words: Iterable[str], symbols: Symbols, grammar: Machine = GRAMMAR) -> float:
    arcs, finals = grammar
    state, insults, threats = 0, 0.0, 0.0
    for raw in words:
        symbol, weight = symbol_of(raw, symbols)
        state, factor = arcs[state, symbol]
        if symbol == INSULT:
            insults += weight * factor
        elif symbol == THREAT:
            threats += weight * factor
    return insults * finals[state][0] + threats * finals[state][1]


def words_of(text: str) -> list[str]:
    """A text's words in small letters, cut where clauses are."""
    return CLAUSE.sub(" ", text.lower()).split()


def text_weight(text: str | None, symbols: Symbols) -> tuple[float, int]:
    """The sum of a text's matched clauses, and its words. Clauses without an insult or threat weigh nothing and are not run."""
    text = (text or "").lower()
    words = words_of(text)
    if not any(map(symbols.__getitem__, words)):
        return 0.0, len(words)
    clauses = (c.split() for c in CLAUSE.split(text))
    return sum(clause_weight(c, symbols) for c in clauses if any(map(symbols.__getitem__, c))), len(words)


def sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Texts with their label, of at most `rows` labelled rows by a hash of the id; their ids are few enough to broadcast."""
    some = labels.where(F.col("toxic").isNotNull()).select("doc_id", "toxic").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(some), "doc_id")


def learn(labelled: DataFrame) -> dict[str, float]:
    """The lexicon: entries by their log-odds between toxic and other texts."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = {EDGE.sub("", w) for w in set(words_of(text))}
            seen[int(toxic > 0)].update({f for w in words for f in features_of(w)})
        keys = [*{*seen[0], *seen[1]}]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], ["feature", "other", "toxic"])

    totals = labelled.agg(F.sum(F.expr("int(toxic > 0)")).alias("toxic"), F.count("*").alias("n")).first()
    if not totals.toxic or totals.toxic == totals.n:
        return {}
    other = totals.n - totals.toxic
    counts = map_batches(labelled.select("text", "toxic"), count, "feature string, other bigint, toxic bigint").groupBy("feature").agg(
        F.sum("other").alias("other"), F.sum("toxic").alias("toxic")
    )
    odds = F.log((F.col("toxic") + 0.5) / (totals.toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    top = counts.where(f"toxic >= {SUPPORT}").withColumn("odds", odds).where(f"odds >= {ODDS}").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature")
    return {r.feature: r.odds for r in top.limit(LEXICON).collect()}


def curve(weights: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Logistic coefficients for log(1 + weight), weight by word, and one, by Newton steps with a small ridge."""
    x = np.stack([np.log1p(weights), np.log1p(100 * weights / (words + 10)), np.ones_like(weights)], axis=1)
    c = np.array([0.0, 0.0, -1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        ridge = np.diag([0.05, 0.05, 0.001])
        c = c - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - toxic) + ridge @ c)
    return c.tolist()


def probability(weight: float, words: int, c: list[float]) -> float:
    z = c[0] * math.log1p(weight) + c[1] * math.log1p(100 * weight / (words + 10)) + c[2]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> dict:
    """A lexicon and a curve from labelled texts. Only the rows of `labels` are learned from."""
    labelled = written(sample(docs, labels, rows))
    lexicon = learn(labelled)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        symbols = Symbols(lexicon)
        found = [text_weight(t, symbols) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found]), pa.array([n for _, n in found], pa.int64()), batch.column(1)], ["weight", "words", "toxic"])

    rows_ = map_batches(labelled.select("text", F.expr("int(toxic > 0)").alias("toxic")), weigh, "weight double, words bigint, toxic int").collect() if lexicon else []
    if not rows_:
        return {"lexicon": {}, "curve": [1.0, 0.0, -3.0]}
    return {"lexicon": lexicon, "curve": curve(*(np.array([r[k] for r in rows_], float) for k in range(3)))}


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, weight of the matched clauses, score and predicted of every row."""
    lexicon, c = model["lexicon"], model["curve"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        symbols = _symbols(lexicon)
        found = [text_weight(t, symbols) for t in batch.column(1).to_pylist()]
        scores = [round(probability(w, n, c), 6) for w, n in found]
        more = [pa.array([round(w, 6) for w, _ in found]), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column(0), *more], ["doc_id", "clause_weight", "score", "predicted"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, clause_weight double, score double, predicted int")


_made: dict[int, Symbols] = {}


def _symbols(lexicon: dict[str, float]) -> Symbols:
    """This process's memo for a lexicon; the last one only."""
    key = hash(frozenset(lexicon.items()))
    if key not in _made:
        _made.clear()
        _made[key] = Symbols(lexicon)
    return _made[key]
