"""Quality classifier from weak labels.

Heuristic labellers look for one defect or one merit each, and vote on every document that is long
enough for them, else abstain. Their votes make patterns, of which there are at most 3 ** len(LABELLERS);
from the counts of the patterns over all documents expectation-maximisation estimates how often each labeller
votes on bad and on good documents, its accuracies, and so the posterior of every pattern. Votes for merit
and for defects together settle which class is which, so the prior on accuracies may be weak. The posteriors
of a bounded sample, drawn by a hash of id and text, train a linear scorer on hashed byte trigrams, and the
scorer's probability decides. What the driver gets of the sample are DIMENSIONS + 1 counts a document, not its text.

Defined results: a null or empty text meets labellers as an empty text and scores as one; equal
texts score equally; repeated rows are kept; further columns pass through, those named like a
result column give way; on an empty table nothing is fitted and no row returned.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowlens.llm.common import map_batches

#: Documents that train the scorer, at most.
TRAIN_ROWS = 3000
DIMENSIONS = 1024
EM_ROUNDS, STEPS, RATE, DECAY = 50, 150, 0.05, 1e-4
#: A document stays if its probability of being good reaches this.
THRESHOLD = 0.25
#: Prior of votes against a document's class, and its weight as a share of all documents.
FALSE_VOTES, PRIOR = 0.001, 0.02
#: Added to a text's number of features, so that a few of them say little.
SHRINK = 64

_SYMBOLS = [ord(c) for c in "#*$%&|<>{}[]\\^~=_"]
_ENDS = [ord(c) for c in ".!?"]


#: Words that a text must have for most labellers to vote.
SHORT, LONG = 8, 60
Vote = bool | None


def _symbols(c: np.ndarray, words: list[str], text: str) -> Vote:
    return c[_SYMBOLS].sum() >= 0.2 * len(words) if len(words) > 1 else None


def _capitals(c: np.ndarray, words: list[str], text: str) -> Vote:
    return c[65:91].sum() > c[97:123].sum() if len(words) >= SHORT else None


def _shouting(c: np.ndarray, words: list[str], text: str) -> Vote:
    return c[33] >= 0.25 * len(words) if len(words) >= SHORT else None


def _stutter(c: np.ndarray, words: list[str], text: str) -> Vote:
    return sum(map(operator.eq, words, words[1:])) >= 0.2 * len(words) if len(words) >= SHORT else None


def _sentences(c: np.ndarray, words: list[str], text: str) -> Vote:
    return c[_ENDS].sum() <= 0.004 * len(words) if len(words) >= LONG else None


def _cells(c: np.ndarray, words: list[str], text: str) -> Vote:
    return c[124] >= 0.2 * len(words) if len(words) >= SHORT else None


def _word_length(c: np.ndarray, words: list[str], text: str) -> Vote:
    return abs((len(text) - len(words)) / len(words) - 5.5) >= 4.5 if len(words) >= SHORT else None


def _prose(c: np.ndarray, words: list[str], text: str) -> Vote:
    return len(words) / 40 <= c[_ENDS].sum() <= len(words) / 3 and c[_SYMBOLS].sum() <= 0.02 * len(words) if len(words) >= 20 else None


def _variety(c: np.ndarray, words: list[str], text: str) -> Vote:
    return len(set(words)) >= 0.4 * len(words) ** 0.93 and c[97:123].sum() + c[128:].sum() >= 0.7 * c.sum() if len(words) >= SHORT else None


#: Each votes that a document is bad (first those), or good, or doesn't, or abstains (None).
DEFECTS = [_symbols, _capitals, _shouting, _stutter, _sentences, _cells, _word_length]
MERITS = [_prose, _variety]
LABELLERS = [*DEFECTS, *MERITS]


def pattern(text: str) -> int:
    """The labellers' votes as one number to base 3: 0 no vote, 1 a vote, 2 abstains."""
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    words, out = text.split(), 0
    for labeller in LABELLERS:
        vote = labeller(counts, words, text)
        out = out * 3 + (2 if vote is None else int(vote))
    return out


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def em(patterns: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good for each pattern, and each labeller's rate of votes [class, labeller], bad class first.

    It starts from a bad posterior wherever a defect is seen. Labellers are taken as independent given
    the class; those that abstain say nothing. A vote for a defect on a good document, or for a merit on a bad
    one, is held rare beforehand (FALSE_VOTES, with the weight of a share PRIOR of the documents).
    """
    codes = sorted(patterns)
    digits = np.array([votes_of(c) for c in codes])
    votes, there = (digits == 1).astype(float), (digits < 2).astype(float)
    n = np.array([patterns[c] for c in codes], float)
    defect = np.arange(len(LABELLERS)) < len(DEFECTS)
    weight = PRIOR * n.sum()
    post = np.where(votes[:, defect].any(axis=1), 0.1, 0.95)
    rates = np.zeros((2, len(LABELLERS)))
    for _ in range(rounds):
        for k, (share, against) in enumerate(((n * (1 - post), ~defect), (n * post, defect))):
            rates[k] = (share @ votes + np.where(against, weight * FALSE_VOTES, 0.5)) / (share @ there + np.where(against, weight, 1))
        rates = rates.clip(1e-6, 1 - 1e-6)
        share = min(0.98, max(0.02, (n * post).sum() / n.sum()))
        logs = votes @ np.log(rates).T + (there - votes) @ np.log(1 - rates).T + np.log([1 - share, share])
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return dict(zip(codes, post.tolist(), strict=True)), rates


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text, and a slot of their own for words that repeat the word before."""
    b = np.frombuffer(b"\x02\x02" + text.encode() + b"\x03", np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    words = text.split()
    again = sum(map(operator.eq, words, words[1:]))
    return np.concatenate([h, np.full(6 * again, DIMENSIONS, np.uint32)]) if again else h


def slots(text: str) -> np.ndarray:
    """The mean weight of each slot in a text's score, times 100."""
    h = trigrams(text)
    return (np.bincount(h, minlength=DIMENSIONS + 1) * (100 / (len(h) + SHRINK))).astype(np.float32)


def train(x: np.ndarray, posteriors: list[float]) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of texts' slots, by Adam on soft labels; classes weigh the same."""
    y = np.array(posteriors, np.float32)
    good = max(1e-3, float(y.mean()))
    weight = y / good + (1 - y) / max(1e-3, 1 - good)
    weight = (weight / weight.sum()).astype(np.float32)
    w, b = np.zeros(DIMENSIONS + 1, np.float32), np.float32(0)
    m, v = np.zeros(DIMENSIONS + 2, np.float32), np.zeros(DIMENSIONS + 2, np.float32)
    for k in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        err = weight * (p - y)
        g = np.append(err @ x + DECAY * w, err.sum()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(text: str, w: np.ndarray, b: float) -> float:
    h = trigrams(text)
    return float(1 / (1 + np.exp(-np.clip(100 * float(w[h].sum(dtype=np.float64)) / (len(h) + SHRINK) + b, -30, 30))))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Patterns over all documents, their posteriors, and a scorer trained on at most `rows` documents."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, n = np.unique([pattern(t or "") for t in batch.column(0).to_pylist()], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(n, pa.int64())], ["code", "n"])

    texts = docs.select("text")
    counted = map_batches(texts, count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    patterns = {r.code: r.n for r in counted.collect()}
    if not patterns:
        return {"posteriors": {}, "w": np.zeros(DIMENSIONS + 1, np.float32), "b": 0.0}
    posteriors, rates = em(patterns)
    # a deterministic sample: the least hashes, of those below a bound that lets about enough pass
    share = min(1 << 30, max(1, int(1.5 * rows / sum(patterns.values()) * (1 << 30))))
    drawn = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.pmod("h", F.lit(1 << 30)) < share).orderBy("h", "text").limit(rows)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([pattern(t) for t in texts], pa.int32()), pa.array([slots(t).tobytes() for t in texts], pa.binary())], ["h", "code", "x"])

    sample = sorted(map(tuple, map_batches(drawn, features, "h bigint, code int, x binary").collect()))
    x = np.array([np.frombuffer(r[2], np.float32) for r in sample]).reshape(-1, DIMENSIONS + 1)
    w, b = train(x, [posteriors.get(r[1], 0.5) for r in sample])
    return {"posteriors": posteriors, "rates": rates, "w": w, "b": b}


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs with weak_label (the posterior of the votes), quality_score and quality_kept."""
    names = [c for c in docs.columns if c not in ("weak_label", "quality_score", "quality_kept")]
    docs = docs.select(*names)
    at, w, b, posteriors = names.index("text"), model["w"], model["b"], model["posteriors"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        scores = [round(score(t, w, b), 6) for t in texts]
        weak = [round(posteriors.get(pattern(t), 0.5), 6) for t in texts]
        more = [pa.array(weak), pa.array(scores), pa.array([s >= threshold for s in scores])]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "weak_label", "quality_score", "quality_kept"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "weak_label double, quality_score double, quality_kept boolean"])
    return map_batches(docs, run, schema)
