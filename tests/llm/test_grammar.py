"""The toxicity grammar: composed machine against the single ones, and what matches."""

import random
import zlib

import pytest

from stowlens.llm import queries, toxicity

SYMBOLS = toxicity.Symbols({"idiot$": 3.0, "moron": 2.0, "kill$": 4.0})


def weight(text):
    return toxicity.text_weight(text, SYMBOLS)[0]


def test_composed_machine_equals_the_machines_side_by_side():
    rng = random.Random(6)
    words = ["idiot", "moronic", "kill", "hurt", "you", "they", "not", "never", "said", "quiet", "house", "tree"]
    for _ in range(2000):
        clause = [rng.choice(words) for _ in range(rng.randrange(0, 9))]
        states, insults, threats = [0] * len(toxicity.MACHINES), 0.0, 0.0
        for w in clause:
            symbol, x = toxicity.symbol_of(w, SYMBOLS)
            for k, (arcs, _) in enumerate(toxicity.MACHINES):
                states[k], factor = arcs[states[k], symbol]
                x *= factor
            if symbol == toxicity.THREAT:
                threats += x
            else:
                insults += x
        for k, (_, finals) in zip(states, toxicity.MACHINES, strict=True):
            insults, threats = insults * finals[k][0], threats * finals[k][1]
        assert toxicity.clause_weight(clause, SYMBOLS) == pytest.approx(insults + threats)


def test_no_blank_is_needed_at_clause_ends():
    assert weight("you,idiot") == weight("you, idiot") > 0 and weight("hey:idiot") == weight("hey: idiot") > 0 and weight("Go.Idiot.Now") == weight("go. idiot. now") > 0


def test_patterns():
    aimed, alone = weight("you are an idiot"), weight("idiot")
    assert aimed > alone > 0 and weight("idiot, you") == alone and weight("idiot that you are") == aimed
    assert weight("i will kill you") > 3 * weight("i will kill time") > 0
    assert weight("you are not an idiot") < aimed and weight("they said you are an idiot") < aimed and weight("you idiot, you") < weight("you idiot you")
    assert toxicity.symbol_of("kill", SYMBOLS) == (toxicity.THREAT, 4.0) and toxicity.symbol_of("hurt", SYMBOLS)[0] == toxicity.THREAT
    assert weight(None) == weight("") == weight("a quiet house") == 0


def test_held_out_of_a_row_without_id(spark, tmp_path):
    docs = [(k, "you idiot" if k % 3 == 0 else "a quiet house") for k in range(60)] + [(None, "you idiot")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = queries.op6_toxicity(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.held_out for r in out} == {None: False, **{k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(60)}}
    assert all(r.predicted == int(r.score >= 0.5) for r in out)
