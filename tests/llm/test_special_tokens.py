"""Special tokens in texts against the library with its defaults."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from stowlens.llm import packing, tokens, wavelet


def test_special_tokens_are_as_the_library_has_them_by_default(spark):
    t = Tokenizer.from_file(tokens.vocabulary_file())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "word,", "end.", "don't", "<|endoftext|>", "<|endoftext|>", "é", " ", "12345", "'s", "!", "\r\n", "\U0001f600"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|>.", " <|endoftext|>", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 15))) for _ in range(3000))]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275]
    got = tokens.encoder(tokens.vocabulary_file()).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == want

    df = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string")
    start = 0
    for r, ids in zip(sorted(wavelet.encode_and_read(df, tokens.vocabulary_file()).collect(), key=lambda r: r.doc_id), want, strict=False):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        start += r.n_tokens
    packed = {r.doc_id: r for r in packing.pack(packing.pieces(df, tokens.vocabulary_file())).collect()}
    assert all((packed[k].length, packed[k].ids_crc32) == (len(want[k]) + 1, zlib.crc32(np.array([*want[k], 2], "<u4").tobytes())) for k in range(50))
