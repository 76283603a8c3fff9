"""Whole texts to token ids by a public byte-level BPE, with a memo of the words met before.

Byte-level BPE first cuts a text into words, and no merge crosses a cut. The last blank of a run of
white space, before a character that is none, always begins a word. So a text is cut before such
spaces and line ends. Arrow finds the distinct pieces of some texts and which of them the memo has; each new one
meets the tokenizer once, and the texts' ids are gathered from their pieces'. A final full stop or comma
after a letter or digit, a word of its own, is split off first. The ids equal those of one call over the whole text,
which the tests hold against the tokenizer itself.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that the memo holds; beyond them those that were met last stay, half as many.
MEMO_PIECES = 700_000
#: Texts that have these are cut with more care.
UNSAFE = re.compile(r"[ \n](?:\s|\Z)")
SAFE = re.compile(r" (?=\S)")
BLANK = re.compile(r"\s")
TAIL = r"[\p{L}\p{N}][.,]$"
#: Words given to the tokenizer as one string.
JOINED = 500
#: Characters of texts that are cut at once, unless one text has more.
CHARACTERS = 12_000_000
#: Rows of texts handed over at once: the more there are, the more of their pieces are equal.
ROWS = 4096


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Pieces and their ids: words as an Arrow array, ids as slices of one array, and when each was met last."""

    def __init__(self, size: int):
        self.limit, self.clock = size, 0
        self.words = pa.array([], pa.large_string())
        self.flat = np.zeros(0, "<u2")
        self.start, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, keys: pa.Array, learn: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """Where each key stands in the memo, new ones learned."""
        at = pc.index_in(keys, value_set=self.words)
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            lacking = keys.filter(at.is_null())
            new = lacking.unique()
            out[out < 0] = len(self.words) + pc.index_in(lacking, value_set=new).to_numpy()
            ids = learn(new.to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            self.words = pa.concat_arrays([self.words, new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.met = np.concatenate([self.met, np.zeros(len(ids), np.int32)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u2")])
        self.clock += 1
        self.met[out] = self.clock
        return out

    def trim(self) -> None:
        if len(self.words) > self.limit:
            stay = np.sort(np.argsort(self.met, kind="stable")[-(self.limit // 2) :])
            self.words = self.words.take(pa.array(stay))
            self.flat = slices(self.flat, self.start[stay], self.size[stay])
            self.size, self.met = self.size[stay], self.met[stay]
            self.start = np.cumsum(self.size) - self.size


def slices(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of an array one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 16-bit numbers.

    special_as_text: the strings of special tokens in a text are ordinary text; else each is its
    token, as the library has it by default. They hold no blanks, so the cuts are valid either way.
    """

    def __init__(self, path: str, memo: int = MEMO_PIECES, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        model = self.tokenizer.model
        model._resize_cache(0)  # only new words come here; the memo is the cache
        self.tokenizer.model = model
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.opens = np.zeros(1 << 16, bool)  # ids of tokens that begin with a space or a line end
        self.opens[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True
        self.tails = {c: vocabulary[c] for c in ".,"}
        self.memo = Memo(memo)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces; those of letters and digits are encoded together and cut at their blanks."""
        found: dict[str, bytes] = {}
        words = [k for k in pieces if k.isalnum()]
        lines = [k for k in pieces if k[0] == "\n" and k[1:].isalnum()]
        parts = [(words[at : at + JOINED], " ") for at in range(0, len(words), JOINED)] + [(lines[at : at + JOINED], "") for at in range(0, len(lines), JOINED)]
        for (keys, before), ids in zip(parts, self._ids([b + b.join(k) for k, b in parts]), strict=True):
            cuts = (np.flatnonzero(self.opens[np.frombuffer(ids, "<u2")]) * 2).tolist()
            if len(cuts) == len(keys):
                found.update(zip(keys, map(ids.__getitem__, map(slice, cuts, [*cuts[1:], len(ids)])), strict=True))
            else:
                found.update(zip(keys, self._ids([before + k for k in keys]), strict=True))
        rest = [k for k in pieces if k not in found]
        found.update(zip(rest, self._ids([k if k[0] == "\n" else " " + k for k in rest]), strict=True))
        return list(map(found.__getitem__, pieces))

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts and where each text's begin; one that begins with a line end is whole, any other lacks the space before it, as does a text's first if there was none."""
        careful = [UNSAFE.search(t) is not None for t in texts]
        plain = pa.array([t for t, c in zip(texts, careful, strict=True) if not c], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        cut = [SAFE.split(t) for t, c in zip(texts, careful, strict=True) if c]
        if not cut:
            return lists.flatten(), lists.offsets.to_numpy()
        pieces = pa.concat_arrays([lists.flatten(), pa.array([p for c in cut for p in c], pa.large_string())])
        sizes = np.concatenate([np.diff(lists.offsets.to_numpy()), [len(c) for c in cut]]).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.argsort(np.argsort(careful, kind="stable"), kind="stable")  # of each text among the plain and then the careful ones
        begins, sizes = first[place], sizes[place]
        ends = np.cumsum(sizes)
        return pieces.take(pa.array(np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1]))), np.concatenate([[0], ends])

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces, begins = self._cut(texts)
        coded = pieces.dictionary_encode()
        at, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first = begins[:-1]
        heads = distinct.take(pa.array(at[first])).to_pylist()
        inner = np.ones(len(at), bool)
        inner[first] = False
        used = np.zeros(len(distinct), bool)
        used[at[inner]] = True
        words = distinct.filter(pa.array(used))
        # a first piece is met as if after a line end, whose id is taken off again; unless it begins with a blank
        odd = sorted({h for h in heads if BLANK.match(h)})
        lines = sorted({*heads} - {"", *odd})
        # a last full stop or comma is met by itself
        tailed = pc.match_substring_regex(words, TAIL)
        keys = pc.if_else(tailed, pc.utf8_slice_codeunits(words, 0, -1), words)
        tail = np.zeros(len(words), "<u2")
        tail[pc.ends_with(words, ".").to_numpy(zero_copy_only=False)] = self.tails["."]
        tail[pc.ends_with(words, ",").to_numpy(zero_copy_only=False)] = self.tails[","]
        tailed = tailed.to_numpy(zero_copy_only=False)
        memo = self.memo
        place = memo.places(pa.concat_arrays([keys, pa.array(["\n" + h for h in lines], pa.large_string())]), self._learn)
        start, size = memo.start[place], memo.size[place]
        start[len(words) :] += 1
        size[len(words) :] -= 1
        # the ids of the distinct pieces: words with their tails, lines' first pieces, blank ones, none
        size[: len(words)] += tailed  # room for the tail
        flat = slices(np.append(memo.flat, memo.flat[:1]), start, size)  # a tail's place may lie one beyond the last piece
        ends = np.cumsum(size)
        flat[(ends[: len(words)] - 1)[tailed]] = tail[tailed]
        blank = [np.frombuffer(b, "<u2") for b in self._ids(odd)]
        flat = np.concatenate([flat, *blank])
        size = np.concatenate([size, [len(b) for b in blank], [0]]).astype(np.int64)
        start = np.cumsum(size) - size
        spot = {h: len(words) + k for k, h in enumerate([*lines, *odd])} | {"": len(size) - 1}
        row = (np.cumsum(used) - 1)[at]
        row[first] = [spot[h] for h in heads]
        bounds = np.concatenate([[0], np.cumsum(size[row])])[begins].tolist()
        gathered = slices(flat, start[row], size[row])
        memo.trim()
        return [gathered[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for t in texts:
            if some and size + len(t) > CHARACTERS:
                out += self._encode(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        return out + self._encode(some) if some else out


@functools.cache
def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file, with special tokens as the library has them by default."""
    return Encoder(path, special_as_text=False)
