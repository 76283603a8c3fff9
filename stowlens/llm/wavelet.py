"""Token-ID output: a wavelet matrix per shard file.

A shard file holds the ids of a run of documents as BITS bit-planes, most significant first. After
each plane the ids are parted stably, zeros before ones, so that rank and select over the planes
give access to any token, the count of an id in a prefix, and its k-th occurrence. Planes are cut into
blocks of BLOCK_BITS, each compressed by itself; the file's directory has the ones before every block
and where it lies. So a query reads the directory and, for each level, the blocks that it meets, at
their offsets, and never the whole file.

Layout, little-endian: MAGIC, then uint32 version, documents, levels, bits of a block, compressed bytes
of directory and of the documents' table; uint64 tokens. Then the directory (zstd): uint64 zeros of each
level; for each level and block, and once more at its end, uint64 ones before it; for each level and block
uint64 compressed bytes. Then the documents' table (zstd): document ids (int64), which ids are null (uint8),
lengths (uint64). Then the blocks of bits (zstd), level by level.

Defined results: a null or empty text has the end id alone; null document ids come first; repeated
ids are encoded each, in the order of their ids' hashes; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowlens.llm import files, tokens
from stowlens.llm.common import map_batches, shared_folder, ship, whole_text, written

MAGIC, VERSION, BITS = b"WVMX", 2, 16
END_ID = 0
#: Tokens after which a shard is closed; the document that crosses the mark stays whole.
SHARD_TOKENS = 1 << 23
BLOCK_BITS = 1 << 15
#: Ids that are parted at once.
PIECE = 1 << 16
#: Blocks of a level that a reader keeps unpacked; those of a whole shard by default, 34 MB.
CACHED = SHARD_TOKENS // BLOCK_BITS
_HEAD = "<4s6IQ"


def build(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Packed bit-planes and each level's zeros. A level is parted piece by piece, so that the work stays in the processor's cache."""
    planes, zeros = [], []
    a = ids.astype(np.uint16)
    for level in range(BITS):
        bit, low, high = np.zeros(len(a), bool), [a[:0]], [a[:0]]
        for at in range(0, len(a), PIECE):
            piece = a[at : at + PIECE]
            one = np.not_equal(piece & np.uint16(1 << (BITS - 1 - level)), 0, out=bit[at : at + PIECE])
            low.append(piece[np.flatnonzero(~one)])
            high.append(piece[np.flatnonzero(one)])
        planes.append(np.packbits(bit, bitorder="little"))
        zeros.append(sum(map(len, low)))
        a = np.concatenate(low + high)
    return planes, zeros


def dump(doc_ids: list[int | None], parts: list[bytes]) -> bytes:
    """The file of a shard: parts are each document's ids as little-endian unsigned 16-bit numbers."""
    ids = np.frombuffer(b"".join(parts), "<u2")
    planes, zeros = build(ids)
    press = zstandard.ZstdCompressor(level=1)
    ones, sizes, blocks = [], [], []
    for plane in planes:
        at = np.arange(0, len(plane), BLOCK_BITS // 8)
        ones.append(np.cumsum([0, *(np.add.reduceat(np.bitwise_count(plane), at, dtype=np.int64) if len(at) else ())]))
        packed = [press.compress(plane[k : k + BLOCK_BITS // 8]) for k in at.tolist()]
        sizes.append([len(b) for b in packed])
        blocks += packed
    directory = press.compress(b"".join(np.array(x, "<u8").tobytes() for x in (zeros, ones, sizes)))
    table = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.array([len(p) // 2 for p in parts], "<u8")]
    table = press.compress(b"".join(x.tobytes() for x in table))
    return b"".join([struct.pack(_HEAD, MAGIC, VERSION, len(doc_ids), BITS, BLOCK_BITS, len(directory), len(table), len(ids)), directory, table, *blocks])


class Shard:
    """Queries on a shard file, which may be any file that can be read at offsets. Positions and ends may be arrays."""

    def __init__(self, file: BinaryIO):
        self.file = file
        magic, version, self.docs, levels, block, directory, table, self.n = struct.unpack(_HEAD, self._read(0, struct.calcsize(_HEAD)))
        if (magic, version, levels, block) != (MAGIC, VERSION, BITS, BLOCK_BITS):
            raise ValueError("not a shard of this format")
        self.table_at = struct.calcsize(_HEAD) + directory
        blocks = -(-self.n // BLOCK_BITS)
        numbers = np.frombuffer(self._unpacked(self.table_at - directory, directory), "<u8").astype(np.int64)
        self.zeros = numbers[:BITS].tolist()
        self.ones_before = numbers[BITS : BITS + BITS * (blocks + 1)].reshape(BITS, blocks + 1)
        sizes = numbers[BITS + BITS * (blocks + 1) :]
        self.places = (self.table_at + table + np.cumsum(np.concatenate([[0], sizes]))).tolist()
        self.table = table
        self._block = functools.lru_cache(maxsize=BITS * CACHED)(self._load)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _unpacked(self, at: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._read(at, size))

    def _bytes(self, level: int, block: int) -> bytes:
        k = level * (self.ones_before.shape[1] - 1) + block
        return self._unpacked(self.places[k], self.places[k + 1] - self.places[k])

    def _load(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits as words, with one of zeros after them, and the level's ones before each word."""
        raw = self._bytes(level, block)
        words = np.frombuffer(raw.ljust(-(-len(raw) // 8) * 8 + 8, b"\0"), "<u8")
        return words, self.ones_before[level, block] + np.cumsum(np.concatenate([[0], np.bitwise_count(words[:-1])]), dtype=np.int64)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Document ids and lengths."""
        raw = self._unpacked(self.table_at, self.table)
        ids, null = np.frombuffer(raw, "<i8", self.docs).tolist(), np.frombuffer(raw, np.uint8, self.docs, 8 * self.docs).tolist()
        return [None if z else d for d, z in zip(ids, null, strict=True)], np.frombuffer(raw, "<u8", self.docs, 9 * self.docs).astype(np.int64)

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a level before each position, 0 to n."""
        block = at // BLOCK_BITS
        if not len(at):
            return np.zeros(0, np.int64)
        order = np.argsort(block, kind="stable")
        found, first = np.unique(block[order], return_index=True)
        out = np.empty(len(at), np.int64)
        for b, here in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            if b == self.ones_before.shape[1] - 1:
                out[here] = self.ones_before[level, b]
                continue
            words, before = self._block(level, b)
            place = at[here] - b * BLOCK_BITS
            word = place >> 6
            rest = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            out[here] = before[word] + np.bitwise_count(words[word] & rest)
        return out

    def access(self, at: np.ndarray | int) -> np.ndarray | int:
        """The ids at positions."""
        one = np.ndim(at) == 0
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(at)
        out = np.zeros(len(at), np.int64)
        for level in range(BITS):
            ones, after = np.split(self.rank(level, np.concatenate([at, at + 1])), 2)
            bit = after - ones
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return int(out[0]) if one else out

    def _range(self, token: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of token among the first `end` ids lie below the last level."""
        at = np.concatenate([[0], end])
        for level in range(BITS):
            ones = self.rank(level, at)
            at = self.zeros[level] + ones if token >> (BITS - 1 - level) & 1 else at - ones
        return at[0], at[1:]

    def count(self, token: int, end: np.ndarray | int | None = None) -> np.ndarray | int:
        """Occurrences of token among the first `end` ids, all by default."""
        first, last = self._range(token, np.atleast_1d(np.asarray(self.n if end is None else end, np.int64)))
        return last - first if np.ndim(end) else int(last[0] - first)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of token."""
        first, last = self._range(token, np.array([self.n]))
        if not 0 <= k < last[0] - first:
            raise IndexError(k)
        i = int(first) + k
        for level in reversed(range(BITS)):
            one = token >> (BITS - 1 - level) & 1
            i = self._find(level, one, i - self.zeros[level] if one else i)
        return i

    def _find(self, level: int, one: int, rank: int) -> int:
        """The position of the rank-th bit of a kind: by the directory, the block's words, the word's bits."""
        before = self.ones_before[level]
        if not one:
            before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.n) - before
        block = int(np.searchsorted(before, rank, "right")) - 1
        words, ones = self._block(level, block)
        if not one:
            ones = block * BLOCK_BITS + np.arange(len(ones)) * 64 - ones
        word = int(np.searchsorted(ones, rank, "right")) - 1
        bits = int(words[word]) if one else ~int(words[word]) & ((1 << 64) - 1)
        for _ in range(rank - int(ones[word])):
            bits &= bits - 1
        return block * BLOCK_BITS + word * 64 + (bits & -bits).bit_length() - 1

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the partings undone from the last level up."""
        a = np.zeros(self.n, np.uint16)
        for level in reversed(range(BITS)):
            words = [self._block(level, b)[0][:-1] for b in range(self.ones_before.shape[1] - 1)]
            plane = np.concatenate([np.zeros(0, "<u8"), *words])
            bit = np.unpackbits(plane.view(np.uint8), count=self.n, bitorder="little").view(bool)
            up, one = np.empty(self.n, np.uint16), np.uint16(1 << (BITS - 1 - level))
            low, high = 0, self.zeros[level]
            for at in range(0, self.n, PIECE):
                here = bit[at : at + PIECE]
                ones, zeros = np.flatnonzero(here), np.flatnonzero(~here)
                piece = up[at : at + PIECE]
                piece[ones] = a[high : high + len(ones)] | one
                piece[zeros] = a[low : low + len(zeros)]
                low, high = low + len(zeros), high + len(ones)
            a = up
        return a


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (with the end id, as little-endian unsigned 16-bit numbers) and their hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([END_ID], "<u2").tobytes()
        coded = [c + end for c in tokens.encoder(vocabulary).encode(batch.column(1).to_pylist())]
        hashes = np.array([xxhash.xxh3_64_intdigest(c) for c in coded], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary()), pa.array(hashes)], ["doc_id", "ids", "h"])

    return map_batches(docs.select("doc_id", whole_text().alias("text")), run, "doc_id bigint, ids binary, h bigint", tokens.ROWS)


def shards(docs: DataFrame, vocabulary: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """part, shard, inside, n_docs, n_tokens, path of shard files: by part and shard they are in ascending doc_id order.

    inside: the tokens of the part's earlier shards. Texts are encoded where they are, and only ids are
    shuffled; the driver draws the ranges from document ids and hashes alone.
    """
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    folder = shared_folder(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size, part, shard, inside = [], [], 0, None, 0, 0

        def closed() -> pa.RecordBatch:
            path = files.put(folder, f"{part:06}-{shard:06}", dump(ids, parts))
            row = {"part": part, "shard": shard, "inside": inside, "n_docs": len(ids), "n_tokens": size, "path": path}
            return pa.RecordBatch.from_pylist([row], pa.schema(list(zip(row, kinds, strict=True))))

        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            for doc_id, coded in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids.append(doc_id)
                parts.append(coded)
                size += len(coded) // 2
                if size >= shard_tokens:
                    yield closed()
                    ids, parts, size, shard, inside = [], [], 0, shard + 1, inside + size
        if ids:
            yield closed()

    ship(docs.sparkSession)
    ordered = written(encoded(docs, vocabulary)).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    return ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(
        run, "part int, shard int, inside bigint, n_docs bigint, n_tokens bigint, path string"
    )


def with_starts(stored: DataFrame) -> DataFrame:
    """Adds `start`, the tokens before each shard, from totals by part; those are one row a task, so they are broadcast."""
    by_part = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_part.select("part", before.alias("before"))
    return stored.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("inside"))


def read_back(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document from the shard files, its last id by access and its n_end_ids by counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.opened(path) as file:
                    shard = Shard(file)
                    doc_ids, lengths = shard.documents()
                    ends = np.cumsum(lengths)
                    begins = ends - lengths
                    last, counts = shard.access(ends - 1), shard.count(END_ID, ends)
                    ids = shard.ids().astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                numbers = [begins + start, lengths, np.array(sums, np.int64), last, np.diff(counts, prepend=0)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *map(pa.array, numbers)], ["doc_id", "start", "n_tokens", "ids_crc32", "last_id", "n_end_ids"])

    ship(stored.sparkSession)
    tasks = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored.select("start", "path").repartition(tasks).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, last_id bigint, n_end_ids bigint")


def encode_and_read(docs: DataFrame, vocabulary: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shard files written to the shared folder, and what they hold."""
    return read_back(with_starts(written(shards(docs, vocabulary, shard_tokens))))
