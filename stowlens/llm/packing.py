"""Best-fit packing into sequences by a grouping genetic algorithm on islands.

Documents become pieces: a longer document is cut so that all pieces but the first are full. Full
pieces are sequences already. The others are dealt into chunks of about CHUNK_PIECES pieces by a hash;
each chunk is evolved by ISLANDS islands, which are separate tasks. An individual is a list of
bins. Crossover puts whole well-filled bins of one parent into the other, removes the bins that
now hold a piece twice, and best-fits the displaced pieces, longest first. Mutation empties bins and
fills new ones from their pieces, each bin with the pieces that fill it best. Between epochs each
island's elite migrates to the next island; at the end each chunk keeps its best individual. An island
ends early when its best individual has no more bins than the pieces' total needs.

Defined results: a null or empty text is a piece of one token, the end id; repeated rows are
pieces of their own; an empty table gives no rows; further columns are ignored. Given the same
rows the pieces that share a sequence are the same (up to equal pieces), for chunks, seeds and the order
of pieces come from document ids and contents; the numbers of full pieces' sequences depend on partitions.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowlens.llm import tokens
from stowlens.llm.common import map_batches, whole_text, written

CAPACITY, END_ID = 1024, 2
CHUNK_PIECES, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 16_000, 2, 3, 6, 5

Bins = list[list[int]]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        end = np.array([END_ID], "<u2").tobytes()
        for doc_id, coded in zip(batch.column(0).to_pylist(), tokens.encoder(vocabulary).encode(batch.column(1).to_pylist()), strict=True):
            ids = np.frombuffer(coded + end, "<u2").astype("<u4")
            n = len(ids)
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for name, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b])), strict=True):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    texts = docs.select("doc_id", whole_text().alias("text"))
    return map_batches(texts, run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", tokens.ROWS)


def best_fit(bins: Bins, fills: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Each item, in the order given, into the bin with the least room that holds it, else a new one."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, f in enumerate(fills):
        rooms[capacity - f].append(i)
        mask |= 1 << (capacity - f)
    for item in items:
        size = sizes[item]
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            bins[at].append(item)
            fills[at] += size
        else:
            at, room = len(bins), capacity
            bins.append([item])
            fills.append(size)
        left = room - size
        rooms[left].append(at)
        mask |= 1 << left


def fill_best(items: list[int], sizes: list[int], capacity: int) -> tuple[Bins, list[int]]:
    """New bins, each begun by the longest item left and filled by the one or two others that leave least room, then by what still fits."""
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for item in sorted(items, reverse=True):
        waiting[sizes[item]].append(item)
        mask |= 1 << sizes[item]
    bins, fills = [], []

    def take(size: int) -> int:
        nonlocal mask
        item = waiting[size].pop()
        if not waiting[size]:
            mask &= ~(1 << size)
        return item

    def longest(room: int) -> int:
        return (mask & ((2 << room) - 1)).bit_length() - 1

    while mask:
        first = mask.bit_length() - 1
        group, room = [take(first)], capacity - first
        while (one := longest(room)) > 0:
            best, two = one, 0
            if one < room:
                left = mask & ((2 << room) - 1)
                while left and 2 * (b := left.bit_length() - 1) > best:
                    left ^= 1 << b
                    rest = (left | (1 << b if len(waiting[b]) > 1 else 0)) & ((2 << (room - b)) - 1) if b < room else 0
                    c = rest.bit_length() - 1
                    if c > 0 and b + c > best:
                        best, one, two = b + c, b, c
                        if best == room:
                            break
            group += [take(k) for k in (one, two) if k]
            room -= best
        bins.append(group)
        fills.append(capacity - room)
    return bins, fills


def fitness(fills: list[int], capacity: int) -> tuple[float, float]:
    """Fewer bins first, then fuller ones."""
    return -len(fills), sum((f / capacity) ** 2 for f in fills) / max(1, len(fills))


#: An individual: its fitness, its bins and how full each is.
Packed = tuple[tuple[float, float], Bins, list[int]]


def packed(bins: Bins, fills: list[int], loose: list[int], sizes: list[int], capacity: int) -> Packed:
    """Bins with the loose pieces best-fitted, longest first."""
    loose.sort(key=lambda i: (-sizes[i], i))
    best_fit(bins, fills, loose, sizes, capacity)
    return fitness(fills, capacity), bins, fills


def crossover(a: Packed, b: Packed, sizes: list[int], capacity: int, rng: random.Random) -> Packed:
    """A child of b's bins with well-filled bins of a put in whole."""
    full = [k for k, f in enumerate(a[2]) if f >= capacity - 1]
    give = rng.sample(full, max(1, len(full) // 2)) if full else [0]
    given = {i for k in give for i in a[1][k]}
    kept, fills, loose = [], [], []
    for group, fill in zip(b[1], b[2], strict=True):
        if given.isdisjoint(group):
            kept.append(list(group))
            fills.append(fill)
        else:
            loose.extend(i for i in group if i not in given)
    for k in give:
        kept.append(list(a[1][k]))
        fills.append(a[2][k])
    return packed(kept, fills, loose, sizes, capacity)


def mutate(a: Packed, sizes: list[int], capacity: int, rng: random.Random) -> Packed:
    """The worst-filled bins and a few others emptied and new ones filled from their pieces; those of the emptiest new bins are best-fitted."""
    _, bins, fills = a
    order = sorted(range(len(bins)), key=fills.__getitem__)
    few = max(1, len(bins) // rng.choice((10, 20, 50)))
    out = {*order[:few], *rng.sample(order, few)}
    kept = [k for k in range(len(bins)) if k not in out]
    new, filled = fill_best([i for k in sorted(out) for i in bins[k]], sizes, capacity)
    good = [k for k, f in enumerate(filled) if 2 * f > capacity]
    loose = [i for k, f in enumerate(filled) if 2 * f <= capacity for i in new[k]]
    return packed([list(bins[k]) for k in kept] + [new[k] for k in good], [fills[k] for k in kept] + [filled[k] for k in good], loose, sizes, capacity)


def evolve(sizes: list[int], start: list[Bins], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION) -> Packed:
    """The best individual after some generations; start gives the elites that have arrived, if any."""
    rng = random.Random(seed)
    items = list(range(len(sizes)))
    least = -(-sum(sizes) // capacity)
    people = [packed([list(g) for g in s], [sum(sizes[i] for i in g) for g in s], [], sizes, capacity) for s in start]
    if not people:
        people.append(packed([], [], items[:], sizes, capacity))
        if len(people[0][1]) > least:
            bins, fills = fill_best(items, sizes, capacity)
            people.append((fitness(fills, capacity), bins, fills))
    rank = lambda p: p[0]
    while len(people) < population and len(max(people, key=rank)[1]) > least:
        noise = [s + rng.randrange(1 + capacity // 16) for s in sizes]
        bins: Bins = []
        fills: list[int] = []
        best_fit(bins, fills, sorted(items, key=lambda i: (-noise[i], i)), sizes, capacity)
        people.append((fitness(fills, capacity), bins, fills))
    people.sort(key=rank, reverse=True)
    for _ in range(generations):
        if len(people[0][1]) <= least:
            break
        a, b = people[0], people[rng.randrange(1, len(people))] if len(people) > 1 else people[0]
        people += [crossover(a, b, sizes, capacity, rng), crossover(b, a, sizes, capacity, rng), mutate(a, sizes, capacity, rng)]
        people.sort(key=rank, reverse=True)
        del people[population:]
    return people[0]


def _to_bins(values: np.ndarray) -> Bins:
    found: dict[int, list[int]] = {}
    for i, b in enumerate(values.tolist()):
        found.setdefault(b, []).append(i)
    return list(found.values())


def _island(frame: pd.DataFrame, epoch: int, capacity: int) -> pd.DataFrame:
    """Evolves one island of one chunk; own_bin and come_bin are its elite and the arrived one, -1 at first."""
    frame = frame.sort_values(["ord", "uid"], ignore_index=True)
    sizes = frame["length"].tolist()
    start = [_to_bins(frame[c].to_numpy()) for c in ("own_bin", "come_bin") if len(frame) and frame[c].iloc[0] >= 0]
    chunk, island = int(frame["chunk"].iloc[0]), int(frame["island"].iloc[0])
    (_, fit), bins, _ = evolve(sizes, start, (chunk * ISLANDS + island) * EPOCHS + epoch, capacity)
    at = np.zeros(len(frame), np.int64)
    offset = np.zeros(len(frame), np.int64)
    for k, group in enumerate(bins):
        place = 0
        for i in sorted(group):
            at[i], offset[i] = k, place
            place += sizes[i]
    frame["own_bin"], frame["offset"] = at, offset
    frame["n_bins"] = len(bins)
    frame["fit"] = fit
    return frame


def _evolver(epoch: int, capacity: int, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda frame: _island(frame, epoch, capacity)[names]


_EVOLVED = "uid bigint, ord bigint, chunk int, island int, length bigint, own_bin bigint, come_bin bigint, offset bigint, n_bins bigint, fit double"


def assign(items: DataFrame, capacity: int = CAPACITY, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """chunk, own_bin and offset for every (uid, ord, length); uids are distinct, ord says which chunk and place a piece takes, lengths are below the capacity."""
    n = items.count()
    chunks = max(1, -(-n // chunk_pieces))
    state = items.select("uid", "ord", "length", F.pmod("ord", F.lit(chunks)).cast("int").alias("chunk"))
    state = state.withColumn("island", F.explode(F.array([F.lit(i) for i in range(ISLANDS)])))
    state = state.withColumns({"own_bin": F.lit(-1).cast("long"), "come_bin": F.lit(-1).cast("long"), "offset": F.lit(0).cast("long"), "n_bins": F.lit(0).cast("long"), "fit": F.lit(0.0)})
    for epoch in range(EPOCHS):
        if epoch:  # the elite of island k goes to island k + 1
            gone = state.select("uid", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("own_bin").alias("come"))
            state = state.join(gone, ["uid", "island"]).withColumn("come_bin", F.col("come")).drop("come")
        names = [c.split()[0] for c in _EVOLVED.split(", ")]
        state = written(state.select(*names).groupBy("chunk", "island").applyInPandas(_evolver(epoch, capacity, names), _EVOLVED))
    best = state.groupBy("chunk").agg(F.min_by("island", F.struct("n_bins", -F.col("fit"), "island")).alias("island"))
    return state.join(best, ["chunk", "island"], "left_semi").select("uid", "chunk", "own_bin", "offset")


def pack(cut: DataFrame, capacity: int = CAPACITY, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(); every full piece is a sequence by itself."""
    cut = written(cut.withColumns({"uid": F.monotonically_increasing_id(), "ord": F.xxhash64("doc_id", "piece", "length", "ids_crc32")}))
    placed = assign(cut.where(F.col("length") < capacity), capacity, chunk_pieces)
    spots = placed.select("uid", (F.shiftleft(F.col("chunk").cast("long"), 24) + F.col("own_bin")).alias("sequence_id"), "offset")
    part = cut.where(F.col("length") < capacity).join(spots, "uid")
    full = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("long")})
    return part.unionByName(full).drop("uid", "ord")
