"""MinHash near-duplicates by min-max hashing.

Every permutation gives two signature values, the least and the greatest hash of a document's
shingles, so half as many hashes are evaluated. Bands of ROWS values propose pairs; a pair counts
only if the full shingle sets confirm it: 100 * intersection >= percent * union. Links make
components, named by their smallest document id.

Equal sets are one class, and only classes take part. A document id that stands on rows of several
classes links them. No bucket is expanded into all its pairs:

- In rounds, each bucket compares its members with one pivot, which is one pair a member; members
  already in the pivot's component need none. Links found join components.
- Classes in buckets that are still mixed after the rounds meet by prefixes. With shingles ordered
  from rare to common, two similar sets share one among the first of each, and the less similar they
  may be, the more of these are needed; a template that many pages share is common, so it lies
  behind these prefixes. In a shingle's list of classes, those of its main component meet only the others.

Sizes, a sketch of the signature, and parities, which bound the shingles that only one of two sets
has, rule out most pairs before full sets are joined. So every pair that a band proposes is confirmed,
refuted, or already connected.

With the default bands a pair at the very threshold (0.85) is missed with a chance of 2e-8 by the
bands, (1 - 0.85 ** 4) ** 24, and 5e-9 by the sketch; pairs above it with less.

Defined results: a document without words has no shingles and is linked with nothing, nor is a row
without id; one with fewer words than a shingle has its whole sequence as its shingle; repeated rows
are kept and get the same component, and so do all rows of a repeated id that have words; further
columns of the input are ignored; an empty table gives no rows. The answer depends on the rows only,
not on their order or partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowlens.llm.common import Scratch, map_batches, written

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 24, 4
PERMUTATIONS = BANDS * ROWS // 2
#: Differing two-bit codes of the BANDS * ROWS in a sketch, at most, for a pair that is compared.
SKETCH_DIFFERENCES = 34
PIVOT_ROUNDS = 3
#: Bits of a set's parity: how often, modulo 2, its shingles fall on each.
PARITY_BITS = 1024
MEMO_WORDS = 300_000
#: Bits of the filter that says whose sets are worth computing; at most, and for each document.
FILTER_BITS, FILTER_BITS_EACH = 1 << 25, 16

_M64 = (1 << 64) - 1
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _keys(n: int, name: str) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the name only."""
    return np.array([xxhash.xxh3_64_intdigest(f"{name}{i}") | 1 for i in range(n)], np.uint64)


_PERM, _ADD = _keys(PERMUTATIONS, "a"), _keys(PERMUTATIONS, "b")
_BAND, _ROW = _keys(BANDS, "band"), _keys(ROWS, "row")
_WORD = _keys(64, "word")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, emptied when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = WordHashes()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(n, size)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total = mix(total + h[i : n - k + 1 + i] * _WORD[i])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value of each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, _M64, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        v = shingles[at : at + 2048] * _PERM[:, None] + _ADD[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mix((mix(sig).reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) + _BAND)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of each value, 32 values to a word."""
    code = (mix(sig) & np.uint64(3)).reshape(-1, 32)
    return (code << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


_SIGNED = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>, sketch array<bigint>"
#: What tells one set from another.
_SET = ["n_shingles", "h1", "h2"]


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a sorted set."""
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return digest & _M64, digest >> 64


def signatures(docs: DataFrame, size: int, carry: list[str] = []) -> DataFrame:
    """Of every document its number of shingles, a 128-bit hash of the set, band keys and sketch; columns to carry on come last."""
    words = BANDS * ROWS // 32

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, h, bands, sketches = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, size)
            n.append(len(s))
            h.append(set_hash(s))
            sig = signature(s)
            bands.append(band_keys(sig))
            sketches.append(sketch(sig))

        def lists(rows: list[np.ndarray], k: int) -> pa.Array:
            flat = np.concatenate(rows).view(np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(flat))

        pair = np.array(h, np.uint64).view(np.int64)
        made = [pa.array(n, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), lists(bands, BANDS), lists(sketches, words)]
        return pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch", *carry])

    rest = docs.select("doc_id", "text", *carry)
    return map_batches(rest, run, ", ".join([_SIGNED, *(f"`{c}` {rest.schema[c].dataType.simpleString()}" for c in carry)]))


def id_filter(ids: DataFrame, documents: int) -> np.ndarray:
    """A bitmap of hashed ids of bounded size; a full one only means that more sets are computed."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (FILTER_BITS_EACH * max(1, documents)).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select((at / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, int(pmod(pmod(xxhash64(id), {bits}L), 64L)))").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.w] = r.b
    return out


def sets_of(docs: DataFrame, size: int, keep: np.ndarray) -> DataFrame:
    """doc_id, the set's size and hashes, the set and its parity of the documents whose id the filter has; repeated ones once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column(2).to_numpy()
        there = (keep[at >> 6] >> (at & 63)) & 1
        rows = np.flatnonzero(there)
        sets = [shingle_set(t, size) for t in batch.column(1).take(pa.array(rows)).to_pylist()]
        hashes = np.array([set_hash(x) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
        sets = [x.view(np.int64) for x in sets]
        parity = [np.packbits(np.bincount(x & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1).view(np.int64) for x in sets]

        def lists(arrays: list[np.ndarray]) -> pa.Array:
            ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))

        made = [pa.array([len(x) for x in sets], pa.int64()), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), lists(sets), lists(parity)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *made], ["doc_id", *_SET, "shingles", "parity"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(len(keep) * 64)).alias("at")
    found = map_batches(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", at), run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, shingles array<bigint>, parity array<bigint>")
    return found.dropDuplicates(["doc_id", *_SET])


#: A class's sketch and parity, word by word, so that a join's condition reads plain numbers.
_SKETCH = [f"s{i}" for i in range(BANDS * ROWS // 32)]
_PARITY = [f"p{i}" for i in range(PARITY_BITS // 64)]


def _similar(a: str, b: str, percent: int) -> Column:
    """Whether sizes, sketches and parities leave a pair possible.

    A shingle in one set only flips one bit of parity, so the bits that differ are no more than such
    shingles, and linked sets have at most (100 - percent) / (100 + percent) of both sizes of them.
    """
    only = " + ".join(f"bit_count({a}.{k} ^ {b}.{k})" for k in _PARITY)
    differ = " + ".join(f"bit_count((({a}.{k} ^ {b}.{k}) | shiftrightunsigned({a}.{k} ^ {b}.{k}, 1)) & 6148914691236517205L)" for k in _SKETCH)
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {differ} <= {SKETCH_DIFFERENCES} and ({only}) * {100 + percent} <= ({a}.n + {b}.n) * {100 - percent}")


def possible(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that members' sizes, sketches and parities don't rule out."""
    a, b = members.withColumnRenamed("id", "a").alias("x"), members.withColumnRenamed("id", "b").alias("y")
    return pairs.join(a, "a").join(b, "b").where(_similar("x", "y", percent)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total")).where(
        F.col("common") * 100 >= percent * (F.col("total") - F.col("common"))
    ).select("a", "b")


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(id, component) of every node of undirected edges (a, b): stars towards the least neighbour, large and small in turn.

    A node's least neighbour comes from an aggregation that combines before its shuffle, and is written, so
    that both sides of the joins are plain shuffles: adaptive skew joins split the rows of a star's centre.
    """
    edges = work.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = work.written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = work.written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        # done when every node has one edge only, to a node without any
        two = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("a")
        if two.unionByName(edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")).isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("c", F.col("id"))
    return members.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _mixed(now: DataFrame, *more: Column) -> DataFrame:
    """Buckets whose members are of several components."""
    return now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *more).where("lo < hi")


def pivot_pairs(rows: DataFrame, labels: DataFrame | None, k: int, work: Scratch) -> DataFrame:
    """(a, b): each member of a mixed bucket with the bucket's pivot, if of another component."""
    now = _labelled(rows, labels)
    # the first pivot shares most buckets, later ones are drawn
    drawn = F.xxhash64("id", F.lit(k))
    rank = drawn if k else F.least("weight", F.lit(1 << 30)) * (1 << 32) + F.pmod(drawn, F.lit(1 << 32))
    mixed = work.written(_mixed(now, F.max_by("id", rank).alias("p"), F.max_by("c", rank).alias("pc")).select("key", "p", "pc"))
    return now.join(mixed, "key").where("c <> pc").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def prefix_pairs(some: DataFrame, sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """(a, b) of different components that share a shingle among the first of both, rare ones first.

    some: id and component c. Of similar sets of n and m <= n shingles, the first common shingle stands
    among the first n - ceil(percent * n / 100) + 1 of the one and the first m - ceil(2 * percent * m /
    (100 + percent)) + 1 of the other, and enough shingles follow it in both.
    """
    shingles = work.written(some.join(sets.select("id", "shingles"), "id").select("id", "c", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("t")))
    often = shingles.groupBy("t").agg(F.count("*").alias("often"))
    ordered = shingles.join(work.written(often), "t").groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("often", "t"))).alias("x"))
    first = ordered.select("id", "c", "n", F.posexplode(F.expr(f"slice(x, 1, int(n - ({percent} * n + 99) div 100 + 1))"))).where("col.often > 1")
    first = work.written(first.select("id", "c", "n", F.col("pos").cast("long").alias("pos"), F.col("col.t").alias("t")))
    per = first.groupBy("t", "c").agg(F.count("*").alias("size"))
    lists = work.written(per.groupBy("t").agg(F.max_by("c", "size").alias("main"), F.count("*").alias("k")).where("k > 1").select("t", "main"))
    listed = work.written(first.join(lists, "t"))
    short = "{0}.pos <= {0}.n - (2 * %d * {0}.n + %d) div %d" % (percent, 99 + percent, 100 + percent)
    fits = f"""x.t = y.t and x.c <> y.c and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        and (x.n >= y.n and {short.format("y")} or y.n >= x.n and {short.format("x")})
        and least(x.n - x.pos, y.n - y.pos) * {100 + percent} >= {percent} * (x.n + y.n)"""
    found = listed.where("c <> main").alias("x").join(listed.alias("y"), F.expr(fits))
    return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def link_classes(reps: DataFrame, docs: DataFrame, size: int, percent: int, same: DataFrame | None, work: Scratch) -> DataFrame | None:
    """(id, component) of the classes that have links; None if there are no links.

    reps has a row for each class, with a document of it (doc_id); same has links that are known.
    """
    labels = None if same is None else components(same, work)
    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = work.written(rows.join(shared, "key").select("key", "size", "id"))
    weight = work.written(rows.groupBy("id").agg(F.sum("size").alias("weight")))
    n = weight.count()
    if not n:
        return labels
    needed = work.written(reps.join(weight.select("id"), "id").select("id", "doc_id", *_SET, "sketch"))
    found = sets_of(docs, size, id_filter(needed.select(F.col("doc_id").alias("id")), n))
    sets = work.written(found.join(needed, ["doc_id", *_SET]).select("id", F.col("n_shingles").alias("n"), "sketch", "parity", "shingles"))
    members = sets.select("id", "n", *[F.col("sketch")[i].alias(k) for i, k in enumerate(_SKETCH)], *[F.col("parity")[i].alias(k) for i, k in enumerate(_PARITY)])
    rows = work.written(rows.join(weight, "id").select("key", "id", "weight"))
    edges = same

    def join(pairs: DataFrame) -> None:
        nonlocal edges, labels
        new = work.written(confirmed(work.written(possible(pairs, members, percent)), sets, percent))
        if not new.isEmpty():
            edges = new if edges is None else edges.unionByName(new)
            labels = components(edges, work)

    for k in range(PIVOT_ROUNDS):
        join(work.written(pivot_pairs(rows, labels, k, work)))
    now = _labelled(rows, labels)
    left = work.written(now.join(work.written(_mixed(now).select("key")), "key", "left_semi").groupBy("id").agg(F.min("c").alias("c")))
    if not left.isEmpty():
        join(work.written(prefix_pairs(left, sets, percent, work)))
    return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, carry: list[str] = []) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether the document names its component) of every row, and the columns to carry."""
    docs = docs.select("doc_id", "text", *carry)
    signed = written(signatures(docs, shingle, carry).withColumn("dup_row", F.monotonically_increasing_id()))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy(*_SET).agg(F.min("dup_row").alias("id"), F.min("doc_id").alias("first")))
    work = Scratch(docs.sparkSession)
    reps = work.written(some.join(classes.select("id"), F.col("dup_row") == F.col("id")).select("id", "doc_id", *_SET, "bands", "sketch"))
    # ids with several texts
    several = some.groupBy("doc_id").agg(*[f(k).alias(f"{n}_{k}") for k in _SET for n, f in (("lo", F.min), ("hi", F.max))])
    several = work.written(several.where(" or ".join(f"lo_{k} < hi_{k}" for k in _SET)).select("doc_id"))
    same = None
    if not several.isEmpty():
        texts = some.join(several, "doc_id", "left_semi").select("doc_id", *_SET).distinct().join(classes, _SET).select("doc_id", "id")
        texts = work.written(texts)
        same = work.written(texts.join(work.written(texts.groupBy("doc_id").agg(F.min("id").alias("a"))), "doc_id").where("id > a").select("a", F.col("id").alias("b")))
    labels = link_classes(reps, docs, shingle, percent, same, work)
    if labels is not None:
        labels = work.written(labels)
        named = classes.join(labels, "id", "left").select("id", *_SET, F.coalesce("component", "id").alias("c"), "first")
        least = work.written(named.groupBy("c").agg(F.min("first").alias("component_id")))
        classes = written(named.join(least, "c").select(*_SET, "component_id"))
    else:
        classes = classes.select(*_SET, F.col("first").alias("component_id"))
    work.clear()
    # null-safe: a row without id is linked with nothing
    group = F.when(F.col("doc_id").isNotNull(), F.col("n_shingles")).alias("n_shingles")
    out = signed.select("doc_id", F.col("n_shingles").alias("n"), group, "h1", "h2", *carry).join(classes, _SET, "left")
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, kept, *carry)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near copies: of each group the row of the least id stays, and of that id's rows one. Rows without words or id stay."""
    extra = ["dup_uid", "dup_text"]
    named = written(docs.drop(*extra).withColumns({"dup_uid": F.monotonically_increasing_id(), "dup_text": F.xxhash64("text")}))
    found = near_duplicates(named, shingle, percent, extra).where("n_shingles > 0 and doc_id is not null")
    found = written(found.select("component_id", "kept", *extra))
    stay = found.where("kept").groupBy("component_id").agg(F.min_by("dup_uid", "dup_text").alias("dup_uid"))
    gone = written(found.select("dup_uid").join(stay, "dup_uid", "left_anti"))
    return named.join(gone, "dup_uid", "left_anti").drop(*extra)
