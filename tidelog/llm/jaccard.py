"""SimHash near-dedup at a Jaccard index: covering LSH first, then prefix filtering, so that no pair is missed.

A text's set is that of its shingles of SHINGLE words (lower-cased), each as its XXH64.  The first links come from the
covering tables of simhash over the SimHash of these shingles, and are compared whole.  Pairs at an index of 0.8 lie
about ten bits apart, though, beyond any radius that has few enough tables, so the rest is found by prefixes:

Put all sets in one order of their shingles.  If |A and B| / |A or B| is at least 4/5, A and B share no fewer than 4/5 of
either set, so the first shingle they share is among the first n - ceil(4 n / 5) + 1 of each: its prefix.  At that
shingle, what either set has before it is not shared, which bounds the overlap by the places in both.  Sets that share a
shingle of their prefixes, and whose sizes and places allow the index, are compared by parities of their shingles'
hashes in about as many buckets as shingles; no more parities than shingles differ, so what fails here has a smaller
index.  The rest is compared whole.

Any order finds the same pairs.  Shingles that many of all documents have come last, so that prefixes rarely meet in
common passages, and the edits of a much copied text come first.  Groups of many near copies are linked by stars first,
each set to one of those that share a shingle with it: the one with that shingle in the earliest place, which has the
fewest edits (then, if there are more stars, another).  After that only pairs of different components are compared, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.common import mapped, raw, small_rows, written
from tidelog.llm.graph import components
from tidelog.llm.simhash import keep_smallest

#: The index is at least OF_TEN / 10.  Shingles in more than one of SHARE documents come last; a table of fewer than
#: SAMPLE_DOCS counts as one of so many there (nothing is sampled).  All this bears on the order only, not on what is found.
SHINGLE, OF_TEN, SEED, STARS, SAMPLE_DOCS, SHARE = 5, 8, 42, 1, 16_000, 1000

#: Hashes are counted in 2^BUCKET_BITS buckets first, by their highest bits, and these counts are added up in blocks of BLOCK.
BUCKET_BITS, BLOCK = 22, 1 << 15


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, ascending; one for all words if these are fewer than a shingle's, none without words."""
    words = text.lower().split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, SEED) for p in parts), dtype="<u8"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), pa.array(flat))


def _crowded(texts: DataFrame, least: int) -> np.ndarray:
    """For each bucket of hashes, whether its shingles are in more than least texts, all of them together."""
    bits, block = BUCKET_BITS, min(BLOCK, 1 << BUCKET_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << bits, np.uint32)
        for b in small_rows(batches):
            for t in b.column(0).to_pylist():
                np.add.at(found, (shingles(t) >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        parts = found.reshape(-1, block)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pa.compress(parts[i].tobytes(), codec="zstd", asbytes=True) for i in some], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(pa.decompress(part.as_buffer(), 4 * block, codec="zstd"), np.uint32)
                sums[i] = sums.get(i, np.zeros(block, np.int64)) + own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x > least).tobytes() for x in sums.values()], pa.binary())], names=["block", "crowded"])

    parts = mapped(texts, count, "block int, counts binary").repartition("block")
    out = np.zeros(((1 << bits) // block, block), bool)
    for r in mapped(parts, add, "block int, crowded binary").collect():
        out[r.block] = np.unpackbits(np.frombuffer(r.crowded, np.uint8), count=block)
    return out.reshape(-1)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than one of SHARE documents, ascending, and how many have each: all of them, counted in all documents.

    There are at most SHARE times as many as a document has on average, so they go through the driver.  A bucket has no
    fewer than each of its shingles, so only shingles in crowded buckets are counted one by one."""
    texts = docs.select(raw().alias("t"))
    least, bits = max(2, max(texts.count(), SAMPLE_DOCS) // SHARE), BUCKET_BITS
    crowded = _crowded(texts, least)
    if not crowded.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sent = np.packbits(crowded).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(sent, np.uint8), count=1 << bits).view(bool)
        for b in batches:
            every = [shingles(t) for rows in small_rows([b]) for t in rows.column(0).to_pylist()]
            h, n = np.unique(np.concatenate([s[wanted[(s >> np.uint64(64 - bits)).astype(np.int64)]] for s in every] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    found = mapped(texts, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > least).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which any other set at the least index has one, if the prefixes of both are taken."""
    n = len(found)
    if not n:
        return found
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        weight = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, weight))[: n - -(-OF_TEN * n // 10) + 1]]


def parities(found: np.ndarray) -> np.ndarray:
    """How many hashes fall in each bucket, modulo 2; a power of two buckets, as many as hashes or more, 64 at least."""
    size = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def may_be_near(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
    """False only if sets of n and m shingles with these parities are below the least index."""
    while len(x) != len(y):  # the longer is folded
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (10 + OF_TEN) * int(np.bitwise_count(x ^ y).sum()) <= (10 - OF_TEN) * (n + m)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), id (a hash of the set), n (its size), fp (its SimHash), prefix, parity for each row."""
    common, counts = _common(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_rows(batches):
            found = [shingles(t) for t in b.column(2).to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
            sizes, heads = pa.array([len(s) for s in found], pa.int32()), _lists([prefix(s, common, counts) for s in found])
            parity = pa.array([parities(s).tobytes() for s in found], pa.binary())
            fps = pa.array(np.array([simhash.majority(s) for s in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids), sizes, fps, heads, parity], names=["doc_id", "th", "id", "n", "fp", "prefix", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", F.xxhash64(raw()).alias("th"), raw().alias("t")), run, f"doc_id {kind}, th long, id long, n int, fp long, prefix array<long>, parity binary")


def _whole(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, tokens for each row of wanted (th, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_rows(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t) for t in b.column(1).to_pylist()])], names=["id", "tokens"])

    texts = docs.select(F.xxhash64(raw()).alias("th"), raw().alias("t")).join(wanted, "th").select("id", "t")
    return mapped(texts, run, "id long, tokens array<long>").dropDuplicates(["id"])


def _sizes_allow(a: Column, b: Column) -> Column:
    return OF_TEN * F.greatest(a, b) <= 10 * F.least(a, b)


def _places_allow(a: Column, p: Column, b: Column, q: Column) -> Column:
    """For sets of a and b shingles whose first shared one stands at p and q: it and what follows suffices for the index."""
    return (10 + OF_TEN) * F.least(a - p, b - q) >= OF_TEN * (a + b)


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")]


def _possible(pairs: DataFrame, parity: DataFrame) -> DataFrame:
    """The pairs hi, lo that parities leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_rows(batches):
            n, x, m, y = (b.column(i).to_pylist() for i in range(2, 6))
            keep = [may_be_near(np.frombuffer(p, np.uint8), i, np.frombuffer(q, np.uint8), j) for p, i, q, j in zip(x, n, y, m)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["hi", "lo"]).filter(pa.array(keep, pa.bool_()))

    x = parity.select(F.col("id").alias("hi"), F.col("n").alias("n"), F.col("parity").alias("x"))
    y = parity.select(F.col("id").alias("lo"), F.col("n").alias("m"), F.col("parity").alias("y"))
    return mapped(pairs.join(x, "hi").join(y, "lo").select("hi", "lo", "n", "x", "m", "y"), run, "hi long, lo long")


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs hi, lo whose sets have the least index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_rows(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(10 * both >= OF_TEN * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["hi", "lo"]).filter(pa.array(keep, pa.bool_()))

    x = whole.select(F.col("id").alias("hi"), F.col("tokens").alias("x"))
    y = whole.select(F.col("id").alias("lo"), F.col("tokens").alias("y"))
    return mapped(pairs.join(x, "hi").join(y, "lo").select("hi", "lo", "x", "y"), run, "hi long, lo long")


def _across(groups: DataFrame) -> DataFrame:
    """hi, lo of each group's members of different components whose sizes and places allow the index; pairs may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_rows(batches):
            for members in b.column(0):
                n, id_, root, pos = (members.values.field(i).to_numpy() for i in range(4))
                order = np.argsort(n, kind="stable")
                n, id_, root, pos = n[order].astype(np.int64), id_[order], root[order], pos[order]
                ends, rest = np.searchsorted(n, 10 * n // OF_TEN, side="right"), n - pos
                for i, end in enumerate(ends):
                    others = slice(i + 1, end)
                    near = (root[others] != root[i]) & ((10 + OF_TEN) * np.minimum(rest[others], rest[i]) >= OF_TEN * (n[others] + n[i]))
                    other = id_[others][near]
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(other, id_[i])), pa.array(np.minimum(other, id_[i]))], names=["hi", "lo"])

    return mapped(groups, run, "hi long, lo long")


def _covered(sets: DataFrame) -> DataFrame:
    """hi, lo: sets whose SimHashes covering LSH links.  Sets of one fingerprint meet in the least of them."""
    nodes = written(sets.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("node")))
    same = sets.join(nodes, "fp").filter((F.col("id") != F.col("node.id")) & _sizes_allow(F.col("n"), F.col("node.n")))
    ends = simhash.links(nodes.select("fp")).join(nodes.select(F.col("fp").alias("hi"), F.col("node").alias("a")), "hi").join(nodes.select(F.col("fp").alias("lo"), F.col("node").alias("b")), "lo")
    near = ends.filter(_sizes_allow(F.col("a.n"), F.col("b.n"))).select(*_pair(F.col("a.id"), F.col("b.id")))
    return same.select(*_pair(F.col("id"), F.col("node.id"))).union(near)


def links(docs: DataFrame, rows: DataFrame, stars: int = STARS) -> DataFrame:
    """hi, lo: pairs of sets at the least index, with the same components as all such pairs have."""
    posts = rows.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posts.groupBy("token").agg(F.collect_set(F.struct("id", "n", "pos")).alias("m")).filter(F.size("m") > 1)
    posts = written(shared.select("token", F.explode("m").alias("m")).select("token", "m.id", "m.n", "m.pos"))
    # Copies are one set before they meet in a task.
    sets = rows.groupBy("id").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("parity").alias("parity"))
    sets = written(sets.join(posts.select("id").distinct(), "id", "left_semi"))
    tested = found = None
    for step in range(-1, stars + 1):
        placed = posts.withColumn("root", F.col("id"))
        if found is not None:
            roots = components(found).withColumnRenamed("node", "id").withColumnRenamed("root", "_root")
            placed = posts.join(roots, "id", "left").select("token", "id", "n", "pos", F.coalesce("_root", "id").alias("root"))
        if step < 0:
            pairs = _covered(sets)
        elif step < stars:
            order = F.struct(F.when(F.lit(step == 0), F.col("pos")), F.xxhash64("id", F.lit(step)))
            hub = placed.groupBy("token").agg(F.min_by(F.struct("id", "n", "root", "pos"), order).alias("hub"))
            near = placed.join(hub, "token").filter((F.col("root") != F.col("hub.root")) & _sizes_allow(F.col("n"), F.col("hub.n")))
            near = near.filter(_places_allow(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
            pairs = near.select(*_pair(F.col("id"), F.col("hub.id")))
        else:
            groups = placed.groupBy("token").agg(F.collect_list(F.struct("n", "id", "root", "pos")).alias("m"), F.min("root").alias("a"), F.max("root").alias("b"))
            pairs = _across(groups.filter("a <> b").select("m"))
        pairs = pairs.distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["hi", "lo"], "left_anti"))
        near = written(_possible(pairs, sets))
        ends = near.select(F.col("hi").alias("id")).union(near.select("lo")).distinct()
        whole = written(_whole(docs, sets.select("th", "id").join(ends, "id").select("th", "id")))
        near = written(_verified(near, whole))
        tested, found = (pairs, near) if tested is None else (tested.union(pairs), found.union(near))
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id for each row of docs.

    component_id is the smallest doc_id that pairs at the least index lead to, the row's own included.  Equal sets are
    one set before anything is compared; texts without words (or null) all have the empty one.  Null and repeated
    doc_ids as in simhash.near_duplicates.  Other columns than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    rows = written(_sets(docs))
    roots = components(links(docs, rows)).withColumnRenamed("node", "id")
    placed = rows.select("doc_id", "id").join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root"))
    least = written(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))  # a table, so that the join by root may be split
    return placed.join(least, "root").select("doc_id", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; see simhash.keep_smallest."""
    return keep_smallest(docs, near_duplicates(docs))
