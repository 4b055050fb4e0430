"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link if they differ in at most RADIUS bits.  Each bit position gets a fixed vector of
RADIUS + 1 bits; each of the 2^(RADIUS + 1) - 1 nonzero vectors v is a table, whose mask has the positions with an
odd product with v.  RADIUS differing positions span less than the whole space, so some v is orthogonal to them
all: in that table both fingerprints have the same masked value.  No linked pair is missed.

Buckets of more than BUCKET distinct fingerprints are split by the same construction with other vectors, which
again loses no pair; after the third split at most a few bits are free, which bounds a bucket by itself.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import mapped, packed, raw, small_rows, written
from tidelog.llm.graph import components

BITS, RADIUS, SHINGLE, SEED, BUCKET, SPLITS = 64, 3, 3, 42, 64, 3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(p, SEED) for p in parts), dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (a signed BIGINT) for each row, in a pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_rows(batches):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", raw().alias("t")), run, f"doc_id {kind}, fp long")


def masks(radius: int = RADIUS, split: int = 0) -> list[int]:
    """The signed masks of one family; families differ in how the vectors are dealt to the positions."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    random.Random(split).shuffle(vectors)
    out = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, top)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def _literal(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values))


def _near(a: Column, b: Column, radius: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, splits: int = SPLITS) -> DataFrame:
    """hi, lo: all pairs of the distinct fingerprints fp within the radius (a pair may come more than once)."""
    found = None
    level = nodes.select("fp", F.lit(0).cast("bigint").alias("mask"), F.lit(0).alias("path"))
    for split in range(splits):
        family = masks(radius, split)
        keyed = level.select("fp", "mask", "path", F.posexplode(_literal(family)).alias("table", "own"))
        keyed = keyed.select("fp", F.col("mask").bitwiseOR(F.col("own")).alias("mask"), (F.col("path") * len(family) + F.col("table")).alias("path"))
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        size = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1")
        size = written(size)
        two = size.filter("n = 2").select("hi", "lo").filter(_near(F.col("hi"), F.col("lo"), radius))
        last = split == splits - 1
        members = keyed.join(size.filter("n > 2").select("path", "key", "n"), ["path", "key"])
        groups = members.filter(F.lit(last) | (F.col("n") <= bucket)).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        pairs = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & _near(a, b, radius)), lambda b: F.struct(b.alias("hi"), a.alias("lo")))))
        near = groups.select(F.explode(pairs).alias("p")).select("p.hi", "p.lo")
        found = two.union(near) if found is None else found.union(two).union(near)
        if last or not size.filter(F.col("n") > bucket).limit(1).count():
            return found
        level = written(members.filter(F.col("n") > bucket).select("fp", "mask", "path"))
    raise AssertionError


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    component_id is the smallest doc_id that links lead to, the row's own included.  Copies meet as one
    fingerprint before anything is compared.  Null or empty text: fingerprint zero, linked like any other.  Null
    doc_id: a row like any other, but never the smallest (component_id is null where a component has no other).
    Repeated rows stay repeated.  Other columns of docs are not read.
    """
    rows = written(fingerprints(docs, shingle))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    label = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_smallest(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """docs without the documents whose component (placed: doc_id, component_id) has a smaller doc_id.

    Of rows that repeat the kept doc_id one stays (the one with the smallest text); rows whose component has no
    doc_id at all stay.
    """
    found = placed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("n"))
    found = written(found.filter("least <> doc_id OR n > 1"))
    rows = docs.select(packed(docs).alias("own"))
    kept = rows.filter("own.doc_id IS NOT NULL").join(found.filter("least <> doc_id").select("doc_id"), F.col("own.doc_id") == F.col("doc_id"), "left_anti")
    if found.filter("least = doc_id AND n > 1").limit(1).count():
        others = [F.col("own").getField(c) for c in docs.columns if c not in ("doc_id", "text")]
        w = Window.partitionBy("own.doc_id").orderBy(F.col("own.text").asc_nulls_first(), *others)
        kept = kept.withColumn("row", F.row_number().over(w)).filter("row = 1").drop("row")
    return kept.unionByName(rows.filter("own.doc_id IS NULL")).select("own.*")


def dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id, as keep_smallest says."""
    return keep_smallest(docs, near_duplicates(docs, shingle, radius))
