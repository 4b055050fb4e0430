"""Exact line dedup across documents, reversible: sharded cuckoo filters backed by reference counts.

A line's key is the line stripped of ASCII white space and A-Z lower-cased; keys of fewer than MIN_CHARS code
points are left alone.  Of a key that several documents hold, the document with the smallest doc_id keeps its lines
and the others lose theirs.

The exact table has a row for each key and the documents that hold it: references, smallest and largest doc_id.
Keys of two documents or more are *shared*; each shard of the key space has a cuckoo filter of its shared keys.
Lines are tested against the filters, and only those that may be shared are joined with the exact table, which drops
the filters' false positives.  Small filters are sent to where the lines are read; larger ones and lines meet by shard.  When documents come or go, counts are added or taken off,
and keys that become shared, or cease to be, are inserted into or deleted from the filters of their shards; what is
not touched is neither shuffled nor written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidelog.llm.common import mapped, packed, prepare, written
from tidelog.llm.cuckoo import CuckooFilter

MIN_CHARS, SHARD_KEYS, FILTER_BYTES = 10, 20_000, 32 << 20
#: Keys with more than one in HOT of all references are hot: there are fewer than HOT, so they may be broadcast.
HOT = 100_000

#: Stand for a null doc_id, of a number or of anything else (told apart as text): such rows are one document, larger
#: than any other.  A doc_id of just this value is taken for null.
NO_ID, NO_NAME = 2**63 - 1, "\U0010ffff" * 2
RESULTS = ("kept_text", "n_lines", "n_dropped")
#: spark.sql and DuckDB: a translation of A-Z alone.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit("\x20\t\n\x0b\x0c\r")), _UPPER, _LOWER)


def _id(docs: DataFrame) -> Column:
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_NAME))


def _keyed(docs: DataFrame, min_chars: int, text_key: Column) -> DataFrame:
    """id, tk, line, hi, lo: the lines that count, by two 64-bit hashes of their keys, seeded apart."""
    lines = docs.select(_id(docs).alias("id"), text_key.alias("tk"), F.posexplode(split_lines(F.col("text"))).alias("line", "s"))
    key = lines.select("id", "tk", "line", line_key(F.col("s")).alias("k")).filter(F.char_length("k") >= min_chars)
    return key.select("id", "tk", "line", F.xxhash64("k").alias("hi"), F.xxhash64(F.lit(1), "k").alias("lo"))


def references(lines: DataFrame) -> DataFrame:
    """hi, lo, refs, least, most: the exact table.  refs: lines with the key."""
    return lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.min("id").alias("least"), F.max("id").alias("most"))


def _shards(n_keys: int) -> int:
    n = 1
    while n * SHARD_KEYS < n_keys:
        n *= 2
    return n


def _shard(shards: int) -> Column:
    return F.pmod(F.col("lo"), F.lit(shards)).cast("int")


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    """shard, data: a filter for each shard of distinct keys hi, lo; a task holds the keys of one shard, which the
    choice of shards bounds."""

    def build(key, table):
        keys = np.sort(table.column("hi").to_numpy()).view(np.uint64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([CuckooFilter.of(np.unique(keys)).dump()], pa.binary())})

    prepare(shared.sparkSession)
    return shared.select(_shard(shards).alias("shard"), "hi").groupBy("shard").applyInArrow(build, "shard int, data binary")


def _hot(keys: DataFrame) -> DataFrame:
    """The hot ones of keys (refs and other columns, a row for each key), fewer than HOT."""
    total = keys.agg(F.sum("refs")).first()[0] or 0
    return keys.filter(F.col("refs") * HOT > total)


def may_be_shared(lines: DataFrame, filters: DataFrame, shards: int, hot: DataFrame | None = None) -> DataFrame:
    """The lines that pass their shard's filter.  Filters of FILTER_BYTES or less are sent to the lines; else both are
    brought together by shard (hot: hi, lo of the lines' hot keys, if known; see _meet)."""
    size = filters.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    if size > FILTER_BYTES:
        return _meet(lines, filters, shards, hot)
    rows = filters.collect()  # at most FILTER_BYTES
    sent = lines.sparkSession.sparkContext.broadcast({r.shard: bytes(r.data) for r in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: CuckooFilter.load(v) for k, v in sent.value.items()}
        for b in batches:
            hi, lo = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("hi", "lo"))
            shard, keep = lo % shards, np.zeros(b.num_rows, dtype=bool)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order])) + 1
            for own in np.split(order, edges) if len(order) else []:
                if (table := tables.get(int(shard[own[0]]))) is not None:
                    keep[own] = table.contains(hi[own].view(np.uint64))
            if keep.any():
                yield b.filter(pa.array(keep))

    return mapped(lines, run, lines.schema)


def _meet(lines: DataFrame, filters: DataFrame, shards: int, hot: DataFrame | None) -> DataFrame:
    """may_be_shared() for filters of any size: each shard's filter, then its lines, stream through one task, which holds
    one filter at a time.  Lines of hot keys, which would crowd a shard, stay where they are and pass untested."""
    if hot is None:
        hot = _hot(lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs")))
    hot = F.broadcast(written(hot.select("hi", "lo")))  # fewer than HOT
    names = lines.columns
    tested = lines.join(hot, ["hi", "lo"], "left_anti").select(*names, _shard(shards).alias("shard"), F.lit(None).cast("binary").alias("data"))
    blank = [F.lit(0).cast(f.dataType).alias(f.name) for f in lines.schema]
    first = filters.select(*blank, "shard", "data")
    ordered = tested.union(first).repartition("shard").sortWithinPartitions("shard", F.col("data").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table = None
        for b in batches:
            hi, shard, data = b.column(names.index("hi")).to_numpy().view(np.uint64), b.column(len(names)).to_numpy(), b.column(len(names) + 1)
            keep, heads = np.zeros(b.num_rows, dtype=bool), np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for start, end in zip([-1, *heads], [*heads, b.num_rows]):
                if start >= 0:
                    own, table = shard[start], CuckooFilter.load(data[start].as_py())
                rows = slice(start + 1, end)
                if table is not None:
                    keep[rows] = (shard[rows] == own) & table.contains(hi[rows])
            if keep.any():
                yield b.select(names).filter(pa.array(keep))

    return mapped(ordered, run, lines.schema).union(lines.join(hot, ["hi", "lo"], "left_semi").select(*names))


def drops(lines: DataFrame, table: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """id, tk, lines: the numbers of the lines that each document loses.  table is one that is written."""
    shared = table.filter("least <> most")
    return lost_lines(may_be_shared(lines, filters, shards, _hot(shared)), shared)


def lost_lines(lines: DataFrame, table: DataFrame) -> DataFrame:
    """drops() without the filters.  Lines of hot keys get the least document by broadcast, and are spread over the tasks
    of the join that the others need."""
    shared = table.filter("least <> most")
    hot = F.broadcast(_hot(shared).select("hi", "lo", F.col("least").alias("hot_least")))  # fewer than HOT
    known = lines.join(hot, ["hi", "lo"], "left").withColumn("at", F.when(F.col("hot_least").isNull(), F.col("hi")).otherwise(F.xxhash64("id", "line")))
    others = shared.select(F.col("hi").alias("at"), F.col("lo").alias("lo2"), "least")
    same = (known["at"] == others["at"]) & (known["lo"] == others["lo2"]) & known["hot_least"].isNull()
    lost = known.join(others, same, "left").filter(F.col("id") != F.coalesce("hot_least", "least"))
    return lost.groupBy("id", "tk").agg(F.collect_set("line").alias("lines"))


def _text_key() -> Column:
    """Tells rows that repeat a doc_id apart; rows with equal texts lose equal lines."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def apply_drops(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs with kept_text, n_lines, n_dropped."""
    keyed = docs.select(packed(docs, RESULTS).alias("own"), _id(docs).alias("id"), _text_key().alias("tk"))
    out = keyed.join(lost.withColumnRenamed("lines", "lost"), ["id", "tk"], "left")
    text = F.coalesce("own.text", F.lit(""))
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    stay = F.array_except(F.sequence(F.lit(0), n - 1), "lost")
    # One array of one array, so that the lines are cut once and not for each index.
    kept = F.transform(F.array(split_lines(text)), lambda cut: F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n"))[0]
    kept = F.when(F.col("lost").isNull(), text).otherwise(kept)
    results = F.struct(kept.alias("kept_text"), n.cast("bigint").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"))
    return out.select("own", results.alias("results")).select("own.*", "results.*")


class LineIndex:
    """The exact table and its filters; insert() and delete() give a new index, and dedup() reads it.

    For deletions the index keeps who holds what (postings: hi, lo, id, refs), so that the smallest doc_id of a key is
    right again when its document has gone.  They lie in segments: each insertion or deletion appends one, of references
    added or taken off, and compact() makes one of them.  A change scans the segments for its own keys (a semi-join,
    broadcast while the change is small), counts these anew and edits the filters of their shards.  Rows with null doc_ids
    are one document; null and empty texts hold no key.
    """

    def __init__(self, segments: list[DataFrame], filters: DataFrame, shards: int, min_chars: int):
        self.segments, self.filters, self.shards, self.min_chars = segments, filters, shards, min_chars

    @staticmethod
    def _posted(docs: DataFrame, min_chars: int) -> DataFrame:
        return _keyed(docs, min_chars, F.lit(0)).groupBy("hi", "lo", "id").agg(F.count(F.lit(1)).alias("refs"))

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineIndex:
        postings = written(cls._posted(docs, min_chars))
        shared = written(cls._shared(cls._table(postings)))
        shards = _shards(shared.count())
        return cls([postings], written(build_filters(shared, shards)), shards, min_chars)

    @staticmethod
    def _held(segments: list[DataFrame], keys: DataFrame | None = None) -> DataFrame:
        """hi, lo, id, refs of all segments together; keys: only of the keys in hi there."""
        every = None
        for s in segments:
            s = s if keys is None else s.join(keys, "hi", "left_semi").select("hi", "lo", "id", "refs")
            every = s if every is None else every.unionByName(s)
        return every.groupBy("hi", "lo", "id").agg(F.sum("refs").alias("refs")).filter("refs > 0") if len(segments) > 1 else every

    @staticmethod
    def _table(postings: DataFrame) -> DataFrame:
        return postings.groupBy("hi", "lo").agg(F.sum("refs").alias("refs"), F.min("id").alias("least"), F.max("id").alias("most"))

    @staticmethod
    def _shared(table: DataFrame) -> DataFrame:
        return table.filter("least <> most").select("hi", "lo")

    @property
    def postings(self) -> DataFrame:
        return self._held(self.segments)

    @property
    def table(self) -> DataFrame:
        return self._table(self.postings)

    def compact(self) -> LineIndex:
        return LineIndex([written(self.postings)], self.filters, self.shards, self.min_chars)

    def _changed(self, change: DataFrame) -> LineIndex:
        """With one more segment; the filters of the shards with changed keys are edited by inserting and deleting."""
        segments, shards = [*self.segments, change], self.shards
        # By hi alone, as filters tell keys by it: a key goes only when no shared key of that half is left in the shard.
        touched = written(change.select("hi").distinct())
        old = self._shared(self._table(self._held(self.segments, touched))).select("hi", _shard(shards).alias("shard")).distinct()
        new = self._shared(self._table(self._held(segments, touched))).select("hi", _shard(shards).alias("shard")).distinct()
        states = old.withColumn("was", F.lit(1)).withColumn("is", F.lit(0)).union(new.withColumn("was", F.lit(0)).withColumn("is", F.lit(1)))
        edits = written(states.groupBy("shard", "hi").agg(F.max("was").alias("was"), F.max("is").alias("is")).filter("was <> is").select("shard", "hi", (F.col("is") == 1).alias("add")))

        def edit(key, filters, changes):
            add = changes.column("add").to_numpy(zero_copy_only=False)
            keys = changes.column("hi").to_numpy().view(np.uint64)
            f = CuckooFilter.load(filters.column("data")[0].as_py()) if filters.num_rows else CuckooFilter(SHARD_KEYS)
            f.delete(np.sort(keys[~add]))
            data = f.dump() if f.insert(np.sort(keys[add])) else b""
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

        own = edits.select("shard").distinct()
        edited = self.filters.join(own, "shard", "left_semi").groupBy("shard").cogroup(edits.groupBy("shard")).applyInArrow(edit, "shard int, data binary")
        filters = written(self.filters.join(own, "shard", "left_anti").unionByName(edited))
        if filters.filter("length(data) = 0").limit(1).count():  # a shard is full: more shards
            shared = written(self._shared(self._table(self._held(segments))))
            shards = _shards(2 * shared.count())
            filters = written(build_filters(shared, shards))
        return LineIndex(segments, filters, shards, self.min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With new documents, whose ids the index must not have yet."""
        return self._changed(written(self._posted(docs, self.min_chars)))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of column doc_id; ids that the index does not have change nothing."""
        gone = ids.select(_id(ids).alias("id")).distinct()
        held = self.postings.join(gone, "id", "left_semi")
        return self._changed(written(held.select("hi", "lo", "id", (-F.col("refs")).alias("refs"))))

    def dedup(self, docs: DataFrame) -> DataFrame:
        """docs (all of them in the index) with kept_text, n_lines, n_dropped; references are read of those keys alone
        that pass the filters."""
        lines = written(may_be_shared(_keyed(docs, self.min_chars, _text_key()), self.filters, self.shards))
        table = written(self._table(self._held(self.segments, lines.select("hi").distinct())))
        return apply_drops(docs, lost_lines(lines, table))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with kept_text, n_lines (before dropping), n_dropped, in one batch.

    Null or empty text: one empty line, kept.  Rows with a null doc_id are one document, larger than all others.
    Rows that repeat a doc_id belong to one document: its lines do not make a key shared.  An empty docs gives no rows.
    All other columns are carried along; those that bear a result's name are replaced.
    """
    lines = written(_keyed(docs, min_chars, _text_key()))
    table = written(references(lines).filter("least <> most"))
    shards = _shards(table.count())
    filters = written(build_filters(table, shards))
    return apply_drops(docs, drops(lines, table, filters, shards))


SQL = f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
 keyed AS (SELECT doc_id, s, i, translate(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM lines),
 shared AS (SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING min(doc_id) <> max(doc_id)),
 marked AS (SELECT keyed.*, shared.k IS NOT NULL AND least <> doc_id AS lost FROM keyed LEFT JOIN shared USING (k))
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


