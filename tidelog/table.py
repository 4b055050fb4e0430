"""The stored table: a manifest, sorted runs, and a small buffer of single writes on the driver."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.keys import no_empty
from tidelog.model import CHANGE_LOG, STATE, KeyRange
from tidelog.operators import lookup
from tidelog.operators.compaction import merge
from tidelog.operators.resolve import as_of, resolve
from tidelog.plans.cascade import due
from tidelog.sources.manifest import Manifest
from tidelog.sources.runs import read_runs, write_run
from tidelog.sources.store import Store


#: As many keys go into a scan as a list.
FEW = 1000


class Table:
    """Byte keys to non-empty byte values; the last write wins, an empty or null value deletes.

    put() and delete() take DataFrames and are the way to write much; insert() and erase() buffer single rows
    on the driver, up to flush_threshold distinct keys, and then flush.  Readers see the buffer.
    Files lie under the table's path alone.  One writer at a time: a second one's commit fails, and what it wrote lies
    in folders of its own.  Runs that were merged stay until vacuum(), so that readers of older versions can go on.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self.store = Store(spark, self.path)
        self.buffer: dict[bytes, bytes | None] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, flush_threshold: int = 100_000, fanout: int = 10, bloom_fpp: float = 0.05) -> Table:
        if flush_threshold < 1 or fanout < 2 or not 0 < bloom_fpp < 1:
            raise ValueError("flush_threshold >= 1, fanout >= 2 and 0 < bloom_fpp < 1 are required")
        m = Manifest(flush_threshold, fanout, bloom_fpp)
        return cls(spark, path, m.commit(Store(spark, path)))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Table:
        return cls(spark, path, Manifest.load(Store(spark, path)))

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> Table:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()

    # Writes

    def insert(self, key: bytes, value: bytes | None) -> None:
        self.buffer[bytes(key)] = bytes(value) if value else None
        if len(self.buffer) >= self.manifest.flush_threshold:
            self.flush()

    def erase(self, key: bytes) -> None:
        self.insert(key, None)

    def put(self, df: DataFrame, order: str | None = None, compact: bool = True, stream: tuple[str, int] | None = None) -> None:
        """Upserts (and deletions, where value is null or empty) from columns key and value.

        order: which of several rows of one key is the last; without it the greatest value is.  stream: id and batch
        number of a stream, kept in the same commit.
        """
        self.flush()
        rows = df.select("key", no_empty(F.col("value")).alias("value"), (F.col(order) if order else F.lit(0)).alias("_order"))
        w = Window.partitionBy("key").orderBy(F.col("_order").desc(), F.col("value").desc_nulls_last())
        rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
        self._add(rows.select("key", F.lit(self.manifest.next_seq).cast("bigint").alias("seq"), "value"), compact=compact, stream=stream)

    def delete(self, keys: DataFrame, compact: bool = True) -> None:
        """Deletions from column key."""
        self.put(keys.select("key", F.lit(None).cast("binary").alias("value")), compact=compact)

    def delete_range(self, r: KeyRange) -> None:
        self.delete(self.scan(r, ordered=False).select("key"))

    def flush(self) -> None:
        if self.buffer:
            self._add(self._buffered(), len(self.buffer))
            self.buffer = {}

    def _buffered(self) -> DataFrame:
        seq = self.manifest.next_seq
        return self.spark.createDataFrame([(bytearray(k), seq, v and bytearray(v)) for k, v in self.buffer.items()], CHANGE_LOG)

    def _name(self) -> str:
        return f"run-{self.manifest.next_run:08d}-{uuid.uuid4().hex[:8]}"

    def _add(self, log: DataFrame, expected: int | None = None, compact: bool = True, stream: tuple[str, int] | None = None) -> None:
        m, name = self.manifest, self._name()
        log = log if m.runs else log.filter(F.col("value").isNotNull())  # nothing older: deletions delete nothing
        run = write_run(self.spark, log, self.path, name, 0, m.bloom_fpp, expected=expected)
        streams = m.streams | dict([stream] if stream else [])
        self.manifest = m.commit(self.store, next_seq=m.next_seq + 1, next_run=m.next_run + 1, streams=streams, runs=m.runs + ((run,) if run else ()))
        if not run:
            self.store.delete(name)
        if compact:
            while (target := due(self.manifest.counts(), self.manifest.fanout)) is not None:
                self._merge([r for r in self.manifest.runs if r.level < target], target)

    # Compaction

    def compact(self) -> None:
        """Everything into one run without old versions and deletions."""
        self.flush()
        if len(self.manifest.runs) > 1 or any(r.deletions for r in self.manifest.runs):
            self._merge(list(self.manifest.runs), max(1, *(r.level for r in self.manifest.runs)))

    def _merge(self, old: list, target: int) -> None:
        m, gone = self.manifest, {r.name for r in old}
        rest = tuple(r for r in m.runs if r.name not in gone)
        bottom = not any(r.level >= target for r in rest)
        log, name = read_runs(self.spark, self.path, sorted(gone)), self._name()
        run = write_run(self.spark, merge(log, bottom), self.path, name, target, m.bloom_fpp, expected=sum(r.rows for r in old))
        horizon = max(m.horizon, *(r.max_seq for r in old))
        self.manifest = m.commit(self.store, next_run=m.next_run + 1, horizon=horizon, runs=rest + ((run,) if run else ()))
        if not run:
            self.store.delete(name)

    def vacuum(self, versions: int = 1) -> list[str]:
        """Deletes what none of the last so many versions of the table names: runs and manifests.

        Readers that hold plans of older versions, and writers at work on the table, must have ended.
        """
        manifests = [x for x in self.store.names("_manifest") if x.endswith(".json")]
        kept = manifests[-max(1, versions) :]
        live = {r.name for x in kept for r in Manifest.load(self.store, int(x[:-5])).runs} | {r.name for r in self.manifest.runs}
        dead = [x for x in self.store.names("") if x.startswith("run-") and x not in live]
        dead += [f"_manifest/{x}" for x in self.store.names("_manifest") if x not in kept]
        for x in dead:
            self.store.delete(x)
        return dead

    # Reads

    def _runs(self, r: KeyRange | None = None) -> list:
        return [x for x in self.manifest.runs if r is None or r.overlaps(bytes.fromhex(x.low), bytes.fromhex(x.high))]

    def log(self, r: KeyRange | None = None) -> DataFrame:
        """The change log; r leaves out runs whose keys all lie outside it."""
        log = read_runs(self.spark, self.path, [x.name for x in self._runs(r)])
        return log.unionByName(self._buffered()) if self.buffer else log

    def _resolved(self, r: KeyRange | None = None) -> DataFrame:
        """key, value of the range, unordered.

        A run has each key once, so only runs whose key bounds overlap (and the buffer's) are resolved together; a
        run that meets no other is read as it is, without a shuffle.
        """
        r = r or KeyRange()
        spans = [(bytes.fromhex(x.low), bytes.fromhex(x.high), x.name) for x in self._runs(r)]
        if self.buffer:
            spans.append((min(self.buffer), max(self.buffer), None))
        groups, top = [], None
        for low, high, name in sorted(spans, key=lambda s: s[:2]):
            if top is None or low > top:
                groups.append([])
            groups[-1].append(name)
            top = high if top is None else max(top, high)
        inside, parts = r.literal().predicate(F.col("key")), []
        for names in groups:
            log = read_runs(self.spark, self.path, [n for n in names if n])
            log = (log.unionByName(self._buffered()) if None in names else log).filter(inside)
            parts.append((resolve(log, ["key"]) if len(names) > 1 else log.filter(F.col("value").isNotNull())).select("key", "value"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], STATE)

    def state(self) -> DataFrame:
        return self._resolved()

    def find(self, key: bytes) -> bytes | None:
        if key in self.buffer:
            return self.buffer[key]
        r = KeyRange(bytes(key), bytes(key))
        row = lookup.get(self.log(r), bytearray(key)).select("value").first()
        return bytes(row.value) if row else None

    def find_many(self, keys: DataFrame) -> DataFrame:
        """key, found, value for each row of keys.

        Runs that hold none of the keys' span are left out.  FEW keys go into the scan as a list, where statistics and
        Bloom filters of row groups prune.  More are semi-joined with it inside their span, before versions are
        resolved; where they are not few beside the rows of the runs, that join would save nothing and is left out.
        """
        keys = keys.select("key")
        first = keys.limit(FEW + 1).collect()
        if len(first) <= FEW:
            few = sorted({bytes(x.key) for x in first if x.key is not None})
            log = self.log(KeyRange(few[0], few[-1]) if few else KeyRange(b"", b"", False)).filter(F.col("key").isin([bytearray(k) for k in few]))
            return lookup.multi_get(log, keys).select("key", "found", "value")
        edge = keys.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).first()
        r = KeyRange(edge.low and bytes(edge.low), edge.high and bytes(edge.high))
        if 4 * edge.n >= sum(x.rows for x in self._runs(r)):
            hits = self._resolved(r).withColumn("found", F.lit(True))
            return keys.join(hits, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")
        return lookup.multi_get(self.log(r).filter(r.literal().predicate(F.col("key"))), keys).select("key", "found", "value")

    def scan(self, r: KeyRange | None = None, ordered: bool = True) -> DataFrame:
        """key, value ascending by key."""
        out = self._resolved(r)
        return out.orderBy("key") if ordered else out

    def find_range(self, r: KeyRange | None = None) -> dict[bytes, bytes]:
        """The range in the driver's memory, ascending; for small ranges."""
        return {bytes(x.key): bytes(x.value) for x in self.scan(r).collect()}

    def scan_many(self, ranges: DataFrame) -> DataFrame:
        """range_id, key, value of each of many ranges; runs outside the span of all of them are left out."""
        edge = ranges.agg(F.min("lower").alias("low"), F.max("upper").alias("high"), F.count("lower").alias("a"), F.count("upper").alias("b"), F.count(F.lit(1)).alias("n")).first()
        r = KeyRange(bytes(edge.low) if edge.n and edge.a == edge.n else None, bytes(edge.high) if edge.n and edge.b == edge.n else None)
        return lookup.range_join(self._resolved(r), ranges).select("range_id", "key", "value")

    def as_of(self, seq: int) -> DataFrame:
        """The state after the batch of that number; ValueError where compaction has dropped versions of it."""
        if seq < self.manifest.horizon:
            raise ValueError(f"batch {seq} lies before {self.manifest.horizon}, up to which compaction has dropped versions")
        return resolve(as_of(self.log(), "seq", seq), ["key"]).select("key", "value")

    def stats(self) -> DataFrame:
        """A row for each run."""
        rows = [(r.name, r.level, r.rows, r.deletions, r.low, r.high, r.min_seq, r.max_seq) for r in self.manifest.runs]
        return self.spark.createDataFrame(rows, "run string, level int, n_rows long, deletions long, low string, high string, min_seq long, max_seq long")

    def view(self, name: str) -> None:
        """The state as a temporary view for SQL."""
        self.state().createOrReplaceTempView(name)


__all__ = ["STATE", "Table"]
