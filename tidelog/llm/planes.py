"""Bit-plane shuffled token files.

A block of up to BLOCK ids is transposed into its 4 byte planes or 32 bit planes, and each plane that is not all
zero is compressed with zstandard.  Byte planes are the default: on word BPE ids they took 1.34 bytes an id and bit
planes 1.55, in a seventh of the time.  A block's bytes are a header (magic, kind, number of ids, a length for each
plane) and the planes.  A chunk index tells each block's place in the stream of all ids.

The blocks of a store lie in Parquet files, as binary rows, so that Spark's committer makes writes whole, lost
tasks are run again, and any file system that Spark reaches will do:

    rows/    part, chunk, n_ids, payload    the blocks; parts are consecutive ranges of doc_id
             part, doc_id, row, at, n_ids   the documents (payload null); at: ids before the document inside its part
    parts/   part, first                    ids before the part
    index/   part, chunk, first, n_ids, bytes
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import mapped, shared_folder, small_rows, written
from tidelog.llm.tokenizing import encoder, vocabulary

BLOCK, LEVEL, MAGIC = 65_536, 3, b"BPS1"


def pack(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> bytes:
    """A block of ids as bytes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0, bitorder="little").T
    elif kind == "byte":
        planes = raw.T
    else:
        raise ValueError("kind must be bit or byte")
    z = zstandard.ZstdCompressor(level=level)
    parts = [z.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]
    return MAGIC + struct.pack(f"<BI{len(parts)}I", kind == "byte", len(raw), *map(len, parts)) + b"".join(parts)


def unpack(block: bytes) -> np.ndarray:
    """The ids of a block."""
    if block[:4] != MAGIC:
        raise ValueError("no token block")
    byte, n = struct.unpack_from("<BI", block, 4)
    count = 4 if byte else 32
    lengths, at, z = struct.unpack_from(f"<{count}I", block, 9), 9 + 4 * count, zstandard.ZstdDecompressor()
    width = n if byte else (n + 7) // 8
    planes = np.zeros((count, width), dtype=np.uint8)
    for i, length in enumerate(lengths):
        if length:
            planes[i] = np.frombuffer(z.decompress(block[at : at + length], max_output_size=width), dtype=np.uint8)
            at += length
    raw = planes.T if byte else np.packbits(np.unpackbits(planes.T, axis=0, count=n, bitorder="little"), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class TokenStore:
    """A written store; ids(), documents, index and digests() read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def blocks(self) -> DataFrame:
        return self._read("rows").filter("payload IS NOT NULL").select("part", "chunk", "n_ids", "payload")

    @property
    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before), n_tokens, and part, at."""
        docs = self._read("rows").filter("payload IS NULL").select("part", "doc_id", "row", "at", F.col("n_ids").alias("n_tokens"))
        return docs.join(self._read("parts"), "part").withColumn("start", F.col("first") + F.col("at")).drop("first")

    @property
    def index(self) -> DataFrame:
        """The chunk index: part, chunk, first (the block's first id in the whole stream), n_ids, bytes."""
        return self._read("index")

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at places first to last - 1 of the whole stream, for ranges that the driver can hold.

        The chunk index names the blocks; only these are read (by part and chunk) and decompressed.
        """
        found = self.index.filter((F.col("first") < last) & (F.col("first") + F.col("n_ids") > first))
        places = {(r.part, r.chunk): r.first for r in found.select("part", "chunk", "first").collect()}  # a row for each block of the range
        if not places:
            return np.zeros(0, dtype="<u4")
        wanted = F.broadcast(found.select("part", "chunk"))
        near = self.blocks.filter(F.col("part").isin(sorted({p for p, _ in places}))).join(wanted, ["part", "chunk"], "left_semi")
        rows = sorted(near.select("part", "chunk", "payload").collect(), key=lambda r: places[r.part, r.chunk])
        out = [unpack(r.payload)[max(0, first - at) : max(0, last - at)] for r in rows for at in [places[r.part, r.chunk]]]
        return np.concatenate(out)

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, from the blocks: each is decompressed once, beside the list of the
        document pieces that lie in it (no more than its ids); a document's pieces are joined by their checksums."""
        block = F.floor(F.col("at") / BLOCK)
        last = F.floor((F.col("at") + F.col("n_tokens") - 1) / BLOCK)
        pieces = self.documents.select("part", "doc_id", "row", "start", "n_tokens", "at", F.explode(F.sequence(block, last)).alias("chunk"))
        low = F.greatest("at", F.col("chunk") * BLOCK) - F.col("chunk") * BLOCK
        high = F.least(F.col("at") + F.col("n_tokens"), (F.col("chunk") + 1) * BLOCK) - F.col("chunk") * BLOCK
        pieces = pieces.select("part", "chunk", F.struct("doc_id", "row", "start", "n_tokens", low.cast("int").alias("low"), high.cast("int").alias("high")).alias("p"))
        lists = pieces.groupBy("part", "chunk").agg(F.collect_list("p").alias("ps"))
        kind = self._read("rows").schema["doc_id"].dataType.simpleString()
        sums = mapped(self.blocks.join(lists, ["part", "chunk"]).select("part", "chunk", "payload", "ps"), _piece_sums, f"part int, row long, doc_id {kind}, start long, n_tokens long, chunk long, n long, crc long")
        sums = written(sums)
        whole = sums.filter("n = n_tokens").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
        parts = sums.filter("n < n_tokens").groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("chunk", "n", "crc"))).alias("ps"))
        joined = mapped(parts.select("doc_id", "start", "n_tokens", "ps"), _join_sums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
        return whole.unionByName(joined)


def _piece_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_rows(batches, 8):
        for r in b.to_pylist():
            ids, ps = unpack(r["payload"]), r["ps"]
            out = {k: [p[k] for p in ps] for k in ("row", "doc_id", "start", "n_tokens")}
            crc = [zlib.crc32(ids[p["low"] : p["high"]]) for p in ps]
            arrays = [pa.array([r["part"]] * len(ps), pa.int32()), pa.array(out["row"], pa.int64()), pa.array(out["doc_id"], b.schema.field("ps").type.value_type.field("doc_id").type), pa.array(out["start"], pa.int64()), pa.array(out["n_tokens"], pa.int64())]
            arrays += [pa.array([r["chunk"]] * len(ps), pa.int64()), pa.array([p["high"] - p["low"] for p in ps], pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "row", "doc_id", "start", "n_tokens", "chunk", "n", "crc"])


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def join_crc32(first: int, second: int, length: int) -> int:
    """crc32(a + b) from crc32(a), crc32(b) and len(b): the first is carried over length zero bytes, a linear map
    over single bits whose powers come by squaring."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    bits = 8 * length
    while bits:
        if bits & 1:
            first = _times(step, first)
        step = [_times(step, x) for x in step]
        bits >>= 1
    return first ^ second


def _join_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = []
        for ps in b.column(3).to_pylist():
            crc = ps[0]["crc"]
            for p in ps[1:]:
                crc = join_crc32(crc, p["crc"], 4 * p["n"])
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str | None = None, vocabulary_path: str | None = None, parts: int | None = None, kind: str = "byte") -> TokenStore:
    """Encodes the whole texts of docs (null: empty) in ascending doc_id order, nulls first, into a store.

    One shuffle deals the documents to ranges of doc_id (repeated ones by their text), and each range is encoded
    and written as a stream of its own, block by block.  An empty docs gives a store without rows.  Other columns
    are not read.
    """
    spark, vocab = docs.sparkSession, vocabulary_path or vocabulary()
    path = path or shared_folder(spark)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(vocab).encode
        schema, held, size, chunk, at, row = None, [], 0, 0, 0, 0

        def blocks(all_of_it: bool) -> Iterator[tuple[int, bytes]]:
            nonlocal held, size
            joined = b"".join(held)
            cut = len(joined) if all_of_it else len(joined) - len(joined) % (4 * BLOCK)
            for i in range(0, cut, 4 * BLOCK):
                ids = np.frombuffer(joined[i : min(cut, i + 4 * BLOCK)], dtype="<u4")
                yield len(ids), pack(ids, kind)
            held, size = [joined[cut:]], len(joined) - cut

        def chunks(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            for n, payload in found:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, schema), pa.nulls(1, pa.int64()), pa.array([chunk], pa.int64()), pa.nulls(1, pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], names=names)
                chunk += 1

        names = ["part", "doc_id", "row", "chunk", "at", "n_ids", "payload"]
        for b in small_rows(batches, 32):
            schema, ats, counts = b.schema.field("doc_id").type, [], []
            for text in b.column(1).to_pylist():
                ids = encode(text)
                held.append(ids)
                size += len(ids)
                ats.append(at)
                counts.append(len(ids) // 4)
                at += len(ids) // 4
                if size >= 4 * BLOCK:
                    yield from chunks(blocks(False))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), b.column(0), pa.array(range(row, row + n), pa.int64()), pa.nulls(n, pa.int64()), pa.array(ats, pa.int64()), pa.array(counts, pa.int64()), pa.nulls(n, pa.binary())], names=names)
            row += n
        if size:
            yield from chunks(blocks(True))

    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    dealt = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    mapped(dealt, run, f"part int, doc_id {doc_kind}, row long, chunk long, at long, n_ids long, payload binary").write.parquet(f"{path}/rows")
    store = TokenStore(spark, path)
    # One row for each part, so the driver may add them up.
    totals = {r.part: r.n for r in store.blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, starts = 0, []
    for part in sorted(totals):
        starts.append((part, first))
        first += totals[part]
    spark.createDataFrame(starts, "part int, first long").coalesce(1).write.parquet(f"{path}/parts")
    blocks = store.blocks.select("part", "chunk", "n_ids", F.length("payload").alias("bytes"))
    index = blocks.join(store._read("parts"), "part").select("part", "chunk", (F.col("first") + F.col("chunk") * BLOCK).alias("first"), "n_ids", "bytes")
    index.write.parquet(f"{path}/index")
    return store
