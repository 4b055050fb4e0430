"""Hierarchical packing into context windows of several lengths.

A document's ids are cut into whole windows of the longest tier; the rest is routed to the shortest tier that
holds it.  Tiers are packed from the longest to the shortest: a document opens a window of its tier, the gap is
filled with the longest waiting documents of shorter tiers that fit, and what then remains of the gap is filled by
cutting the next waiting document, whose rest goes back to wait.  So every window is full, until the documents
that wait cannot fill one; the last of them are laid end to end and cut at powers of two.  Windows of one tier are
then dealt to step groups of as many tokens each.

Every task packs the documents of its input split by itself, in pools of bounded size.  What waits at its end, less
than the shortest tier, is written beside the windows; these ends meet in fewer and fewer tasks, a pool in each, until
one holds the last of them.  So there is no shuffle of texts, and only one window of each size below the shortest tier.

Step groups hold the same number of tokens, all of one tier, whatever tasks they come from: windows are numbered
through over all tasks, from a table of how many each task made, and every group but the last of a tier is full.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import mapped, small_rows, written
from tidelog.llm.tokenizing import encoder, vocabulary

TIERS = (512, 1024, 2048, 4096)
POOL, STEP = 1 << 20, 1 << 16

#: A piece: document number in the task, start, length.
Piece = tuple[int, int, int]


def pack(rests: list[Piece], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows of pieces, each with a power of two as total, and the pieces that wait (none if last).

    rests: pieces of at most the longest tier's length.  Tiers must be ascending powers of two.
    """
    waiting = sorted((n, -doc, -start) for doc, start, n in rests if n)  # by length; of equals, the first document is taken first
    windows, low = [], 0

    def take(limit: int) -> Piece | None:
        """The longest waiting piece of at most limit ids."""
        i = bisect.bisect_left(waiting, (limit + 1,))
        if not i:
            return None
        n, doc, start = waiting.pop(i - 1)
        return -doc, -start, n

    total = sum(x[0] for x in waiting)
    for tier in reversed(tiers):
        low = tier // 2 if tier > tiers[0] else 0
        while total >= tier and waiting[-1][0] > low:
            window, gap = [], tier
            while gap:
                piece = take(gap)
                if piece is None:  # only longer ones wait: cut the shortest
                    n, doc, start = waiting.pop(0)
                    bisect.insort(waiting, (n - gap, doc, start - gap))
                    piece = (-doc, -start, gap)
                window.append(piece)
                gap -= piece[2]
            windows.append(window)
            total -= tier
    rest = sorted((-doc, -start, n) for n, doc, start in waiting)
    if not last:
        return windows, rest
    size = tiers[-1]
    while rest:
        while size > total:
            size //= 2
        window, gap = [], size
        while gap:
            doc, start, n = rest.pop(0)
            if n > gap:
                rest.insert(0, (doc, start + gap, n - gap))
                n = gap
            window.append((doc, start, n))
            gap -= n
        windows.append(window)
        total -= size
    return windows, []


class _Task:
    """Windows and waiting pieces of one task as rows.  A document is known by its number in the task."""

    def __init__(self, kind: pa.DataType, round_: int):
        from pyspark import TaskContext

        self.kind, self.task = kind, (round_ << 20) + TaskContext.get().partitionId()
        #: Document number: doc_id, number of ids, ids, place of the first of them.
        self.docs: dict[int, tuple] = {}
        self.made, self.nth = 0, {}

    def _rows(self, windows: list[list[Piece]], whole: bool) -> pa.RecordBatch:
        cols = [[] for _ in PACKED]
        for window in windows:
            size, offset = sum(p[2] for p in window), 0
            nth = self.nth[size] = self.nth.get(size, -1) + 1 if whole else None
            for doc, start, n in window:
                doc_id, count, ids, first = self.docs[doc]
                own = ids[4 * (start - first) : 4 * (start - first + n)]
                place = ((self.task << 40) + self.made, offset, size, nth) if whole else (None,) * 4
                for c, v in zip(cols, (doc_id, start, n, own, zlib.crc32(own), count, *place, self.task)):
                    c.append(v)
                offset += n
            self.made += whole
        kinds = [self.kind, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=PACKED)

    def rows(self, windows: list[list[Piece]], whole: bool = True, size: int = 2048) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(windows), size):
            yield self._rows(windows[i : i + size], whole)


PACKED = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "nth", "task"]


def _windows(docs: DataFrame, vocab: str, tiers: tuple[int, ...], pool: int, schema: str) -> DataFrame:
    """The windows of each input split, and the pieces that wait at its end (tier null)."""
    top = tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, encode, number, waiting, held = None, encoder(vocab).encode, 0, [], 0
        for b in small_rows(batches, 64):
            task = task or _Task(b.column(0).type, 0)
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = encode(text)
                n = len(own) // 4
                task.docs[number] = (doc_id, n, own, 0)
                full = n // top * top
                for i in range(0, full, 256 * top):
                    yield from task.rows([[(number, s, top)] for s in range(i, min(full, i + 256 * top), top)])
                if n > full:
                    waiting.append((number, full, n - full))
                    held += n
                else:
                    del task.docs[number]
                number += 1
                if held >= pool:
                    windows, waiting = pack(waiting, tiers, last=False)
                    yield from task.rows(windows)
                    task.docs = {doc: task.docs[doc] for doc, _, _ in waiting}
                    held = sum(n for _, _, n in waiting)
        if waiting:
            windows, waiting = pack(waiting, tiers, last=False)
            yield from task.rows(windows)
            yield from task.rows([[p] for p in waiting], whole=False)

    return mapped(docs.select("doc_id", "text"), run, schema)


def _ends(waiting: DataFrame, tiers: tuple[int, ...], round_: int, last: bool, schema: str) -> DataFrame:
    """The windows of each partition of waiting pieces, and the pieces that wait on (none if last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rests = None, []
        for b in batches:
            task = task or _Task(b.column(0).type, round_)
            for doc_id, start, n, ids, _, count, *_ in zip(*(c.to_pylist() for c in b.columns)):
                rests.append((len(task.docs), start, n))
                task.docs[len(task.docs)] = (doc_id, count, ids, start)
        if rests:
            windows, rests = pack(rests, tiers, last)
            yield from task.rows(windows)
            yield from task.rows([[p] for p in rests], whole=False)

    return mapped(waiting, run, schema)


def pack_documents(docs: DataFrame, vocabulary_path: str | None = None, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens,
    sequence_id, offset, tier (the window's length) and step_group.

    Every row of docs is a document of its own, repeated or not; null text is an empty one, of the end id alone; a
    null doc_id is carried along; an empty docs gives no rows.  pool: ids that wait in a task at most before windows are
    made.  step: tokens of a step group, a multiple of the longest tier.  Other columns are not read.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) or t < 1 for t in tiers) or step % tiers[-1] or pool < 2 * tiers[0]:
        raise ValueError("tiers must be ascending powers of two, step a multiple of the longest, pool twice the shortest at least")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, nth long, task long"
    packed = written(_windows(docs, vocabulary_path or vocabulary(), tiers, pool, schema))
    done, round_ = packed.filter("tier IS NOT NULL"), 0
    while True:
        tokens = packed.filter("tier IS NULL").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if not tokens:
            break
        parts, round_ = -(-tokens // pool), round_ + 1
        waiting = packed.filter("tier IS NULL")
        waiting = waiting.repartition(1) if parts == 1 else waiting.repartition(parts, "task")
        packed = written(_ends(waiting, tiers, round_, parts == 1, schema))
        done = done.unionByName(packed.filter("tier IS NOT NULL"))
    made = done.groupBy("task", "tier").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tier").orderBy("task")) - F.col("n")
    firsts = made.select("task", "tier", before.alias("first"))  # a row for each task and tier
    group = (F.col("tier") * (1 << 32) + F.floor((F.col("first") + F.col("nth")) * F.col("tier") / step)).cast("bigint")
    return done.join(F.broadcast(firsts), ["task", "tier"]).withColumn("step_group", group).select(*NAMES)


NAMES = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
