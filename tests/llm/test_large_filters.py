"""Line dedup beyond the size at which filters are sent to the lines, and with hot lines."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import slow_lines
from tidelog.llm import linededup


@pytest.fixture
def data():
    """Lines of one, two and many documents; one line in all of them; one often in a single document."""
    rnd = random.Random(21)
    out = []
    for d in range(60):
        lines = ["a line that every document has", *(f"line number {rnd.randrange(400)} of a pool" for _ in range(8)), f"alone in {d} of them"]
        rnd.shuffle(lines)
        out.append((d, "\n".join(lines)))
    out.append((60, "\n".join(["many times, but here alone"] * 300)))
    return [*out, (None, "a line that every document has"), (None, None), (5, out[5][1])]


@pytest.fixture
def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string").repartition(4)


def results(out):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())


@pytest.mark.parametrize("filter_bytes, hot", [(0, 1), (0, 50), (32 << 20, 50), (32 << 20, 100_000)])
def test_hot_lines_and_large_filters_change_no_result(frame, data, monkeypatch, filter_bytes, hot):
    monkeypatch.setattr(linededup, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 16)
    monkeypatch.setattr(linededup, "HOT", hot)
    assert results(linededup.dedup(frame)) == slow_lines(data)


def test_string_ids_with_large_filters(frame, data, monkeypatch):
    monkeypatch.setattr(linededup, "FILTER_BYTES", 0)
    monkeypatch.setattr(linededup, "HOT", 50)
    named = frame.withColumn("doc_id", F.format_string("d%03d", "doc_id")).filter("text is not null and doc_id <> 'dnull'")
    want = Counter({(f"d{d:03d}", *rest): n for (d, *rest), n in slow_lines([r for r in data if r[0] is not None]).items()})
    assert results(linededup.dedup(named)) == want


def test_index_with_large_filters(frame, data, monkeypatch):
    monkeypatch.setattr(linededup, "FILTER_BYTES", 0)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 16)
    monkeypatch.setattr(linededup, "HOT", 50)
    assert results(linededup.LineIndex.build(frame).dedup(frame)) == slow_lines(data)


def test_filters_that_meet_lines_by_shard_hold_back_what_the_others_do(frame, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 16)
    lines = linededup.written(linededup._keyed(frame, 10, F.lit(0)))
    table = linededup.written(linededup.references(lines).filter("least <> most"))
    shards = linededup._shards(table.count())
    filters = linededup.written(linededup.build_filters(table, shards))
    assert shards > 8
    rows = lambda: Counter(map(tuple, linededup.may_be_shared(lines, filters, shards, table.limit(0)).collect()))
    sent = rows()
    monkeypatch.setattr(linededup, "FILTER_BYTES", 0)
    assert rows() == sent and sum(sent.values()) < lines.count() - 300
