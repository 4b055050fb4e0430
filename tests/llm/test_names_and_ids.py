"""Columns of docs that bear inner names or results' names, doc_ids that are strings, and a changing line index."""

import random
from collections import Counter

import pytest
from conftest import prose
from test_operators import slow_lines
from tidelog.llm import linededup, mixing, quality, simhash

NAMES = ["_n", "_s", "_h", "_b", "_x", "_id", "_tk", "_lid", "_ltk", "_lost", "_kept", "_row", "own", "rest", "row", "words", "part", "cut", "id", "tk", "lost", "least", "n", "hi", "lo", "line", "fp", "root", "a.b", "it`s"]
RESULTS = ["kept_text", "n_lines", "n_dropped", "size", "taken", "target", "source_size", "kept", "n_words"]


@pytest.fixture(scope="module")
def named(spark):
    rnd = random.Random(60)
    base = prose(rnd, 80)
    texts = [base, base, base + " more", prose(rnd, 60), prose(rnd, 60) + "\nshared line of two documents", prose(rnd, 60) + "\nshared line of two documents", "", None]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES + RESULTS)
    data = [(i, t, f"s{i % 2}", len(t or ""), *(f"{n} {i}" for n in NAMES + RESULTS)) for i, t in enumerate(texts)]
    return spark.createDataFrame([*data, data[3]], schema).cache()


def kept_names(df, without=()):
    found = {c: {(r.doc_id, r[c]) for r in df.collect()} for c in NAMES + RESULTS if c not in without}
    return all(v == f"{c} {i}" for c, rows in found.items() for i, v in rows)


def test_clashing_columns_are_carried(named):
    for out, own in ((linededup.dedup(named), linededup.RESULTS), (mixing.mix(named), mixing.RESULTS), (quality.judge(named, quality.Field.untrained()), quality.RESULTS)):
        assert Counter(out.columns) == Counter({*named.columns, *own}) and out.count() == 9 and kept_names(out, own)
    for out in (simhash.dedup(named), mixing.sample(named)):
        assert out.columns == named.columns and kept_names(out)
    assert sorted(r.doc_id for r in simhash.dedup(named).collect())[:2] == [0, 2] or sorted(r.doc_id for r in simhash.dedup(named).collect())[0] == 0


def test_string_ids(spark, named):
    text = named.selectExpr("concat('d', doc_id) AS doc_id", "text", "source").union(spark.createDataFrame([(None, "shared line of two documents", "s1")], "doc_id string, text string, source string"))
    got = {(r.doc_id, r.n_dropped) for r in linededup.dedup(text).collect()}
    assert {("d5", 1), (None, 1), ("d4", 0)} <= got
    assert simhash.near_duplicates(text).filter("component_id = 'd0'").count() >= 2 and mixing.mix(text).count() == 10


def test_line_index_of_nulls_and_empties(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    result = lambda index, rows: Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in index.dedup(frame(rows)).collect())
    data = [(1, "a line of many words\nshort"), (2, None), (3, ""), (None, "a line of many words"), (None, "a line of many words"), (4, "A LINE of many words ")]
    index = linededup.LineIndex.build(frame([]))
    assert index.dedup(frame([])).count() == 0
    index = index.insert(frame(data[3:5]))
    assert result(index, data[3:5]) == slow_lines(data[3:5])
    index = index.insert(frame([*data[:3], data[5]]))
    assert result(index, data) == slow_lines(data) and len(index.segments) == 3
    less = index.compact().delete(frame([(1, ""), (77, "")]).select("doc_id"))
    assert result(less, data[1:]) == slow_lines(data[1:]) and len(less.segments) == 2


def test_a_change_edits_touched_shards_alone(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = linededup.LineIndex.build(frame([(d, "\n".join(f"shared line number {i}" for i in range(200))) for d in (1, 2)] + [(3, "one line that is alone")]))
    assert index.shards == 32
    before = {r.shard: bytes(r.data) for r in index.filters.collect()}
    more = index.insert(frame([(4, "one line that is alone")]))
    after = {r.shard: bytes(r.data) for r in more.filters.collect()}
    assert sum(before.get(k) != v for k, v in after.items()) == 1 and more.segments[0] is index.segments[0]
    back = more.delete(frame([(4, "")]).select("doc_id"))
    assert sum(before.get(r.shard) != bytes(r.data) for r in back.filters.collect()) <= 1
    assert index.table.count() == back.table.count() == 201
