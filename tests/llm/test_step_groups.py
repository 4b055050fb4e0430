"""Windows and step groups over many tasks: nothing is padded but the last windows, and groups hold the same tokens."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import prose
from test_operators import reference_ids
from tidelog.llm import packing


@pytest.mark.parametrize("pool", [packing.POOL, 3000])
def test_groups_of_all_tasks_are_full(spark, pool):
    rnd = random.Random(70)
    texts = [prose(rnd, rnd.choice([0, 1, 5, 40, 150, 400, 900, 2500])) for _ in range(150)] + [prose(rnd, 20_000), None]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tier string, nth int").repartition(12)
    rows = packing.pack_documents(docs, pool=pool, step=8192).drop("ids").collect()
    size, group = {}, {}
    for r in rows:
        size[r.sequence_id], group[r.sequence_id] = r.tier, r.step_group
    tokens = defaultdict(Counter)
    for s, n in size.items():
        tokens[n][group[s]] += n
    for n, groups in tokens.items():
        assert all(groups[g] == 8192 for g in sorted(groups)[:-1]) and groups[max(groups)] <= 8192
        assert len({g >> 32 for g in groups}) == 1
    below = [n for n in size.values() if n < packing.TIERS[0]]
    assert len(below) == len(set(below))
    ids = {i: reference_ids(t) for i, t in enumerate(texts)}
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert got.keys() == ids.keys()
    for i, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes()) and r.doc_tokens == len(ids[i])
            at += r.length
        assert at == len(ids[i])
    assert sum(size.values()) == sum(map(len, ids.values()))


def test_step_must_hold_windows(spark):
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), step=5000)
