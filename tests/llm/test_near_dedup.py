"""The pipeline's near-dedup against brute force over all pairs."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from conftest import SCHEMA, prose, rows
from tidelog.llm import jaccard


def slow_kept(data):
    """The smallest doc_id of each component of texts whose five-word shingles have a Jaccard index of 0.8 or more."""
    sets = []
    for _, text, *_ in data:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(data):
        groups[find(i)].append(r[0])
    return sorted(min(g) for g in groups.values())


def test_near_dedup_misses_no_pair(spark, monkeypatch):
    """Edits of growing size, a crowd around the limit, a passage that many share, and all odd documents."""
    rnd, texts = random.Random(31), []

    def edited(text, n):
        w = text.split()
        for i in rnd.sample(range(len(w)), min(n, len(w))):
            w[i] = f"new{rnd.random()}"
        return " ".join(w)

    for size in (6, 12, 30, 60, 150, 400):
        base = prose(rnd, size)
        texts += [base] + [edited(base, n) for n in (1, 1, size // 50 + 1, size // 40 + 1, size // 20 + 1)]
        texts += [base + " " + prose(rnd, size // n) for n in (3, 4, 5, 8)]
    crowd, passage = prose(rnd, 200), prose(rnd, 20)
    texts += [edited(crowd, rnd.randrange(2, 7)) for _ in range(60)]
    texts += [f"{prose(rnd, 40)} {passage} {prose(rnd, 40)}" for _ in range(40)]
    rnd.shuffle(texts)
    once = {r[0]: r for r in rows() if r[0] is not None}
    data = [*once.values(), *((1000 + i, t, "en", "s1", len(t)) for i, t in enumerate(texts))]
    want = slow_kept(data)
    for sample in (jaccard.SAMPLE_DOCS, 2000):  # with the second, shingles of more than two documents are common
        monkeypatch.setattr(jaccard, "SAMPLE_DOCS", sample)
        got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(data, SCHEMA).repartition(3), "")
        assert sorted(r.doc_id for r in got.collect()) == want


def test_prefixes_meet_in_any_order():
    rnd = np.random.default_rng(4)
    for _ in range(2000):
        n = int(rnd.integers(1, 60))
        a, b = (np.unique(np.r_[rnd.integers(0, 40, n), rnd.integers(0, 300, int(rnd.integers(0, 6)))]).astype(np.uint64) for _ in range(2))
        common = np.unique(rnd.integers(0, 60, 30)).astype(np.uint64)
        both = len(np.intersect1d(a, b))
        if 10 * both >= 8 * (len(a) + len(b) - both):
            counts = common.astype(np.int64) % 3 + 2
            assert jaccard.may_be_near(jaccard.parities(a), len(a), jaccard.parities(b), len(b))
            assert len(np.intersect1d(jaccard.prefix(a, common, counts), jaccard.prefix(b, common, counts)))


def test_null_and_repeated_doc_ids(spark):
    text = prose(random.Random(8), 50)
    data = [(None, text, "en", "s", 1), (None, "a", "en", "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (7, text + " more", "en", "s", 1), (9, None, "en", "s", 0), (8, " \n", "en", "s", 2)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(data, SCHEMA), "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 4), (False, 8), (True, 0), (True, 0)]


def test_the_order_of_shingles_counts_all_documents(spark, monkeypatch):
    """Exact counts of every frequent shingle, with few and many buckets, more rows than SAMPLE_DOCS, copies, nulls and empty tables."""
    rnd, passages = random.Random(12), [prose(random.Random(i), 9) for i in range(20)]
    texts = [" ".join([prose(rnd, 30), *rnd.sample(passages, rnd.randrange(4))]) for _ in range(600)]
    texts += [texts[0]] * 5 + [None, "", "one word"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    n = Counter(h for t in texts for h in jaccard.shingles((t or "").encode()).tolist())
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 100)
    for bits in (22, 4):
        monkeypatch.setattr(jaccard, "BUCKET_BITS", bits, raising=False)
        h, counts = jaccard._common(docs)
        assert list(zip(h.tolist(), counts.tolist())) == sorted((h, k) for h, k in n.items() if k > 2)
    assert len(h) > 100 and max(counts) > 50
    assert [len(x) for x in jaccard._common(docs.limit(0))] == [0, 0]
