"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on odd documents."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SCHEMA, prose, rows
from tidelog.llm import cuckoo, graph, linededup, mixing, packing, pii, planes, quality, sharding, simhash, syncmers, tokenizing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def none_first(x):
    return (x is not None, x if x is not None else 0)


# 1 SimHash


def slow_fingerprint(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """doc_id and fingerprint pairs -> smallest id by fingerprint."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in fps}


def test_simhash(odd, nothing):
    got = [tuple(r) for r in simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()]
    pairs = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    want = slow_components(pairs)
    assert sorted(got, key=repr) == sorted(((d, f"{f:016x}", want[f]) for d, f in pairs), key=repr)
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.dedup(nothing).count() == 0
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want.values() if c is not None}) and ids.count(None) == 2


def test_covering_masks_miss_no_pair():
    """All differences of three bits or fewer are outside some mask of each family."""
    for split in range(simhash.SPLITS):
        m = [x & (2**64 - 1) for x in simhash.masks(split=split)]
        assert len(m) == 15 and all(16 <= x.bit_count() <= 48 for x in m)
        rnd = random.Random(split)
        for _ in range(5000):
            x = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 4)))
            assert any(not x & y for y in m)


def test_crowded_buckets_are_split_without_loss(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(150)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {frozenset(r) for r in simhash.links(nodes, bucket=4).collect()} == want


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(500, 501), (501, 500)]
    random.Random(2).shuffle(edges)
    got = dict(graph.components(spark.createDataFrame(edges, "hi long, lo long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, 501: 500}


# 2 Fingerprints


def test_syncmer_fingerprints(spark, odd, nothing):
    got = syncmers.edited_fingerprints(odd).collect()
    docs = sorted({(r[0], r[1] or "") for r in rows()}, key=lambda r: none_first(r[0]))
    assert len(got) == len(rows()) and syncmers.edited_fingerprints(nothing).count() == 0
    by = defaultdict(set)
    for i, (d, t) in enumerate(docs):
        by[d].add(t)
    keyed = {(d, spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]): t for d, t in docs}
    order = sorted(keyed, key=lambda k: (none_first(k[0]), k[1]))
    want = {}
    for i, k in enumerate(order):
        t, after = keyed[k], keyed[order[(i + 1) % len(order)]]
        m = len(t) // 4
        want[k[0], hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()] = len(t)
    assert {(r.doc_id, r.edited_sha256): r.n_chars for r in got} == want
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    long = [r for r in got if r.n_chars > 3000]
    assert len(long) == 2 and all(0.4 < r.near_edited < 0.9 for r in long)
    equal = {r.fingerprint for r in syncmers.fingerprints(odd.filter("doc_id IN (0, 30)")).collect()}
    assert len(equal) == 1


def test_syncmers_do_not_depend_on_context(spark):
    rnd = random.Random(3)
    shared = prose(rnd, 60).lower().replace("\n", " ")
    texts = [f"{prose(rnd, 30)} {shared} {prose(rnd, 30)}", f"{prose(rnd, 7)} {shared}"]
    found = [{(r.hash) for r in syncmers.anchors(spark.createDataFrame([(i, t)], "doc_id int, text string")).collect()} for i, t in enumerate(texts)]
    alone = {r.hash for r in syncmers.anchors(spark.createDataFrame([(9, shared)], "doc_id int, text string")).collect()}
    assert len(alone) > 15 and alone <= found[0] and alone <= found[1]
    plan = syncmers.edited_fingerprints(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_syncmers_by_hand(spark):
    h = lambda *xs: spark.range(1).select(F.xxhash64(*(F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for x in xs))).first()[0]
    words = [h(w) for w in prose(random.Random(4), 40).lower().split()]
    m = [h(a, b) for a, b in zip(words, words[1:])]
    want = [i for i in range(len(words) - 4) if min(m[i : i + 4]) in (m[i], m[i + 3])]
    df = spark.createDataFrame([(1, prose(random.Random(4), 40))], "doc_id long, text string")
    assert [r.place for r in syncmers.anchors(df).orderBy("place").collect()] == want


# 3 PII


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 97, 1000):
        f = pii.Feistel(b"k", "x", size)
        out = [f.apply(i) for i in range(size)]
        assert sorted(out) == list(range(size)) and [f.apply(x, True) for x in out] == list(range(size))


VALUES = ["4111111111111111", "4111 1111 1111 1111", "ann.lee42@mail7.example.com", "+1 (017) 555-7713", "97.51.17.173", "2024-02-29", "31/12/1999", "12.31.1999", "078-05-1120", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
CLEAN = ["4111111111111112", "version 4.0.1", "999.51.17.173", "2023-02-30", "666-12-1234", "GB82 WEST 1234 5698 7654 33", "12345", "1111111111111111", "a @ b", "1.2.3.4.5"]


#: Values beside words and numbers that their patterns could run into.
BESIDE = {
    "pay DE89 3704 0044 0532 0130 00 BANK now": ["iban"],
    "DE89370400440532013000 AND 4111-1111-1111-1111, 2020-01-02": ["iban", "card", "date"],
    "card 4111 1111 1111 1111 12/27": ["card"],
    "no 12 4111 1111 1111 1111": ["card"],
    "order 4111 1111 1111 1112 on 2020-01-02": ["date"],
    "GB82 WEST 1234 5698 7654 33 of 31/12/1999": ["date"],
    "DE99000000000000000030": [],
}


def test_date_pseudonyms_are_one_to_one():
    names, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", True)
    days = [datetime.date.fromordinal(datetime.date(1999, 1, 1).toordinal() + i) for i in range(1500)]
    dates = {d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")}
    found = {d: names.date(d) for d in dates}
    assert len(set(found.values())) == len(dates) and all(back.date(p) == d for d, p in found.items())
    assert names.date("2003-12-05").split("-") == names.date("05-12-2003").split("-")[::-1]


def test_pii(spark, odd, nothing):
    names, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", True)
    for v in VALUES:
        text = f"Here {v}, and {v}!"
        new, spans = pii.pseudonymize(text, names)
        a, b = (new[s:e] for _, s, e in spans)
        assert a == b != v and len(a) == len(v) and [c.isdigit() for c in a] == [c.isdigit() for c in v] or "." in v, v
        assert pii.pseudonymize(new, back)[0] == text and a not in text
        again, more = pii.pseudonymize(a, names)
        assert len(more) == 1  # a valid value of the same kind
    for v in CLEAN:
        assert pii.pseudonymize(f"x {v} y", names) == (f"x {v} y", []), v
    for text, found in BESIDE.items():
        new, spans = pii.pseudonymize(text, names)
        assert [k for k, _, _ in spans] == found and pii.pseudonymize(new, back)[0] == text, text
    assert pii.Pseudonyms(b"other").card(VALUES[0]) != names.card(VALUES[0])
    assert re.sub(" ", "", names.card(VALUES[1])) == names.card(VALUES[0])
    out = pii.pseudonymized(odd)
    assert {r.doc_id: r.text for r in out.filter("n_found = 0").collect()}.keys() >= {0, 45} and out.filter("text IS NULL").count() == 2
    assert pii.pseudonymized(nothing).count() == 0
    df = spark.createDataFrame([(1, f"mail {VALUES[2]} or {VALUES[4]}", "mine")], "doc_id long, text string, kinds string")
    r = pii.pseudonymized(df).first()
    assert r.kinds == "email,address" and r.n_found == 2 and r.text[r.spans[0] : r.spans[1]].endswith("@mail7.example.com")


# 4 Tokens


def reference_ids(text):
    t = Tokenizer.from_file(tokenizing.vocabulary())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_encoder_equals_the_library():
    e = tokenizing.Encoder(tokenizing.vocabulary(), limit=50)
    for text in [r[1] for r in rows()] + ["don't WE'LL 's''t", "a<b>c|d", "<|startoftext|>x", "Éé é ΙΣ ﬁ", "tab\there\r\nthere", "9.99"]:
        assert np.array_equal(np.frombuffer(e.encode(text), dtype="<u4"), reference_ids(text)), text


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_blocks_round_trip(kind):
    rnd = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(5), np.arange(1), rnd.integers(0, 49_408, 1000), rnd.integers(0, 2**32, 1003)):
        ids = ids.astype("<u4")
        assert np.array_equal(planes.unpack(planes.pack(ids, kind)), ids)
    with pytest.raises(ValueError):
        planes.unpack(b"nothing at all")


def test_joined_checksums():
    a, b = b"some bytes", bytes(range(256)) * 9
    assert planes.join_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_store(odd, nothing, monkeypatch):
    monkeypatch.setattr(planes, "BLOCK", 512)  # documents span many blocks
    store = planes.write_tokens(odd, parts=3)
    got = sorted((tuple(r) for r in store.digests().select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows()), key=none_first)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    want = Counter((d, len(i), zlib.crc32(i.tobytes())) for d, i in ((r[0], reference_ids(r[1])) for r in rows()))
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    index = store.index.orderBy("first").collect()
    assert index[0].first == 0 and all(a.first + a.n_ids == b.first for a, b in zip(index, index[1:])) and index[-1].first + index[-1].n_ids == at
    assert planes.write_tokens(nothing).digests().count() == 0


# 5 Mixing


def slow_targets(sizes, weights, cap):
    total, left, out = sum(sizes), set(range(len(sizes))), {}
    while left:
        share = (total - sum(out.values())) / sum(weights[i] for i in left)
        over = {i for i in left if share * weights[i] > cap * sizes[i] + 1e-9}
        if not over:
            return {**out, **{i: share * weights[i] for i in left}}
        out |= {i: cap * sizes[i] for i in over}
        left -= over
    return out


def test_targets_against_repeated_clamping(spark):
    rnd = random.Random(6)
    for n in (1, 2, 3, 7, 20):
        sizes = [rnd.choice([0, 1, 10, 100, 5000]) for _ in range(n)] + [1000]
        df = spark.createDataFrame([(f"s{i:03d}", s) for i, s in enumerate(sizes)], "_s string, _n long")
        got = {r._s: r.target for r in mixing.targets(df).collect()}
        want = slow_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 3)
        assert all(abs(got[f"s{i:03d}"] - want[i]) < 1e-6 for i in want)


def test_mixing(odd, nothing):
    got = mixing.mix(odd).collect()
    assert len(got) == len(rows()) and mixing.mix(nothing).count() == 0 and mixing.sample(nothing).count() == 0
    assert "score" in got[0].asDict()
    sources = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size
        s = sources[r.source]
        s[0], s[1], s[2] = s[0] + r.size, s[1] + r.taken, r.target
        assert r.target <= 3 * r.source_size + 1e-9
    assert all(abs(taken - target) <= 1 for _, taken, target in sources.values())
    assert Counter(map(str, got)) == Counter(map(str, mixing.mix(odd.repartition(5)).collect()))
    narrow = mixing.mix(mixing.sizes(odd), words="words").select("doc_id", *mixing.RESULTS)
    assert Counter(map(tuple, narrow.collect())) == Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got)
    mixed = mixing.sample(odd)
    assert mixed.columns == odd.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(words[s] == taken for s, (_, taken, _) in sources.items())
    plan = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


# 6 Quality


def slow_base(text):
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_base_counts():
    rnd = random.Random(7)
    for text in [r[1] or "" for r in rows()] + [" ".join(rnd.choice("ab") for _ in range(30)) for _ in range(50)] + ["a b c a b c a b", "x\nx\n\n\n x\nx | # <"]:
        assert quality.base(text) == slow_base(text), text


def test_viterbi_and_gradient():
    rnd = np.random.default_rng(8)
    f = quality.Field(rnd.normal(size=(2, quality.FEATURES)), rnd.normal(size=(2, 2)))
    for n in (1, 2, 6):
        x = rnd.normal(size=(n, quality.FEATURES))
        score = lambda y: sum(x[i] @ f.nodes[k] for i, k in enumerate(y)) + sum(f.steps[a, b] for a, b in zip(y, y[1:]))
        best = max((tuple(int(c) for c in f"{i:0{n}b}") for i in range(2**n)), key=score)
        assert tuple(f.decode(x)) == best
    x, y, lengths = rnd.normal(size=(3, 5, quality.FEATURES)), rnd.integers(0, 2, (3, 5)), np.array([5, 3, 1])
    _, g = quality.likelihood(f, x, y, lengths)
    for name, grad in (("nodes", g.nodes), ("steps", g.steps)):
        for at in np.ndindex(grad.shape):
            value = getattr(f, name)
            ends = []
            for d in (1e-5, -1e-5):
                moved = value.copy()
                moved[at] += d
                ends.append(quality.likelihood(quality.Field(**{"nodes": f.nodes, "steps": f.steps, name: moved}), x, y, lengths)[0])
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[at]) < 1e-6


def test_quality_of_held_out_documents(spark):
    rnd = random.Random(9)
    junk = lambda: "\n".join(" | ".join(prose(rnd, 1).strip() for _ in range(12)) for _ in range(8))
    data = [(i, prose(rnd, 150) if i % 2 else junk(), i % 2) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 60] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert all(out[i].kept == (y == 1) for i, _, y in data if i >= 60)


def test_quality_on_odd_documents(spark, odd, nothing):
    field = quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.judge(odd, field).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_base(r.text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.judge(nothing, quality.fit(nothing, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


# 7 Sharding


def test_sharding(spark, odd, nothing, tmp_path):
    got = sharding.shard(odd, path=f"{tmp_path}/map").collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) <= set(range(40))
    assert sharding.shard(nothing).count() == 0
    first = sharding.SlotMap.read(spark, f"{tmp_path}/map")
    second = first.rebalanced({r.virtual_slot: r.size for r in got}, shards=41)
    second.write(spark, f"{tmp_path}/map")
    assert sharding.SlotMap.read(spark, f"{tmp_path}/map") == second and sharding.SlotMap.read(spark, f"{tmp_path}/map", 1) == first


def test_rebalancing_moves_little():
    rnd = random.Random(10)
    sizes = {i: rnd.randrange(500, 1500) for i in range(4096)}
    m = sharding.SlotMap.build(sizes, 40, 4096)
    loads = m.loads(sizes)
    assert max(loads) - min(loads) < 0.02 * max(loads)
    grown = m.rebalanced(sizes, 41)
    moved = [i for i in sizes if m.shard_of[i] != grown.shard_of[i]]
    loads = grown.loads(sizes)
    # A 41st of the bytes, and of each old shard at most a slot more.
    assert sum(sizes[i] for i in moved) < sum(loads) / 41 + 40 * 1000 and max(loads) < 1.05 * sum(loads) / 41 and min(loads) > 0.9 * sum(loads) / 41
    shrunk = m.rebalanced(sizes, 39)
    assert max(shrunk.shard_of) == 38 and shrunk.version == 2
    assert m.rebalanced(sizes).shard_of == m.shard_of


# 8 Toxicity


def test_toxicity_held_out(spark, odd, nothing):
    rnd = random.Random(11)
    bad = ["grumph", "zorkel", "blatzing"]
    data = []
    for i in range(600):
        words = prose(rnd, 60).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        data.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, "grumph"), (1000, ""), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(out[i].predicted, y) for i, _, y in data if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in data) and not out[None].held_out
    assert sum(p == y for p, y in held) > 0.97 * len(held) and len(out) == 603 and 0 <= out[1000].score == out[1001].score <= 1
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, turned).collect()}
    assert all(abs(again[k] - r.score) < 1e-12 for k, r in out.items())  # held-out labels are not looked at
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(odd, empty).collect()} == {0.5}
    assert toxicity.score_documents(nothing, empty).count() == 0


# 9 Packing


def test_windows():
    rnd = random.Random(12)
    for _ in range(30):
        rests = [(i, rnd.choice([0, 4096]), rnd.choice([1, 2, 300, 700, 2000, 3000, 4096, rnd.randrange(1, 4097)])) for i in range(rnd.randrange(40))]
        windows, rest = packing.pack(rests)
        assert not rest and all((n := sum(p[2] for p in w)) & (n - 1) == 0 and n <= 4096 for w in windows)
        pieces = defaultdict(list)
        for w in windows:
            for doc, start, n in w:
                pieces[doc].append((start, n))
        for doc, start, n in rests:
            at = start
            for s, k in sorted(pieces[doc]):
                assert s == at and k > 0
                at += k
            assert at == start + n
        part, waiting = packing.pack(rests, last=False)
        assert sum(p[2] for w in part for p in w) + sum(p[2] for p in waiting) == sum(r[2] for r in rests)
        assert all(sum(p[2] for p in w) in packing.TIERS for w in part)


def test_packing(odd, nothing):
    got = packing.pack_documents(odd, pool=2000, step=8192).collect()
    want = Counter((r[0], zlib.crc32(i.tobytes()), len(i)) for r in rows() for i in [reference_ids(r[1])])
    windows, whole = defaultdict(list), Counter()
    by = defaultdict(list)
    for r in got:
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        windows[r.sequence_id].append(r)
        by[r.doc_id, r.doc_tokens].append(r)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        at = 0
        for r in w:
            assert r.offset == at
            at += r.length
        assert at == w[0].tier <= 4096 and at & (at - 1) == 0 and len({r.step_group for r in w}) == 1
    for (d, n), ps in by.items():
        copies = sum(p.length for p in ps) // n
        ps.sort(key=lambda p: p.start)
        if copies == 1:
            whole[d, zlib.crc32(b"".join(bytes(p.ids) for p in ps)), n] += 1
        else:
            whole.update({k: v for k, v in want.items() if k[0] == d and k[2] == n})
    assert whole == want
    assert packing.pack_documents(nothing).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, tiers=(500,))


# 10 Line dedup


def slow_lines(data):
    """Rows of (doc_id, text) -> (n_lines, n_dropped, kept) for each."""
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in data:
        for line in (t or "").split("\n"):
            holders[key(line)].add(linededup.NO_ID if d is None else d)
    out = []
    for d, t in data:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < 10 or len(holders[key(s)]) < 2 or min(holders[key(s)]) == (linededup.NO_ID if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(odd, nothing):
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup(odd).collect())
    assert got == slow_lines([r[:2] for r in rows()])
    assert linededup.dedup(nothing).count() == 0


def test_line_index_is_reversible(spark):
    rnd = random.Random(13)
    pool = [f"shared line number {i}" for i in range(12)]
    data = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else prose(rnd, 6).replace("\n", " ") for _ in range(6))) for i in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    result = lambda index, rows: Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in index.dedup(frame(rows)).collect())
    index = linededup.LineIndex.build(frame(data[:20]))
    assert result(index, data[:20]) == slow_lines(data[:20])
    more = index.insert(frame(data[20:]))
    assert result(more, data) == slow_lines(data)
    less = more.delete(frame([(i, "") for i in range(0, 30, 2)]).select("doc_id"))
    assert result(less, data[1::2]) == slow_lines(data[1::2])
    back = less.delete(frame([(i, "") for i in range(21, 30, 2)]).select("doc_id")).insert(frame(data[0:20:2]))
    assert result(back, data[:20]) == slow_lines(data[:20])
    assert back.table.select(F.sum("refs")).first()[0] == index.table.select(F.sum("refs")).first()[0]


def test_line_dedup_where_filters_meet_lines_by_shard(odd, monkeypatch):
    monkeypatch.setattr(linededup, "FILTER_BYTES", 0)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup(odd).collect())
    assert got == slow_lines([r[:2] for r in rows()])


def test_cuckoo_filter():
    rnd = np.random.default_rng(14)
    keys = rnd.integers(0, 2**63, 20_000).astype(np.uint64)
    f = cuckoo.CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(rnd.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.005
    f.delete(keys[:10_000])
    f = cuckoo.CuckooFilter.load(f.dump())
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.005
    assert not cuckoo.CuckooFilter(10).insert(keys[:500])


def test_schema_has_all_columns():
    assert [c.split()[0] for c in SCHEMA.split(", ")] == ["doc_id", "text", "lang", "source", "n_chars"]
