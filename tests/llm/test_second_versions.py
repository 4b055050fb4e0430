"""Slow second versions: FTRL in scalars, a scanner for planted values, shards by hand, ranges of the token stream."""

import datetime
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from conftest import prose, rows
from pyspark.sql import functions as F
from test_operators import reference_ids
from tidelog.llm import pii, planes, sharding, toxicity


def test_ftrl_against_scalars():
    rnd = random.Random(80)
    data = [(np.array(sorted(rnd.sample(range(60), rnd.randrange(0, 12))), dtype=np.int32), rnd.randrange(2)) for _ in range(200)]
    alpha, beta, l1, l2 = 0.7, 1.0, 0.4, 0.2
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, own):
        if abs(z[i]) <= own:
            return 0.0
        return -(z[i] - math.copysign(own, z[i])) / ((beta + math.sqrt(n[i])) / alpha + (l2 if i != "bias" else 0))

    for _ in range(3):
        for found, y in data:
            keys = [*map(int, found), "bias"]
            w = {i: weight(i, 0.0 if i == "bias" else l1) for i in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in keys:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    m = toxicity.train(data, epochs=3, alpha=alpha, beta=beta, l1=l1, l2=l2)
    dense = m.dense()
    assert abs(m.bias - weight("bias", 0.0)) < 1e-9
    for i in range(60):
        assert abs(dense[i] - weight(i, l1)) < 1e-9
    assert 0 < len(m.buckets) < 60 and not dense[60:].any()


def test_features_against_words():
    text = "One two, THREE four-five six one two"
    words = ["one", "two", "three", "four", "five", "six", "one", "two"]
    h, want, full = [xxhash.xxh64_intdigest(w) for w in words], set(), 2**64 - 1
    want |= {x >> 44 for x in h}
    for skip in (1, 2, 3):
        for a, b in zip(h, h[skip:]):
            x = (a * 0x9E3779B97F4A7C15 + b + skip) & full
            want.add((((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & full) >> 44)
    assert toxicity.features(text).tolist() == sorted(want)


# PII: values with their kinds, made and checked by rules of their own.


def _luhn(d):
    for c in range(10):
        total = 0
        for i, x in enumerate(map(int, reversed(d + str(c)))):
            x *= 1 + i % 2
            total += x - 9 * (x > 9)
        if total % 10 == 0:
            return str(c)
    raise AssertionError


def value(rnd, kind):
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    if kind == "card":
        d = "4" + digits(14)
        d += _luhn(d)
        cut = rnd.choice(["", " ", "-"])
        return cut.join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == "iban":
        body = digits(18)
        number = int(body + "1314" + "00")  # D = 13, E = 14
        return f"DE{98 - number % 97:02d}{body}"
    if kind == "email":
        return f"{rnd.choice(['ann', 'bo.lee', 'x_1'])}{digits(2)}@mail{digits(1)}.example.org"
    if kind == "phone":
        return rnd.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "+1 {}.{}.{}"]).format(digits(3), digits(3), digits(4))
    if kind == "address":
        return ".".join(str(rnd.randrange(256)) for _ in range(4))
    if kind == "ssn":
        return f"{rnd.randrange(1, 600):03d}-{rnd.randrange(1, 100):02d}-{rnd.randrange(1, 10000):04d}"
    day = datetime.date(1950, 1, 1) + datetime.timedelta(rnd.randrange(30_000))
    return day.strftime(rnd.choice(["%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y"]))


def valid(kind, s):
    """By rules of this file."""
    d = "".join(c for c in s if c.isdigit())
    if kind == "card":
        return _luhn(d[:-1]) == d[-1]
    if kind == "iban":
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "address":
        return all(0 <= int(x) < 256 for x in s.split("."))
    if kind == "ssn":
        return 0 < int(d[:3]) < 900 and int(d[:3]) != 666 and int(d[3:5]) and int(d[5:])
    if kind == "date":
        tried = []
        for f in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y"):
            try:
                tried.append(datetime.datetime.strptime(s, f))
            except ValueError:
                pass
        return bool(tried)
    return True


def test_planted_values_are_all_found_and_nothing_else():
    rnd, kinds = random.Random(81), ["card", "iban", "email", "phone", "address", "ssn", "date"]
    names, back, linked = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", True), {}
    for _ in range(400):
        parts, spans, at = [], [], 0
        for _ in range(rnd.randrange(1, 6)):
            gap = " ".join(prose(rnd, rnd.randrange(1, 8)).split()) + rnd.choice([" ", ": ", " ("])
            kind = rnd.choice(kinds)
            v = value(rnd, kind)
            parts += [gap, v, rnd.choice([", ", ") ", "; ", " x "])]
            spans.append((kind, at + len(gap), v))
            at += sum(map(len, parts[-3:]))
        text = "".join(parts)
        new, found = pii.pseudonymize(text, names)
        assert [k for k, _, _ in spans] == [k for k, _, _ in found], text
        cuts = [0, *(x for _, s, e in found for x in (s, e)), len(new)]
        assert [new[a:b] for a, b in zip(cuts[::2], cuts[1::2])] == [p for i in range(0, len(parts), 3) for p in [(parts[i - 1] if i else "") + parts[i]]] + [parts[-1]], text
        assert pii.pseudonymize(new, back)[0] == text
        for (kind, _, v), (_, s, e) in zip(spans, found):
            assert valid(kind, new[s:e]) and linked.setdefault((kind, v), new[s:e]) == new[s:e]


def test_key_of_the_session(spark):
    df = spark.createDataFrame([(1, "card 4111 1111 1111 1111", "z")], "doc_id long, text string, `a.b` string")
    plain = pii.pseudonymized(df).first()
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        other = pii.pseudonymized(df).first()
        assert other.text != plain.text and other["a.b"] == "z" and pii.pseudonymized(df, pii.KEY).first() == plain
    finally:
        spark.conf.unset(pii.KEY_SETTING)


# Sharding


def test_shards_by_hand(spark, odd):
    got = sharding.shard(odd, shards=5, slots=64).collect()
    text = F.coalesce("text", F.lit("")).cast("binary")
    slots = defaultdict(list)
    for r in odd.select("doc_id", "text", F.xxhash64("doc_id", F.crc32(text)).alias("h")).collect():
        raw = (r.text or "").encode()
        slots[r.h % 64].append((r.doc_id is not None, r.doc_id or 0, zlib.crc32(raw), len(raw) + 16))
    loads, shard_of = [0] * 5, {}
    for slot in sorted(range(64), key=lambda i: (-sum(x[3] for x in slots.get(i, [])), i)):
        s = min(range(5), key=lambda k: (loads[k], k))
        shard_of[slot] = s
        loads[s] += max(1, sum(x[3] for x in slots.get(slot, [])))
    want = []
    for s in range(5):
        place = 0
        for slot in range(64):
            if shard_of[slot] == s:
                for has, d, crc, size in sorted(slots.get(slot, [])):
                    want.append((d if has else None, size, crc, s, place))
                    place += 1
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.size, r.text_crc32, r.shard, r.slot)) for r in got)


# Tokens by the chunk index


def test_ranges_of_the_token_stream(odd, nothing, monkeypatch):
    monkeypatch.setattr(planes, "BLOCK", 256)
    store = planes.write_tokens(odd, parts=3)
    texts = {(r.doc_id, r.start): r.n_tokens for r in store.documents.collect()}
    total = sum(texts.values())
    stream = store.ids(0, total)
    assert len(stream) == total and len(store.ids(total, total + 9)) == 0
    by = {r[0]: reference_ids(r[1]) for r in rows() if r[0] not in (None, 6)}
    for (d, start), n in texts.items():
        if d in by:
            assert np.array_equal(stream[start : start + n], by[d])
    rnd = random.Random(82)
    for _ in range(3):
        a = rnd.randrange(total)
        b = min(total, a + rnd.randrange(1, 2000))
        assert np.array_equal(store.ids(a, b), stream[a:b])
    assert len(planes.write_tokens(nothing).ids(0, 10)) == 0
