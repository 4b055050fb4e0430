import random

import pytest
from pyspark.sql import functions as F

from tidelog import CHANGE_LOG, KeyRange, Table
from tidelog.functions import bloom
from tidelog.functions.keys import encode_signed, encode_unsigned
from tidelog.operators import lookup
from tidelog.operators.resolve import resolve
from tidelog.plans.cascade import capacity, due, layout
from tidelog.plans.queries import QUERIES
from tidelog.sources.store import Store

FIXTURE = [("61", "01"), ("6100", "02"), ("7f", "03"), ("80", "04"), ("ff", "05"), ("61", "06"), ("80", None), ("62", None), ("7f", None), ("7f", "07"), ("", "08")]
STATE = {"": "08", "61": "06", "6100": "02", "7f": "07", "ff": "05"}
RANGES = [
    (None, None, True, False, ["", "61", "6100", "7f", "ff"]), ("61", "7f", True, True, ["61", "6100", "7f"]), ("61", "7f", True, False, ["61", "6100"]),
    ("61", "7f", False, True, ["6100", "7f"]), ("61", "7f", False, False, ["6100"]), ("61", None, False, True, ["6100", "7f", "ff"]), (None, "61", False, True, ["", "61"]),
    ("61", "61", True, True, ["61"]), ("61", "61", True, False, []), ("7f", "61", True, True, []), ("80", "80", True, True, []),
]


def _b(x):
    return None if x is None else bytearray.fromhex(x)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(_b(k), i + 1, _b(v)) for i, (k, v) in enumerate(FIXTURE)], CHANGE_LOG).cache()


def test_state(log):
    rows = resolve(log, ["key"]).orderBy("key").collect()
    assert {r.key.hex(): r.value.hex() for r in rows} == STATE and [r.key.hex() for r in rows] == list(STATE)


@pytest.mark.parametrize("low,high,a,b,want", RANGES)
def test_ranges(log, low, high, a, b, want):
    assert [r.key.hex() for r in lookup.scan(log, KeyRange(_b(low), _b(high), a, b)).collect()] == want


def test_many_ranges_and_keys(spark, log):
    ranges = spark.createDataFrame([(i, _b(x[0]), _b(x[1]), x[2], x[3]) for i, x in enumerate(RANGES)], "range_id int, lower binary, upper binary, incl_lower boolean, incl_upper boolean")
    got = {}
    for r in lookup.multi_scan(log, ranges).orderBy("key").collect():
        got.setdefault(r.range_id, []).append(r.key.hex())
    assert all(got.get(i, []) == x[4] for i, x in enumerate(RANGES))
    state = resolve(log, ["key"])
    rows = lambda n: sorted((r.range_id, r.key.hex(), r.value.hex(), r.seq) for r in lookup.range_join(state, ranges, nested=n).collect())
    assert rows(0) == rows(100) and len(rows(0)) == sum(len(x[4]) for x in RANGES)
    wanted = spark.createDataFrame([(_b(k),) for k in ("61", "62", "80", "99")], "key binary")
    assert {r.key.hex(): r.found for r in lookup.multi_get(log, wanted).collect()} == {"61": True, "62": False, "80": False, "99": False}


def test_pushdown(spark, tmp_path):
    spark.range(100).select(encode_unsigned(F.col("id")).alias("key"), F.col("id").alias("seq"), F.lit(b"x").alias("value")).write.parquet(f"{tmp_path}/x")
    plan = lookup.scan(spark.read.parquet(f"{tmp_path}/x"), KeyRange(bytearray(b"a"), bytearray(b"b")))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(key" in plan


def test_layout():
    assert layout(256, 4) == [0, 0, 0, 0, 1] and layout(64, 5) == [4, 2, 2] and layout(500, 10) == [0, 0, 5]
    for f in (2, 3, 4, 5, 10):
        for n in range(1, 300, 7):
            counts = layout(n, f)
            assert sum(c * f**i for i, c in enumerate(counts)) == n and max(counts) < f
    assert due([1], 2) is None and due([], 2) is None and capacity(100, 4, 2) == 1600
    with pytest.raises(ValueError):
        due([1], 1)


def test_bloom(spark):
    assert [bloom.sizing(n, p) for n, p in ((100, 0.1), (100_000, 0.05), (1, 0.05), (100, 0.5), (100, 0.99), (0, 0.5))] == [(480, 3), (623_523, 4), (7, 4), (145, 1), (3, 1), (0, 0)]
    for bad in (0, 1):
        with pytest.raises(ValueError):
            bloom.sizing(5, bad)
    bits, hashes = bloom.sizing(2000, 0.05)
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    filters = bloom.build(keys, "key", bits, hashes)
    assert bloom.probe(keys, "key", filters, bits, hashes).filter("NOT maybe_present").count() == 0
    absent = spark.range(10_000, 14_000).select(F.col("id").cast("string").alias("key"))
    assert bloom.probe(absent, "key", filters, bits, hashes).filter("maybe_present").count() < 400


def test_key_order(spark):
    rows = spark.createDataFrame([(x,) for x in (-(2**63), -5, -1, 0, 1, 255, 256, 2**63 - 1)], "x long")
    assert [r.x for r in rows.orderBy(encode_signed(F.col("x"))).collect()] == sorted(r.x for r in rows.collect())
    assert KeyRange.prefix(b"a\xff").upper == b"b" and KeyRange.prefix(b"\xff").upper is None
    assert KeyRange.prefix("12").upper == "13" and KeyRange.prefix("a\U0010ffff").upper == "b" and KeyRange.prefix("").upper is None


def test_ranges_by_equality(spark):
    """Beyond the nested number: random, nested, equal, inverted and unbounded ranges against brute force."""
    rnd = random.Random(5)
    keys = sorted({bytes(rnd.randrange(6) for _ in range(rnd.randrange(1, 5))) for _ in range(300)})
    bound = lambda: None if rnd.random() < 0.05 else rnd.choice(keys) if rnd.random() < 0.6 else bytes(rnd.randrange(6) for _ in range(rnd.randrange(5)))
    ranges = [(i, bound(), bound(), rnd.random() < 0.5, rnd.random() < 0.5) for i in range(400)]
    state = spark.createDataFrame([(bytearray(k), i) for i, k in enumerate(keys)], "key binary, x int").repartition(3)
    frame = spark.createDataFrame([(i, a and bytearray(a) if a else a if a is None else bytearray(a), None if b is None else bytearray(b), c, d) for i, a, b, c, d in ranges], "range_id int, lower binary, upper binary, incl_lower boolean, incl_upper boolean")
    want = {(i, k) for i, a, b, c, d in ranges for k in keys if (a is None or k > a or c and k == a) and (b is None or k < b or d and k == b)}
    out = lookup.range_join(state, frame, nested=10)
    got = [(r.range_id, bytes(r.key)) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and "NestedLoop" not in out._jdf.queryExecution().toString()
    empty = spark.createDataFrame([], "key binary, x int")
    assert lookup.range_join(empty, frame, nested=10).count() == 0


@pytest.mark.parametrize("kind", ["binary", "string"])
def test_range_stats(spark, kind):
    """Against brute force: repeated and null keys, ranges that repeat, are inverted, empty or without bounds; no rows, no ranges."""
    rnd, put = random.Random(6), (lambda x: x if x is None else bytearray(x) if kind == "binary" else x.decode())
    word = lambda n: bytes(rnd.randrange(97, 103) for _ in range(rnd.randrange(n)))
    keys = [None] * 5 + [word(5) for _ in range(300)]
    bound = lambda: None if rnd.random() < 0.15 else rnd.choice(keys[5:]) if rnd.random() < 0.6 else word(5)
    ranges = [(i // 2 if i < 20 else i, bound(), bound(), rnd.random() < 0.5, rnd.random() < 0.5) for i in range(400)] + [(500, None, None, True, True)] * 2
    key_type, range_type = f"key {kind}, x int", f"range_id int, lower {kind}, upper {kind}, incl_lower boolean, incl_upper boolean"
    state = spark.createDataFrame([(put(k), i) for i, k in enumerate(keys)], key_type).repartition(3)
    frame = spark.createDataFrame([(i, put(a), put(b), c, d) for i, a, b, c, d in ranges], range_type).repartition(2)
    plain = lambda x: x.encode() if isinstance(x, str) else x if x is None else bytes(x)
    rows = lambda df: sorted(((r.range_id, r.n, plain(r.low), plain(r.high)) for r in df.collect()), key=repr)

    def want(keys):
        for i, a, b, c, d in ranges:
            hit = [k for k in keys if k is not None and (a is None or k > a or c and k == a) and (b is None or k < b or d and k == b)]
            yield i, len(hit), min(hit, default=None), max(hit, default=None)

    assert rows(lookup.range_stats(state, frame)) == sorted(want(keys), key=repr)
    assert rows(lookup.range_stats(state.limit(0), frame)) == sorted(want([]), key=repr)
    assert rows(lookup.range_stats(state, frame.limit(0))) == rows(lookup.range_stats(state.limit(0), frame.limit(0))) == []


def test_range_join_many_makes_no_pairs(spark, tmp_path):
    """A seventh of the ranges has no upper bound, so pairs grow with the square of the tables; no step may make them."""
    rnd = random.Random(7)
    events = [(i, rnd.randrange(500), rnd.choice(["view", "click", "error"]), f'{{"k": {rnd.randrange(30)}}}') for i in range(4000)]
    customers = [(i, rnd.randrange(25)) for i in range(400)] + [(7, 3), (8, 3), (401, None), (None, 4)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    last = {f"{u}|{p}": kind for _, u, kind, p in events}
    keys, want = [k for k, kind in last.items() if kind != "error"], {}
    for c, nation in customers:
        hit = [k for k in keys if c is not None and k > str(c) and (c % 7 == 0 or nation is None or k <= f"{c}|{nation}")]
        want.setdefault(c, []).extend(hit)
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    seen = {runs.apply(i).executionId() for i in range(runs.size())}
    got = {r.range_id: (r.n, r.low, r.high) for r in QUERIES["range_join_many"](spark, str(tmp_path)).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs, most = store.executionsList(), 0
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        if run in seen:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    pairs, most_allowed = sum(map(len, want.values())), 2 * (len(events) + 2 * len(customers))  # the range exchange reads its rows twice
    assert len(events) <= most <= most_allowed < pairs, (most, pairs)
    assert got == {c: (len(x), min(x), max(x)) for c, x in want.items() if x}


def test_runs_that_do_not_overlap_are_read_without_a_shuffle(spark, tmp_path):
    rows = spark.range(300).select(encode_unsigned(F.col("id")).alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    t = Table.create(spark, f"{tmp_path}/t")
    t.put(rows.filter("value < '2'"), compact=False)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(t.state()) and "Window" not in plan(t.state())
    t.insert((10_000).to_bytes(8), b"far")
    t.insert((10_001).to_bytes(8), b"")
    assert "Exchange" not in plan(t.state())
    t.put(rows, compact=False)
    assert "Exchange" in plan(t.state()) and t.state().count() == 301
    r = KeyRange((10_000).to_bytes(8), None)
    assert "Exchange" not in plan(t.scan(r, ordered=False)) and t.find_range(r) == {(10_000).to_bytes(8): b"far"}
    t.view("state_of_t")
    assert spark.sql("SELECT count(*) AS n, max(length(value)) AS m FROM state_of_t WHERE key >= X'00000000000000FA'").first() == (51, 3)


def test_many_lookups_by_list_and_by_join(spark, tmp_path, monkeypatch):
    rows = spark.range(500).select(encode_unsigned(F.col("id") * 2).alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    t = Table.create(spark, f"{tmp_path}/t")
    t.put(rows)
    t.delete(rows.limit(20).select("key"))
    t.insert((4).to_bytes(8), b"again")
    wanted = spark.createDataFrame([(bytearray(i.to_bytes(8)),) for i in [4, 4, 0, 5, 100, 998, 2000]] + [(None,)], "key binary")
    got = []
    for few in (1000, 2):
        monkeypatch.setattr("tidelog.table.FEW", few)
        got.append(sorted((r.key and int.from_bytes(r.key), r.found, r.value and bytes(r.value)) if r.key else (-1, r.found, r.value) for r in t.find_many(wanted).collect()))
    assert got[0] == got[1] == [(-1, False, None), (0, False, None), (4, True, b"again"), (4, True, b"again"), (5, False, None), (100, True, b"50"), (998, True, b"499"), (2000, False, None)]
    assert t.find_many(wanted.limit(0)).count() == 0
    every = t.find_many(rows.select("key").union(wanted))  # as many keys as rows
    assert every.count() == 508 and every.filter("found").count() == 481 + 4 and "left_semi" not in every._jdf.queryExecution().toString().lower().replace(" ", "_")


def test_snapshots_say_when_versions_are_gone(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t")
    for key, value in ((b"a", b"1"), (b"b", b"2"), (b"a", b"")):
        t.insert(key, value)
        t.flush()
    state = lambda df: {bytes(r.key): bytes(r.value) for r in df.collect()}
    assert [state(t.as_of(i)) for i in (0, 1, 2, 3)] == [{}, {b"a": b"1"}, {b"a": b"1", b"b": b"2"}, {b"b": b"2"}]
    held = t.scan()
    t.compact()
    assert state(t.as_of(3)) == {b"b": b"2"} == state(held) == state(t.state())
    with pytest.raises(ValueError):
        Table.open(spark, f"{tmp_path}/t").as_of(2)
    assert t.vacuum(versions=50) == [] and state(held) == {b"b": b"2"}
    assert len([x for x in t.vacuum() if x.startswith("run-")]) == 3 and state(t.state()) == {b"b": b"2"}


def test_racing_writers(spark, tmp_path):
    """Of writers that commit one version at once, one wins, and its rows are what is read."""
    from concurrent.futures import ThreadPoolExecutor

    Table.create(spark, f"{tmp_path}/t")
    tables = [Table.open(spark, f"{tmp_path}/t") for _ in range(4)]
    for i, t in enumerate(tables):
        t.insert(b"k", b"%d" % i)

    def flush(i):
        try:
            tables[i].flush()
        except FileExistsError:
            return None
        return i

    with ThreadPoolExecutor(4) as pool:
        won = [i for i in pool.map(flush, range(4)) if i is not None]
    assert len(won) == 1 and Table.open(spark, f"{tmp_path}/t").find_range() == {b"k": b"%d" % won[0]}
    store = Store(spark, f"{tmp_path}/s")
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda i: _try(lambda: store.write_new("x", str(i))), range(24)))
    assert done.count(True) == 1 and store.read("x") == str(done.index(True)) and store.names("") == ["x"]


def _try(f):
    try:
        f()
        return True
    except FileExistsError:
        return False


def test_6400_operations_against_a_dict(spark, tmp_path):
    rnd, model = random.Random(100), {}
    t = Table.create(spark, f"{tmp_path}/t", flush_threshold=500, fanout=3)
    some = lambda n, top: bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, top + 1)))
    for i in range(6400):
        key = some(1, 3) if rnd.random() < 0.7 or not model else rnd.choice(list(model)[:50])
        if rnd.random() < 0.3:
            t.erase(key)
            model.pop(key, None)
        else:
            value = some(1, 20)
            t.insert(key, value)
            model[key] = value
        if i % 1600 == 800:
            t.close()
            t = Table.open(spark, f"{tmp_path}/t")
        if i % 800 == 400:
            for k in (key, some(1, 3)):
                assert t.find(k) == model.get(k)
            low, high = some(1, 6), some(1, 6)
            modes = (rnd.random() < 0.5, rnd.random() < 0.5)
            inside = lambda k: (k > low or modes[0] and k == low) and (k < high or modes[1] and k == high)
            assert t.find_range(KeyRange(low, high, *modes)) == {k: v for k, v in sorted(model.items()) if inside(k)}
    assert t.find_range() == dict(sorted(model.items())) and len(t.manifest.runs) < 6


@pytest.mark.parametrize("seed", range(2))
def test_random_operations_against_a_dict(spark, tmp_path, seed):
    """Flushing, compacting and reopening at random points never change an answer."""
    rnd, model = random.Random(seed), {}
    t = Table.create(spark, f"{tmp_path}/t", flush_threshold=25, fanout=2)
    for i in range(160):
        key, value = bytes(rnd.randrange(4) for _ in range(rnd.randrange(4))), bytes(rnd.randrange(256) for _ in range(rnd.randrange(4)))
        if rnd.random() < 0.25:
            t.erase(key)
            model.pop(key, None)
        else:
            t.insert(key, value)
            model.update({key: value}) if value else model.pop(key, None)
        if i % 60 == 30:
            t.compact()
        if i % 80 == 70:
            t.close()
            t = Table.open(spark, f"{tmp_path}/t")
        if i % 40 == 20:
            assert t.find(key) == model.get(key)
            low, high = sorted(bytes(rnd.randrange(4) for _ in range(rnd.randrange(3))) for _ in range(2))
            assert t.find_range(KeyRange(low, high, True, False)) == {k: model[k] for k in sorted(model) if low <= k < high}
    assert t.find_range() == dict(sorted(model.items())) and list(t.find_range()) == sorted(model)
    assert t.find(b"not there") is None
    t.compact()
    assert t.stats().count() <= 1 and t.find_range() == dict(sorted(model.items()))
    t.vacuum()
    assert Table.open(spark, f"{tmp_path}/t").find_range() == dict(sorted(model.items()))


def test_batches(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t", fanout=3)
    assert t.find_range() == {} and t.find(b"x") is None
    rows = spark.range(1000).select(encode_unsigned(F.col("id")).alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    t.put(rows)
    t.put(rows.filter("value < '5'").withColumn("value", F.lit(b"new")))
    t.delete(rows.limit(10).select("key"), compact=False)
    keys = spark.createDataFrame([(bytearray((i).to_bytes(8)),) for i in (3, 11, 999, 5000)], "key binary")
    got = {int.from_bytes(r.key): (r.found, r.value and bytes(r.value)) for r in t.find_many(keys).collect()}
    assert got == {3: (False, None), 11: (True, b"new"), 999: (True, b"999"), 5000: (False, None)}
    assert t.as_of(1).count() == 1000 and t.state().count() == 990
    t.delete_range(KeyRange((0).to_bytes(8), (500).to_bytes(8), True, False))
    t.compact()
    assert t.state().count() == 500 and t.stats().first().deletions == 0
    t.delete_range(KeyRange())
    t.compact()
    assert t.state().count() == 0 and t.stats().count() == 0


def test_second_writer_fails_and_missing_table(spark, tmp_path):
    a = Table.create(spark, f"{tmp_path}/t")
    b = Table.open(spark, f"{tmp_path}/t")
    a.insert(b"k", b"v")
    a.flush()
    b.insert(b"k", b"w")
    with pytest.raises(FileExistsError):
        b.flush()
    with pytest.raises(FileNotFoundError):
        Table.open(spark, f"{tmp_path}/none")
    for bad in ({"flush_threshold": 0}, {"fanout": 1}, {"bloom_fpp": 1.0}):
        with pytest.raises(ValueError):
            Table.create(spark, f"{tmp_path}/bad", **bad)


def test_stream(spark, tmp_path):
    from tidelog.streaming.ingest import sink

    t = Table.create(spark, f"{tmp_path}/t")
    spark.createDataFrame([(bytearray(b"a"), bytearray(b"1")), (bytearray(b"b"), bytearray(b"2"))], "key binary, value binary").write.parquet(f"{tmp_path}/in")
    q = sink(spark.readStream.schema("key binary, value binary").parquet(f"{tmp_path}/in"), t, f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert Table.open(spark, f"{tmp_path}/t").find_range() == {b"a": b"1", b"b": b"2"}


def _rows(spark, path, pairs):
    spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], "key binary, value binary").coalesce(1).write.mode("append").parquet(path)


def _run(spark, path, table, checkpoint):
    from tidelog.streaming.ingest import sink

    q = sink(spark.readStream.schema("key binary, value binary").parquet(path), table, checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_two_streams_into_one_table(spark, tmp_path):
    t = Table.create(spark, f"{tmp_path}/t")
    for name in ("a", "b"):
        _rows(spark, f"{tmp_path}/in_{name}", [(name.encode(), b"1")])
        _run(spark, f"{tmp_path}/in_{name}", t, f"{tmp_path}/ck_{name}")
    assert Table.open(spark, f"{tmp_path}/t").find_range() == {b"a": b"1", b"b": b"1"} and len(t.manifest.streams) == 2


def test_a_batch_runs_again_after_a_crash(spark, tmp_path):
    """The batch is committed to the table, but not to the stream's own log; another write follows in between."""
    t = Table.create(spark, f"{tmp_path}/t")
    _rows(spark, f"{tmp_path}/in", [(b"a", b"1")])
    _run(spark, f"{tmp_path}/in", t, f"{tmp_path}/ck")
    t.insert(b"a", b"later")
    t.flush()
    for x in (tmp_path / "ck" / "commits").iterdir():
        x.unlink()
    t = Table.open(spark, f"{tmp_path}/t")
    _run(spark, f"{tmp_path}/in", t, f"{tmp_path}/ck")
    assert Table.open(spark, f"{tmp_path}/t").find_range() == {b"a": b"later"}
    _rows(spark, f"{tmp_path}/in", [(b"c", b"2")])
    _run(spark, f"{tmp_path}/in", t, f"{tmp_path}/ck")
    assert t.find_range() == {b"a": b"later", b"c": b"2"}


def test_entry_points(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and "lww_state" in names
    assert e.entry(spark).count() > 0
