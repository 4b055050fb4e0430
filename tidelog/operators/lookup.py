"""Point, bulk and range lookups over a change log.  Key predicates go below the resolve, value predicates never."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import KeyRange
from tidelog.operators.resolve import newest, resolve


#: Ranges that are broadcast and tried one by one, at most.
NESTED = 1000


def get(log: DataFrame, value: Any, key: str = "key", seq: str = "seq") -> DataFrame:
    """No row or one."""
    return resolve(log.filter(F.col(key) == F.lit(value)), [key], seq)


def multi_get(log: DataFrame, wanted: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """A row for each wanted key with found and the log's other columns (null where there is none).

    The semi-join stands on the log, below the window; Spark broadcasts wanted only if it is small.
    """
    keys = wanted.select(key).distinct()
    hits = newest(log.join(keys, key, "left_semi"), [key], seq).filter(F.col("value").isNotNull())
    return wanted.join(hits.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scan(log: DataFrame, r: KeyRange, key: str = "key", seq: str = "seq", ordered: bool = True) -> DataFrame:
    """The state inside the range, ascending by key."""
    out = resolve(log.filter(r.predicate(F.col(key))), [key], seq)
    return out.orderBy(key) if ordered else out


def multi_scan(log: DataFrame, ranges: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """range_id and the state inside each of many ranges (columns range_id, lower, upper, incl_lower, incl_upper).

    The state is resolved once, inside the span of all ranges where they have one, and then range-joined: a version's
    range membership depends on its key alone.
    """
    edge = ranges.agg(F.min("lower").alias("low"), F.max("upper").alias("high"), F.count("lower").alias("a"), F.count("upper").alias("b"), F.count(F.lit(1)).alias("n")).first()
    span = KeyRange(edge.low if edge.n and edge.a == edge.n else None, edge.high if edge.n and edge.b == edge.n else None)
    return range_join(resolve(log.filter(span.predicate(F.col(key))), [key], seq), ranges, key)


def range_join(state: DataFrame, ranges: DataFrame, key: str = "key", nested: int = NESTED) -> DataFrame:
    """range_id beside each row of state (any rows with a key) for every range that holds its key.

    Up to nested ranges are broadcast and tried one by one.  More are joined by equality: the bounds cut the keys into
    points and the gaps between them, numbered in order, so a range is an interval of numbers and falls into
    at most two nodes of each level of a binary tree over them; a row looks for the nodes above its own number.
    """
    if ranges.limit(nested + 1).count() <= nested:
        r, k = ranges.alias("r"), F.col(key)
        low = F.col("r.lower").isNull() | (k > F.col("r.lower")) | (F.col("r.incl_lower") & (k == F.col("r.lower")))
        high = F.col("r.upper").isNull() | (k < F.col("r.upper")) | (F.col("r.incl_upper") & (k == F.col("r.upper")))
        return state.join(F.broadcast(r), low & high).drop("lower", "upper", "incl_lower", "incl_upper")
    bounds = ranges.select(F.col("lower").alias("_key")).union(ranges.select("upper")).filter("_key IS NOT NULL").distinct()
    rows = state.select(F.col(key).alias("_key"), F.struct("*").alias("_row"))
    both = rows.withColumn("_bound", F.lit(0)).unionByName(bounds.withColumn("_bound", F.lit(1)), allowMissingColumns=True)
    # Fixed in the shared folder: another run of the sampling could cut the ranges elsewhere.
    dealt = both.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()).checkpoint()
    before = dealt.groupBy("_part").agg(F.sum("_bound").alias("n"))  # a row for each partition
    before = before.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    here = Window.partitionBy("_part").orderBy("_key", F.col("_bound").desc()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_bound") == 1, F.col("_key")), ignorenulls=True).over(here)
    placed = dealt.withColumns({"_n": F.sum("_bound").over(here), "_last": last}).join(F.broadcast(before), "_part")
    number = 2 * (F.col("_before") + F.col("_n")) - F.when(F.col("_last") == F.col("_key"), F.lit(1)).otherwise(F.lit(0))
    placed = placed.select("_key", "_row", "_bound", number.alias("_at"))
    top = 2 * bounds.count()
    points = placed.filter("_bound = 1").select("_key", "_at")
    found = ranges.join(points.withColumnsRenamed({"_key": "lower", "_at": "_low"}), "lower", "left").join(points.withColumnsRenamed({"_key": "upper", "_at": "_high"}), "upper", "left")
    low = F.when(F.col("lower").isNull(), F.lit(0)).otherwise(F.col("_low") + F.when(F.col("incl_lower"), 0).otherwise(1))
    end = F.when(F.col("upper").isNull(), F.lit(top + 1)).otherwise(F.col("_high") + F.when(F.col("incl_upper"), 1).otherwise(0))
    levels = F.sequence(F.lit(0), F.lit(max(1, top.bit_length())))
    node = lambda level, at: F.struct(level.alias("level"), at.alias("at"))

    def climb(acc, level):
        left, right, some = acc["low"] % 2 == 1, acc["end"] % 2 == 1, acc["low"] < acc["end"]
        first = F.when(some & left, F.array(node(level, acc["low"]))).otherwise(none)
        last = F.when(some & right, F.array(node(level, acc["end"] - 1))).otherwise(none)
        low, end = acc["low"] + left.cast("bigint"), acc["end"] - right.cast("bigint")
        return F.struct(F.floor(low / 2).cast("bigint").alias("low"), F.floor(end / 2).cast("bigint").alias("end"), F.concat(acc["nodes"], first, last).alias("nodes"))

    none = F.array().cast("array<struct<level:int,at:bigint>>")
    start = F.struct(low.cast("bigint").alias("low"), end.cast("bigint").alias("end"), none.alias("nodes"))
    cover = found.select(*(c for c in ranges.columns if c not in ("lower", "upper", "incl_lower", "incl_upper")), F.explode(F.aggregate(levels, start, climb)["nodes"]).alias("_node"))
    up = F.transform(levels, lambda i: node(i, F.floor(F.col("_at") / F.pow(F.lit(2), i)).cast("bigint")))
    above = placed.filter("_bound = 0").select("_row", F.explode(up).alias("_node"))
    return above.join(cover, "_node").select("_row.*", *(c for c in cover.columns if c != "_node"))


def range_stats(state: DataFrame, ranges: DataFrame, key: str = "key") -> DataFrame:
    """For each range its columns but the bounds, and n, low, high: how many rows of state (any rows with a key) it holds,
    their least and greatest key; 0 and nulls where there are none.  Null keys are in no range.

    No row is paired with a range, so wide ranges cost no more than narrow ones.  Keys and bounds are put in one order,
    where each bound gets the number of rows up to it and the nearest keys on both sides; a range takes them from its two bounds.
    """
    keys = state.select(F.col(key).alias("_key"), F.lit(1).cast("bigint").alias("_rows"), F.lit(False).alias("_bound"))
    bounds = ranges.select(F.col("lower").alias("_key")).union(ranges.select("upper"))
    both = keys.union(bounds.select("_key", F.lit(0).cast("bigint"), F.lit(True))).filter("_key IS NOT NULL")
    both = both.groupBy("_key").agg(F.sum("_rows").alias("_rows"), F.max("_bound").alias("_bound"))
    # Fixed as in range_join.
    dealt = both.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()).checkpoint()
    held, up, down = F.when(F.col("_rows") > 0, F.col("_key")), F.col("_key").asc(), F.col("_key").desc()
    parts = dealt.groupBy("_part").agg(F.sum("_rows").alias("_n"), F.min(held).alias("_least"), F.max(held).alias("_most"))  # a row for each partition
    whole = parts.agg(F.sum("_n").alias("n"), F.min("_least").alias("low"), F.max("_most").alias("high")).first()
    lesser, greater = (Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in (F.col("_part").asc(), F.col("_part").desc()))
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(lesser), F.lit(0)).alias("_n"), F.max("_most").over(lesser).alias("_most"), F.min("_least").over(greater).alias("_least"))

    def near(order, end, beyond):
        here = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        return F.coalesce(F.last(held, ignorenulls=True).over(here), F.col(beyond))

    upto = F.sum("_rows").over(Window.partitionBy("_part").orderBy(up).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")
    placed = dealt.join(F.broadcast(parts), "_part").withColumns({
        "_upto": upto, "_at_most": near(up, 0, "_most"), "_below": near(up, -1, "_most"), "_at_least": near(down, 0, "_least"), "_above": near(down, -1, "_least"),
    })
    place = lambda n, k: F.struct(n.cast("bigint").alias("n"), k.alias("key"))
    upto, before = F.col("_upto"), F.col("_upto") - F.col("_rows")
    points = placed.filter("_bound").select(
        "_key", place(before, F.col("_at_least")).alias("_from_at"), place(upto, F.col("_above")).alias("_from_after"),
        place(upto, F.col("_at_most")).alias("_to_at"), place(before, F.col("_below")).alias("_to_before"),
    ).checkpoint()

    def at(df, bound, incl, if_in, if_out, absent, name):
        """Ranges without this bound are not joined: their nulls would all meet in one task."""
        found = points.select(F.col("_key").alias(bound), if_in, if_out)
        some = df.filter(F.col(bound).isNotNull()).join(found, bound).withColumn(name, F.when(F.col(incl), F.col(if_in)).otherwise(F.col(if_out))).drop(if_in, if_out)
        return some.unionByName(df.filter(F.col(bound).isNull()).withColumn(name, absent))

    key_type = dealt.schema["_key"].dataType
    out = at(ranges, "lower", "incl_lower", "_from_at", "_from_after", place(F.lit(0), F.lit(whole.low).cast(key_type)), "_from")
    out = at(out, "upper", "incl_upper", "_to_at", "_to_before", place(F.lit(whole.n or 0), F.lit(whole.high).cast(key_type)), "_to")
    n = F.greatest(F.col("_to.n") - F.col("_from.n"), F.lit(0))
    return out.select(*(c for c in ranges.columns if c not in ("lower", "upper", "incl_lower", "incl_upper")), n.alias("n"), F.when(n > 0, F.col("_from.key")).alias("low"), F.when(n > 0, F.col("_to.key")).alias("high"))
