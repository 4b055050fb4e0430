"""Prints one JSON line: seconds of the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR."""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidelog import KeyRange, Table
from tidelog.functions.keys import encode_unsigned
from tidelog.plans.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    root = tempfile.mkdtemp()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{root}/warehouse").config("spark.checkpoint.dir", f"file://{root}/shared").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}

    def timed(name, f, rows=None):
        began = time.perf_counter()
        n = f()
        seconds[name] = round(time.perf_counter() - began, 3)
        if rows or n:
            rates[name] = round((rows or n) / seconds[name])

    QUERIES["lww_state"](spark, SF).count()  # warm-up
    for name in ("lww_state", "multi_get", "range_co", "multi_scan", "runs_overlay", "compaction_purge", "delete_then_reinsert", "bloom_probe"):
        timed(name, lambda n=name: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("id", F.monotonically_increasing_id())
    rows = lines.select(encode_unsigned(F.col("id") * 2).alias("key"), F.encode(F.concat_ws("|", "l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate"), "UTF-8").alias("value")).cache()
    n = rows.count()
    t = Table.create(spark, f"{root}/table")
    timed("table_put", lambda: t.put(rows), n)
    timed("table_overwrite", lambda: t.put(rows), n)
    keys, absent = rows.select("key"), lines.select(encode_unsigned(F.col("id") * 2 + 1).alias("key"))  # between the stored ones
    timed("table_find_hits", lambda: t.find_many(keys).filter("found").count())
    timed("table_find_misses", lambda: t.find_many(absent).filter("NOT found").count())
    # Ranges of ten 256ths of the keys, as many as a thousandth of the rows; rows of all ranges are counted.
    top, width = 2 * n, 2 * n * 10 // 256
    starts = spark.range(n // 1000).select("id", (F.pmod(F.xxhash64("id"), F.lit(top))).alias("at"))
    ranges = starts.select(F.col("id").alias("range_id"), encode_unsigned(F.col("at")).alias("lower"), encode_unsigned(F.col("at") + width).alias("upper"), F.lit(True).alias("incl_lower"), F.lit(False).alias("incl_upper"))
    timed("table_short_ranges", lambda: t.scan_many(ranges).count())
    rates["table_short_ranges_queries"] = round(n // 1000 / seconds["table_short_ranges"], 1)
    timed("table_scan", lambda: t.scan(KeyRange(b"", b"\x80")).count())
    timed("table_compact", lambda: t.compact(), 2 * n)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows_per_sec": rates, "sf": SF.rsplit("sf", 1)[-1], "cpus": int(CPUS)}), flush=True)
    spark.stop()
    shutil.rmtree(root, ignore_errors=True)


if __name__ == "__main__":
    main()
