"""Writing and reading sorted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import CHANGE_LOG
from tidelog.sources.manifest import Run


def write_run(spark: SparkSession, df: DataFrame, root: str, name: str, level: int, fpp: float, rows_per_file: int = 2_000_000, expected: int | None = None) -> Run | None:
    """key, seq, value as one folder of Parquet, range-partitioned and sorted by key; None if there are no rows.

    Its statistics come from the written files, by one aggregate over Parquet, not from computing df again.
    """
    path = f"{root}/{name}"
    parts = max(1, -(-expected // rows_per_file)) if expected is not None else None
    dealt = df.select("key", "seq", "value")
    dealt = dealt.repartitionByRange(parts, "key") if parts else dealt.repartitionByRange("key")
    writer = dealt.sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true")
    writer.option("parquet.bloom.filter.fpp#key", str(fpp)).parquet(path)
    stats = read_runs(spark, root, [name]).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("d"), F.hex(F.min("key")).alias("lo"),
        F.hex(F.max("key")).alias("hi"), F.min("seq").alias("s0"), F.max("seq").alias("s1"),
    ).first()
    return Run(name, level, stats.n, stats.d, stats.lo, stats.hi, stats.s0, stats.s1) if stats.n else None


def read_runs(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], CHANGE_LOG)
    return spark.read.schema(CHANGE_LOG).parquet(*(f"{root}/{x}" for x in names))
