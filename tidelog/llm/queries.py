"""The registered queries: one for each operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import linededup, mixing, packing, pii, planes, quality, sharding, simhash, syncmers, toxicity
from tidelog.llm.common import documents

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.write_tokens(documents(spark, sf_dir)).digests().select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir)).drop("ids")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL["op10_line_dedup"] = linededup.SQL


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sizes(documents(spark, sf_dir)), words="words").select("doc_id", *mixing.RESULTS)


SQL["op5_mixing"] = mixing.SQL


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    field = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, field).drop("text")


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(documents(spark, sf_dir))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES["pipeline"] = corpus_pipeline.run
