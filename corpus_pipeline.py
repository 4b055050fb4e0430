"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard, linededup, mixing, packing, quality
from tidelog.llm.common import DOCUMENTS, documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose lines are mostly boilerplate, go.

    Null and empty texts have no words and go; null doc_ids are judged but lend no label; equal rows are judged alike; an
    empty table gives an empty one.  Without labels of both kinds the base rules decide alone."""
    field = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, field).filter("kept").select(*DOCUMENTS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents stay, with what is left of their texts (null stays null).

    Rows that share a doc_id are one document, rows without one another, later than all; an empty table gives an empty one."""
    out = linededup.dedup(docs.select(*DOCUMENTS))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return out.withColumns({"n_chars": F.when(F.col("n_dropped") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")), "text": text}).select(*DOCUMENTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard index 0.8 or more) the smallest doc_id stays.

    Null texts and texts without words are one group.  Of rows that repeat the kept doc_id, the one with the smallest text
    (then the smallest other columns, nulls first) stays; rows without doc_id stay where their group has none."""
    return jaccard.dedup(docs.select(*DOCUMENTS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or cut, to the sources' target weights.

    Texts without words (null, empty) are not in the mix; a null source is a source, the last; rows without or with
    repeated doc_ids are documents each, in the seeded order; an empty table gives an empty one."""
    return mixing.sample(docs.select(*DOCUMENTS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of several lengths.

    Every row is a document; null text is an empty one, of the end id alone; null doc_ids are carried along."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can express neither the labelling of lines nor the fingerprints, the mix's cuts or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
