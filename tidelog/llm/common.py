"""What the operators share: words, Arrow rows, and tables in the shared folder."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of anything but ASCII white space (0x20, 0x09-0x0D); bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _root(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share.

    Where none is configured, a local session (tests) gets a temporary one; a cluster has no folder to guess.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp()}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes what this application's operators have written between their steps.  Results that are still to be read
    depend on it, so it is for the end of an application, or of a job whose results are stored."""
    _SHIPPED.discard(spark.sparkContext.applicationId)
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and lost executors take nothing along."""
    path, writer = shared_folder(df.sparkSession), df.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_rows(batches: Iterator[pa.RecordBatch], size: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that little more than one slice of them exists as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text and the label of at most rows documents, in the order of a hash of doc_id, in one partition.

    The labels (doc_id, label; one row each) are chosen first, so that they alone are broadcast, at most rows of them,
    and only chosen texts are moved.
    """
    chosen = labels.select("doc_id", label, F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.orderBy("h", "doc_id", "text").limit(rows).select("text", label).coalesce(1)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """The columns of docs, but for those named, as one struct: carried so, no name of theirs can clash with inner ones."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns if c not in without))


def raw(text: str | Column = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, for clusters where it is not installed."""
    sc, root, packed = spark.sparkContext, Path(__file__).parents[2], io.BytesIO()
    files = sorted((root / "tidelog").rglob("*.py"))
    if sc.applicationId in _SHIPPED or not files:
        return
    with zipfile.ZipFile(packed, "w") as z:
        for f in files:
            z.write(f, f.relative_to(root))
    path = f"{shared_folder(spark)}/tidelog.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


#: Texts run to 100 kB and more, so batches are of few rows: a reader's or a Python worker's batch stays near a megabyte.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def prepare(spark: SparkSession) -> None:
    """The sizes of BATCHES, where the session leaves them open, and the package on the workers."""
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    ship(spark)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(f, schema) on workers that have the package."""
    prepare(df.sparkSession)
    return df.mapInArrow(f, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
