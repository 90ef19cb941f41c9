"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH = "corpusloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, read through Spark so that any file system works.

    One that is read in fewer tasks than there are threads (a small file of one row group) is dealt out first.
    """
    rows, n = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own on a single machine, an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{SCRATCH}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path  # noqa: SLF001
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished stages: Spark deletes them when their owners are collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # noqa: SLF001


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; a frame of another origin is left alone."""
    path = getattr(df, "_corpusloom_path", None)
    if path:
        jvm = df.sparkSession._jvm  # noqa: SLF001
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)  # noqa: SLF001


def each_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` from one that works on a single batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    return run


def each_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, most_rows: int = 512, most_bytes: int = 8_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As ``each_batch``, over slices of few rows and bytes of ``column`` (binary); a row larger than the limit is a slice of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, begin, held = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()], 0, 0
            for i, size in enumerate(sizes):
                if i > begin and (i - begin == most_rows or held + size > most_bytes):
                    yield fn(batch.slice(begin, i - begin))
                    begin, held = i, 0
                held += size
            if begin < len(sizes):
                yield fn(batch.slice(begin))

    return run


def utf8_list(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_list(column: pa.Array) -> list[str]:
    """The texts of an Arrow string column; a null is empty."""
    return [x or "" for x in column.to_pylist()]


def texts_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, whatever else the input carries."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
