"""Helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own on a single machine, an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/corpusloom-core/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path  # noqa: SLF001
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; a frame of another origin is left alone."""
    if path := getattr(df, "_corpusloom_path", None):
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)  # noqa: SLF001


def global_row_number(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Numbers rows from 1 in a total order without one task that sorts them all: ranges, their sizes, places within."""
    ranged = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy("_part").count()  # a row for each range
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")
