"""The test tables as the engine's own tables, and the same mapping as SQL.

``conversations`` and ``documents`` carry no time: a turn's is 2024-01-01 plus conv_id hours and turn minutes, a document's is
2024-01-01 plus doc_id seconds. Every fifth conversation counts as spoken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = 1_704_067_200  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table that Spark reads in fewer tasks than it has threads (a small file of one row group) is dealt out, before costly expressions."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def conversation_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws(":", F.lit("conversations"), "conv_id", "turn").alias("utterance_id"),
        F.lit("conversations").alias("source_adapter"),
        F.sha2(F.lit("conversations"), 256).alias("source_path_hash"),
        F.sha2(F.col("conv_id").cast("string"), 256).alias("session_hash"),
        F.timestamp_seconds(F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts"),
        "text", "conv_id", "turn", "role",
        F.when(F.col("conv_id") % 5 == 0, "spoken_asr").otherwise("written").alias("modality"),
        F.lit("verbatim").alias("text_status"),
    )


def document_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws(":", F.lit("documents"), "doc_id").alias("utterance_id"),
        F.col("source").alias("source_adapter"),
        F.sha2(F.col("source"), 256).alias("source_path_hash"),
        F.sha2(F.col("source"), 256).alias("session_hash"),
        F.timestamp_seconds(F.lit(START) + F.col("doc_id")).alias("ts"),
        "text", "doc_id", "lang", "n_chars",
        F.lit("written").alias("modality"),
        F.when(F.col("doc_id") % 2 == 0, "verbatim").otherwise("cleaned").alias("text_status"),
    )


#: The same mappings for the SQL side.
CONVERSATIONS = f"""(SELECT concat_ws(':', 'conversations', conv_id, turn) AS utterance_id, sha256(CAST(conv_id AS VARCHAR)) AS session_hash,
 {START} + conv_id * 3600 + turn * 60 AS epoch, text, conv_id, turn, role, CASE WHEN conv_id % 5 = 0 THEN 'spoken_asr' ELSE 'written' END AS modality FROM conversations)"""
DOCUMENTS = f"""(SELECT concat_ws(':', 'documents', doc_id) AS utterance_id, source AS source_adapter, sha256(source) AS session_hash, {START} + doc_id AS epoch, text, doc_id, lang, n_chars,
 CASE WHEN doc_id % 2 = 0 THEN 'verbatim' ELSE 'cleaned' END AS text_status FROM documents)"""
