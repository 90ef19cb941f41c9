"""The event log of runs as a stream: by run and step the state in force, kept up as events arrive.

An event is (run_id, step_id, event_id, at, kind). What counts for a step is its latest lifecycle event, by time and then by id, so that neither the split
into micro-batches nor late or repeated events change the result; ``settle`` is the same over a finished log. The stream's state is an aggregation: one such
event for each step of a run, however long the log is, and the events of a micro-batch combine before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import partitions
from ..operators.common import materialize

#: Kinds that change what a step is; the others are only counted by nobody here.
STATUS_OF = {"artifact_produced": "produced", "artifact_verified": "verified_deterministic", "artifact_promoted": "promoted", "artifact_replaced": "in_progress", "downstream_invalidated": "invalidated", "item_quarantined": "quarantined"}
#: Runs whose states share one partition of the kept table.
BUCKETS = 64
EVENT = "run_id long, step_id long, event_id long, at timestamp, kind string"
OUT = "run_id long, step_id long, at timestamp, event_id long, kind string"


def status(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])[kind]


def lifecycle(events: DataFrame) -> DataFrame:
    return events.select(*[c.split()[0] for c in EVENT.split(", ")]).where(F.col("kind").isin(*STATUS_OF) & F.col("step_id").isNotNull() & F.col("run_id").isNotNull() & F.col("at").isNotNull())


def settle(events: DataFrame) -> DataFrame:
    """(run_id, step_id, at, event_id, status) of a finished log."""
    latest = lifecycle(events).groupBy("run_id", "step_id").agg(F.max(F.struct("at", "event_id", "kind")).alias("e"))
    return latest.select("run_id", "step_id", "e.at", "e.event_id", status(F.col("e.kind")).alias("status"))


def updates(events: DataFrame) -> DataFrame:
    """A stream of the states in force of the steps that a micro-batch has events of; ``events`` is a stream."""
    latest = lifecycle(events).groupBy("run_id", "step_id").agg(F.max(F.struct("at", "event_id", "kind")).alias("e"))
    return latest.select("run_id", "step_id", "e.at", "e.event_id", "e.kind")


def keep(spark: SparkSession, events: DataFrame, path: str, checkpoint: str):
    """Run the stream until its input is used up and keep the states in a table of partitions at ``path``. A batch that is run again after a failure changes nothing: a state
    that came before wins only if it is later."""

    def upsert(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("long")
        new = materialize(batch.withColumn("bucket", bucket), "updates")
        old = partitions.read(spark, path, OUT, "bucket", form="parquet").join(new.select("bucket").distinct(), "bucket", "left_semi")
        both = old.unionByName(new)
        latest = both.groupBy("bucket", "run_id", "step_id").agg(F.max(F.struct("at", "event_id", "kind")).alias("e")).select("run_id", "step_id", "e.*", "bucket")
        if not new.isEmpty():
            partitions.change(materialize(latest, "upserted"), path, "bucket", ["run_id", "step_id"], form="parquet")

    query = updates(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The states that ``keep`` has left."""
    return partitions.read(spark, path, OUT, "bucket", form="parquet").select("run_id", "step_id", "at", "event_id", status(F.col("kind")).alias("status"))


def progress(states: DataFrame, steps: int) -> DataFrame:
    """By run how many of its ``steps`` steps are promoted, and the whole percent."""
    return states.groupBy("run_id").agg(F.count_if(F.col("status") == "promoted").alias("promoted")).withColumn("percent", F.floor(100 * F.col("promoted") / steps).cast("long"))
