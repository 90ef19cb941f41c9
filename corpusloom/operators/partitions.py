"""Tables of partitions whose changes touch only what changed, and show as a whole or not at all.

A table is a folder with two parts::

    data/generation=<id>/<key>=<value>/part-*     what one change wrote; never altered afterwards
    manifest/version=<n>/part-*.parquet           for each live partition the generation that holds it

A change writes a generation of its own and then a manifest that names it for the partitions it replaces, and the former generations for all others. A
version counts once Spark's writer has marked it complete (``_SUCCESS``); a change that broke off before leaves the former version in force, and its
files are waste for ``vacuum``. Untouched partitions keep their very files. There is one writer at a time: a second one that begins from the same version fails, as its
version exists already. A reader keeps the version it began with until ``vacuum`` removes its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENERATION = "generation"
#: Up to so many generations in force are named to the reader, which then leaves out the files of all others.
MOST_GENERATIONS = 1000


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at, jvm.org.apache.hadoop.fs.Path  # noqa: SLF001


def _versions(spark: SparkSession, path: str) -> dict[int, bool]:
    """Every version number in the folder, and whether it is complete."""
    fs, at, make = _fs(spark, f"{path}/manifest")
    if not fs.exists(at):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return {int(n.removeprefix("version=")): fs.exists(make(f"{path}/manifest/{n}/_SUCCESS")) for n in names if n.startswith("version=")}


def current_version(spark: SparkSession, path: str) -> int | None:
    return max((v for v, whole in _versions(spark, path).items() if whole), default=None)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(key, generation) of the live partitions; None for a folder without a complete version."""
    version = current_version(spark, path) if version is None else version
    return None if version is None else spark.read.parquet(f"{path}/manifest/version={version}")


def read(spark: SparkSession, path: str, schema: str, key: str, version: int | None = None, form: str = "json") -> DataFrame:
    """The live rows: ``schema`` without the key, then the key."""
    live = manifest(spark, path, version)
    if live is None or live.isEmpty():
        return spark.createDataFrame([], schema).withColumn(key, F.lit(None).cast("bigint" if live is None else live.schema[key].dataType))
    kind = live.schema[key].dataType.simpleString()
    rows = spark.read.schema(f"{schema}, {GENERATION} string, {key} {kind}").format(form).load(f"{path}/data")
    in_force = [r[0] for r in live.select(GENERATION).distinct().limit(MOST_GENERATIONS + 1).collect()]
    if len(in_force) <= MOST_GENERATIONS:
        rows = rows.where(F.col(GENERATION).isin(in_force))  # the files of others aren't read
    return rows.join(live, [key, GENERATION], "left_semi").drop(GENERATION)


def change(rows: DataFrame, path: str, key: str, order: list[str], removed: DataFrame | None = None, form: str = "json") -> int:
    """Replace the partitions that ``rows`` have, in the order given within each, and drop those of ``removed`` (key); all others stay. Returns the new version.

    ``rows`` may be read from this very table: its files aren't touched. A null key is an error, as no folder could hold it.
    """
    spark = rows.sparkSession
    known = _versions(spark, path)
    version = max((v for v, whole in known.items() if whole), default=None)
    generation = uuid.uuid4().hex
    kind = rows.schema[key].dataType
    checked = rows.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row without {key}"))).otherwise(F.col(key)).cast(kind))
    target = f"{path}/data/{GENERATION}={generation}"
    checked.repartition(key).sortWithinPartitions(key, *order).write.partitionBy(key).format(form).save(target)
    fs, at, _ = _fs(spark, target)
    wrote = [s.getPath().getName() for s in fs.listStatus(at)]
    if any(n.startswith(f"{key}=") for n in wrote):
        own = spark.read.schema(f"{key} {kind.simpleString()}").format(form).load(target).select(key).distinct()
    else:
        own = spark.createDataFrame([], f"{key} {kind.simpleString()}")
    live = own.withColumn(GENERATION, F.lit(generation))
    if version is not None:
        kept = manifest(spark, path, version).join(own, key, "left_anti")
        live = (kept if removed is None else kept.join(removed.select(key), key, "left_anti")).unionByName(live)
    new = max(known, default=0) + 1
    live.write.parquet(f"{path}/manifest/version={new}")  # fails if another writer was first
    return new


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what the version in force doesn't need: generations without a live partition, and other manifests. Returns the folders deleted."""
    version = current_version(spark, path)
    if version is None:
        return 0
    live = {r[0] for r in manifest(spark, path, version).select(GENERATION).distinct().collect()}  # one for each change that is still in force
    fs, data, make = _fs(spark, f"{path}/data")
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName().removeprefix(f"{GENERATION}=") not in live]
    gone += [make(f"{path}/manifest/version={v}") for v in _versions(spark, path) if v != version]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
