"""Cross-source deduplication: copies of one utterance, exact or nearly so, from different sources.

Input rows: utterance_id, source_adapter, source_path_hash, ts (timestamp or null), text, text_status, modality. Two rows of different sources are
copies if their keys are equal and they are at most ten minutes apart, or one has no time; or if both have a time, are at most
ten minutes apart and their keys' similarity is 0.92 or more. Clusters are connected components, and each keeps one row.

Only edges that connect the same components are made. Among rows of one key within two time buckets each row is linked to the nearest
earlier and the nearest later row of another source; any pair of different sources in reach is connected through
these. Rows without a time, and what they link to, go through representatives of two different sources. So a key that
holds a third of all rows costs edges in proportion to its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..functions.similarity import may_reach, most_apart, placed_runs, profile
from ..functions.similarity import ratio as compared
from .common import materialize
from .components import components

#: Rows, and characters of their keys, of a chunk that is compared in one task.
CHUNK_ROWS, CHUNK_CHARS = 128, 8_000_000


def _source(rows: DataFrame) -> Column:
    return F.concat_ws("\u0001", "source_adapter", "source_path_hash")


def prepared(utterances: DataFrame) -> DataFrame:
    rows = utterances.select("utterance_id", "source_adapter", "source_path_hash", "ts", "text_status", "modality", text.dedup_key(F.col("text")).alias("key"))
    # What is shuffled is 128 bits of a key, not its text.
    return rows.withColumn("source", _source(rows)).withColumn("at", F.unix_micros("ts")).withColumn("key_hash", F.md5("key"))


def _timed_edges(rows: DataFrame) -> DataFrame:
    limit = fixed.PROXIMITY_SECONDS * 1_000_000
    bucket = F.floor(F.col("at") / limit)
    timed = rows.where("at is not null").select("key_hash", "source", "at", "utterance_id", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    order = Window.partitionBy("key_hash", "bucket").orderBy("at", "utterance_id")
    me = F.struct("at", "source", "utterance_id")
    run = timed.withColumn("before", F.lag(me).over(order)).withColumn("after", F.lead(me).over(order))
    earlier = F.last(F.when(F.col("before.source") != F.col("source"), F.col("before")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first(F.when(F.col("after.source") != F.col("source"), F.col("after")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = run.select("at", "utterance_id", earlier.alias("earlier"), later.alias("later")).withColumn("near", F.explode(F.array("earlier", "later"))).where(F.col("near").isNotNull() & (F.abs(F.col("near.at") - F.col("at")) <= limit))
    return both.select(F.col("utterance_id").alias("a"), F.col("near.utterance_id").alias("b"))


def _two_sources(rows: DataFrame) -> DataFrame:
    """By key the least row and the least row of another source."""
    per = rows.groupBy("key_hash", "source").agg(F.min("utterance_id").alias("id"))
    first = per.groupBy("key_hash").agg(F.min_by(F.struct("id", "source"), F.struct("id", "source")).alias("one"))
    other = per.join(first, "key_hash").where("source <> one.source").groupBy("key_hash").agg(F.min_by(F.struct("id", "source"), F.struct("id", "source")).alias("two"))
    return first.join(other, "key_hash", "left")


def _untimed_edges(rows: DataFrame) -> DataFrame:
    untimed = rows.where("at is null")
    some = _two_sources(untimed)
    every = _two_sources(rows.join(untimed.select("key_hash").distinct(), "key_hash", "left_semi"))
    pick = F.when(F.col("one.source") != F.col("source"), F.col("one.id")).otherwise(F.col("two.id"))
    edges = rows.join(some, "key_hash").select(F.col("utterance_id").alias("a"), pick.alias("b"))
    edges = edges.union(untimed.join(every, "key_hash").select(F.col("utterance_id").alias("a"), pick.alias("b")))
    return edges.where("b is not null and a <> b")


def exact_edges(rows: DataFrame) -> DataFrame:
    return _timed_edges(rows).union(_untimed_edges(rows)).distinct()


def bucketed_range_join(left: DataFrame, right: DataFrame, at: str, width: int, condition: Column, keys: list[str] | None = None) -> DataFrame:
    """Pairs of ``left`` and ``right`` (aliased l and r) whose ``at`` differ by at most ``width``, later side on the right."""
    bucket = F.floor(F.col(at) / width)
    a = left.withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))).alias("l")
    b = right.withColumn("_bucket", bucket).alias("r")
    on = (F.col("l._bucket") == F.col("r._bucket")) & (F.col(f"r.{at}") >= F.col(f"l.{at}")) & (F.col(f"r.{at}") - F.col(f"l.{at}") <= width)
    for k in keys or []:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return a.join(b, on & condition)


def _linked(ratio: float, window: int):
    """For one chunk of earlier rows (side 0) and one of later ones (side 1): the pairs that are nearly equal.

    Lengths and times rule out most pairs, the counts of characters most of the others, and runs of characters near their own places, made once for each row, nearly all that are
    unlike; what is left is compared.
    """

    def run(rows: pa.Table) -> pa.Table:
        left, right = (rows.filter(pc.equal(rows["side"], s)) for s in (0, 1))
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            x, y = left["key"].to_pylist(), right["key"].to_pylist()
            n, m, at, bt = (np.array(t[c].to_pylist(), np.int64) for t, c in ((left, "n"), (right, "n"), (left, "at"), (right, "at")))
            ids, jds, sources, others = left["id"].to_pylist(), right["id"].to_pylist(), left["source"].to_pylist(), np.array(right["source"].to_pylist(), object)
            profiles, runs, known = np.stack([profile(t) for t in y]).astype(np.int32), {}, {}
            for i, key in enumerate(x):
                total = n[i] + m
                fit = (bt >= at[i]) & (bt - at[i] <= window) & (2 * np.minimum(n[i], m) >= ratio * total - 1e-9) & (others != sources[i])
                near = np.flatnonzero(fit)
                if not len(near):
                    continue
                own, placed = profile(key).astype(np.int32), None
                apart = np.abs(profiles[near] - own).sum(axis=1)
                for j in near[apart <= most_apart(total[near], ratio)].tolist():
                    if key == y[j] or (at[i], ids[i]) >= (bt[j], jds[j]):
                        continue
                    pair = (key, y[j])
                    if pair not in known:
                        placed = placed_runs(key) if placed is None else placed
                        runs[j] = placed_runs(y[j]) if j not in runs else runs[j]
                        known[pair] = may_reach(placed, runs[j], n[i], m[j], ratio) and compared(key, y[j], ratio) >= ratio
                    if known[pair]:
                        out_a.append(ids[i])
                        out_b.append(jds[j])
        return pa.table({"a": pa.array(out_a, pa.string()), "b": pa.array(out_b, pa.string())})

    return run


def fuzzy_edges(rows: DataFrame) -> DataFrame:
    """Pairs of nearly equal keys. Equal keys of one source and time are one row here; lengths that can't reach the ratio never meet.

    A row goes once to each place (time bucket, class of lengths) where a partner may be, not once for each partner; a place of many rows is dealt out as pairs of
    chunks, so no task holds more than two chunks, and every pair meets once.
    """
    limit, ratio = fixed.PROXIMITY_SECONDS * 1_000_000, fixed.FUZZY_RATIO
    kinds = rows.where("at is not null").groupBy("key_hash", "source", "at").agg(F.min(F.struct("utterance_id", "key")).alias("m")).select("key_hash", "source", "at", F.col("m.utterance_id").alias("id"), F.col("m.key").alias("key")).withColumn("n", F.length("key").cast("long"))
    # The ratio bounds the quotient of two lengths, so their classes differ by one at most.
    step = F.log(F.lit((2 - ratio) / ratio * 1.0001))
    size, bucket = F.floor(F.log(F.greatest("n", F.lit(1))) / step), F.floor(F.col("at") / limit)
    one = kinds.select("id", "source", "at", "key", "n", size.alias("size"), bucket.alias("bucket"))
    later = one.withColumn("side", F.lit(1))
    earlier = one.withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1))).withColumn("side", F.lit(0))
    counts = lambda d, name: d.groupBy("bucket", "size").agg(F.ceil(F.greatest(F.count("*") / CHUNK_ROWS, F.sum("n") / CHUNK_CHARS)).cast("int").alias(name))
    chunks = counts(earlier.drop("key"), "lc").join(counts(later.drop("key"), "rc"), ["bucket", "size"])  # places with rows on both sides
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = earlier.join(chunks, ["bucket", "size"]).withColumn("l", own("lc")).withColumn("r", every("rc"))
    right = later.join(chunks, ["bucket", "size"]).withColumn("r", own("rc")).withColumn("l", every("lc"))
    columns = ["bucket", "size", "l", "r", "side", "id", "source", "at", "n", "key"]
    linked = left.select(*columns).unionByName(right.select(*columns)).groupBy("bucket", "size", "l", "r").applyInArrow(_linked(ratio, limit), "a string, b string")
    linked = materialize(linked, "fuzzy")
    # Rows that the grouping joined hang on their representative.
    same = rows.where("at is not null").join(kinds.select("key_hash", "source", "at", "id"), ["key_hash", "source", "at"]).where("utterance_id <> id").select(F.col("utterance_id").alias("a"), F.col("id").alias("b"))
    partners = linked.select("a").union(linked.select("b")).distinct().withColumnRenamed("a", "b")
    return linked.union(same.join(partners, "b", "left_semi").select("a", "b"))


def clusters(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``cluster`` and the cluster's ``canonical_id`` and ``canonical_key``."""
    found = components(edges)
    named = rows.drop("key").join(found, F.col("utterance_id") == F.col("node"), "left").withColumn("cluster", F.coalesce("root", "utterance_id")).drop("node", "root")
    order = F.struct(
        (F.col("text_status") != "verbatim").alias("v"),
        (F.col("modality") != "spoken_asr").alias("s"),
        F.col("at").isNull().alias("u"),
        F.coalesce("at", F.lit(0)).alias("t"),
        F.col("utterance_id").alias("i"),
    )
    best = named.groupBy("cluster").agg(F.min_by(F.struct("utterance_id", "key_hash"), order).alias("c"))
    return named.join(best, "cluster").withColumn("canonical_id", F.col("c.utterance_id")).withColumn("canonical_key", F.col("c.key_hash")).drop("c")


def deduplicate(utterances: DataFrame, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(surviving utterance ids, exclusions: excluded_utterance_id, canonical_utterance_id, kind)."""
    rows = materialize(prepared(utterances), "dedup")
    edges = exact_edges(rows)
    if fuzzy:
        edges = edges.union(fuzzy_edges(rows))
    found = clusters(rows, edges)
    kept = found.where("utterance_id = canonical_id").select("utterance_id")
    kind = F.when(F.col("key_hash") == F.col("canonical_key"), "exact").otherwise("fuzzy")
    gone = found.where("utterance_id <> canonical_id").select(F.col("utterance_id").alias("excluded_utterance_id"), F.col("canonical_id").alias("canonical_utterance_id"), kind.alias("kind"))
    return kept, gone


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group: fork, hash and session collapse. An aggregation, so groups of any size combine before the shuffle."""
    keys = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    every = [F.col(c) for c in rows.columns]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*every), keys).alias("_row")).select("_row.*")


def last_write_wins(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """The latest row of each id, at the place of its first one (``first_position``)."""
    every = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*by).agg(F.max_by(every, F.col(position)).alias("_row"), F.min(position).alias("first_position")).select("_row.*", "first_position")
