"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones, a minimum-cost flow (keeping a byte where it is costs
nothing, moving it costs one) says how many bytes go from each old shard to each new one; the network has as many nodes as there are
shards. Rows are grouped into blocks by a hash within their old shard, and whole blocks carry out the flow, so a plan over blocks and
not over rows passes through the driver. Rows of more than ``1 / LARGE`` of all bytes are blocks of their own (there are at most ``LARGE``), which keeps
the new sizes near equal. Only files of shards that give or take rows are rewritten.

Defined results: a null text has no bytes and a checksum of 0; repeated rows each get a slot; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import partitions
from .common import materialize

OVERHEAD = 16
OLD_SHARDS, NEW_SHARDS = 32, 40
#: Blocks of an old shard; a row above this share of all bytes is a block of its own.
BLOCKS, LARGE = 256, 4000
#: Rows that share one task when slots are counted.
BUCKET_ROWS = 100_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts (i, j) -> flow that ship all supply within capacity at least cost, by successive shortest paths with potentials."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are less than the supply")
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # to, room, cost, index of the reverse edge

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    level = [0] * len(graph)
    left = sum(supply)
    while left:
        dist, back = [float("inf")] * len(graph), [None] * len(graph)
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                if room and d + price + level[a] - level[b] < dist[b]:
                    dist[b] = d + price + level[a] - level[b]
                    back[b] = (a, k)
                    heapq.heappush(heap, (dist[b], b))
        for v, d in enumerate(dist):
            level[v] += d if d < float("inf") else 0
        amount, v = left, sink
        while v != source:
            a, k = back[v]
            amount, v = min(amount, graph[a][k][1]), a
        v = sink
        while v != source:
            a, k = back[v]
            graph[a][k][1] -= amount
            graph[v][graph[a][k][3]][1] += amount
            v = a
        left -= amount
    return {(i, b - n): graph[b][k][1] for i in range(n) for b, _, _, k in graph[i] if n <= b < n + m and graph[b][k][1]}


def plan_blocks(blocks: list[tuple[int, int, int]], new_shards: int) -> list[tuple[int, int, int]]:
    """(old shard, block, new shard) for blocks (old shard, block, bytes): the flow by whole blocks, largest first.

    A new shard that an old one has bytes left to give takes the block that fits best; blocks that overfill every share go to the emptiest shard.
    """
    total = sum(b[2] for b in blocks)
    old = sorted({b[0] for b in blocks})
    supply = [sum(b[2] for b in blocks if b[0] == o) for o in old]
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(old[i] != j))
    due = {i: {j: f for (a, j), f in flow.items() if a == i} for i in range(len(old))}
    room = list(capacity)
    index = {o: i for i, o in enumerate(old)}
    out = []
    for o, block, size in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        mine = due[index[o]]
        fits = [j for j, f in mine.items() if f >= size and room[j] >= size]
        if o in fits:
            j = o
        elif fits:
            j = max(fits, key=lambda j: (mine[j], -j))
        else:
            j = max(range(new_shards), key=lambda j: (room[j], -j))
        if j in mine:
            mine[j] = max(0, mine[j] - size)
        room[j] -= size
        out.append((o, block, j))
    return out


def reshard(rows: DataFrame, new_shards: int, blocks: int = BLOCKS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with ``old_shard``, ``size`` and ``row_key`` (a long that spreads rows)."""
    spark = rows.sparkSession
    rows = materialize(rows, "reshard")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    block = F.when(F.col("size") * LARGE > total, blocks + F.pmod("row_key", F.lit(1 << 40))).otherwise(F.pmod("row_key", F.lit(blocks)))
    # Numbers of large rows stay apart from those of hashed blocks; rows with equal keys are one block.
    rows = rows.withColumn("block", block.cast("long"))
    sizes = [(r["old_shard"], r["block"], r["size"]) for r in rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size")).collect()]  # at most shards x blocks + LARGE rows
    moved = spark.createDataFrame(plan_blocks(sizes, new_shards) if sizes else [], "old_shard int, block long, shard int")
    placed = rows.join(F.broadcast(moved), ["old_shard", "block"])  # as many rows as blocks
    buckets = max(1, -(-n // BUCKET_ROWS))
    dealt = placed.withColumn("bucket", F.pmod(F.shiftrightunsigned("row_key", 17), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").count().withColumn("before", F.expr("sum(count) over (partition by shard order by bucket) - count")).select("shard", "bucket", "before")
    own = F.expr("row_number() over (partition by shard, bucket order by row_key)")
    return dealt.withColumn("own", own).join(counts, ["shard", "bucket"]).withColumn("slot", F.col("own") - 1 + F.col("before")).drop("own", "before", "bucket")


def rewrite_affected(placed: DataFrame, path: str) -> DataFrame:
    """Write the shards that gave or took rows, each in the order of its slots; every other shard keeps its very files. Returns the shards written.

    ``path`` is a table of ``corpusloom.operators.partitions`` with the key ``shard``; a first call on an empty folder should give all shards as changed. A shard that
    gave all its rows goes. The change shows as a whole or not at all.
    """
    changed = placed.where(~F.col("old_shard").eqNullSafe(F.col("shard")))
    touched = materialize(changed.select("shard").union(changed.select(F.col("old_shard").alias("shard"))).where("shard is not null").distinct(), "touched")
    rows = placed.join(F.broadcast(touched), "shard", "left_semi").drop("row_key", "block")  # as many rows as shards
    emptied = touched.join(rows.select("shard").distinct(), "shard", "left_anti")
    partitions.change(rows, path, "shard", ["slot"], removed=emptied, form="parquet")
    return touched


def op2(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """The documents lie in ``old_shards`` by a hash of their id; ``bytes`` is the law of the new shards."""
    raw = F.col("text").cast("string").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(raw), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # The row's number keeps equal rows apart; `reshard` writes the key down at once, so it holds from then on.
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())).withColumn("old_shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(old_shards)).cast("int"))
    return reshard(rows, new_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")
