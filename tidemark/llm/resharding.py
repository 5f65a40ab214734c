"""Resharding that moves the fewest bytes.

Documents lie in old shards; new shards have capacities. A minimum-cost flow from old shard sizes to
new capacities, where staying costs nothing and moving costs a unit a byte, says how many bytes go
where. Blocks then realize the flow: a shard's documents fall into blocks by the hash of their
text, and whole blocks, large ones first, go where they fit. The few blocks that fit nowhere are cut
into parts by the hash of ``doc_id``, which go the same way. So equal texts stay together except in
blocks that had to be cut, and a text that a third of all documents share is no obstacle.

Block and part sizes are the only things that reach the driver: at most ``BLOCKS`` blocks a shard and
``PARTS`` parts a cut block, and as many rows go back in broadcast tables. Neither grows with the data.

The law held is ``bytes``: shard sizes differ by about the smallest part.

Rules: a document's size is its UTF-8 bytes (null text: none) and ``OVERHEAD``. Null ids, repeated ids and
repeated rows are documents like others. Columns besides ``doc_id`` and ``text`` that the caller
passes are rewritten as they are, except those named ``old_shard``, ``shard``, ``slot`` or ``size``, which this
operator's own replace.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import written

SHARDS, OLD_SHARDS = 24, 20
BLOCKS, PARTS = 256, 1024
OVERHEAD = 8
LAW = "bytes"


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest flow that ships all supply within capacities, by shortest augmenting paths."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the supply")
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, left, cost; each followed by its reverse
    of: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        of[a].append(len(edges))
        edges.append([b, room, price])
        of[b].append(len(edges))
        edges.append([a, 0, -price])

    total = sum(supply)
    for i, s in enumerate(supply):
        add(source, i, s, 0)
    for i in range(n):
        for j in range(m):
            add(i, n + j, total, cost[i][j])
    for j, c in enumerate(capacity):
        add(n + j, sink, c, 0)
    sent = 0
    while sent < total:
        dist, by = [math.inf] * len(of), [-1] * len(of)
        dist[source], queue = 0, [source]
        while queue:
            later = []
            for a in queue:
                for e in of[a]:
                    b, room, price = edges[e]
                    if room and dist[a] + price < dist[b]:
                        dist[b], by[b] = dist[a] + price, e
                        later.append(b)
            queue = list(dict.fromkeys(later))
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = edges[by[at] ^ 1][0]
        step = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= step
            edges[e ^ 1][1] += step
        sent += step
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in of[i]:
            b, room, _ = edges[e]
            if not e & 1 and n <= b < n + m:
                flow[i][b - n] = edges[e ^ 1][1]
    return flow


@dataclass(frozen=True)
class Plan:
    """Where blocks, and parts of cut blocks, go; ``flow`` has bytes by old and new shard."""

    flow: list[list[int]]
    blocks: dict[tuple[int, int], int]
    parts: dict[tuple[int, int, int], int]
    old_shards: int
    shards: int


def _fill(items: list[tuple], quotas: dict[int, dict[int, int]], room: list[int], rest: bool) -> tuple[dict, list]:
    """Put (size, old shard, key) items, large first, where the flow has room for them: at home if
    possible, else where most is left. What fits nowhere is returned, or, with ``rest``, put into
    the shard with most room."""
    placed, left = {}, []
    for size, i, key in sorted(items, reverse=True):
        fits = [j for j, quota in quotas[i].items() if quota >= size and room[j] >= size]
        if fits:
            target = max(fits, key=lambda j: (j == i, quotas[i][j], -j))
        elif rest:
            target = max(range(len(room)), key=lambda j: (room[j], j == i, -j))
        else:
            left.append((size, i, key))
            continue
        placed[key] = target
        quotas[i][target] = quotas[i].get(target, 0) - size
        room[target] -= size
    return placed, left


def old_shard_by_text(old_shards: int = OLD_SHARDS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(old_shards))


def _placed(docs: DataFrame, old_shard: Column) -> DataFrame:
    """``row`` (the columns of ``docs``, as a struct) with size, old shard, block and part."""
    text = F.coalesce("row.text", F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), old_shard.cast("int").alias("old_shard")).select(
        "row",
        "old_shard",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.pmod(F.xxhash64(text, F.lit("block")), F.lit(BLOCKS)).cast("int").alias("block"),
        F.pmod(F.xxhash64("row.doc_id", text, F.lit("part")), F.lit(PARTS)).cast("int").alias("part"),
    )


def plan_shards(docs: DataFrame, old_shard: Column, shards: int = SHARDS) -> Plan:
    """Solve the transfers for equal capacities."""
    sized = written(
        _placed(docs, old_shard).groupBy("old_shard", "block", "part").agg(F.sum("size").alias("size")),
        "sizes",
    )
    blocks = [tuple(r) for r in sized.groupBy("old_shard", "block").agg(F.sum("size")).collect()]
    by_shard: dict[int, list] = defaultdict(list)
    for shard, block, size in blocks:
        by_shard[shard].append((size, block))
    old_shards = max(by_shard, default=0) + 1
    supply = [sum(s for s, _ in by_shard[i]) for i in range(old_shards)]
    total = sum(supply)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    cost = [[int(i != j) for j in range(shards)] for i in range(old_shards)]
    flow = min_cost_flow(supply, capacity, cost)
    quotas = {i: {j: x for j, x in enumerate(flow[i]) if x} for i in range(old_shards)}
    room = list(capacity)
    whole, left = _fill([(size, i, (i, b)) for i in by_shard for size, b in by_shard[i]], quotas, room, rest=False)
    moved = {}
    if left:
        wanted = docs.sparkSession.createDataFrame([key for _, _, key in left], "old_shard int, block int")
        parts = sized.join(F.broadcast(wanted), ["old_shard", "block"], "left_semi").collect()
        items = [(r["size"], r["old_shard"], (r["old_shard"], r["block"], r["part"])) for r in parts]
        moved, _ = _fill(items, quotas, room, rest=True)
    return Plan(flow, whole, moved, old_shards, shards)


def apply_plan(docs: DataFrame, plan: Plan, old_shard: Column) -> DataFrame:
    """``row``, ``size``, ``old_shard``, ``shard`` and ``cell``: what is numbered together in a shard."""
    spark = docs.sparkSession
    blocks = spark.createDataFrame(
        [(*k, j) for k, j in plan.blocks.items()], "old_shard int, block int, block_shard int"
    )
    parts = spark.createDataFrame(
        [(*k, j) for k, j in plan.parts.items()], "old_shard int, block int, part int, part_shard int"
    )
    # Broadcast: at most BLOCKS rows an old shard, and PARTS rows a cut block.
    joined = _placed(docs, old_shard).join(F.broadcast(blocks), ["old_shard", "block"], "left")
    joined = joined.join(F.broadcast(parts), ["old_shard", "block", "part"], "left")
    whole = F.col("block_shard").isNotNull()
    cell = F.col("old_shard") * BLOCKS + F.col("block")
    return (
        joined.withColumn("shard", F.coalesce("block_shard", "part_shard"))
        .withColumn("cell", cell.cast("long") * (PARTS + 1) + F.when(whole, F.lit(0)).otherwise(F.col("part") + 1))
        .drop("block", "part", "block_shard", "part_shard")
    )


def rewrite(docs: DataFrame, plan: Plan, old_shard: Column, folder: str, untouched: bool = False) -> DataFrame:
    """Write the affected shards, those that give or take bytes, under ``folder`` (one folder a
    shard), and return their rows as read back, with ``slot``: the place in the shard, from 0. With
    ``untouched`` also the rows of all other shards, which are numbered and not written."""
    n_old, affected = plan.old_shards, []
    for j in range(plan.shards):
        stays = plan.flow[j][j] if j < n_old else 0
        if sum(row[j] for row in plan.flow) != stays or j < n_old and sum(plan.flow[j]) != stays:
            affected.append(j)
    rest = untouched and len(affected) < plan.shards
    assigned = apply_plan(docs, plan, old_shard)
    assigned = assigned if rest else assigned.where(F.col("shard").isin(affected))
    counts = written(assigned.groupBy("shard", "cell").agg(F.count("*").alias("n")), "cells")
    # Rows here are cells, of which a shard has a bounded number.
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = assigned.withColumn("deal", F.pmod(F.xxhash64("cell"), F.lit(math.ceil(partitions / plan.shards))))
    dealt = dealt.join(F.broadcast(offsets), ["shard", "cell"]).repartition("shard", "deal")
    inside = Window.partitionBy("shard", "deal", "cell").orderBy("row.doc_id", F.xxhash64("row.text"))
    numbered = dealt.withColumn("slot", (F.row_number().over(inside) - 1 + F.col("before")).cast("long"))
    own = ["size", "old_shard", "slot", "shard"]
    kept = [f"row.{c}" for c in docs.columns if c not in own]
    made = numbered.select(*kept, *own)
    moved = made.where(F.col("shard").isin(affected)) if rest else made
    moved.write.partitionBy("shard").parquet(folder)
    back = docs.sparkSession.read.schema(made.schema).parquet(folder)
    return back.unionByName(made.where(~F.col("shard").isin(affected))) if rest else back
