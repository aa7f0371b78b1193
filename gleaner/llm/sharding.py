"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups above a 4096th of all bytes or of all rows, at most 8192 by those bounds, are differenced first, on the
driver. All others go to chunks of bounded length by the hash of their digest; each chunk is
differenced in one task and starts from the heavy groups' partial partition scaled to its share of
the bytes, so it fills the shards that these left short. Rows join their group's shard by digest;
rows of heavy groups by broadcast of those at most 8192 digests.

Defined results: a null text has no bytes and groups with empty texts; equal doc_ids with equal
texts share a shard and have slots of their own; a null doc_id comes first; an empty table gives an
empty result. A group larger than a shard's share leaves its shard larger than the others.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import parts_for, running_total, stage, text_of

HEAVY_SHARE = 4096
#: Groups of fewer rows are never heavy by their rows.
HEAVY_ROWS = 1_000


def difference(weights: list[float], shards: int, start: list[float] | None = None) -> list[int]:
    """The shard of each weight: partial partitions of largest spread are combined, oppositely
    ordered, until one is left. ``start`` is a partial partition given, whose order fixes the
    shards' numbers."""
    if not weights and start is None:
        return []
    # A node is (sums from small to large, left child, right child, where each sum came from in the two).
    nodes: list[tuple] = []
    heap: list[tuple[float, int]] = []

    def push(sums: list[float], left: int, right: int, froms: list[tuple[int, int]] | None) -> None:
        order = sorted(range(shards), key=sums.__getitem__)
        low = sums[order[0]]
        nodes.append(([sums[i] - low for i in order], left, right, [froms[i] for i in order] if froms else order))
        heapq.heappush(heap, (low - sums[order[-1]], len(nodes) - 1))

    empty = [0.0] * (shards - 1)
    for w in weights:
        push([*empty, w], -1, -1, None)
    if start is not None:
        push(list(start), -1, -1, None)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb = nodes[a][0], nodes[b][0]
        push([x + y for x, y in zip(sa, reversed(sb), strict=True)], a, b, [(i, shards - 1 - i) for i in range(shards)])
    # Downwards: labels[i] is the shard of a node's i-th sum.
    labels: dict[int, list[int]] = {heap[0][1]: list(range(shards))}
    out = [0] * len(weights)
    given = list(range(shards))
    for k in range(len(nodes) - 1, -1, -1):
        sums, left, right, froms = nodes[k]
        mine = labels.pop(k)
        if left >= 0:
            la, lb = [0] * shards, [0] * shards
            for shard, (i, j) in zip(mine, froms, strict=True):
                la[i], lb[j] = shard, shard
            labels[left], labels[right] = la, lb
        elif k < len(weights):
            out[k] = mine[-1]
        else:
            for shard, position in zip(mine, froms, strict=True):
                given[position] = shard
    if start is None:
        return out
    number = {shard: position for position, shard in enumerate(given)}
    return [number[s] for s in out]


def shard_by_bytes(docs: DataFrame, *, shards: int = 8, chunk_groups: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = text_of(docs)
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        ),
        "sizes",
    )
    groups = stage(rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.count("*").alias("rows")), "groups")
    total, n, count = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    is_heavy = (F.col("weight") > total / HEAVY_SHARE) | (F.col("rows") > max(count / HEAVY_SHARE, HEAVY_ROWS))
    heavy = groups.where(is_heavy).orderBy(F.desc("weight"), "digest").collect()  # < 2 * HEAVY_SHARE rows
    placed = difference([float(g.weight) for g in heavy], shards)
    start = [0.0] * shards
    for g, s in zip(heavy, placed, strict=True):
        start[s] += g.weight
    of_heavy = spark.createDataFrame([(bytes(g.digest), s) for g, s in zip(heavy, placed, strict=True)], "digest binary, shard int")
    light_total = max(1.0, total - sum(start))

    def one_chunk(table: pa.Table) -> pa.Table:
        table = table.sort_by([("weight", "descending"), ("digest", "ascending")])
        weights = table["weight"].to_pylist()
        share = sum(weights) / light_total
        return pa.table({"digest": table["digest"], "shard": pa.array(difference([float(w) for w in weights], shards, [x * share for x in start]), pa.int32())})

    light = groups.where(~is_heavy).withColumn("chunk", F.pmod(F.xxhash64("digest"), F.lit(parts_for(n, chunk_groups))))
    of_light = light.groupBy("chunk").applyInArrow(one_chunk, "digest binary, shard int")
    marked = rows.join(F.broadcast(of_heavy), "digest", "left")
    rest = marked.where(F.col("shard").isNull()).drop("shard").join(of_light, "digest")
    both = stage(marked.where(F.col("shard").isNotNull()).unionByName(rest).drop("digest"), "shards")
    out = running_total(both, ["shard"], ["doc_id", "text_crc32", "row"], F.lit(1).cast("long"), "doc_id", parts_for(count, 50_000), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
