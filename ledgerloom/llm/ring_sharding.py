"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A document's key is its text, so equal texts meet at one place of the ring. The ring has `cells` equal cells; each shard
has `vnodes` virtual nodes on cell borders, and a key belongs to the first virtual node clockwise of its cell. Shards are
bounded: what a virtual node cannot place in its own shard goes on clockwise to the next ones, in rounds, the nearest
first. A row goes where its middle byte falls, so no shard takes more than (1 + epsilon) / shards of all bytes and, at the
place where it is full, one text. Equal texts lie side by side and are in one shard but where a shard is full: at most
2 * shards texts are split. Law: `bytes`, sizes near equal.

Texts are read once: doc_id, size and hashes of each row go to a checkpoint. Only the cells' totals and the texts that are
more than a `hot_share` of all rows reach the driver, at most `cells` and 1 / `hot_share` rows, whatever the input. There
the walk is done; it gives byte ranges of each virtual node's keys to shards. A key's place in that order is a prefix sum
in two levels: over units and inside a unit. A cell has a unit for each `unit_rows` rows, by the text's hash, and a hot
text has units of its own, so no window holds more than about `unit_rows` rows and a `hot_share` of all.

Defined results: null text has no bytes and size 1, and shares its place with empty texts; null doc_ids count like
others; repeated rows each get a slot of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import cut, rows_of_literals


@dataclass(frozen=True)
class Ring:
    shards: int = 8
    vnodes: int = 64
    cells: int = 4096
    epsilon: float = 0.002
    unit_rows: int = 500
    hot_share: float = 1 / 512


def _mix(x: int) -> int:
    """splitmix64's finaliser."""
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def nodes_of(ring: Ring) -> list[tuple[int, int]]:
    """(last cell, shard) of each virtual node, clockwise; a place that two draw goes to the smaller shard."""
    placed: dict[int, int] = {}
    for shard in range(ring.shards):
        for v in range(ring.vnodes):
            at = _mix(shard * 1_000_003 + v) % ring.cells
            placed[at] = min(shard, placed.get(at, shard))
    return sorted(placed.items())


def owner_of(ring: Ring, nodes: list[tuple[int, int]]) -> list[int]:
    """The virtual node of each cell: the first at or after it, around the ring."""
    out, k = [], 0
    for cell in range(ring.cells):
        while k < len(nodes) and nodes[k][0] < cell:
            k += 1
        out.append(k % len(nodes))
    return out


def walk(totals: dict[int, int], nodes: list[tuple[int, int]], ring: Ring) -> list[tuple[int, int, int, int]]:
    """Bounded loads: (node, from byte, to byte, shard) of every node's keys, in their order within the node."""
    room = [math.ceil((1 + ring.epsilon) * sum(totals.values()) / ring.shards)] * ring.shards
    pending, out = dict(totals), []
    done = dict.fromkeys(totals, 0)
    for step in range(len(nodes)):
        for node in sorted(k for k, v in pending.items() if v):
            shard = nodes[(node + step) % len(nodes)][1]
            if took := min(pending[node], room[shard]):
                out.append((node, done[node], done[node] + took, shard))
                room[shard] -= took
                done[node] += took
                pending[node] -= took
        if not any(pending.values()):
            break
    return out


def _cell(text: Column, ring: Ring) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(ring.cells)).cast("int")


def shard_documents(docs: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard of each row."""
    spark: SparkSession = docs.sparkSession
    bytes_of = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = cut(
        docs.select(
            "doc_id", (F.octet_length(bytes_of) + 1).cast("long").alias("size"), F.crc32(bytes_of).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("place"), _cell(F.col("text"), ring).alias("cell"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    same = ["place", "text_crc32", "size"]
    totals = keys.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # ring.cells rows at most
    least = max(ring.unit_rows, ring.hot_share * sum(r["rows"] for r in totals))
    often = keys.groupBy("cell", *same).count().where(F.col("count") > least).orderBy(*same).collect()  # 1 / ring.hot_share rows at most
    nodes = nodes_of(ring)
    owner, by_node, cold = owner_of(ring, nodes), {}, {r["cell"]: r["rows"] for r in totals}
    for r in totals:
        by_node[owner[r["cell"]]] = by_node.get(owner[r["cell"]], 0) + r["bytes"]
    for r in often:
        cold[r["cell"]] -= r["count"]
    cells = rows_of_literals(spark, [(c, owner[c], nodes[owner[c]][1], max(1, -(-n // ring.unit_rows))) for c, n in cold.items()] or [(0, 0, 0, 1)], "cell int, node int, home_shard int, subs int")
    hot = rows_of_literals(spark, [(*(r[k] for k in same), -1 - i, -(-r["count"] // ring.unit_rows)) for i, r in enumerate(often)] or [(0, 0, 0, -1, 1)], "place long, text_crc32 long, size long, own_sub int, salts int")
    ranges = rows_of_literals(spark, walk(by_node, nodes, ring) or [(0, 0, 1, 0)], "at_node int, low long, high long, shard int")

    # a unit: the texts of a cell whose hash falls to it, or a share of the rows of one hot text
    unit = ["node", "cell", "sub", "salt"]
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("doc_id"))
    rows = keys.join(F.broadcast(cells), "cell").join(F.broadcast(hot), same, "left")  # ring.cells and 1 / ring.hot_share rows at most
    rows = rows.withColumn("sub", F.coalesce("own_sub", F.pmod(F.xxhash64("place"), F.col("subs")).cast("int"))).withColumn("salt", F.coalesce(F.pmod(spread, F.col("salts")).cast("int"), F.lit(0)))
    units = rows.groupBy(*unit).agg(F.sum("size").alias("unit_bytes"))
    before = Window.partitionBy("node").orderBy("cell", "sub", "salt").rowsBetween(Window.unboundedPreceding, -1)
    units = units.select(*unit, F.coalesce(F.sum("unit_bytes").over(before), F.lit(0)).alias("unit_from"))
    inside = Window.partitionBy(*unit).orderBy(*same, "doc_id", "row")
    placed = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(units, unit)
    # a key goes where its middle byte falls
    placed = placed.withColumn("middle", F.col("unit_from") + F.col("upto") - F.col("size") + F.floor((F.col("size") - 1) / 2))
    placed = placed.join(F.broadcast(ranges), (F.col("node") == F.col("at_node")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high")))  # 2 * nodes * shards rows at most

    part = ["shard", *unit]
    counts = placed.groupBy(*part).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*part, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first_slot"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy(*part).orderBy("upto", "row")))
    slotted = numbered.join(counts, part).withColumn("slot", (F.col("first_slot") + F.col("k") - 1).cast("long"))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
