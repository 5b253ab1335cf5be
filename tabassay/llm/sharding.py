"""Sharding by a hierarchical weighted hash tree of regions, racks and shards.

Every shard makes a draw for a document: an exponential number from a hash of the document's key
and the shard, divided by the shard's weight. A rack's draw is the least of its shards' and a
region's the least of its racks'; that is again a draw with the summed weight. A document descends
to the region with the least draw, in it to the rack, in it to the shard. A draw depends on nothing
but its own subtree, so a changed weight moves documents only into or out of the shards whose weight
changed, and a new shard takes documents only into itself.

The law is ``key``: key and tree decide; copies of a text go their own ways. Null keys share one
shard. Null text: size 8, crc32 0. Repeated rows and keys each get a slot of their own. Slots are
gapless in each shard from 0, numbered by input partition, without moving rows to one task per
shard. Empty tables give empty results; extra columns are not read. Ties of draws (never seen in 63
bits) go to the lower number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .tables import load, stage, texts


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, racks_per_region: int = 3) -> list[Shard]:
    """Equal shards filled rack by rack; a tree of one more shard only adds that one."""
    return [Shard(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]


def _draw(key: Column, leaf: Shard) -> Column:
    """Exponential with rate ``weight``."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(leaf.shard)), 11)  # 53 bits
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(leaf.weight))


def _least(columns: list) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def _descend(draws: Column, nodes, level: int) -> Column:
    """Shard number under the node with the least draw; ``draws`` has a field for each leaf."""
    if level == 3:
        return F.lit(nodes[0].shard)
    groups: dict = {}
    for leaf in nodes:
        groups.setdefault((leaf.region, leaf.rack, leaf.shard)[level], []).append(leaf)
    node_draw = {g: _least([draws[f"s{x.shard}"] for x in inside]) for g, inside in groups.items()}
    order = sorted(groups)
    best = _least([node_draw[g] for g in order])
    chosen = None
    for g in reversed(order):
        below = _descend(draws, groups[g], level + 1)
        chosen = below if chosen is None else F.when(node_draw[g] == best, below).otherwise(chosen)
    return chosen


def shard_of(docs: DataFrame, key: Column, leaves: list[Shard], out_col: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row's key."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard with a weight")
    drawn = docs.withColumn("_draws", F.struct(*[_draw(key, x).alias(f"s{x.shard}") for x in live]))
    return drawn.withColumn(out_col, _descend(F.col("_draws"), live, 0).cast("int")).drop("_draws")


def _number(batches):
    """Adds the input partition and the row's number among its partition's rows of the shard."""
    part, taken = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        if not len(shard):
            continue
        if shard.max() >= len(taken):
            taken = np.concatenate([taken, np.zeros(int(shard.max()) + 1 - len(taken), np.int64)])
        order = np.argsort(shard, kind="stable")
        in_order = shard[order]
        first = np.searchsorted(in_order, in_order)
        local = np.empty(len(shard), np.int64)
        local[order] = np.arange(len(shard)) - first + taken[in_order]
        taken += np.bincount(shard, minlength=len(taken))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int64)), pa.array(local)],
                                         [*batch.schema.names, "part", "local"])


def with_slots(placed: DataFrame) -> DataFrame:
    """``placed`` with slot: a gapless number within each shard."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields), "part long", "local long"])
    rows = stage(placed.mapInArrow(_number, schema), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = (rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
             .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return rows.join(start, ["shard", "part"]).withColumn("slot", F.col("start") + F.col("local")).drop("part", "local", "start")


def place(docs: DataFrame, leaves: list[Shard], grown: list[Shard] | None = None, **columns) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, for a second tree, grown_shard."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = texts(docs, **columns).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = shard_of(rows, F.col("doc_id"), leaves)
    rows = shard_of(rows, F.col("doc_id"), grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    return with_slots(rows)


SHARDS = 24


def query(spark, sf_dir):
    placed = place(load(spark, sf_dir, "documents"), tree(SHARDS), tree(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
