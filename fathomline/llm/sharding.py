"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.hot import spread_join
from fathomline.session import partitions_of, saved

#: Blocks for a shard: packing groups into blocks and blocks into shards keeps either step small.
BLOCKS_A_SHARD = 100
#: Blocks that one task packs into shards where a capacity is given: some hundreds of full shards.
BLOCKS_A_CELL = 1 << 16


class Room:
    """Open bins by remaining capacity, in a balanced tree: 64 children a node, each of equal depth, a bit for each that isn't empty."""

    def __init__(self, capacity: int) -> None:
        self.levels: list[dict[int, int]] = [{} for _ in range(max(1, -(-max(capacity, 1).bit_length() // 6)))]
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, bin_: int) -> None:
        if room in self.bins:
            heappush(self.bins[room], bin_)
            return
        self.bins[room] = [bin_]
        for level in self.levels:
            node, bit = room >> 6, 1 << (room & 63)
            was = level.get(node, 0)
            level[node] = was | bit
            if was:
                return
            room = node

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the bin with the least room that holds ``size``, the first of equals."""
        at, found = size, None
        for up, level in enumerate(self.levels):  # up until a node has a child at or behind the place
            above = level.get(at >> 6, 0) >> (at & 63)
            if above:
                found = at + ((above & -above).bit_length() - 1)
                break
            at = (at >> 6) + 1
        if found is None:
            return None
        for level in reversed(self.levels[:up]):  # and down to the first
            held = level[found]
            found = (found << 6) + ((held & -held).bit_length() - 1)
        bin_ = heappop(self.bins[found])
        if not self.bins[found]:
            del self.bins[found]
            self._empty(found)
        return found, bin_

    def _empty(self, room: int) -> None:
        for level in self.levels:
            node = room >> 6
            level[node] &= ~(1 << (room & 63))
            if level[node]:
                return
            del level[node]
            room = node


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, which must come in descending order; one over ``capacity`` gets a bin of its own."""
    out, room, bins = np.empty(len(sizes), np.int64), Room(capacity), 0
    for i, size in enumerate(sizes.tolist()):
        found = room.tightest(size)
        left, at = found if found else (capacity, bins)
        bins += not found
        out[i] = at
        if left > size:
            room.add(left - size, at)
    return out


def level(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each size (descending) for ``bins`` bins of near-equal sums: the least capacity that suffices.

    A size of a bin's fair share or more gets a bin alone, and the share of the rest is taken anew.
    """
    alone, total = 0, int(sizes.sum())
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) >= total:
        total -= int(sizes[alone])
        alone += 1
    rest, bins = sizes[alone:], bins - alone
    if not len(rest):
        return np.arange(alone)
    low, high = max(int(rest[0]), -(-total // bins)), int(rest[0]) + -(-total // bins)
    while low < high:
        mid = (low + high) // 2
        if best_fit(rest, mid).max() < bins:
            high = mid
        else:
            low = mid + 1
    return np.concatenate([np.arange(alone), alone + best_fit(rest, low)])


def _packed(groups: DataFrame, capacity: int, cells: int) -> DataFrame:
    """``(group, size, cell, block)``: groups packed into blocks of ``capacity`` within cells dealt by hash."""

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "group"], ascending=[False, True])
        return x.assign(block=best_fit(x["size"].to_numpy(), capacity))

    cell = groups.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)))
    return cell.groupBy("cell").applyInPandas(pack, "group binary, size bigint, cell bigint, block bigint")


def shards_of_groups(groups: DataFrame, shards: int | None = None, capacity: int | None = None, cells: int | None = None) -> DataFrame:
    """``(group, size, shard)`` for distinct ``group`` (binary) with ``size``: ``shards`` of near-equal size, or as few as best fit needs at ``capacity``.

    Best fit decreasing is sequential, so it runs in two steps whose tasks are bounded.  Groups of a cell, dealt by
    hash, enter the tightest block that has room, largest first; then blocks enter shards the same way.  A block
    but the last of each cell is over half full or a single group, and blocks are a BLOCKS_A_SHARD-th of a shard.

    What that loses against one sequence over all groups: a shard that is closed to all blocks has room for less than
    the smallest block left.  With ``shards`` blocks are at most 2 * BLOCKS_A_SHARD a shard and one for each cell; that
    table alone is packed in one place, and shards differ by at most the smallest blocks, a hundredth of a shard, or
    less as the last, small blocks level them.  With ``capacity`` blocks are packed in tasks of about BLOCKS_A_CELL
    blocks, several hundred shards, of which each leaves at most one shard less than half full: under one per cent more shards.
    A group is never split: one larger than a shard makes its shard larger.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give shards or capacity")
    groups = saved(groups)
    total = groups.agg(F.sum("size").alias("n")).first()["n"] or 0
    cells = cells or partitions_of(groups.sparkSession)
    block = max(1, total // (shards * BLOCKS_A_SHARD) if shards else capacity // BLOCKS_A_SHARD)
    packed = saved(_packed(groups, block, cells))
    blocks = packed.groupBy("cell", "block").agg(F.sum("size").alias("size"))
    if shards:
        held = blocks.toPandas()  # at most 200 rows for each shard and one for each cell
        held = held.sort_values(["size", "cell", "block"], ascending=[False, True, True])
        held["shard"] = level(held["size"].to_numpy(np.int64), shards).astype(np.int32)
        where = groups.sparkSession.createDataFrame(held[["cell", "block", "shard"]], "cell bigint, block bigint, shard int")
        return packed.join(F.broadcast(where), ["cell", "block"]).select("group", "size", "shard")

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "cell", "block"], ascending=[False, True, True])
        return x.assign(place=best_fit(x["size"].to_numpy(), capacity))[["cell", "block", "wide", "place"]]

    wide = F.pmod(F.xxhash64("cell", "block"), F.lit(-(-blocks.count() // BLOCKS_A_CELL) or 1))
    placed = saved(blocks.withColumn("wide", wide).groupBy("wide").applyInPandas(pack, "cell bigint, block bigint, wide bigint, place bigint"))
    each = placed.groupBy("wide").agg((F.max("place") + 1).alias("n"))
    each = each.select("wide", (F.sum("n").over(Window.orderBy("wide")) - F.col("n")).alias("before"))  # a row for each BLOCKS_A_CELL blocks
    where = placed.join(F.broadcast(each), "wide").select("cell", "block", (F.col("before") + F.col("place")).cast("int").alias("shard"))
    return packed.join(where, ["cell", "block"]).select("group", "size", "shard")


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, buckets: int = 64) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for each row of ``docs``: ``shards`` of near-equal bytes, equal texts together.

    A row's size is its text in UTF-8 plus ``overhead``.  Slots of a shard count from 0 by bucket of id
    and then id, numbered by bucket so that no task sorts a shard.  Null text counts as empty; repeated
    rows, null ids and ties get slots of their own; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    digest = F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), digest.alias("group"))
    rows = saved(rows)
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("held"))
    placed = shards_of_groups(groups.select("group", "size"), shards).select("group", "shard").join(groups.select("group", "held"), "group")
    rows = spread_join(rows, saved(placed), "group", "held").drop("held").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    each = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    each = each.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "group"))
    numbered = rows.withColumn("place", place).join(F.broadcast(each), ["shard", "bucket"])  # a row for each shard and bucket
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))
