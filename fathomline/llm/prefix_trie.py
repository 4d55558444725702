"""Trie of conversation prefixes: ROLLUP over columns of turns aggregates all prefixes of a block at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.hot import spread_join
from fathomline.session import partitions_of, saved

#: Turns that are columns of one row; longer conversations go on in further rows.
WIDTH = 8
#: Blocks, and groups of them, whose names one row holds while prefixes are named.
FAN = 64
#: Bytes of ids that one row holds while they are digested.
PACK = 1 << 16
COLUMNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256)), 1, 16)


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``(conv, pos, id, size)`` of ``rows(conv_id, turn, role, text)``: positions from 1, a digest of role and text, UTF-8 bytes of the text.

    Turns come in the order of ``turn``, null first, then of role and digest.  Null roles and texts count as empty;
    rows without a conv_id belong to no conversation.  A conversation of any share of the rows is dealt to many tasks:
    rows are sorted by range, and each range counts on from those before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = _digest(F.length(role).cast("string"), F.lit(":"), role, text)
    told = rows.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), name.alias("id"), F.octet_length(text).cast("long").alias("size"))
    order = ["conv", "turn", "role", "id"]
    dealt = told.where("conv is not null").repartitionByRange(partitions_of(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = saved(dealt.select("conv", "id", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    spans = dealt.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    spans = spans.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return dealt.join(spans, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "id", "size")


def _named(blocks: DataFrame) -> DataFrame:
    """``blocks(conv, block, name, bytes)`` with names of the turns before each block and up to its end, and the bytes before it.

    FAN consecutive blocks are named by their own names and what comes before them, which their groups know in the same
    way, so no row holds more than FAN blocks however long a conversation is, and a conversation of n blocks takes
    log n rounds.
    """
    if blocks.where("block > 0").isEmpty():
        return blocks.withColumns({"before": F.lit(""), "above": F.lit(0).cast("long"), "after": F.sha2("name", 256)})
    held = F.array_sort(F.collect_list(F.struct(F.pmod("block", F.lit(FAN)).alias("at"), "name", "bytes")))
    groups = saved(blocks.groupBy("conv", F.floor(F.col("block") / FAN).alias("group")).agg(held.alias("held")))
    upper = _named(groups.select("conv", F.col("group").alias("block"), F.sha2(F.array_join("held.name", ""), 256).alias("name"), F.aggregate("held.bytes", F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes")))
    upper = upper.select("conv", F.col("block").alias("group"), F.col("before").alias("_before"), F.col("after").alias("_after"), F.col("above").alias("_above"))
    upto = lambda n: F.concat("_before", F.array_join(F.slice("held.name", F.lit(1), n), ""))
    each = groups.join(upper, ["conv", "group"]).select("*", F.explode("held").alias("b"))
    before = F.when(F.col("b.at") == 0, F.col("_before")).otherwise(F.sha2(upto(F.col("b.at")), 256))
    after = F.when(F.col("b.at") == FAN - 1, F.col("_after")).otherwise(F.sha2(upto(F.col("b.at") + 1), 256))
    above = F.col("_above") + F.aggregate(F.slice("held.bytes", F.lit(1), F.col("b.at")), F.lit(0).cast("long"), lambda a, x: a + x)
    return each.select("conv", (F.col("group") * FAN + F.col("b.at")).alias("block"), F.col("b.name").alias("name"), F.col("b.bytes").alias("bytes"), before.alias("before"), above.alias("above"), after.alias("after"))


def _rolled(rows: DataFrame, sums: str) -> DataFrame:
    """One row for each prefix: its conversations, their least id, and ``sums``; ``level`` turns of the block belong to it."""
    last = COLUMNS[-1]
    found = rows.sparkSession.sql(
        f"select block, before, above, {', '.join(COLUMNS)}, {WIDTH} - bit_count(grouping_id()) as level, count(*) as n_convs, min(conv) as conv_id, {sums}"
        f" from {{rows}} group by block, before, above, rollup({', '.join(COLUMNS)})",
        rows=rows,
    )
    # A block's empty prefix is the node above but for the root, and what ends before a level is not of that level.
    of_level = F.coalesce(*(F.when(F.col("level") == i, F.col(f"t{i}").isNotNull()) for i in range(1, WIDTH + 1)), F.col("block") == 0)
    ids = [F.when(F.col("level") >= i, F.coalesce(F.col(f"t{i}.id"), F.lit(bytearray()))).otherwise(F.lit(bytearray())) for i in range(1, WIDTH + 1)]
    shorter = [F.when(F.col("level") > i, x).otherwise(F.lit(bytearray())) for i, x in enumerate(ids, 1)]
    start = F.col("before").cast("binary")
    key = F.when(F.col("level") == WIDTH, F.unhex(f"{last}.after")).otherwise(_digest(start, *ids))
    up = F.when(F.col("level") > 1, _digest(start, *shorter)).when((F.col("level") == 1) & (F.col("block") > 0), F.unhex("before")).when(F.col("level") == 1, _digest(start))
    bytes_above = F.col("above")
    for i in range(1, WIDTH):
        bytes_above = bytes_above + F.when(F.col("level") > i, F.coalesce(F.col(f"t{i}.size"), F.lit(0))).otherwise(0)
    return found.where(of_level).select((F.col("block") * WIDTH + F.col("level")).alias("depth"), key.alias("key"), up.alias("parent_key"), bytes_above.alias("bytes_above"), "n_convs", "conv_id", *[s.split(" as ")[1] for s in sums.split(", ")])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All distinct prefixes of conversations, and where each conversation ends.

    ``turns(conv, pos, id, size)`` has positions from 1 without gaps, as ``ordered_turns`` gives them; ``convs(conv)``
    has each conversation once, also those without turns, which all end in the root.  Returns nodes ``(key, conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved)`` and ends ``(key, conv)``.  A node is known by its
    least conversation and its depth.  ``saved`` sums, over its subtree, each node's size of its last turn for all of its
    conversations but one.  No conversations give no nodes.

    WIDTH turns are columns of one row and ROLLUP aggregates all their prefixes together; longer conversations go on in further
    rows, keyed by the name of all turns before, so all blocks take part in one aggregation.  Sums over
    subtrees need no rounds either: a conversation is the least of its nodes from some depth to its end, so it saves what
    it shares above that depth, and members add up what they save.
    """
    held = turns.groupBy("conv", F.floor((F.col("pos") - 1) / WIDTH).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "size"))).alias("t"))
    bare = convs.join(turns.where("pos = 1").select("conv"), "conv", "left_anti").select("conv", F.lit(0).cast("long").alias("block"), F.array().cast(held.schema["t"].dataType).alias("t"))
    held = saved(held.unionByName(bare))
    ids = F.array_join(F.transform("t", lambda x: F.hex(x.id)), "")
    size = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x.size)
    named = _named(held.select("conv", "block", ids.alias("name"), size.alias("bytes")))
    whole = held.groupBy("conv").agg(F.sum(F.size("t")).alias("longest"), F.sum(size).alias("total"))
    at = lambda i: F.get("t", F.lit(i - 1))
    turn = lambda i: F.when(at(i).isNotNull(), F.struct(at(i).id.alias("id"), at(i)["size"].alias("size"), *([F.substring("after", 1, 32).alias("after")] if i == WIDTH else [])))
    short = lambda c: F.substring(c, 1, 32)
    rows = held.join(named.drop("name", "bytes"), ["conv", "block"]).join(whole, "conv")
    rows = saved(rows.select("conv", "block", short("before").alias("before"), "above", *(turn(i).alias(c) for i, c in enumerate(COLUMNS, 1)), "longest", "total"))

    first = _rolled(rows, "max(longest) as longest")
    least = first.groupBy(F.col("conv_id").alias("conv")).agg(F.min("bytes_above").alias("pre"), F.max((F.col("depth") == F.col("longest")).cast("long")).alias("leaf"))
    least = saved(least)
    marked = rows.join(least, "conv", "left").withColumns({"pre": F.coalesce("pre", "total"), "leaf": F.coalesce("leaf", F.lit(0))})
    nodes = _rolled(marked, "sum(pre) as pre, sum(leaf) as leaf")
    own = least.select(F.col("conv").alias("conv_id"), F.col("pre").alias("own"))
    saves = F.col("pre") - F.col("own") - (F.col("n_convs") - 1) * F.col("bytes_above")
    nodes = saved(nodes.join(own, "conv_id").select("key", "parent_key", "conv_id", "depth", "n_convs", F.col("leaf").alias("n_leaves"), saves.alias("saved")))

    children = nodes.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    below = spread_join(nodes.where("depth > 0"), above, "parent_key", "_n")
    out = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    start = F.col("before").cast("binary")
    full = F.unhex(f"{COLUMNS[-1]}.after")
    end = F.coalesce(full, _digest(start, *(F.coalesce(F.col(f"{c}.id"), F.lit(bytearray())) for c in COLUMNS[:-1])))
    ends = rows.where(F.col("longest") <= (F.col("block") + 1) * WIDTH).select(end.alias("key"), "conv")
    return below.select(*out).unionByName(root.select(*out)), ends


def listed_sha256(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``(key, sha256)``: SHA-256 in lowercase hex of each key's distinct-or-repeated longs, ascending, in decimal, joined by commas.

    Ranges of ``(key, number)`` are sorted and packed into rows of at most PACK bytes, so a key of any share of the rows is
    spread over many tasks; its packs, some thousand times fewer, then stream through one digest.
    """
    n = partitions_of(rows.sparkSession)
    dealt = rows.select(F.col(key).alias("key"), F.col(number).cast("long").alias("number")).where("number is not null").repartitionByRange(n, "key", "number").sortWithinPartitions("key", "number")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("pack", pa.binary())])
        for x in batches:
            out: dict[str, list] = {"key": [], "first": [], "pack": []}
            texts: list[str] = []
            size = 0
            for k, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                if not texts or out["key"][-1] != k or size > PACK:
                    if texts:
                        out["pack"].append(",".join(texts).encode())
                    out["key"].append(k)
                    out["first"].append(v)
                    texts, size = [], 0
                texts.append(str(v))
                size += len(texts[-1]) + 1
            if texts:
                out["pack"].append(",".join(texts).encode())
            yield pa.RecordBatch.from_pydict(out, schema)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("sha256", pa.string())])
        now, digest = None, None
        for x in batches:
            done: list[tuple[bytes, str]] = []
            for k, pack in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                if digest is not None and k == now:
                    digest.update(b",")
                else:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256()
                digest.update(pack.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)

    packs = dealt.mapInArrow(packed, "key binary, first bigint, pack binary")
    return packs.repartition(n, "key").sortWithinPartitions("key", "first").select("key", "pack").mapInArrow(digested, "key binary, sha256 string")
