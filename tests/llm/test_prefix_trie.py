"""The prefix trie against a plain one, with long and equal conversations, ties, nulls, and no rows."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fathomline.llm import prefix_trie as pt
from fathomline.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(convs):
    """Nodes of {conv: [(name, size)]} as sorted rows."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    rows = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        rows.append(
            (min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in below), sum((len(nodes[q]) - 1) * q[-1][1] for q in below if q), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(rows, key=str)


def nodes_of(spark, rows):
    turns = pt.ordered_turns(rows)
    nodes, ends = pt.prefix_trie(turns, rows.where("conv_id is not null").select(F.col("conv_id").alias("conv")).distinct())
    found = nodes.join(pt.listed_sha256(ends, "key", "conv"), "key", "left").withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256)))
    return sorted((tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "sha256").collect()), key=str)


@pytest.mark.parametrize("fan", [2, 64])
def test_trie_is_the_plain_one(spark, monkeypatch, fan):
    """Long conversations take several blocks and, with groups of two, several rounds of names."""
    monkeypatch.setattr(pt, "FAN", fan)
    monkeypatch.setattr(pt, "PACK", 8)
    rng = random.Random(3)
    said = {}
    for c in range(-3, 60):
        said[c] = [rng.choice(["a", "bé", ""]) for _ in range(rng.choice([1, 2, 3, 8, 9, 16, 17]))]
    long = [rng.choice("xyz") for _ in range(75)]
    said |= {100: long, 101: long[:70] + ["other"], 102: long[:64], 103: long[:8], 104: long, 105: long[:16]}
    said |= {200 + i: ["hot", "same"] for i in range(60)}
    rows = [(c, t, "user" if t % 2 == 0 else None, x) for c, turns in said.items() for t, x in enumerate(turns)]
    rows += [(None, 1, "user", "of no conversation"), (300, None, "user", "first"), (300, 0, "user", None), (301, None, "user", "first"), (301, 0, "user", "")]
    rng.shuffle(rows)
    said |= {300: ["first", ""], 301: ["first", ""]}
    role = lambda c, t: "user" if t % 2 == 0 or c >= 300 else ""
    want = plain({c: [((role(c, t), x), len(x.encode())) for t, x in enumerate(turns)] for c, turns in said.items()})
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("conv", "pos", "id", "key", "block", "t1", "before", "level")})
    assert nodes_of(spark, df) == want


def test_a_conversation_without_turns_ends_in_the_root(spark):
    turns = spark.createDataFrame([(1, 1, bytearray(b"x"), 3)], "conv long, pos long, id binary, size long")
    nodes, ends = pt.prefix_trie(turns, spark.createDataFrame([(1,), (2,)], "conv long"))
    assert sorted((r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"]) for r in nodes.collect()) == [(1, 0, 2, 1, 1), (1, 1, 1, 0, 1)]
    held = {r["key"]: r["depth"] for r in nodes.collect()}
    assert sorted((r["conv"], held[r["key"]]) for r in ends.collect()) == [(1, 1), (2, 0)]


def test_no_conversations(spark):
    assert nodes_of(spark, spark.createDataFrame([], SCHEMA)) == []
    assert nodes_of(spark, spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_repeated_turns_and_equal_numbers_have_an_order(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (2, 0, "a", "y"), (2, 1, "a", "y"), (2, 1, "b", "x")]
    a = nodes_of(spark, spark.createDataFrame(rows, SCHEMA))
    assert [r[3] for r in sorted(a, key=lambda r: r[1])] == [2, 2, 2, 2] and a == nodes_of(spark, spark.createDataFrame(rows[::-1], SCHEMA))


def test_a_hot_conversation_is_dealt_to_many_tasks(spark):
    n = 30_000
    rows = spark.range(0, 3 * n, 1, 16).select(F.when(F.col("id") < n, F.lit(-1)).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), (F.col("id") % 100).cast("string").alias("text"))
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        turns = pt.ordered_turns(rows)
        assert turns.where("conv = -1").agg(F.min("pos"), F.max("pos"), F.count_distinct("pos")).first() == (1, n, n)
        held = turns.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
        assert held.agg(F.max("n")).first()[0] < n / 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_shared_heads(spark):
    """The first h turns come from the conversation that the id rounded down to fives names, if there is one."""
    import zlib

    rng = random.Random(5)
    said = {c: [rng.choice("abc") for _ in range(rng.randint(1, 12))] for c in range(40) if c not in (5, 10)}
    rows = spark.createDataFrame([(c, t, "u", x) for c, turns in said.items() for t, x in enumerate(turns)], SCHEMA)
    got = queries.with_shared_heads(pt.ordered_turns(rows)).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("id")))).alias("t")).collect()
    own = {r["conv"]: [x[1] for x in r["t"]] for r in pt.ordered_turns(rows).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("id")))).alias("t")).collect()}
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    assert {r["conv"]: [x[1] for x in r["t"]] for r in got} == {c: t for c, t in want.items() if t}
    assert all([x[0] for x in r["t"]] == list(range(1, len(r["t"]) + 1)) for r in got)
