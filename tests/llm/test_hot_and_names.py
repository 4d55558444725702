"""Hot keys, clashing names and the columns that queries return, against plain versions."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import chat_format, exact_dedup, mixing, queries, sharding, simhash
from fathomline.llm.hot import spread_join
from tests.llm.test_operators import fingerprint

SF = "/root/testdata/sf0.001"


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_a_hot_key_is_dealt_to_many_tasks(spark):
    rows = spark.range(0, 60_000, 1, 64).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = spread_join(rows, table, "k", "n")
        assert found.select("id", "k", "top").where("k = id or (k = -1 and top = 59997)").distinct().count() == 60_000
        held = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(held) < 5 * np.median(held)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_groups_of_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "The Same").otherwise(F.col("id").cast("string")).alias("text"), F.lit(1).alias("digest"), F.lit(1).alias("norm"), F.lit(2).alias("salt"))
    got = exact_dedup.exact_groups(docs).groupBy("keep_id", "group_size").agg(F.count("*").alias("n")).where("group_size > 1").collect()
    assert [tuple(r) for r in got] == [(2997, 1000, 1000)]


@pytest.mark.parametrize("cap", [1, 64])
def test_links_of_one_bit(spark, cap):
    fps = [0, 1, 2, 3, 4, 12, 1 << 40, (1 << 40) | 1, 7 << 50]
    near = lambda a, b: bin(a ^ b).count("1") == 1
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 1, cap).collect()}
    assert all(near(*g) for g in got)
    assert roots(fps, map(tuple, got)) == roots(fps, [(a, b) for a in fps for b in fps if a < b and near(a, b)])


def test_simhash_query_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fp = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    some = sorted(set(fp.values()))
    root = roots(some, [(a, b) for i, a in enumerate(some) for b in some[i + 1 :] if (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = {(i, f"{f:016x}", least[root[f]]) for i, f in fp.items()}
    assert {tuple(r) for r in queries.op7_simhash(spark, SF).collect()} == want


def test_sharding_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 16 for r in rows}
    got = queries.op5_sharding(spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(r["doc_id"], size[r["doc_id"]], zlib.crc32((r["text"] or "").encode())) for r in rows}
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) <= set(range(40))
    for held in shards.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    groups = {}
    for r in rows:
        groups[r["text"] or ""] = groups.get(r["text"] or "", 0) + size[r["doc_id"]]
    # Groups of a fair share or more fill a shard each; the rest is level to within the smallest groups.
    large = sorted(groups.values(), reverse=True)
    alone, total = 0, sum(large)
    while large[alone] * (40 - alone) >= total:
        total -= large[alone]
        alone += 1
    fair = total / (40 - alone)
    held = sorted((sum(r["size"] for r in x) for x in shards.values()), reverse=True)[alone:]
    assert len(held) == 40 - alone and max(held) <= 1.1 * fair and min(held) >= 0.9 * fair


def test_sharding_of_a_hot_text_and_other_columns(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.col("id").cast("string")).alias("text"), *(F.lit("x").alias(c) for c in ("id", "size", "group", "held", "shard", "slot", "bucket", "_salt")))
    got = sharding.sharded(docs.union(docs.where("doc_id = 7")), 4).collect()
    assert len(got) == 3001 and len({r["shard"] for r in got if r["id"] % 3 == 0}) == 1
    assert {r["shard"] for r in got} == {0, 1, 2, 3}


def test_shards_of_a_capacity(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 400, 5000).tolist()
    groups = spark.createDataFrame([(str(k).encode(), s) for k, s in enumerate(sizes)], "group binary, size bigint")
    rows = sharding.shards_of_groups(groups, capacity=10_000).collect()
    held = {}
    for r in rows:
        held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
    assert len(rows) == 5000 and sorted(held) == list(range(len(held)))
    assert max(held.values()) <= 10_000 and len(held) <= 1.02 * sum(sizes) / 10_000 + 1


def test_room_is_an_ordered_set():
    rng = np.random.default_rng(2)
    room, want = sharding.Room(5000), []
    for k in range(4000):
        if rng.random() < 0.6:
            r = int(rng.integers(1, 5000))
            room.add(r, k)
            want.append((r, k))
        else:
            size = int(rng.integers(1, 6000))
            fits = [x for x in want if x[0] >= size]
            best = min(fits) if fits else None
            assert room.tightest(size) == best
            if best:
                want.remove(best)


NAMES = ["base", "units", "mix_size", "mix_key", "mix_draws", "rest", "block", "mix_block", "cut_key", "u_source", "pass", "shard", "size", "source_size", "key", "_0", "_9"]


def test_mix_of_other_columns_repeated_rows_and_nulls(spark):
    rows = [(i, "w " * (i % 9 + 1), "s" + str(i % 4) if i % 4 else None) for i in range(400)] + [(7, "w w", "s1")] * 3 + [(None, "w", "s1"), (9, None, None), (10, "", "s2")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = plain.withColumns({c: F.lit(k) for k, c in enumerate(NAMES)})
    cols = ["doc_id", "text", "source", "mix_size", "mix_source_size", "mix_target", "mix_draws"]
    got, want = mixing.mix(docs), mixing.mix(plain)
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))
    kept = [c for c in NAMES if not c.startswith("mix_") or c == "mix_block"]
    assert got.select(kept).distinct().collect() == docs.select(kept).distinct().collect()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    drawn = want.select("doc_id", "text", "source", F.explode("mix_draws")).drop("col")
    assert sorted(map(repr, out.select("doc_id", "text", "source").collect())) == sorted(map(repr, drawn.collect()))
    assert mixing.mixed(docs.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["binary", "string", "int", "decimal(5,1)", "date", "double"])
def test_chats_of_any_id_type_and_other_columns(spark, kind):
    rows = [(k % 3, t, r, x) for k in range(6) for t, r, x in [(k, "user", "a"), (k, "assistant", None)]] + [(None, 1, "assistant", "b"), (None, 1, "assistant", "b")]
    talk = spark.createDataFrame(rows, "c int, turn long, role string, text string").withColumn("conv_id", F.col("c").cast("string").cast(kind) if kind != "date" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("c")))
    talk = talk.withColumns({c: F.lit("x") for c in ("conv", "seq", "n_turns", "formatted", "first_turn", "loss_start")})
    got = chat_format.digests(chat_format.format_conversations(talk)).collect()
    assert sorted((r["n_turns"], r["loss_chars"]) for r in got) == [(2, 2), (4, 0), (4, 0), (4, 0)]
    assert sum(r["conv_id"] is None for r in got) == 1
