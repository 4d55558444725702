"""Mixing sources to target weights by an exact splitting tree of block quotas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import saved

WORDS = r"[^\x20\x09-\x0D]+"
#: Units (source, pass, block) up to which their table is broadcast; beyond it the join shuffles.
BROADCAST_UNITS = 100_000
#: Hex digits of a key that name its part: a million parts, so a block of 64 has at most 16,384.
PART_DIGITS = 5
#: Leading bits of the hash that shuffles a shard, by whose values the shard is dealt to tasks.
SHARD_PART_BITS = 8


def word_count(text):
    """Number of words as a column; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, size)``: weights 1, 2, 3, 1 ... by code point, null last.

    Targets share the sum of all sizes by weight; one that would pass ``most`` times its source's size
    stops there, and its excess goes to the others by weight until none is above.  The common factor
    is the first at which, in order of the factor where each stops, those still open can take what is left.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    per = per.withColumn("stop", F.lit(most) * F.col("source_size") / F.col("weight"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    upto = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("all", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    per = per.withColumn("held", F.lit(most) * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    per = per.withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    per = per.withColumn("place", F.row_number().over(by_stop))
    per = per.withColumn("factor", (F.col("all") - F.col("held")) / F.col("open"))
    per = per.withColumn("level", F.min(F.when(F.col("factor") <= F.col("stop"), F.struct("place", "factor"))).over(every)["factor"])
    target = F.when(F.coalesce(F.col("level"), F.col("stop")) >= F.col("stop"), F.lit(most) * F.col("source_size")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "weight", target.cast("double").alias("target"))


def quotas(units: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Units of each source that each shard gets, ``(shards, sources)``, by a tree of multivariate hypergeometric splits."""
    out = np.zeros((shards, len(units)), np.int64)

    def cut(lo: int, hi: int, have: np.ndarray, node: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, node]))
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if take else np.zeros_like(have)
        cut(lo, mid, left, 2 * node)
        cut(mid, hi, have - left, 2 * node + 1)

    cut(0, shards, units.astype(np.int64), 1)
    return out


def mix(docs: DataFrame, shards: int = 16, blocks: int = 64, most: float = 3.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with columns ``mix_size, mix_source_size, mix_target, mix_key, mix_draws`` added.

    ``mix_draws`` is an array of ``(pass, shard)``, one entry for each time that the mix takes the
    document, so exploding it and sorting each shard by ``mix_key`` gives the mix.  A source's documents
    are permuted by a hash of id and text and cut into ``blocks`` by its first bits.  The mix takes whole
    passes over a source and, of one more, those before the cut that would pass the target and the one
    behind it that fits the gap best; so no document is taken more than ``most`` times and reruns agree.  The blocks of all
    passes are the units that the splitting tree deals to shards as exact quotas; a source's units are
    drawn in permuted order without repetition.

    Sources are assumed to be as few as a catalogue's: their totals and quotas are handled on the driver.
    Null text has size 0, null source is a source, null id hashes as an empty text, rows alike in id and
    text are taken alike, and an empty table gives no rows.  Columns of ``docs`` stay untouched whatever their names,
    but for one that has the name of an added column and gives way to it.
    """
    spark = docs.sparkSession
    added = ["mix_size", "mix_source_size", "mix_target", "mix_key", "mix_draws"]
    given = docs.columns
    docs = docs.toDF(*(f"_{k}" for k in range(len(given))))  # names that none of those below has
    id_col, text_col, source_col = (f"_{given.index(c)}" for c in (id_col, text_col, source_col))
    key = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))), 256)
    block = F.shiftright(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * blocks, 32).cast("int")
    sized = docs.withColumn("mix_size", word_count(F.col(text_col))).withColumn("mix_key", key).withColumn("mix_block", block)
    small = saved(sized.select(F.col(source_col).alias("source"), F.col("mix_size").alias("size"), F.col("mix_key").alias("key"), F.col("mix_block").alias("block")))
    per = saved(source_targets(small, most).withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")))
    per = per.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    # Of the pass that is not whole: words before each block, then inside the one block where the cut falls.
    sums = small.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("block")) - F.col("words"))
    hit = sums.join(per.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).where("words > 0 and rest >= before and rest < before + words")
    hit = hit.select(F.col("s"), F.col("block").alias("b"), "before", "rest")
    inside = small.join(hit, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("part", F.substring("key", 1, PART_DIGITS))
    # The block may hold a large share of a large source, so its parts are summed first and only the one with the cut is put in order.
    parts = inside.groupBy("s", "b", "part", "before", "rest").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("held", F.col("before") + F.sum("words").over(Window.partitionBy("s", "b").orderBy("part")) - F.col("words"))
    parts = parts.where("words > 0 and rest >= held and rest < held + words").select(F.col("s").alias("ps"), F.col("part").alias("pp"), "held")
    inside = inside.join(parts, F.col("s").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp")))
    inside = inside.withColumn("upto", F.col("held") + F.sum("size").over(Window.partitionBy("s", "b").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
    cut = inside.groupBy("s", F.col("b").alias("cut_block")).agg(
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("key"))).alias("cut_key"),
        (F.max("rest") - F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.max("held"))).alias("gap"),
    )
    cut = saved(cut)
    beyond = small.join(cut, F.col("source").eqNullSafe(F.col("s"))).where("size > 0 and (block > cut_block or (block = cut_block and key >= cut_key))")
    fit = beyond.groupBy(F.col("s").alias("f"), "key", "gap").agg(F.abs(F.col("gap") - F.sum("size")).alias("off")).where("off < gap")
    fit = fit.groupBy("f").agg(F.min(F.struct("off", "key"))["key"].alias("fit_key"))
    plan = per.join(cut.drop("gap"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = saved(plan.join(fit, F.col("source").eqNullSafe(F.col("f")), "left").drop("f"))
    sources = plan.orderBy(F.col("source").asc_nulls_last()).collect()
    # A pass draws the units up to the block of its cut; without a cut block there is no part of a pass.
    n = np.array([r["base"] * blocks + (r["cut_block"] + 1 if r["cut_block"] is not None else 0) for r in sources], np.int64)
    ends = np.cumsum(quotas(n, shards, seed), axis=0) if len(n) else np.zeros((shards, 0), np.int64)
    rows = [(r["source"], k, int(ends[k][i] - (ends[k - 1][i] if k else 0)), int(ends[k][i])) for i, r in enumerate(sources) for k in range(shards)]
    quota = spark.createDataFrame(rows, "q_source string, shard int, n bigint, upto bigint").where("n > 0")
    unit = plan.select("source", "base", "cut_block", F.explode(F.sequence(F.lit(0), F.col("base").cast("int"))).alias("pass"))
    unit = unit.select("source", "base", "cut_block", "pass", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    unit = unit.where((F.col("pass") < F.col("base")) | (F.col("block") <= F.col("cut_block")))
    turn = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "pass", "block"), "pass", "block")
    unit = unit.withColumn("no", F.row_number().over(turn).cast("long"))
    unit = unit.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("no") <= F.col("upto")) & (F.col("no") > F.col("upto") - F.col("n")))
    last = unit.where("pass = base and block = cut_block").select(F.col("source").alias("l_source"), F.col("shard").alias("cut_shard"))
    unit = unit.groupBy(F.col("source").alias("u_source"), F.col("block").alias("u_block")).agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("units"))
    lead = plan.select(F.col("source").alias("u_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "base", "cut_block", "cut_key", "fit_key")
    lead = lead.join(last, F.col("u_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
    unit = saved(lead.select("u_source", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("u_block"), *lead.columns[1:]).join(
        unit.withColumnsRenamed({"u_source": "v_source", "u_block": "v_block"}), F.col("u_source").eqNullSafe(F.col("v_source")) & (F.col("u_block") == F.col("v_block")), "left"
    ).drop("v_source", "v_block"))
    if len(sources) * blocks <= BROADCAST_UNITS:
        unit = F.broadcast(unit)
    found = sized.join(unit, F.col(source_col).eqNullSafe(F.col("u_source")) & (F.col("mix_block") == F.col("u_block")))
    before = (F.col("mix_block") < F.col("cut_block")) | ((F.col("mix_block") == F.col("cut_block")) & (F.col("mix_key") < F.col("cut_key")))
    draws = F.filter("units", lambda u: (u["pass"] < F.col("base")) | F.coalesce(before, F.lit(False)))
    none = F.array().cast("array<struct<pass:int,shard:int>>")
    one = F.array(F.struct(F.col("base").cast("int").alias("pass"), F.col("cut_shard").alias("shard")))
    fitted = F.when(F.coalesce(F.col("mix_key") == F.col("fit_key"), F.lit(False)), one).otherwise(none)
    found = found.withColumn("mix_draws", F.when(F.col("mix_size") > 0, F.concat(F.coalesce(draws, none), fitted)).otherwise(none))
    return found.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(given) if c not in added), *added)


def mixed(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The mix itself: ``docs`` with a row for each draw, dealt by shard and shuffled within it.

    A shard is as large as the mix over ``shards``, so it is dealt in ``2 ** SHARD_PART_BITS`` ranges of the
    hash that shuffles it: within a range rows are in the hash's order, and no task holds a shard.
    """
    given = docs.columns
    named = docs.toDF(*(f"_{k}" for k in range(len(given))))
    columns = {c: f"_{given.index(options.pop(c, of))}" for c, of in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    drawn = mix(named, shards, **columns, **options).withColumn("mix_draw", F.explode("mix_draws"))
    drawn = drawn.withColumn("mix_turn", F.xxhash64("mix_key", "mix_draw.pass"))
    drawn = drawn.withColumn("mix_range", F.shiftright("mix_turn", 64 - SHARD_PART_BITS))
    dealt = drawn.repartition("mix_draw.shard", "mix_range").sortWithinPartitions("mix_draw.shard", "mix_turn")
    return dealt.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(given)))
