"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import laid_by, saved, saved_as_laid, shuffled, written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Connected components: ``(id, component)`` for every id in an edge, component the smallest id reachable.

    Each round takes the smallest label among neighbours, hands it on to the node that gave the label before, so that all
    under that follow it, and then takes the label of that label, so long paths take few rounds in any order of ids.  Every round aggregates on the map side before its shuffle, is
    written to the shared folder, and survives lost executors.  Edges with a null end are ignored; repeated edges
    and loops change nothing; an empty table gives an empty result.  Pairs are laid by node once, so rounds shuffle and sort labels alone.
    """
    pairs = written(edges.select(F.col(a).alias("s"), F.col(b).alias("t")).where("s is not null and t is not null"))
    pairs = saved_as_laid(laid_by(pairs.union(pairs.select("t", "s")), 2 * pairs.count(), "s").distinct().sortWithinPartitions("s"))
    labels = saved(pairs.groupBy(F.col("s").alias("id")).agg(F.min(F.least("s", "t")).alias("label")))
    for _ in range(max_rounds):
        near = pairs.join(shuffled(labels), pairs.s == labels.id).groupBy(F.col("t").alias("id")).agg(F.min("label").alias("near"))
        seen = labels.join(shuffled(near), "id", "left").select("id", "label", F.least("label", "near").alias("now"))
        above = seen.where("now < label").select(F.col("label").alias("id"), F.lit(None).cast(labels.schema["label"].dataType).alias("was"), "now")
        hooked = seen.select("id", F.col("label").alias("was"), "now").unionByName(above).groupBy("id").agg(F.max("was").alias("was"), F.min("now").alias("now"))
        up = labels.select(F.col("id").alias("now"), F.col("label").alias("above"))
        moved = written(hooked.join(shuffled(up), "now", "left").select("id", "was", F.least("now", F.coalesce("above", "now")).alias("label")))
        labels = moved.select("id", "label")
        if moved.where("label <> was").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _laid(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(a, b, w)``: the edges in both directions, each once at its least weight, laid by ``a`` and sorted; and a bound of their number."""
    one = written(edges.select("a", "b", "w"))
    rows = 2 * one.count()
    both = laid_by(one.union(one.select("b", "a", "w")), rows, "a").groupBy("a", "b").agg(F.min("w").alias("w"))
    return saved_as_laid(both.sortWithinPartitions("a")), rows


def _relaxed(both: DataFrame, sources: DataFrame, max_distance: float, max_rounds: int) -> DataFrame:
    known = saved(sources.select("node").distinct().withColumn("distance", F.lit(0.0)))
    front = known
    for _ in range(max_rounds):
        step = both.join(shuffled(front), both.a == front.node).groupBy(F.col("b").alias("node")).agg(F.min(F.col("distance") + F.col("w")).alias("via"))
        step = step.where(F.col("via") <= max_distance)
        merged = written(known.join(shuffled(step), "node", "full").select("node", F.least("distance", "via").alias("distance"), (F.col("distance").isNull() | (F.col("via") < F.col("distance"))).alias("nearer")))
        known, front = merged.select("node", "distance"), merged.where("nearer").select("node", "distance")
        if front.isEmpty():
            return known
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def distances(edges: DataFrame, sources: DataFrame, max_distance: float = float("inf"), max_rounds: int = 10_000) -> DataFrame:
    """``(node, distance)``: least sum of ``edges(a, b, w)``, in either direction, from any of ``sources(node)``.

    Each round relaxes only the edges of nodes that the round before brought nearer, and is written to the shared folder.  Edges are laid
    by node once, so rounds shuffle and sort nodes alone.
    """
    return _relaxed(_laid(edges)[0], sources, max_distance, max_rounds)


def shortest_path(edges: DataFrame, start: int, end: int) -> DataFrame:
    """``(node, distance)`` along one least path; of equal ways to a node the one from the smallest node.  Weights are positive.

    Each node's way back to the start is one row.  Jumps along it double until they reach the start, so a path of
    n nodes takes log n joins.  No path gives no rows.
    """
    both, rows = _laid(edges)
    far = _relaxed(both, edges.sparkSession.createDataFrame([(start,)], "node bigint"), float("inf"), 10_000)
    last = far.where(F.col("node") == end).first()
    if last is None:
        return far.where("false")
    ends = far.select(F.col("node").alias("b"), F.col("distance").alias("to"))
    # nodes of the path are no farther than its end
    ways = both.join(shuffled(far.select(F.col("node").alias("a"), F.col("distance").alias("of"))), "a").where(F.col("of") + F.col("w") <= last["distance"])
    ways = laid_by(ways, rows, "b").join(shuffled(ends), "b")
    jump = saved(ways.where("of < to and of + w = to").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
    on = saved(far.where(F.col("node") == end).select("node"))
    while True:
        more = on.join(shuffled(jump), "node").select(F.col("up").alias("node"))
        grown = written(on.union(more).distinct())
        if grown.count() == on.count():
            return grown.join(shuffled(far), "node").select("node", "distance")
        on = grown
        jump = written(jump.join(shuffled(jump.select(F.col("node").alias("up"), F.col("up").alias("above"))), "up").select("node", F.col("above").alias("up")))
