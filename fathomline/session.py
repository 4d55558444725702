"""What operators need of a session beside its DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition at most, on average, of tables that are laid by keys, and rows under which a table is not dealt any further.
PART_ROWS, FEW_ROWS = 1 << 19, 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``.

    Where it is unset, one process alone gets a temporary one; on a cluster that is an error, as no executor sees another's.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathomline-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the folder that the cluster shares.

    ``spark.checkpoint.dir`` names that folder, see ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the folder that the cluster shares, for loops that join what they made before.

    A checkpoint keeps the planner's guess of its size, and the guess for a join is the product of both sides'.  In a loop it squares
    each round and its digits double, until planning alone takes minutes; a table has the size of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, for tables that grow with the input.

    The planner guesses the size of a side from its files, packed and before any ``explode``, so it would send tables of millions of
    rows through the driver.
    """
    return df.hint("merge")


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by keys in as many partitions as the user has set for this amount of data, none of them merged.

    The planner merges partitions up to a size on disk; rows of counted keys pack there to a hundredth of what sorts and windows
    hold of them, so a task's memory would grow with the input.
    """
    return df.repartition(partitions_of(df.sparkSession), *keys)


def partitions_of(spark: SparkSession) -> int:
    """The number of shuffle partitions that the user has set for this amount of data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def laid_by(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by keys in as many partitions as the user has set, more if its ``rows`` are many and fewer if they are few.

    So what a task holds is bounded whatever the input.
    """
    return df.repartition(max(-(-rows // PART_ROWS), min(partitions_of(df.sparkSession), -(-rows // FEW_ROWS)), 1), *keys)


def saved_as_laid(df: DataFrame) -> DataFrame:
    """``saved``, of a table that ``laid_by`` deals and that is sorted: joins and groups by these keys neither shuffle nor sort it again.

    A checkpoint keeps how it is laid, but an adaptive plan doesn't say so before it has run; this one has nothing to adapt.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return saved(df)
    finally:
        conf.set(name, was)
