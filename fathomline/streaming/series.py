"""Series that arrive: bins, repeats and windows by sign with bounded state.

Each function takes and gives an unbounded DataFrame; the caller chooses source, sink and trigger.  State is
partitioned by the keys and, but for ``sign_windows``, dropped once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bin_means(stream: DataFrame, keys: list[str], seconds: int, late: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """``(keys, bin, mean, n)``: as ``temporal.bin_mean``, each bin once it is ``late`` in the past.

    Bins are closed on the right.  Windows are closed on the left, so a sample is dealt by the microsecond before it.
    """
    at = stream.withColumn("_at", F.col(ts).cast("timestamp") - F.expr("interval 1 microsecond")).withWatermark("_at", late)
    out = at.groupBy(*keys, F.window("_at", f"{seconds} seconds").alias("_w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("bin"), "mean", "n")


def drop_repeats(stream: DataFrame, ids: list[str], late: str, ts: str = "ts") -> DataFrame:
    """The first row of each id; ids are remembered for at least ``late``."""
    at = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return at.dropDuplicatesWithinWatermark(ids).drop("_at")


def sign_windows(stream: DataFrame, key: str, value: str, low: float = 0.0, high: float = 0.0, ts: str = "ts") -> DataFrame:
    """``(key, sign, start, end, n)``: as ``temporal.sign_windows``, each stretch once the next one begins.

    A key's state is its open stretch.  Samples older than the last of their key are left out, as are null ones.
    """
    kind = dict(stream.dtypes)[key]

    def follow(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(batches)).sort_values("us")
        sign, start, end, n = state.get if state.exists else (0, 0, -(2**62), 0)
        x = x[x.us > end]
        own = (x.v > high).astype("int64") - (x.v < low).astype("int64")
        own = own.where(own != 0).ffill().fillna(sign).astype("int64")
        us, own = x.us[own != 0].to_numpy(), own[own != 0].to_numpy()
        done = []
        for t, s in zip(us.tolist(), own.tolist(), strict=True):
            if s != sign:
                if n:
                    done.append((name[0], sign, start, end, n))
                sign, start, n = s, t, 0
            end, n = t, n + 1
        if n:
            state.update((sign, start, end, n))
        yield pd.DataFrame(done, columns=["k", "sign", "start", "end", "n"])

    rows = stream.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(value).cast("double").alias("v")).where("us is not null and v is not null")
    found = rows.groupBy("k").applyInPandasWithState(
        follow, f"k {kind}, sign long, start long, end long, n long", "sign long, start long, end long, n long", "append", GroupStateTimeout.NoTimeout
    )
    times = {c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz") for c in ("start", "end")}
    return found.withColumns(times).withColumnRenamed("k", key)
