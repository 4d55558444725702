"""Near-duplicates by SimHash, found with generalised pigeonhole search.

Fingerprints are taken per text in numpy; all search and linking is Spark joins over distinct
fingerprints, so any number of equal texts costs one row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.hot import spread_join
from fathomline.llm.words import give_back, passes, split, xxh64
from fathomline.operators.graph import components
from fathomline.session import saved

BITS = 64
#: Byte j of LANES[v] is bit j of v: sums of up to 255 of them don't overflow a byte.
LANES = sum((((np.arange(256, dtype=np.uint64) >> np.uint64(j)) & np.uint64(1)) << np.uint64(8 * j)) for j in range(8))


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The SimHash of each text; 0 without words."""
    return np.concatenate([_fingerprints(texts[a:b], shingle) for a, b in passes(texts)] or [np.zeros(0, np.uint64)])


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    w = split(texts, lower=True)
    words = np.diff(w.first)
    n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if not len(some):
        return out
    n, words, base = n[some], words[some], w.first[:-1][some]
    at = np.cumsum(n) - n
    head = np.arange(int(n.sum())) + np.repeat(base - at, n)
    h = xxh64(w.buf, w.start[head], w.end[head + np.repeat(np.minimum(words, shingle) - 1, n)])
    parts = -(-n // 255)
    cut = np.repeat(at, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    whole = np.cumsum(parts) - parts
    fp = np.zeros(len(n), np.uint64)
    for byte in range(8):
        lanes = LANES[((h >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.intp)]
        sums = np.add.reduceat(lanes, cut).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        set_ = 2 * np.add.reduceat(sums, whole, axis=0) > n[:, None]
        fp |= (set_.astype(np.uint64) << (np.arange(8) + 8 * byte).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    out[some] = fp
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``: the 64-bit fingerprint of each whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fingerprints(x.column(1)).view(np.int64))], ["id", "fp"])
            give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each pair of bits in how many both are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for x in batches:
            for a in range(0, x.num_rows, 1 << 16):
                v = x.column(0).to_numpy()[a : a + (1 << 16)].astype("<i8")
                bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
                n += len(v)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    cells = np.zeros(BITS * BITS + 1)
    for r in fps.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r.cell] = r.n  # 4,097 rows whatever the input
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of near-equal width, correlated bits together."""
    q = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(q * (1 - q), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(q, q)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        seed = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        part = [seed]
        left.discard(seed)
        while len(part) < width:
            nxt = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.discard(nxt)
        parts.append(sorted(part))
    return parts


def allotted(n: int, both: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """Parts of the bits, each with its threshold (-1: unused), of least estimated cost.

    By the generalised pigeonhole principle two fingerprints within ``most`` bits are within t_i on
    some part i, if the t_i sum to most - m + 1.  For each number m of parts, dynamic programming
    over the parts picks the t_i that minimise candidate pairs, estimated from how often each bit is
    set, plus the rows that probing emits.
    """
    q = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, most + 3):
        parts = grouped_bits(n, both, m)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            differ = np.zeros(most + 1)
            differ[0] = 1.0
            for b in part:
                p = 2 * q[b] * (1 - q[b])
                differ[1:] = differ[1:] * (1 - p) + differ[:-1] * p
                differ[0] *= 1 - p
            nxt: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, ts) in state.items():
                for t in range(-1, most + 1):
                    more = 0.0 if t < 0 else n * n / 2 * differ[: t + 1].sum() + 2.0 * n * sum(math.comb(len(part), k) for k in range(t + 1))
                    if total + t not in nxt or cost + more < nxt[total + t][0]:
                        nxt[total + t] = (cost + more, [*ts, t])
            state = nxt
        cost, ts = state[most - m + 1]
        if cost < best[0]:
            best = (cost, list(zip(parts, ts, strict=True)))
    return best[1]


def _long(bits: list[int]) -> int:
    v = sum(1 << b for b in bits)
    return v - (1 << 64) if v >> 63 else v


def _flips(part: list[int], t: int) -> list[int]:
    out = [0] + ([_long([b]) for b in part] if t >= 1 else [])
    return out + ([_long([a, b]) for i, a in enumerate(part) for b in part[i + 1 :]] if t >= 2 else [])


def links(fps: DataFrame, most: int = 2, cap: int = 64) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints at ``most`` (at most 2) or fewer differing bits.

    Each link is a true pair.  Keys of up to ``cap`` fingerprints are probed and their pairs verified.
    In a larger key, where all pairs would grow with its square, every member instead lists itself
    and its 64 one-bit neighbours: two members within 2 bits share one of those, and all that share
    one are within 2 bits, so tying them to the smallest keeps every component (at most 65 a group).
    With ``most`` 1 the same neighbours are listed, and of those that share one only pairs 1 bit apart are links:
    a member that is itself such a neighbour of the others is tied to each of them.
    """
    if most > 2:
        raise ValueError("links are exact up to 2 differing bits")
    if most < 1:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    n, both = bit_counts(fps)
    probes = [(i, _long(part), flip, k > 0) for i, (part, t) in enumerate(allotted(n, both, most)) if t >= 0 for k, flip in enumerate(_flips(part, t))]
    kind = "array<struct<part:int,mask:bigint,flip:bigint,probe:boolean>>"
    every = F.from_json(F.lit(json.dumps([dict(zip(("part", "mask", "flip", "probe"), p, strict=True)) for p in probes])), kind)
    rows = fps.select("fp", F.explode(every).alias("p"))
    rows = rows.select("p.part", F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key"), "fp", "p.probe")
    size = rows.groupBy("part", "key").agg(F.count("*").alias("members"), F.count(F.when(~F.col("probe"), 1)).alias("held"))
    rows = rows.join(size.where("held > 0 and members > 1").hint("merge"), ["part", "key"])
    cold = rows.where(F.col("members") <= cap)
    a = cold.where(~F.col("probe")).select("part", "key", F.col("fp").alias("a"))
    b = cold.select("part", "key", F.col("fp").alias("b"), "probe")
    near = a.hint("merge").join(b, ["part", "key"]).where(F.expr(f"bit_count(a ^ b) between 1 and {most}")).select("a", "b")
    hot = rows.where(F.col("members") > cap).select("part", "fp").distinct()
    ball = hot.select("part", "fp", F.explode(F.array(*(F.lit(x).cast("long") for x in _flips(list(range(BITS)), 1)))).alias("flip"))
    ball = ball.select("part", F.col("fp").bitwiseXOR(F.col("flip")).alias("spot"), "fp", (F.col("flip") == 0).alias("own"))
    if most == 1:  # the member at the spot itself, tied to the others
        star = ball.where("own").select("part", "spot", F.col("fp").alias("a"))
    else:
        star = ball.groupBy("part", "spot").agg(F.min("fp").alias("a"))
    tied = ball.join(star.hint("merge"), ["part", "spot"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return near.union(tied).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2) -> DataFrame:
    """``(id, fp, component_id)`` for each row of ``docs``: the smallest id reachable by links.

    Texts link where their fingerprints differ in ``most`` or fewer bits; null and wordless texts
    have fingerprint 0 and link like any other.  Repeated rows share a component; null ids never
    become its name unless a component has no other.  No other column is read.
    """
    each = saved(simhash(docs, id_col, text_col))
    fps = saved(each.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("held")))
    found = components(links(fps.select("fp"), most)).withColumnRenamed("id", "fp")
    named = fps.join(found, "fp", "left").select("fp", "least", "held", F.coalesce("component", "fp").alias("root"))
    name = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(named.join(name, "root").select("fp", "held", "component_id"))
    return spread_join(each, named, "fp", "held").select("id", "fp", "component_id")
