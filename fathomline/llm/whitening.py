"""Whitening of vectors: spectra grow by rank-one updates, are merged, and are refined by Rayleigh-Ritz steps over all rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.topk import matrix, quantised
from fathomline.session import saved

#: Rows whose updates make one spectrum, and spectra that one task merges.
SPECTRUM_ROWS, FAN = 4096, 16
#: Rows that one numpy product takes, and basis vectors beyond the wanted components at the start of the refinement.
BLOCK, GUARD = 2048, 4
EPS = np.finfo(np.float64).eps
SAFE = float(2**62)


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x) = 0 for ascending d and positive z2: one right of each pole.

    Each root is given as its nearest pole and what to add, which keeps it apart from the pole in full precision.
    All roots are sought at once: steps of a rational model of the two neighbouring poles, inside a bracket that halves where a
    step leaves it.
    """
    n = len(d)
    top = d[-1] + z2.sum()
    right = np.append(d[1:], top)
    gap = right - d
    middle = d + gap / 2
    at_middle = 1 + (z2 / (d - middle[:, None])).sum(axis=1)
    near = np.arange(n)
    near[:-1] += (at_middle[:-1] < 0).astype(near.dtype)  # the root lies in the right half, so count from the right pole
    delta = d - d[near][:, None]  # row i: poles seen from the pole of root i
    own = near == np.arange(n)
    lo, hi = np.where(own, 0.0, -gap / 2), np.where(own, np.where(np.arange(n) == n - 1, gap, gap / 2), 0.0)
    lo[-1], hi[-1] = (gap[-1] / 2, gap[-1]) if at_middle[-1] < 0 else (0.0, gap[-1] / 2)
    mu = (lo + hi) / 2
    a_pole = np.maximum(np.arange(n) - (np.arange(n) == n - 1), 0)
    b_pole = np.minimum(a_pole + 1, n - 1)
    left = (np.arange(n)[None, :] <= a_pole[:, None]).astype(np.float64)
    right_of = 1 - left
    live = np.arange(n)
    for _ in range(120):
        x = mu[live]
        with np.errstate(all="ignore"):
            away = delta[live] - x[:, None]
            part = z2 / away
            slope = part / away
            here, rest = left[live], right_of[live]
            low, high = np.einsum("ij,ij->i", part, here), np.einsum("ij,ij->i", part, rest)
            f, size = 1 + low + high, 1 + np.abs(low) + np.abs(high)
            hi[live], lo[live] = np.where(f > 0, x, hi[live]), np.where(f <= 0, x, lo[live])
            psi, phi = np.einsum("ij,ij->i", slope, here), np.einsum("ij,ij->i", slope, rest)
            da, db = away[np.arange(len(live)), a_pole[live]], away[np.arange(len(live)), b_pole[live]]
            c = f - da * psi - db * phi
            a = (da + db) * f - da * db * (psi + phi)
            b = da * db * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            if live[-1] == n - 1:  # both poles of the last root lie left of it
                away_root = np.sqrt(abs(a[-1] ** 2 - 4 * b[-1] * abs(c[-1])))
                step[-1] = (a[-1] + away_root) / (2 * abs(c[-1])) if a[-1] >= 0 else 2 * b[-1] / (a[-1] - away_root)
            step = np.where(f * step > 0, -f / (psi + phi), step)
            new = x + step
            bad = ~(np.isfinite(new) & (new > lo[live]) & (new < hi[live]))
            new = np.where(bad, (lo[live] + hi[live]) / 2, new)
        done = (np.abs(f) <= n * EPS * size) | (hi[live] - lo[live] <= 2 * EPS * np.maximum(np.abs(lo[live]), np.abs(hi[live])))
        mu[live] = np.where(done, x, new)
        live = live[~done]
        if not len(live):
            break
    return near, mu


def updated(q: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and ascending eigenvalues of ``q diag(w) q' + x x'``.

    Values that x doesn't touch, and all but one of equal values, are deflated: they stay, the latter after a reflection
    that gives the whole of x to one of them.  Vectors come from weights that the computed roots solve exactly (Gu and
    Eisenstat), so they stay orthogonal.
    """
    z = x @ q
    scale = max(float(np.abs(w).max(initial=0)), float(z @ z))
    if scale == 0:
        return q, w
    tiny = 8 * EPS * scale
    close = np.diff(w) <= tiny
    if close.any():
        q = q.copy()
        edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(np.int8)))
        for a, b in edges.reshape(-1, 2):
            u = z[a : b + 1].copy()
            length = np.copysign(np.sqrt(u @ u), u[-1])
            if length:
                u[-1] += length
                u /= np.sqrt(u @ u)
                q[:, a : b + 1] -= 2 * np.outer(q[:, a : b + 1] @ u, u)
                z[a:b], z[b] = 0, -length
    live = np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > tiny)
    if not len(live):
        return q, w
    d, zl = w[live], z[live]
    near, mu = secular_roots(d, zl * zl) if len(live) > 1 else (np.zeros(1, int), zl * zl)
    # differences of poles and roots: d[j] - root[i]
    apart = (d[None, :] - d[near][:, None]) - mu[:, None]
    poles = d[None, :] - d[:, None]
    np.fill_diagonal(poles, 1.0)
    n = len(d)
    ratio = -apart.copy()  # root[i] - d[j]
    with np.errstate(all="ignore"):
        # product over i of (root[i] - d[j]) / (d[i] - d[j]), paired so that factors stay near one
        low = np.tril(np.ones((n, n), bool), -1)  # i > j seen as [i, j]
        top = ratio[n - 1]
        factor = np.where(low, ratio[np.maximum(np.arange(n) - 1, 0)] / -poles, ratio / -poles)
        factor[np.arange(n), np.arange(n)] = 1.0
        weight = np.sqrt(np.abs(top * factor.prod(axis=0)))
    weight = np.copysign(weight, zl)
    u = weight / apart
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    w, q = w.copy(), q.copy()
    q[:, live] = q[:, live] @ u.T
    w[live] = d[near] + mu
    order = np.argsort(w, kind="stable")
    return q[:, order], w[order]


class Spectrum:
    """Count, mean, and eigenvectors and eigenvalues of the centred sums of products of some rows."""

    def __init__(self, width: int) -> None:
        self.n, self.mean, self.q, self.w = 0, np.zeros(width), np.eye(width), np.zeros(width)

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        away = x - self.mean
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.q, self.w = updated(self.q, self.w, away * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        """One update for each direction of the other that has any variance, and one for the distance of the means."""
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.q, self.w = other.n, other.mean, other.q, other.w
            return
        for v, size in zip(other.q.T, other.w, strict=True):
            if size > EPS * other.w[-1]:
                self.q, self.w = updated(self.q, self.w, v * np.sqrt(size))
        n = self.n + other.n
        away = other.mean - self.mean
        self.q, self.w = updated(self.q, self.w, away * np.sqrt(self.n / n * other.n))
        self.mean = self.mean + away * (other.n / n)
        self.n = n


def _blocks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for x in batches:
        for a in range(0, x.num_rows, BLOCK):
            y = x.slice(a, BLOCK)
            yield y, matrix(y.column(column))


def _summed(df: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``of(rows)`` over all blocks of rows: one array a task, added up in Spark by place."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, v in _blocks(batches):
            got = of(v).ravel()
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

    found = df.mapInArrow(parts, "part array<double>").select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # width rows
    out = np.zeros(width)
    for r in found:
        out[r["at"]] = r["x"]
    return out


def merged_spectrum(fit: DataFrame, width: int, n: int) -> Spectrum:
    """The spectrum of all ``fit(x)``: one for each SPECTRUM_ROWS rows, merged by FAN until one is left."""
    tasks = max(1, -(-n // SPECTRUM_ROWS))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum(width)
        for _, v in _blocks(batches):
            for x in v.astype(np.float64):
                found.add(x)
        if found.n:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["spectrum"])

    def joined(held: pa.Table) -> pa.Table:
        found = Spectrum(width)
        for x in held["spectrum"]:
            found.merge(pickle.loads(x.as_py()))
        return pa.table({"spectrum": pa.array([pickle.dumps(found)], pa.binary())})

    spectra = saved(fit.repartition(tasks).mapInArrow(grown, "spectrum binary").withColumn("at", F.monotonically_increasing_id()))
    while (left := spectra.count()) > 1:
        group = F.pmod(F.xxhash64("at"), F.lit(-(-left // FAN)))
        spectra = saved(spectra.groupBy(group.alias("group")).applyInArrow(joined, "spectrum binary").withColumn("at", F.monotonically_increasing_id()))
    return pickle.loads(spectra.first()["spectrum"])


def refined(fit: DataFrame, s: np.ndarray, n: int, basis: np.ndarray, k: int, tol: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and vectors of the covariance of ``fit(x)``, from a basis that nearly holds them.

    A Rayleigh-Ritz step multiplies all centred rows with the basis, in one pass, and solves the small problem that is left.
    While a residual is above ``tol`` of the largest value, the residuals join the basis, which at the latest is exact when it
    spans all dimensions.
    """
    width = len(basis)
    mean = s / n
    while True:
        m = basis.shape[1]

        def product(v: np.ndarray, basis: np.ndarray = basis) -> np.ndarray:
            x = v.astype(np.float64) - mean
            return x.T @ (x @ basis)

        y = _summed(fit, product, width * m).reshape(width, m) / n
        small = basis.T @ y
        e, w = np.linalg.eigh((small + small.T) / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        q, rest = basis @ w, y @ w - (basis @ w) * e
        if m == width or np.abs(rest).max(initial=0) <= tol * max(e[0], np.finfo(float).tiny):
            return e, q / np.sqrt((q * q).sum(axis=0))
        more = [np.concatenate([basis, rest], axis=1)]
        full, r = np.linalg.qr(more[0])
        keep = np.abs(np.diag(r)) > EPS * np.abs(np.diag(r)).max()
        keep[:m] = True
        grown = full[:, keep][:, :width]
        basis = grown if grown.shape[1] > m else np.linalg.qr(np.concatenate([basis, np.eye(width)], axis=1))[0]


def whiten(rows: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each row and component.

    ``vec_col`` holds arrays of longs, as ``topk.quantised`` makes them.  The spectrum is fitted on each distinct vector once, n
    of them with sums S.  ``deviation`` is the exact sum of (n x - S)^2, null where it exceeds 64 bits; ``whitened`` the row less
    the mean on a unit eigenvector, over the root of its eigenvalue; ``explained`` the eigenvalue's share of the trace;
    ``identity_error`` the largest entry of the covariance of the whitened fit rows less the identity.

    Rows whose vector is null or empty take no part, nor do those of another length than most distinct vectors have (of equal
    counts the longer).  Ids may be null or repeat.  Components without variance are left out, so no row is returned where all
    vectors are equal.  Components are the same for all rows, of either sign.
    """
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("x")).where("x is not null and size(x) > 0")
    fit = saved(named.select("x").distinct())
    lengths = fit.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    schema = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double".format(named.schema["vec_id"].dataType.simpleString())
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    width, n = lengths["width"], lengths["n"]
    fit, named = fit.where(F.size("x") == width), named.where(F.size("x") == width)
    sums = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.max(F.abs(F.col("v").cast("double"))).alias("most")).collect()  # width rows
    exact = [0] * width
    for r in sums:
        exact[r["at"]] = int(r["s"])
    most = max(r["most"] for r in sums)
    s = np.array([float(x) for x in exact])
    start = merged_spectrum(fit, width, n)
    k = min(components, width)
    e, q = refined(fit, s, n, start.q[:, ::-1][:, : min(width, k + GUARD)], k)
    total = float(_summed(fit, lambda v: ((v.astype(np.float64) - s / n) ** 2).sum(keepdims=True), 1)[0]) / n
    k = int((e > width * EPS * max(total, 0.0)).sum())
    e, q = e[:k], q[:, :k]
    if not k:
        return rows.sparkSession.createDataFrame([], schema)

    def white(v: np.ndarray) -> np.ndarray:
        return (v.astype(np.float64) - s / n) @ q / np.sqrt(e)

    mean = _summed(fit, lambda v: white(v).sum(axis=0), k) / n
    spread = _summed(fit, lambda v: (white(v) - mean).T @ (white(v) - mean), k * k).reshape(k, k) / n
    error = float(np.abs(spread - np.eye(k)).max())
    share = np.minimum(e / total, 1.0)
    small = 4.0 * (n * max(most, 1.0)) ** 2 * width < SAFE

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, v in _blocks(batches, 1):
            if small:
                far = ((n * v - np.array(exact, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                far = ((n * v.astype(object) - np.array(exact, object)) ** 2).sum(axis=1)
                far = [int(x) if x < 2**63 else None for x in far]
            z, m = white(v), len(v)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    y.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(at)), pa.array(z.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return named.mapInArrow(scored, schema)


def scaled(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) as longs; null for a vector that is null or has a null or non-finite entry."""
    return quantised(embedding, scale)
