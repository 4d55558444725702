"""Near copies of vectors: robust-pruned flat graphs of overlapping shards, searched from medoids by growing ranges, and audited."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.hot import spread_join
from fathomline.operators.graph import components
from fathomline.session import partitions_of, saved

#: Vectors of one graph, and queries that pass one graph in a task.
SHARD_ROWS, QUERY_BLOCK = 4096, 1 << 18
#: Bytes of cluster centres that each task holds.
PIVOT_BYTES = 16 << 20
#: Clusters that a vector joins, links of a node, best nodes that a search keeps, and how much longer a detour may be.
OVERLAP, DEGREE, BEAM, ALPHA = 3, 32, 32, 1.2
#: Vectors whose links are counted against all others, and the share of those that must be found.
AUDIT, RECALL = 1024, 0.99
#: Under the threshold by so much, a node is still passed while a range grows.
SLACK = 0.05
STEP = 512


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: neither null, empty or zero, nor with a null or non-finite component."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vec.isNotNull() & ~odd & F.exists(vec, lambda x: x != 0)


def unit(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of length one; shorter ones are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    off = np.asarray(vectors.offsets).astype(np.int64)
    size = np.diff(off)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)] = vectors.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    out /= np.abs(out).max(axis=1, initial=0)[:, None]
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def _first_of_each(row: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """Places of the first of equal (row, node) pairs."""
    return np.unique(row * n + node, return_index=True)[1]


def pruned(v: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, best first and -1 for none, those kept: a candidate goes that a kept one reaches by a short enough detour."""
    size = ids.shape[1]
    c = v[ids]
    between = c @ c.transpose(0, 2, 1)
    alive = ids >= 0
    kept, count = np.full((len(ids), degree), -1, np.int32), np.zeros(len(ids), np.int64)
    for k in range(size):
        rows = np.flatnonzero(alive[:, k] & (count < degree))
        if not len(rows):
            continue
        kept[rows, count[rows]] = ids[rows, k]
        count[rows] += 1
        if k + 1 < size:
            alive[rows, k + 1 :] &= ALPHA**2 * (1 - between[rows, k, k + 1 :]) > 1 - sims[rows, k + 1 :]
    return kept


class FlatGraph:
    """Links between the rows of ``v``, float32 of length one; ``links[i]`` are padded with -1."""

    def __init__(self, v: np.ndarray, links: np.ndarray | None = None) -> None:
        self.v = v
        self.start = int(np.argmax(v @ v.mean(axis=0))) if len(v) else 0  # the medoid
        self.links = np.full((len(v), DEGREE), -1, np.int32) if links is None else links

    def best(self, q: np.ndarray, beam: int, own: np.ndarray | None = None, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Greedy search from the medoid and each query's ``own`` node, if not -1: the ``beam`` best nodes met, best first, -1 for none."""
        m, n = len(q), len(self.v)
        ids, sims = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = self.start, q @ self.v[self.start]
        seen = np.zeros((m, n), bool)
        seen[:, self.start] = True
        if own is not None:
            at = np.flatnonzero((own >= 0) & (own != self.start))
            ids[at, 1], sims[at, 1] = self.start, sims[at, 0]
            ids[at, 0], sims[at, 0] = own[at], 1
            seen[at, own[at]] = True
        done = ids < 0
        while True:
            pick = ~done & (np.cumsum(~done, axis=1) <= width)
            row, at = np.nonzero(pick)
            if not len(row):
                return ids, sims
            done |= pick
            near = self.links[ids[row, at]]
            row, near = np.repeat(row, near.shape[1]), near.ravel().astype(np.int64)
            new = (near >= 0) & ~seen[row, near]
            row, near = row[new], near[new]
            one = _first_of_each(row, near, n)
            row, near = row[one], near[one]
            seen[row, near] = True
            s = np.einsum("ij,ij->i", self.v[near], q[row])
            good = s > sims[row, -1]
            row, near, s = row[good], near[good], s[good]
            if not len(row):
                continue
            first = np.searchsorted(row, np.arange(m))
            place = np.arange(len(row)) - first[row]
            more = int(place.max()) + 1
            i2, s2 = np.full((m, beam + more), -1, np.int64), np.full((m, beam + more), -np.inf, np.float32)
            d2 = np.ones((m, beam + more), bool)
            i2[:, :beam], s2[:, :beam], d2[:, :beam] = ids, sims, done
            i2[row, beam + place], s2[row, beam + place], d2[row, beam + place] = near, s, False
            order = np.argsort(-s2, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(x, order, 1) for x in (i2, s2, d2))

    def within(self, q: np.ndarray, least: float, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of at least about ``least``: the range found by greedy search grows along links until it ends."""
        ids, sims = self.best(q, beam, own)
        n = len(self.v)
        met = np.zeros((len(q), n), bool)
        row, at = np.nonzero((ids >= 0) & (sims >= least - SLACK))
        node, s = ids[row, at], sims[row, at]
        met[row, node] = True
        found = []
        while len(row):
            hit = s >= least - 1e-4
            found.append((row[hit], node[hit]))
            near = self.links[node]
            row, node = np.repeat(row, near.shape[1]), near.ravel().astype(np.int64)
            new = (node >= 0) & ~met[row, node]
            row, node = row[new], node[new]
            one = _first_of_each(row, node, n)
            row, node = row[one], node[one]
            met[row, node] = True
            s = np.einsum("ij,ij->i", self.v[node], q[row])
            go = s >= least - SLACK
            row, node, s = row[go], node[go], s[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def insert(self, rows: np.ndarray, held: int, beam: int) -> None:
        """Link ``rows`` to the graph and each other, and their neighbours back to them."""
        q = self.v[rows]
        ids, sims = self.best(q, beam) if held else (np.zeros((len(rows), 0), np.int64), np.zeros((len(rows), 0), np.float32))
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        few = min(len(rows) - 1, beam // 2 if held else beam)
        if few:
            top = np.argpartition(-among, few - 1, axis=1)[:, :few]
            ids, sims = np.concatenate([ids, rows[top]], axis=1), np.concatenate([sims, np.take_along_axis(among, top, 1)], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        self.links[rows] = pruned(self.v, ids, sims, DEGREE)
        a = np.repeat(rows, DEGREE)
        b = self.links[rows].ravel()
        a, b = a[b >= 0], b[b >= 0].astype(np.int64)
        to = np.unique(b)
        old = self.links[to]
        b, a = np.concatenate([b, np.repeat(to, DEGREE)[old.ravel() >= 0]]), np.concatenate([a, old.ravel()[old.ravel() >= 0]])
        one = _first_of_each(b, a, len(self.v))
        b, a = b[one], a[one]
        s = np.einsum("ij,ij->i", self.v[a], self.v[b])
        order = np.lexsort((-s, b))
        a, b, s = a[order], b[order], s[order]
        place = np.arange(len(b)) - np.searchsorted(b, b)
        a, b, s, place = (x[place < 2 * beam] for x in (a, b, s, place))
        at = np.searchsorted(to, b)
        ids, sims = np.full((len(to), int(place.max(initial=0)) + 1), -1, np.int64), np.full((len(to), int(place.max(initial=0)) + 1), -np.inf, np.float32)
        ids[at, place], sims[at, place] = a, s
        full = (ids >= 0).sum(axis=1) > DEGREE
        self.links[to[~full]] = np.pad(ids, ((0, 0), (0, DEGREE)), constant_values=-1)[~full, :DEGREE]
        for part in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // STEP))):
            if len(part):
                self.links[to[part]] = pruned(self.v, ids[part], sims[part], DEGREE)

    def build(self, beam: int) -> None:
        """Insert rows in batches as large as what is held, the medoid's first, and lead links to what no range or search reaches."""
        n = len(self.v)
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([[self.start], order[order != self.start]]) if n else order
        held = 0
        while held < n:
            size = min(max(held, 128), STEP, n - held)
            self.insert(order[held : held + size], held, beam)
            held += size
        self._answer()
        while n:
            met = np.zeros(n, bool)
            met[self.start] = True
            front = np.array([self.start])
            while len(front):
                near = np.unique(self.links[front])
                front = near[(near >= 0) & ~met[near]]
                met[front] = True
            lost = np.flatnonzero(~met)
            if not len(lost):
                return
            lost = lost[:STEP]
            inside = np.flatnonzero(met)
            best = inside[np.argmax(self.v[lost] @ self.v[inside].T, axis=1)]
            self._lead(best, lost)

    def _lead(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links from each a to its b, beyond the degree where that is full."""
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        free = (self.links[a] >= 0).sum(axis=1) + np.arange(len(a)) - np.searchsorted(a, a)
        wide = int(free.max(initial=0)) + 1 - self.links.shape[1]
        if wide > 0:
            self.links = np.pad(self.links, ((0, 0), (0, wide)), constant_values=-1)
        self.links[a, free] = b

    def _answer(self) -> None:
        """Each row's best neighbour links back to it, so that a range that holds the one leads to the other."""
        a = np.flatnonzero((self.links >= 0).any(axis=1))
        sims = np.where(self.links[a] >= 0, np.einsum("ikj,ij->ik", self.v[self.links[a]], self.v[a]), -np.inf)
        best = self.links[a, np.argmax(sims, axis=1)].astype(np.int64)
        lone = ~(self.links[best] == a[:, None]).any(axis=1)
        self._lead(best[lone], a[lone])


def _joined(label: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Labels after all nodes of a row are joined; each label is a node that bears it."""
    order = np.argsort(row, kind="stable")
    row, node = row[order], node[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
    while len(row):
        least = np.minimum.reduceat(label[node], first)[of]
        if (least == label[node]).all():
            break
        np.minimum.at(label, label[node], least)
        np.minimum.at(label, node, least)
        while not (label[label] == label).all():
            label = label[label]
    return label


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal (cell, part, block, kind)."""
    for x in batches:
        keys = np.stack([x.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cut], [*cut, len(keys)], strict=True):
            if b > a:
                yield tuple(keys[a].tolist()), x.slice(a, b - a)


def linked_classes(classes: DataFrame, width: int, threshold: float, overlap: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """``found(class, links)`` and ``edges(a, b)`` of ``classes(class, v, n)``.

    ``links`` sums ``n`` over the other classes found with a cosine of at least ``threshold``; the edges join the same classes
    as the pairs do, but are no more than the classes a task holds.
    """
    spark = classes.sparkSession
    total = classes.count()
    wanted = min(-(-total // SHARD_ROWS), max(1, PIVOT_BYTES // (8 * width)))
    picked = unit(classes.orderBy(F.xxhash64("class"), "class").limit(wanted).toArrow()["v"], width)  # PIVOT_BYTES at most
    pivots = picked[:1]
    for p in picked[1:]:
        if (pivots @ p).max() < threshold:  # near copies share a centre
            pivots = np.concatenate([pivots, p[None]])
    each = min(overlap, len(pivots))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a in range(0, x.num_rows, STEP):
                y = x.slice(a, STEP)
                cos = unit(y.column(1), width) @ pivots.T
                cell = np.argsort(-cos, axis=1, kind="stable")[:, :each].ravel()
                at = pa.array(np.repeat(np.arange(y.num_rows), each))
                yield pa.RecordBatch.from_arrays([y.column(0).take(at), y.column(1).take(at), y.column(2).take(at), pa.array(cell.astype(np.int32)), pa.array(np.tile(np.arange(each) == 0, y.num_rows))], ["class", "v", "n", "cell", "home"])

    rows = saved(classes.select("class", "v", "n").mapInArrow(dealt, "class bigint, v array<double>, n bigint, cell int, home boolean"))
    cells = rows.groupBy("cell").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts"), F.ceil(F.sum(F.col("home").cast("long")) / QUERY_BLOCK).cast("int").alias("blocks"))
    cells = F.broadcast(saved(cells))  # a row for each pivot
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    members = rows.join(cells, "cell").select("cell", part.alias("part"), "blocks", "class", "v", "n")

    def build(held: pa.Table) -> pa.Table:
        graph = FlatGraph(unit(held["v"], width).astype(np.float32))
        graph.build(beam)
        names = held["class"].to_numpy()
        real = graph.links >= 0
        off = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
        return pa.table({"class": pa.array(names), "near": pa.ListArray.from_arrays(pa.array(off), pa.array(names[graph.links[real]]))})

    links = members.groupBy("cell", "part").applyInArrow(build, "class bigint, near array<bigint>")
    flat = links.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one graph of all shards

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, graph = None, [], None
        u, names, weight, label = (np.zeros(0),) * 4

        def forest() -> Iterator[pa.RecordBatch]:
            if graph is not None:
                off = np.flatnonzero(label != np.arange(len(label)))
                yield out(names[off], np.zeros(len(off), np.int64), names[label[off]])

        def out(a: np.ndarray, count: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(count, pa.int64()), pa.array(b, pa.int64())], ["class", "links", "to"])

        for (*key, kind), x in _keyed(batches):
            if key != now:
                yield from forest()
                now, held, graph = key, [], None
            if kind == 0:
                held.append(x)
                continue
            if graph is None:
                if not held:
                    continue
                t = pa.Table.from_batches(held)
                held = []
                names, weight, u = t["class"].to_numpy(), t["n"].to_numpy(), unit(t["v"], width)
                order = np.argsort(names)
                near = t["near"].combine_chunks()
                flat_ids, off = near.values.to_numpy(zero_copy_only=False), np.asarray(near.offsets)
                owner = np.repeat(np.arange(len(names)), np.diff(off))
                at = np.minimum(np.searchsorted(names, flat_ids[off[0] : off[-1]], sorter=order), len(names) - 1)
                node = order[at]
                here = names[node] == flat_ids[off[0] : off[-1]]  # links to other shards lead nowhere here
                owner, node = owner[here], node[here]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                table = np.full((len(names), int(place.max(initial=0)) + 1), -1, np.int32)
                table[owner, place] = node
                graph, label = FlatGraph(u.astype(np.float32), table), np.arange(len(names))
            for a in range(0, x.num_rows, STEP):
                y = x.slice(a, STEP)
                q, ask = unit(y.column(5), width), y.column(4).to_numpy()
                at = order[np.minimum(np.searchsorted(names, ask, sorter=order), len(names) - 1)]
                row, node = graph.within(q.astype(np.float32), threshold, beam, np.where(names[at] == ask, at, -1))
                real = np.einsum("ij,ij->i", q[row], u[node]) >= threshold
                row, node = row[real], node[real]
                other = names[node] != ask[row]
                count = np.bincount(row[other], weights=weight[node[other]], minlength=len(ask)).astype(np.int64)
                label = _joined(label, row, node)
                to = ask.copy()
                to[row] = names[node]
                yield out(ask, count, to)
        yield from forest()

    none = F.lit(None).cast("array<bigint>")
    sides = members.join(flat, "class").select("cell", "part", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)).alias("block"), F.lit(0).alias("kind"), "class", "v", "n", "near")
    block = F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int")
    asks = rows.where("home").join(cells, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"), F.lit(1).alias("kind"), "class", "v", "n", none.alias("near"))
    met = sides.unionByName(asks).repartition(max(partitions_of(spark), -(-total * each // SHARD_ROWS)), "cell", "part", "block").sortWithinPartitions("cell", "part", "block", "kind")
    got = saved(met.mapInArrow(search, "class bigint, links bigint, to bigint"))
    return got.groupBy("class").agg(F.sum("links").alias("links")), got.where("class <> to").select(F.col("class").alias("a"), F.col("to").alias("b"))


def audited(classes: DataFrame, found: DataFrame, width: int, threshold: float) -> float:
    """The share of the links of AUDIT classes, chosen by hash, that were found: all other classes are compared with them in blocks."""
    picked = classes.orderBy(F.xxhash64("class", F.lit(7)), "class").limit(AUDIT).toArrow()
    if not picked.num_rows:
        return 1.0
    u, names = unit(picked["v"], width), picked["class"].to_numpy()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for x in batches:
            for a in range(0, x.num_rows, STEP):
                y = x.slice(a, STEP)
                near = (u @ unit(y.column(1), width).T >= threshold) & (names[:, None] != y.column(0).to_numpy()[None, :])
                total += near @ y.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["class", "all"])

    exact = classes.select("class", "v", "n").mapInArrow(counted, "class bigint, all bigint").groupBy("class").agg(F.sum("all").alias("all"))
    r = exact.join(found, "class", "left").agg(F.sum("all"), F.sum(F.least("all", F.coalesce("links", F.lit(0))))).first()
    return r[1] / r[0] if r[0] else 1.0


def near_vectors(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept, recall)``: one row for each row, with how many others have a cosine of at least ``threshold``.

    ``component_id`` is the smallest id reachable along links and ``kept`` whether that is the row's own.  Rows whose vector is
    null, empty or zero, or holds a null or non-finite component, link with nothing.  Shorter vectors count as filled with
    zeros; equal vectors link; rows with equal ids are rows of their own.  A row without id links like any other; it takes
    the smallest id of its component, null if that has none, and is not kept.  Other columns are not read.

    Equal vectors are one class, so copies cost nothing.  Classes join the OVERLAP clusters of nearest centres; a cluster is dealt
    to shards of about SHARD_ROWS, each shard builds a robust-pruned graph, and the lists of a class from all its shards
    are united into one flat graph.  Each class is searched in all shards of its nearest cluster, greedily from the medoid and
    then along links while they stay in range; each pair is verified in double precision.  Pairs are counted
    where they are found and never leave a task: what leaves it is a count a class and a spanning forest.

    ``recall`` is audited against AUDIT classes compared with all others.  While it is under RECALL, overlap and beam are doubled
    and the search is run again, at the latest until every class meets every other in some shard and is searched whole.
    """
    named = rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fit = usable(F.col("v"))
    classes = named.where(fit).groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = saved(classes.withColumn("class", F.monotonically_increasing_id()).select("class", "v", "n", "least"))
    width = classes.agg(F.max(F.size("v"))).first()[0] or 0
    alone = named.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    recall = 1.0
    if not width:
        return alone.withColumn("recall", F.lit(recall))
    overlap, beam = OVERLAP, BEAM
    total = classes.count()
    while True:
        found, edges = linked_classes(classes, width, threshold, overlap, beam)
        recall = audited(classes, found, width, threshold)
        if recall >= RECALL or (overlap * SHARD_ROWS >= total and beam >= 2 * SHARD_ROWS):
            break
        overlap, beam = overlap * 2, beam * 2
    of = components(edges.distinct()).select(F.col("id").alias("class"), F.col("component"))
    told = classes.join(found, "class", "left").join(of, "class", "left")
    told = saved(told.select("class", "v", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("component")))
    least = told.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    told = spread_join(told, least, "component", "size").select("v", "n", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = spread_join(named.where(fit), told, "v", "n")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.select("vec_id", "n_links", "component_id", kept.alias("kept")).unionByName(alone).withColumn("recall", F.lit(recall))
