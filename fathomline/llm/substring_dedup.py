"""Removal of repeated passages, revealed by recompression and verified on whole windows.

A text is recompressed in rounds.  A round gives every symbol a coin by its name and names each pair of
a head followed by a tail anew, by a hash of both names, so the same words get the same names in every
document and task.  Equal neighbours have equal coins and never pair, so a run stays a run whose slots all
bound symbols, and a document lists equal names of it once.  Whether a boundary of round r stands between
two words depends on 2^r words around it alone: symbols inside equal passages are equal.

Boundaries of round three, and those of round two inside a symbol of more than four words, are at most
four words apart.  The words around a boundary, three fewer than a window, are an anchor, and every window
holds one that its own words determine.  Documents ask, by slice of the names, which anchors others hold
too; windows around shared ones are compared by 128-bit names the same way.  What travels is arrays of names
for a bucket of documents, each name once or twice, so a passage in a third of all documents costs a slice
one entry for each bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.words import Words, give_back, mix64, passes, split, spread, strings, xxh64
from fathomline.session import partitions_of

ROUNDS, LONG = 3, 4
#: Text bytes of a bucket of documents, on average.
BUCKET = 16 << 20
NONE = np.iinfo(np.int64).max


def boundaries(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of words that begin a selected symbol, at most LONG apart unless a text begins or ends."""
    head = np.zeros(len(names) + 1, bool)
    head[first] = True
    at, before = np.arange(len(names)), np.arange(len(names))
    for r in range(ROUNDS):
        coin = (mix64(names, r + 1) >> np.uint64(63)).astype(bool)
        pair = np.zeros(len(names), bool)
        if len(names) > 1:
            pair[1:] = coin[:-1] & ~coin[1:] & ~head[at[1:]]
        both = np.flatnonzero(pair)
        names = names.copy()
        names[both - 1] = mix64(mix64(names[both - 1], 11) + names[both], 12)
        before = at
        at, names = at[~pair], names[~pair]
    size = np.diff(np.append(at, len(head) - 1))
    long = np.zeros(len(head), bool)
    long[at[size > LONG]] = True
    inner = before[np.isin(before, at, invert=True, assume_unique=True)]
    owner = at[np.searchsorted(at, inner, "right") - 1]
    return np.sort(np.concatenate([at, inner[long[owner]]]))


def grams(names: np.ndarray, start: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A name for each n words from ``start``."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(start), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + names[start + k]
        return mix64(h, salt)


def anchors(w: Words, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of 48 bits, where the anchor's words begin, and its text."""
    cut = boundaries(names, w.first)
    text = np.searchsorted(w.first, cut, "right") - 1
    start = cut - n // 2
    whole = (start >= w.first[text]) & (start + n <= w.first[text + 1])
    start, text = start[whole], text[whole]
    return grams(names, start, n, 21) >> np.uint64(16), start, text


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _texts(held: pa.Table):
    """Passes over a bucket: words, names of the words, and ids; a null id is NONE."""
    ids, texts = held["id"].combine_chunks(), held["text"].combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts, ids = pa.concat_arrays(texts.chunks), pa.concat_arrays(ids.chunks)
    ids = ids.fill_null(NONE).to_numpy(zero_copy_only=False)
    give_back()  # what the bucket before has left
    for a, b in passes(texts):
        w = split(texts[a:b])
        yield w, xxh64(w.buf, w.start, w.end), ids[a:b]
    give_back()


def _dealt(slices: int, key: np.ndarray, **columns: np.ndarray) -> list[tuple[int, dict[str, np.ndarray]]]:
    """The rows of each slice of ``key``."""
    where = (key % np.uint64(slices)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[order], np.arange(slices + 1))
    return [(s, {n: c[order[cut[s] : cut[s + 1]]] for n, c in columns.items()}) for s in range(slices) if cut[s] < cut[s + 1]]


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)`` for each row of ``docs``: words of repeated windows are gone from ``kept``.

    A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one text; it is repeated if its
    words also start in a text of a smaller id.  Windows are judged on the input.  ``kept`` is the words that
    stay, joined by one space.  Null text has no words; rows without an id lose nothing and are nobody's
    source; rows that share an id are never each other's source; texts shorter than a window stay whole; an
    empty table gives no rows; other columns are not read.  Documents are dealt by a hash of id and text to buckets of
    about BUCKET bytes, how many is counted first, and names to as many slices; a task holds one of them.
    """
    if window < 11:
        raise ValueError("anchors need windows of 11 words or more")
    size = window - LONG + 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = slices = max(partitions_of(docs.sparkSession), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    bucketed = rows.groupBy("bucket")

    def name_anchors(key: tuple, held: pa.Table) -> pa.Table:
        found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for w, names, ids in _texts(held):
            name, _, text = anchors(w, names, size)
            real = ids[text] != NONE
            found.append(name[real])
            owners.append(ids[text][real])
        name, owner = np.concatenate(found), np.concatenate(owners)
        order = np.lexsort((owner, name))
        name, owner = name[order], owner[order]
        new = np.append(True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1]))[: len(name)]
        name = name[new]
        # Once for a name of one document, twice for one of several.
        third = np.append([False, False], name[2:] == name[:-2])[: len(name)]
        name = name[~third]
        out = _dealt(slices, name, name=name)
        bucket = key[0].as_py()
        return pa.table({"slice": pa.array([s for s, _ in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "names": pa.array([_six(x["name"]) for _, x in out], pa.binary())})

    asked = bucketed.applyInArrow(name_anchors, "slice int, bucket int, names binary")

    def shared_anchors(rows: pa.Table) -> pa.Table:
        give_back()
        lists = [_eight(b) for b in rows["names"].to_pylist()]
        name = np.concatenate(lists)
        owner = np.repeat(rows["bucket"].to_numpy(), [len(x) for x in lists])
        order = np.argsort(name, kind="stable")
        name, owner = name[order], owner[order]
        same = name[1:] == name[:-1]
        shared = np.append(same, False) | np.append(False, same)
        name, owner = name[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        name, owner = name[order], owner[order]
        buckets, cut = np.unique(owner, return_index=True)
        parts = np.split(name, cut[1:]) if len(cut) else []
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "names": pa.array([_six(x) for x in parts], pa.binary())})

    shared = asked.groupBy("slice").applyInArrow(shared_anchors, "bucket int, names binary")

    def name_windows(key: tuple, held: pa.Table, told: pa.Table) -> pa.Table:
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_eight(b) for b in told["names"].to_pylist())]))
        found, other, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for w, names, ids in _texts(held) if len(known) else ():
            name, start, text = anchors(w, names, size)
            at = np.minimum(np.searchsorted(known, name), len(known) - 1)
            hit = (known[at] == name) & (ids[text] != NONE)
            start, text = start[hit], text[hit]
            some = np.zeros(len(names) + 1, bool)
            for back in range(window - size + 1):
                s = start - back
                some[s[(s >= w.first[text]) & (s + window <= w.first[text + 1])]] = True
            s = np.flatnonzero(some)
            second = np.zeros(len(names), np.uint64)
            near = np.zeros(len(names) + 1, np.int64)
            np.add.at(near, s, 1)
            np.add.at(near, s + window, -1)
            near = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            second[near] = xxh64(w.buf, w.start[near], w.end[near], 43)
            found.append(grams(names, s, window, 31))
            other.append(grams(second, s, window, 32))
            owners.append(ids[np.searchsorted(w.first, s, "right") - 1])
        one, two, owner = np.concatenate(found), np.concatenate(other), np.concatenate(owners)
        order = np.lexsort((owner, two, one))
        one, two, owner = one[order], two[order], owner[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
        last = np.append(np.flatnonzero(new)[1:], len(one)) - 1
        many = owner[last] > owner[new] if len(one) else np.zeros(0, bool)
        out = _dealt(slices, one[new], one=one[new], two=two[new], least=owner[new], many=many)
        return pa.table(
            {"slice": pa.array([s for s, _ in out], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32())}
            | {c: pa.array([x[c].tobytes() for _, x in out], pa.binary()) for c in ("one", "two", "least", "many")}
        )

    windows = bucketed.cogroup(shared.groupBy("bucket")).applyInArrow(name_windows, "slice int, bucket int, one binary, two binary, least binary, many binary")

    def least_owners(rows: pa.Table) -> pa.Table:
        give_back()
        one, two, least, many = (np.concatenate([np.frombuffer(b, t) for b in rows[c].to_pylist()]) for c, t in (("one", np.uint64), ("two", np.uint64), ("least", np.int64), ("many", bool)))
        owner = np.repeat(rows["bucket"].to_numpy(), [len(b) // 8 for b in rows["one"].to_pylist()])
        order = np.lexsort((least, two, one))
        one, two, least, many, owner = one[order], two[order], least[order], many[order], owner[order]
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        first = least[new][np.cumsum(new) - 1]
        tell = many | (first < least)
        one, two, first, owner = one[tell], two[tell], first[tell], owner[tell]
        order = np.argsort(owner, kind="stable")
        one, two, first, owner = one[order], two[order], first[order], owner[order]
        buckets, cut = np.unique(owner, return_index=True)
        part = lambda x: pa.array([p.tobytes() for p in np.split(x, cut[1:])] if len(cut) else [], pa.binary())
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "one": part(one), "two": part(two), "least": part(first)})

    repeated = windows.groupBy("slice").applyInArrow(least_owners, "bucket int, one binary, two binary, least binary")

    def keep(key: tuple, held: pa.Table, told: pa.Table) -> pa.Table:
        one, two, least = (np.concatenate([np.zeros(0, t), *(np.frombuffer(b, t) for b in told[c].to_pylist())]) for c, t in (("one", np.uint64), ("two", np.uint64), ("least", np.int64)))
        order = np.lexsort((two, one))
        one, two, least = one[order], two[order], least[order]
        seen = np.zeros(1 << 22, bool)
        seen[(one >> np.uint64(42)).astype(np.int64)] = True
        out = []
        for w, names, ids in _texts(held):
            total = np.diff(w.first)
            gone = np.zeros(len(names), bool)
            if len(one):
                s = spread(w.first[:-1], np.maximum(total - window + 1, 0))
                name = grams(names, s, window, 31)
                may = seen[(name >> np.uint64(42)).astype(np.int64)]
                s, name = s[may], name[may]
                at = np.searchsorted(one, name)
                may = (at < len(one)) & (one[np.minimum(at, len(one) - 1)] == name)
                s, name, at = s[may], name[may], at[may]
                touched = np.zeros(len(names) + 1, np.int64)
                np.add.at(touched, s, 1)
                np.add.at(touched, s + window, -1)
                near = np.flatnonzero(np.cumsum(touched)[:-1] > 0)
                second = np.zeros(len(names), np.uint64)
                second[near] = xxh64(w.buf, w.start[near], w.end[near], 43)
                check = grams(second, s, window, 32)
                mine = ids[np.searchsorted(w.first, s, "right") - 1]
                hit = np.zeros(len(s), bool)
                live = np.arange(len(s))
                while len(live):  # windows that share a first name follow each other
                    same = two[at[live]] == check[live]
                    hit[live] |= same & (least[at[live]] < mine[live]) & (mine[live] != NONE)
                    at[live] += 1
                    live = live[~same & (at[live] < len(one))]
                    live = live[one[at[live]] == name[live]]
                cover = np.zeros(len(names) + 1, np.int64)
                np.add.at(cover, s[hit], 1)
                np.add.at(cover, s[hit] + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
            kept = np.flatnonzero(~gone)
            cut = np.searchsorted(kept, w.first)
            spaced = np.ones(len(kept), np.int64)
            spaced[cut[1:][cut[1:] > cut[:-1]] - 1] = 0  # no space after a text's last word
            length = w.end[kept] - w.start[kept] + spaced
            buf = np.append(w.buf, np.uint8(32))
            take = spread(w.start[kept], length)
            ends = np.cumsum(length)
            joined = buf[np.minimum(take, len(buf) - 1)]
            joined[(ends - 1)[spaced > 0]] = 32
            edge = np.append(0, ends)[cut]
            removed = total - np.diff(cut)
            out.append(pa.table({"id": pa.array(ids, mask=ids == NONE), "n_words": total.astype(np.int64), "n_removed": removed.astype(np.int64), "kept": strings(joined, edge[:-1], edge[1:]).cast(pa.string())}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    return bucketed.cogroup(repeated.groupBy("bucket")).applyInArrow(keep, "id bigint, n_words bigint, n_removed bigint, kept string")
