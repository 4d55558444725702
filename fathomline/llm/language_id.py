"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of one fixed public vocabulary.  A word's probability is the
sum over all its segmentations into pieces, by a forward algorithm; a text's is the product over its words.
Words are the runs of letters, lower-cased, with the space before them that the vocabulary's pieces carry.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.words import give_back, passes, split, spread, strings, text_bytes
from fathomline.session import saved

#: Pieces of up to 8 bytes fit one integer; longer ones are found by their first 8 bytes and compared whole.
PIECE = 8
#: Every byte of a word is scaled by this so that products of probabilities stay in range; logs take it back.
SCALE = 64.0
#: Sums are brought back to a largest of 1 each so many bytes, so words of any length stay in range.
REST = 32
#: Places of words that one numpy pass scores, unless a single word has more.
PASS_PLACES = 1 << 18
#: Text bytes whose distinct words one pass scores.
PASS_BYTES = 4 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary(NamedTuple):
    """Pieces as numbers.  Short ones: for each length their bytes as sorted integers.  Long ones: sorted, by their first 8 bytes."""

    keys: list[np.ndarray]
    numbers: list[np.ndarray]
    prefix: np.ndarray
    cut: np.ndarray
    tail: np.ndarray
    size: np.ndarray
    number: np.ndarray
    total: int
    longest: int


@cache
def vocabulary(path: str) -> Vocabulary:
    """All pieces of the file, and every single byte."""
    with open(path, "rb") as f:
        pieces = sorted({base64.b64decode(line.split()[0]) for line in f} | {bytes([b]) for b in range(256)})
    keys, numbers = [], []
    for n in range(1, PIECE + 1):
        own = sorted((int.from_bytes(p, "little"), k) for k, p in enumerate(pieces) if len(p) == n)
        keys.append(np.array([x for x, _ in own], np.uint64))
        numbers.append(np.array([k for _, k in own], np.int32))
    long = sorted((int.from_bytes(p[:PIECE], "little"), p[PIECE:], k) for k, p in enumerate(pieces) if len(p) > PIECE)
    prefix, cut = np.unique(np.array([x for x, _, _ in long], np.uint64), return_index=True)
    longest = max(map(len, pieces))
    tail = np.zeros((len(long), longest - PIECE + 1), np.uint8)
    for i, (_, rest, _) in enumerate(long):
        tail[i, : len(rest)] = np.frombuffer(rest, np.uint8)
    size = np.array([PIECE + len(rest) for _, rest, _ in long], np.int64)
    return Vocabulary(keys, numbers, prefix, np.append(cut, len(long)), tail, size, np.array([k for _, _, k in long], np.int64), len(pieces), longest)


class Matches(NamedTuple):
    """Pieces that words hold.  ``short``: (words, places, lengths), the number of pieces for none; long ones by place."""

    short: np.ndarray
    place: np.ndarray
    word: np.ndarray
    size: np.ndarray
    number: np.ndarray
    cut: np.ndarray


def _grid(buf: np.ndarray, start: np.ndarray, size: np.ndarray, more: int) -> np.ndarray:
    out = np.zeros((len(start), int(size.max()) + more), np.uint8)
    at = np.arange(out.shape[1])
    held = at < size[:, None]
    out[held] = buf[(start[:, None] + at)[held]]
    return out


def _matches(buf: np.ndarray, start: np.ndarray, size: np.ndarray, path: str) -> Matches:
    """The pieces of each word ``buf[start:start + size]`` at each place."""
    voc = vocabulary(path)
    grid = _grid(buf, start, size, voc.longest + 1)
    places = grid.shape[1] - voc.longest - 1
    out = np.full((len(grid), places, PIECE), voc.total, np.int32)
    key = np.zeros((len(grid), places), np.uint64)
    for n in range(PIECE):
        key |= grid[:, n : n + places].astype(np.uint64) << np.uint64(8 * n)
        fits = np.arange(places) + n < size[:, None]
        want = key[fits]
        at = np.minimum(np.searchsorted(voc.keys[n], want), len(voc.keys[n]) - 1)
        out[:, :, n][fits] = np.where(voc.keys[n][at] == want, voc.numbers[n][at], voc.total)
    word, place = np.nonzero(np.arange(places) + PIECE < size[:, None]) if len(voc.prefix) else (np.zeros(0, np.int64),) * 2
    want = key[word, place]
    at = np.minimum(np.searchsorted(voc.prefix, want), max(len(voc.prefix) - 1, 0))
    hit = voc.prefix[at] == want if len(want) else np.zeros(0, bool)
    word, place, at = word[hit], place[hit], at[hit]
    many = voc.cut[at + 1] - voc.cut[at]
    piece = spread(voc.cut[at], many)
    word, place = np.repeat(word, many), np.repeat(place, many)
    fits = place + voc.size[piece] <= size[word]
    word, place, piece = word[fits], place[fits], piece[fits]
    along = np.arange(voc.tail.shape[1])
    same = (grid[word[:, None], place[:, None] + PIECE + along[:-1]] == voc.tail[piece, :-1]) | (along[:-1] >= voc.size[piece, None] - PIECE)
    same = same.all(axis=1)
    word, place, piece = word[same], place[same], piece[same]
    order = np.argsort(place, kind="stable")
    word, place, piece = word[order], place[order], piece[order]
    return Matches(out, place, word, voc.size[piece], voc.number[piece], np.searchsorted(place, np.arange(places + 1)))


def _live(size: np.ndarray, i: int) -> int:
    """How many words reach beyond place i; words come longest first."""
    return int(np.searchsorted(-size, -i, "left"))


def _forward(found: Matches, size: np.ndarray, prob: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over segmentations of each prefix, (places + 1, words, languages), and the logs taken out of them up to each REST places.

    The last row of prob is 0.
    """
    words, places, _ = found.short.shape
    alpha = np.zeros((places + 1, words, prob.shape[1]))
    taken = np.zeros((places // REST + 1, words, prob.shape[1]))
    alpha[0] = 1.0
    for i in range(places):
        live = _live(size, i)
        if i and i % REST == 0:
            near = alpha[i : i + longest + 1, :live]
            most = near.max(axis=0)
            most[most <= 0] = 1.0
            near /= most
            taken[i // REST] = taken[i // REST - 1]
            taken[i // REST, :live] += np.log(most)
        for n in range(min(PIECE, places - i)):
            alpha[i + n + 1, :live] += alpha[i, :live] * (prob[found.short[:live, i, n]] * SCALE ** (n + 1))
        a, b = found.cut[i], found.cut[i + 1]
        if a < b:
            w, n = found.word[a:b], found.size[a:b]
            np.add.at(alpha, (i + n, w), alpha[i, w] * (prob[found.number[a:b]] * (SCALE**n)[:, None]))
    return alpha, taken


def _passes(size: np.ndarray) -> Iterator[np.ndarray]:
    """Words longest first, about PASS_PLACES places at a time."""
    order = np.argsort(-size, kind="stable")
    a = 0
    while a < len(order):
        b = a + max(1, PASS_PLACES // max(int(size[order[a]]), 1))
        yield order[a:b]
        a = b


def _total(alpha: np.ndarray, taken: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log of each word's sum, the scale of its bytes included."""
    every = np.arange(len(size))
    return np.log(np.maximum(alpha[size, every], 1e-300)) + taken[np.maximum(size - 1, 0) // REST, every]


def word_scores(words: pa.Array, prob: np.ndarray, path: str) -> np.ndarray:
    """Log probability of each word in each language, summed over segmentations."""
    buf, off = text_bytes(words)
    start, size = off[:-1], np.diff(off)
    out = np.zeros((len(words), prob.shape[1]))
    for k in _passes(size):
        if not size[k[0]]:
            break  # the rest are empty
        alpha, taken = _forward(_matches(buf, start[k], size[k], path), size[k], prob, vocabulary(path).longest)
        out[k] = _total(alpha, taken, size[k]) - size[k, None] * np.log(SCALE)
    return out


def piece_counts(words: pa.Array, n: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece in the words, each n times, if all pieces were equally likely (forward-backward)."""
    voc = vocabulary(path)
    prob = np.append(np.full(voc.total, 1.0 / voc.total), 0.0)
    buf, off = text_bytes(words)
    start, size = off[:-1], np.diff(off)
    out = np.zeros(voc.total + 1)
    for k in _passes(size):
        if not size[k[0]]:
            break
        found = _matches(buf, start[k], size[k], path)
        alpha, taken = _forward(found, size[k], prob[:, None], voc.longest)
        total, alpha, taken = _total(alpha, taken, size[k])[:, 0], alpha[:, :, 0], taken[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[size[k], np.arange(len(k))] = 1.0
        put = np.zeros(len(k))
        places = found.short.shape[1]
        for i in range(places - 1, -1, -1):
            live = _live(size[k], i)
            share = alpha[i, :live] * np.exp(taken[i // REST, :live] + put[:live] - total[:live]) * n[k[:live]]
            for m in range(min(PIECE, places - i)):
                piece = found.short[:live, i, m]
                step = prob[piece] * SCALE ** (m + 1) * beta[i + m + 1, :live]
                beta[i, :live] += step
                out += np.bincount(piece, share * step, voc.total + 1)
            a, b = found.cut[i], found.cut[i + 1]
            if a < b:
                w, z, piece = found.word[a:b], found.size[a:b], found.number[a:b]
                step = prob[piece] * SCALE**z * beta[i + z, w]
                np.add.at(beta, (i, w), step)
                out += np.bincount(piece, share[w] * step, voc.total + 1)
            if i % REST == 0:
                near = beta[i : i + voc.longest + 1, :live]
                most = near.max(axis=0)
                most[most <= 0] = 1.0
                near /= most
                put[:live] += np.log(most)
    return out[: voc.total]


def letter_runs(text: Column) -> Column:
    """The runs of letters of a text, lower-cased, with a space between them."""
    return F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}]+", " ")


class Model:
    """Languages in order, and the probability of each piece in each (a last row of zeros for no piece)."""

    def __init__(self, languages: list[str], prob: np.ndarray, path: str) -> None:
        self.languages, self.prob, self.path = languages, prob, path


def sampled(rows: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """``(lang, text)`` of at most ``most`` of ``rows(lang, id, text)`` a language, those of the least hashes of id and text.

    Rows alike in language, id and text are one row, so null or repeated ids choose nothing by themselves.  A share of the
    hashes is looked at that holds a quarter more than is wanted; where rows repeat so often that it holds
    too few, it widens, at last to all.  ``sizes`` has the number of rows of each language.
    """
    full = 1 << 53
    share = {lang: min(1.0, 1.25 * most / n) for lang, n in sizes.items()}
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64("id", "text", F.lit("lang")), F.lit(full)))
    while True:
        part = F.create_map(*(F.lit(x) for lang, p in share.items() for x in (lang, int(p * full))))
        picked = saved(hashed.where(F.col("_h") < part[F.col("lang")]).groupBy("lang", "_h").agg(F.any_value("text").alias("text")))
        held = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        short = [lang for lang, p in share.items() if p < 1 and held.get(lang, 0) < most]
        if not short:
            best = Window.partitionBy("lang").orderBy("_h")  # little more than ``most`` rows
            return picked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most).select("lang", "text")
        share |= {lang: min(1.0, 16 * share[lang]) for lang in short}


def learned(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample_per_lang: int = 2000, smoothing: float = 0.1, path: str | None = None) -> Model:
    """A model of the languages in ``docs``; rows without text or language teach nothing.

    It is fitted on a bounded sample of labelled rows, ``sample_per_lang`` of each language at most, see
    ``sampled``.  Piece counts are expected counts over all
    segmentations, smoothed by ``smoothing`` for each piece.  The result is as large as the vocabulary
    times the number of languages, whatever the input.
    """
    path = path or tokenizer_path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    total = vocabulary(path).total
    if not languages:
        return Model([], np.zeros((total + 1, 0)), path)
    sample = sampled(rows, sizes, sample_per_lang)
    words = sample.select("lang", F.explode(F.split(letter_runs(F.col("text")), " ")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            langs = np.array(x.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = pa.array(np.flatnonzero(langs == lang))
                spaced = pc.binary_join_element_wise(" ", x.column(1).take(own), "")
                uses = piece_counts(spaced, x.column(2).take(own).to_numpy().astype(float), path)
                used = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(uses[used])], ["lang", "piece", "uses"])
            give_back()

    uses = words.mapInArrow(expected, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
    counts = np.zeros((total, len(languages)))
    counts[uses["piece"].to_numpy(np.int64), [languages.index(x) for x in uses["lang"]]] = uses["uses"]
    # Rounded, so that the order in which tasks were summed changes no prediction.
    prob = np.round(counts, 6) + smoothing
    return Model(languages, np.vstack([prob / prob.sum(axis=0), np.zeros(len(languages))]), path)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``(id, *keep, lang_pred, score)`` for each row of ``docs``, from its whole text.

    ``score`` is the posterior of the predicted language, each equally likely beforehand; equal ones go to
    the first by name.  A text that is null or has no letter is ``und`` with score 0, as all are without a
    learned language.  Repeated rows are predicted alike; ids may be null; an empty table gives no rows.
    Only the letters of a text go to Python; the kept columns stay in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.prob, model.path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages, prob, path = shared.value
        for runs in batches:
            has, total = np.zeros(len(runs), np.int64), np.zeros((len(runs), len(languages)))
            for a, b in passes(runs, PASS_BYTES):
                w = split(runs.slice(a, b - a))
                has[a:b] = np.diff(w.first)
                words = strings(w.buf, w.start, w.end).dictionary_encode()
                score = word_scores(pc.binary_join_element_wise(" ", words.dictionary.cast(pa.string()), ""), prob, path)
                some = a + np.flatnonzero(has[a:b])
                number, cut = words.indices.to_numpy(), w.first[:-1][has[a:b] > 0]
                for k in range(len(languages) if len(some) else 0):
                    total[some, k] = np.add.reduceat(score[number, k], cut)
                give_back()
            name, share = np.full(len(runs), "und", object), np.zeros(len(runs))
            if languages:
                name = np.where(has > 0, np.array(languages, object)[total.argmax(axis=1)], "und")
                share = np.where(has > 0, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            yield pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(share)], ["lang_pred", "score"])

    told = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()  # so that it runs once a row
    rows = docs.select(F.col(id_col).alias("id"), *keep, told(letter_runs(F.col(text_col))).alias("_told"))
    return rows.select(*(rows[c] for c in rows.columns[:-1]), "_told.lang_pred", "_told.score")
