"""BPE encoding through a table of distinct words, and decoding through a join of ids to pieces.

Texts are split into words in tasks of Spark.  Each distinct word is encoded once, and its ids go to the
buckets of documents that hold it.  There the documents' words meet them by position.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.language_id import tokenizer_path
from fathomline.llm.words import gathered, give_back, passes, spread, text_bytes, xxh64
from fathomline.session import partitions_of

# The white space of the split pattern that byte-level vocabularies of this kind are published with,
# "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+", and its endings after an apostrophe.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
#: Code points that all versions of Unicode at hand class alike; texts with others are split by the library.
ALIKE = [(0x0000, 0x086F), (0x2000, 0x20BF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: Text bytes that are gathered before their distinct words are taken, at most twice as many at once.
PASS = 6 << 20
#: Text bytes of a bucket of documents, on average and at most unless a single text is longer than that.
BUCKET = 16 << 20


@cache
def classes() -> np.ndarray:
    """The class of each code point below 0x10000."""
    out = np.full(0x10000, ODD, np.uint8)
    for a, b in ALIKE:
        for c in range(a, b + 1):
            kind = unicodedata.category(chr(c))[0]
            out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[WHITE] = SPACE
    return out


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@cache
def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)


@cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes, and start and size for each id (size 0 for an id without a piece)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        table[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    size = np.array([len(x) for x in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size


def library_words(text: str, path: str) -> list[str]:
    """Words of a text as the library splits it, special tokens apart."""
    out, rest = [], [text]
    for token in special_tokens(path):
        rest = [y for x in rest for y in ([x] if x == token else _apart(x, token))]
    for part in rest:
        if part in special_tokens(path):
            out.append(part)
        elif part:
            out += [part[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
    return out


def _apart(text: str, token: str) -> list[str]:
    pieces_ = text.split(token)
    return [y for k, x in enumerate(pieces_) for y in ([token, x] if k else [x])]


def _bits(raw: np.ndarray, at: np.ndarray, mask: int) -> np.ndarray:
    return (raw[at] & np.uint8(mask)).astype(np.int32)


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = classes()
    out = np.append(table[:128], np.full(128, ODD, np.uint8))[raw]
    two, three = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0)), np.flatnonzero((raw >= 0xE0) & (raw < 0xF0))
    kind = table[(_bits(raw, two, 31) << 6) | _bits(raw, two + 1, 63)]
    out[two], out[two + 1] = kind, kind
    kind = table[(_bits(raw, three, 15) << 12) | (_bits(raw, three + 1, 63) << 6) | _bits(raw, three + 2, 63)]
    for k in range(3):
        out[three + k] = kind
    return out


def word_starts(raw: np.ndarray, off: np.ndarray, path: str) -> np.ndarray:
    """Where words begin in texts ``raw[off[t]:off[t + 1]]``; words tile each text."""
    if not len(raw):
        return np.zeros(0, np.int64)
    kind = byte_classes(raw)
    lead = (raw & 0xC0) != 0x80
    begin = np.zeros(len(raw) + 1, bool)
    begin[off] = True
    before = np.append(np.uint8(ODD), kind[:-1])
    start = lead & (begin[:-1] | (kind != before))
    # Of white space before a word its last character is apart, and a blank goes to the word.
    word = np.flatnonzero(start & ~begin[:-1] & (before == SPACE) & (kind != SPACE))
    last = word - 1
    for _ in range(2):
        last = np.where(lead[last], last, last - 1)
    start[last] = True
    start[word[raw[last] == 0x20]] = False
    # Endings after an apostrophe that begins a word are words.
    mark = np.flatnonzero((raw == 0x27) & start)
    limit = off[np.searchsorted(off, mark, "right")]
    padded = np.append(raw, np.zeros(2, np.uint8))
    for ending in ENDINGS:
        hit = mark + len(ending) < limit
        for k, byte in enumerate(ending):
            hit &= padded[mark + 1 + k] == byte
        at = mark[hit]
        start[at + 1] = False
        after = at + 1 + len(ending)
        start[after[after < len(raw)]] = True
    # Texts with other characters or special tokens are split by the library.
    odd = set((np.searchsorted(off, np.flatnonzero(kind == ODD), "right") - 1).tolist())
    whole = raw.tobytes()
    for token in special_tokens(path):
        at = whole.find(token.encode())
        while at >= 0:
            odd.add(int(np.searchsorted(off, at, "right")) - 1)
            at = whole.find(token.encode(), at + 1)
    for t in odd:
        a, b = int(off[t]), int(off[t + 1])
        words = library_words(whole[a:b].decode(), path)
        start[a:b] = False
        start[a + np.cumsum([0, *(len(w.encode()) for w in words[:-1])])] = True
    return np.flatnonzero(start)


def split_texts(texts: pa.Array, path: str) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of the first word of each text (one more for the end)."""
    raw, off = text_bytes(texts)
    parts = [off[a] + word_starts(raw[off[a] : off[b]], off[a : b + 1] - off[a], path) for a, b in passes(texts, 2 << 20)]
    start = np.concatenate([np.zeros(0, np.int64), *parts])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(raw)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
    return words, np.searchsorted(start, off)


def _slices(words: pa.Array, slices: int) -> np.ndarray:
    raw, off = text_bytes(words)
    return (xxh64(raw, off[:-1], off[1:]) % np.uint64(slices)).astype(np.int32)


def _in_order(words: pa.Array, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by slice and then bytes, and their slices in that order."""
    order = pc.sort_indices(words).to_numpy().astype(np.int64)
    part = _slices(words, slices)[order]
    again = np.argsort(part, kind="stable")
    return order[again], part[again]


def _zipped(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _parts(key: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of a sorted key with the range that has it."""
    own, cut = np.unique(key, return_index=True)
    return list(zip(own.tolist(), cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True)) if len(own) else []


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decode: bool = False) -> DataFrame:
    """``(id, n_tokens, ids)`` for each row of ``docs``: token ids of the whole text as little-endian unsigned 32-bit integers.

    The ids are those of the tokenizers library with the file at ``path`` (a byte-level BPE with the usual
    split pattern), without added special tokens; special tokens within a text count as such.  Null text is
    empty, ids may be null or repeat, an empty table gives no rows, other columns are not read.  With
    ``decode`` a column ``text`` has what ``decoded`` makes of the ids, where they are made.

    Documents are dealt to buckets of about BUCKET bytes by a hash of id and text; how many is counted first.
    Each batch sends its distinct words, with the buckets that hold them, to as many slices of the words.  A slice
    encodes each of its words once, and tells each bucket the ids of the words that it holds in order.  A
    bucket puts its own distinct words in that order, so ids meet words by position.  What travels is
    compressed.  A task holds one bucket or one slice, whatever the size of the table, and streams what it gives.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = max(partitions_of(docs.sparkSession), -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BUCKET))
    bucket = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n)).cast("int").alias("bucket")
    rows = docs.select(bucket, F.col(id_col).alias("id"), text.alias("text"))
    kind = dict(rows.dtypes)["id"]
    table = docs.sparkSession.sparkContext.broadcast(pieces(path)) if decode else None

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in gathered(batches, "text", PASS):
            for a, b in passes(x.column("text"), 2 * PASS):
                words, first = split_texts(x.column("text").slice(a, b - a), path)
                coded = words.dictionary_encode()
                order, part = _in_order(coded.dictionary, n)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                pair = np.unique(rank[coded.indices.to_numpy()] * n + np.repeat(x.column("bucket").to_numpy()[a:b], np.diff(first)))
                cut = np.searchsorted(pair // n, np.arange(len(order) + 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(cut), pa.array((pair % n).astype(np.int32)))
                table = pa.table({"word": coded.dictionary.take(pa.array(order)), "buckets": held})
                parts = _parts(part)
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in parts], pa.int32()), pa.array([_zipped(table.slice(i, j - i)) for _, i, j in parts], pa.binary())], ["slice", "words"])
            give_back()

    held = rows.select("bucket", "text").mapInArrow(distinct, "slice int, words binary")

    def encode(key: tuple, packs: pa.Table) -> pa.Table:
        table = pa.concat_tables(pa.ipc.open_stream(p).read_all() for p in packs["words"].to_pylist()).combine_chunks()
        coded = table["word"].combine_chunks().dictionary_encode()
        lists = table["buckets"].combine_chunks()
        order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = coded.dictionary.take(pa.array(order)).to_pylist()
        ids = [e.ids for a in range(0, len(words), 10_000) for e in tokenizer(path).encode_batch_fast(words[a : a + 10_000], add_special_tokens=False)]
        count = np.array([len(x) for x in ids], np.int64)
        flat, at = np.concatenate([np.array(x, np.uint32) for x in ids]), np.cumsum(count) - count
        own = np.unique(lists.values.to_numpy().astype(np.int64) * len(words) + np.repeat(rank[coded.indices.to_numpy()], np.diff(np.asarray(lists.offsets))))
        bucket_, word = own // len(words), own % len(words)
        out = []
        for b, i, j in _parts(bucket_):
            w = word[i:j]
            got = pa.table({"ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[w])).astype(np.int32)), pa.array(flat[spread(at[w], count[w])]))})
            out.append((b, _zipped(got)))
        give_back()
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "slice": pa.array([key[0].as_py()] * len(out), pa.int32()), "ids": pa.array([x for _, x in out], pa.binary())})

    told_ids = held.groupBy("slice").applyInArrow(encode, "bucket int, slice int, ids binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in gathered(batches, "text", PASS):
            order = np.argsort(x.column("bucket").to_numpy(), kind="stable")
            parts = _parts(x.column("bucket").to_numpy()[order])
            each = [_zipped(pa.table({c: x.column(c).take(pa.array(order[i:j])) for c in ("id", "text")})) for _, i, j in parts]
            del x
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int32()), pa.array(each, pa.binary())], ["bucket", "docs"])
            give_back()

    packed = rows.mapInArrow(pack, "bucket int, docs binary")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, told = [], []
        for x in batches:
            for s, p in zip(x.column("slice").to_pylist(), x.column("pack").to_pylist(), strict=True):
                packs.append(p) if s < 0 else told.append((s, p))
        # Of each pack its documents' ids, words by number and own distinct words; these are merged for the bucket.
        split = []
        while packs:
            t = pa.ipc.open_stream(packs.pop()).read_all().combine_chunks()
            words, first = split_texts(t["text"].combine_chunks(), path)
            coded = words.dictionary_encode()
            split.append((t["id"].combine_chunks(), first, coded.indices.to_numpy(), coded.dictionary))
            del t, words, coded
        every = pa.chunked_array([d for _, _, _, d in split], pa.string()).combine_chunks().dictionary_encode()
        order, _ = _in_order(every.dictionary, n)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lists = [pa.ipc.open_stream(p).read_all()["ids"].combine_chunks() for _, p in sorted(told)]
        count = np.concatenate([np.zeros(0, np.int64), *(np.diff(np.asarray(x.offsets)).astype(np.int64) for x in lists)])
        flat = np.concatenate([np.zeros(0, np.uint32), *(x.flatten().to_numpy() for x in lists)])
        if len(count) != len(order):
            raise RuntimeError("a bucket's words and the ids told to it differ")
        at = np.cumsum(count) - count
        to = rank[every.indices.to_numpy()]
        seen = len(to)
        del every, lists, told, order, rank
        while split:
            ids, first, indices, own = split.pop()
            seen -= len(own)
            word = to[seen : seen + len(own)][indices]
            size = count[word]
            ends = np.append(0, np.cumsum(size))[first]
            tokens = flat[spread(at[word], size)]
            columns = [ids, pa.array(np.diff(ends)), _binary(tokens, ends)]
            if table is not None:
                columns.append(_texts(tokens, ends, table.value))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "text"][: len(columns)])
        give_back()

    both = packed.select("bucket", F.lit(-1).alias("slice"), F.col("docs").alias("pack")).union(told_ids.select("bucket", "slice", "ids"))
    return both.groupBy("bucket").applyInArrow(assemble, f"id {kind}, n_tokens bigint, ids binary" + (", text string" if decode else ""))


def _binary(tokens: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(tokens, "<u4"))])


def _texts(tokens: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Array:
    """The texts whose ids are ``tokens[ends[t]:ends[t + 1]]``: each id's piece, in order."""
    data, start, size = table
    known = tokens < len(size)
    flat = np.where(known, tokens, 0).astype(np.int64)
    count = np.where(known, size[flat], 0) if len(size) else np.zeros(len(flat), np.int64)
    out = data[spread(start[flat], count)] if len(flat) and len(size) else data[:0]
    cut = np.append(0, np.cumsum(count))[ends]
    text = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:
        raw = out.tobytes()
        text = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())
    return text


def decoded(tokens: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with the string column ``text`` instead of ``ids``: each id joined with its piece, in order.

    The table of pieces is as large as the vocabulary, so it is broadcast, and the join looks ids up by position.
    Only ids go to Python.  A column of ``tokens`` that is called ``text`` gives way to the result.  Ids without a
    piece give nothing, bytes that are not UTF-8 give U+FFFD, null ids an empty text.
    """
    table = tokens.sparkSession.sparkContext.broadcast(pieces(path or tokenizer_path("byte_bpe_50k.json")))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            ids = pc.fill_null(x, b"")
            off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            out = []
            for a, b in passes(ids, 1 << 20):
                flat = np.frombuffer(ids.buffers()[2], "<u4", (off[b] - off[a]) // 4, off[a]) if off[b] > off[a] else np.zeros(0, "<u4")
                out.append(_texts(flat, (off[a : b + 1] - off[a]) // 4, table.value))
            yield pa.concat_arrays(out) if out else pa.array([], pa.string())
            give_back()

    text = F.arrow_udf(run, "string")(F.col(ids_col)).alias("text")
    return tokens.select(*(tokens[c] for c in tokens.columns if c not in (ids_col, "text")), text)
