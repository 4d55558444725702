"""Chat formatting: turns become one marked-up text per conversation, with a loss mask over assistant text.

The template of a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In a text every ``<``, any number
of backslashes, ``|`` gets one backslash more, so a formatted text holds ``<|`` nowhere but in its own
marks, and taking one backslash away gives the text back.  In a role, backslash, line feed and bar
are written ``\\\\``, ``\\n`` and ``\\p``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomline.llm.words import passes, spread, text_bytes
from fathomline.session import partitions_of

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
PARTS = "conv_id {conv}, first_turn {turn}, seq bigint, n_turns bigint, formatted string, loss_start array<bigint>, loss_chars array<bigint>"


def escaped(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, r"<(\\*)\|", r"<\\\1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escaped_role(role: pa.Array) -> pa.Array:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("|", "\\p")):
        role = pc.replace_substring(role, a, b)
    return role


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role) if "\\" in role else role


def assembled(role: pa.Array, text: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted texts of runs of turns that begin at ``first``, and where their learned texts lie (code points)."""
    learned = pc.equal(role, LEARNED_ROLE).to_numpy(zero_copy_only=False)
    roles, role_at = text_bytes(escaped_role(role))
    texts, text_at = text_bytes(escaped(text))
    head, tail = np.frombuffer(HEAD.encode(), np.uint8), np.frombuffer(TAIL.encode(), np.uint8)
    n = len(learned)
    size = np.stack([np.full(n, len(head)), np.diff(role_at), np.ones(n, np.int64), np.diff(text_at), np.full(n, len(tail))], axis=1)
    to = (np.cumsum(size) - size.ravel()).reshape(n, 5)
    total = int(size.sum())
    out = np.empty(total, np.uint8)
    out[to[:, 0, None] + np.arange(len(head))] = head
    out[spread(to[:, 1], size[:, 1])] = roles
    out[to[:, 2]] = 10
    out[spread(to[:, 3], size[:, 3])] = texts
    out[to[:, 4, None] + np.arange(len(tail))] = tail
    cut = np.append(to[first, 0], total).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(cut), pa.py_buffer(out))
    points = np.zeros(total + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=points[1:])
    base = np.repeat(points[to[first, 0]], np.diff(np.append(first, n)))
    at, end = points[to[:, 3]], points[to[:, 3] + size[:, 3]]
    lists = np.append(0, np.cumsum(learned))[np.append(first, n)].astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(lists), pa.array(v[learned])) for v in (at - base, end - at)]
    return formatted, *spans


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted conversations in parts: ``(conv_id, first_turn, seq, n_turns, formatted, loss_start, loss_chars)``.

    A conversation is its parts by first_turn and seq, one after the other; most have one.  Rows are
    dealt by range of conversation and turn, so a conversation of any length is spread over tasks and
    no part exceeds an Arrow batch.  Null role and text are empty, a null conversation is one too, null
    turns come first, and rows that share a turn go by role and text.  Other columns are not read.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for x in batches:
            for a, b in passes(x.column(3)):
                ids, turns, roles, texts = (x.column(k).slice(a, b - a) for k in range(4))
                new = np.ones(b - a, bool)
                new[1:] = ~pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
                none = ids.is_null().to_numpy(zero_copy_only=False)
                new[1:] &= ~(none[1:] & none[:-1])
                first = np.flatnonzero(new)
                formatted, start, chars = assembled(pc.fill_null(roles, ""), pc.fill_null(texts, ""), first)
                count = np.diff(np.append(first, b - a)).astype(np.int64)
                numbers = np.arange(seq, seq + len(first), dtype=np.int64)
                seq += len(first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(first)), turns.take(pa.array(first)), pa.array(numbers), pa.array(count), formatted, start, chars],
                    ["conv_id", "first_turn", "seq", "n_turns", "formatted", "loss_start", "loss_chars"],
                )

    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    dealt = named.repartitionByRange(partitions_of(rows.sparkSession), "conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInArrow(run, PARTS.format(conv=kinds[conv], turn=kinds[turn]))


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """The roles and texts of a formatted part, escapes undone."""
    for turn in formatted.split(TAIL)[:-1]:
        role, _, text = turn.removeprefix(HEAD).partition("\n")
        yield unescaped_role(role), unescaped(text)


def digests(parts: DataFrame) -> DataFrame:
    """Read formatted conversations back: a row each with digests of its turns and of what the mask covers.

    A digest of a whole conversation is sequential, so its parts stream through one task in order; the
    task holds one part and two hash states, whatever the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def closed() -> list:
            return [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]

        for x in batches:
            done = []
            for p in x.to_pylist():
                if not now or now[0] != p["conv_id"]:
                    if now:
                        done.append(closed())
                    now = [p["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += p["n_turns"]
                now[5] += len(p["formatted"])
                for role, text in turns_of(p["formatted"]):
                    now[2].update(f"{role}\n{text}\n".encode())
                for a, n in zip(p["loss_start"], p["loss_chars"], strict=True):
                    learned = unescaped(p["formatted"][a : a + n])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
            yield batch(done)
        yield batch([closed()] if now else [])

    kind = dict(parts.dtypes)["conv_id"]
    own = to_arrow_type(parts.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [parts.schema["conv_id"].dataType, "bigint", "string", "bigint", "string", "bigint"]
    arrow = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(done: list) -> pa.RecordBatch:
        first = pa.array([r[0] for r in done], type=own)
        return pa.RecordBatch.from_arrays([first, *(pa.array([r[k] for r in done], type=arrow[k]) for k in range(1, 6))], names)

    schema = ", ".join(f"{n} {kind if k == 0 else types[k]}" for k, n in enumerate(names))
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "seq").mapInArrow(run, schema)

