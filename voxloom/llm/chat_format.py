"""Chat formatting by columnar byte assembly.

A conversation becomes one text: BEGIN, and for each turn OPEN role CLOSE text END. Control strings (CONTROLS, those of the
template and those of other common chat templates) inside roles and texts are broken by a backslash after their first
character, and backslashes are doubled, so that a text can never be read as a mark; `unescape` takes that back.

Segments (marks, roles, texts) of a run of turns are laid out at once: their lengths give cumulative offsets, and from these a
source index for each output byte is computed in numpy; one gather copies marks and contents into a single preallocated Arrow
buffer, which is the data of the output column. The loss mask is a list of [start, end) code points of the output: the texts
of assistant turns.

Rows are brought together by conversation with one shuffle and sorted inside partitions, so turns of one conversation pass
through a task in order and are not collected by Spark. A conversation's text is one value, so it has to fit a task.

Defined cases: null text or role is empty; turns that tie are ordered by role, then text; repeated rows are turns; a null
conv_id is a conversation; a null turn comes first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import table

BEGIN, OPEN, CLOSE, END = b"<|begin|>", b"<|role|>", b"<|text|>\n", b"<|end|>\n"
#: Control strings of chat templates.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_BREAK = rb"\\|<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\])"
_HAS = r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>"
_TURN = re.compile(re.escape(OPEN) + rb"(.*?)" + re.escape(CLOSE) + rb"(.*?)" + re.escape(END), re.S)


def escape(text: bytes) -> bytes:
    return re.sub(_BREAK, rb"\g<0>\\", text)


def unescape(text: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.S) if b"\\" in text else text


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted conversation."""
    if not formatted.startswith(BEGIN):
        raise ValueError("no formatted conversation")
    turns, at = [], len(BEGIN)
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _escaped(column: pa.Array) -> pa.Array:
    """The column with nulls empty and control strings broken; only values that hold any are touched one by one."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    has = pc.match_substring_regex(column, _HAS).to_numpy(zero_copy_only=False)
    if has.any():
        own = column.cast(pa.large_binary()).to_pylist()
        for i in np.flatnonzero(has):
            own[i] = escape(own[i])
        column = pa.array(own, pa.large_binary()).cast(pa.large_string())
    return column


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a large_string array."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at[:-1], np.diff(at)


def assemble(first: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Format consecutive turns: first[i] is true where a conversation begins.

    Returns the formatted conversations (large_string), and for each turn the [start, end) of its text in code points.
    """
    n = len(first)
    roles, texts = _escaped(roles), _escaped(texts)
    raw_r, at_r, len_r = _bytes_of(roles)
    raw_t, at_t, len_t = _bytes_of(texts)
    marks = np.frombuffer(BEGIN + OPEN + CLOSE + END, np.uint8)
    at = np.cumsum([0, len(BEGIN), len(OPEN), len(CLOSE)])
    source = np.concatenate((marks, raw_r, raw_t))
    # six segments for each turn: begin (or nothing), open, role, close, text, end
    starts = np.empty((n, 6), np.int64)
    starts[:, 0], starts[:, 1], starts[:, 3], starts[:, 5] = at
    starts[:, 2], starts[:, 4] = at_r + len(marks), at_t + len(marks) + len(raw_r)
    sizes = np.empty((n, 6), np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 3], sizes[:, 5] = np.where(first, len(BEGIN), 0), len(OPEN), len(CLOSE), len(END)
    sizes[:, 2], sizes[:, 4] = len_r, len_t
    flat = sizes.ravel()
    ends = np.cumsum(flat)
    total = int(ends[-1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    step = 1 << 20
    lo = 0
    for hi in range(0, n, 1024):  # turns at a time: the index has eight bytes for each output byte
        k = slice(hi * 6, min(n, hi + 1024) * 6)
        size, end = flat[k], ends[k]
        until = int(end[-1])
        for a in range(lo, until, step):
            b = min(until, a + step)
            x = np.arange(a, b)
            seg = np.searchsorted(end, x, "right") if b - a < until - lo else np.repeat(np.arange(len(size)), size)
            out[a:b] = source[starts.ravel()[k][seg] + x - (end - size)[seg]]
        lo = until
    turn_ends = ends.reshape(n, 6)
    begins = np.flatnonzero(first)
    offsets = np.append(turn_ends[begins, 0] - sizes[begins, 0], total) if n else np.zeros(1, np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets.astype(np.int64)), buffer])
    # byte offsets -> code points: bytes that begin a character, counted within the conversation
    chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    base = chars[offsets[:-1]][np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
    stop = turn_ends[:, 4] if n else np.zeros(0, np.int64)
    return formatted, chars[stop - len_t] - base, chars[stop] - base


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, formatted_chars, loss array of [start, end) flat) for each conversation.

    turns: conv_id, turn, role, text.
    """

    def run(parts):
        def done(held: pa.Table):
            held = held.combine_chunks()
            conv = held.column("conv_id").combine_chunks()
            ids, null = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            first = np.ones(len(ids), bool)
            first[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
            roles, texts = (held.column(k).combine_chunks() for k in ("role", "text"))
            formatted, start, stop = assemble(first, roles, texts)
            begins = np.flatnonzero(first)
            counts = np.diff(np.append(begins, len(ids)))
            mine = pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False)
            of = (np.cumsum(first) - 1)[mine]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], 2 * np.cumsum(np.bincount(of, minlength=len(begins))))), pa.int32()), pa.array(np.column_stack((start[mine], stop[mine])).ravel(), pa.int64()))
            return pa.RecordBatch.from_arrays([conv.take(pa.array(begins)), pa.array(counts, pa.int64()), formatted.cast(pa.string()), pc.utf8_length(formatted).cast(pa.int64()), lists], names=["conv_id", "n_turns", "formatted", "formatted_chars", "loss"])

        held, size = None, 0
        for part in parts:
            for i in range(0, part.num_rows, 2000):
                piece = pa.Table.from_batches([part.slice(i, 2000)])
                held = piece if held is None else pa.concat_tables([held, piece])
                conv = held.column("conv_id")
                last = conv[-1].as_py()
                same = pc.fill_null(pc.equal(conv, last), False) if last is not None else conv.is_null()
                keep = held.num_rows - pc.sum(same).as_py()  # the last conversation may go on; equal ids are neighbours
                if keep:
                    yield done(held.slice(0, keep))
                    held = held.slice(keep)
        if held is not None and held.num_rows:
            yield done(held)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, n_turns long, formatted string, formatted_chars long, loss array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the output alone: turns by parsing, losses by the mask's code points."""

    def run(parts):
        for part in parts:
            out = []
            for text, loss in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                turns = parse(text.encode())
                said = "".join(unescape(text[a:b].encode()).decode() for a, b in zip(loss[::2], loss[1::2]))
                out.append((len(turns), hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
            n, turns, chars, said, size = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(said, pa.string()), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_chats(turns.union(own)))


def _count(x: str) -> str:
    return f"(length(text) - length(replace(text, '{x}', ''))) // {len(x)}"


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST({len(BEGIN)} + sum({len(OPEN + CLOSE + END)} + length(role) + length(text) + {" + ".join(_count(x) for x in [chr(92), *CONTROLS])}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
