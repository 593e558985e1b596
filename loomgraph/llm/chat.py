r"""Chat formatting by columnar byte assembly.

Each turn becomes ``<|turn|>role\ntext<|end|>\n``.  For a batch of turns the
lengths of all segments (header, text, footer) are known from Arrow's offsets;
their running sum places every segment in one preallocated buffer, and numpy
scatters header and text bytes there.  The buffer becomes the Arrow column
without another copy.

Control strings inside a role or text are escaped reversibly: a backslash goes
after the first character of ``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``<<SYS>>`` and ``<</SYS>>``, and one more where backslashes already stand there.

A conversation is one row, unless it has over ``part_turns`` turn numbers or
very many rows: then it comes in chunks, in the order of ``(part, seq)``, which
concatenate to the whole.  So no task must hold a conversation of any size.
``whole_conversations`` puts chunks together where one row each is wanted.

Edge cases: null texts and roles count as empty; null conversation IDs form one
conversation; equal turn numbers are ordered by role and text, and repeated rows
all stay; empty tables give no rows; extra columns are ignored.
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

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
# What follows the first character of a control string.
_TAILS = r"(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
_ESCAPE = r"([<\[])(\\*)" + _TAILS
_UNESCAPE = re.compile(r"([<\[])(\\*)\\" + _TAILS)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.DOTALL)
CARRY, SLICE_BYTES = 4096, 1 << 24


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=_ESCAPE, replacement=r"\1\2\\\3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    return escape(pa.array([role.replace("\\", "\\\\").replace("\n", "\\n")]))[0].as_py()


def _read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (from 0) and the bytes of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return offsets - offsets[0], data


def _scatter(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copy segment i of ``data`` to position ``at[i]``, some bytes at a time."""
    lengths = np.diff(offsets)
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        if j == i + 1:  # a single segment, maybe a very long one
            out[at[i] : at[i] + lengths[i]] = data[offsets[i] : offsets[j]]
        else:
            shift = np.repeat(at[i:j] - offsets[i:j], lengths[i:j])
            out[np.arange(offsets[i], offsets[j]) + shift] = data[offsets[i] : offsets[j]]
        i = j


def assemble(roles: pa.Array, texts: pa.Array, firsts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted text of each group of turns, and each turn's content span.

    ``firsts``: the first turn of each group.  Spans are code points from the start of the turn's group.
    """
    roles = roles.dictionary_encode()
    heads = [(OPEN + _role(r) + "\n").encode("utf-8", "surrogatepass") for r in roles.dictionary.to_pylist()]
    code = roles.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    contents = escape(texts)
    offsets, data = _bytes(contents)
    head_len = np.array([len(h) for h in heads], np.int64)[code]
    foot = np.frombuffer(CLOSE.encode(), np.uint8)
    ends = np.cumsum(head_len + np.diff(offsets) + len(foot))
    starts = ends - (head_len + np.diff(offsets) + len(foot))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int64)
    for c in range(len(heads)):  # one header text for each distinct role
        where = starts[code == c]
        out[where[:, None] + np.arange(len(heads[c]))[None, :]] = head_bytes[head_at[c] : head_at[c + 1]]
    _scatter(out, starts + head_len, offsets, data)
    out[(ends - len(foot))[:, None] + np.arange(len(foot))[None, :]] = foot
    bounds = np.append(starts[firsts], ends[-1] if len(ends) else 0)
    formatted = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    head_chars = np.array([len(h.decode("utf-8", "surrogatepass")) for h in heads], np.int64)[code]
    chars = pc.utf8_length(contents).to_numpy(zero_copy_only=False).astype(np.int64)
    char_ends = np.cumsum(head_chars + chars + len(CLOSE))
    group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(code))))
    base = (char_ends - (head_chars + chars + len(CLOSE)))[firsts][group] if len(firsts) else np.empty(0, np.int64)
    stop = char_ends - len(CLOSE) - base
    return formatted, stop - chars, stop


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", part_turns: int = 2048) -> DataFrame:
    """Rows (conv, part, seq, formatted, n_turns, loss_starts, loss_ends).

    The loss spans are code points of ``formatted``: the contents of ``loss_role``'s turns.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv_type = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.coalesce(F.floor(F.col(f"`{turn_col}`") / part_turns), F.lit(0)).cast("long").alias("part"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "turn", "role", "text").drop("turn")

    def emit(rows: pa.Table, seq: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        conv, part = rows.column("conv"), rows.column("part")
        changed = np.ones(len(rows), bool)
        if len(rows) > 1:
            same = pc.and_(pc.fill_null(pc.equal(conv[1:], conv[:-1]), False), pc.equal(part[1:], part[:-1]))
            both_null = pc.and_(pc.and_(pc.is_null(conv[1:]), pc.is_null(conv[:-1])), pc.equal(part[1:], part[:-1]))
            changed[1:] = ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(changed)
        one = lambda c: pa.concat_arrays(rows.column(c).chunks) if rows.column(c).num_chunks != 1 else rows.column(c).chunk(0)
        role = one("role")
        formatted, starts, stops = assemble(role, one("text"), firsts)
        learnt = pc.equal(role, loss_role).to_numpy(zero_copy_only=False)
        per_group = np.add.reduceat(learnt.astype(np.int64), firsts)
        offsets = pa.array(np.concatenate(([0], np.cumsum(per_group))).astype(np.int32))
        span = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x[learnt]))
        return pa.RecordBatch.from_arrays(
            [one("conv").take(pa.array(firsts)), one("part").take(pa.array(firsts)), pa.array(np.arange(seq, seq + len(firsts))), formatted.cast(pa.string()), pa.array(np.diff(np.append(firsts, len(rows)))), span(starts), span(stops)],
            names=["conv", "part", "seq", "formatted", "n_turns", "loss_starts", "loss_ends"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        seq = 0
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(whole):
                continue
            last = (whole.column("conv")[-1].as_py(), whole.column("part")[-1].as_py())
            keep = 0
            while keep < min(len(whole), CARRY) and (whole.column("conv")[len(whole) - 1 - keep].as_py(), whole.column("part")[len(whole) - 1 - keep].as_py()) == last:
                keep += 1
            if keep >= CARRY:
                keep = 0  # too many rows to wait for the rest: they become a chunk
            held = whole.slice(len(whole) - keep)
            if len(whole) > keep:
                out = emit(whole.slice(0, len(whole) - keep), seq)
                seq += len(out)
                yield out
        if held is not None and len(held):
            yield emit(held, seq)

    return dealt.mapInArrow(run, f"conv {conv_type}, part long, seq long, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted chunk; raises if it isn't one."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside a turn")
        turns.append((_read_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return turns


def whole_conversations(formatted: DataFrame) -> DataFrame:
    """Rows (conv, formatted, n_turns, loss_starts, loss_ends), one for each conversation, with spans in the whole text.

    A conversation must fit in one row, so in 2 GB.
    """
    chunk = F.struct("part", "seq", "formatted", "n_turns", "loss_starts", "loss_ends")
    sizes = F.transform("c", lambda x: F.char_length(x["formatted"]).cast("long"))
    before = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0).cast("long"), lambda a, v: a + v)
    spans = lambda name: F.flatten(F.transform("c", lambda x, i: F.transform(x[name], lambda at: at + before(i))))
    rows = formatted.groupBy("conv").agg(F.sort_array(F.collect_list(chunk)).alias("c")).withColumn("sizes", sizes)
    return rows.select(
        "conv", F.array_join(F.transform("c", lambda x: x["formatted"]), "").alias("formatted"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n_turns"]).alias("n_turns"),
        spans("loss_starts").alias("loss_starts"), spans("loss_ends").alias("loss_ends"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Rows (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from the formatted chunks."""
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv_type = formatted.schema["conv"].dataType.simpleString()
    dealt = formatted.select("conv", "part", "seq", "formatted", "loss_starts", "loss_ends").repartition(n, "conv").sortWithinPartitions("conv", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        state: list | None = None

        def row(s: list) -> dict:
            return {"conv": s[0], "n_turns": s[1], "turns_sha256": s[2].hexdigest(), "loss_chars": s[3], "loss_sha256": s[4].hexdigest(), "formatted_chars": s[5]}

        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field("conv").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            done = []
            for r in batch.to_pylist():
                if state is None or state[0] != r["conv"]:
                    if state is not None:
                        done.append(row(state))
                    state = [r["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["formatted"]
                for role, said in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True):
                    said = unescape(text[a:b])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(state)], schema=schema)

    return dealt.mapInArrow(run, f"conv {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
