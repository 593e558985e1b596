r"""Exact repeats of ``length`` bytes by a distributed sort of sampled suffixes.

Every byte that a ``length``-byte string covers which starts anywhere else, too, is
removed.  Sorting all suffixes would move ``length`` bytes for each byte of text, so
suffixes are sampled: of every ``length`` consecutive bytes, the ``gram``-byte
string with the smallest hash is an anchor.  Equal strings have equal anchors at
equal places, so no repeat is missed.

1. Anchors' hashes are dealt out by range; those that occur once are dropped.
2. For each other anchor, its suffix (``length`` bytes) and the bytes before it go to
   a bucket of its gram.  Each task sorts what it has for a bucket, by suffix and by the
   reversed bytes before, and sends both orders as front-coded runs: the common prefix
   with the string before, and the rest.  Anchors with equal bytes on both sides in one
   task repeat each other wherever they may; their spans are known there, and one of
   them goes on for all.
3. The bucket's task merges both kinds of runs with loser trees whose nodes know how much
   each candidate shares with the last winner: a candidate that shares more is
   smaller, and only on a tie are bytes compared, from that place on.  The merge
   yields the sorted strings with their common prefixes.
4. The string of ``length`` bytes with ``a`` bytes before the anchor is repeated if
   another occurrence is in the same class of suffixes by their first ``length - a``
   bytes (runs of the sorted order) and in the same class by the last ``a`` bytes
   before (runs of the order of reversed prefixes).  All ``a`` are tried, one after the other.

Equal texts are one class from the start: all of a repeated text is removed, and one
of its copies stands for it in the search, so a group of copies costs its size.  Texts
have 64-bit names, which a second hash of 64 bits checks: names of different texts are
drawn anew.

Buckets grow in number with the input, without a top.  A gram that different texts hold
in different surroundings is one bucket's, at some 400 bytes an occurrence.

Edge cases: null texts are empty; texts shorter than ``length`` keep all their bytes;
matches never cross texts; repeated rows and rows with equal or null identifiers are texts
like any other; identifiers may have any type; texts of any length are cut into their
anchors' surroundings; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import _passing, bit_filter
from .scratch import release_memory, stage
from .words import mix

_U = np.uint64
FLUSH_BYTES = 48 << 20
_RUN = ("keys", "places", "shared", "sizes", "rest", "by_left", "left_shared", "left_sizes", "left_rest", "told")


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
    up, down = np.full(length, base, np.uint64), np.full(length, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return values, np.cumprod(up), np.cumprod(down)


def _gram_hashes(data: np.ndarray, gram: int, block: int = 1 << 18) -> np.ndarray:
    """A hash of the ``gram`` bytes at each position."""
    n = len(data) - gram + 1
    out = np.empty(max(n, 0), np.uint64)
    values, up, down = _powers(block + gram)
    for a in range(0, n, block):
        b = min(n, a + block)
        part = data[a : b + gram - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[part] * up[: len(part)])))
        out[a:b] = (sums[gram:] - sums[:-gram]) * down[: b - a]
    return mix(out)


def _sliding(x: np.ndarray, width: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """Minimum or maximum over each window, by running values from both ends of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, fill, np.uint64))).reshape(-1, width)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    behind = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of one text."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    width = length - gram + 1
    h = _gram_hashes(data, gram)
    least = _sliding(h, width, np.minimum, (1 << 64) - 1)
    # A position is an anchor if a window that holds it has its hash as the minimum; no minimum there is larger.
    ends = np.zeros(width - 1, np.uint64)
    top = _sliding(np.concatenate((ends, least, ends)), width, np.maximum, 0)
    at = np.flatnonzero(top == h)
    return at, h[at]


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]


def _deal_anchors(length: int, gram: int, bits: int):
    """Rows (bucket, toks, keys, counts, places) of anchors, one text of a key from each task."""
    schema = pa.schema([("bucket", pa.int32()), ("toks", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        pack = zstandard.ZstdCompressor(level=1)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        met: set[int] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            rows: dict[str, list] = {k: [] for k in schema.names}
            if found:
                h = mix(~np.concatenate([x[2] for x in found]))  # anchors have small hashes; these are spread evenly
                at = np.concatenate([x[1] for x in found])
                owner = np.repeat(np.arange(len(found)), [len(x[1]) for x in found])
                names = np.array([x[0] for x in found], np.int64)
                bucket = (h >> _U(64 - bits)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                bucket, short, at, owner = bucket[order], (h >> _U(32 - bits)).astype(np.uint32)[order], at[order], owner[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] ^ 1, append=bucket[-1] ^ 1)) if len(bucket) else bucket
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    firsts = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                    many = np.diff(np.append(firsts, b - a)).astype(np.uint32)
                    for k, v in zip(schema.names, (int(bucket[a]), short[a:b].tobytes(), names[owner[a:b][firsts]].tobytes(), pack.compress(many.tobytes()), pack.compress(at[a:b].astype(np.int64).tobytes())), strict=True):
                        rows[k].append(v)
            found.clear()
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for batch in batches:
            for i in range(0, len(batch), 128):
                part = batch.slice(i, 128)
                for key, text in zip(part.column(0).to_pylist(), _raw(part), strict=True):
                    if len(text) >= length and key not in met:
                        if len(met) < 2_000_000:
                            met.add(key)
                        at, h = anchors(np.frombuffer(text, np.uint8), length, gram)
                        found.append((key, at, h))
                        held += len(at)
                if held > max(2_000_000, 1 << bits):
                    held = 0
                    yield flush()
        yield flush()

    return run


_PLACES = pa.schema([("key", pa.int64()), ("places", pa.binary())])


def _blobs(order_keys: np.ndarray, values: np.ndarray) -> pa.Table:
    """One row a key, with its values (rows of 8-byte numbers) as a blob; keys come sorted."""
    firsts = np.flatnonzero(np.concatenate(([True], order_keys[1:] != order_keys[:-1]))) if len(order_keys) else np.empty(0, np.int64)
    width = 8 * (values.shape[1] if values.ndim > 1 else 1)
    ends = (np.append(firsts, len(order_keys)) * width).astype(np.int32)
    blob = pa.BinaryArray.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
    return pa.table([pa.array(order_keys[firsts]), blob], schema=_PLACES)


def _shared_anchors(t: pa.Table) -> pa.Table:
    """One range: for each key the places of its anchors that occur twice or more."""
    cols = [t.column(c).to_pylist() for c in ("toks", "keys", "counts", "places")]
    toks = np.concatenate([np.frombuffer(x, np.uint32) for x in cols[0]])
    keys = np.concatenate([np.repeat(np.frombuffer(k, np.int64), np.frombuffer(zstandard.decompress(n), np.uint32)) for k, n in zip(cols[1], cols[2], strict=True)])
    at = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64) for x in cols[3]])
    order = np.lexsort((at, keys, toks))
    toks, keys, at = toks[order], keys[order], at[order]
    once = np.concatenate(([True], (toks[1:] != toks[:-1]) | (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])))
    toks, keys, at = toks[once], keys[once], at[once]
    same = toks[1:] == toks[:-1]
    many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    keys, at = keys[many], at[many]
    order = np.argsort(keys, kind="stable")
    return _blobs(keys[order], at[order])


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes two strings share, of which ``at`` are known."""
    top = min(len(a), len(b))
    while at + 16 <= top and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < top and a[at] == b[at]:
        at += 1
    return at


def front_code(sorted_suffixes: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The common prefix of each with the one before, and the rest of each."""
    shared = np.zeros(len(sorted_suffixes), np.uint16)
    rest = []
    last = b""
    for i, s in enumerate(sorted_suffixes):
        n = _common(last, s, 0)
        shared[i] = n
        rest.append(s[n:])
        last = s
    return shared, rest


def merge_runs(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """Merge sorted runs of (string, common prefix with the run's string before, payload).

    A loser tree; a candidate is [string, common prefix with the last winner, payload,
    run].  A larger common prefix means a smaller string.  Of equal prefixes the
    strings are compared from there on, and the loser keeps what it shares with its winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    done = None
    tree: list[list | None] = [done] * k

    def play(a: list | None, b: list | None) -> tuple[list | None, list | None]:
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        x, y = a[0], b[0]
        n = _common(x, y, a[1])
        a_first = n == len(x) or (n < len(y) and x[n] < y[n])
        if a_first:
            b[1] = n
            return a, b
        a[1] = n
        return b, a

    def take(i: int) -> list | None:
        if i >= len(runs):
            return None
        got = next(runs[i], None)
        return None if got is None else [got[0], got[1], got[2], i]

    def build(node: int) -> list | None:
        if node >= k:
            first = take(node - k)
            if first is not None:
                first[1] = 0
            return first
        winner, loser = play(build(2 * node), build(2 * node + 1))
        tree[node] = loser
        return winner

    top = build(1) if k > 1 else take(0)
    if k == 1 and top is not None:
        top[1] = 0
    while top is not None:
        yield top[0], top[1], top[2]
        i = top[3]
        new = take(i)
        node = (k + i) // 2
        while node:
            new, tree[node] = play(new, tree[node])
            node //= 2
        top = new


def whole_span(place: int, left: int, right: int, length: int, gram: int) -> tuple[int, int] | None:
    """What all strings of ``length`` bytes cover that hold an anchor's gram and lie inside its surroundings."""
    low, high = max(0, length - right), min(length - gram, left)
    return (place - high, place - low + length) if low <= high else None


def _deal_suffixes(length: int, gram: int, bits: int):
    """For each text and its shared anchors: rows (bucket, run) with two sorted, front-coded orders, and spans that are known already."""
    before = length - gram
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in _RUN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        piles: dict[int, list[tuple[bytes, bytes, int, int]]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows: dict[str, list] = {k: [] for k in schema.names}
            for bucket, pile in piles.items():
                pile.sort()
                kept, told, i = [], [], 0
                while i < len(pile):
                    j = i + 1
                    while j < len(pile) and pile[j][0] == pile[i][0] and pile[j][1] == pile[i][1]:
                        j += 1
                    if j > i + 1:
                        for right, left, key, place in pile[i:j]:
                            span = whole_span(place, len(left), len(right), length, gram)
                            if span:
                                told.append((key, *span))
                    kept.append(pile[i])
                    i = j
                by_left = sorted(range(len(kept)), key=lambda i, kept=kept: kept[i][1])
                shared, rest = front_code([x[0] for x in kept])
                left_shared, left_rest = front_code([kept[i][1] for i in by_left])
                sizes = lambda parts: np.array([len(x) for x in parts], np.uint16).tobytes()
                values = (
                    bucket, len(kept), np.array([x[2] for x in kept], np.int64).tobytes(), np.array([x[3] for x in kept], np.int64).tobytes(), shared.tobytes(), sizes(rest), b"".join(rest),
                    np.array(by_left, np.uint32).tobytes(), left_shared.tobytes(), sizes(left_rest), b"".join(left_rest), np.array(told, np.int64).tobytes(),
                )
                for k, v in zip(schema.names, values, strict=True):
                    rows[k].append(pack.compress(v) if isinstance(v, bytes) else v)
            piles.clear()
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        seen = None
        for batch in batches:
            texts = _raw(batch)
            for key, text, places in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                if key == seen:
                    continue  # copies of a text; rows come sorted by key
                seen = key
                at = np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in places]))
                for p in at.tolist():
                    right = text[p : p + length]
                    bucket = hash_bytes(right[:gram]) >> (64 - bits)
                    piles.setdefault(bucket, []).append((right, text[max(0, p - before) : p][::-1], key, p))
                    held += 2 * length
                if held > FLUSH_BYTES:
                    held = 0
                    yield flush()
        yield flush()

    return run


def hash_bytes(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _read_run(shared: bytes, sizes: bytes, rest: bytes, numbers: list[int]) -> Iterator[tuple[bytes, int, int]]:
    last, at = b"", 0
    for n, size, i in zip(np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(sizes, np.uint16).tolist(), numbers, strict=True):
        last = last[:n] + rest[at : at + size]
        at += size
        yield last, n, i


def _merged(runs: list[Iterator[tuple[bytes, int, int]]], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The occurrences in sorted order, what each shares with the one before, and (by occurrence) the lengths."""
    order, lcp, size = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total, np.int32)
    for i, (s, n, who) in enumerate(merge_runs(runs)):
        order[i], lcp[i], size[who] = who, n, len(s)
    return order, lcp, size


def _repeats(length: int, gram: int):
    """One bucket: the spans of each key that repeated strings cover."""

    def run(t: pa.Table) -> pa.Table:
        unpack = zstandard.decompress
        keys, places, rights, lefts, told = [], [], [], [], []
        total = 0
        for r in t.to_pylist():
            x = {c: unpack(r[c]) for c in _RUN}
            keys.append(np.frombuffer(x["keys"], np.int64))
            places.append(np.frombuffer(x["places"], np.int64))
            told.append(np.frombuffer(x["told"], np.int64).reshape(-1, 3))
            rights.append(_read_run(x["shared"], x["sizes"], x["rest"], list(range(total, total + r["n"]))))
            lefts.append(_read_run(x["left_shared"], x["left_sizes"], x["left_rest"], (np.frombuffer(x["by_left"], np.uint32).astype(np.int64) + total).tolist()))
            total += r["n"]
        if not total:
            return _PLACES.empty_table()
        key, at = np.concatenate(keys), np.concatenate(places)
        right_order, right_lcp, right_len = _merged(rights, total)
        left_order, left_lcp, left_len = _merged(lefts, total)
        # One text may come from several tasks, if a join was split; an occurrence is no repeat of itself.
        order = np.lexsort((at, key))
        own = np.ones(total, bool)
        own[order[1:][(key[order][1:] == key[order][:-1]) & (at[order][1:] == at[order][:-1])]] = False
        right_class, left_class = np.empty(total, np.int64), np.empty(total, np.int64)
        before, opened = np.zeros(total, bool), np.zeros(total, np.int64)
        found = [np.concatenate(told)]

        def close(ended: np.ndarray, a: int) -> None:
            """Strings with opened[i] to a - 1 bytes before occurrence i are repeated."""
            found.append(np.column_stack((key[ended], at[ended] - a + 1, at[ended] - opened[ended] + length)))

        for a in range(length - gram + 1):
            hit = np.zeros(total, bool)
            valid = np.flatnonzero(own & (left_len >= a) & (right_len >= length - a))
            if len(valid) > 1:
                right_class[right_order] = np.cumsum(right_lcp < length - a)
                left_class[left_order] = np.cumsum(left_lcp < a)
                both = right_class[valid] * (total + 1) + left_class[valid]
                order = np.argsort(both, kind="stable")
                same = both[order][1:] == both[order][:-1]
                hit[valid[order[1:][same]]] = True
                hit[valid[order[:-1][same]]] = True
            opened[hit & ~before] = a
            close(np.flatnonzero(before & ~hit), a)
            before = hit
        close(np.flatnonzero(before), length - gram + 1)
        spans = np.concatenate(found)
        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
        return _blobs(spans[:, 0], spans[:, 1:])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256, kept) of texts and the spans to remove."""
    for batch in batches:
        out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in spans])
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            far = np.maximum.accumulate(pairs[:, 1])
            new = np.concatenate(([True], pairs[1:, 0] > far[:-1]))
            begins, ends = pairs[new, 0], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]
            sha = hashlib.sha256()
            last = 0
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                sha.update(raw[last:a])
                last = b
            sha.update(raw[last:])
            out["n_removed"].append(int((ends - begins).sum()))
            out["n_spans"].append(len(begins))
            out["kept_sha256"].append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(texts: DataFrame, *, length: int = 200, gram: int = 40, range_bytes: int = 1 << 24) -> DataFrame:
    """Rows (key, places): spans (begin, end as 8-byte numbers, several blobs a key) that repeats in other texts or elsewhere in the text cover.

    ``texts`` has a key (long) and a text; rows with equal keys have equal texts, of which one counts.
    """
    spark = texts.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    bits = max(4, int(total // range_bytes).bit_length())
    dealt = texts.select("key", "text").mapInArrow(_deal_anchors(length, gram, bits), "bucket int, toks binary, keys binary, counts binary, places binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared_anchors, "key long, places binary").groupBy("key").agg(F.collect_list("places").alias("places"))
    shared = stage(shared, "suffix-anchors")
    wanted = bit_filter(shared.select(F.xxhash64("key").alias("h")))
    once = texts.select("key", "text", F.xxhash64("key").alias("h")).mapInArrow(_passing(wanted), "key long, text string, h long").mapInArrow(_first_of_task, "key long, text string, h long")
    found = once.join(shared.hint("merge"), "key").select("key", "text", "places").sortWithinPartitions("key")
    runs = found.mapInArrow(_deal_suffixes(length, gram, bits), "bucket int, n int, " + ", ".join(f"{c} binary" for c in _RUN))
    return stage(runs.groupBy("bucket").applyInArrow(_repeats(length, gram), "key long, places binary").groupBy("key").agg(F.collect_list("places").alias("places")), "suffix-spans")


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a key from each task (as far as a bounded set can tell; the rest only costs time)."""
    met: set[int] = set()
    for batch in batches:
        keep = []
        for k in batch.column(0).to_pylist():
            keep.append(k not in met)
            if len(met) < 2_000_000:
                met.add(k)
        yield batch.filter(pa.array(keep, pa.bool_()))


def text_names(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text: its name, and what tells texts of one name apart (and is their name then)."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 40) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept_sha256), one for each document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    name, check = text_names(F.col("text"))
    renamed: set[int] = set()
    while True:
        rows = texts.withColumn("key", F.when(name.isin(*renamed), check).otherwise(name) if renamed else name)
        copies = stage(
            rows.select("key", check.alias("chk"), (F.octet_length("text") >= length).alias("long")).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("chk").alias("lo"), F.max("chk").alias("hi"), F.max("long").alias("long")).filter("copies > 1"),
            "suffix-copies",
        )
        twice = copies.filter("lo != hi").select("key").collect()  # names of several texts: some n^2 / 2^65
        if not twice:
            break
        renamed |= {r.key for r in twice}
    copies = copies.filter("long").select("key", F.lit(True).alias("whole"))
    spans = repeated_spans(rows.select("key", "text"), length=length, gram=gram)

    # Of repeated texts all goes, so that no group of copies meets at its key.
    spans = stage(spans.join(copies, "key", "left_anti"), "suffix-cuts")
    # A text travels only if spans are cut from it; the others need its digest alone.
    wanted = bit_filter(spans.select(F.xxhash64("key").alias("h")))
    hashed = rows.withColumn("h", F.xxhash64("key"))
    plain = hashed.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    flags = copies.join(spans.select("key", F.lit(True).alias("cut")), "key", "full")
    known = plain.join(flags, "key", "left")
    uncut = known.filter("whole or cut is null").select(
        "id", "n_bytes", F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("whole"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"), F.when(F.col("whole"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.col("sha")).alias("kept_sha256")
    )
    texts = hashed.select("id", "text", "key", "h").mapInArrow(_passing(wanted), f"id {id_type}, text string, key long, h long")
    cut = texts.join(spans.hint("merge"), "key").select("id", "text", "places", F.octet_length("text").cast("long").alias("n_bytes"))
    return uncut.unionByName(cut.mapInArrow(_cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
