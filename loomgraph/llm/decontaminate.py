r"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Words are maximal runs without white space and ASCII punctuation, in lower
case.  A document and an item are a pair when the best score of their local
alignment (Smith-Waterman: match 1, other word -1, gap -1) is at least ``limit``
times the item's words, so copies with replaced, dropped or added words count, and
shared phrases do not.  No such pair is missed by the seeds: an alignment of score s
with m equal words in k runs has k - 1 edits at least, so s <= m - k + 1, and m - k
neighbouring word pairs of the item are intact in it, s - 1 at least.  Of an item's w
word pairs, at most w - (s - 1) can be broken; the w - (s - 1) + ``least`` rarest are
its seeds, and a document that holds fewer than ``least`` of them is no pair.  How
rare a word pair is, is counted over all texts.  Windows of a document that pass a bounded bit filter of
the seeds are possible hits; a join with the seeds settles which are.  The regions of
a document around an item's seeds are aligned with it.

Texts are shuffled only if a second filter says that they may have a seed.  Nothing
but the filters (of bounded size) goes to all tasks; a benchmark of many million word
pairs fills them and makes more rows pass to the joins, never another result.  The hits
of a word pair that many texts hold are plain rows of a join of two staged tables, of
which Spark splits the longer side.

Edge cases: null texts have no words; items of one or two words are found where they
stand whole (half of two words is any text with one of them); documents with equal identifiers and different texts are
looked at one by one and reported once for each item, with the best score; repeated
rows are reported once; null identifiers are left out; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release_memory, stage
from .words import PUNCTUATION, SPACE, byte_table, windows, word_hashes

SEPARATORS = SPACE + PUNCTUATION
FILTER_BITS, FILTER_MOST = 1 << 22, 1 << 27
SIZE = 2  # words of a seed; the bound on intact windows above holds for two
_FOLD = byte_table(SEPARATORS)


def fold(text: str) -> list[bytes]:
    """The words of a text as they are compared."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _window_hashes(texts: list[str | None], single: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of some texts: number of the text, hash and word position.

    Single words are windows, too: "all", those that are a "whole" text, or "no" one.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    words, bounds = word_hashes(raw, SEPARATORS)
    text = np.repeat(np.arange(len(raw)), np.diff(bounds))
    h = windows(words, SIZE)
    k = np.flatnonzero(text[: len(h)] == text[SIZE - 1 :]) if len(h) else np.empty(0, np.int64)
    h = h[k]
    if single != "no":
        one = np.flatnonzero(np.diff(bounds)[text] == 1) if single == "whole" else np.arange(len(words))
        k, h = np.concatenate((k, one)), np.concatenate((h, windows(words[one], 1)))
    return text[k], h, k - bounds[text[k]]


def _windows(bits: np.ndarray | None, single: str):
    """Rows (id, part, h, pos) of the windows of each text (id, text, part) that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for at in range(0, len(batch), 512):
                b = batch.slice(at, 512)
                text, h, pos = _window_hashes(b.column(1).to_pylist(), single)
                k = np.flatnonzero(passes(h, bits)) if bits is not None else np.arange(len(h))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[k])), b.column(2).take(pa.array(text[k])), pa.array(h[k].view(np.int64)), pa.array(pos[k].astype(np.int32))], names=["id", "part", "h", "pos"])

    return run


def _window_counts(bits: np.ndarray, single: str):
    """Rows (h, n): how often each window that passes the filter occurs in some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for at in range(0, len(batch), 512):
                _, h, _ = _window_hashes(batch.column(0).slice(at, 512).to_pylist(), single)
                values, n = np.unique(h[passes(h, bits)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def bit_filter(rows: DataFrame) -> np.ndarray:
    """A bit for each value of the column ``h`` of a staged table; built by an aggregate of 32,768-bit pieces.

    Sixteen bits or more a row, between ``FILTER_BITS`` (512 KB) and ``FILTER_MOST`` (16 MB); a table
    of over eight million rows fills it, so that more passes and is dropped by the join that follows.
    """
    size = min(FILTER_MOST, max(FILTER_BITS, 1 << (16 * rows.count()).bit_length()))
    bit = F.col("h").bitwiseAND(size - 1)  # a power of two, so the same bits as of the unsigned number
    pieces = rows.select(bit.alias("b")).groupBy(F.expr("b div 32768").alias("n")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in pieces.collect():  # at most FILTER_MOST / 32768 rows of 4 KB
        out[r.n * 4096 : r.n * 4096 + 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    p = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[p >> 3] >> (p & 7) & 1).astype(bool)


def _passing(bits: np.ndarray):
    """Rows whose last column, a hash, passes a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64), bits)))

    return run


def needed(n_words: int, limit: float) -> int:
    """The least score that is ``limit`` times an item's words."""
    return math.ceil(limit * n_words)


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word-number arrays, and the region's span (begin, end) of it."""
    n = len(region)
    steps = np.arange(n + 1)
    score, begin = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for w in item:
        diag = score[:-1] + np.where(region == w, 1, -1)
        up = score[1:] - 1
        new = np.zeros(n + 1, np.int64)
        new_begin = steps.copy()
        take_up = up > diag
        top = np.where(take_up, up, diag)
        live = top > 0
        new[1:][live] = top[live]
        new_begin[1:][live] = np.where(take_up, begin[1:], begin[:-1])[live]
        lifted = new + steps  # gaps along the region: best of new[k] - (j - k)
        high = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == high, steps, 0))
        score = np.maximum(high - steps, 0)
        begin = np.where(score > 0, new_begin[source], steps)
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(begin[j]), j)
    return best


def _regions(shifts: list[int], length: int, reach: int, n_words: int) -> Iterator[tuple[int, int]]:
    """Spans of the document around seeds (document's less item's position): the item and ``reach`` gaps to each side, joined where they meet."""
    spans = sorted((max(0, d - reach), min(n_words, d + length + reach + 1)) for d in shifts)
    a, b = spans[0]
    for c, d in spans[1:]:
        if c > b:
            yield a, b
            a, b = c, d
        else:
            b = max(b, d)
    yield a, b


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = 2, limit: float = 0.5) -> DataFrame:
    """Rows (id, item, score, words, start, end): documents that hold a copy of a test item.

    ``score`` is the best alignment's, of at most ``words``; start and end are word positions in the document.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).filter("id is not null").withColumn("part", F.xxhash64("text"))
    tests = items.select(F.col(f"`{item_col}`").alias("id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("text")).filter("id is not null").distinct().withColumn("part", F.xxhash64("text"))
    of_items = stage(tests.mapInArrow(_windows(None, "whole"), f"id {item_type}, part long, h long, pos int"), "leak-items")
    lone = of_items.groupBy("id", "part").count().filter("count = 1")  # items of one or two words
    single = "no" if lone.isEmpty() else "all"
    counts = texts.select("text").mapInArrow(_window_counts(bit_filter(of_items), single), "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))

    def seeds(key: tuple, t: pa.Table) -> pa.Table:
        n = len(t)
        intact = max(1, needed(n + SIZE - 1, limit) - 1)
        asks = min(least, intact)
        order = np.lexsort((t.column("pos").to_numpy(), t.column("df").to_numpy()))[: n - intact + asks]
        return t.select(["id", "part", "h", "pos"]).take(pa.array(order)).append_column("asks", pa.array(np.full(len(order), asks, np.int32)))

    rare = of_items.join(counts, "h", "left").select("id", "part", "h", "pos", F.coalesce("df", F.lit(0)).alias("df")).groupBy("id", "part").applyInArrow(seeds, f"id {item_type}, part long, h long, pos int, asks int")
    rare = stage(rare.select(F.col("id").alias("item"), F.col("part").alias("item_part"), "h", F.col("pos").alias("item_pos"), "asks"), "leak-seeds")
    hits = stage(texts.select("id", "text", "part").mapInArrow(_windows(bit_filter(rare), single), f"id {id_type}, part long, h long, pos int"), "leak-hits")
    held = hits.join(rare, "h").groupBy("id", "part", "item", "item_part").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("shifts"), F.collect_set("item_pos").alias("at"), F.first("asks").alias("asks"))
    pairs = held.filter(F.size("at") >= F.col("asks")).drop("at", "asks")
    tests_by = stage(tests.select(F.col("id").alias("item"), F.col("part").alias("item_part"), F.col("text").alias("item_text")), "leak-tests")
    asked = pairs.join(tests_by, ["item", "item_part"]).groupBy("id", "part").agg(F.collect_list(F.struct("item", "item_text", "shifts")).alias("asked"))  # at most the items that a text shares seeds with
    asked = stage(asked, "leak-pairs")
    # Only texts that can be asked for are shuffled, and by the same plan at every size.
    wanted = bit_filter(asked.select(F.xxhash64("id", "part").alias("h")))
    held = texts.withColumn("h", F.xxhash64("id", "part")).mapInArrow(_passing(wanted), f"id {id_type}, text string, part long, h long")
    rows = held.join(asked.hint("merge"), ["id", "part"]).select("id", "text", "asked")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for i in range(len(batch)):
                words = fold(batch.column(1)[i].as_py())
                for ask in batch.column(2)[i].as_py():
                    test = fold(ask["item_text"])
                    number = {w: k for k, w in enumerate(dict.fromkeys(test))}
                    item = np.array([number[w] for w in test])
                    best = (0, 0, 0)
                    for a, b in _regions(ask["shifts"], len(test), len(test) - needed(len(test), limit), len(words)):
                        region = np.array([number.get(w, -1) for w in words[a:b]])
                        if np.count_nonzero(region >= 0) < limit * len(test):
                            continue  # fewer equal words than the score needs
                        s, x, y = align(item, region)
                        if s > best[0]:
                            best = (s, a + x, a + y)
                    if best[0] >= limit * len(test):
                        out.append({"id": batch.column(0)[i].as_py(), "item": ask["item"], "score": best[0], "words": len(test), "start": best[1], "end": best[2]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("id", batch.schema.field(0).type), ("item", batch.schema.field(2).type.value_type.field(0).type), ("score", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    scored = rows.mapInArrow(score, f"id {id_type}, item {item_type}, score long, words long, start long, end long")
    return scored.groupBy("id", "item").agg(F.max(F.struct("score", "words", "start", "end")).alias("x")).select("id", "item", "x.*")
