r"""Class-based bigram language model: exchange clustering, then smoothed log probabilities.

Tokens are the words ``[^\x20\x09-\x0D]+`` of a text with A-Z in lower case, then one end.
P(w | v) = P(class of w | class of v) * P(w | class of w), estimated on the training rows.

1. ``encode``: each partition of texts becomes parts of about ``PART`` tokens: numbers of
   words, and the part's words.  Texts are read once.
2. Counts of all words by one aggregation.  Words that make up at least 1/``CORE`` of all
   tokens are the core; by that rule there are at most ``CORE`` of them, at any size of the
   corpus, so they may be broadcast.
3. The exchange: bigrams of core words (all others stand for one rare word) are counted
   over all parts.  In a round every other core word asks which class would gain the most
   likelihood if it moved there alone, exactly, on the executors; the moves are kept if
   together they gain, or else the best of them.
4. Every other word joins, once, the class that gains most by the classes of all its
   neighbours in the corpus.  Its occurrences meet by a sort; none holds more than
   1/``CORE`` of the tokens, so no key is hot.
5. Counts and classes go back to the parts: texts in slices of about ``SLICE`` tokens and
   the words' counts and classes in pieces meet by a sort, pieces first, so a task holds the
   words of one part and a slice.  Class transitions are counted over all training texts,
   and all texts are scored.

Smoothing.  A transition gets ``strength`` counts in proportion to the class's share.  What
is unknown is one type, as in the base: its share after a class is that of words seen once
there (and what follows it, what follows those).  All probabilities after a class sum to 1.

Edge cases: null and empty texts have the end alone; rows are scored one by one, whatever
their identifiers; rows whose training condition is null are scored, not learnt from;
without training rows the unknown type has probability 1; long texts are parts of their
own (below 2^29 tokens each); an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import count as count_from
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import release_memory, stage

PART, CORE, SLICE = 1 << 22, 1 << 16, 1 << 18
#: Neighbours of core words in a partition of the exchange, and rare words that a task holds before it passes them on.
NEAR, HELD = 1 << 20, 1 << 20
RARE_CLASS, END_CLASS = 0, 1
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_END = b""


@contextmanager
def _few_rows(spark: SparkSession, n: int = 1) -> Iterator[None]:
    """Arrow batches of few rows: a part is a row of some megabytes."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(n))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def _ints(cell: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(cell, kind)


def _cells(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows of parts; lists and numbers are arrays that share the batch's memory."""
    kinds = {"codes": np.int32, "counts": np.int64}
    for i in range(len(b)):
        row = {}
        for name in b.schema.names:
            x = b.column(name)[i]
            if name in kinds:
                row[name] = np.frombuffer(x.as_buffer(), kinds[name])
            elif name in ("lengths", "train"):
                row[name] = x.values.to_numpy(zero_copy_only=False)
            else:
                row[name] = x.values if name == "ids" else x.as_py()
        yield row


def _tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values and how often they occur; sorts ``x`` in place."""
    x.sort()
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[first], np.diff(np.append(first, len(x)))


def _binaries(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data``, as binary values."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def encode(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART) -> DataFrame:
    """A row for each part: identifiers, training flags, lengths, word numbers, words and their counts in training rows."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        first = TaskContext.get().partitionId() << 24
        numbers = count_from()
        ids: list[pa.Array] = []
        flags: list[bool] = []
        codes: list[np.ndarray] = []
        known: defaultdict = defaultdict()
        held = 0

        def begin() -> None:
            nonlocal ids, flags, codes, known, held
            ids, flags, codes, held = [], [], [], 0
            known = defaultdict(count_from().__next__)
            known[_END]

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(c) for c in codes], np.int64)
            whole = np.concatenate(codes)
            n = np.bincount(whole[np.repeat(np.array(flags), lengths)], minlength=len(known))
            cells = [pa.array([first + next(numbers)], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(flags)], pa.int32()), a) for a in (pa.concat_arrays(ids), pa.array(flags), pa.array(lengths)))]
            cells += [pa.array([x], pa.binary()) for x in (whole.astype(np.int32).tobytes(), b" ".join(known), n.astype(np.int64).tobytes())]
            return pa.RecordBatch.from_arrays(cells, names=["part", "ids", "train", "lengths", "codes", "words", "counts"])

        begin()
        for b in batches:
            for i, (text, flag) in enumerate(zip(b.column(1), b.column(2).to_pylist(), strict=True)):
                words = text.as_buffer().to_pybytes().lower().split()
                one = np.zeros(len(words) + 1, np.int32)
                one[:-1] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                ids.append(b.column(0).slice(i, 1))
                flags.append(flag)
                codes.append(one)
                held += len(one)
                if held >= part_tokens:
                    yield flush()
                    begin()
        if codes:
            yield flush()

    out = narrow.mapInArrow(run, f"part long, ids array<{kind}>, train array<boolean>, lengths array<long>, codes binary, words binary, counts binary")
    return stage(out, "lm-parts")


def word_counts(parts: DataFrame) -> DataFrame:
    """Rows (word, n) of all words of training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _cells(b):
                w = pa.array(r["words"].split(b" "), pa.binary())
                yield pa.RecordBatch.from_arrays([w, pa.array(r["counts"])], names=["word", "n"]).filter(pa.array(r["counts"] > 0))

    with _few_rows(parts.sparkSession):
        return stage(parts.select("words", "counts").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def _core_numbers(words: bytes, core: dict[bytes, int]) -> np.ndarray:
    own = words.split(b" ")
    return np.fromiter(map(core.get, own, repeat(0)), np.int64, len(own))


def _trained(codes: np.ndarray, lengths: np.ndarray, train: np.ndarray) -> np.ndarray:
    return codes[np.repeat(train, lengths)]


def core_bigrams(parts: DataFrame, core: Callable[[], dict[bytes, int]], width: int) -> DataFrame:
    """Rows (prev, cur, n) over training rows; words outside the core are number 0, each text follows an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _cells(b):
                seq = _core_numbers(r["words"], core())[_trained(r["codes"], r["lengths"], r["train"])]
                pair = np.concatenate(([core()[_END]], seq[:-1]))[: len(seq)]
                pair *= width
                pair += seq
                del seq
                pair, n = _tally(pair)
                for a in range(0, len(pair), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (pair, n)], names=["pair", "n"])

    found = parts.select("train", "lengths", "codes", "words").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    with _few_rows(parts.sparkSession):
        return stage(found.selectExpr(f"cast(pair div {width} as int) prev", f"cast(pair % {width} as int) cur", "n"), "lm-bigrams")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(m: np.ndarray) -> float:
    """The part of the class bigrams' log likelihood that depends on the classes."""
    return float(_f(m).sum() - _f(m.sum(1)).sum() - _f(m.sum(0)).sum())


def move_gains(m: np.ndarray, left: np.ndarray, right: np.ndarray, own: int, self_n: float) -> np.ndarray:
    """For a word of class ``own``, what the objective gains if it moves to each class.

    ``left`` and ``right`` are its counts after and before words of each class, ``self_n`` those beside itself.
    """
    # Marginals without the word: pairs with it stay in other classes' margins, whatever its class.
    out, into = m.sum(1), m.sum(0)
    out[own] -= right.sum()
    into[own] -= left.sum()
    m = m.copy()
    m[:, own] -= left
    m[own, :] -= right
    m[own, own] += self_n
    l, r = left.copy(), right.copy()
    l[own] -= self_n
    r[own] -= self_n
    d = np.arange(len(m))
    before = _f(m)
    cols, rows = _f(m + l[:, None]) - before, _f(m + r[None, :]) - before
    both = _f(m[d, d] + l + r + self_n) - before[d, d]
    to = cols.sum(0) - cols[d, d] + rows.sum(1) - rows[d, d] + both
    to -= _f(out + right.sum()) - _f(out) + _f(into + left.sum()) - _f(into)
    return to - to[own]


def exchange(bigrams: DataFrame, width: int, end: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each core word, the counts of class bigrams, and the objective after each round."""
    spark = bigrams.sparkSession
    both = bigrams.selectExpr("cur w", "0 side", "prev other", "n").unionByName(bigrams.selectExpr("prev w", "1 side", "cur other", "n"))
    # A word has at most 2 * `width` neighbours; a partition is read as one batch, so there are more of them where there are more neighbours.
    pieces = max(1, min(width // 64, 4 * spark.sparkContext.defaultParallelism), min(width, 2 * bigrams.count() // NEAR))
    near = stage(both.groupBy("w").agg(F.collect_list(F.struct("side", "other", "n")).alias("near")).repartition(pieces, "w"), "lm-neighbours")
    cls = np.zeros(width, np.int16)
    if width > 1:
        cls[1:] = 2 + np.arange(width - 1) % (classes - 2)
        cls[end] = END_CLASS

    def fields(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        w = b.column(0).to_numpy()
        flat = b.column(1).flatten()
        side, other, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        return w, np.repeat(np.arange(len(w)), b.column(1).value_lengths().to_numpy()), side, other, n

    def class_bigrams(cls: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros(classes * classes)
            for b in batches:
                w, at, side, other, n = fields(b)
                one = side == 1
                m += np.bincount(cls[w[at[one]]].astype(np.int64) * classes + cls[other[one]], weights=n[one], minlength=classes * classes)
            k = np.flatnonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m[k].astype(np.int64))], names=["k", "n"])

        m = np.zeros(classes * classes)
        for r in near.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # classes^2 at most
            m[r.k] = r.n
        return m.reshape(classes, classes)

    def proposals(cls: np.ndarray, m: np.ndarray, turn: int) -> list[tuple[float, int, int]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w, at, side, other, n = fields(b)
                hist = np.bincount(at * (2 * classes) + side * classes + cls[other], weights=n, minlength=len(w) * 2 * classes).reshape(len(w), 2, classes)
                selves = np.bincount(at, weights=n * ((side == 1) & (other == w[at])), minlength=len(w))
                out = []
                for i in np.flatnonzero((w != 0) & (w != end) & (w % 2 == turn)):
                    g = move_gains(m, hist[i, 0], hist[i, 1], int(cls[w[i]]), selves[i])
                    g[END_CLASS] = -np.inf
                    to = int(g.argmax())
                    if g[to] > 1e-6 and to != cls[w[i]]:
                        out.append((float(g[to]), int(w[i]), to))
                cols = list(zip(*out, strict=True)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["gain", "w", "cls"])

        return sorted((tuple(r) for r in near.mapInArrow(run, "gain double, w int, cls int").collect()), key=lambda r: (-r[0], r[1]))  # the core at most

    m = class_bigrams(cls)
    course = [objective(m)]
    for r in range(rounds):
        moves = proposals(cls, m, r % 2)
        while moves:
            new = cls.copy()
            new[[w for _, w, _ in moves]] = [to for _, _, to in moves]
            then = class_bigrams(new)
            if objective(then) > course[-1]:
                cls, m = new, then
                break
            moves = moves[: len(moves) // 4]
        course.append(objective(m))
        if r and course[-1] <= course[-3]:  # neither half of the words has moved
            break
    return cls, m, course


def rare_words(parts: DataFrame, core: Callable[[], dict[bytes, int]], cls: np.ndarray, m: np.ndarray, classes: int) -> DataFrame:
    """Rows (part, codes, counts, classes): for words outside the core, packed, their counts in all training rows and their classes."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _cells(b):
                numbers = _core_numbers(r["words"], core())
                seq = _trained(r["codes"], r["lengths"], r["train"])
                of = cls.astype(np.uint8)[numbers][seq]
                at = np.flatnonzero((numbers == 0)[seq])  # never an end, so each has a next token
                key = np.concatenate((seq[at], seq[at])).astype(np.int64)
                key *= 2 * classes
                key[: len(at)] += np.where(at > 0, of[at - 1], END_CLASS)
                key[len(at) :] += classes + of[at + 1].astype(np.int64)
                del seq, of, at
                key, n = _tally(key)
                word = key // (2 * classes)
                key %= 2 * classes
                entry = n
                entry <<= 8
                entry |= key
                del key, n
                rare = np.flatnonzero(numbers == 0)
                own, counts = r["words"].split(b" "), r["counts"]
                ends = np.searchsorted(word, rare, "right")
                starts = np.searchsorted(word, rare, "left")
                for a in range(0, len(rare), 50_000):
                    some = slice(a, a + 50_000)
                    codes = rare[some]
                    data = entry[starts[some][0] : ends[some][-1]] if len(codes) else entry[:0]
                    cols = [pa.array([own[c] for c in codes], pa.binary()), pa.array(np.full(len(codes), r["part"])), pa.array(codes.astype(np.int32)), pa.array(counts[codes]), _binaries((ends[some] - starts[some]) * 8, data)]
                    yield pa.RecordBatch.from_arrays(cols, names=["word", "part", "code", "n", "near"])

    # A small change of the objective for each count that a word brings to a class, by the neighbour's class.
    log = lambda x: np.log(x + 0.5)
    table = np.concatenate((log(m) - log(m.sum(0))[None, :], log(m.T) - log(m.sum(1))[None, :]))
    table[:, END_CLASS] = -np.inf

    def settle(t: pa.Table) -> tuple[np.ndarray, ...]:
        """Parts, numbers in them, counts and classes of whole groups of equal words."""
        t = t.combine_chunks()
        words, near = (t[c].chunk(0) for c in ("word", "near"))
        fresh = np.concatenate(([True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)))
        group = np.cumsum(fresh) - 1
        total = np.bincount(group, weights=t["n"].to_numpy()).astype(np.int64)
        lengths = pc.binary_length(near).to_numpy() // 8
        entries = np.frombuffer(b"".join(near.to_pylist()), np.int64)
        x = np.bincount(np.repeat(group, lengths) * (2 * classes) + (entries & 255), weights=entries >> 8, minlength=len(total) * 2 * classes)
        with np.errstate(invalid="ignore"):
            best = np.nan_to_num(x.reshape(-1, 2 * classes) @ table, nan=-np.inf).argmax(1)
        best[total == 0] = classes
        return t["part"].to_numpy(), t["code"].to_numpy(), total[group], best[group].astype(np.uint8)

    def passed_on(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        part, code, n, kind = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(part, kind="stable")
        names, at = np.unique(part[order], return_index=True)
        sizes = np.diff(np.append(at, len(part)))
        return pa.RecordBatch.from_arrays([pa.array(names), _binaries(sizes * 4, code[order]), _binaries(sizes * 8, n[order]), _binaries(sizes, kind[order])], names=["part", "codes", "counts", "classes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        open_: list[pa.RecordBatch] = []  # of the word that the last batch ended with
        held: list[tuple[np.ndarray, ...]] = []  # else each part got a piece of each batch
        for b in batches:
            if not len(b):
                continue
            words = b.column(0)
            change = np.flatnonzero(pc.not_equal(words.slice(1), words.slice(0, len(b) - 1)).to_numpy(zero_copy_only=False))
            if open_ and open_[-1].column(0)[-1] != words[0]:
                held.append(settle(pa.Table.from_batches(open_)))
                open_ = []
            if len(change):
                last = int(change[-1]) + 1
                held.append(settle(pa.Table.from_batches([*open_, b.slice(0, last)])))
                open_ = [b.slice(last)]
            else:
                open_.append(b)
            if sum(len(x[0]) for x in held) >= HELD:
                yield passed_on(held)
        if open_:
            held.append(settle(pa.Table.from_batches(open_)))
        if held:
            yield passed_on(held)

    schema = "word binary, part long, code int, n long, near binary"
    # Parts are written first, as they are read with batches of few rows and words are not.
    met = parts.select("part", "train", "lengths", "codes", "words", "counts").mapInArrow(occurrences, schema)
    with _few_rows(parts.sparkSession):
        met = stage(met, "lm-occurrences")
    return stage(met.repartition("word").sortWithinPartitions("word").mapInArrow(merge, "part long, codes binary, counts binary, classes binary"), "lm-words")


def spread(parts: DataFrame, core: Callable[[], dict[bytes, int]], cls: np.ndarray, core_counts: np.ndarray) -> DataFrame:
    """Rows (part, ids, train, lengths, codes, counts, classes): a part's core words as a piece, without lists; its texts in slices, without counts and classes."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            for r in _cells(b):
                numbers = _core_numbers(r["words"], core())
                own = np.flatnonzero(numbers)
                numbers = numbers[own]
                types = [b.schema.field(c).type for c in ("ids", "train", "lengths")]
                cells = [pa.array([x], pa.binary()) for x in (own.astype(np.int32).tobytes(), core_counts[numbers].tobytes(), cls[numbers].astype(np.uint8).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), *(pa.nulls(1, t) for t in types), *cells], names=names)
                ends = np.cumsum(r["lengths"])
                first = np.flatnonzero(np.diff((ends - r["lengths"]) // SLICE, prepend=-1)).tolist()
                for a, z in zip(first, [*first[1:], len(ends)], strict=True):
                    lists = [pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), x) for x in (r["ids"].slice(a, z - a), pa.array(r["train"][a:z]), pa.array(r["lengths"][a:z]))]
                    codes = r["codes"][ends[a] - r["lengths"][a] : ends[z - 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), *lists, pa.array([codes.tobytes()], pa.binary()), *(pa.nulls(1, pa.binary()) for _ in range(2))], names=names)

    names = ["part", "ids", "train", "lengths", "codes", "counts", "classes"]
    schema = f"part long, ids {kinds['ids']}, train {kinds['train']}, lengths {kinds['lengths']}, codes binary, counts binary, classes binary"
    return parts.select("part", "ids", "train", "lengths", "codes", "words").mapInArrow(run, schema)


def score_documents(docs: DataFrame, *, train: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = 64, rounds: int = 6, strength: float = 64.0, part_tokens: int = PART, core_share: int = CORE) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score); ``train`` says which rows to learn from.

    ``classes`` (4 to 126) include one of ends and one that rare words begin in; ``core_share`` is the core's inverse share.
    """
    if not 4 <= classes <= 126:
        raise ValueError("classes must be from 4 to 126")
    spark = docs.sparkSession
    parts = encode(docs, train, id_col, text_col, part_tokens)
    kind = parts.schema["ids"].dataType.elementType.simpleString()
    counts = word_counts(parts)
    s = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, v = s.n or 0, s.v
    # At most `core_share` words, as shares sum to 1, and the end.
    top = counts.filter((F.col("n") * core_share >= total) | (F.length("word") == 0)).orderBy(F.col("n").desc(), "word").collect()
    core_words = [bytes(r.word) for r in top] or [_END]
    core_counts = np.array([0, *(r.n for r in top)] if top else [0, 0], np.int64)
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(core_words, 1)})
    core = lambda: shared.value
    width, end = len(core_words) + 1, core_words.index(_END) + 1
    cls, m, _ = exchange(core_bigrams(parts, core, width), width, end, classes, rounds)
    rare = rare_words(parts, core, cls, m, classes)
    base_total = np.log10(total + 0.1 * (v + 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each part its pieces, then its slices."""
        release_memory()
        at_part, pieces = None, []
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i] for c in b.schema.names}
                if row["part"] != at_part:
                    at_part, pieces = row["part"], []
                if not row["lengths"].is_valid:
                    pieces.append([row[c].as_py() for c in ("codes", "counts", "classes")])
                    continue
                if pieces:  # together they have every word of the part
                    at, n, c = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*pieces, strict=True), (np.int32, np.int64, np.uint8), strict=True))
                    order = np.empty(len(at), np.int64)
                    order[at] = np.arange(len(at))
                    n, c = n[order], c[order]
                    c = np.where(n > 0, c, classes)
                    marks = (c + 128 * (n == 1)).astype(np.uint8)
                    base, words = np.log10(n + 0.1) - base_total, np.log10(np.maximum(n, 1))
                    known, pieces = n > 0, []
                codes, lengths = np.frombuffer(row["codes"].as_buffer(), np.int32), row["lengths"].values.to_numpy()
                starts = np.cumsum(lengths) - lengths
                sums = [pa.array(np.add.reduceat(x, starts)) for x in (known[codes].astype(np.int64), base[codes], words[codes])]
                yield pa.RecordBatch.from_arrays([row["ids"].values, row["train"].values, pa.array(lengths), *sums, _binaries(lengths, marks[codes])], names=["id", "train", "n_tokens", "n_known", "base_score", "words", "marks"])

    ddl = f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, words double, marks binary"
    met = spread(parts, core, cls, core_counts).unionByName(rare, allowMissingColumns=True)
    with _few_rows(spark, 2):
        coded = stage(met.repartition("part").sortWithinPartitions("part", F.col("lengths").isNotNull()).mapInArrow(place, ddl), "lm-coded")
    wide = classes + 1

    def steps(marks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class of each token, and of the one before it, and whether each has been seen once; texts begin after an end."""
        cur, once = (marks & 127).astype(np.int64), marks >= 128
        prev = np.concatenate(([END_CLASS], cur[:-1]))
        prev[(np.cumsum(lengths) - lengths)[lengths > 0]] = END_CLASS
        return prev, cur, once

    def flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(b.column(name).to_pylist()), np.uint8), b.column("n_tokens").to_numpy()

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = np.zeros((wide, wide), np.int64)
        for b in batches:
            for at in range(0, len(b), 256):
                marks, lengths = flat(b.slice(at, 256), "marks")
                prev, cur, once = steps(marks, lengths)
                first = np.zeros(len(cur), bool)
                first[np.cumsum(lengths) - lengths] = True
                after = np.concatenate(([False], once[:-1])) & ~first
                for a, c in ((prev, cur), (prev[once], np.full(once.sum(), classes)), (np.full(after.sum(), classes), cur[after]), (np.full((after & once).sum(), classes), np.full((after & once).sum(), classes))):
                    e += np.bincount(a * wide + c, minlength=wide * wide).reshape(wide, wide)
        k = np.flatnonzero(e.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(e.ravel()[k])], names=["k", "n"])

    e = np.zeros(wide * wide)
    for r in coded.filter("train").select("n_tokens", "marks").mapInArrow(transitions, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # (classes + 1)^2 at most
        e[r.k] = r.n
    log_p = transition_table(e.reshape(wide, wide), strength)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.empty(0)]
            for at in range(0, len(b), 256):
                marks, lengths = flat(b.slice(at, 256), "marks")
                prev, cur, _ = steps(marks, lengths)
                got.append(np.add.reduceat(log_p[prev, cur], np.cumsum(lengths) - lengths))
            score = np.concatenate(got) + b.column("words").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_tokens"), b.column("n_known"), pa.array(np.full(len(b), total)), b.column("base_score"), pa.array(score)], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.select("id", "n_tokens", "n_known", "base_score", "words", "marks").mapInArrow(finish, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def transition_table(e: np.ndarray, strength: float) -> np.ndarray:
    """log10 of P(next class | class) / (count of the next class); the last row and column are the unknown type.

    ``e`` counts transitions of training tokens; its last column those to words seen once, its last row those from them.
    """
    m, once = e[:, :-1], e[:, -1]
    per_class, total = m[:-1].sum(0), m[:-1].sum()
    if not total:
        return np.zeros_like(e)
    n = m.sum(1)
    p0 = (once[:-1].sum() + 0.1) / (total + 0.2)
    unknown = (once + strength * p0) / (n + strength)
    known = (m + strength * per_class[None, :] / total) / (n + strength)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log10((1 - unknown)[:, None] * known) - np.log10(per_class)[None, :]
    return np.column_stack((out, np.log10(unknown)))
