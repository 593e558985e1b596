r"""Toxicity of restored text: noisy-channel deobfuscation, then a word model.

Restoring.  Strings that look disguised (digits or signs among letters, a letter
three times or more in a row, single letters set apart by spaces or marks) become
a lattice: each sign may stand for the letters it resembles or for nothing, and a
run of one letter for one or two of them, of n wildcards for up to n letters (or as many
as the longest known word has).  What
sets single letters apart may be nothing or a word break; two separators, or a space
among marks, favour the break.  A Viterbi search under a trigram character model, with a
bonus for known words, finds the likeliest spelling of all; nothing is pruned.  The
character model counts all trigrams of all documents.

Scoring.  Words (restored ones included) and beginnings of words of labelled documents give log odds by
smoothed document counts; words whose odds are significant (|z| > 4.5) make up a
table.  A logistic regression on what a text's words say under that table gives the
probability.  Both learn from every labelled row: counts are aggregates, and each Newton step
is a pass over the rows' features, whose sums are taken in one order however rows were dealt out.

Edge cases: null and empty texts get the score of a text without words; labels of
null identifiers or classes are left out, of repeated ones the largest counts;
without labels of both classes the score is the smoothed share of the one class;
long strings are restored in linear time; identifiers may have any type; extra columns
are kept, and ``score`` refuses a name for its own that is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release_memory, stage
from .words import PUNCTUATION, SPACE, byte_table

# Letters that a sign can stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz",
}
_SIGNS = re.escape("".join(LOOKALIKE))
_RUN = re.compile(rf"[a-z{_SIGNS}]+")
_INSIDE = re.compile(rf"[a-z][{_SIGNS}]+[a-z]")
_ENDS = re.compile(rf"([{_SIGNS}]*)([a-z]+)([0-9@$|]*)")
_ANY_SIGN = re.compile(rf"[{_SIGNS}]")
_TRIPLE = re.compile(r"([a-z])\1\1")
_LETTERS = re.compile(r"[a-z]+")
#: Stretches of letters that each differ from the next, then runs of one sign.
_PIECE = re.compile(r"((?:([a-z])(?!\2))+)|(.)\3*", re.DOTALL)
_SPACED = re.compile(rf"(?<![a-z0-9])[a-z0-9@$!](?:[ ._\-*]{{1,2}}[a-z0-9@$!|*]){{3,}}(?![a-z0-9])")
_STEP = re.compile(r"([ ._\-*]{1,2})([a-z0-9@$!|*])")
_FOLD = byte_table(SPACE + PUNCTUATION)
CODES, HEADS = 32, (4, 7)
#: Rows of a bucket of the regression; terms that a task counts before it tells them.
BUCKET, TERMS = 4096, 100_000
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams (0: not a letter a to z) over all texts, as a 32 x 32 x 32 array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        total = np.zeros(CODES**3, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 256):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).slice(at, 256).to_pylist()]
                data = np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8)  # two spaces around each, whatever its batch
                for a in range(0, len(data), 1 << 20):
                    c = _CODE[data[a : a + (1 << 20) + 2]]
                    if len(c) > 2:
                        total += np.bincount(c[:-2] * (CODES * CODES) + c[1:-1] * CODES + c[2:], minlength=CODES**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most 32,768
    out = np.zeros(CODES**3, np.int64)
    for r in rows:
        out[r.k] = r.n
    return out.reshape(CODES, CODES, CODES)


def disguised(low: str) -> Iterator[str]:
    """Strings of letters and signs that look like disguised words, in time linear in the text.

    A run of letters and signs counts whole if a sign lies between letters, or if signs other than asterisks come before
    letters; else without the asterisks at its front and what precedes them; else up to the digits behind its letters.
    """
    for m in _RUN.finditer(low):
        run = m[0]
        if run.isalpha():
            continue
        if _INSIDE.search(run):
            yield run
        elif ends := _ENDS.match(run):
            before, letters, behind = ends.groups()
            if before and "*" not in before:
                yield run
            elif behind:
                yield before + letters + behind
            elif tail := before.rpartition("*")[2]:
                yield tail + run[len(before) :]


class _Cells:
    """The best path to each pair of last letters, as arrays: for steps of many states and readings."""

    def __init__(self, states: dict[tuple[int, int], tuple[float, tuple]]) -> None:
        self.score = np.full((27, 27), -np.inf)
        self.spelt = np.empty((27, 27), object)
        for at, (score, spelt) in states.items():
            self.score[at], self.spelt[at] = score, spelt

    def moved(self, letters: str, cost: float, log_p: np.ndarray) -> _Cells:
        """These paths with some letters more; ``spelt`` is still without them."""
        score, spelt = self.score + cost, self.spelt
        cols = np.arange(27)
        for ch in letters:
            z = ord(ch) - 96 if "a" <= ch <= "z" else 0
            reached = score + log_p[:, :, z]
            came = reached.argmax(0)
            next_score, next_spelt = np.full((27, 27), -np.inf), np.empty((27, 27), object)
            next_score[:, z], next_spelt[:, z] = reached[came, cols], spelt[came, cols]
            score, spelt = next_score, next_spelt
        out = _Cells({})
        out.score, out.spelt = score, spelt
        return out

    def take(self, other: _Cells, letters: str) -> None:
        better = other.score > self.score
        self.score[better] = other.score[better]
        came = other.spelt[better]
        if letters and len(came):
            came = np.frompyfunc(lambda spelt: (spelt, letters), 1, 1)(came)
        self.spelt[better] = came

    def states(self) -> dict[tuple[int, int], tuple[float, tuple]]:
        return {(x, y): (float(self.score[x, y]), self.spelt[x, y]) for x, y in np.argwhere(self.score > -np.inf).tolist()}


#: States times readings from which a step of the search works on arrays.
DENSE = 256


@dataclass
class Restorer:
    """Viterbi decoding of disguised strings under a trigram model and a set of known words."""

    log_p: np.ndarray
    known: frozenset[str] = frozenset()
    bonus: float = 10.0
    memo: dict[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.heads = frozenset(w[:k] for w in self.known for k in range(len(w) + 1)) | {""}
        self.longest = max(map(len, self.known), default=0)
        self.steps = self.log_p.tolist()

    @staticmethod
    def of_counts(counts: np.ndarray, known: frozenset[str] = frozenset()) -> Restorer:
        used = 27
        c = counts[:used, :used, :used].astype(float)
        pair = c.sum(2)
        back = (c.sum((0, 1)) + 1) / (c.sum() + used)
        two = (c.sum(0) + 5 * back[None, :]) / (c.sum((0, 2))[:, None] + 5)
        return Restorer(np.log((c + 20 * two[None, :, :]) / (pair[:, :, None] + 20)), known)

    def restore(self, shown: str) -> str:
        if len(shown) > 256:  # hardly seen twice
            return self._decode(shown)
        found = self.memo.get(shown)
        if found is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = self.memo[shown] = self._decode(shown)
        return found

    def restore_spaced(self, shown: str) -> list[str]:
        """The words of single letters set apart."""
        if len(shown) > 256:
            return self._search(self._spaced_slots(shown), self.bonus / 5).split()
        found = self.memo.get(shown + "\0")
        if found is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            found = self.memo[shown + "\0"] = self._search(self._spaced_slots(shown), self.bonus / 5)
        return found.split()

    @staticmethod
    def _sign(sign: str) -> list[tuple[str, float]]:
        letters = LOOKALIKE[sign]
        return [(x, -0.7 if len(letters) < 3 else -2.5) for x in letters]

    def _spaced_slots(self, shown: str) -> list[list[tuple[str, float]]]:
        # A run of "*" sets apart; so does each of them where they would outnumber the letters.
        steps = [(m[1], "" if m[2] == "*" and "*" in m[1] else m[2]) for m in _STEP.finditer(shown, 1)]
        if 2 * sum(sign == "*" for _, sign in steps) > 1 + sum(sign != "" for _, sign in steps):
            steps = [(gap, sign.strip("*")) for gap, sign in steps]
        marked = any(gap != " " * len(gap) for gap, _ in steps)
        slots, last = [], ""
        for gap, sign in [("", shown[0]), *steps]:
            if gap and not (last == "" and slots):
                apart = len(gap) > 1 or sign == "" or (gap == " " and marked)
                slots.append([("", -3.0 * apart), (" ", -3.0 * (not apart))])
            if sign in LOOKALIKE:
                slots.append([*self._sign(sign), ("", -9.0)])
            elif sign:
                slots.append([(sign, -0.1), ("", -0.2)] if sign == last else [(sign, 0.0)])
            last = sign
        return slots

    def _decode(self, shown: str) -> str:
        # The lattice: for each run of equal signs its readings, with their channel costs; other letters stand for themselves.
        slots: list[list[tuple[str, float]]] = []
        for m in _PIECE.finditer(shown):
            if m[1]:
                slots.append([(m[1], 0.0)])
                continue
            sign, n = m[3], len(m[0])
            if sign.isalpha():
                slots.append([(sign, -0.3), (sign * 2, -0.1 if n == 2 else -0.7)] if n > 1 else [(sign, 0.0)])
            elif sign in LOOKALIKE:
                one = self._sign(sign)
                if len(one) < 3:
                    slots.append((one if n == 1 else one + [(x * 2, c - 0.5) for x, c in one]) + [("", -9.0)])
                else:  # as many letters as the longest known word has, at most
                    slots += [[*one, ("", -2.5 if k else -9.0)] for k in range(min(n, max(1, self.longest)))]
            # Other marks only set letters apart.
        return self._search(slots, 0.0)

    def _inner(self, letters: str) -> float:
        """The log probability of letters from the third on, each after the two before it."""
        c = _CODE[np.frombuffer(letters.encode("ascii"), np.uint8)]
        return float(self.log_p[c[:-2], c[1:-1], c[2:]].sum())

    def _search(self, slots: list[list[tuple[str, float]]], per_letter: float) -> str:
        """The best spelling; known words are worth ``per_letter`` for each of three letters or more, or else ``bonus``."""
        heads = self.heads
        state = tuple[int, int, str]
        path = tuple[float, tuple]

        def worth(word: str) -> float:
            if word not in self.known:
                return 0.0
            return self.bonus if not per_letter else per_letter * len(word) * (len(word) > 2)

        def steps(x: int, y: int, letters: str, inner: float) -> tuple[int, int, float]:
            """The last two letters after some more, and what they cost; ``inner`` is the cost from the third on."""
            if len(letters) < 3:
                total = 0.0
                for ch in letters:
                    z = ord(ch) - 96 if "a" <= ch <= "z" else 0
                    total += self.steps[x][y][z]
                    x, y = y, z
                return x, y, total
            first, second, x2, y2 = (ord(ch) - 96 if "a" <= ch <= "z" else 0 for ch in (letters[0], letters[1], letters[-2], letters[-1]))
            return x2, y2, self.steps[x][y][first] + self.steps[y][first][second] + inner

        # A state is the last two letters and, while a known word begins like it, the word so far; each keeps its
        # best path.  States without such a word are in ``free``, by their letters alone.
        begun: dict[state, path] = {(0, 0, ""): (0.0, ())}
        free: dict[tuple[int, int], path] = {}
        for readings in slots:
            next_begun: dict[state, path] = {}
            next_free: dict[tuple[int, int], path] = {}
            inner = [self._inner(letters) if len(letters) > 2 else 0.0 for letters, _ in readings]
            for (a, b, head), (score, spelt) in begun.items():
                for (letters, cost), deep in zip(readings, inner, strict=True):
                    x, y, more = steps(a, b, letters, deep)
                    total, h = score + cost + more, head
                    if letters == " ":
                        total += worth(h)
                        h = ""
                    elif letters:
                        h = h + letters if len(h) + len(letters) <= self.longest else None
                        if h is not None and h not in heads:
                            h = None
                    now = (spelt, letters) if letters else spelt
                    if h is None:
                        if (x, y) not in next_free or total > next_free[x, y][0]:
                            next_free[x, y] = (total, now)
                    elif (x, y, h) not in next_begun or total > next_begun[x, y, h][0]:
                        next_begun[x, y, h] = (total, now)
            if len(free) * len(readings) > DENSE:
                cells, into = _Cells(free), _Cells(next_free)
                for letters, cost in readings:
                    moved = cells.moved(letters, cost, self.log_p)
                    if letters != " ":
                        into.take(moved, letters)
                        continue
                    for y in range(27):  # a break: any word may begin
                        if moved.score[y, 0] > (next_begun[y, 0, ""][0] if (y, 0, "") in next_begun else -math.inf):
                            next_begun[y, 0, ""] = (float(moved.score[y, 0]), (moved.spelt[y, 0], " "))
                next_free = into.states()
            else:
                for (letters, cost), deep in zip(readings, inner, strict=True):
                    for (a, b), (score, spelt) in free.items():
                        x, y, more = steps(a, b, letters, deep)
                        total = score + cost + more
                        if letters == " ":
                            if (x, y, "") not in next_begun or total > next_begun[x, y, ""][0]:
                                next_begun[x, y, ""] = (total, (spelt, letters))
                        elif (x, y) not in next_free or total > next_free[x, y][0]:
                            next_free[x, y] = (total, (spelt, letters) if letters else spelt)
            begun, free = next_begun, next_free
        ends = [(v[0] + self.steps[a][b][0] + worth(h), v[1]) for (a, b, h), v in begun.items()]
        ends += [(score + self.steps[a][b][0], spelt) for (a, b), (score, spelt) in free.items()]
        _, spelt = max(ends, key=lambda e: e[0])
        out = []
        while spelt:
            spelt, letters = spelt
            out.append(letters)
        return "".join(reversed(out))

    def words(self, text: str) -> list[str]:
        """The words of a text in lower case, with disguised ones restored behind them."""
        low = text.lower()
        words = low.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass").split()
        if _ANY_SIGN.search(low):
            words += (self.restore(found.strip("!(|+*")) for found in disguised(low))
        if _TRIPLE.search(low):
            words += (self.restore(m[0]) for m in _LETTERS.finditer(low) if _TRIPLE.search(m[0]))
        words += (w for m in _SPACED.finditer(low) for w in self.restore_spaced(m[0]))
        return words


def _terms(words: list[str]) -> Counter:
    """How often each word, and each beginning of a longer word, occurs."""
    out = Counter(words)
    for w, n in list(out.items()):
        for k in HEADS:
            if len(w) > k:
                out[w[:k] + "~"] += n
    return out


def _word_features(words: list[str], weights: dict[str, float]) -> list[float]:
    terms = _terms(words)
    hits = [weights[w] for w in terms.keys() & weights.keys() for _ in range(terms[w])]
    up = [h for h in hits if h > 0]
    return [max(up, default=0.0), math.log1p(sum(up)), math.log1p(len(up)), sum(hits) / math.sqrt(1 + len(words))]


def _slopes(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log likelihood, without the ridge."""
    a = np.column_stack((np.ones(len(x)), x))
    p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
    return a.T @ (y - p), (a * (p * (1 - p))[:, None]).T @ a


def _newton(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients, the intercept first, by Newton steps with a ridge on all but the intercept."""
    b = np.zeros(size)
    penalty = np.full(size, ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        grad, curve = slopes(b)
        move = np.linalg.solve(curve + np.diag(penalty + 1e-9), grad - penalty * b)
        b += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return b


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """``_newton`` of rows in memory."""
    return _newton(lambda b: _slopes(x, y, b), x.shape[1] + 1, ridge, steps)


def fit_logistic_rows(rows: DataFrame, n: int) -> np.ndarray:
    """``fit_logistic`` of ``n`` rows (y int, a, b, c, d double): a pass over them for each step.

    Rows meet in buckets by a hash of their values, some ``BUCKET`` in each; a bucket is sorted and kept as one
    row, and the driver adds up buckets in their order.
    """
    columns = ["y", "a", "b", "c", "d"]

    def sort(t: pa.Table) -> pa.Table:
        made = np.column_stack([t[c].to_numpy() for c in columns]).astype(float)
        made = made[np.lexsort(made.T)]
        return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int64()), "v": pa.array([made.ravel()], pa.list_(pa.float64()))})

    bucket = F.pmod(F.xxhash64(*columns), F.lit(-(-n // BUCKET)))
    held = stage(rows.select(bucket.alias("bucket"), *columns).groupBy("bucket").applyInArrow(sort, "bucket long, v array<double>"), "toxicity-features")

    def slopes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = []
                for i in range(len(batch)):
                    v = np.array(batch.column(1)[i].values).reshape(-1, 5)
                    sums.append(np.concatenate([x.ravel() for x in _slopes(v[:, 1:], v[:, 0], b)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.list_(pa.float64()))], names=["bucket", "s"])

        got = held.mapInArrow(run, "bucket long, s array<double>").collect()  # 30 numbers for each BUCKET rows
        total = np.sum([r.s for r in sorted(got, key=lambda r: r.bucket)], axis=0)
        return total[:5], total[5:].reshape(5, 5)

    return _newton(slopes, 5)


@dataclass
class ToxicityModel:
    restorer: Restorer
    weights: dict[str, float]
    coef: np.ndarray

    def score(self, text: str | None) -> float:
        f = np.array(_word_features(self.restorer.words(text or ""), self.weights))
        return float(1 / (1 + np.exp(-np.clip(self.coef[0] + f @ self.coef[1:], -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on ``docs`` and the rows of ``labels`` (identifier, 0 or 1)."""
    restorer = Restorer.of_counts(trigram_counts(docs, text_col))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Texts are shuffled once at any size, not only where labels outgrow a broadcast, and stream past the labels unsorted.
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).join(known.hint("shuffle_hash"), "id").select("text", "y"), "toxicity-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[0][w] for w in words], pa.int64()), pa.array([seen[1][w] for w in words], pa.int64())], names=["w", "n0", "n1"])

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(_terms(restorer.words(t)).keys())
                if len(seen[0]) + len(seen[1]) > TERMS:  # the aggregate adds up what a task tells in parts
                    yield told()
                    seen[0].clear()
                    seen[1].clear()
        yield told()

    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n0 + n1 else math.log(0.01)
        return ToxicityModel(restorer, {}, np.array([prior, 0.0, 0.0, 0.0, 0.0]))
    odds = F.log((F.col("n1") + 0.1) / (n1 + 1)) - F.log((F.col("n0") + 0.1) / (n0 + 1))
    expect = (F.col("n0") + F.col("n1")) * (n1 / (n0 + n1))
    z = (F.col("n1") - expect) / F.sqrt(expect + 0.5)
    counted = rows.select("text", "y").mapInArrow(count, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    telling = counted.select("w", odds.alias("odds"), z.alias("z")).filter(F.abs("z") > 4.5).orderBy(F.abs("z").desc(), "w").collect()  # terms of significant odds
    weights = {r.w: r.odds for r in telling}
    restorer = Restorer(restorer.log_p, frozenset(weights))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([_word_features(restorer.words(t), weights) for t in batch.column(0).to_pylist()]).reshape(len(batch), 4)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(f[:, i]) for i in range(4))], names=["y", "a", "b", "c", "d"])

    made = rows.select("text", "y").mapInArrow(measure, "y int, a double, b double, c double, d double")
    return ToxicityModel(restorer, weights, fit_logistic_rows(made, n0 + n1))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the column ``out_col``: the probability of being toxic."""
    names = docs.columns
    if out_col.lower() in (c.lower() for c in names):
        raise ValueError(f"there is a column {out_col!r} already")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out_col}` double"
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            got = pa.array([model.score(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*names, out_col])

    return docs.mapInArrow(run, schema)
