"""Quality rules: base counts, then divergence from language references.

Each document gets counts of words, symbols, repeated lines and repeated 3-word
windows, and two histograms: character classes, and common (function) words.
The reference of a language is the sum of the histograms of all its documents
that pass the base rules.  A document is kept when the Jensen-Shannon distance
of each histogram from its language's reference stays within a limit; a
histogram with too few characters or words to say anything is not judged
(minimum-length guards).  Everything is DataFrame expressions; only counts, not
texts, are staged and joined.

Edge cases: a null text counts as empty and fails the base rules; rows with a
null language share one reference; a language without any passing document has
no reference and its documents are judged by the base rules alone; repeated
rows are judged alike; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with",
    "le", "la", "les", "des", "et", "un", "du", "que", "pour",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "nicht",
    "el", "los", "y", "en", "de", "por", "con", "una",
)

#: Limits of the Jensen-Shannon distance (0 to 1) and the least characters and words to judge by; documents labelled good stay below them.
CHAR_LIMIT, CHAR_LEAST = 0.27, 400
WORD_LIMIT, WORD_LEAST = 0.22, 150


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(positions: Column) -> Column:
    """How many words the 3-word windows at the given sorted positions cover."""
    steps = F.transform(positions, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def repeated_window_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each word once.

    Windows are sorted by hash, with their position in the low bits, so equal ones are
    neighbours; their words are compared.  Where neighbours of one hash differ, which a
    long text makes likelier as positions leave fewer bits, that text's windows are sorted
    again by the whole hash, and if that, too, puts different ones together, by their words.
    """
    sr, sl = (lambda a, b: F.call_function("shiftright", a, b)), (lambda a, b: F.call_function("shiftleft", a, b))

    def windows(make: Callable[[Column, Column], Column]) -> Column:
        at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: make(window_hash(*(F.get(words, i + k) for k in range(3))), i))

    def checked(found: Column, hashed: Callable[[Column], Column], place: Callable[[Column], Column], other: Callable[[], Column]) -> Column:
        """Words that the windows in ``found``, neighbours by hash, cover; ``other()`` if different ones are neighbours."""

        def differ(x: Column, i: Column) -> Column:
            a, b = place(x), place(F.get(found, i - 1))
            unlike = [F.get(words, (a + k).cast("int")) != F.get(words, (b + k).cast("int")) for k in range(3)]
            return (i > 0) & (hashed(x) == hashed(F.get(found, i - 1))) & (unlike[0] | unlike[1] | unlike[2])

        clash = F.exists(F.transform(found, differ), lambda v: F.coalesce(v, F.lit(False)))
        return F.when(clash, other()).otherwise(let(F.sort_array(F.transform(found, place)), _covered))

    def by_words() -> Column:
        made = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(*(F.get(words, i + k).alias(f"w{k}") for k in range(3)), i.cast("long").alias("i")))
        same = lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
        found = let(F.sort_array(made), lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), _covered)

    def by_hash() -> Column:
        made = F.sort_array(windows(lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        found = let(made, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        return let(found, lambda f: checked(f, lambda x: x["h"], lambda x: x["i"], by_words))

    def packed(b: Column) -> Column:
        made = F.sort_array(windows(lambda h, i: sl(sr(h, b), b).bitwiseOR(i.cast("long"))))
        found = let(made, lambda s: F.filter(s, lambda x, i: (sr(x, b) == sr(F.get(s, i - 1), b)) | (sr(x, b) == sr(F.get(s, i + 1), b))))
        return let(found, lambda f: checked(f, lambda x: sr(x, b), lambda x: x - sl(sr(x, b), b), by_hash))

    return let(F.ceil(F.log2(n + 1)).cast("int"), packed)  # bits for a position; the hash keeps the rest


def _drop_count(text: Column, what: str) -> Column:
    """How often an ASCII string occurs, without overlaps."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def features(text: Column) -> Column:
    """Struct of the base counts and the two histograms of one text."""
    no_word = r"^[\x20\x09-\x0D]*$"

    def of_words(t: Column, words: Column) -> Column:
        n = F.size(words)
        chars = F.length(F.array_join(words, ""))
        symbols = sum((_drop_count(t, c) for c in SYMBOLS[1:]), _drop_count(t, SYMBOLS[0]))
        lines = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(no_word))
        space = F.length(t) - chars
        upper, digit, mark = (F.regexp_count(t, F.lit(p)) for p in ("[A-Z]", "[0-9]", r"[.,;:!?'\"()-]"))
        wide = F.octet_length(t) - F.length(t)

        def with_counts(c: Column) -> Column:
            rest = F.length(t) - c["space"] - c["symbols"] - c["upper"] - c["digit"] - c["mark"]
            return F.array(*(c[x].cast("long") for x in ("space", "symbols", "upper", "digit", "mark", "wide")), F.greatest(rest.cast("long"), F.lit(0)))

        counts = F.struct(space.alias("space"), symbols.alias("symbols"), upper.alias("upper"), digit.alias("digit"), mark.alias("mark"), wide.alias("wide"))
        spaced = F.lower(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")))

        def common(s: Column) -> Column:
            return let(F.array(*(_drop_count(s, f" {w} ") for w in COMMON_WORDS)), lambda a: F.concat(a, F.array(n - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))))

        return F.struct(
            n.cast("long").alias("n_words"),
            chars.cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_window_words(words, n).cast("long").alias("n_repeat_words"),
            let(counts, with_counts).alias("char_hist"),
            let(spaced, common).alias("word_hist"),
        )

    return let(F.coalesce(text.cast("string"), F.lit("")), lambda t: let(F.array_remove(F.split(t, WORD_GAP), ""), lambda w: of_words(t, w)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts with equal bins."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (part(a) + part(b)) / 2

    def of(sums: Column) -> Column:
        both = F.zip_with(p, q, lambda a, b: term(a / sums["a"], b / sums["b"]))
        return F.when((sums["a"] > 0) & (sums["b"] > 0), F.sqrt(F.greatest(total(both), F.lit(0.0))))

    return let(F.struct(total(p).alias("a"), total(q).alias("b")), of)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, counts, base_failed, char_distance, word_distance, kept), one for each document.

    A distance is null where its guard says that the text is too short to judge.
    """
    spread = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), features(F.col(f"`{text_col}`")).alias("f")).select("id", "lang", "f.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = stage(spread.withColumn("base_failed", failed), "quality")

    sums = [F.sum(F.get("char_hist", F.lit(i))).alias(f"c{i}") for i in range(7)] + [F.sum(F.get("word_hist", F.lit(i))).alias(f"w{i}") for i in range(len(COMMON_WORDS) + 1)]
    reference = (
        counted.filter(~F.col("base_failed")).groupBy("lang").agg(*sums)
        .select(F.col("lang").alias("of"), F.array(*(f"c{i}" for i in range(7))).alias("char_ref"), F.array(*(f"w{i}" for i in range(len(COMMON_WORDS) + 1))).alias("word_ref"))
    )
    # One row a language; no hint, so it is sent to all only when its measured size allows.
    judged = counted.join(reference, F.col("lang").eqNullSafe(F.col("of")), "left").withColumns({
        "char_distance": F.when(F.col("word_chars") >= CHAR_LEAST, js_distance(F.col("char_hist"), F.col("char_ref"))),
        "word_distance": F.when(F.col("n_words") >= WORD_LEAST, js_distance(F.col("word_hist"), F.col("word_ref"))),
    })
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= CHAR_LIMIT) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= WORD_LIMIT)
    return judged.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & near).alias("kept"))
