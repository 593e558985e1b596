"""Operators on small fixtures, against plain Python."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, decontaminate, jaccard_join, line_dedup, mixing, quality, sharding, sstable, suffix_dedup, token_tables, toxicity, words
from loomgraph.llm.components import components
from loomgraph.llm.entry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, h1 string, `key` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    """Random prose with copies, near copies, shared passages, odd and empty texts, nulls and repeated rows."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdefgé"), rng.integers(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab, k))
    passage = prose(60)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            t = prose(int(rng.integers(1, 200)))
        elif kind == 1:
            t = out[int(rng.integers(len(out)))]
        elif kind == 2:
            w = out[int(rng.integers(len(out)))].split(" ")
            for _ in range(int(rng.integers(1, 4))):
                w[int(rng.integers(len(w)))] = "x"
            t = " ".join(w)
        elif kind == 3:
            t = prose(30) + "\n" + passage + "\n" + prose(30)
        elif kind == 4:
            t = "\n".join([prose(8), "Shared footer line", prose(8), "  shared FOOTER line\t"])
        else:
            t = prose(5) * int(rng.integers(1, 30))
        out.append(t)
    out += ["", " \t\n", "é", "a b c d", "A b  c\td", "x" * 3000, "ab " * 2000]
    rows = [(i * 3, t, ("en", "fr", None)[i % 3], f"src{i % 4}" if i % 5 else None, "clash", i) for i, t in enumerate(out)]
    return rows + [(9001, None, None, None, None, None), rows[0]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_word_hashes():
    texts = [b"", b"  ", b"Aa bB\tcc", b"aa", b"x" * 5000 + b" aa", b"aa bb cc"]
    for size in (words.SEGMENT, 64):
        old, words.SEGMENT = words.SEGMENT, size
        h, at = words.word_hashes(texts)
        words.SEGMENT = old
        got = [h[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert [len(g) for g in got] == [0, 0, 3, 1, 2, 3]
        assert got[2] == got[5] and got[3][0] == got[4][1] == got[2][0] and len(set(got[2])) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100, 102: 100}


def test_sharding(docs, rows, empty):
    got = sharding.byte_shards(docs, 5, pad=1).collect()
    assert len(got) == len(rows)
    total, at = sum(r["size"] for r in got), 0
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.id, r["size"], r.text_crc32) for r in got) == want
    slots = collections.Counter()
    for r in sorted(got, key=lambda r: (r.id, r.text_crc32, r["size"], r.start_byte)):
        assert r.start_byte == at and r.shard == min(4, (2 * at + r["size"]) * 5 // (2 * total)) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        at += r["size"]
    assert sharding.byte_shards(empty, 4).count() == 0


def test_jaccard(docs, rows, empty):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for size, percent in ((5, 80), (2, 60)):
        sets = []
        for r in rows:
            w = WORD.findall((r[1] or "").translate(table))
            sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
        root = list(range(len(rows)))

        def find(a, root=root):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in itertools.combinations(range(len(rows)), 2):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        least = {}
        for a in range(len(rows)):
            least[find(a)] = min(least.get(find(a), 1 << 60), rows[a][0])
        want = collections.Counter((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
        got = jaccard_join.jaccard_components(docs, size=size, percent=percent)
        assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_names_of_several_sets_are_drawn_anew(spark, docs, monkeypatch):
    want = collections.Counter(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    real = jaccard_join.set_names
    monkeypatch.setattr(jaccard_join, "set_names", lambda s: (real(s)[0] % 5, real(s)[1]))
    assert collections.Counter(map(tuple, jaccard_join.jaccard_components(docs).collect())) == want


def test_jaccard_in_pieces(spark, monkeypatch):
    """Near copies by the hundred, and phrases that most texts hold, with everything dealt out in pieces."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(200)]
    phrases = [" ".join(rng.choice(vocab, 12)) for _ in range(6)]
    base = rng.choice(vocab, 60).tolist()
    rows = []
    for i in range(260):
        if i % 2:
            w = list(base)
            w[int(rng.integers(60))] = f"x{i % 90}"
            rows.append((f"id{i:03d}", " ".join(w)))
        else:
            rows.append((f"id{i:03d}", " ".join(rng.permutation(phrases)[:4])))
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {(r[0], len(s), rows[find(i)][0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))}
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for hot, leaders, group in ((1024, 32, 128), (2, 1, 8)):
        for name, value in (("HOT", hot), ("LEADERS", leaders), ("GROUP", group)):
            monkeypatch.setattr(jaccard_join, name, value)
        assert {tuple(r) for r in jaccard_join.jaccard_components(df).collect()} == want
    monkeypatch.undo()
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), ("x", "d e"), (None, "D  e"), (None, None)], "doc_id string, text string")
    got = collections.Counter(map(tuple, jaccard_join.jaccard_components(nulls).collect()))
    assert got == collections.Counter([(None, 1, None), (None, 1, None), ("x", 1, "x"), (None, 1, "x"), (None, 0, None)])


def test_jaccard_pieces_grow_with_a_hot_hash(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "PIECES", 4)
    counts = {11: 2, 22: 3, 33: 8, 44: 9, 55: 100}
    tiers = jaccard_join._tiers(spark.createDataFrame(list(counts.items()), "h long, count long"))
    pieces = {}
    for h in counts:
        for bits, n in tiers:
            if jaccard_join.passes(np.array([h], np.uint64), bits)[0]:
                pieces[h] = n
    assert pieces == {22: 4, 33: 4, 44: 16, 55: 64}
    assert jaccard_join._tiers(spark.createDataFrame([], "h long, count long")) == []


def test_quality(docs, rows, empty):
    got = collections.defaultdict(list)
    for r in quality.quality(docs).collect():
        got[r.id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)) in got[r[0]]
    assert quality.quality(empty).count() == 0


@pytest.mark.parametrize("bad", [lambda *w: F.xxhash64(*w).bitwiseAND(3), lambda *w: F.call_function("shiftleft", F.xxhash64(w[0]), F.lit(58))])
def test_repeated_windows_are_told_by_their_words(spark, monkeypatch, bad):
    """Hashes that put different windows together change nothing."""
    monkeypatch.setattr(quality, "window_hash", bad)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), k)) for k in (0, 1, 2, 3, 4, 30, 30, 100, 400)] + ["a b c d a b c", "a b c a b c", "a a a a"]
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "i int, w array<string>")
    got = {r.i: r.n for r in df.select("i", quality.repeated_window_words(F.col("w"), F.size("w")).alias("n")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        assert got[i] == len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}), t


def test_js_distance(spark):
    p, q = np.array([3.0, 0, 5]), np.array([1.0, 4, 5])
    a, b = p / p.sum(), q / q.sum()
    m = (a + b) / 2
    kl = lambda x: sum(v * math.log2(v / w) for v, w in zip(x, m, strict=True) if v)
    got = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p.tolist())), F.array(*map(F.lit, q.tolist()))).alias("d"), quality.js_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert got.d == pytest.approx(math.sqrt((kl(a) + kl(b)) / 2)) and got.z is None


def _repeats(raws, length):
    seen = collections.Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for b in raws:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append((len(b), sum(cover), sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1])), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return out


def test_suffix(docs, rows, empty):
    raws = [(r[1] or "").encode() for r in rows]
    for length, gram in ((200, 40), (30, 8)):
        want = collections.Counter((r[0], *x) for r, x in zip(rows, _repeats(raws, length), strict=True))
        got = suffix_dedup.remove_repeats(docs, length=length, gram=gram).collect()
        assert collections.Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_names_of_several_texts_are_drawn_anew(docs, rows, monkeypatch):
    real = suffix_dedup.text_names
    monkeypatch.setattr(suffix_dedup, "text_names", lambda t: (F.pmod(real(t)[0], F.lit(7)), real(t)[1]))
    want = collections.Counter((r[0], *x) for r, x in zip(rows, _repeats([(r[1] or "").encode() for r in rows], 200), strict=True))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_suffix_of_a_common_passage(spark):
    """A passage that hundreds of texts hold, at their beginnings, ends and between other words; some texts come twice."""
    rng = np.random.default_rng(12)
    prose = lambda k: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(k))
    passage, long = prose(45), prose(120)
    texts = [f"{prose(int(rng.integers(0, 60)))} {(passage, long)[i % 2]} {prose(int(rng.integers(0, 60)))}"[: (300, 5000)[i % 7 > 0]] for i in range(150)]
    texts += [texts[0], texts[3], passage, long, passage + passage]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(5)).collect()
    want = {(f"d{i}", *x) for i, x in enumerate(_repeats([t.encode() for t in texts], 200))}
    assert {(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.integers(97, 100, rng.integers(0, 9)).astype(np.uint8)) for _ in range(int(rng.integers(0, 40)))) for _ in range(k)]
        coded = [suffix_dedup.front_code(r) for r in runs]
        merged = list(suffix_dedup.merge_runs([iter([(s, int(n), (i, j)) for j, (s, n) in enumerate(zip(r, c[0], strict=True))]) for i, (r, c) in enumerate(zip(runs, coded, strict=True))]))
        flat = [x[0] for x in merged]
        assert flat == sorted(itertools.chain(*runs))
        assert all(n == suffix_dedup._common(a, b, 0) for a, b, n in zip(flat[:-1], flat[1:], [x[1] for x in merged[1:]], strict=True))


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    vocab = ["the", "and", "then", "shade", "ringer", "moth", "tin", "lead", "ocean", "other", "wand"]
    bad = ["idiot", "moron", "worthless"]
    rows, labels = [], []
    for i in range(400):
        t = rng.choice(vocab, 30).tolist()
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                t[int(rng.integers(30))] = str(rng.choice(bad))
        rows.append((i, " ".join(t), "x"))
        labels.append((i, y))
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", None), (1, rows[1][1], "x")], "doc_id long, text string, score string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (5, None), (1, 0)], "doc_id long, toxic int"))
    assert set(bad) <= set(model.weights)
    for t in ("you 1d10t", "a m0r0n", "w o r t h l e s s", "so worthlesss", "MORON!", "m-o-r-o-n", "idiiiot there"):
        assert model.score(t) > 0.5, t
    for t in ("", None, "the moth", "12345 67", "a b c d e", "x" * 100_000):
        assert model.score(t) < 0.5
    got = toxicity.score(docs.withColumnRenamed("score", "other"), model).collect()
    assert len(got) == 403 and all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id < 400)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score("idiot") < 0.5
    assert toxicity.score(docs.limit(0), model, out_col="s").count() == 0


def _insults(spark):
    """A model of prose in which three words are toxic."""
    rng = np.random.default_rng(3)
    vocab = ["you", "are", "a", "such", "man", "the", "then", "shade", "moth", "tin", "lead", "ocean", "other", "wand", "i", "so"]
    rows = [(i, " ".join([*rng.choice(vocab, 30), *(rng.choice(["idiot", "loser", "stupid"], 3) if i % 4 == 0 else [])])) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_spaced_words_are_told_apart(spark):
    model = _insults(spark)
    for t, word in {"you are a l o s e r": "loser", "such a s.t.u.p.i.d man": "stupid", "y o u i d i o t": "idiot", "y o u  i d i o t": "idiot", "i a m a l o s e r": "loser", "y-o-u--l-o-s-e-r": "loser", "o i d 1 0 t": "idiot"}.items():
        assert word in model.restorer.words(t) and model.score(t) > 0.5, (t, model.restorer.words(t))
    for t in ("a b c d e f", "t h e o t h e r m o t h", "s h a d e"):
        assert model.score(t) < 0.5, t


@pytest.mark.parametrize("seed", range(6))
def test_decoding_finds_the_best_of_all_spellings(seed):
    """Random lattices under random models, against all their spellings."""
    rng = np.random.default_rng(seed)
    letters = "abcd"
    for per_letter in (0.0, 2.0):
        model = toxicity.Restorer.of_counts(rng.integers(0, 50, (32, 32, 32)), frozenset({"abc", "cab", "dd", "a"}))
        for _ in range(25):
            slots = []
            for _ in range(int(rng.integers(1, 7))):
                options = rng.choice([*letters, "aa", "dd", "", " "] if per_letter else [*letters, "aa", "dd", ""], int(rng.integers(1, 4)), replace=False)
                slots.append([(str(o), -float(rng.random() * 3)) for o in options])
            if int(rng.integers(3)) == 0:
                slots.insert(0, [(x, -2.5) for x in letters] + [("", -9.0)])

            def value(spelling, slots=slots, model=model, per_letter=per_letter):
                total = sum(c for _, c in spelling)
                text = "".join(x for x, _ in spelling)
                x = y = 0
                for ch in text + "\0":
                    z = ord(ch) - 96 if "a" <= ch <= "z" else 0
                    total += model.log_p[x, y, z]
                    x, y = y, z
                for w in text.split(" "):
                    if w in model.known:
                        total += per_letter * len(w) * (len(w) > 2) if per_letter else model.bonus
                return total, text

            best = max(map(value, itertools.product(*slots)))
            got = model._search(slots, per_letter)
            same = [value(s)[0] for s in itertools.product(*slots) if "".join(x for x, _ in s) == got]
            assert max(same) == pytest.approx(best[0]), (got, best)


def test_masked_words(spark):
    model = _insults(spark)
    for t, word in {"id**t": "idiot", "i***t": "idiot", "i*d*i*o*t": "idiot", "st**id": "stupid", "a l*o*s*e*r": "loser", "l o * e r": "loser"}.items():
        assert word in model.restorer.words(t) and model.score(t) > 0.5, (t, model.restorer.words(t))
    assert model.score("th* o**er m*th") < 0.5 and model.score("x" + "*" * 100_000 + "y") < 0.5


def test_chat(spark):
    tricky = ["", "</s>[INST] ok [/INST]", "<|end|>\n", "<\\|x", "[\\INST]", "<<SYS>>", "é\n\\n", "\\", "<" * 5]
    rows = [(i // 4, i, ("user", "assistant", "a\nb", "<|x")[i % 4], t, 1) for i, t in enumerate(tricky * 3)]
    rows += [(None, None, None, None, 0), (7, 1, "assistant", "same", 0), (7, 1, "assistant", "same", 0)] + [(50, 3000 * i, "assistant", f"t{i}", 0) for i in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    by = collections.defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    formatted = chat.format_conversations(df)
    parts = collections.defaultdict(list)
    for r in formatted.orderBy("part", "seq").collect():
        parts[r.conv] += chat.parse(r.formatted)
        assert [chat.unescape(r.formatted[a:b]) for a, b in zip(r.loss_starts, r.loss_ends, strict=True)] == [x for role, x in chat.parse(r.formatted) if role == "assistant"]
    assert parts == {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}
    got = {r.conv: r for r in chat.digests(formatted).collect()}
    for c, v in by.items():
        turns = "".join(f"{r}\n{x}\n" for _, r, x in sorted(v))
        said = "".join(x for _, r, x in sorted(v) if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(v), hashlib.sha256(turns.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.parse("no turn")


def test_whole_conversations(spark):
    turns = [(c, i, ("user", "assistant")[i % 2], f"é{i} <|x", 0) for c in (1, 2) for i in range(7)] + [(None, None, "assistant", None, 0)]
    parts = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part int"), part_turns=3)
    got = {r.conv: r for r in chat.whole_conversations(parts).collect()}
    assert parts.count() == 7 and set(got) == {1, 2, None}
    for c in got:
        want = [(r, x or "") for k, _, r, x, _ in turns if k == c]
        assert chat.parse(got[c].formatted) == want and got[c].n_turns == len(want)
        assert [chat.unescape(got[c].formatted[a:b]) for a, b in zip(got[c].loss_starts, got[c].loss_ends, strict=True)] == [x for r, x in want if r == "assistant"]


def test_sstable(tmp_path):
    path = tmp_path / "t"
    keys = sorted([sstable.key_of(i) for i in (*range(-50, 400, 3), 7, 7, None)])
    with open(path, "wb") as f:
        w = sstable.Writer(f, block_bytes=64)
        for i, k in enumerate(keys):
            w.add(k, bytes([i % 251]) * (i % 9), 1)
        with pytest.raises(ValueError):
            w.add(sstable.key_of(-99), b"", 0)
        w.close()

    class File:
        def __init__(self):
            self.data = path.read_bytes()

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            return self.data[at : at + n]

    r = sstable.Reader(File())
    assert len(r.blocks) > 5 and [k for k, _ in r] == keys and r.entries == len(keys)
    assert len(r.get(sstable.key_of(7))) == 3 and r.get(sstable.key_of(8)) == [] and len(r.get(b"")) == 1
    assert sum(r.may_hold(sstable.key_of(i)) for i in range(10_000, 12_000)) < 100
    assert [sstable.value_of(k) for k in keys[:2]] == [None, -50] and sstable.value_of(sstable.key_of("é")) == "é"


def test_token_tables(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tok = Tokenizer.from_file(path)
    more = ["Hello, World... it's <|endoftext|>x A\x1cb!", "naïve café. İstanbul, ß.", "x" * 300 + " y", "1,2 3.,"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = collections.defaultdict(list)
    for r in [*[(r[0], r[1]) for r in rows], *[(10_000 + i, t) for i, t in enumerate(more)]]:
        texts[r[0]].append(r[1] or "")
    manifest = token_tables.write_tables(df, path, shards=3).cache()
    start = 0
    for r in token_tables.read_tables(manifest, 2).orderBy("start").collect():
        ids = [*tok.encode(texts[r.id][0], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_tables.lookup(spark, manifest, 10_001, 2) == [[*tok.encode(more[1], add_special_tokens=False).ids, 1]]
    assert token_tables.lookup(spark, manifest, -5, 2) == []
    assert token_tables.read_tables(token_tables.write_tables(empty, path), 2).count() == 0
    old, token_tables.SEGMENT = token_tables.SEGMENT, 100
    long = "some words, with\nlines " * 40
    assert b"".join(token_tables.encode_all([long], path, 2)) == np.array(tok.encode(long, add_special_tokens=False).ids, "<u2").tobytes()
    token_tables.SEGMENT = old


def test_token_tables_of_string_identifiers(spark):
    df = spark.createDataFrame([("b", "two words"), ("é", None), (None, "x"), ("a", "one"), ("a", "other"), ("", "y")], "doc_id string, text string")
    manifest = token_tables.write_tables(df, tokenizer_path(), shards=2).cache()
    got = [r.id for r in token_tables.read_tables(manifest, 2).orderBy("start").collect()]
    assert got == [None, "", "a", "a", "b", "é"]
    assert len(token_tables.lookup(spark, manifest, "a", 2)) == 2 and token_tables.lookup(spark, manifest, "zz", 2) == [] and len(token_tables.lookup(spark, manifest, None, 2)) == 1
    with pytest.raises(TypeError):
        token_tables.write_tables(df.select(F.lit(1.5).alias("doc_id"), "text"), tokenizer_path())


def test_a_tokenizer_that_crosses_spaces_gets_whole_texts(spark, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello, World... it's x", "", "a  b\nc", "naïve café. 1,2"]
    spec = json.loads(open(tokenizer_path()).read())
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    for path, how in ((tokenizer_path(), "folded"), (str(tmp_path / "t.json"), "pieces"), (public_tokenizers.path("byte_bpe_50k.json"), "whole")):
        assert token_tables.piecewise(path) == how
        tok, width = Tokenizer.from_file(path), token_tables.id_width(path, 1)
        assert list(token_tables.encode_all(texts, path, width)) == [np.array(tok.encode(t, add_special_tokens=False).ids, f"<u{width}").tobytes() for t in texts]


def _kept_lines(rows, least):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    own = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= least:
                own[key(x)] = min(own.get(key(x), 1 << 60), r[0])
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if own.get(key(x), r[0]) == r[0]]
        yield r[0], "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(docs, rows, empty, batches):
    got = line_dedup.dedup_lines(docs, batches=batches, buckets=4)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(_kept_lines(rows, 10))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_buckets_grow_with_the_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKETS", 1)
    monkeypatch.setattr(line_dedup, "BUCKET_KEYS", 7)
    made = []
    real = line_dedup.LineStore
    monkeypatch.setattr(line_dedup, "LineStore", lambda *a: made.append(a) or real(*a))
    assert collections.Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == collections.Counter(_kept_lines(rows, 10))
    assert made[0][2] > 5


def test_lines_of_string_identifiers(docs, rows):
    """Their order is that of the strings; here the same as of the numbers."""
    named = docs.withColumn("doc_id", F.format_string("d%06d", "doc_id")).withColumn("doc_id", F.when(F.col("doc_id") != "dnull", F.col("doc_id")))
    want = collections.Counter((None if i is None else f"d{i:06d}", *rest) for i, *rest in _kept_lines(rows, 10))
    assert collections.Counter(tuple(r) for r in line_dedup.dedup_lines(named).collect()) == want


def test_shards_without_any_bytes(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), (None, None)], "doc_id string, text string")
    got = sharding.byte_shards(df, 4, pad=0).collect()
    assert sorted((r.shard, r.slot, r.size) for r in got) == [(0, 0, 0), (0, 1, 0), (0, 2, 0)]


def test_line_store_levels(spark, docs):
    from loomgraph.llm.scratch import fresh_path

    store = line_dedup.LineStore(spark, fresh_path(spark, "t"), 4, fanout=2)
    keys = line_dedup.line_keys(docs)
    for i in range(4):
        store.add(keys.filter(F.col("doc") % 4 == i))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    assert store.add(keys).select("h1", "h2").distinct().count() == keys.select("h1", "h2").distinct().count()


def test_mixing(spark, docs, rows, empty):
    path = {"lang": F.col("lang"), "source": F.col("source")}
    weights = ({"en": 3.0, "fr": 1.0}, {"src1": 2.0, "src2": 0.0})
    got = mixing.mix(docs, path, weights, share=0.7, max_epochs=3, seed=5)
    out = got.collect()
    tokens = lambda t: len(WORD.findall(t or ""))
    used, budget = collections.Counter(), {}
    for r in out:
        used[r.mix_lang, r.mix_source] += r.mix_tokens
        budget[r.mix_lang, r.mix_source] = r.mix_budget
        assert r.mix_tokens == tokens(r.text)
    assert all(used[k] <= budget[k] for k in used)
    total = sum(tokens(r[1]) for r in rows)
    assert sum(budget.values()) <= 0.7 * total
    assert not any(k[1] == "src2" and v for k, v in used.items())
    assert collections.Counter((r.doc_id, r.mix_epoch) for r in out if r.mix_epoch == 0).keys() <= {(r[0], 0) for r in rows}
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(docs.repartition(2), path, weights, share=0.7, max_epochs=3, seed=5).collect()))
    assert mixing.mix(docs, path, weights, details=False).columns == docs.columns
    assert mixing.mix(empty, path, weights).count() == 0
    one = mixing.mix(docs, path, ({}, {}), share=1.0, max_epochs=1, seed=1)
    assert one.count() == len(rows)


def test_mixing_by_radix_is_mixing_by_sorting(spark, monkeypatch):
    rows = [(i // 2, "w " * (i % 5), ("a", "b")[i % 7 > 0], "theirs", i, i) for i in range(600)] + [(None, "w w", "a", None, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, mix_epoch string, _mix_0 int, mix_lang int")
    run = lambda: mixing.mix(df, {"lang": F.col("lang")}, ({"a": 3.0},), share=0.37, max_epochs=2, seed=3)
    want = run()
    assert want.columns == [*df.columns, "mix_lang_", "mix_epoch_", "mix_tokens", "mix_budget"]
    want = sorted(map(str, want.collect()))
    monkeypatch.setattr(mixing, "SORTED", 0)
    assert sorted(map(str, run().collect())) == want and all("theirs" in r or "None" in r for r in want)
    assert mixing.mix(df, {"lang": F.col("lang")}, ({},), details=False).columns == df.columns


def test_budget_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, s string, tokens long")
    got = {(r.d, r.s): r.budget for r in mixing.budgets(leaves, ["d", "s"], ({}, {}), F.lit(600.0), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 290, ("b", "z"): 300}
    got = {(r.d, r.s): r.budget for r in mixing.budgets(leaves, ["d", "s"], ({"b": 9.0}, {}), F.lit(1500.0), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 490, ("b", "z"): 1000}


def _align(item, region):
    h = np.zeros((len(item) + 1, len(region) + 1), int)
    for i, j in itertools.product(range(1, len(item) + 1), range(1, len(region) + 1)):
        h[i, j] = max(0, h[i - 1, j - 1] + (1 if item[i - 1] == region[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        s, x, y = decontaminate.align(a, b)
        assert s == _align(a, b) and (s == 0 or _align(a, b[x:y]) == s)


def test_decontamination(spark, empty):
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    prose = lambda k: rng.choice(vocab, k).tolist()
    items = [prose(int(rng.integers(15, 40))) for _ in range(12)]
    rows, want = [], set()
    for i in range(120):
        t = prose(80)
        k = i % 12
        if i % 3 == 0:  # exact, with a replaced, a dropped and an added word in turn
            w = list(items[k])
            for j in range(4, len(w) - 4, 9):
                w[j : j + 1] = ([w[j]], ["zzz"], [], [w[j], "yyy"])[i // 3 % 4]
            t[30:30] = ["(" + w[0].upper(), *w[1:]]
            want.add((i, k))
        rows.append((i, ", ".join(t) if i % 2 else " ".join(t), "c"))
    rows += [(500, None, None), (501, "", None), rows[0], (None, " ".join(items[0]), None), (502, "word " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string")
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "ab cd")], "item_id long, text string")
    got = decontaminate.contaminated(docs, tests).collect()
    assert {(r.id, r.item) for r in got} == want and len(got) == len(want)
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), tests).count() == 0


def test_decontamination_misses_no_edited_copy(spark):
    """Copies with an edit every two to seven words, of all kinds, against alignments of all pairs; no other text holds what the edits made."""
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)]
    prose = lambda k: rng.choice(vocab, k).tolist()
    items = [prose(30), *(prose(int(rng.integers(3, 36))) for _ in range(11)), ["on", "on"] * 8]
    rows = []
    for i in range(240):
        w = list(items[i % 13])
        every, kind = 2 + i % 6, i // 6 % 4
        for j in reversed(range(every, len(w), every + (kind != 2))):
            new = f"new{i}x{j}"
            w[j : j + 1] = ([new], [], [new, w[j]], ([new], [], [new, w[j]])[int(rng.integers(3))])[kind]
        rows.append((i, " ".join([*prose(20), *w, *prose(20)])))
    w = list(items[0])
    w[5::6] = [f"alone{j}" for j in range(5)]  # runs of five words: 25 - 4 edits
    rows.append((900, " ".join(w)))
    want = {}
    for i, text in rows:
        for k, item in enumerate(items):
            number = {v: n for n, v in enumerate(dict.fromkeys(item))}
            s = decontaminate.align(np.array([number[v] for v in item]), np.array([number.get(v, -1) for v in text.split()]))[0]
            if s >= 0.5 * len(item):
                want[i, k] = s
    assert want[900, 0] == 21 and 100 < len(want) < 240
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.id, r.item): r.score for r in got} == want


def test_decontamination_of_short_items(spark):
    docs = spark.createDataFrame([(1, "so Alpha, said"), (2, "beta gamma!"), (3, "beta or gamma"), (4, "delta eps zeta"), (5, "alphabet"), (6, "alpha"), (7, "eps zeta it")], "doc_id long, text string")
    items = [(10, "alpha"), (11, "beta, gamma"), (12, "delta eps zeta"), (13, ""), (14, "unseen")]
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.id, r.item, r.score, r.start, r.end) for r in got} == {(1, 10, 1, 1, 2), (6, 10, 1, 0, 1), (2, 11, 2, 0, 2), (4, 12, 3, 0, 3), (7, 12, 2, 0, 2)}


def test_pieces_of_latin_letters_are_merged_at_once():
    """Words and the marks behind them have the IDs of the whole text, without a call of the tokenizer for each word."""
    from loomgraph.llm.entry import tokenizer_path

    path = tokenizer_path()
    texts = ["ÉTÉ. Straße, µ ª º ÿ Àb", "a..,, x., <s> </s> pad [UNK] it's", "日本 x\ty", "Wort*** ab&&& x$#,. é!? a-b- it's. - *** \"Wort\" s>, &</s>"]
    pieces = token_tables._Pieces(path, 4, True)
    plain = pieces.tok
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert token_tables.encode_texts(texts, path, 4, True) == want
    pieces._whole = None
    assert pieces["Straße"] == np.array(plain.encode("Straße", add_special_tokens=False).ids, "<u4").tobytes()
