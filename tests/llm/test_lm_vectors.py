"""Hard negatives, the class language model, centroids and the toxicity score, against plain Python."""

import collections
import hashlib
import math
import os
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import centroids, class_lm, hard_negatives, toxicity, vectors

VECTORS = "vec_id long, embedding array<float>, label int, score string, `q` int"
FULL = "/root/testdata/sf0.1"


# ---- Vectors --------------------------------------------------------------------------------


def odd_vectors(seed=1, n=160, dims=6):
    """Random vectors with many copies, ties, nulls, infinities, wrong lengths and negative identifiers."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = (rng.integers(-4, 5, dims) / 4).tolist() if i % 3 else [0.5] * dims
        out.append((i * 10 - 50, v, int(rng.integers(3)) if i % 11 else 1, "clash", i))
    out[7] = (*out[7][:2], None, None, None)
    bad = [None, [0.1] * (dims - 1) + [None], [0.1] * (dims - 1) + [float("nan")], [float("inf")] * dims]
    return out + [(10_000 + i, v, 1, None, None) for i, v in enumerate(bad)] + [(None, [0.25] * dims, 1, None, None)]


def plain_negatives(rows, positives=5, k=10):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, q in kept:
        if a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, p, strict=True)), i, other) for i, other, p in kept if i != a))
        for s, i, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [(j, -t) for t, j, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out += [(a, i, r, j, -s, t) for r, (j, t) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    rows = odd_vectors()
    if small:  # many tiles, digits of scores and of identifiers
        monkeypatch.setattr(hard_negatives, "ROWS", 50)
        monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
        monkeypatch.setattr(hard_negatives, "BUCKETS", 16)
        monkeypatch.setattr(hard_negatives, "SPARE", 1)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(df, is_anchor=F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == plain_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(none, is_anchor=F.col("id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, None, None), (0, [2.0], 1, None, None), (5, [1.0, 2.0], 2, None, None)], VECTORS)
    assert hard_negatives.hard_negatives(alone, is_anchor=F.col("id") % 100 == 0).count() == 0  # repeated identifiers are one row


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    c = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), -(10**9) if r[0] is None else r[0], r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        to = [min((dist(q, x), j) for j, x in enumerate(c)) for _, q in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [q for (_, q), (_, t) in zip(kept, to, strict=True) if t == j]
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)] if own else c[j]
    sums = collections.Counter()
    for d, j in to:
        sums[j] += d
    return sorted((repr(i), j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, to, strict=True))


@pytest.mark.parametrize("k", [1, 2, 12, 1000])
def test_centroids(spark, k):
    rows = odd_vectors(3)
    got = centroids.cluster(spark.createDataFrame(rows + rows[:3], VECTORS).repartition(3), k=k, dims=6)
    have = sorted((repr(r.id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect())
    assert have == plain_clusters(rows + rows[:3], k, 5, 6)


def test_centroids_of_nothing(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0


def test_bounds_certify_and_hold():
    """Bounds stay below true distances over many moves, and most vectors need no distance."""
    rng = np.random.default_rng(4)
    centre = rng.integers(-900, 900, (20, 5)).astype(float)
    x = np.rint(centre[rng.integers(20, size=3000)] + rng.normal(0, 20, (3000, 5)))
    s = centroids.first_bounds(x, centre, 5)
    for _ in range(6):
        new = centre + rng.integers(-3, 4, centre.shape)
        moves = centroids._up(((new - centre) ** 2).sum(1).astype(np.int64))
        s, centre = centroids.moved_bounds(s, x, new, moves, 5), new
        d = centroids._squares(x, centre)
        assert (s["cluster"] == d.argmin(1)).all()
        true = np.sqrt(d.astype(float))
        assert (s["low"] <= np.take_along_axis(true, s["near"], 1) + 1e-9).all()
        others = true.copy()
        np.put_along_axis(others, np.column_stack((s["cluster"], s["near"])), np.inf, axis=1)
        assert (s["rest"] <= others.min(1) + 1e-9).all()
        assert (s["used"] == 0).mean() > 0.9


def test_large_components_are_exact():
    x = np.array([[1 << 26, -(1 << 26), 1]], float)
    assert vectors.products(x, x, float(1 << 26))[0, 0] == 2 * (1 << 52) + 1
    assert centroids._squares(x, -x)[0, 0] == 4 * (2 * (1 << 52) + 1)


# ---- The class language model -----------------------------------------------------------------

DOCS = "doc_id string, text string, lang string, score double"


def prose(seed=1, n=90):
    """Two languages of nouns and verbs in turn, with odd texts, nulls and copies."""
    rng = np.random.default_rng(seed)
    kinds = [[f"{tongue}{kind}{i}" for i in range(30)] for tongue in "xy" for kind in ("n", "v")]
    out = []
    for i in range(n):
        two = kinds[:2] if i % 2 else kinds[2:]
        out.append(" ".join(str(rng.choice(two[j % 2])) for j in range(int(rng.integers(1, 40)))))
    out += ["", None, " \t\n\x0b", "É é É \x1cA a", out[0], out[0].upper(), "z" * 100_000, "w " * 30_000]
    return [(str(i), t, "en", None) for i, t in enumerate(out)] + [(None, "xn1 nobody", None, None)]


def plain_tokens(text):
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def is_train(i):
    return i is not None and zlib.crc32(i.encode()) % 10 != 0


def test_class_model(spark):
    rows = prose()
    train = F.crc32(F.col("doc_id")) % 10 != 0
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {(r.id, r.n_tokens): r for r in class_lm.score_documents(df, train=train, classes=8, part_tokens=500, core_share=130).collect()}
    c = collections.Counter(w for i, t, *_ in rows if is_train(i) for w in plain_tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len({(i, len(plain_tokens(t))) for i, t, *_ in rows})
    for i, t, *_ in rows:
        words = plain_tokens(t)
        r = got[i, len(words)]
        assert (r.n_known, r.train_tokens) == (sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    held = [got[i, len(plain_tokens(t))] for i, t, *_ in rows[:90] if not is_train(i)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_class_model_against_a_plain_version(spark):
    """The score from the words' classes alone: transitions, emissions, and the unknown type, in plain loops."""
    rows = [r for r in prose(5) if r[1] is not None and len(r[1]) < 1000]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    train = F.crc32(F.col("doc_id")) % 10 != 0
    classes, strength = 8, 64.0
    held = {}
    real = class_lm.rare_words
    exchanged = class_lm.exchange

    def rare(parts, core, cls, m, k):
        out = real(parts, core, cls, m, k)
        held["core"] = {w: int(cls[i]) for w, i in core().items()}
        own = {r.part: r.words.split(b" ") for r in parts.select("part", "words").collect()}
        held["rare"] = {own[r.part][code]: kind for r in out.collect() for code, kind in zip(np.frombuffer(r.codes, np.int32), np.frombuffer(r.classes, np.uint8), strict=True)}
        return out

    def course(*a):
        cls, m, steps = exchanged(*a)
        assert all(b >= a for a, b in zip(steps, steps[1:], strict=False)) and steps[-1] > steps[0]
        return cls, m, steps

    class_lm.rare_words, class_lm.exchange = rare, course
    try:
        got = {r.id: r.score for r in class_lm.score_documents(df, train=train, classes=classes, part_tokens=300, core_share=150, strength=strength).collect()}
    finally:
        class_lm.rare_words, class_lm.exchange = real, exchanged
    c = collections.Counter(w for i, t, *_ in rows if is_train(i) for w in plain_tokens(t))
    kind = {**held["rare"], **held["core"]}
    assert {w for w in kind if c[w] == 0} == {w for w in kind if kind[w] == classes}
    to, once, per = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        if is_train(i):
            last, rare_last = 1, False
            for w in plain_tokens(t):
                for a in [last] + [classes] * rare_last:
                    to[a, kind[w]] += 1
                    once[a] += c[w] == 1
                per[kind[w]] += 1
                last, rare_last = kind[w], c[w] == 1
    n = sum(c.values())
    p0 = (sum(x == 1 for x in c.values()) + 0.1) / (n + 0.2)
    total = lambda a: sum(to[a, b] for b in range(classes))
    unknown = lambda a: (once[a] + strength * p0) / (total(a) + strength)
    known = lambda a, b: (1 - unknown(a)) * (to[a, b] + strength * per[b] / n) / (total(a) + strength)
    for a in range(classes + 1):
        assert unknown(a) + sum(known(a, b) for b in range(classes)) == pytest.approx(1)
    for i, t, *_ in rows:
        last, want = 1, 0.0
        for w in plain_tokens(t):
            k = kind[w] if c[w] else classes
            want += math.log10(known(last, k) * c[w] / per[k] if c[w] else unknown(last))
            last = k
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_gains_of_moves_are_exact():
    rng = np.random.default_rng(2)
    words, classes = 12, 4
    n = rng.integers(0, 4, (words, words)).astype(float)
    cls = rng.integers(0, classes, words)

    def counts(cls):
        m = np.zeros((classes, classes))
        np.add.at(m, (cls[:, None], cls[None, :]), n)
        return m

    m = counts(cls)
    for w in range(words):
        left, right = np.bincount(cls, n[:, w], classes), np.bincount(cls, n[w], classes)
        gain = class_lm.move_gains(m, left, right, int(cls[w]), n[w, w])
        for to in range(classes):
            new = cls.copy()
            new[w] = to
            assert gain[to] == pytest.approx(class_lm.objective(counts(new)) - class_lm.objective(m), abs=1e-9)


def test_class_model_never_moves_whole_parts(spark, monkeypatch):
    """Texts go to their words' classes in slices, and a part's words in a piece of each task, whatever the batches."""
    rows = prose(7)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    train = F.crc32(F.col("doc_id")) % 10 != 0
    run = lambda: class_lm.score_documents(df, train=train, classes=8, part_tokens=2000, core_share=130)
    kept = lambda: sorted((repr(r.id), r.n_tokens, r.base_score, r.score) for r in run().collect())
    want = kept()
    staged, real = {}, class_lm.stage
    monkeypatch.setattr(class_lm, "stage", lambda d, name: staged.setdefault(name, (real(d, name), d))[0])
    monkeypatch.setattr(class_lm, "SLICE", 64)
    before = spark.conf.get(class_lm._BATCH)
    spark.conf.set(class_lm._BATCH, "7")
    try:
        assert kept() == want
    finally:
        spark.conf.set(class_lm._BATCH, before)
    assert "CoGroup" not in staged["lm-coded"][1]._jdf.queryExecution().optimizedPlan().toString()
    per_part = [r["count"] for r in staged["lm-words"][0].groupBy("part").count().collect()]
    assert per_part and max(per_part) <= 4  # shuffle partitions
    parts = staged["lm-parts"][0]
    found = class_lm.spread(parts, lambda: {b"": 1}, np.array([0, 1]), np.array([0, 9])).collect()
    for p in parts.collect():
        own = [r for r in found if r.part == p.part]
        assert [(bytes(r.codes), bytes(r.counts), bytes(r.classes)) for r in own if r.lengths is None] == [(np.int32([0]).tobytes(), np.int64([9]).tobytes(), b"\1")]
        slices = [r for r in own if r.lengths is not None]
        assert b"".join(bytes(r.codes) for r in slices) == bytes(p.codes)
        for name in ("ids", "train", "lengths"):
            assert [x for r in slices for x in r[name]] == p[name]
        assert all(sum(r.lengths[:-1]) < 64 for r in slices) and all(4 * sum(r.lengths) == len(r.codes) for r in slices)


def test_neighbours_are_dealt_out_by_their_number(spark, monkeypatch):
    """A partition of the exchange is read as one batch, so it must not grow with the pairs; the classes stay the same."""
    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(1, 40, (600, 2))})
    df = spark.createDataFrame([(a, b, 1 + (a * b) % 5) for a, b in pairs], "prev int, cur int, n long")
    staged, real = [], class_lm.stage
    monkeypatch.setattr(class_lm, "stage", lambda d, name: staged.append(d) or real(d, name))
    want = class_lm.exchange(df, 40, 1, 6, 3)
    monkeypatch.setattr(class_lm, "NEAR", 64)
    got = class_lm.exchange(df, 40, 1, 6, 3)
    assert [d.rdd.getNumPartitions() for d in staged] == [1, 2 * len(pairs) // 64]
    assert (got[0] == want[0]).all() and got[2] == want[2]


def test_class_model_without_training_rows(spark):
    df = spark.createDataFrame([("a", "x y", None, None), ("b", None, None, None)], DOCS)
    got = class_lm.score_documents(df, train=F.lit(False)).collect()
    assert sorted((r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [("a", 3, 0, 0, 0.0, 0.0), ("b", 1, 0, 0, 0.0, 0.0)]
    assert class_lm.score_documents(spark.createDataFrame([], DOCS), train=F.lit(True)).count() == 0


# ---- Toxicity ---------------------------------------------------------------------------------


def toxic_prose(n=400):
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghil"), rng.integers(3, 8))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        t = " ".join(rng.choice(vocab, int(rng.integers(5, 60))))
        bad = i % 4 == 0
        if bad:
            t += " " + rng.choice(["grobian", "gr0bian", "scoundrel", "sc0undr3l", "g r o b i a n", "scouuundrel"])
        docs.append((i, t))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_against_a_plain_version(spark):
    """Counts, odds, significance, features and the logistic fit, written out; spellings come from the restorer."""
    docs, labels = toxic_prose()
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    tri = np.zeros((32, 32, 32))
    code = lambda ch: ord(ch.lower()) - 96 if ch.isascii() and ch.isalpha() else 0
    for _, t in docs:
        k = [code(ch) for ch in f"  {t}  "]
        for a, b, c in zip(k, k[1:], k[2:], strict=False):
            tri[a, b, c] += 1
    plain = toxicity.Restorer.of_counts(tri)
    assert np.allclose(model.restorer.log_p, plain.log_p)

    def terms(words):
        return [x for w in words for x in [w, *(w[:k] + "~" for k in (4, 7) if len(w) > k)]]

    y = dict(labels)
    n = [sum(v == k for v in y.values()) for k in (0, 1)]
    seen = collections.defaultdict(lambda: [0, 0])
    for i, t in docs:
        for w in set(terms(plain.words(t))):
            seen[w][y[i]] += 1
    weights = {}
    for w, (a, b) in seen.items():
        expect = (a + b) * n[1] / sum(n)
        if abs((b - expect) / math.sqrt(expect + 0.5)) > 4.5:
            weights[w] = math.log((b + 0.1) / (n[1] + 1)) - math.log((a + 0.1) / (n[0] + 1))
    assert set(weights) == set(model.weights) and all(model.weights[w] == pytest.approx(x) for w, x in weights.items())
    known = toxicity.Restorer(plain.log_p, frozenset(weights))

    def features(t):
        words = known.words(t)
        hits = [weights[x] for x in terms(words) if x in weights]
        up = [h for h in hits if h > 0]
        return [1.0, max(up, default=0.0), math.log1p(sum(up)), math.log1p(len(up)), sum(hits) / math.sqrt(1 + len(words))]

    x = np.array([features(t) for _, t in docs])
    target = np.array([y[i] for i, _ in docs])
    p = 1 / (1 + np.exp(-x @ model.coef))
    slope = x.T @ (target - p) - np.array([1e-6, 1, 1, 1, 1]) * model.coef  # 0 at the penalised optimum
    assert np.abs(slope).max() < 1e-4
    for i, t in docs[:80]:
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-float(np.dot(features(t), model.coef)))), rel=1e-9)


def test_long_strings_take_linear_time():
    model = toxicity.Restorer.of_counts(np.ones((32, 32, 32)), frozenset({"hello", "acgt"}))
    for text in ("acgt" * 500_000 + " x1y", "acgt" * 500_000 + "1 x", "a1" + "bcd" * 500_000, "a" + "*" * 500_000 + "b", "f*ck " * 50_000, "a b " * 20_000):
        began = time.time()
        model.words(text)
        assert time.time() - began < 20, text[:10]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    n = 24_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('plain words ', if(id % 4 = 0, 'grobian', 'kind'), ' w', id % 7) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "cast(id % 8 = 0 or id % 1000 = 1 as int) as toxic")
    bad = {i for i in range(n) if i % 8 == 0 or i % 1000 == 1}
    with_word = sum(i % 4 == 0 for i in bad)
    model = toxicity.fit(docs, labels)
    want = math.log((with_word + 0.1) / (len(bad) + 1)) - math.log((n / 4 - with_word + 0.1) / (n - len(bad) + 1))
    assert model.weights["grobian"] == pytest.approx(want, rel=1e-12)
    monkeypatch.setattr(toxicity, "TERMS", 3)  # told in parts
    again = toxicity.fit(docs.repartition(3), labels)
    assert again.weights == model.weights and (again.coef == model.coef).all()


def test_toxicity_joins_labels_alike_at_any_size(spark, monkeypatch):
    plans, real = [], toxicity.stage

    def kept(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, *rest)

    monkeypatch.setattr(toxicity, "stage", kept)
    docs = spark.createDataFrame([(1, "kind"), (2, "foul"), (2, "foul again"), (3, None), (None, "lost")], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int"))
    executed = dict(plans)["toxicity-labelled"]
    assert "ShuffledHashJoin" in executed and "Broadcast" not in executed  # few labels go the way that many go


def test_logistic_rows_in_buckets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 4))
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    monkeypatch.setattr(toxicity, "BUCKET", 64)
    rows = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "y int, a double, b double, c double, d double")
    got = toxicity.fit_logistic_rows(rows, 900)
    assert np.allclose(got, toxicity.fit_logistic(x, y), rtol=1e-9)
    assert (got == toxicity.fit_logistic_rows(rows.repartition(7), 900)).all()


@pytest.mark.skipif(not os.path.isdir(FULL), reason="needs the test tables")
def test_toxicity_finds_held_out_cases(spark):
    from loomgraph.llm.entry import QUERIES

    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FULL}/labels.parquet").collect() if r.toxic is not None}
    rows = [(r.score, truth[r.doc_id]) for r in QUERIES["op5_restored_toxicity"](spark, FULL).filter("held_out").collect() if r.doc_id in truth]
    bad = [s for s, y in rows if y]
    assert sum(s >= 0.5 for s in bad) >= 0.9 * len(bad) and sum(s >= 0.5 for s, y in rows if not y) <= 0.01 * len(rows)
