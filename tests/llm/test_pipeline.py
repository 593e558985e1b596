"""The pipeline against a plain Python version, and the registered queries against what can be checked by hand."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from loomgraph.llm import decontaminate, toxicity
from loomgraph.llm.entry import MIX_WEIGHTS, QUERIES, tokenizer_path

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r.text or "").translate(table))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a, r in enumerate(rows):
        least[find(a)] = min(least.get(find(a), r.doc_id), r.doc_id)
    return [r for a, r in enumerate(rows) if r.doc_id == least[find(a)]]


def leaks(text, items):
    doc = decontaminate.fold(text or "")
    for item in items:
        number = {w: k for k, w in enumerate(dict.fromkeys(item))}
        region = np.array([number.get(w, -1) for w in doc])
        if np.count_nonzero(region >= 0) >= 0.5 * len(item) and decontaminate.align(np.array([number[w] for w in item]), region)[0] >= 0.5 * len(item):
            return True
    return False


def fill(children, given):
    """Shares of a family by repeated division of what is left."""
    share, open_, left = {}, dict(children), given
    while open_:
        total = sum(w for _, w in open_.values())
        full = {k for k, (c, w) in open_.items() if c <= left * w / total + 1e-9}
        if not full:
            return {**share, **{k: left * w / total for k, (_, w) in open_.items()}}
        for k in full:
            share[k] = open_.pop(k)[0]
        left = given - sum(share.values())
    return share


def mixed(rows, share, epochs, seed):
    def path(r):
        m = re.search(r"([0-9]+)$", r.source or "")
        return (f"d{int(m[1]) // 5 if m else 0}", r.lang or "", r.source or "")

    tokens = {id(r): len(WORD.findall(r.text or "")) for r in rows}
    cap = collections.Counter()
    for r in rows:
        for k in range(4):
            cap[path(r)[:k]] += tokens[id(r)] * epochs
    budget = {(): float(int(cap[()] / epochs * share))}
    for k in (1, 2, 3):
        for up in [p for p in budget if len(p) == k - 1]:
            kids = {p: (cap[p], MIX_WEIGHTS[k - 1].get(p[-1], 1.0)) for p in cap if len(p) == k and p[:-1] == up}
            budget.update(fill(kids, budget[up]))
    out = []
    for leaf in [p for p in budget if len(p) == 3]:
        own = [r for r in rows if path(r) == leaf]
        size, b = sum(tokens[id(r)] for r in own), int(budget[leaf] + 1e-6)
        whole = b // size if size else 0
        own.sort(key=lambda r: (int(hashlib.md5(f"{seed}|{whole}|{r.doc_id}".encode()).hexdigest()[:15], 16), r.doc_id))
        rest = b - whole * size
        for r in own:
            rest -= tokens[id(r)]
            out += [r] * (whole + (rest >= 0))
    return out


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    steps = []
    for name, f in pipeline.STAGES:
        docs = spark.createDataFrame((out := f(spark, docs, DATA)).collect(), out.schema)
        steps.append(docs.collect())
        assert name == "token_tables" or docs.columns == columns
    start = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.fit(start, spark.read.parquet(f"{DATA}/labels.parquet").filter("crc32(cast(doc_id as string)) % 5 != 0"))
    rows = [r for r in start.collect() if model.score(r.text) < 0.5]
    key = lambda rs: sorted(r.doc_id for r in rs)
    assert key(steps[0]) == key(rows)
    rows = near_copies(rows)
    assert key(steps[1]) == key(rows)
    items = [decontaminate.fold(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [r for r in rows if not leaks(r.text, items)]
    assert key(steps[2]) == key(rows)
    rows = mixed(rows, 0.8, 2, 17)
    assert key(steps[3]) == key(rows)
    tok = Tokenizer.from_file(tokenizer_path())
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r.doc_id, zlib.crc32((r.text or "").encode()))):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, steps[4])) == sorted(want)
    assert sorted(map(tuple, pipeline.run(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)


def test_queries_run_and_say_what_they_should(spark):
    wanted = {
        "op1": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op2": {"doc_id", "n_shingles", "component_id"},
        "op3": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op4": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op5": {"doc_id", "held_out", "score", "predicted"},
        "op6": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
        "op7": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op8": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
        "op9": {"doc_id", "domain", "lang", "source", "epoch"},
        "op10": {"doc_id", "item_id", "score"},
        "op11": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
        "op12": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op13": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    }
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert {name.split("_")[0] for name in QUERIES} == set(wanted)
    for name, f in QUERIES.items():
        df = f(spark, DATA)
        op = name.split("_")[0]
        assert wanted[op] <= set(df.columns), name
        assert op in ("op6", "op9", "op10", "op11", "op13") or df.count() == n


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.score) for r in QUERIES["op5_restored_toxicity"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.75 and sum(s >= 0.5 for s in neg) <= 2


def test_near_duplicates_of_one_identifier(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(7, text(0)), (7, text(1)), (3, text(1) + " more"), (9, text(2)), (9, text(3)), (9, text(3)), (None, text(3)), (None, text(4)), (None, text(4)), (None, None), (5, None), (6, "")]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[3], rows[4], rows[7], rows[9], rows[10], rows[11]], key=str)


def test_stages_on_odd_tables(spark):
    """Nulls, empty and repeated texts, one doc_id for different texts, and columns called like those that stages make."""
    clashes = ["score", "_row", "row", "id", "component", "name", "h", "part", "_mix_0", "mix_epoch", "key", "t", "text_", "n_tokens", "start", "_mix_taken"]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(2).collect()]
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    texts = [(1, prose(1)), (1, prose(1)), (1, prose(2)), (2, "see " + items[0]), (2, prose(3)), (None, prose(4)), (None, items[1]), (None, None), (3, None), (4, ""), (5, "a b"), (6, "x " * 200_000), (7, prose(5) + " end")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clashes)
    rows = [(i, t, ("en", None)[k % 2], (None, f"src{k % 3}")[k % 4 > 0], k % 2, *("theirs" for _ in clashes)) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    pairs = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    clean = pipeline.toxicity(spark, docs, DATA)
    assert clean.columns == docs.columns and pairs(clean) == collections.Counter(texts)
    once = pipeline.near_duplicates(spark, docs, DATA)
    assert once.columns == docs.columns and pairs(once) == collections.Counter(set(texts))
    pure = pipeline.decontamination(spark, docs, DATA)
    assert pure.columns == docs.columns and pairs(pure) == collections.Counter(x for x in texts if x[1] not in ("see " + items[0], items[1]))
    mixed_ = pipeline.mixing(spark, docs, DATA)
    assert mixed_.columns == docs.columns and set(pairs(mixed_)) <= set(texts) and all(r.score == "theirs" for r in mixed_.collect())
    assert pipeline.token_tables(spark, docs, DATA).count() == len(texts)
    empty = docs.limit(0)
    assert [f(spark, empty, DATA).count() for _, f in pipeline.STAGES] == [0] * 5


def test_rarity_counts_all_texts(spark, monkeypatch):
    """Word pairs that a text holds are no rare ones, whichever text it is: a sample of texts missed most of them."""
    seen = []
    stage = decontaminate.stage
    monkeypatch.setattr(decontaminate, "stage", lambda df, name: seen.append((name, stage(df, name))) or seen[-1][1])
    words = [f"item{chr(97 + k)}" for k in range(20)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for k in range(3):
        docs = spark.createDataFrame([(1, " ".join([f"text{k}", *words[:7], "end"]))], "doc_id long, text string")
        assert decontaminate.contaminated(docs, items).count() == 0
        seeds = next(df for name, df in reversed(seen) if name == "leak-seeds")
        assert sorted(r.item_pos for r in seeds.collect()) == list(range(6, 18))
