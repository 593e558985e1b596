r"""N-gram Jaccard join with a token-group matrix.

A document's set holds the hashes of its distinct ``size``-word shingles (words:
maximal runs outside ``[\x20\x09-\x0D]``, A-Z in lower case; with fewer words, the
whole sequence).  Documents link when the Jaccard similarity is at least
``percent`` / 100.  Equal sets are one class from the start.

1. Tokens are dealt out by hash range, packed in arrays with their class keys.  A
   range's task sees in how many classes each of its tokens is; tokens of one class
   only can never be shared and go no further.  A class of which less than
   ``percent`` % of its tokens are shared links with nothing.
2. The others order their tokens by rarity.  Two linked sets share one of their
   first ``n - ceil(n * percent / 100) + 1`` tokens (the prefix), as any global order does it.
3. Grouping.  Classes are dealt out by their smallest token hash and linked with a
   leader there, in a few rounds with other hashes, leaders alone going on; a hash with
   over ``HOT`` classes is dealt out in as many pieces as bring each below that.  What that connects is a cluster.  Parts
   of a large cluster, and classes of small ones with one hash, form groups of some
   ``GROUP`` similar members: the columns of the matrix.  Each group stores its members'
   token union.
4. The matrix.  For prefix tokens in several clusters, every class outside the token's
   commonest cluster is a query against all groups with that token, another cluster and
   members of a fitting size.  A query opens a group only if its overlap with the group's
   union reaches what a link needs; of each cluster there one link suffices.  Tokens with
   over ``HOT`` classes and groups with over ``GROUP`` queries are dealt out in pieces, with
   the smaller side (the token's clusters, the group's members) in each piece.
5. Links become components by star contraction.

No pair of one cluster is looked at twice, so a group of many near copies costs its
size, not its square, and no link between different clusters is lost.

Equal sets have one 64-bit name.  A second hash of 64 bits tells whether different sets
share one; if so (some n^2 / 2^65 pairs among n sets), theirs are drawn anew and the
tokens are dealt again.  Inside a range a token has 32 bits and the range's number: a
false match of two tokens of a pair has a chance of some 1e-6 at a gigabyte, less with
more ranges.  Ranges grow in number with the input, without a top; a task holds about
six times ``range_bytes``.

Edge cases: null, empty and wordless texts have no shingles and link with nothing;
repeated rows are one class; rows with equal identifiers keep a row each; rows with a
null identifier take part like others but name no component (null, if all its
identifiers are null); identifiers may have any type that can be ordered; an empty table
gives no rows; texts of any length are one set; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import components
from .decontaminate import bit_filter, passes
from .scratch import release_memory, stage
from .words import SPACE, mix, windows, word_hashes

GROUP, LEADERS, ROUNDS, FLUSH, HOT, PIECES = 128, 32, 4, 1_500_000, 1024, 32
_U = np.uint64


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(texts, SPACE)
    every = windows(words, size)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(windows(words[a:b], int(n)) if n else np.empty(0, _U))
    return out


def set_names(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set: its name, and what tells sets of one name apart (and is their name then)."""
    both = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return both & (1 << 64) - 1, both >> 64


def _ids_to_bytes(ids: list, kind: pa.DataType) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(ids, kind)], names=["id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _deal(size: int, bits: int, renamed: frozenset[int]):
    """Texts to packed rows: kind 0 has identifiers, names and sizes, kind 1 the tokens of a range."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
    flush_at = max(FLUSH, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        pack = zstandard.ZstdCompressor(level=1)
        kind: pa.DataType = pa.null()
        ids: list = []
        keys: list[int] = []
        checks: list[int] = []
        sizes: list[int] = []
        tokens: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        met: set[int] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            rows: dict[str, list] = {k: [] for k in schema.names}

            def add(*values) -> None:
                for k, v in zip(schema.names, values, strict=True):
                    rows[k].append(v)

            if ids:
                add(keys[0] % (1 << bits), 0, _ids_to_bytes(ids, kind), np.array(keys, np.uint64).tobytes(), np.array(sizes, np.int64).tobytes(), np.array(checks, np.uint64).tobytes())
            if tokens:
                h = np.concatenate(tokens)
                counts = np.array([n for _, n in owners])
                owner = np.repeat(np.arange(len(owners), dtype=np.int32), counts)
                bucket = (h >> _U(64 - bits)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                bucket, owner = bucket[order], owner[order]
                short = (h >> _U(32 - bits)).astype(np.uint32)[order]
                names = np.array([k for k, _ in owners], np.uint64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] ^ 1, append=bucket[-1] ^ 1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    firsts = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                    many = np.diff(np.append(firsts, b - a)).astype(np.uint32)
                    add(int(bucket[a]), 1, short[a:b].tobytes(), names[owner[a:b][firsts]].tobytes(), pack.compress(many.tobytes()), None)
            for x in (ids, keys, checks, sizes, tokens, owners):
                x.clear()
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                for i, s in zip(part.column(0).to_pylist(), shingle_sets(raw, size), strict=True):
                    key, check = set_names(s) if len(s) else (0, 0)
                    if key in renamed:
                        key = check
                    ids.append(i)
                    keys.append(key)
                    checks.append(check)
                    sizes.append(len(s))
                    if len(s) and key not in met:  # one copy of a set from each task
                        if len(met) < 2_000_000:
                            met.add(key)
                        tokens.append(s)
                        owners.append((key, len(s)))
                        held += len(s)
                if held >= flush_at or len(ids) >= 100_000:
                    held = 0
                    yield flush()
        yield flush()
        release_memory()

    return run


def _shared_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc", id_type), ("n", pa.int64()), ("key", pa.int64()), ("chk", pa.int64()), ("bucket", pa.int32()), ("cnt", pa.int32()), ("toks", pa.binary()), ("dfs", pa.binary())])


def _find_shared(schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        out = _shared_tokens(t, schema)
        release_memory()
        return out

    return run


def _shared_tokens(t: pa.Table, schema: pa.Schema) -> pa.Table:
    """One range: its documents' rows (no bucket), and for each class the tokens that another class has too."""
    bucket = t.column("bucket")[0].as_py()
    kinds = t.column("kind").to_numpy()
    out = []
    cols = [t.column(c).to_pylist() for c in ("a", "b", "c", "d")]
    for i in np.flatnonzero(kinds == 0):
        docs = pa.ipc.open_stream(cols[0][i]).read_all().column(0).combine_chunks()
        keys, sizes, checks = (np.frombuffer(cols[k][i], np.int64) for k in (1, 2, 3))
        n = len(docs)
        out.append(pa.table([docs, sizes, keys, checks, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema))
    rows = np.flatnonzero(kinds == 1)
    if len(rows):
        toks = np.concatenate([np.frombuffer(cols[0][i], np.uint32) for i in rows])
        keys = np.concatenate([np.repeat(np.frombuffer(cols[1][i], np.int64), np.frombuffer(zstandard.decompress(cols[2][i]), np.uint32)) for i in rows])
        names = np.sort(keys)
        names = names[np.concatenate(([True], names[1:] != names[:-1]))]
        entry = toks.astype(np.uint64)
        entry <<= _U(32)
        entry |= np.searchsorted(names, keys).astype(np.uint64)
        del toks, keys
        entry.sort()
        entry = entry[np.concatenate(([True], entry[1:] != entry[:-1]))]  # a set comes once from each task
        tok = (entry >> _U(32)).astype(np.uint32)
        firsts = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        df = np.diff(np.append(firsts, len(tok)))
        df = np.repeat(df, df)
        keep = df > 1
        tok, df, owner = tok[keep], np.minimum(df[keep], 65535).astype(np.uint16), (entry[keep] & _U(0xFFFFFFFF)).astype(np.int64)
        if len(tok):
            order = np.argsort(owner, kind="stable")
            tok, df, owner = tok[order], df[order], owner[order]
            firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            ends = np.append(firsts, len(tok)).astype(np.int32)
            n = len(firsts)
            blob = lambda x, w: pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * w).astype(np.int32)), pa.py_buffer(x)])
            out.append(pa.table([pa.nulls(n, schema.field("doc").type), pa.nulls(n, pa.int64()), names[owner[firsts]], pa.nulls(n, pa.int64()), np.full(n, bucket, np.int32), np.diff(ends), blob(tok, 4), blob(df, 2)], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def _flat(column: pa.ListArray, field: str, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of a list of binary blobs, where each list begins in them, and each blob's count."""
    blobs = column.flatten().field(field)
    off = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4).astype(np.int64)
    width = np.dtype(kind).itemsize
    data = np.frombuffer(blobs.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind)
    off = (off - off[0]) // width
    lists = column.offsets.to_numpy().astype(np.int64)
    return data, off[lists - lists[0]], np.diff(off)


def _order_tokens(percent: int):
    """Rows of a class: its shared tokens from the rarest on, the prefix's length among them, the share of the others in thousandths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = batch.column(batch.schema.get_field_index("parts"))
            tok, at, each = _flat(parts, "toks", np.uint32)
            df, _, _ = _flat(parts, "dfs", np.uint16)
            bucket = np.repeat(parts.flatten().field("bucket").to_numpy().astype(np.uint64), each)
            tok = bucket << _U(32) | tok
            blobs, heads, ranks = [], [], []
            for n, a, b in zip(batch.column(batch.schema.get_field_index("n")).to_pylist(), at[:-1], at[1:], strict=True):
                t = tok[a:b]
                t = t[np.lexsort((t, df[a:b]))]
                prefix = n - -(-n * percent // 100) + 1 - (n - len(t))
                blobs.append(t.tobytes())
                heads.append(max(0, prefix))
                ranks.append(1000 - 1000 * len(t) // n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranks, pa.int32()), pa.array(heads, pa.int32()), pa.array(blobs, pa.binary())], names=["key", "n", "rank", "head", "toks"])

    return run


def _linked(a: np.ndarray, n: int, b: np.ndarray, m: int, percent: int) -> bool:
    """Whether two sets link; arrays are their shared tokens, sorted, and n and m the whole sizes."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (n + m - common)


def _smallest(blobs: list[bytes], seed: int) -> np.ndarray:
    turn = mix(np.array([seed], np.uint64))
    return np.array([int(mix(np.frombuffer(b, np.uint64) ^ turn).min()) >> 1 for b in blobs], np.int64)


def _tiers(counts: DataFrame) -> list[tuple[np.ndarray, int]]:
    """For hashes (h, count) of over ``HOT`` classes, filters and numbers of pieces, so that a piece has some ``HOT`` at most."""
    most = counts.agg(F.max("count").alias("c")).first().c or 0
    out, pieces = [], 1
    while most > HOT * pieces:
        out.append((bit_filter(counts.filter(F.col("count") > HOT * pieces).select("h")), pieces * PIECES))
        pieces *= PIECES
    return out


def _min_hash(seed: int, hot: list[tuple[np.ndarray, int]] | None):
    """A class's smallest token hash under a seed; with ``hot``, the whole row, and hot hashes in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids = _smallest(batch.column("toks").to_pylist(), seed)
            if hot is None:
                yield pa.RecordBatch.from_arrays([pa.array(gids)], names=["gid"])
                continue
            pieces = np.ones(len(gids), np.uint64)
            for bits, n in hot:
                pieces[passes(gids.view(np.uint64), bits)] = n
            piece = mix(batch.column("key").to_numpy().view(np.uint64)) % pieces
            parted = (mix(gids.view(np.uint64) + piece) >> _U(1)).view(np.int64)
            gids = np.where(pieces > 1, parted, gids)
            yield pa.RecordBatch.from_arrays([pa.array(gids), *(batch.column(c) for c in ("key", "n", "rank", "toks"))], names=["gid", "key", "n", "rank", "toks"])

    return run


def _lead(percent: int):
    """Link classes of one hash with a leader; rows come sorted by (gid, rank, key).

    A class whose tokens are all shared leads before its edited copies do, so that
    copies that link with their original, but not with each other, find it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = None
        leaders: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            out: dict[str, list] = {"key": [], "leader": [], "gid": []}
            for g, key, n, blob in zip(*(batch.column(c).to_pylist() for c in ("gid", "key", "n", "toks")), strict=True):
                if g != gid:
                    gid, leaders = g, []
                mine = np.sort(np.frombuffer(blob, np.uint64))
                found = next((k for k, m, theirs in leaders if _linked(mine, n, theirs, m, percent)), key)
                if found == key and len(leaders) < LEADERS:
                    leaders.append((key, n, mine))
                out["key"].append(key)
                out["leader"].append(found)
                out["gid"].append(g)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))

    return run


def _open(percent: int):
    """Queries against groups; rows come sorted by (grp, piece, kind): a group's members, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp = None
        members: list[tuple[int, int, int, np.ndarray]] = []
        union: np.ndarray | None = None
        for batch in batches:
            out: dict[str, list] = {"u": [], "v": []}
            for g, piece, kind, key, cluster, n, blob in zip(*(batch.column(c).to_pylist() for c in ("grp", "piece", "kind", "key", "cluster", "n", "toks")), strict=True):
                if (g, piece) != grp:
                    grp, members, union = (g, piece), [], None
                mine = np.sort(np.frombuffer(blob, np.uint64))
                if kind == 0:
                    members.append((key, cluster, n, mine))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([m[3] for m in members])) if members else np.empty(0, _U)
                at = np.searchsorted(union, mine)
                bound = int(np.count_nonzero(union[np.minimum(at, len(union) - 1)] == mine)) if len(union) else 0
                if 100 * bound < percent * n:
                    continue  # no member can have enough of the query
                met = {cluster}
                for other, its, m, theirs in members:
                    if its not in met and _linked(mine, n, theirs, m, percent):
                        met.add(its)  # a cluster is connected: one link decides
                        out["u"].append(key)
                        out["v"].append(other)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, range_bytes: int = 1 << 24) -> DataFrame:
    """Rows (id, n_shingles, component): component is the smallest identifier reachable by links, its own included.

    ``range_bytes``: bytes of text that fall on one hash range, which sets their number.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(f"`{text_col}`").cast("string")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first().b
    bits = max(4, int(total // range_bytes).bit_length())
    id_type = docs.schema[id_col].dataType
    named_schema = _shared_schema(to_arrow_type(id_type))
    ddl = f"doc {id_type.simpleString()}, n long, key long, chk long, bucket int, cnt int, toks binary, dfs binary"

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    renamed: frozenset[int] = frozenset()
    while True:
        dealt = texts.mapInArrow(_deal(size, bits, renamed), "bucket int, kind int, a binary, b binary, c binary, d binary")
        shared = stage(dealt.groupBy("bucket").applyInArrow(_find_shared(named_schema), ddl), "jaccard-shared")
        of_docs = shared.filter("bucket is null").select("doc", "n", "key", "chk")
        classes = of_docs.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
        twice = classes.filter("lo != hi").select("key").collect()  # names of several sets: some n^2 / 2^65
        if not twice:
            break
        renamed |= {r.key & (1 << 64) - 1 for r in twice}

    tokens = shared.filter("bucket is not null").groupBy("key").agg(F.sum("cnt").alias("cnt"), F.collect_list(F.struct("bucket", "toks", "dfs")).alias("parts"))  # a class's tokens: one document's
    alive = classes.select("key", "n").join(tokens, "key").filter(100 * F.col("cnt") >= percent * F.col("n")).select("key", "n", "parts")
    sets = stage(alive.mapInArrow(_order_tokens(percent), "key long, n long, rank int, head int, toks binary").filter("head > 0"), "jaccard-sets")

    # Rounds of linking with leaders; only leaders take part in the next, under another hash.
    edges, part, firsts = None, sets, None
    for seed in range(ROUNDS):
        hot = _tiers(stage(part.mapInArrow(_min_hash(seed, None), "gid long").groupBy(F.col("gid").alias("h")).count().filter(F.col("count") > HOT), "jaccard-hot"))
        met = part.mapInArrow(_min_hash(seed, hot), "gid long, key long, n long, rank int, toks binary").repartition(n_parts, "gid").sortWithinPartitions("gid", "rank", "key")
        led = stage(met.mapInArrow(_lead(percent), "key long, leader long, gid long"), "jaccard-led")
        firsts = led.select("key", "gid") if firsts is None else firsts
        new = led.filter("key != leader").select(F.col("key").alias("u"), F.col("leader").alias("v"))
        edges = new if edges is None else edges.unionByName(new)
        part = sets.join(led.filter("key = leader").select("key"), "key", "left_semi")
    roots = components(edges)
    clusters = stage(sets.select("key", "n").join(roots, F.col("key") == F.col("node"), "left").select("key", "n", F.coalesce("root", "key").alias("cluster")), "jaccard-clusters")
    # Groups of similar classes: parts of a large cluster, or classes of small clusters with one hash.
    big = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= GROUP // 2).select("cluster", F.lit(True).alias("big"))
    placed = clusters.join(big, "cluster", "left").join(firsts, "key").select("key", "n", "cluster", F.when(F.col("big"), F.col("cluster")).otherwise(F.col("gid")).alias("near"))
    many = placed.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    groups = stage(placed.join(many, "near").select("key", "n", "cluster", F.xxhash64("near", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("grp")), "jaccard-groups")

    # Rows of the matrix: prefix tokens in several clusters (the filter may let others pass, which then ask nothing).
    met = sets.mapInArrow(_prefixes, "key long, tok long").join(groups, "key").select("tok", "key", "n", "cluster", "grp")
    seen = met.groupBy("tok").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo < hi")
    seen = stage(seen.select(F.col("tok").alias("h"), "c"), "jaccard-mixed")
    mixed, hot = bit_filter(seen), bit_filter(seen.filter(F.col("c") > HOT))
    heads = stage(met.mapInArrow(_of_matrix(mixed, hot), "tok long, key long, n long, cluster long, grp long, hot boolean"), "jaccard-heads")
    pieces = lambda of: F.when(F.col("hot"), F.pmod(F.xxhash64(of), F.lit(PIECES)).cast("long")).otherwise(F.lit(0).cast("long"))
    every = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(PIECES - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    common = heads.groupBy("tok", "hot", "cluster").agg(F.count(F.lit(1)).alias("c")).groupBy("tok", "hot").agg(F.max_by("cluster", F.struct("c", "cluster")).alias("top"))
    asking = heads.select("tok", pieces("key").alias("piece"), "key", "n", "cluster").join(common.select("tok", every.alias("piece"), "top"), ["tok", "piece"]).filter("cluster != top")
    index = heads.groupBy("tok", "hot", "grp").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    asked = asking.join(index.select("tok", every.alias("piece"), "grp", "lo", "hi", "least", "most"), ["tok", "piece"]).filter("cluster != lo or cluster != hi").filter(fits)
    asked = stage(asked.select("key", "cluster", "grp").distinct(), "jaccard-asked")

    load = asked.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))  # as many queries a piece as members
    body = sets.select("key", "n", "toks")
    queries = asked.join(load, "grp").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("parts"))).join(body, "key").select("grp", "piece", F.lit(1).alias("kind"), "key", "cluster", "n", "toks")
    opened = load.join(groups.drop("n"), "grp").join(body, "key").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    opened = opened.select("grp", "piece", F.lit(0).alias("kind"), "key", "cluster", "n", "toks")
    links = opened.unionByName(queries).repartition(n_parts, "grp", "piece").sortWithinPartitions("grp", "piece", "kind", "key").mapInArrow(_open(percent), "u long, v long")

    by_key = groups.select("key", "cluster")
    edges = links.join(by_key.withColumnsRenamed({"key": "u", "cluster": "cu"}), "u").join(by_key.withColumnsRenamed({"key": "v", "cluster": "cv"}), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    roots = components(edges)
    label = groups.join(roots, F.col("cluster") == F.col("node"), "left").select("key", F.coalesce("root", "cluster").alias("label"))
    named = of_docs.join(label, "key", "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("label"))
    named = stage(named, "jaccard-named")
    # Staged, so that the join below reads two plain exchanges, of which Spark can split a hot one.
    least = stage(named.filter("label is not null").groupBy("label").agg(F.min("doc").alias("component")), "jaccard-least")
    return named.join(least, "label", "left").select(F.col("doc").alias("id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def _of_matrix(mixed: np.ndarray, hot: np.ndarray):
    """Rows whose token may be in several clusters, and whether it is dealt out in pieces (by the filter alone, so that all see it alike)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok = batch.column(0).to_numpy().view(np.uint64)
            keep = passes(tok, mixed)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(passes(tok[keep], hot))], names=["tok", "key", "n", "cluster", "grp", "hot"])

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, tok) of each class's prefix tokens."""
    for batch in batches:
        heads = batch.column("head").to_numpy()
        toks = [np.frombuffer(b, np.int64, h) for b, h in zip(batch.column("toks").to_pylist(), heads, strict=True)]
        keys = np.repeat(batch.column("key").to_numpy(), heads)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(toks) if toks else np.empty(0, np.int64))], names=["key", "tok"])
