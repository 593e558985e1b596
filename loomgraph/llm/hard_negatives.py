"""Hard-negative mining by distributed radix selection.

A window is an anchor, a range of integer scores and a condition on labels; wanted are
its first ``k`` rows by falling score, then rising identifier.  Each pass counts, for each
window, how many scores lie in each bucket of its range; the sum of the counts tells the
bucket that holds the kth score, and the next pass looks into that bucket alone, digit by
digit, then (among equal scores) into digits of the identifier.  A window is done when its
bucket holds few rows.  Then one pass gathers only rows in front of that place.  A tile
reports no bucket behind its own kth row, as the kth of all can't lie there.

Positives are found in this way (one window an anchor), then negatives (one window for
each anchor and positive).

Rows are dealt into tiles of about ``ROWS`` rows and ``ANCHORS`` anchors by hashes of the
identifiers; anchors go to all row tiles, rows to all anchor tiles.  So a task holds one
tile, whatever labels or copies are frequent, and nothing but a count of open windows
reaches the driver.

Edge cases: rows with a null identifier, label or vector, or a null or non-finite
component, take no part; of rows with one identifier the one with the smallest label,
then vector, counts; shorter vectors are filled up with zeros; anchors without another
row of their label, or with a negative positive score, give no row; an empty table gives
an empty one; extra columns are ignored.  Components beyond ``vectors.LARGEST`` raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import release_memory, stage
from .vectors import as_integers, is_finite, matrix, products

ROWS, ANCHORS, BUCKETS, SPARE = 8192, 2048, 4096, 4
STATE = "anchor long, win int, same boolean, lo long, hi long, by_id boolean, base long, width long, need long, cut long, last long, done boolean"


def _per_window(left: pa.Table, right: pa.Table, dims: int, largest: int):
    """For each window of a tile: its state, and the scores and identifiers of the rows that its labels allow."""
    ids, labels = left["id"].to_numpy(), left["label"].to_numpy()
    x = matrix(left["q"], dims)
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in right["wins"]])))
    wins = right["wins"].combine_chunks()
    wins = (wins if isinstance(wins, pa.Array) else pa.concat_arrays(wins.chunks)).flatten()
    fields = {f.name: wins.field(i).to_pylist() for i, f in enumerate(wins.type)}
    anchors, own = right["id"].to_numpy(), right["label"].to_numpy()
    a = matrix(right["q"], dims)
    for at in range(0, len(a), 256):
        scores = products(a[at : at + 256], x, largest)
        for k in range(len(scores)):
            same = labels == own[at + k]
            for j in range(offsets[at + k], offsets[at + k + 1]):
                w = {n: v[j] for n, v in fields.items()}
                may = same & (ids != anchors[at + k]) if w["same"] else ~same
                may &= (scores[k] >= w["lo"]) & (scores[k] <= w["hi"])
                yield int(anchors[at + k]), w, scores[k][may], ids[may]


def select_first(rows: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, shape: dict) -> DataFrame:
    """Rows (anchor, win, rank, id, score): the first ``k`` of each window (anchor, win, same, lo, hi)."""
    dims, largest, least_id, most_id = shape["dims"], shape["largest"], shape["least_id"], shape["most_id"]
    over_rows, over_anchors = shape["row_tiles"], shape["anchor_tiles"]
    tile_i, tile_j = F.pmod(F.xxhash64("id"), F.lit(over_rows)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(over_anchors)).cast("int")
    dealt = rows.select(tile_i.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(over_anchors - 1))).alias("j"), "id", "label", "q")
    spare = SPARE * k

    def tiles(state: DataFrame):
        nested = state.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("win", "same", "lo", "hi", "by_id", "base", "width", "need", "cut", "last")).alias("wins"))
        asked = anchors.join(nested, "id").select(F.explode(F.sequence(F.lit(0), F.lit(over_rows - 1))).alias("i"), tile_j.alias("j"), "id", "label", "q", "wins")
        return dealt.groupBy("i", "j").cogroup(asked.groupBy("i", "j"))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        release_memory()
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            for anchor, w, s, ids in _per_window(left, right, dims, largest):
                v = (ids[s == w["cut"]] - w["base"]) if w["by_id"] else w["base"] - s
                v = v[(v >= 0) & (v < w["width"] * BUCKETS)] // w["width"] if len(v) else v
                n = np.bincount(v) if len(v) else np.empty(0, np.int64)
                full = np.searchsorted(np.cumsum(n), w["need"])
                out += [(anchor, w["win"], int(b), int(n[b])) for b in np.flatnonzero(n[: full + 1])]
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["anchor", "win", "bucket", "n"])

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if left.num_rows and right.num_rows:
            for anchor, w, s, ids in _per_window(left, right, dims, largest):
                ok = s >= w["cut"]
                if w["last"] is not None:
                    ok &= (s > w["cut"]) | (ids <= w["last"])
                if ok.any():
                    parts.append((np.full(ok.sum(), anchor), np.full(ok.sum(), w["win"], np.int32), ids[ok], s[ok]))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        return pa.table([pa.array(c) for c in cols], names=["anchor", "win", "id", "score"])

    null = F.lit(None).cast("long")
    id_width = F.lit((most_id - least_id) // BUCKETS + 1).cast("long")
    state = windows.select("anchor", "win", "same", "lo", "hi", F.lit(False).alias("by_id"), F.col("hi").alias("base"), F.expr(f"(hi - lo) div {BUCKETS} + 1").alias("width"), F.lit(k).cast("long").alias("need"), F.col("lo").alias("cut"), null.alias("last"), F.lit(False).alias("done"))
    state = stage(state, "negatives-windows")
    by = Window.partitionBy("anchor", "win").orderBy("bucket")
    while state.filter(~F.col("done")).limit(1).count():
        open_ = state.filter(~F.col("done"))
        counted = tiles(open_).applyInArrow(count, "anchor long, win int, bucket int, n long").groupBy("anchor", "win", "bucket").agg(F.sum("n").alias("n"))
        run = counted.withColumn("cum", F.sum("n").over(by)).join(open_.select("anchor", "win", "need"), ["anchor", "win"])
        place = run.filter("cum >= need").groupBy("anchor", "win").agg(F.min(F.struct("bucket", (F.col("cum") - F.col("n")).alias("before"), F.col("n").alias("inside"))).alias("p"))
        at, some = F.col("p.bucket").cast("long") * F.col("width"), F.col("p").isNotNull()
        need = F.col("need") - F.col("p.before")
        few = (F.lit(k) - need + F.col("p.inside")) <= spare
        top = F.col("base") - at
        low = F.greatest("cut", top - F.col("width") + 1)  # `cut` is the range's low end while scores are told apart
        first, last = F.col("base") + at, F.expr(f"coalesce(try_add(base + p.bucket * width, width - 1), {most_id}L)")
        single = F.col("width") == 1
        to_id = ~F.col("by_id") & ~few & single
        moved = {
            "done": ~some | few | (F.col("by_id") & single),
            "need": F.when(some, need).otherwise(F.col("need")),
            "cut": F.when(some & ~F.col("by_id"), low).otherwise(F.col("cut")),
            "last": F.when(some & F.col("by_id"), last).otherwise(F.col("last")),
            "base": F.when(to_id & some, F.lit(least_id).cast("long")).when(some, F.when(F.col("by_id"), first).otherwise(top)).otherwise(F.col("base")),
            "width": F.when(to_id & some, id_width).when(some & F.col("by_id"), F.expr(f"(width - 1) div {BUCKETS} + 1")).when(some, F.floor((top - low) / BUCKETS).cast("long") + 1).otherwise(F.col("width")),
            "by_id": F.col("by_id") | (to_id & some),
        }
        after = open_.join(place, ["anchor", "win"], "left")
        after = after.select("anchor", "win", "same", "lo", "hi", *(moved[c].alias(c) for c in ("by_id", "base", "width", "need", "cut", "last", "done")))
        state = stage(state.filter("done").unionByName(after), "negatives-windows")
    found = tiles(state).applyInArrow(gather, "anchor long, win int, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "win").orderBy(F.col("score").desc(), "id")))
    return stage(ranked.filter(F.col("rank") <= k).select("anchor", "win", "rank", "id", "score"), "negatives-first")


def hard_negatives(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``id``; ``low`` and ``high`` bound the negative score in percent of
    the positive one.  Identifiers are whole numbers, labels have a type that numpy compares.
    """
    vec = F.col(f"`{vec_col}`")
    clean = df.filter(is_finite(vec)).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), as_integers(vec, scale).alias("q")).filter("id is not null and label is not null")
    rows = stage(clean.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q"), "negatives-rows")
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(is_anchor.cast("long")).alias("a"), F.max(F.size("q")).alias("dims"), F.max(F.array_max(F.transform("q", F.abs))).alias("largest"), F.min("id").alias("least"), F.max("id").alias("most")).first()
    shape = {"dims": max(s.dims or 0, 1), "largest": s.largest or 0, "least_id": s.least or 0, "most_id": s.most or 0, "row_tiles": -(-max(s.n, 1) // ROWS), "anchor_tiles": -(-max(s.a or 0, 1) // ANCHORS)}
    most = shape["dims"] * shape["largest"] ** 2
    if 100 * most >= 1 << 63:
        raise ValueError("scores would leave 64 bits")
    anchors = stage(rows.filter(is_anchor), "negatives-anchors")
    ends = (F.lit(-most).cast("long").alias("lo"), F.lit(most).cast("long").alias("hi"))
    near = select_first(rows, anchors, anchors.select(F.col("id").alias("anchor"), F.lit(0).alias("win"), F.lit(True).alias("same"), *ends), positives, shape)
    near = near.select("anchor", F.col("rank").alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = near.filter("positive_score >= 0").select("anchor", "win", F.lit(False).alias("same"), F.expr(f"({low} * positive_score + 99) div 100").alias("lo"), F.expr(f"({high} * positive_score) div 100").alias("hi")).filter("lo <= hi")
    hard = select_first(rows, anchors, windows, k, shape).select("anchor", "win", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(near, ["anchor", "win"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
