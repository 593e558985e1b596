r"""Line dedup with levelled sorted runs of line hashes.

A line's key is its text without ``[\x20\x09-\x0D]`` at both ends and with A-Z in
lower case; keys of fewer than ``least`` code points are never dropped.  The store
keeps which document owns each key, as 128-bit hashes in sorted runs, each cut
into the same hash ranges (buckets).  A new batch is reduced to one row for each
key, dealt out by bucket, and merged with that bucket of every run (an anti-join
of sorted arrays): keys found there belong to an earlier document, the others
become a new run of level 0.  When a level holds ``fanout`` runs they are merged
into one run of the next level.  So a batch never shuffles what came before it.

Runs are files under the shared folder; only those that a finished job reported
count, so lost or repeated tasks leave no trace.

The number of buckets grows with the keys, ``BUCKET_KEYS`` for each; staged keys are kept
by batch, so a batch reads its own alone.

Edge cases: identifiers of any type that can be ordered; owners are kept as numbers, so others
than integers are numbered first, in their order; null or empty texts are one empty line; null identifiers order before
all others; rows with the same identifier are one document (all keep an owned
line); repeated rows are treated alike; empty batches add an empty run; very long
texts are split where they stand; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from .scratch import fresh_path, free_name, stage
from .token_tables import _open_fs

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = pa.schema([("h1", pa.uint64()), ("h2", pa.uint64()), ("owner", pa.int64())])
_OUT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("owner", pa.int64()), ("bucket", pa.int32()), ("file", pa.string()), ("n", pa.int64())])
_OUT_DDL = "h1 long, h2 long, owner long, bucket int, file string, n long"
_CHUNK = 1 << 20
BUCKETS, BUCKET_KEYS = 64, 1 << 21


def line_keys(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """Rows (doc, row_hash, pos, h1, h2) of every line whose key is long enough."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("doc"), text.alias("text"))
    lines = rows.select("doc", F.xxhash64("text").alias("row_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("doc", "row_hash", "pos", F.translate(F.btrim("line", F.lit(_BLANK)), _UPPER, _LOWER).alias("key")).filter(F.char_length("key") >= least)
    return keys.select("doc", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _sorted(h1: np.ndarray, h2: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((h2, h1))
    return (h1[order], h2[order], *(x[order] for x in more))


def _merge_find(h1: np.ndarray, h2: np.ndarray, owner: np.ndarray, found: np.ndarray, path: str) -> None:
    """Mark the sorted keys that a run's file holds, and take over their owners."""
    fs, base = _open_fs(path)
    with fs.open_input_file(base) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=_CHUNK):
            r1, r2, ro = (batch.column(i).to_numpy() for i in range(3))
            a, b = np.searchsorted(h1, r1[0], "left"), np.searchsorted(h1, r1[-1], "right")
            if a == b:
                continue
            # Both sides are sorted; run rows come first among equal keys.
            k1, k2 = np.concatenate((r1, h1[a:b])), np.concatenate((r2, h2[a:b]))
            own = np.arange(len(k1)) >= len(r1)
            order = np.lexsort((own, k2, k1))
            same = np.zeros(len(k1), bool)
            same[1:] = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
            hit = np.flatnonzero(same & own[order])
            mine, theirs = order[hit] - len(r1) + a, order[hit - 1]
            found[mine] = True
            owner[mine] = ro[theirs]


def _write_run(folder: str, bucket: int, h1: np.ndarray, h2: np.ndarray, owner: np.ndarray) -> str:
    fs, base = _open_fs(folder)
    fs.create_dir(base, recursive=True)
    name = f"bucket-{bucket:05d}-{uuid.uuid4().hex[:12]}.parquet"
    with fs.open_output_stream(f"{base}/{name}") as out:
        pq.write_table(pa.table([h1, h2, owner], schema=_RUN), out, row_group_size=_CHUNK, compression="zstd")
    return f"{folder}/{name}"


@dataclass
class LineStore:
    """The runs by level; each run maps a bucket to its file.

    ``buckets`` must be fixed for a store's life: choose it so that one bucket of
    all keys (24 bytes each) fits in a task.
    """

    spark: SparkSession
    folder: str
    buckets: int = BUCKETS
    fanout: int = 3
    levels: list[list[dict[int, str]]] = field(default_factory=list)

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch of ``line_keys``; rows (h1, h2, owner) of its keys that an earlier document or several of its own hold."""
        runs = [run for level in self.levels for run in level]
        files = {b: [run[b] for run in runs if b in run] for b in range(self.buckets)}
        folder, buckets = self.folder, self.buckets

        def merge(pdf: pa.Table) -> pa.Table:
            bucket = pdf.column("bucket")[0].as_py()
            col = lambda c: pdf.column(c).to_numpy()
            h1, h2, lo, hi = _sorted(col("h1").astype(np.uint64), col("h2").astype(np.uint64), col("lo"), col("hi"))
            owner, found = lo.copy(), np.zeros(len(h1), bool)
            for path in files[bucket]:
                _merge_find(h1, h2, owner, found, path)
            new = ~found
            file = _write_run(folder, bucket, h1[new], h2[new], lo[new]) if new.any() else None
            told = found | (lo < hi)
            n = int(told.sum())
            rows = pa.table([h1[told].astype(np.int64), h2[told].astype(np.int64), owner[told], np.full(n, bucket, np.int32), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=_OUT)
            note = pa.table([[None], [None], [None], [bucket], [file], [int(new.sum())]], schema=_OUT)
            return pa.concat_tables([rows, note])

        # The upper half of h1 as an unsigned number picks the bucket: ranges of the sorted order.
        once = keys.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        dealt = once.withColumn("bucket", F.expr(f"cast(shiftrightunsigned({buckets} * shiftrightunsigned(h1, 32), 32) as int)"))
        out = stage(dealt.groupBy("bucket").applyInArrow(merge, _OUT_DDL), "line-runs")
        notes = out.filter("n is not null and file is not null").select("bucket", "file").collect()  # one row a bucket
        if not self.levels:
            self.levels.append([])
        self.levels[0].append({r.bucket: r.file for r in notes})
        self._compact()
        return out.filter("n is null").select("h1", "h2", "owner")

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._merged(self.levels[level]))
                self.levels[level] = []

    def _merged(self, runs: list[dict[int, str]]) -> dict[int, str]:
        """One run of several; their keys are distinct, as each was anti-joined with those before it."""
        folder = self.folder
        rows = [(b, [run[b] for run in runs if b in run]) for b in range(self.buckets)]

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    tables = []
                    for path in r["files"]:
                        fs, base = _open_fs(path)
                        with fs.open_input_file(base) as f:
                            tables.append(pq.read_table(f))
                    t = pa.concat_tables(tables)
                    file = _write_run(folder, r["bucket"], *_sorted(*(t.column(i).to_numpy() for i in range(3))))
                    yield pa.RecordBatch.from_pydict({"bucket": [r["bucket"]], "file": [file]}, schema=pa.schema([("bucket", pa.int32()), ("file", pa.string())]))

        held = [r for r in rows if r[1]]
        if not held:
            return {}
        plan = self.spark.createDataFrame(held, "bucket int, files array<string>").repartition(min(len(held), int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
        return {r.bucket: r.file for r in stage(plan.mapInArrow(merge, "bucket int, file string"), "line-compaction").collect()}  # one row a bucket


def numbered(ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """Rows (identifier, number): distinct identifiers, counted in their order by ranges, each behind those of the ranges before it."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(ids.filter(F.col(f"`{id_col}`").isNotNull()).distinct().repartitionByRange(n, F.col(f"`{id_col}`")).withColumn("_range", F.spark_partition_id()), "line-ids")
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # one row a range
    at = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(f"`{id_col}`"))) - 1
    return dealt.withColumn("_at", at).join(F.broadcast(first), "_range").select(id_col, (F.col("_first") + F.col("_at")).cast("long").alias(name))  # n rows


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 4, buckets: int | None = None) -> DataFrame:
    """Rows (id, text, n_lines, n_dropped): ``docs`` without lines that a smaller identifier holds.

    The table goes through the store in ``batches`` ranges of the identifier, in ascending order.
    ``buckets``: of the store; by default as many as keep one within ``BUCKET_KEYS`` keys.
    """
    spark = docs.sparkSession
    number = id_col
    if not isinstance(docs.schema[id_col].dataType, (IntegralType, NullType)):
        number = free_name("number", [id_col, text_col])
        docs = stage(docs.select(id_col, text_col).join(numbered(docs.select(id_col), id_col, number), id_col, "left"), "line-numbered")
    cuts = docs.agg(F.percentile_approx(F.col(f"`{number}`").cast("long"), [i / batches for i in range(1, batches)], 1000).alias("c")).first().c if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum(((F.col("doc") > c).cast("int") for c in cuts), F.lit(0))
    keys = stage(line_keys(docs, id_col=number, text_col=text_col, least=least).withColumn("batch", batch), "line-keys", by="batch")
    n_buckets = buckets or max(BUCKETS, -(-keys.count() // BUCKET_KEYS))
    store = LineStore(spark, fresh_path(spark, "line-store"), n_buckets)
    drops = None
    for i in range(len(cuts) + 1):
        part = keys.filter(F.col("batch") == i).drop("batch")
        owned = store.add(part)
        hit = part.join(owned, ["h1", "h2"]).filter("owner < doc").select("doc", "row_hash", "pos")
        drops = hit if drops is None else drops.unionByName(hit)
    gone = drops.groupBy("doc", "row_hash").agg(F.collect_set("pos").alias("gone"))  # as many as the document has lines

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.coalesce(F.col(f"`{number}`").cast("long"), F.lit(-(1 << 63))).alias("doc")).withColumn("row_hash", F.xxhash64("text"))
    joined = rows.join(gone, ["doc", "row_hash"], "left").select("id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, lost = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.split("\n")
                away = set(gone or ())
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in away) if away else text)
                counts.append(len(lines))
                lost.append(len(away))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64())], names=["id", "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, f"id {id_type}, text string, n_lines long, n_dropped long")
