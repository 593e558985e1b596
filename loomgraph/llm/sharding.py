"""Contiguous shards of near-equal bytes by global prefix sums.

Rows are ordered by ``(id, crc32, size)``.  A range partitioning deals them out
in that order, every partition's byte and row totals become offsets by one
prefix sum over the partitions (a table with one row a partition), and a running
sum inside the partition finishes the global prefix.  A row goes to the shard
in which the middle of its bytes falls when the total is cut at equal targets.
Only ``(id, crc32, size)`` is shuffled, never the text, and no row is compared
with all others.

Edge cases: a null text has size ``pad`` and CRC 0; an empty table gives an empty
result; repeated rows each get a slot of their own; extra columns are ignored
unless named in ``keep``; rows with a null id come first.  One text larger than
a shard leaves the shards that it spans empty; where no row has any bytes all are in the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage


def byte_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", pad: int = 1, partitions: int | None = None) -> DataFrame:
    """Rows (id, size, text_crc32, start_byte, shard, slot), one for each input row.

    ``pad`` bytes are added to each text's size (a separator, say).  ``slot``
    counts from 0 in each shard, without gaps, in the order of the rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(f"`{text_col}`").cast("string")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + pad).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # The partition number is part of the data from here on, so it is written down:
    # range bounds come from a sample, and a second evaluation could draw another.
    dealt = stage(sized.repartitionByRange(n, "id", "text_crc32", "size").withColumn("part", F.spark_partition_id()), "shards")

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    over = Window.partitionBy(F.lit(0)).orderBy("part")  # one row a partition: n at most
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("id", "text_crc32", "size")
    placed = (
        dealt.withColumns({"run": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})
        .join(F.broadcast(offsets), "part")  # n rows
        .withColumns({"start_byte": F.col("bytes_before") + F.col("run") - F.col("size"), "row": F.col("rows_before") + F.col("nth") - 1})
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.expr(f"((2 * start_byte + size) * {shards}) div greatest(2 * total, 1)"))).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "start_byte", "shard", (F.col("row") - F.col("first_row")).alias("slot"))  # one row a shard
