"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.

Edge cases, in all stages: documents are rows, told apart by doc_id and text together,
so what is decided about one never touches another with its doc_id; null doc_ids are a
doc_id like others, null texts are empty; extra columns stay, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.decontaminate import contaminated
from loomgraph.llm.entry import MIX_WEIGHTS, mix_path, table, tokenizer_path, toxicity_scores
from loomgraph.llm.jaccard_join import jaccard_components
from loomgraph.llm.mixing import mix
from loomgraph.llm.scratch import free_name, stage
from loomgraph.llm.token_tables import id_width, read_tables, write_tables


def row_name() -> Column:
    """128 bits of a row's doc_id and text."""
    return F.unhex(F.md5(F.concat_ws("\1", F.coalesce(F.col("doc_id").cast("string"), F.lit("\2")), F.coalesce(F.col("text"), F.lit("\2")))))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    score = free_name("score", docs.columns)
    return toxicity_scores(spark, docs, sf_dir, score).filter(F.coalesce(F.col(score), F.lit(0.0)) < 0.5).select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id, then text hash, of each group of near copies (five words, 0.8).

    Rows that repeat in doc_id and text go too; rows with a null doc_id stay only where no other of their group has one.
    """
    row = free_name("_row", docs.columns)
    keyed = docs.withColumn(row, row_name())
    found = jaccard_components(keyed, id_col=row, size=5, percent=80).select(F.col("id").alias("row"), "component").distinct()
    names = keyed.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"), F.col(row).alias("row")).alias("name")).distinct()
    first = found.join(names, "row").groupBy("component").agg(F.min("name").alias("name")).select(F.col("name.row").alias(row))
    return keyed.join(first, row, "left_semi").dropDuplicates([row]).select(*_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    row = free_name("_row", docs.columns)
    keyed = docs.withColumn(row, row_name())
    leaks = contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=row).select(F.col("id").alias(row)).distinct()
    leaks = stage(leaks, "pipeline-leaks")  # so that its size is known when the join is planned
    return keyed.join(leaks, row, "left_anti").select(*_own(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their domain, language and source ask for; rows of one doc_id in a leaf together."""
    return mix(docs, mix_path(), MIX_WEIGHTS, share=0.8, max_epochs=2, seed=17, details=False)


def token_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token IDs in sorted-string tables; a row for each entry, read back from the files."""
    path = tokenizer_path()
    return read_tables(write_tables(docs, path, end_id=1), id_width(path, 1)).withColumnRenamed("id", "doc_id")


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_tables", token_tables),
]

#: The stages learn, hash and align; SQL can't express them, so tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
