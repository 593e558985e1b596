"""Writing results and reports."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each table in a folder of its own; arrays become text in csv."""
    for name, df in tables.items():
        if fmt == "csv":
            df = df.select(*(F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes)).coalesce(1)
            df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)
        else:
            df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(spark: SparkSession, tables: Mapping[str, DataFrame], settings: Mapping[str, object], folder: str, rows: int = 20) -> str:
    """Tables as csv, settings as JSON, and a markdown overview with the first rows of each; the overview's text."""
    write_tables(tables, folder, "csv")
    write_text(spark, json.dumps(settings, default=str, sort_keys=True), f"{folder}/settings")
    lines = ["# Report", "", *(f"- {k}: {v}" for k, v in settings.items())]
    for name, df in tables.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(map(str, r)) + " |" for r in df.limit(rows).collect()]
    text = "\n".join(lines) + "\n"
    write_text(spark, text, f"{folder}/report")
    return text
