"""python -m loomgraph.cli --input data.csv --output folder: search a file's numeric columns."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .config import CI_METHODS, RESIDUALS, CIConfig, DiscoverConfig
from .plans.discover import discover
from .sources.matrix import complete_cases, numeric_columns, read_any
from .sources.sinks import write_report, write_tables


def pairs(text: str | None, columns: Sequence[str]) -> tuple[tuple[int, int], ...]:
    """Places of the columns in 'a:b,c:d'."""
    out = []
    for pair in text.split(",") if text else ():
        names = pair.split(":")
        if len(names) != 2 or not set(names) <= set(columns):
            raise ValueError(f"{pair!r} is no pair of columns; there are {', '.join(columns)}")
        out.append(tuple(columns.index(n) for n in names))
    return tuple(out)


def main(argv: Sequence[str] | None = None) -> int:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--input", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--alpha", type=float, default=0.2)
    ap.add_argument("--ci-method", choices=CI_METHODS, default="dcc.gamma")
    ap.add_argument("--residual", choices=RESIDUALS, default="linear")
    ap.add_argument("--max-conditioning-size", type=float, default=2)
    ap.add_argument("--graph-stage", choices=("skeleton", "wanpdag"), default="wanpdag")
    ap.add_argument("--order-by", help="a key column, which is no variable")
    ap.add_argument("--seed", type=int, default=1)
    ap.add_argument("--index", type=float, help="exponent of distances, from 0 to 2; without it distances are plain")
    ap.add_argument("--sig", type=float, default=1.0, help="width of the RBF kernel")
    ap.add_argument("--replicates", type=int, default=100)
    ap.add_argument("--num-col", type=int, help="rank of factors")
    ap.add_argument("--precision", choices=("fast", "compatible", "hybrid", "legacy"), default="fast")
    ap.add_argument("--on-error", choices=("raise", "na"), default="raise")
    ap.add_argument("--labels", help="names for the variables, with commas between")
    ap.add_argument("--gaps", help="pairs of columns without an edge, such as a:b,c:d")
    ap.add_argument("--keep", help="pairs of columns whose edge stays, alike")
    ap.add_argument("--trace", action="store_true", help="also write a record of each test")
    ap.add_argument("--report", action="store_true", help="also write csv tables and a markdown overview")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    df = read_any(spark, a.input)
    cols = numeric_columns(df, [a.order_by] if a.order_by else [])
    df = complete_cases(df, cols, order_by=a.order_by, min_variables=2, min_rows=6)
    ci = CIConfig(a.ci_method, seed=a.seed, index=1.0 if a.index is None else a.index, legacy_index=a.index is None, sig=a.sig, replicates=a.replicates, num_col=a.num_col, on_error=a.on_error)
    cfg = DiscoverConfig(alpha=a.alpha, max_conditioning_size=a.max_conditioning_size, ci=ci, residual=a.residual, graph_stage=a.graph_stage, precision=a.precision, fixed_gaps=pairs(a.gaps, cols), fixed_edges=pairs(a.keep, cols), trace=a.trace)
    out = discover(df, cols, cfg, order_by=[a.order_by] if a.order_by else [], labels=a.labels.split(",") if a.labels else None)
    tables = out.tables()
    write_tables(tables, a.output)
    if a.report:
        write_report(spark, tables, out.summary(), f"{a.output}/report")
    print(json.dumps(out.summary(), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
