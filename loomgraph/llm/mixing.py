r"""Mixing sources to target weights by hierarchical budgets.

The leaves are the distinct values of the path columns (domain, language, source).
A node can give at most its documents' tokens times ``max_epochs``.  The total
budget goes down the tree: siblings share their parent's budget by weight, and one
that cannot use its share leaves the rest to its siblings, by weight again.  As a
parent never gets more than its subtree can give, a shortage leaves a family only
when the whole family is short.  The shares solve ``sum(min(capacity, t * weight))
= budget`` for each family: with siblings in order of capacity over weight, those
that are full form a prefix, which running sums find without iteration.

A leaf takes all its documents for each whole epoch in its budget, then the
longest prefix of the next epoch's order that fits.  An epoch's order is by the
first 60 bits of ``md5(seed|epoch|id)``.  Where the prefix ends is found by radix: tokens
are summed by 64 ranges of that order, the range that holds the cut by 64 ranges of its
own, and so on until ``SORTED`` documents are left in it at most, which are sorted.  So no
leaf's documents meet in one task, and texts are not shuffled.

Edge cases: a null path value is the same as an empty one; null texts have no
tokens and cost nothing; rows with equal identifiers in a leaf stand or fall
together; a weight of 0 or less gets nothing; empty tables give no rows; all columns
of the input are kept, under their names; where one of them is called like a column of
ours, ours gets underscores behind.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import WORD_GAP
from .scratch import free_name, stage

ORDER_BITS, RANGE_BITS, SORTED = 60, 6, 4096


def word_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_GAP), "")).cast("long")


def epoch_order(seed: int, epoch: Column, identifier: Column) -> Column:
    """A number below 2^60 that places an identifier in an epoch."""
    name = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(identifier.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _weight(level: int, value: Column, weights: Sequence[Mapping[str, float]]) -> Column:
    known = weights[level] if level < len(weights) else {}
    out = F.lit(1.0)
    for k, v in known.items():
        out = F.when(value == k, F.lit(float(v))).otherwise(out)
    return out


def budgets(leaves: DataFrame, path: Sequence[str], weights: Sequence[Mapping[str, float]], total: Column, max_epochs: int) -> DataFrame:
    """Rows (path..., tokens, budget) from rows (path..., tokens); ``total`` may use the column ``all_tokens``."""
    whole = Window.partitionBy(F.lit(0))
    tree = leaves
    for depth in range(len(path)):
        family = Window.partitionBy(*path[: depth + 1])
        tree = tree.withColumn(f"cap{depth}", F.sum("tokens").over(family) * max_epochs)
    # One row a leaf from here on; each level looks at one row a node.
    given = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")).select(F.floor(total).cast("double").alias("g")).first().g
    level: DataFrame | None = None
    for depth in range(len(path)):
        nodes = tree.groupBy(*path[: depth + 1]).agg(F.first(f"cap{depth}").cast("double").alias("cap"))
        nodes = nodes.withColumn("w", F.greatest(_weight(depth, F.col(path[depth]), weights), F.lit(0.0)))
        nodes = nodes.withColumn("given", F.lit(given)) if level is None else nodes.join(level, list(path[:depth]))
        order = Window.partitionBy(*path[:depth]) if depth else whole
        upto = order.orderBy("ratio", path[depth]).rowsBetween(Window.unboundedPreceding, 0)
        live = F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0)
        nodes = nodes.withColumn("live", live).withColumn("ratio", F.when(F.col("w") > 0, F.col("live") / F.col("w")).otherwise(0.0))
        nodes = nodes.withColumns({"cap_upto": F.sum("live").over(upto), "w_upto": F.sum("w").over(upto), "w_all": F.sum("w").over(order)})
        nodes = nodes.withColumn("full", F.col("cap_upto") + F.col("ratio") * (F.col("w_all") - F.col("w_upto")) <= F.col("given"))
        nodes = nodes.withColumns({"cap_full": F.sum(F.when(F.col("full"), F.col("live")).otherwise(0.0)).over(order), "w_full": F.sum(F.when(F.col("full"), F.col("w")).otherwise(0.0)).over(order)})
        share = F.when(F.col("full"), F.col("live")).otherwise((F.col("given") - F.col("cap_full")) / (F.col("w_all") - F.col("w_full")) * F.col("w"))
        level = nodes.select(*path[: depth + 1], share.alias("given"))
    return leaves.join(level, list(path)).select(*path, "tokens", F.floor("given").cast("long").alias("budget"))


def mix(docs: DataFrame, path: Mapping[str, Column], weights: Sequence[Mapping[str, float]], *, share: float = 0.6, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", details: bool = True) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them.

    ``path``: level names and their expressions over ``docs``.  ``share``: the total
    budget as a part of all tokens.  ``details`` adds the path and the columns
    mix_epoch, mix_tokens and mix_budget; else the columns are those of ``docs``.
    """
    own = free_name("_mix", docs.columns)
    names = [f"{own}_{i}" for i in range(len(path))]
    keyed = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(names, path.values(), strict=True)})
    narrow = stage(keyed.select(F.col(f"`{id_col}`").alias("id"), *names, word_tokens(F.col(f"`{text_col}`")).alias("t")), "mix-tokens")
    leaves = stage(narrow.groupBy(*names).agg(F.sum("t").alias("tokens")), "mix-leaves")
    plan = budgets(leaves, names, weights, F.col("all_tokens") * F.lit(share), max_epochs)
    # Whole epochs, and what is left for a prefix of the next.  Staged, so that its size is known when joins are planned.
    plan = stage(plan.withColumns({"whole": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int")}).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-plan")
    ends = _prefix_ends(narrow, plan, names, seed)

    final = plan.join(ends, names).select(*names, F.col("budget").alias(f"{own}_budget"), F.col("whole").alias(f"{own}_whole"), F.col("below").alias(f"{own}_below"), F.col("last").alias(f"{own}_last"))
    final = stage(final, "mix-final")
    joined = keyed.join(final, names).withColumn(f"{own}_h", epoch_order(seed, F.col(f"{own}_whole"), F.col(f"`{id_col}`")))
    upto_last = F.coalesce(F.struct(F.col(f"{own}_h").alias("h"), F.col(f"`{id_col}`").alias("id")) <= F.col(f"{own}_last"), F.lit(False))
    taken = F.col(f"{own}_whole") + ((F.col(f"{own}_h") < F.col(f"{own}_below")) | upto_last).cast("int")
    out = joined.withColumn(f"{own}_taken", taken).filter(F.col(f"{own}_taken") > 0).withColumn(f"{own}_epoch", F.explode(F.sequence(F.lit(0), F.col(f"{own}_taken") - 1)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    if not details:
        return out.select(*kept)
    made = {**{f"mix_{k}": F.col(n) for n, k in zip(names, path, strict=True)}, "mix_epoch": F.col(f"{own}_epoch"), "mix_tokens": word_tokens(F.col(f"`{text_col}`")), "mix_budget": F.col(f"{own}_budget")}
    return out.select(*kept, *(c.alias(free_name(k, docs.columns)) for k, c in made.items()))


def _prefix_ends(narrow: DataFrame, plan: DataFrame, names: Sequence[str], seed: int) -> DataFrame:
    """Rows (path..., below, last): of the next epoch a leaf takes what is ``below``, and up to ``last`` (h, id) if that isn't null."""
    left = narrow.join(plan.select(*names, "whole", "rest"), list(names)).withColumn("h", epoch_order(seed, F.col("whole"), F.col("id"))).select(*names, "rest", "h", "id", "t")
    shift, done = ORDER_BITS, []
    while True:
        shift -= RANGE_BITS
        at = F.shiftright("h", shift)
        sums = left.groupBy(*names, "rest", at.alias("range")).agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # 64 rows a leaf
        summed = sums.withColumn("c", F.sum("t").over(upto)).groupBy(*names, "rest").agg(F.min(F.when(F.col("c") > F.col("rest"), F.struct("range", (F.col("c") - F.col("t")).alias("before"), "n"))).alias("x"))
        cuts = stage(summed.select(*names, "x.range", (F.col("rest") - F.col("x.before")).alias("rest"), "x.n", (F.col("x.range") * (1 << shift)).alias("below")), "mix-cuts")
        done.append(cuts.filter("range is null").select(*names, F.lit(1 << ORDER_BITS).alias("below")))  # all that was left is taken
        cuts = cuts.filter("range is not null")
        left = left.drop("rest").join(cuts.select(*names, "range", "rest"), list(names)).filter(at == F.col("range")).drop("range")
        most = cuts.agg(F.max("n").alias("n")).first().n or 0
        if most <= SORTED or not shift:
            break
        left = stage(left, "mix-left")
    done.append(cuts.select(*names, "below"))
    below = done[0]
    for part in done[1:]:
        below = below.unionByName(part)
    run = Window.partitionBy(*names).orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    inside = left.groupBy(*names, "rest", "h", "id").agg(F.sum("t").alias("t")).withColumn("c", F.sum("t").over(run))
    last = inside.filter(F.col("c") <= F.col("rest")).groupBy(*names).agg(F.max(F.struct("h", F.coalesce("id", F.lit(None)).alias("id"))).alias("last"))
    return below.join(last, list(names), "left")
