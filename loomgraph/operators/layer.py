"""One level of the skeleton search as queries: neighbours, plan, requests, replay.

``edges`` are rows (x, y) with x < y; a task tests x and y given the set s.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def complete_graph(variables: DataFrame) -> DataFrame:
    """All pairs x < y of the values of ``v``."""
    return variables.alias("a").join(variables.alias("b"), F.col("a.v") < F.col("b.v")).select(F.col("a.v").alias("x"), F.col("b.v").alias("y"))


def apply_gaps(edges: DataFrame, gaps: DataFrame) -> DataFrame:
    """Edges less those that must not exist; gaps may name either end first."""
    return edges.join(gaps.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), ["x", "y"], "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("x").alias("v"), F.col("y").alias("u")).unionByName(edges.select(F.col("y").alias("v"), F.col("x").alias("u")))


def neighbours(edges: DataFrame) -> DataFrame:
    """Rows (v, adj): each node's neighbours in ascending order."""
    return both_ways(edges).groupBy("v").agg(F.sort_array(F.collect_list("u")).alias("adj"))


def combinations(items: Column, size: int) -> Column:
    """All subsets of ``size`` of a sorted array, in lexicographic order; the empty set alone for 0."""
    if size == 0:
        return F.array(F.array().cast("array<int>"))
    out = F.transform(items, lambda e: F.array(e))
    for _ in range(size - 1):
        out = F.flatten(F.transform(out, lambda c: F.transform(F.filter(items, lambda e: e > F.element_at(c, -1)), lambda e: F.concat(c, F.array(e)))))
    return out


#: Numbers that one row may list while ranks or masks are spread out.
STRETCH = 4096


def spread(df: DataFrame, start: Column, stop: Column, name: str) -> DataFrame:
    """A row for each number from ``start`` to below ``stop``, in two steps, so that no row lists more than the root of them or ``STRETCH``."""
    step = F.greatest(F.lit(STRETCH).cast("long"), F.ceil(F.sqrt(F.greatest(stop - start, F.lit(0)).cast("double"))).cast("long"))
    some = df.withColumns({"_from": start.cast("long"), "_to": stop.cast("long"), "_step": step}).filter("_to > _from")
    some = some.withColumn("_from", F.explode(F.sequence("_from", F.col("_to") - 1, F.col("_step"))))
    return some.withColumn(name, F.explode(F.sequence("_from", F.least(F.col("_from") + F.col("_step"), F.col("_to")) - 1))).drop("_from", "_to", "_step")


def masked(items: Column, mask: Column) -> Column:
    """The items of an array at the bits of a mask."""
    return F.filter(items, lambda e, i: F.call_function("shiftright", mask, i).bitwiseAND(1) == 1)


def unrank(items: Column, size: int, nth: Column) -> Column:
    """The nth (from 0) of the subsets of ``size`` of a sorted array, in lexicographic order, without listing any other.

    Numbers of subsets, largest first, are digits of the combinatorial number system: the
    lexicographic order backwards is that of the sets of places counted from the end.
    """
    if size == 0:
        return F.array().cast("array<int>")
    n = F.size(items)
    places = F.sequence(F.lit(0), n - 1)

    def digit(acc: Column, k: Column) -> Column:
        # The largest place with no more than what is left of subsets of k below it.
        at = F.size(F.filter(places, lambda c: binomial(c, k) <= acc["left"])) - 1
        return F.struct((acc["left"] - binomial(at, k)).alias("left"), F.concat(acc["s"], F.array(F.get(items, n - 1 - at))).alias("s"))

    start = F.struct((choose(n, size) - 1 - nth).cast("long").alias("left"), F.array().cast("array<int>").alias("s"))
    return F.aggregate(F.array(*map(F.lit, range(size, 0, -1))), start, digit, lambda acc: acc["s"])


def binomial(n: Column, k: Column) -> Column:
    """``choose`` for a column k of 1 or more."""
    return F.aggregate(F.sequence(F.lit(1), k), F.lit(1).cast("long"), lambda a, i: F.floor(a * F.greatest(n - i + 1, F.lit(0)) / i))


def rank_of(items: Column, s: Column) -> Column:
    """The number of a subset of a sorted array among those of its size, in lexicographic order."""
    n, k = F.size(items), F.size(s)
    after = F.transform(s, lambda v, i: F.struct((n - F.array_position(items, v)).cast("int").alias("at"), (k - i).alias("k")))
    return F.when(k == 0, F.lit(0).cast("long")).otherwise(binomial(n, F.greatest(k, F.lit(1))) - 1 - F.aggregate(after, F.lit(0).cast("long"), lambda a, c: a + binomial(c["at"], c["k"])))


def choose(n: Column, k: int) -> Column:
    """Binomial coefficient of a column, 0 where n < k."""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = F.floor(out * F.greatest(n - i, F.lit(0)) / (i + 1))
    return out


def set_key(s: Column) -> Column:
    return F.array_join(s, "|")


def sides(edges: DataFrame, level: int) -> DataFrame:
    """Two rows an edge (edge_x, edge_y, side, x, y, pool, n_pool, n_sets, first): x's other neighbours, how many sets they give, and the first one's number."""
    near = neighbours(edges)
    both = edges.select(F.col("x").alias("edge_x"), F.col("y").alias("edge_y"), F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.lit(1).alias("side"), F.col("y").alias("x"), F.col("x").alias("y")))))
    pool = both.join(near, F.col("x") == F.col("v")).withColumn("pool", F.array_remove("adj", F.col("y"))).withColumn("n_pool", F.size("pool")).drop("adj", "v").withColumn("n_sets", choose(F.col("n_pool"), level))
    # A side's tasks are numbered behind those of the sides before it, whose numbers are known without listing them.
    order = Window.orderBy("edge_x", "edge_y", "side").rowsBetween(Window.unboundedPreceding, -1)  # two rows an edge
    return pool.withColumn("first", F.coalesce(F.sum("n_sets").over(order), F.lit(0)).cast("long"))


def _as_tasks(tasks: DataFrame, level: int) -> DataFrame:
    return tasks.select((F.col("first") + F.col("nth")).cast("long").alias("task_id"), F.lit(level).alias("level"), "edge_x", "edge_y", "side", "x", "y", "s", ((F.col("nth") == 0) & (F.col("n_pool") > level)).alias("opens_next"))


def layer_plan(edges: DataFrame, level: int) -> DataFrame:
    """All tests of a level, in canonical order.

    Each edge is tested given the subsets of x's other neighbours, then of y's; a
    set that both sides offer is listed twice.  ``opens_next``: the first task of a
    side that has more neighbours than the level uses.
    """
    pool = sides(edges, level)
    if level == 0:
        return _as_tasks(pool.select("*", F.lit(0).cast("long").alias("nth"), F.array().cast("array<int>").alias("s")), level)
    # A row for each smallest member first, so that no row holds all sets of a side.
    heads = pool.select("*", F.posexplode("pool").alias("at", "head")).filter(F.col("at") <= F.col("n_pool") - level)
    rest = F.slice("pool", F.col("at") + 2, F.col("n_pool"))
    skipped = F.col("n_sets") - choose(F.col("n_pool") - F.col("at"), level)
    some = heads.select("*", skipped.alias("skipped"), F.posexplode(combinations(rest, level - 1)).alias("k", "tail"))
    return _as_tasks(some.select("*", (F.col("skipped") + F.col("k")).alias("nth"), F.concat(F.array("head"), "tail").alias("s")), level)


def plan_ranks(sided: DataFrame, level: int, start: int, stop: int) -> DataFrame:
    """Of the tests of ``layer_plan``, those that are an edge's ``start``-th (from 0) to before its ``stop``-th; no other is made.

    ``sided`` are the rows of ``sides`` for the edges that are asked for.
    """
    before = F.when(F.col("side") == 1, F.sum("n_sets").over(Window.partitionBy("edge_x", "edge_y")) - F.col("n_sets")).otherwise(F.lit(0))
    some = sided.withColumn("before", before.cast("long"))
    low, high = F.greatest(F.lit(start) - F.col("before"), F.lit(0)), F.least(F.lit(stop) - F.col("before"), F.col("n_sets"))
    return _as_tasks(spread(some, low, high, "nth").withColumn("s", unrank(F.col("pool"), level, F.col("nth"))), level)


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add a gapless number from 0 in the order of (group, order); no window holds more than a group, or a row for each."""
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(*group, F.coalesce(F.sum("_n").over(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # pairs of variables
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).join(first, list(group)).withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).select(*rows.columns, name)


def in_pcalg_order(tasks: DataFrame) -> DataFrame:
    """Tasks with ``rank``: their place by (x, y, set), the order in which random numbers are drawn elsewhere."""
    return numbered(tasks, ["x", "y"], ["s"], "rank")


def residual_requests(tasks: DataFrame) -> DataFrame:
    """Distinct (target, s) that the tasks need, with the first task that asks."""
    asked = tasks.filter(F.size("s") > 0).select("task_id", F.explode(F.array("x", "y")).alias("target"), "s")
    return asked.groupBy("target", "s").agg(F.min("task_id").alias("first_task"))


def effective_p(p: Column, na_delete: bool) -> Column:
    """A p-value as the decision uses it: what is not finite deletes the edge, or keeps it."""
    odd = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return F.when(odd, F.lit(1.0 if na_delete else 0.0)).otherwise(p)


def replay(tasks: DataFrame, alpha: float, na_delete: bool = True) -> DataFrame:
    """The tasks (with p) that a sequential search would have run, with the edge's first accepting task.

    In task order, an edge's tests count up to the first with p >= alpha.
    """
    p = effective_p(F.col("p"), na_delete)
    edge = Window.partitionBy("edge_x", "edge_y")
    marked = tasks.withColumn("p", p).withColumn("first_hit", F.min(F.when(F.col("p") >= alpha, F.col("task_id"))).over(edge))
    return marked.filter(F.col("first_hit").isNull() | (F.col("task_id") <= F.col("first_hit")))


def edge_outcome(consumed: DataFrame) -> DataFrame:
    """Rows (x, y, n_tests, pmax, deleted, s, opens) of a replayed level; ``opens``: whether a test of it opens the next level."""
    hit = F.col("task_id") == F.col("first_hit")
    out = consumed.groupBy(F.col("edge_x").alias("x"), F.col("edge_y").alias("y")).agg(F.count(F.lit(1)).alias("n_tests"), F.max("p").alias("pmax"), F.max(hit.cast("int")).alias("d"), F.max(F.when(hit, F.struct("task_id", "s"))).alias("h"), F.max("opens_next").alias("opens"))
    return out.select("x", "y", "n_tests", "pmax", (F.coalesce("d", F.lit(0)) == 1).alias("deleted"), F.col("h.s").alias("s"), "opens")


def perm_seed(base: int, test_id: Column) -> Column:
    """A test's permutation seed, from its number."""
    return F.pmod(F.lit(base).cast("long") + F.lit(1000003).cast("long") * test_id, F.lit(2147483647).cast("long"))


def named_seed(base: int, name: Column) -> Column:
    """A test's permutation seed, from the hash of its description."""
    part = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.pmod(F.lit(base).cast("long") + F.pmod(part, F.lit(2147483647).cast("long")), F.lit(2147483647).cast("long"))


def variables(spark: SparkSession, p: int) -> DataFrame:
    return spark.range(p).select(F.col("id").cast("int").alias("v"))
