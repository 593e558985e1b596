"""Graph patterns and single orientation passes as joins.

``pdag`` has rows (a, b, mark): 1 present, 2 conflict; a-b is undirected when both
(a, b) and (b, a) are 1, directed a->b when only (a, b) is.  Each pass here applies a
rule to the graph as it stands, all at once; the sequential fixpoint, in which one
write can stop the next, is in ``plans.orientation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layer


def skeleton_pdag(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    one = edges.select(F.col("x").alias("a"), F.col("y").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("mark", F.lit(1))


def edge_kinds(pdag: DataFrame) -> DataFrame:
    """Rows (a, b, kind) of directed edges a->b, and of undirected and bidirected ones with a < b."""
    back = pdag.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("mark").alias("back"))
    both = pdag.join(back, ["a", "b"], "left")
    kind = F.when(F.col("back").isNull(), "directed").when((F.col("mark") == 2) & (F.col("back") == 2), "bidirected").when((F.col("mark") == 1) & (F.col("back") == 1), "undirected").otherwise("mixed")
    return both.withColumn("kind", kind).filter((F.col("kind") == "directed") | (F.col("a") < F.col("b"))).select("a", "b", "kind")


def directed(pdag: DataFrame) -> DataFrame:
    back = pdag.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return pdag.filter("mark = 1").join(back, ["a", "b"], "left_anti").select("a", "b")


def undirected(pdag: DataFrame) -> DataFrame:
    """Rows (a, b) in both directions."""
    one = pdag.filter("mark = 1")
    return one.join(one.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).select("a", "b")


def adjacent(pdag: DataFrame) -> DataFrame:
    return pdag.select("a", "b").unionByName(pdag.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def unshielded_triples(pdag: DataFrame) -> DataFrame:
    """Rows (x, y, z), x < z: x-y-z with x and z not adjacent."""
    u, adj = undirected(pdag), adjacent(pdag)
    two = u.select(F.col("a").alias("x"), F.col("b").alias("y")).join(u.select(F.col("a").alias("y"), F.col("b").alias("z")), "y").filter("x < z")
    return two.join(adj.select(F.col("a").alias("x"), F.col("b").alias("z")), ["x", "z"], "left_anti").select("x", "y", "z")


def colliders(pdag: DataFrame, sepsets: DataFrame, unfaithful: DataFrame | None = None) -> DataFrame:
    """Unshielded triples whose middle is not in the ends' separating set (x, y, s with x < y), less unfaithful ones."""
    t = unshielded_triples(pdag)
    if unfaithful is not None:
        t = t.join(unfaithful.select("x", "y", "z"), ["x", "y", "z"], "left_anti")
    s = sepsets.select(F.col("x"), F.col("y").alias("z"), "s")
    return t.join(s, ["x", "z"], "left").filter(~F.coalesce(F.array_contains("s", F.col("y")), F.lit(False))).select("x", "y", "z")


def rule1(pdag: DataFrame) -> DataFrame:
    """b->c for a->b, b-c, a and c not adjacent."""
    d, u, adj = directed(pdag), undirected(pdag), adjacent(pdag)
    two = d.join(u.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").filter("a != c")
    return two.join(adj.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti").select(F.col("b").alias("a"), F.col("c").alias("b")).distinct()


def rule2(pdag: DataFrame) -> DataFrame:
    """a->b for a-b and a->c->b."""
    d, u = directed(pdag), undirected(pdag)
    path = d.select("a", F.col("b").alias("c")).join(d.select(F.col("a").alias("c"), "b"), "c").select("a", "b").distinct()
    return u.join(path, ["a", "b"], "left_semi").select("a", "b")


def rule3(pdag: DataFrame) -> DataFrame:
    """a->b for a-b and two non-adjacent c with a-c->b."""
    d, u, adj = directed(pdag), undirected(pdag), adjacent(pdag)
    via = u.join(u.select("a", F.col("b").alias("c")), "a").filter("b != c").join(d.select(F.col("a").alias("c"), "b"), ["b", "c"])
    two = via.select("a", "b", F.col("c").alias("c1")).join(via.select("a", "b", F.col("c").alias("c2")), ["a", "b"]).filter("c1 < c2")
    return two.join(adj.select(F.col("a").alias("c1"), F.col("b").alias("c2")), ["c1", "c2"], "left_anti").select("a", "b").distinct()


def check_immor(pdag: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (v, s, ok): whether s is a clique and every parent of v is adjacent to all of s."""
    d, adj = directed(pdag), adjacent(pdag)
    q = asked.withColumn("key", F.array_join("s", "|"))
    items = q.select("v", "key", F.explode("s").alias("m"))
    inner = items.join(items.select("v", "key", F.col("m").alias("o")), ["v", "key"]).filter("m < o").select("v", "key", "m", "o")
    outer = items.join(d.select(F.col("a").alias("o"), F.col("b").alias("v")), "v").filter("m != o").select("v", "key", "m", "o")
    missing = inner.unionByName(outer).join(adj.select(F.col("a").alias("m"), F.col("b").alias("o")), ["m", "o"], "left_anti").select("v", "key").distinct().withColumn("bad", F.lit(True))
    return q.join(missing, ["v", "key"], "left").select("v", "s", F.col("bad").isNull().alias("ok"))


def triple_tests(edges: DataFrame) -> DataFrame:
    """Rows (x, y, z, s): for each unshielded triple x-y-z, x < z, the subsets of either end's other neighbours."""
    t = unshielded_triples(skeleton_pdag(edges))
    near = layer.neighbours(edges)
    pool = lambda end, other: t.join(near, F.col(end) == F.col("v")).select("x", "y", "z", F.array_remove("adj", F.col(other)).alias("pool"))
    masks = layer.spread(pool("x", "z").unionByName(pool("z", "x")), F.lit(0), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("pool")), "mask")
    return masks.select("x", "y", "z", layer.masked(F.col("pool"), F.col("mask")).alias("s")).distinct()


def unfaithful(tests: DataFrame, alpha: float, majority: bool = False) -> DataFrame:
    """Rows (x, y, z, share) of ambiguous triples, from triple tests with p.

    Of the sets that separate the ends, ``share`` hold the middle: some but not all of them, or half of them by majority.
    """
    holds = F.array_contains("s", F.col("y")).cast("double")
    share = tests.filter(F.col("p") >= alpha).groupBy("x", "y", "z").agg(F.avg(holds).alias("share"))
    return share.filter(F.col("share") == 0.5 if majority else (F.col("share") > 0) & (F.col("share") < 1))
