"""Registered queries of the causal engine, and their SQL.

All run over whole tables.  Observations are suppliers (with what their line items
sum up to), nations, or orders; graphs are over nations, with edges and p-values by
integer arithmetic on keys, so that graph operators are checked without floats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CIConfig, DiscoverConfig
from ..functions import kernels, sorted_sums, splines, tiles
from ..functions.special import gamma_upper, normal_two_sided_col
from ..operators import analytics, graphdiff, layer, patterns, precision, regression
from ..sources.matrix import complete_cases, descriptor, moments, to_long
from ..streaming.windows import window_moments
from .discover import discover
from .providers import formula_provider, gauss_provider
from .skeleton import search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0)


# ---- Inputs ---------------------------------------------------------------------------------


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return _t(spark, sf, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_suppkey").alias("i"), (F.col("s_acctbal") / 10000).alias("v0"), (F.col("q") / 10000).alias("v1"), (F.col("e") / 1e7).alias("v2"), (F.col("d") * 10).alias("v3"), (F.col("t") * 10).alias("v4"))


_SUP = "m AS (SELECT s_suppkey AS i, s_acctbal / 10000 AS v0, q / 10000 AS v1, e / 1e7::DOUBLE AS v2, d * 10 AS v3, t * 10 AS v4 FROM supplier JOIN (SELECT l_suppkey, sum(l_quantity) AS q, sum(l_extendedprice) AS e, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey)"


def nations(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("b"), F.count(F.lit(1)).cast("double").alias("n"))
    return _t(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_nationkey").alias("i"), (F.col("b") / 1000).alias("v0"), (F.col("n") / 10).alias("v1"))


_NAT = "m AS (SELECT n_nationkey AS i, b / 1000 AS v0, n / 10 AS v1 FROM nation JOIN (SELECT c_nationkey, avg(c_acctbal) AS b, count(*)::DOUBLE AS n FROM customer GROUP BY c_nationkey) ON n_nationkey = c_nationkey)"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return _t(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1e5).alias("v0"), (F.col("q") / 100).alias("v1"), (F.col("e") / 1e6).alias("v2"), (F.col("d") * 10).alias("v3"), (F.col("t") * 10).alias("v4"))


_ORD = "m AS (SELECT o_orderkey AS i, o_totalprice / 1e5::DOUBLE AS v0, q / 100 AS v1, e / 1e6::DOUBLE AS v2, d * 10 AS v3, t * 10 AS v4 FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_extendedprice) AS e, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"
FIVE = ["v0", "v1", "v2", "v3", "v4"]


def graph(spark: SparkSession, sf: str, k: int = 4) -> DataFrame:
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    both = n.select(F.col("k").alias("x"), F.col("r").alias("rx")).join(n.select(F.col("k").alias("y"), F.col("r").alias("ry")), F.col("x") < F.col("y"))
    return both.filter((F.col("x") * 7 + F.col("y") * 3 + F.col("rx") * 5 + F.col("ry")) % k == 0).select("x", "y")


def nation_gaps(spark: SparkSession, sf: str, k: int = 4) -> tuple[int, list[tuple[int, int]]]:
    """The number of nations, and the pairs that the nation graph does not join."""
    n = _t(spark, sf, "nation").select(F.max("n_nationkey").alias("n")).first().n + 1
    joined = {(r.x, r.y) for r in graph(spark, sf, k).collect()}  # edges over nations
    return n, [(x, y) for x in range(n) for y in range(x + 1, n) if (x, y) not in joined]


def _g(k: int = 4, name: str = "g") -> str:
    return f"{name} AS (SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE (a.n_nationkey * 7 + b.n_nationkey * 3 + a.n_regionkey * 5 + b.n_regionkey) % {k} = 0)"


_BOTH = "bw AS (SELECT x AS v, y AS u FROM g UNION ALL SELECT y, x FROM g)"


def formula_p(x: Column, y: Column, s: Column) -> Column:
    """A p-value by integer arithmetic, alike for (x, y) and (y, x)."""
    total = F.aggregate(s, F.lit(0).cast("long"), lambda a, v: a + v * 13)
    return F.pmod(F.least(x, y).cast("long") * 7919 + F.greatest(x, y) * 104729 + F.size(s) * 31 + total, F.lit(1000).cast("long")) / 1000.0


def mixed_pdag(spark: SparkSession, sf: str, k: int = 4) -> DataFrame:
    """The nation graph, a third each undirected, x->y and y->x, and some conflicts."""
    m = (F.col("x") + 2 * F.col("y")) % 3
    e = graph(spark, sf, k).withColumn("m", m).withColumn("c", (F.col("x") * F.col("y")) % 11 == 7)
    one = e.filter((F.col("m") != 2) | F.col("c")).select(F.col("x").alias("a"), F.col("y").alias("b"), F.when(F.col("c"), 2).otherwise(1).alias("mark"))
    two = e.filter((F.col("m") != 1) | F.col("c")).select(F.col("y").alias("a"), F.col("x").alias("b"), F.when(F.col("c"), 2).otherwise(1).alias("mark"))
    return one.unionByName(two)


def _pd(k: int = 4, name: str = "pd") -> str:
    return f"e{name} AS (SELECT x, y, (x + 2 * y) % 3 AS m, (x * y) % 11 = 7 AS c FROM ({_g(k, 'q')[5:]})), {name} AS (SELECT x AS a, y AS b, CASE WHEN c THEN 2 ELSE 1 END AS mark FROM e{name} WHERE m <> 2 OR c UNION ALL SELECT y, x, CASE WHEN c THEN 2 ELSE 1 END FROM e{name} WHERE m <> 1 OR c)"


_VIEWS = f"{_pd()}, dir AS (SELECT a, b FROM pd p WHERE mark = 1 AND NOT EXISTS (SELECT 1 FROM pd q WHERE q.a = p.b AND q.b = p.a)), und AS (SELECT p.a, p.b FROM pd p JOIN pd q ON q.a = p.b AND q.b = p.a WHERE p.mark = 1 AND q.mark = 1), adj AS (SELECT a, b FROM pd UNION SELECT b, a FROM pd)"

# ---- Sources --------------------------------------------------------------------------------


@query("matrix_long", f"WITH {_NAT} SELECT i AS row_id, 0 AS var, round(v0, 6) AS value FROM m UNION ALL SELECT i, 1, round(v1, 6) FROM m")
def _(spark, sf):
    return to_long(nations(spark, sf), "i", ["v0", "v1"]).select("row_id", "var", _r("value").alias("value"))


@query("matrix_descriptor", f"WITH {_ORD} SELECT count(*) AS n, 5 AS p, false AS has_missing, true AS all_finite FROM m")
def _(spark, sf):
    return descriptor(orders(spark, sf), FIVE).select("n", "p", "has_missing", "all_finite")


@query("complete_cases", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_custkey IS NOT NULL AND c_nationkey IS NOT NULL AND isfinite(c_acctbal)")
def _(spark, sf):
    return complete_cases(_t(spark, sf, "customer")).agg(F.count(F.lit(1)).alias("n"), _r(F.sum("c_acctbal"), 2).alias("total"))


# ---- Kernels --------------------------------------------------------------------------------


@query("pairwise_distance", f"WITH {_NAT} SELECT a.i AS i, b.i AS j, round(abs(a.v0 - b.v0), 6) + 0.0 AS d FROM m a CROSS JOIN m b")
def _(spark, sf):
    return kernels.pairs(nations(spark, sf), ["v0"]).select("i", "j", _r(kernels.distance(["v0"])).alias("d"))


@query("distance_index", f"WITH {_SUP} SELECT round(avg(pow(sqrt((a.v0 - b.v0) * (a.v0 - b.v0) + (a.v1 - b.v1) * (a.v1 - b.v1)), 0.5)), 6) AS mean_distance FROM m a CROSS JOIN m b")
def _(spark, sf):
    return kernels.pairs(suppliers(spark, sf), ["v0", "v1"]).agg(_r(F.avg(kernels.distance(["v0", "v1"], 0.5, False))).alias("mean_distance"))


@query("rbf_gram_mean", f"WITH {_SUP} SELECT round(avg(exp(-(a.v0 - b.v0) * (a.v0 - b.v0) / 0.5)), 6) AS mean_k, round(avg(CASE WHEN a.i <> b.i THEN exp(-(a.v0 - b.v0) * (a.v0 - b.v0) / 0.5) END), 6) AS off_diagonal FROM m a CROSS JOIN m b")
def _(spark, sf):
    k = kernels.pairs(suppliers(spark, sf), ["v0"]).withColumn("k", kernels.rbf("v0", 0.5))
    return k.agg(_r(F.avg("k")).alias("mean_k"), _r(kernels.off_diagonal_mean(k, "k")).alias("off_diagonal"))


@query("double_centre", f"WITH {_NAT}, p AS (SELECT a.i AS i, b.i AS j, abs(a.v0 - b.v0) AS k FROM m a CROSS JOIN m b) SELECT i, j, round(k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER (), 6) + 0.0 AS c FROM p")
def _(spark, sf):
    k = kernels.pairs(nations(spark, sf), ["v0"]).withColumn("k", kernels.distance(["v0"]))
    return kernels.double_centre(k, "k", "c").select("i", "j", _r("c").alias("c"))


# ---- Tests ----------------------------------------------------------------------------------


def _q(a: str, x: str) -> str:
    """The upper gamma tail as a sum of its series' terms."""
    return f"greatest(0.0, least(1.0, 1 - list_sum(list_transform(range(0, 601), lambda k: exp(-({x}) + (({a}) + k) * ln({x}) - lgamma(({a}) + k + 1))))))"


def _moment_sql(base: str, k: str, l: str, hsic: bool = False) -> str:
    tail = "shape, stat / (variance / mean)"
    mean = "(1 + mk * ml - mk - ml) / n" if hsic else "gk * gl"
    stat, var = ("ab / (n * n)", "pow(n, 4)") if hsic else ("ab / n", "(n * n)")
    return f"""WITH {base}, p AS (SELECT a.i AS i, b.i AS j, {k} AS k, {l} AS l FROM m a CROSS JOIN m b),
    c AS (SELECT *, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS a, l - avg(l) OVER (PARTITION BY i) - avg(l) OVER (PARTITION BY j) + avg(l) OVER () AS b FROM p),
    s AS (SELECT sqrt(count(*)::DOUBLE) AS n, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, avg(k) AS gk, avg(l) AS gl, avg(CASE WHEN i <> j THEN k END) AS mk, avg(CASE WHEN i <> j THEN l END) AS ml FROM c),
    t AS (SELECT n, {stat} AS stat, {mean} AS mean, 2 * (n - 4) * (n - 5) / (n * (n - 1) * (n - 2) * (n - 3)) * aa * bb / {var} AS variance FROM s),
    u AS (SELECT *, mean * mean / variance AS shape, stat / (variance / mean) AS xx FROM t)
    SELECT round(stat, 6) AS statistic, round(mean, 6) AS mean, round(variance, 6) AS variance, round({_q("shape", "xx")}, 6) AS p_value FROM u"""


def _rounded(t: DataFrame) -> DataFrame:
    return t.select(_r("statistic").alias("statistic"), _r("mean").alias("mean"), _r("variance").alias("variance"), _r("p_value").alias("p_value"))


def _d(c: str) -> str:
    return f"abs(a.{c} - b.{c})"


def _k(c: str, sig: float = 1.0) -> str:
    return f"exp(-(a.{c} - b.{c}) * (a.{c} - b.{c}) / {sig})"


@query("dcov_gamma_pvalue", _moment_sql(_SUP, _d("v1"), _d("v2")))
def _(spark, sf):
    return _rounded(kernels.dcov_tail(sorted_sums.distance_sums(suppliers(spark, sf), "v1", "v2")))


@query("dcov_sorted_blocks", _moment_sql(_SUP, _d("v0"), _d("v3")))
def _(spark, sf):
    return _rounded(kernels.dcov_tail(sorted_sums.distance_sums(suppliers(spark, sf), "v0", "v3", block=8)))


def _large_sql(k: str, l: str, hsic: bool = False) -> str:
    """``_moment_sql`` over all orders, from sums of each row's pairs."""
    mean = "(1 + mk * ml - mk - ml) / n" if hsic else "sk / (n * n) * (sl / (n * n))"
    stat, var = ("ab / (n * n)", "pow(n, 4)") if hsic else ("ab / n", "(n * n)")
    return f"""WITH {_ORD}, r AS (SELECT i, sum(k) AS rk, sum(l) AS rl, sum(k * l) AS kl, sum(k * k) AS kk, sum(l * l) AS ll, sum(k) FILTER (i <> j) AS ok, sum(l) FILTER (i <> j) AS ol FROM (SELECT a.i AS i, b.i AS j, {k} AS k, {l} AS l FROM m a CROSS JOIN m b) GROUP BY i),
    s AS (SELECT count(*)::DOUBLE AS n, sum(rk) AS sk, sum(rl) AS sl, sum(kl) - 2 / count(*) * sum(rk * rl) + sum(rk) * sum(rl) / pow(count(*), 2) AS ab, sum(kk) - 2 / count(*) * sum(rk * rk) + pow(sum(rk) / count(*), 2) AS aa, sum(ll) - 2 / count(*) * sum(rl * rl) + pow(sum(rl) / count(*), 2) AS bb, sum(ok) / (count(*) * (count(*) - 1.0)) AS mk, sum(ol) / (count(*) * (count(*) - 1.0)) AS ml FROM r),
    t AS (SELECT n, {stat} AS stat, {mean} AS mean, 2 * (n - 4) * (n - 5) / (n * (n - 1) * (n - 2) * (n - 3)) * aa * bb / {var} AS variance FROM s),
    u AS (SELECT *, mean * mean / variance AS shape, stat / (variance / mean) AS xx FROM t)
    SELECT round(stat, 6) AS statistic, round(mean, 6) AS mean, round(variance, 6) AS variance, round({_q("shape", "xx")}, 6) AS p_value FROM u"""


@query("dcov_sorted_orders", _large_sql(_d("v0"), _d("v3")))
def _(spark, sf):
    return _rounded(kernels.dcov_tail(sorted_sums.distance_sums(orders(spark, sf), "v0", "v3")))


@query("hsic_tiled_orders", _large_sql(_k("v0"), _k("v3"), True))
def _(spark, sf):
    return _rounded(kernels.hsic_tail(tiles.centred_sums(orders(spark, sf), tiles.Kernel(("v0",), "rbf"), tiles.Kernel(("v3",), "rbf"), 2048)))


@query("dcov_index", _moment_sql(_SUP, f"pow({_d('v0')}, 1.5)", f"pow({_d('v3')}, 1.5)"))
def _(spark, sf):
    return _rounded(kernels.dcov_tail(tiles.centred_sums(suppliers(spark, sf), tiles.Kernel(("v0",), index=1.5), tiles.Kernel(("v3",), index=1.5))))


_E2 = "sqrt((a.{0} - b.{0}) * (a.{0} - b.{0}) + (a.{1} - b.{1}) * (a.{1} - b.{1}))"


@query("dcov_multivariate", _moment_sql(_SUP, _E2.format("v0", "v1"), _E2.format("v2", "v3")))
def _(spark, sf):
    return _rounded(kernels.dcov_tail(tiles.centred_sums(suppliers(spark, sf), tiles.Kernel(("v0", "v1")), tiles.Kernel(("v2", "v3")), 16)))


@query("hsic_gamma", _moment_sql(_SUP, _k("v1"), _k("v2"), True))
def _(spark, sf):
    return _rounded(kernels.hsic_tail(tiles.centred_sums(suppliers(spark, sf), tiles.Kernel(("v1",), "rbf"), tiles.Kernel(("v2",), "rbf"))))


def _perm_sql(base: str, k: str, l: str, reps: int, seed: int, scale: str, over: str, inc: int) -> str:
    return f"""WITH {base}, p AS (SELECT a.i AS i, b.i AS j, {k} AS k, {l} AS l FROM m a CROSS JOIN m b),
    c AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS a, l - avg(l) OVER (PARTITION BY i) - avg(l) OVER (PARTITION BY j) + avg(l) OVER () AS b FROM p),
    r AS (SELECT i, unnest(range({reps})) AS rep FROM m),
    o AS (SELECT rep, i, row_number() OVER (PARTITION BY rep ORDER BY i) AS rn, row_number() OVER (PARTITION BY rep ORDER BY md5('{seed}|' || rep || '|' || i)) AS rm FROM r),
    f AS (SELECT x.rep AS rep, x.i AS i, y.i AS pi FROM o x JOIN o y ON x.rep = y.rep AND x.rn = y.rm),
    s AS (SELECT f.rep, sum(c.a * d.b) AS s FROM c JOIN f ON c.i = f.i JOIN f g ON g.rep = f.rep AND c.j = g.i JOIN c d ON d.i = f.pi AND d.j = g.pi GROUP BY f.rep),
    z AS (SELECT sum(a * b) AS s0 FROM c)
    SELECT round(any_value(s0) * {scale}, 6) AS statistic, count(*) AS replicates, sum(CASE WHEN {over} THEN 1 ELSE 0 END)::BIGINT AS exceedances, round((sum(CASE WHEN {over} THEN 1 ELSE 0 END) + {inc}) / (count(*) + {inc})::DOUBLE, 6) AS p_value FROM s, z"""


_GE, _GT = "s >= s0 - 1e-9 * abs(s0)", "s > s0 + 1e-9 * abs(s0)"
_N = "(SELECT count(*) FROM m)"


def _perm(spark, sf, kind, scale, strict=False):
    t = tiles.permutation_test(nations(spark, sf), tiles.Kernel(("v0",), kind), tiles.Kernel(("v1",), kind), 20, 5, scale, strict=strict, tile=8)
    return t.select(_r("statistic").alias("statistic"), "replicates", "exceedances", _r("p_value").alias("p_value"))


@query("dcov_perm", _perm_sql(_NAT, _d("v0"), _d("v1"), 20, 5, f"1.0 / {_N}", _GE, 1))
def _(spark, sf):
    return _perm(spark, sf, "distance", lambda n: 1 / n)


@query("hsic_perm", _perm_sql(_NAT, _k("v0"), _k("v1"), 20, 5, f"1.0 / ({_N} * {_N})", _GE, 1))
def _(spark, sf):
    return _perm(spark, sf, "rbf", lambda n: 1 / (n * n))


@query("hsic_test_perm_strict", _perm_sql(_NAT, _k("v0"), _k("v1"), 20, 5, f"1.0 / ({_N} * {_N})", _GT, 0))
def _(spark, sf):
    return _perm(spark, sf, "rbf", lambda n: 1 / (n * n), True)


def _gauss_sql(r: str, size: int) -> str:
    z = f"(sqrt(greatest(n - {size} - 3, 0)) * 0.5 * ln((1 + {r}) / (1 - {r})))"
    return f"CASE WHEN {z} * {z} / 2 > 200 THEN 0.0 ELSE round({_q('0.5', f'least(200.0, greatest(1e-300, {z} * {z} / 2))')}, 6) END"


@query("gauss_ci", f"WITH {_ORD}, c AS (SELECT count(*) AS n, corr(v0, v1) AS r, corr(v0, v2) AS rx, corr(v1, v2) AS ry FROM m), d AS (SELECT *, (r - rx * ry) / sqrt((1 - rx * rx) * (1 - ry * ry)) AS q FROM c) SELECT round(r, 6) AS corr, {_gauss_sql('r', 0)} AS p_value, round(q, 6) AS partial, {_gauss_sql('q', 1)} AS p_partial FROM d")
def _(spark, sf):
    c = orders(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.corr("v0", "v1").alias("r"), F.corr("v0", "v2").alias("rx"), F.corr("v1", "v2").alias("ry"))
    c = c.withColumn("q", (F.col("r") - F.col("rx") * F.col("ry")) / F.sqrt((1 - F.col("rx") * F.col("rx")) * (1 - F.col("ry") * F.col("ry"))))
    z = lambda r, size: normal_two_sided_col(F.sqrt(F.greatest(F.col("n") - size - 3, F.lit(0))) * 0.5 * F.log((1 + F.col(r)) / (1 - F.col(r))))
    return c.select(_r("r").alias("corr"), _r(z("r", 0)).alias("p_value"), _r("q").alias("partial"), _r(z("q", 1)).alias("p_partial"))


@query("gamma_tail", f"WITH p AS (SELECT p_size / 5.0 + 0.5 AS a, p_retailprice / 100 AS x FROM part), s AS (SELECT DISTINCT a, round(x) AS x FROM p) SELECT a, x, round({_q('a', 'x')}, 6) AS q FROM s WHERE x > 0")
def _(spark, sf):
    s = _t(spark, sf, "part").select((F.col("p_size") / 5.0 + 0.5).alias("a"), F.round(F.col("p_retailprice") / 100).alias("x")).distinct().filter("x > 0")
    return s.select("a", "x", _r(gamma_upper(F.col("a"), F.col("x"))).alias("q"))


@query("dcov_by_region")
def _(spark, sf):
    from ..functions.udfs import dcov_pvalue, hsic_pvalue

    m = suppliers(spark, sf).join(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), "s_nationkey"), "i").join(_t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return m.groupBy("n_regionkey").agg(_r(dcov_pvalue("v1", "v2")).alias("dcov_p"), _r(hsic_pvalue("v1", "v2")).alias("hsic_p"))


@query("combos_udtf", "WITH r AS (SELECT n_regionkey AS region, n_nationkey AS k FROM nation), c AS (SELECT a.region, a.k AS a, b.k AS b FROM r a JOIN r b ON a.region = b.region AND a.k < b.k) SELECT region, row_number() OVER (PARTITION BY region ORDER BY a, b) - 1 AS nth, a || '|' || b AS s_key FROM c")
def _(spark, sf):
    from ..functions.udfs import register

    register(spark)
    n = _t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_list("n_nationkey").alias("k"))
    out = spark.sql("SELECT region, nth, s FROM {n}, LATERAL combos(k, 2)", n=n)
    return out.select("region", F.col("nth").cast("long").alias("nth"), layer.set_key(F.col("s")).alias("s_key"))


# ---- Regression -----------------------------------------------------------------------------


@query("ols_residual_1", f"WITH {_ORD}, f AS (SELECT regr_slope(v2, v1) AS b, avg(v2) AS my, avg(v1) AS mx FROM m), r AS (SELECT i, v2 - my - b * (v1 - mx) AS resid FROM m, f) SELECT i, round(resid, 6) + 0.0 AS resid FROM r")
def _(spark, sf):
    return regression.ols_residual_1(orders(spark, sf), "v2", "v1").select("i", _r("resid").alias("resid"))


@query("ols_residual_2", f"WITH {_ORD}, k AS (SELECT avg(v2) AS my, avg(v1) AS ma, avg(v0) AS mb, covar_pop(v1, v1) AS aa, covar_pop(v0, v0) AS bb, covar_pop(v1, v0) AS ab, covar_pop(v1, v2) AS ay, covar_pop(v0, v2) AS cy FROM m), f AS (SELECT my, ma, mb, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS ca, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM k) SELECT i, round(v2 - my - ca * (v1 - ma) - cb * (v0 - mb), 6) + 0.0 AS resid FROM m, f")
def _(spark, sf):
    return regression.ols_residual_2(orders(spark, sf), "v2", "v1", "v0").select("i", _r("resid").alias("resid"))


@query("ols_residual_4")
def _(spark, sf):
    return regression.ols_residual(orders(spark, sf), "v2", ["v0", "v1", "v3", "v4"]).select("i", _r("resid").alias("resid"))


_RES = f"{_SUP.replace('m AS', 'm0 AS', 1)}, f AS (SELECT regr_slope(v1, v0) AS b1, avg(v1) AS m1, regr_slope(v2, v0) AS b2, avg(v2) AS m2, avg(v0) AS mx FROM m0), m AS (SELECT i, v1 - m1 - b1 * (v0 - mx) AS r1, v2 - m2 - b2 * (v0 - mx) AS r2 FROM m0, f)"


@query("cond_dcov_1", _moment_sql(_RES, _d("r1"), _d("r2")))
def _(spark, sf):
    m = regression.ols_residual_1(suppliers(spark, sf), "v1", "v0").withColumnRenamed("resid", "r1")
    m = regression.ols_residual_1(m, "v2", "v0").withColumnRenamed("resid", "r2")
    return _rounded(kernels.dcov_tail(sorted_sums.distance_sums(m, "r1", "r2")))


@query("cond_hsic_1", _moment_sql(_RES, _k("r1", 0.1), _k("r2", 0.1), True))
def _(spark, sf):
    m = regression.ols_residual_1(suppliers(spark, sf), "v1", "v0").withColumnRenamed("resid", "r1")
    m = regression.ols_residual_1(m, "v2", "v0").withColumnRenamed("resid", "r2")
    return _rounded(kernels.hsic_tail(tiles.centred_sums(m, tiles.Kernel(("r1",), "rbf", sig=0.1), tiles.Kernel(("r2",), "rbf", sig=0.1))))


_Q10 = ", ".join(f"{i}/9.0" for i in range(10))


@query("quantile_knots", f"SELECT unnest(range(10)) AS knot, round(unnest(quantile_cont(o_totalprice, [{_Q10}])), 4) AS knot_at FROM orders")
def _(spark, sf):
    k = _t(spark, sf, "orders").agg(F.percentile("o_totalprice", F.array(*(F.lit(i / 9.0) for i in range(10)))).alias("k"))
    return k.select(F.posexplode("k").alias("knot", "at")).select(F.col("knot").cast("long").alias("knot"), _r("at", 4).alias("knot_at"))


@query("spline_basis", f"""WITH {_SUP}, k AS (SELECT quantile_cont(v0, [{_Q10}]) AS k FROM m), c AS (SELECT unnest(range(10)) AS b, unnest(k) AS c FROM k),
    w AS (SELECT 2.5 * min(g) AS w FROM (SELECT c - lag(c) OVER (ORDER BY b) AS g FROM c) WHERE g > 0), r AS (SELECT i, b, pow(greatest(0.0, 1 - abs(v0 - c) / w), 3) AS v, abs(v0 - c) AS d FROM m, c, w),
    t AS (SELECT *, sum(v) OVER (PARTITION BY i) AS s, row_number() OVER (PARTITION BY i ORDER BY d, b) AS near FROM r)
    SELECT i, b AS basis, round(CASE WHEN s > 0 THEN v / s WHEN near = 1 THEN 1.0 ELSE 0.0 END, 6) AS value FROM t""")
def _(spark, sf):
    m = suppliers(spark, sf)
    k = m.agg(F.percentile("v0", F.array(*(F.lit(i / 9.0) for i in range(10)))).alias("k"))
    rows = m.crossJoin(F.broadcast(k)).select("i", F.posexplode(splines.bump_basis_col(F.col("v0"), F.col("k"))).alias("basis", "value"))  # one row of ten knots
    return rows.select("i", F.col("basis").cast("long").alias("basis"), _r("value").alias("value"))


@query("lambda_grid", f"WITH {_SUP}, l AS (SELECT i AS step, exp(ln(1e-4) * (1 - i / 24.0) + ln(1e4) * (i / 24.0)) AS lam FROM range(25) t(i)) SELECT step, round(lam, 6) AS smoothing, round(sum(v0 * v0 / (v0 * v0 + lam)), 6) AS freedom FROM m, l GROUP BY step, lam")
def _(spark, sf):
    """How much freedom each smoothing parameter leaves to the suppliers' balances."""
    rows = suppliers(spark, sf).select("v0", F.posexplode(splines.lambda_grid_col()).alias("step", "l"))
    return rows.groupBy(F.col("step").cast("long").alias("step"), _r("l").alias("smoothing")).agg(_r(F.sum(F.col("v0") * F.col("v0") / (F.col("v0") * F.col("v0") + F.col("l")))).alias("freedom"))


@query("penalty_second_difference", "WITH c AS (SELECT o_orderpriority AS priority, o_orderkey % 10 AS j, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT p.priority, r.j, coalesce(n, 0) AS n FROM (SELECT DISTINCT priority FROM c) p CROSS JOIN range(10) r(j) LEFT JOIN c ON c.priority = p.priority AND c.j = r.j) SELECT x.priority, sum(pow(x.n - 2 * y.n + z.n, 2)) AS roughness FROM b x JOIN b y ON x.priority = y.priority AND y.j = x.j + 1 JOIN b z ON x.priority = z.priority AND z.j = x.j + 2 GROUP BY x.priority")
def _(spark, sf):
    """How rough the orders of each priority are over ten classes of keys: a quadratic form of the penalty."""
    p = splines.second_difference_penalty(10)
    penalty = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(10) for j in range(10)], "i int, j int, value double")
    n = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), (F.col("o_orderkey") % 10).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    a, b = n.withColumnsRenamed({"k": "i", "n": "a"}), n.withColumnsRenamed({"k": "j", "n": "b"})
    return a.join(F.broadcast(penalty), "i").join(b, ["priority", "j"]).groupBy("priority").agg(F.sum(F.col("a") * F.col("value") * F.col("b")).alias("roughness"))  # a hundred numbers


# ---- Planning -------------------------------------------------------------------------------


@query("complete_graph", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def _(spark, sf):
    return layer.complete_graph(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("v")))


@query("neighbours", f"WITH {_g()}, {_BOTH} SELECT v, string_agg(u::VARCHAR, '|' ORDER BY u) AS adj FROM bw GROUP BY v")
def _(spark, sf):
    return layer.neighbours(graph(spark, sf)).select("v", F.array_join("adj", "|").alias("adj"))


def _plan_sql(level: int, k: int = 4) -> str:
    joins, where = "", ""
    for i in range(1, level + 1):
        joins += f" JOIN bw n{i} ON n{i}.v = s.x AND n{i}.u <> s.y" + (f" AND n{i}.u > n{i - 1}.u" if i > 1 else "")
    cols = " || '|' || ".join(f"n{i}.u" for i in range(1, level + 1)) or "''"
    arr = ", ".join(f"n{i}.u" for i in range(1, level + 1))
    order = f", {arr}" if arr else ""
    size = "SELECT count(*) FROM bw WHERE bw.v = s.x AND bw.u <> s.y"
    first = f"row_number() OVER (PARTITION BY edge_x, edge_y, side ORDER BY 1{order})"
    return f"""WITH {_g(k)}, {_BOTH}, s AS (SELECT x AS edge_x, y AS edge_y, 0 AS side, x, y FROM g UNION ALL SELECT x, y, 1, y, x FROM g), d AS (SELECT v, count(*) AS deg FROM bw GROUP BY v),
    plan AS (SELECT row_number() OVER (ORDER BY edge_x, edge_y, side{order}) - 1 AS task_id, {level} AS level, edge_x, edge_y, side, s.x AS x, s.y AS y, CAST({cols} AS VARCHAR) AS s_key, {first} = 1 AND d.deg - 1 > {level} AS opens_next FROM s JOIN d ON d.v = s.x{joins})"""


for _level in (0, 1, 2, 3):

    @query(f"layer_plan_{_level}", f"{_plan_sql(_level)} SELECT * FROM plan")
    def _(spark, sf, level=_level):
        return layer.layer_plan(graph(spark, sf), level).withColumn("s_key", layer.set_key(F.col("s"))).drop("s")


@query("natural_stop_flag", f"{_plan_sql(1)} SELECT count(*) FILTER (WHERE opens_next) > 0 AS goes_on, count(*) AS planned FROM plan")
def _(spark, sf):
    return layer.layer_plan(graph(spark, sf), 1).agg((F.sum(F.col("opens_next").cast("int")) > 0).alias("goes_on"), F.count(F.lit(1)).alias("planned"))


@query("unique_residual_requests", f"{_plan_sql(2)}, r AS (SELECT task_id, x AS target, s_key FROM plan UNION ALL SELECT task_id, y, s_key FROM plan) SELECT target, s_key, min(task_id) AS first_task FROM r GROUP BY ALL")
def _(spark, sf):
    return layer.residual_requests(layer.layer_plan(graph(spark, sf), 2)).select("target", layer.set_key(F.col("s")).alias("s_key"), "first_task")


@query("fixed_gaps", f"WITH {_g(2)}, {_g(4, 'h')} SELECT x, y FROM g EXCEPT SELECT x, y FROM h")
def _(spark, sf):
    return layer.apply_gaps(graph(spark, sf, 2), graph(spark, sf, 4).select(F.col("y").alias("x"), F.col("x").alias("y")))


@query("combinations_3", "WITH r AS (SELECT n_regionkey AS r, n_nationkey AS k FROM nation) SELECT a.r AS region, a.k || '|' || b.k || '|' || c.k AS s_key FROM r a JOIN r b ON a.r = b.r AND a.k < b.k JOIN r c ON c.r = a.r AND b.k < c.k")
def _(spark, sf):
    n = _t(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    return n.select("region", F.explode(layer.combinations(F.col("k"), 3)).alias("s")).select("region", layer.set_key(F.col("s")).alias("s_key"))


@query("perm_seed", f"{_plan_sql(1)} SELECT task_id, (1234 + 1000003 * task_id) % 2147483647 AS seed, ((1234 + ('0x' || substr(sha256('dcc.perm#' || x || '#' || y || '#' || s_key), 1, 8))::BIGINT % 2147483647) % 2147483647) AS named FROM plan")
def _(spark, sf):
    t = layer.layer_plan(graph(spark, sf), 1)
    name = F.concat_ws("#", F.lit("dcc.perm"), F.col("x").cast("string"), F.col("y").cast("string"), layer.set_key(F.col("s")))
    return t.select("task_id", layer.perm_seed(1234, F.col("task_id")).alias("seed"), layer.named_seed(1234, name).alias("named"))


@query("formula_class", f"{_plan_sql(3)} SELECT 'additive' AS class, count(*) AS n FROM plan")
def _(spark, sf):
    return layer.layer_plan(graph(spark, sf), 3).groupBy(precision.formula_class(F.col("s")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# ---- Replay ---------------------------------------------------------------------------------

_SUM = "coalesce(list_sum(list_transform(CASE WHEN s_key = '' THEN [] ELSE string_split(s_key, '|') END, lambda v: v::BIGINT * 13)), 0)"
_PSQL = f"((least(x, y)::BIGINT * 7919 + greatest(x, y) * 104729 + (CASE WHEN s_key = '' THEN 0 ELSE len(string_split(s_key, '|')) END) * 31 + {_SUM}) % 1000) / 1000.0::DOUBLE"


def _replay_sql(level: int, alpha: float, p: str = _PSQL, k: int = 4) -> str:
    return f"{_plan_sql(level, k)}, pv AS (SELECT *, {p} AS p FROM plan), h AS (SELECT *, min(CASE WHEN p >= {alpha} THEN task_id END) OVER (PARTITION BY edge_x, edge_y) AS first_hit FROM pv), consumed AS (SELECT * FROM h WHERE first_hit IS NULL OR task_id <= first_hit)"


def _tasks(spark, sf, level, p=None, k=4):
    t = layer.layer_plan(graph(spark, sf, k), level)
    return t.withColumn("p", p(F.col("x"), F.col("y"), F.col("s")) if p else formula_p(F.col("x"), F.col("y"), F.col("s")))


for _level in (0, 1, 2):

    @query(f"ptable_replay_{_level}", f"{_replay_sql(_level, 0.8)} SELECT edge_x AS x, edge_y AS y, count(*) AS n_tests, max(p) AS pmax, coalesce(bool_or(task_id = first_hit), false) AS deleted, max(CASE WHEN task_id = first_hit THEN s_key END) AS s_key FROM consumed GROUP BY ALL")
    def _(spark, sf, level=_level):
        out = layer.edge_outcome(layer.replay(_tasks(spark, sf, level), 0.8))
        return out.select("x", "y", "n_tests", "pmax", "deleted", layer.set_key(F.col("s")).alias("s_key"))


_ODD = f"CASE WHEN task_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN task_id % 11 = 0 THEN NULL ELSE {_PSQL} END"
for _keep in (True, False):

    @query(f"na_policy_{'delete' if _keep else 'keep'}", f"{_replay_sql(1, 0.8, f'(SELECT CASE WHEN q IS NULL OR isnan(q) THEN {1.0 if _keep else 0.0} ELSE q END FROM (SELECT {_ODD} AS q))')} SELECT count(*) AS consumed, count(DISTINCT CASE WHEN task_id = first_hit THEN task_id END) AS deleted FROM consumed")
    def _(spark, sf, keep=_keep):
        t = _tasks(spark, sf, 1).withColumn("p", F.when(F.col("task_id") % 7 == 0, F.lit(float("nan"))).when(F.col("task_id") % 11 == 0, F.lit(None)).otherwise(F.col("p")))
        return layer.replay(t, 0.8, keep).agg(F.count(F.lit(1)).alias("consumed"), F.count_distinct(F.when(F.col("task_id") == F.col("first_hit"), F.col("task_id"))).alias("deleted"))


# ---- Skeletons ------------------------------------------------------------------------------


def _pairs_sql() -> str:
    names = ", ".join(f"corr(v{i}, v{j}) AS r{i}{j}" for i in range(5) for j in range(i + 1, 5))
    rows = " UNION ALL ".join(f"SELECT {i} AS x, {j} AS y, r{min(i, j)}{max(i, j)} AS r, n FROM c" for i in range(5) for j in range(5) if i != j)
    return f"c AS (SELECT count(*) AS n, {names} FROM m), r AS ({rows})"


_L0 = f"WITH {_ORD}, {_pairs_sql()}, l0 AS (SELECT x, y, r, n, {_gauss_sql('r', 0)} AS p FROM r), e0 AS (SELECT x, y FROM l0 WHERE p < 0.05)"


def _gauss_skeleton(spark, sf, size):
    n, corr = moments(orders(spark, sf), FIVE)
    return search(spark, 5, gauss_provider(n, corr), alpha=0.05, max_size=size).tables(spark)["edges"]


@query("skeleton_linear_l0", f"{_L0} SELECT x, y FROM e0 WHERE x < y")
def _(spark, sf):
    return _gauss_skeleton(spark, sf, 0)


@query("skeleton_linear_l1", f"{_L0}, t AS (SELECT e.x, e.y, k.y AS s FROM e0 e JOIN e0 k ON k.x = e.x AND k.y <> e.y), q AS (SELECT t.*, a.n, (a.r - b.r * d.r) / sqrt((1 - b.r * b.r) * (1 - d.r * d.r)) AS pr FROM t JOIN r a ON a.x = t.x AND a.y = t.y JOIN r b ON b.x = t.x AND b.y = t.s JOIN r d ON d.x = t.y AND d.y = t.s), g AS (SELECT least(x, y) AS x, greatest(x, y) AS y FROM q WHERE {_gauss_sql('pr', 1)} >= 0.05) SELECT x, y FROM e0 WHERE x < y EXCEPT SELECT x, y FROM g")
def _(spark, sf):
    return _gauss_skeleton(spark, sf, 1)


@query("skeleton_ptable")
def _(spark, sf):
    n, gaps = nation_gaps(spark, sf)
    return search(spark, n, formula_provider(formula_p), alpha=0.9, gaps=gaps).tables(spark)["deletions"].select("level", "x", "y", layer.set_key(F.col("s")).alias("s_key"), "p")


def _discovery(residual: str, method: str, precision_mode: str = "fast"):
    def run(spark, sf):
        cfg = DiscoverConfig(alpha=0.1, max_conditioning_size=2, ci=CIConfig(method), residual=residual, precision=precision_mode)
        out = discover(suppliers(spark, sf), FIVE, cfg, order_by=["i"])
        return out.pdag()

    return run


query("wanpdag_linear_dcov")(_discovery("linear", "dcc.gamma"))
query("wanpdag_spline_dcov")(_discovery("fast_spline", "dcc.gamma"))
query("wanpdag_tprs_hsic")(_discovery("tprs_gcv", "hsic.gamma"))
query("wanpdag_linear_dcov_perm")(_discovery("linear", "dcc.perm"))
query("wanpdag_linear_hsic_clust")(_discovery("linear", "hsic.clust"))
query("wanpdag_lowrank")(_discovery("linear", "dcc.lowrank"))
query("wanpdag_hybrid")(_discovery("fast_spline", "dcc.gamma", "hybrid"))

# ---- Orientation ----------------------------------------------------------------------------


@query("pdag_kinds", f"WITH {_VIEWS} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN q.a IS NULL THEN 'directed' WHEN p.mark = 2 AND q.mark = 2 THEN 'bidirected' WHEN p.mark = 1 AND q.mark = 1 THEN 'undirected' ELSE 'mixed' END AS kind, p.a, p.b FROM pd p LEFT JOIN pd q ON q.a = p.b AND q.b = p.a) WHERE kind = 'directed' OR a < b GROUP BY kind")
def _(spark, sf):
    return graphdiff.pdag_counts(patterns.edge_kinds(mixed_pdag(spark, sf)))


@query("unshielded_triples", f"WITH {_VIEWS} SELECT u.a AS x, u.b AS y, w.b AS z FROM und u JOIN und w ON u.b = w.a AND u.a < w.b WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = u.a AND adj.b = w.b)")
def _(spark, sf):
    return patterns.unshielded_triples(mixed_pdag(spark, sf))


@query("colliders", f"WITH {_g()}, pd AS (SELECT x AS a, y AS b FROM g UNION ALL SELECT y, x FROM g) SELECT u.a AS x, u.b AS y, w.b AS z FROM pd u JOIN pd w ON u.b = w.a AND u.a < w.b WHERE NOT EXISTS (SELECT 1 FROM pd k WHERE k.a = u.a AND k.b = w.b) AND NOT (u.a + w.b + u.b) % 3 = 0")
def _(spark, sf):
    g = graph(spark, sf)
    everyone = _t(spark, sf, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("all"))
    pairs = layer.complete_graph(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("v")))
    seps = pairs.crossJoin(F.broadcast(everyone)).select("x", "y", F.filter("all", lambda z: (F.col("x") + F.col("y") + z) % 3 == 0).alias("s"))  # one row
    return patterns.colliders(patterns.skeleton_pdag(g), seps)


@query("rule1_pass", f"WITH {_VIEWS} SELECT DISTINCT u.a AS a, u.b AS b FROM dir d JOIN und u ON d.b = u.a WHERE d.a <> u.b AND NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = d.a AND adj.b = u.b)")
def _(spark, sf):
    return patterns.rule1(mixed_pdag(spark, sf))


@query("rule2_pass", f"WITH {_VIEWS} SELECT DISTINCT u.a, u.b FROM und u JOIN dir d ON d.a = u.a JOIN dir e ON e.a = d.b AND e.b = u.b")
def _(spark, sf):
    return patterns.rule2(mixed_pdag(spark, sf))


@query("rule3_pass", f"WITH {_VIEWS}, w AS (SELECT u.a, u.b, k.b AS c FROM und u JOIN und k ON k.a = u.a AND k.b <> u.b JOIN dir d ON d.a = k.b AND d.b = u.b) SELECT DISTINCT p.a, p.b FROM w p JOIN w q ON p.a = q.a AND p.b = q.b AND p.c < q.c WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = p.c AND adj.b = q.c)")
def _(spark, sf):
    return patterns.rule3(mixed_pdag(spark, sf))


@query("check_immor", f"""WITH {_VIEWS}, q AS (SELECT u.a AS v, u.b AS s1, w.b AS s2 FROM und u JOIN und w ON u.a = w.a AND u.b < w.b)
    SELECT v, s1 || '|' || s2 AS s_key, EXISTS (SELECT 1 FROM adj WHERE a = s1 AND b = s2) AND NOT EXISTS (SELECT 1 FROM dir d WHERE d.b = q.v AND ((d.a <> q.s1 AND NOT EXISTS (SELECT 1 FROM adj k WHERE k.a = d.a AND k.b = q.s1)) OR (d.a <> q.s2 AND NOT EXISTS (SELECT 1 FROM adj k WHERE k.a = d.a AND k.b = q.s2)))) AS ok FROM q""")
def _(spark, sf):
    pd = mixed_pdag(spark, sf)
    u = patterns.undirected(pd)
    asked = u.select(F.col("a").alias("v"), F.col("b").alias("s1")).join(u.select(F.col("a").alias("v"), F.col("b").alias("s2")), "v").filter("s1 < s2").select("v", F.array("s1", "s2").alias("s"))
    return patterns.check_immor(pd, asked).select("v", layer.set_key(F.col("s")).alias("s_key"), "ok")


# ---- Precision ------------------------------------------------------------------------------

_VP = "CASE WHEN task_id % 5 = 0 THEN NULL ELSE ((task_id * 37) % 1000) / 1000.0::DOUBLE END"


@query("near_alpha", f"{_plan_sql(1)}, pv AS (SELECT task_id, {_PSQL} AS p FROM plan) SELECT task_id, abs(ln(greatest(p, 2.2250738585072014e-308) / 0.2)) <= ln(2) + 1e-12 AS near FROM pv")
def _(spark, sf):
    return _tasks(spark, sf, 1).select("task_id", precision.near_alpha(F.col("p"), 0.2, 0.6931471805599453).alias("near"))


@query("hybrid_verify", f"{_plan_sql(1)}, pv AS (SELECT task_id, {_PSQL} AS p, {_VP} AS v FROM plan), n AS (SELECT *, abs(ln(greatest(p, 2.2250738585072014e-308) / 0.2)) <= ln(2) + 1e-12 AND v IS NOT NULL AS used FROM pv) SELECT task_id, CASE WHEN used THEN 'verifier' ELSE 'primary' END AS source, CASE WHEN used THEN v ELSE p END AS p_final, p >= 0.2 AS independent_before, CASE WHEN used THEN v ELSE p END >= 0.2 AS independent_after FROM n")
def _(spark, sf):
    t = _tasks(spark, sf, 1)
    v = t.select("task_id", (F.when(F.col("task_id") % 5 != 0, (F.col("task_id") * 37) % 1000) / 1000.0).alias("p"))
    return precision.verify(t.select("task_id", "p"), v, 0.2, 0.6931471805599453).select("task_id", "source", "p_final", "independent_before", "independent_after")


@query("backend_route", f"WITH modes AS (SELECT unnest(['legacy', 'fast', 'compatible', 'hybrid']) AS mode), n AS ({' UNION ALL '.join(f'SELECT {k} AS size, count(*) AS n FROM ({_plan_sql(k)} SELECT task_id FROM plan)' for k in range(4))}) SELECT mode, size::INT AS size, CASE WHEN size = 0 THEN 'direct' WHEN mode IN ('legacy', 'compatible') THEN 'tprs_gcv' ELSE 'fast_spline' END AS primary_backend, CASE WHEN mode = 'hybrid' AND size > 0 THEN 'tprs_gcv' END AS verifier_backend, CASE WHEN size > 0 THEN 'linear' END AS fallback_backend, n AS n_tests FROM modes, n")
def _(spark, sf):
    """What fits the tests of each level of the nation graph, by precision."""
    modes = F.explode(F.array(*map(F.lit, ("legacy", "fast", "compatible", "hybrid"))))
    plan = None
    for k in range(4):
        one = layer.layer_plan(graph(spark, sf), k).select("s")
        plan = one if plan is None else plan.unionByName(one)
    r = plan.select(modes.alias("mode"), F.size("s").alias("size"), "s").select("mode", "size", precision.route(F.col("mode"), F.col("s")).alias("r"))
    return r.groupBy("mode", "size", F.col("r.primary").alias("primary_backend"), F.col("r.verifier").alias("verifier_backend"), F.col("r.fallback").alias("fallback_backend")).agg(F.count(F.lit(1)).alias("n_tests"))


@query("layered_hybrid", f"{_replay_sql(1, 0.2, f'(SELECT CASE WHEN abs(ln(greatest(q, 2.2250738585072014e-308) / 0.2)) <= ln(2) + 1e-12 AND w IS NOT NULL THEN w ELSE q END FROM (SELECT {_PSQL} AS q, {_VP} AS w))')} SELECT count(*) AS consumed, sum(CASE WHEN task_id = first_hit THEN 1 ELSE 0 END)::BIGINT AS deleted FROM consumed")
def _(spark, sf):
    t = layer.layer_plan(graph(spark, sf), 1)
    verifier = lambda tasks: tasks.select("task_id", (F.when(F.col("task_id") % 5 != 0, (F.col("task_id") * 37) % 1000) / 1000.0).alias("p"))
    p = precision.hybrid_provider(formula_provider(formula_p), verifier, 0.2, 0.6931471805599453)(t)
    return layer.replay(t.join(p, "task_id"), 0.2).agg(F.count(F.lit(1)).alias("consumed"), F.sum((F.col("task_id") == F.coalesce("first_hit", F.lit(-1))).cast("int")).alias("deleted"))


# ---- Comparison -----------------------------------------------------------------------------

_AB = f"{_g(4, 'ga')}, {_g(6, 'gb')}"
_DIFF = "(SELECT x, y, 'added' AS status FROM (SELECT * FROM gb EXCEPT SELECT * FROM ga) UNION ALL SELECT x, y, 'removed' FROM (SELECT * FROM ga EXCEPT SELECT * FROM gb) UNION ALL SELECT x, y, 'unchanged' FROM (SELECT * FROM ga INTERSECT SELECT * FROM gb))"


@query("adjacency_diff", f"WITH {_AB} SELECT * FROM {_DIFF}")
def _(spark, sf):
    return graphdiff.adjacency_diff(graph(spark, sf, 4), graph(spark, sf, 6))


@query("skeleton_shd", f"WITH {_AB} SELECT count(*) AS shd FROM {_DIFF} WHERE status <> 'unchanged'")
def _(spark, sf):
    return graphdiff.skeleton_shd(graph(spark, sf, 4), graph(spark, sf, 6))


def _pm(spark, sf, k):
    x, y = F.col("x"), F.col("y")
    return graph(spark, sf, 2).select("x", "y", (F.pmod(x * k + y * 31, F.lit(997)) / 997.0).alias("p"))


_PM = f"{_g(2)}, pa AS (SELECT x, y, ((x * 17 + y * 31) % 997) / 997.0::DOUBLE AS p FROM g), pb AS (SELECT x, y, ((x * 91 + y * 31) % 997) / 997.0::DOUBLE AS p FROM g), j AS (SELECT pa.x, pa.y, pb.p - pa.p AS diff FROM pa JOIN pb USING (x, y))"


@query("pmax_top20", f"WITH {_PM} SELECT x, y, round(diff, 6) + 0.0 AS diff, round(abs(diff), 6) AS abs_diff FROM j ORDER BY abs(diff) DESC, x, y LIMIT 20")
def _(spark, sf):
    return graphdiff.pmax_top(_pm(spark, sf, 17), _pm(spark, sf, 91)).select("x", "y", _r("diff").alias("diff"), _r("abs_diff").alias("abs_diff"))


@query("pmax_summary", f"WITH {_PM} SELECT round(max(abs(diff)), 6) AS max_abs, round(avg(abs(diff)), 6) AS mean_abs, count(*) AS n FROM j")
def _(spark, sf):
    return graphdiff.pmax_summary(_pm(spark, sf, 17), _pm(spark, sf, 91)).select(_r("max_abs").alias("max_abs"), _r("mean_abs").alias("mean_abs"), "n")


@query("sepset_diff", f"WITH {_g(2)}, s AS (SELECT x, y, CASE WHEN (x + y) % 3 > 0 THEN (x % 5) || '|' || (5 + y % 4) END AS s_a, CASE WHEN (x * y) % 3 > 0 THEN (x % 5) || '|' || (5 + y % 3) END AS s_b FROM g) SELECT x, y, s_a, s_b, coalesce(s_a = s_b, false) AS same FROM s WHERE s_a IS NOT NULL OR s_b IS NOT NULL")
def _(spark, sf):
    a, b = _seps(spark, sf)
    return graphdiff.sepset_diff(a, b).select("x", "y", layer.set_key(F.col("s_a")).alias("s_a"), layer.set_key(F.col("s_b")).alias("s_b"), "same")


def _seps(spark, sf):
    g = graph(spark, sf, 2)
    a = g.filter("(x + y) % 3 > 0").select("x", "y", F.array(5 + F.col("y") % 4, F.col("x") % 5).alias("s"))
    return a, g.filter("(x * y) % 3 > 0").select("x", "y", F.array(F.col("x") % 5, 5 + F.col("y") % 3).alias("s"))


@query("sepset_mismatch_rate", f"WITH {_g(2)}, s AS (SELECT (x + y) % 3 > 0 AS ina, (x * y) % 3 > 0 AS inb, y % 4 = y % 3 AS eq FROM g) SELECT round(avg(CASE WHEN ina AND inb AND eq THEN 0.0 ELSE 1.0 END), 6) AS mismatch_rate, count(*) AS pairs FROM s WHERE ina OR inb")
def _(spark, sf):
    return graphdiff.sepset_mismatch_rate(*_seps(spark, sf)).select(_r("mismatch_rate").alias("mismatch_rate"), "pairs")


def _kinds_sql(k: int, n: str) -> str:
    return f"{_pd(k, n)}, k{n} AS (SELECT kind, a, b FROM (SELECT CASE WHEN q.a IS NULL THEN 'directed' WHEN p.mark = 2 AND q.mark = 2 THEN 'bidirected' WHEN p.mark = 1 AND q.mark = 1 THEN 'undirected' ELSE 'mixed' END AS kind, p.a, p.b FROM {n} p LEFT JOIN {n} q ON q.a = p.b AND q.b = p.a) WHERE kind = 'directed' OR a < b)"


@query("pdag_diff", f"WITH {_kinds_sql(4, 'pa')}, {_kinds_sql(6, 'pb')} SELECT *, 'added' AS status FROM (SELECT * FROM kpb EXCEPT SELECT * FROM kpa) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM kpa EXCEPT SELECT * FROM kpb) UNION ALL SELECT *, 'unchanged' FROM (SELECT * FROM kpa INTERSECT SELECT * FROM kpb)")
def _(spark, sf):
    return graphdiff.pdag_diff(*(patterns.edge_kinds(mixed_pdag(spark, sf, k)) for k in (4, 6)))


@query("graph_metrics", f"{_replay_sql(1, 0.8)}, e AS (SELECT edge_x, edge_y, count(*) AS n_tests, max(p) AS p FROM consumed GROUP BY ALL) SELECT count(*) AS n_edges, max(p) AS max_pmax, min(CASE WHEN p > 0 THEN p END) AS min_positive_pmax, sum(n_tests)::BIGINT AS n_tests, 1 AS n_levels FROM e")
def _(spark, sf):
    out = layer.edge_outcome(layer.replay(_tasks(spark, sf, 1), 0.8))
    return graphdiff.graph_metrics(out.select("x", "y"), out.select("x", "y", F.col("pmax").alias("p")), out.agg(F.sum("n_tests").alias("n_tests")))


@query("relative_l2", f"WITH {_ORD} SELECT round(sqrt(sum((v0 - v2) * (v0 - v2))) / sqrt(sum(v0 * v0)), 6) AS relative_l2 FROM m")
def _(spark, sf):
    return orders(spark, sf).agg(_r(graphdiff.relative_l2(F.col("v0"), F.col("v2"))).alias("relative_l2"))


@query("trace_faults", f"{_plan_sql(1)}, tr AS (SELECT task_id, x, y FROM plan UNION ALL SELECT task_id, y, x FROM plan WHERE task_id % 9 = 0 UNION ALL SELECT task_id, x, y FROM plan WHERE task_id % 13 = 0) SELECT task_id, x, y, 'not planned' AS fault FROM tr t WHERE NOT EXISTS (SELECT 1 FROM plan p WHERE p.task_id = t.task_id AND p.x = t.x AND p.y = t.y) UNION ALL SELECT task_id, x, y, 'run twice' FROM tr GROUP BY task_id, x, y HAVING count(*) > 1")
def _(spark, sf):
    p = layer.layer_plan(graph(spark, sf), 1).select("task_id", "x", "y")
    trace = p.unionByName(p.filter("task_id % 9 = 0").select("task_id", F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(p.filter("task_id % 13 = 0"))
    return graphdiff.trace_faults(p, trace)


# ---- Analytics ------------------------------------------------------------------------------


@query("workload_stats", f"{_plan_sql(2)}, r AS (SELECT x AS target, s_key FROM plan UNION ALL SELECT y, s_key FROM plan), g2 AS (SELECT s_key, count(*) AS tests, count(DISTINCT target) AS targets FROM r GROUP BY s_key) SELECT 2 AS level, sum(tests)::BIGINT AS n_tests, count(*) AS n_sets, sum(CASE WHEN targets > 1 THEN 1 ELSE 0 END)::BIGINT AS shared_sets, quantile_cont(targets, 0.5) AS p50_targets, round(quantile_cont(targets, 0.95), 6) AS p95_targets, max(targets) AS max_targets FROM g2")
def _(spark, sf):
    t = layer.layer_plan(graph(spark, sf), 2).select("level", layer.set_key(F.col("s")).alias("s_key"), F.explode(F.array("x", "y")).alias("target"))
    return analytics.workload_stats(t).withColumn("p95_targets", _r("p95_targets"))


@query("workload_census", f"{_plan_sql(2)}, r AS (SELECT task_id, x AS target, s_key FROM plan UNION ALL SELECT task_id, y, s_key FROM plan) SELECT target, s_key, 2 AS s_size, count(*) AS tests, min(task_id) AS first_task, sha256(target || '#' || s_key) AS identity, 'single_penalty' AS risk FROM r GROUP BY ALL")
def _(spark, sf):
    return analytics.workload_census(layer.layer_plan(graph(spark, sf), 2))


@query("cache_stats", "SELECT l_returnflag AS setup, count(DISTINCT l_orderkey) AS tests, count(*) AS requests, count(DISTINCT l_partkey) AS targets, sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END)::BIGINT AS uncached, round(avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    r = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("setup"), F.col("l_orderkey").alias("test_id"), F.col("l_partkey").alias("target"), (F.col("l_linestatus") == "F").alias("cache_hit"))
    return analytics.cache_stats(r).withColumn("hit_rate", _r("hit_rate"))


def _runs(spark, sf):
    return _t(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("mode"), F.col("value").alias("sec"))


@query("mode_summary", "WITH s AS (SELECT event_type AS mode, count(*) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, exp(avg(CASE WHEN value > 0 THEN ln(value) END)) AS geomean FROM events WHERE isfinite(value) GROUP BY event_type), b AS (SELECT median AS base FROM s WHERE mode = 'click') SELECT mode, n, round(median, 6) AS median, round(p90, 6) AS p90, round(p95, 6) AS p95, round(geomean, 6) AS geomean, round(median / base, 6) AS ratio FROM s LEFT JOIN b ON true")
def _(spark, sf):
    return analytics.mode_summary(_runs(spark, sf), "click").select("mode", "n", *(_r(c).alias(c) for c in ("median", "p90", "p95", "geomean", "ratio")))


@query("baseline_election", "SELECT o_orderpriority AS baseline FROM (SELECT DISTINCT o_orderpriority, list_position(['9-NONE', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k > 0 ORDER BY k LIMIT 1")
def _(spark, sf):
    r = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error").alias("status"))
    return analytics.elect_baseline(r, ["9-NONE", "3-MEDIUM", "2-HIGH", "1-URGENT"])


@query("bottleneck", f"WITH {_SUP} SELECT i, CASE WHEN greatest(v0, v1, v2, v3, v4) <= 0 THEN 'unclassified' WHEN v0 = greatest(v0, v1, v2, v3, v4) THEN 'v0' WHEN v1 = greatest(v1, v2, v3, v4) THEN 'v1' WHEN v2 = greatest(v2, v3, v4) THEN 'v2' WHEN v3 >= v4 THEN 'v3' ELSE 'v4' END AS slowest FROM m")
def _(spark, sf):
    return suppliers(spark, sf).select("i", analytics.bottleneck({c: F.col(c) for c in FIVE}).alias("slowest"))


@query("tau_by_scenario", "WITH r AS (SELECT p_brand AS scenario, p_size AS flips, p_retailprice AS speedup, p_partkey AS tau FROM part) SELECT scenario, flips, speedup, tau FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY flips, speedup DESC, tau) AS rn FROM r) WHERE rn = 1")
def _(spark, sf):
    r = _t(spark, sf, "part").select(F.col("p_brand").alias("scenario"), F.col("p_size").alias("flips"), F.col("p_retailprice").alias("speedup"), F.col("p_partkey").alias("tau"))
    return analytics.tau_by_scenario(r)


@query("tau_select", "SELECT p_partkey AS tau, p_size AS flip_reduction FROM part WHERE p_size % 7 <= p_partkey % 5 AND p_retailprice / 1000 <= 2.0 ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 1")
def _(spark, sf):
    r = _t(spark, sf, "part").select(F.col("p_partkey").alias("tau"), F.col("p_size").alias("flip_reduction"), F.col("p_retailprice").alias("verification_rate"), (F.col("p_size") % 7).alias("shd_hybrid"), (F.col("p_partkey") % 5).alias("shd_primary"), (F.col("p_retailprice") / 1000).alias("runtime_ratio"))
    return analytics.tau_select(r).select("tau", "flip_reduction")


@query("campaign_grid", "WITH r AS (SELECT DISTINCT l_returnflag AS flag FROM lineitem), s AS (SELECT DISTINCT l_linestatus AS status FROM lineitem), g AS (SELECT flag, status, n FROM r, s, (SELECT unnest([100, 300]) AS n)) SELECT g.flag, g.status, g.n, count(l_orderkey) AS n_rows FROM g LEFT JOIN lineitem ON l_returnflag = g.flag AND l_linestatus = g.status GROUP BY ALL")
def _(spark, sf):
    """A campaign over all flags and statuses that line items have, with the rows of each setting."""
    li = _t(spark, sf, "lineitem")
    have = li.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("rows"))
    found = have.collect()  # flags and statuses, some letters each
    grid = analytics.campaign_grid(spark, {"flag": sorted({r.flag for r in found}), "status": sorted({r.status for r in found}), "n": [100, 300]})
    return grid.join(have, ["flag", "status"], "left").select("flag", "status", F.col("n").cast("int").alias("n"), F.coalesce("rows", F.lit(0).cast("long")).alias("n_rows"))


@query("pairwise_runs", "WITH r AS (SELECT s_suppkey AS run_id, s_acctbal AS value FROM supplier WHERE s_acctbal >= 0) SELECT a.run_id AS i, b.run_id AS j, round(b.value - a.value, 4) + 0.0 AS diff FROM r a JOIN r b ON a.run_id < b.run_id")
def _(spark, sf):
    r = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"), F.when(F.col("s_acctbal") >= 0, "ok").otherwise("error").alias("status"), F.col("s_acctbal").alias("value"))
    return analytics.pairwise_runs(r).select("i", "j", _r("diff", 4).alias("diff"))


@query("decision_memo", f"WITH {_SUP} SELECT round(avg(v0), 6) AS v0, round(avg(v3), 6) AS v3, CASE WHEN avg(v0) <= 0.9 AND avg(v3) <= 0.1 THEN 'go' ELSE 'no-go' END AS decision FROM m")
def _(spark, sf):
    return analytics.decision(suppliers(spark, sf), {"v0": 0.9, "v3": 0.1}).select(_r("v0").alias("v0"), _r("v3").alias("v3"), "decision")


@query("window_moments", "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(corr(value, user_id::DOUBLE), 6) AS c FROM events GROUP BY 1")
def _(spark, sf):
    out = window_moments(_t(spark, sf, "events"), "ts", ["value", "user_id"], "1 day")
    return out.select("start", "n", _r("c_0_1").alias("c"))


from . import more  # noqa: E402, F401  (registers more queries with the helpers above)
