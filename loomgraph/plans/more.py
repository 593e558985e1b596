"""More registered queries of the causal engine, with SQL: pairwise tests, regressions, search traces, votes, comparisons, analytics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CIConfig, DiscoverConfig, SplineConfig
from ..functions import splines
from ..functions.gram import gram
from ..operators import analytics, graphdiff, layer, patterns, precision, regression
from ..operators.factors import hsic_lowrank
from ..operators.moment_splines import projection_floor, spline_residuals
from ..operators.residuals import fixed_solve
from ..sources.matrix import read_any, to_numpy
from ..sources.sinks import write_tables
from ..sources.staging import shared_folder
from .discover import discover, kernel_ci_test
from .entry import FIVE, ORACLES, _BOTH, _GE, _NAT, _ORD, _PSQL, _Q10, _SUP, _g, _k, _large_sql, _perm_sql, _plan_sql, _q, _r, _replay_sql, _seps, _t, _tasks, formula_p, graph, nation_gaps, nations, orders, query, suppliers
from .providers import formula_provider, matrix_provider
from .residual_tables import residual_table
from .skeleton import search

# ---- Reading and writing ----------------------------------------------------------------------

_FORMATS = ("csv", "json", "orc", "parquet")


@query("read_formats", " UNION ALL ".join(f"SELECT '{f}' AS format, n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r FROM nation" for f in _FORMATS))
def _(spark, sf):
    made, out = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r")), None
    folder = shared_folder(spark, "formats")
    for fmt in _FORMATS:
        write_tables({f"nation.{fmt}": made}, folder, fmt)
        part = read_any(spark, f"{folder}/nation.{fmt}").select(F.lit(fmt).alias("format"), F.col("k").cast("long").alias("k"), F.col("r").cast("long").alias("r"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- Tests of many pairs ----------------------------------------------------------------------


def _long_sql(base: str, n: int = 5) -> str:
    return f"{base}, v AS ({' UNION ALL '.join(f'SELECT {j} AS var, i, v{j} AS v FROM m' for j in range(n))})"


def _grouped_moments(pairs: str, keys: str, hsic: bool = False) -> str:
    """Moments and tail of each group of rows (keys, i, j, k, l)."""
    mean = "(1 + mk * ml - mk - ml) / n" if hsic else "gk * gl"
    stat, var = ("ab / (n * n)", "pow(n, 4)") if hsic else ("ab / n", "(n * n)")
    return f"""p AS ({pairs}),
    c AS (SELECT *, k - avg(k) OVER (PARTITION BY {keys}, i) - avg(k) OVER (PARTITION BY {keys}, j) + avg(k) OVER (PARTITION BY {keys}) AS a, l - avg(l) OVER (PARTITION BY {keys}, i) - avg(l) OVER (PARTITION BY {keys}, j) + avg(l) OVER (PARTITION BY {keys}) AS b FROM p),
    s AS (SELECT {keys}, sqrt(count(*)::DOUBLE) AS n, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, avg(k) AS gk, avg(l) AS gl, avg(CASE WHEN i <> j THEN k END) AS mk, avg(CASE WHEN i <> j THEN l END) AS ml FROM c GROUP BY {keys}),
    t AS (SELECT {keys}, n, {stat} AS stat, {mean} AS mean, 2 * (n - 4) * (n - 5) / (n * (n - 1) * (n - 2) * (n - 3)) * aa * bb / {var} AS variance FROM s),
    u AS (SELECT *, mean * mean / variance AS shape, stat / (variance / mean) AS xx FROM t),
    tested AS (SELECT {keys}, {_q("shape", "xx")} AS p FROM u)"""


_DIST = "d AS (SELECT a.var, a.i, b.i AS j, abs(a.v - b.v) AS d, exp(-(a.v - b.v) * (a.v - b.v)) AS k FROM v a JOIN v b ON a.var = b.var)"


def _pairwise_sql(value: str, hsic: bool) -> str:
    pairs = f"SELECT a.var AS x, b.var AS y, a.i, a.j, a.{value} AS k, b.{value} AS l FROM d a JOIN d b ON a.i = b.i AND a.j = b.j AND a.var < b.var"
    return f"WITH {_long_sql(_SUP)}, {_DIST}, {_grouped_moments(pairs, 'x, y', hsic)} SELECT x, y, round(p, 4) + 0.0 AS p FROM tested"


def _pairwise(spark, sf, ci):
    plan = layer.layer_plan(layer.complete_graph(layer.variables(spark, 5)), 0).filter("side = 0")
    p = matrix_provider(to_numpy(suppliers(spark, sf), FIVE, ["i"]), ci)(plan)
    return plan.join(p, "task_id").select("x", "y", _r("p", 4).alias("p"))


@query("pairwise_dcov_matrix", _pairwise_sql("d", False))
def _(spark, sf):
    return _pairwise(spark, sf, CIConfig("dcc.gamma"))


@query("pairwise_hsic_matrix", _pairwise_sql("k", True))
def _(spark, sf):
    return _pairwise(spark, sf, CIConfig("hsic.gamma"))


@query("lowrank_at_full_rank", _pairwise_sql("d", False))
def _(spark, sf):
    return _pairwise(spark, sf, CIConfig("dcc.lowrank", num_col=1_000_000))


def _region_sql(value: str, hsic: bool, name: str) -> str:
    pairs = f"SELECT r, a.i, b.i AS j, {value.format('v1')} AS k, {value.format('v2')} AS l FROM g a JOIN g b USING (r)"
    return f"{name} AS (WITH {_grouped_moments(pairs, 'r', hsic)} SELECT r, n, p FROM tested JOIN s USING (r))"


ORACLES["dcov_by_region"] = f"""WITH {_SUP}, g AS (SELECT m.*, n_regionkey AS r FROM m JOIN supplier ON s_suppkey = i JOIN nation ON n_nationkey = s_nationkey),
    {_region_sql('abs(a.{0} - b.{0})', False, 'dc')}, {_region_sql('exp(-(a.{0} - b.{0}) * (a.{0} - b.{0}))', True, 'hs')}
    SELECT r AS n_regionkey, CASE WHEN dc.n > 5.5 THEN round(dc.p, 6) + 0.0 END AS dcov_p, CASE WHEN dc.n > 5.5 THEN round(hs.p, 6) + 0.0 END AS hsic_p FROM dc JOIN hs USING (r)"""

_NAT0 = f"m0 AS (WITH {_NAT} SELECT * FROM m), m AS (SELECT row_number() OVER (ORDER BY i) - 1 AS i, v0, v1 FROM m0)"


@query("single_test_defaults", f"SELECT p_value FROM ({_perm_sql(_NAT0, 'abs(a.v0 - b.v0)', 'abs(a.v1 - b.v1)', 100, 1, '1.0', _GE, 1)})")
def _(spark, sf):
    p = kernel_ci_test(to_numpy(nations(spark, sf), ["v0", "v1"], ["i"]), 0, 1)
    return spark.createDataFrame([(round(p, 6),)], "p_value double")


# ---- Regression -------------------------------------------------------------------------------


def _orthogonal(given: list[str], y: str) -> str:
    """CTEs that take one regressor after the other out of those behind it and of y."""
    parts, names = ["o0 AS (SELECT * FROM m)"], [*given, y]
    for k, g in enumerate(given):
        left = ", ".join(f"{c} - avg({c}) OVER () - (regr_slope({c}, {g}) OVER ()) * ({g} - avg({g}) OVER ()) AS {c}" for c in names[k + 1 :])
        done = "".join(f"{c}, " for c in names[: k + 1])
        parts.append(f"o{k + 1} AS (SELECT i, {done}{left} FROM o{k})")
    return ", ".join(parts)


ORACLES["ols_residual_4"] = f"WITH {_ORD}, {_orthogonal(['v0', 'v1', 'v3', 'v4'], 'v2')} SELECT i, round(v2, 6) + 0.0 AS resid FROM o4"


@query("ols_residuals_many", f"WITH {_ORD}, f AS (SELECT regr_slope(v1, v0) AS b1, avg(v1) AS m1, regr_slope(v2, v0) AS b2, avg(v2) AS m2, avg(v0) AS mx FROM m) SELECT i, round(v1 - m1 - b1 * (v0 - mx), 6) + 0.0 AS r1, round(v2 - m2 - b2 * (v0 - mx), 6) + 0.0 AS r2 FROM m, f")
def _(spark, sf):
    out = regression.ols_residuals(orders(spark, sf), ["v1", "v2"], ["v0"])
    return out.select("i", _r("resid_v1").alias("r1"), _r("resid_v2").alias("r2"))


_ALL1 = " UNION ALL ".join(f"SELECT {t} AS target, '{s}' AS s_key, rn AS i, v{t} - avg(v{t}) OVER () - (regr_slope(v{t}, v{s}) OVER ()) * (v{s} - avg(v{s}) OVER ()) AS resid FROM w" for t in range(5) for s in range(5) if t != s)


@query("residual_table_linear", f"WITH {_SUP}, w AS (SELECT row_number() OVER (ORDER BY i) - 1 AS rn, * FROM m) SELECT target, s_key, i, round(resid, 6) + 0.0 AS resid FROM ({_ALL1})")
def _(spark, sf):
    plan = layer.layer_plan(layer.complete_graph(layer.variables(spark, 5)), 1)
    asked = layer.residual_requests(plan).select("target", "s")
    return residual_table(suppliers(spark, sf), FIVE, asked, order_by=["i"]).select("target", "s_key", "i", _r("resid").alias("resid"))


_BASIS = f"""k AS (SELECT quantile_cont({{c}}, [{_Q10}]) AS k FROM m), c AS (SELECT unnest(range(10)) AS b, unnest(k) AS c FROM k), w AS (SELECT 2.5 * min(g) AS w FROM (SELECT c - lag(c) OVER (ORDER BY b) AS g FROM c) WHERE g > 0),
  r AS (SELECT i, b, pow(greatest(0.0, 1 - abs({{c}} - c) / w), 3) AS v, abs({{c}} - c) AS d FROM m, c, w), t AS (SELECT *, sum(v) OVER (PARTITION BY i) AS s, row_number() OVER (PARTITION BY i ORDER BY d, b) AS near FROM r)
  SELECT i, b, CASE WHEN s > 0 THEN v / s WHEN near = 1 THEN 1.0 ELSE 0.0 END AS v FROM t"""
_TWO = f"{_SUP}, ba AS (WITH {_BASIS.format(c='v0')}), bb AS (WITH {_BASIS.format(c='v1')})"


def _bases(spark, sf):
    m = suppliers(spark, sf)
    at = F.array(*(F.lit(i / 9.0) for i in range(10)))
    k = m.agg(F.percentile("v0", at).alias("k0"), F.percentile("v1", at).alias("k1"))
    return m.crossJoin(F.broadcast(k)).select("i", *(splines.bump_basis_col(F.col(f"v{j}"), F.col(f"k{j}")).alias(f"b{j}") for j in (0, 1)))  # one row of knots


@query("tensor_basis", f"WITH {_TWO} SELECT ba.i AS i, ba.b * 10 + bb.b AS basis, round(ba.v * bb.v, 6) AS value FROM ba JOIN bb ON ba.i = bb.i")
def _(spark, sf):
    out = _bases(spark, sf).select("i", F.posexplode(splines.tensor_col(F.col("b0"), F.col("b1"))).alias("basis", "value"))
    return out.select("i", F.col("basis").cast("long").alias("basis"), _r("value").alias("value"))


@query("additive_basis", f"WITH {_TWO} SELECT i, b AS basis, round(v, 6) AS value FROM ba UNION ALL SELECT i, b + 10, round(v, 6) FROM bb")
def _(spark, sf):
    out = _bases(spark, sf).select("i", F.posexplode(splines.additive_col(F.col("b0"), F.col("b1"))).alias("basis", "value"))
    return out.select("i", F.col("basis").cast("long").alias("basis"), _r("value").alias("value"))


#: Penalised least squares of v1 on the basis of v0 at every smoothing parameter, by elimination; GCV picks one.
_SPLINE = f"""WITH RECURSIVE {_SUP}, x AS (WITH {_BASIS.format(c='v0')}), y AS (SELECT i, v1 AS y FROM m), n AS (SELECT count(*) AS n FROM m),
  dm AS (SELECT r, c, CASE c - r WHEN 0 THEN 1 WHEN 1 THEN -2 WHEN 2 THEN 1 ELSE 0 END AS v FROM range(8) a(r), range(10) b(c)), pen AS (SELECT a.c AS i, b.c AS j, sum(a.v * b.v) AS v FROM dm a JOIN dm b ON a.r = b.r GROUP BY ALL),
  g AS (SELECT a.b AS i, b.b AS j, sum(a.v * b.v) AS v FROM x a JOIN x b ON a.i = b.i GROUP BY ALL), h AS (SELECT b AS i, sum(v * y) AS v FROM x JOIN y USING (i) GROUP BY b),
  lam AS (SELECT s, exp(ln(1e-4) * (1 - s / 24.0) + ln(1e4) * (s / 24.0)) AS lam FROM range(25) t(s)),
  cells AS (SELECT s, g.i, g.j AS j, g.v + lam * pen.v + CASE WHEN g.i = g.j THEN 1e-8 ELSE 0 END AS v FROM lam, g JOIN pen USING (i, j) UNION ALL SELECT s, i, 10, v FROM lam, h UNION ALL SELECT s, i, 11 + j, v FROM lam, g),
  start AS (SELECT s, list(row ORDER BY i) AS m FROM (SELECT s, i, list(v::DOUBLE ORDER BY j) AS row FROM cells GROUP BY s, i) GROUP BY s),
  ge AS (SELECT s, 1::BIGINT AS k, m FROM start UNION ALL SELECT s, k + 1, list_transform(range(1, 11), lambda r: list_transform(range(1, 22), lambda c: CASE WHEN r = k THEN m[k][c] / m[k][k] ELSE m[r][c] - m[r][k] * m[k][c] / m[k][k] END)) FROM ge WHERE k <= 10),
  sol AS (SELECT s, m, list_sum(list_transform(range(1, 11), lambda r: m[r][11 + r])) AS edf FROM ge WHERE k = 11),
  res AS (SELECT s, x.i, any_value(y) - sum(v * m[b + 1][11]) AS r, any_value(edf) AS edf FROM sol, x JOIN y USING (i) GROUP BY s, x.i),
  gcv AS (SELECT s, n * sum(r * r) / pow(n - any_value(edf), 2) AS score FROM res, n GROUP BY s, n), best AS (SELECT arg_min(s, score) AS s FROM gcv)
  SELECT row_number() OVER (ORDER BY i) - 1 AS i, round(r, 4) + 0.0 AS resid FROM res WHERE s = (SELECT s FROM best)"""


@query("spline_residual", _SPLINE)
def _(spark, sf):
    asked = spark.createDataFrame([(1, [0])], "target int, s array<int>")
    out = residual_table(suppliers(spark, sf), FIVE, asked, order_by=["i"], backend="fast_spline", spline=SplineConfig())
    return out.select("i", _r("resid", 4).alias("resid"))


@query("moment_spline_orders", _SPLINE.replace(_SUP, _ORD).replace("SELECT row_number() OVER (ORDER BY i) - 1 AS i,", "SELECT i,"))
def _(spark, sf):
    out = spline_residuals(orders(spark, sf).select("i", "v0", "v1"), ["v1"], ["v0"])
    return out.select("i", _r("resid_v1", 4).alias("resid"))


@query("projection_floor_orders", f"WITH {_ORD}, f AS (SELECT regr_slope(v2, v1) AS b, regr_intercept(v2, v1) AS a FROM m) SELECT round(sqrt(sum(pow(v2 - a - b * v1, 2))) / sqrt(sum(v2 * v2)), 6) AS floor FROM m, f")
def _(spark, sf):
    return spark.createDataFrame([(round(projection_floor(orders(spark, sf), "v2", ["v1"]), 6),)], "floor double")


@query("penalised_solve", f"WITH {_SUP}, f AS (SELECT covar_pop(v1, v0) * count(*) AS sxy, var_pop(v0) * count(*) AS sxx, avg(v0) AS mx, avg(v1) AS my FROM m), l AS (SELECT unnest([0.0, 0.5, 20.0]) AS lam) SELECT lam::DOUBLE AS lam, round(my - mx * sxy / (sxx + lam), 6) + 0.0 AS b0, round(sxy / (sxx + lam), 6) + 0.0 AS b1 FROM f, l")
def _(spark, sf):
    m = gram(suppliers(spark, sf), ["v0", "v1"], 3, lambda b: np.column_stack((np.ones(len(b)), b.column(0), b.column(1))))
    # The triangular factor of X'X stands for all rows: a design of two rows with the same products.
    x = np.linalg.cholesky(m[:2, :2]).T
    y = np.linalg.solve(x.T, m[:2, 2])
    rows = [(lam, *map(float, fixed_solve(x, y, np.diag([0.0, lam]))[0])) for lam in (0.0, 0.5, 20.0)]
    out = spark.createDataFrame(rows, "lam double, b0 double, b1 double")
    return out.select("lam", _r("b0").alias("b0"), _r("b1").alias("b1"))


@query("formula_text", " UNION ALL ".join(f"SELECT * FROM ({_plan_sql(k)} SELECT DISTINCT {k} AS size, x AS target, s_key, 'x' || x || ' ~ ' || " + ("'1'" if k == 0 else "'s(x' || replace(s_key, '|', ',x') || ')'" if k <= 2 else "'s(x' || replace(s_key, '|', ') + s(x') || ')'") + f" AS formula, '{('direct', 'full', 'full', 'additive')[k]}' AS class FROM plan)" for k in range(4)))
def _(spark, sf):
    out = None
    for k in range(4):
        t = layer.layer_plan(graph(spark, sf), k).select(F.lit(k).alias("size"), F.col("x").alias("target"), layer.set_key(F.col("s")).alias("s_key"), precision.formula_col(F.col("x"), F.col("s")).alias("formula"), precision.formula_class(F.col("s")).alias("class")).distinct()
        out = t if out is None else out.unionByName(t)
    return out


@query("hsic_factor_orders", _large_sql(_k("v0"), _k("v3"), True))
def _(spark, sf):
    r = hsic_lowrank(orders(spark, sf).select("i", "v0", "v3"), ["v0"], ["v3"], num_col=40, tol=1e-11)
    return spark.createDataFrame([tuple(float(v) for v in (r.statistic, r.mean, r.variance, r.p_value))], "s double, m double, v double, p double").select(_r("s").alias("statistic"), _r("m").alias("mean"), _r("v").alias("variance"), _r("p").alias("p_value"))


# ---- Search -----------------------------------------------------------------------------------


def _level_sql(level: int, alpha: float) -> str:
    """CTEs of one level from the edges g<level>: plan, tests until the first acceptance, deletions, edges left."""
    i = level
    joins = "".join(f" JOIN bw{i} n{k} ON n{k}.v = s.x AND n{k}.u <> s.y" + (f" AND n{k}.u > n{k - 1}.u" if k > 1 else "") for k in range(1, level + 1))
    key = " || '|' || ".join(f"n{k}.u" for k in range(1, level + 1)) or "''"
    order = "".join(f", n{k}.u" for k in range(1, level + 1))
    return f"""bw{i} AS (SELECT x AS v, y AS u FROM g{i} UNION ALL SELECT y, x FROM g{i}), sd{i} AS (SELECT x AS edge_x, y AS edge_y, 0 AS side, x, y FROM g{i} UNION ALL SELECT x, y, 1, y, x FROM g{i}),
    pl{i} AS (SELECT row_number() OVER (ORDER BY edge_x, edge_y, side{order}) - 1 AS task_id, edge_x, edge_y, s.x AS x, s.y AS y, CAST({key} AS VARCHAR) AS s_key FROM sd{i} s{joins}),
    pv{i} AS (SELECT *, {_PSQL} AS p FROM pl{i}), ht{i} AS (SELECT *, min(CASE WHEN p >= {alpha} THEN task_id END) OVER (PARTITION BY edge_x, edge_y) AS hit FROM pv{i}),
    run{i} AS (SELECT {i} AS level, *, coalesce(task_id = hit, false) AS deletes FROM ht{i} WHERE hit IS NULL OR task_id <= hit),
    g{i + 1} AS (SELECT x, y FROM g{i} EXCEPT SELECT edge_x, edge_y FROM run{i} WHERE deletes)"""


_SEARCH = f"WITH {_g(4, 'g0')}, " + ", ".join(_level_sql(k, 0.9) for k in range(7))
_RUNS = " UNION ALL ".join(f"SELECT level, task_id, edge_x, edge_y, x, y, s_key, p, deletes FROM run{k}" for k in range(7))


@query("search_trace", f"{_SEARCH} SELECT level, task_id, x, y, s_key, p, deletes FROM ({_RUNS})")
def _(spark, sf):
    n, gaps = nation_gaps(spark, sf)
    out = search(spark, n, formula_provider(formula_p), alpha=0.9, gaps=gaps, trace=True).ci_results(spark)
    return out.select("level", "task_id", "x", "y", layer.set_key(F.col("s")).alias("s_key"), "p", "deletes")


ORACLES["skeleton_ptable"] = f"{_SEARCH}, r AS ({_RUNS}), top AS (SELECT level, edge_x, edge_y, max(p) AS p FROM r GROUP BY ALL) SELECT r.level, r.edge_x AS x, r.edge_y AS y, r.s_key, top.p FROM r JOIN top USING (level, edge_x, edge_y) WHERE deletes"


@query("search_in_waves", f"{_SEARCH} SELECT x, y, true AS same FROM g3")
def _(spark, sf):
    n, gaps = nation_gaps(spark, sf)
    waved = search(spark, n, formula_provider(formula_p), alpha=0.9, gaps=gaps, max_size=2, waves=(4, 16))
    whole = search(spark, n, formula_provider(formula_p), alpha=0.9, gaps=gaps, max_size=2)
    same = (waved.sepsets, waved.pmax, waved.levels) == (whole.sepsets, whole.pmax, whole.levels)
    return spark.createDataFrame([(x, y, same) for x, y in sorted(waved.edges)], "x int, y int, same boolean")


_RANKED = f"{_replay_sql(2, 0.8)}, rk AS (SELECT *, task_id - min(task_id) OVER (PARTITION BY edge_x, edge_y) AS rank, first_hit - min(task_id) OVER (PARTITION BY edge_x, edge_y) AS hit_rank FROM h)"


@query("wave_sizes", f"{_RANKED} SELECT rank // 16 AS wave, count(*) AS evaluated, count(CASE WHEN hit_rank IS NULL OR rank <= hit_rank THEN 1 END) AS consumed FROM rk WHERE hit_rank IS NULL OR hit_rank // 16 >= rank // 16 GROUP BY 1")
def _(spark, sf):
    plan = layer.layer_plan(graph(spark, sf), 2)
    edge = ["edge_x", "edge_y"]
    t = plan.join(formula_provider(formula_p)(plan), "task_id")
    first = t.groupBy(*edge).agg(F.min("task_id").alias("at"), F.min(F.when(F.col("p") >= 0.8, F.col("task_id"))).alias("hit"))
    r = t.join(first, edge).select((F.col("task_id") - F.col("at")).alias("rank"), (F.col("hit") - F.col("at")).alias("hit_rank")).withColumn("wave", F.expr("rank div 16"))
    ran = r.filter("hit_rank is null or hit_rank div 16 >= wave")
    return ran.groupBy("wave").agg(F.count(F.lit(1)).alias("evaluated"), F.sum(F.expr("hit_rank is null or rank <= hit_rank").cast("int")).alias("consumed"))


@query("pcalg_order", f"{_plan_sql(2)}, k AS (SELECT task_id, x, y, list_transform(string_split(s_key, '|'), lambda v: v::INT) AS s FROM plan) SELECT task_id, row_number() OVER (ORDER BY x, y, s) - 1 AS rank FROM k")
def _(spark, sf):
    t = layer.layer_plan(graph(spark, sf), 2)
    # A set that both sides offer is listed for each, as (x, y) and (y, x), so no two tasks tie.
    return layer.in_pcalg_order(t).select("task_id", F.col("rank").cast("long").alias("rank"))


@query("residual_cache_counts", f"{_plan_sql(2)}, r AS (SELECT level, x AS target, s_key FROM plan UNION ALL SELECT level, y, s_key FROM plan), ds AS (SELECT level, target, s_key, count(*) AS n FROM r GROUP BY ALL) SELECT level, sum(n)::BIGINT AS requests, count(*) AS fits, (sum(n) - count(*))::BIGINT AS hits, round((sum(n) - count(*)) / sum(n)::DOUBLE, 6) AS hit_rate FROM ds GROUP BY level")
def _(spark, sf):
    out = analytics.request_counts(layer.layer_plan(graph(spark, sf), 2))
    return out.select("level", "requests", "fits", "hits", _r("hit_rate").alias("hit_rate"))


_COND = """v AS (SELECT 0 AS var, i, v0 AS v FROM m UNION ALL SELECT 1, i, v1 FROM m UNION ALL SELECT 2, i, v2 FROM m UNION ALL SELECT 3, i, v3 FROM m UNION ALL SELECT 4, i, v4 FROM m),
    fit AS (SELECT a.var AS t, b.var AS s, regr_slope(a.v, b.v) AS b1, avg(a.v) AS my, avg(b.v) AS mx FROM v a JOIN v b ON a.i = b.i AND a.var <> b.var GROUP BY ALL),
    res AS (SELECT t, s, a.i, a.v - my - b1 * (b.v - mx) AS v FROM fit JOIN v a ON a.var = t JOIN v b ON b.var = s AND b.i = a.i),
    d0 AS (SELECT a.var, a.i, b.i AS j, abs(a.v - b.v) AS d FROM v a JOIN v b ON a.var = b.var), d1 AS (SELECT a.t, a.s, a.i, b.i AS j, abs(a.v - b.v) AS d FROM res a JOIN res b ON a.t = b.t AND a.s = b.s)"""
_KSKEL = f"""WITH {_SUP}, {_COND}, p0 AS (WITH {_grouped_moments('SELECT a.var AS x, b.var AS y, a.i, a.j, a.d AS k, b.d AS l FROM d0 a JOIN d0 b ON a.i = b.i AND a.j = b.j AND a.var < b.var', 'x, y')} SELECT * FROM tested),
    e AS (SELECT x, y FROM p0 WHERE p < 0.1), near AS (SELECT x AS v, y AS u FROM e UNION ALL SELECT y, x FROM e),
    p1 AS (WITH {_grouped_moments('SELECT a.t AS x, b.t AS y, a.s AS s, a.i, a.j, a.d AS k, b.d AS l FROM d1 a JOIN d1 b ON a.i = b.i AND a.j = b.j AND a.s = b.s AND a.t < b.t', 'x, y, s')} SELECT * FROM tested),
    gone AS (SELECT DISTINCT e.x, e.y FROM e JOIN p1 ON p1.x = e.x AND p1.y = e.y JOIN near ON near.u = p1.s AND near.v IN (e.x, e.y) WHERE p1.p >= 0.1)"""


@query("skeleton_dcov_l1", f"{_KSKEL} SELECT x, y FROM e EXCEPT SELECT x, y FROM gone")
def _(spark, sf):
    cfg = DiscoverConfig(alpha=0.1, max_conditioning_size=1, ci=CIConfig("dcc.gamma"), graph_stage="skeleton")
    return discover(suppliers(spark, sf), FIVE, cfg, order_by=["i"]).found.tables(spark)["edges"]


# ---- Orientation ------------------------------------------------------------------------------

_TRI = f"WITH {_g(8)}, {_BOTH}, tri AS (SELECT a.v AS x, a.u AS y, b.u AS z FROM bw a JOIN bw b ON a.u = b.v AND a.v < b.u WHERE NOT EXISTS (SELECT 1 FROM bw k WHERE k.v = a.v AND k.u = b.u))"
_SUBSETS = "list_transform(range((1 << len(pool))::BIGINT), lambda b: list_filter(pool, lambda e, i: (b >> (i - 1)) & 1 = 1))"
_VOTES = f"""{_TRI}, pools AS (SELECT x, y, z, (SELECT list(u ORDER BY u) FROM bw WHERE v = x AND u <> z) AS pool FROM tri UNION ALL SELECT x, y, z, (SELECT list(u ORDER BY u) FROM bw WHERE v = z AND u <> x) FROM tri),
    sets AS (SELECT DISTINCT x, y, z, s FROM (SELECT x, y, z, unnest({_SUBSETS}) AS s FROM pools)), pv AS (SELECT x, y AS mid, z, s, array_to_string(s, '|') AS s_key FROM sets),
    tests AS (SELECT x, mid, z, list_contains(s, mid) AS holds, {_PSQL.replace("least(x, y)", "least(x, z)").replace("greatest(x, y)", "greatest(x, z)")} AS p FROM pv),
    share AS (SELECT x, mid AS y, z, avg(holds::INT::DOUBLE) AS share FROM tests WHERE p >= 0.3 GROUP BY ALL)"""


def _votes(spark, sf, majority):
    t = patterns.triple_tests(graph(spark, sf, 8))
    p = t.withColumn("p", formula_p(F.col("x"), F.col("z"), F.col("s")))
    return patterns.unfaithful(p, 0.3, majority).select("x", "y", "z", _r("share").alias("share"))


@query("ambiguous_conservative", f"{_VOTES} SELECT x, y, z, round(share, 6) AS share FROM share WHERE share > 0 AND share < 1")
def _(spark, sf):
    return _votes(spark, sf, False)


@query("ambiguous_majority", f"{_VOTES} SELECT x, y, z, round(share, 6) AS share FROM share WHERE share = 0.5")
def _(spark, sf):
    return _votes(spark, sf, True)


@query("colliders_without_ambiguous", f"{_VOTES} SELECT x, y, z FROM tri WHERE NOT (x + y + z) % 3 = 0 EXCEPT SELECT x, y, z FROM share WHERE share > 0 AND share < 1")
def _(spark, sf):
    g = graph(spark, sf, 8)
    everyone = _t(spark, sf, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("all"))
    pairs = layer.complete_graph(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("v")))
    seps = pairs.crossJoin(F.broadcast(everyone)).select("x", "y", F.filter("all", lambda z: (F.col("x") + F.col("y") + z) % 3 == 0).alias("s"))  # one row
    return patterns.colliders(patterns.skeleton_pdag(g), seps, _votes(spark, sf, False))


@query("neighbour_subsets", f"WITH {_g(8)}, {_BOTH}, pools AS (SELECT v, list(u ORDER BY u) AS pool FROM bw GROUP BY v), s AS (SELECT v, unnest({_SUBSETS}) AS s FROM pools) SELECT v, len(s)::INT AS size, array_to_string(s, '|') AS s_key FROM s WHERE len(s) > 0")
def _(spark, sf):
    masks = layer.spread(layer.neighbours(graph(spark, sf, 8)), F.lit(1), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("adj")), "mask")
    out = masks.select("v", layer.masked(F.col("adj"), F.col("mask")).alias("s"))
    return out.select("v", F.size("s").alias("size"), layer.set_key(F.col("s")).alias("s_key"))


# ---- Precision and failures -------------------------------------------------------------------

#: Tests of pairs of a nation and a region, one for each order of the nation's customers: p-values by arithmetic on keys, some not numbers, every third with a second opinion.
_SNAPSHOTS = """t AS (SELECT o_orderkey AS task_id, c_nationkey AS x, n_regionkey AS y, CAST(o_orderkey % 7 AS VARCHAR) AS s_key,
    CASE WHEN o_orderkey % 17 = 0 THEN CAST('NaN' AS DOUBLE) ELSE (o_orderkey * 7919 % 1000) / 20000.0::DOUBLE END AS p, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 104729 % 1000) / 10000.0::DOUBLE END AS v
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query("golden_replay", f"""WITH {_SNAPSHOTS}, n AS (SELECT *, v IS NOT NULL AND (isnan(p) OR abs(ln(greatest(p, 2.2250738585072014e-308) / 0.05)) <= ln(2) + 1e-12) AS used FROM t),
    f AS (SELECT *, CASE WHEN used THEN v ELSE p END AS q FROM n), h AS (SELECT *, min(CASE WHEN isnan(q) OR q >= 0.05 THEN task_id END) OVER (PARTITION BY x, y) AS hit FROM f), c AS (SELECT * FROM h WHERE hit IS NULL OR task_id <= hit)
    SELECT x, y, bool_or(coalesce(task_id = hit, false)) AS deleted, count(*) AS n_tests, max(CASE WHEN task_id = hit THEN s_key END) AS s_key FROM c GROUP BY x, y""")
def _(spark, sf):
    """Replays of one sequence of tests for each nation."""
    key = F.col("o_orderkey")
    p = F.when(key % 17 == 0, F.lit(float("nan"))).otherwise(key * 7919 % 1000 / 20000.0)
    owned = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = owned.select(key.alias("task_id"), F.col("c_nationkey").alias("edge_x"), F.col("n_regionkey").alias("edge_y"), (key % 7).cast("string").alias("s_key"), p.alias("p"), F.when(key % 3 == 0, key * 104729 % 1000 / 10000.0).alias("v"))
    done = precision.verify(t.select("task_id", "p"), t.filter("v is not null").select("task_id", F.col("v").alias("p")), 0.05, float(np.log(2)))
    c = layer.replay(t.drop("p", "v").join(done.select("task_id", F.col("p_final").alias("p")), "task_id"), 0.05)
    hit = F.col("task_id") == F.col("first_hit")
    return c.groupBy(F.col("edge_x").alias("x"), F.col("edge_y").alias("y")).agg(F.max(F.coalesce(hit, F.lit(False))).alias("deleted"), F.count(F.lit(1)).alias("n_tests"), F.max(F.when(hit, F.col("s_key"))).alias("s_key"))


def _broken_sql(value: str, odd: str) -> str:
    p = f"(SELECT CASE WHEN q IS NULL OR isnan(q) OR isinf(q) THEN {odd} ELSE q END FROM (SELECT CASE WHEN task_id % 3 = 1 THEN {value} ELSE {_PSQL} END AS q))"
    return f"{_replay_sql(1, 0.8, p)} SELECT count(*) AS consumed, count(CASE WHEN task_id = first_hit THEN 1 END) AS deleted FROM consumed"


@query("failure_injection", " UNION ALL ".join(f"SELECT '{n}' AS failure, {str(d).lower()} AS na_delete, consumed, deleted FROM ({_broken_sql(v, '1.0' if d else '0.0')})" for n, v in (("null", "NULL::DOUBLE"), ("nan", "'NaN'::DOUBLE"), ("infinite", "'Infinity'::DOUBLE")) for d in (True, False)))
def _(spark, sf):
    plan, out = layer.layer_plan(graph(spark, sf), 1), None
    for name, value in (("null", None), ("nan", float("nan")), ("infinite", float("inf"))):
        p = precision.inject(formula_provider(formula_p), F.col("task_id") % 3 == 1, value)(plan)
        for keep in (True, False):
            c = layer.replay(plan.join(p, "task_id"), 0.8, keep).agg(F.count(F.lit(1)).alias("consumed"), F.count(F.when(F.col("task_id") == F.col("first_hit"), 1)).alias("deleted"))
            c = c.select(F.lit(name).alias("failure"), F.lit(keep).alias("na_delete"), "consumed", "deleted")
            out = c if out is None else out.unionByName(c)
    return out


@query("replay_snapshot", f"{_replay_sql(1, 0.8)}, k AS (SELECT edge_x, edge_y, bool_or(coalesce(task_id = first_hit, false)) AS deleted, count(*) AS n_tests, max(task_id) AS last_id, arg_max(s_key, task_id) AS last_key FROM consumed GROUP BY ALL) SELECT edge_x, edge_y, deleted, n_tests, sha256(edge_x || '#' || edge_y || '#' || deleted || '#' || n_tests || '#' || last_id || '#' || last_key) AS identity FROM k")
def _(spark, sf):
    return precision.snapshot(layer.replay(_tasks(spark, sf, 1), 0.8))


#: Requests for fits, one for each part.
_ENV = "g AS (SELECT CASE p_size % 3 WHEN 0 THEN 'gaussian' WHEN 1 THEN 'poisson' END AS family, CASE WHEN p_partkey % 2 = 0 THEN 'identity' ELSE 'log' END AS link, CASE WHEN p_partkey % 5 < 3 THEN 'full' WHEN p_partkey % 5 = 3 THEN 'additive' ELSE 'other' END AS formula, p_size % 4 AS given, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END AS penalties, p_partkey % 11 <> 0 AS known FROM part)"


@query("compatibility_envelope", f"WITH {_ENV}, r AS (SELECT list_filter([CASE WHEN NOT known THEN 'version' END, CASE WHEN coalesce(family, '') <> 'gaussian' THEN 'family' END, CASE WHEN link <> 'identity' THEN 'link' END, CASE WHEN formula NOT IN ('full', 'additive') THEN 'formula' END, CASE WHEN given > 2 THEN 'given' END, CASE WHEN penalties <> 1 THEN 'penalties' END], lambda x: x IS NOT NULL) AS failed FROM g) SELECT CASE WHEN len(failed) = 0 THEN 'supported' ELSE 'unsupported' END AS status, CASE WHEN len(failed) = 0 THEN 'run' ELSE 'fall back' END AS action, CASE WHEN len(failed) = 0 THEN 'supported' ELSE 'canary' END AS canary, array_to_string(failed, '|') AS failed, count(*) AS n FROM r GROUP BY ALL")
def _(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    cols = [F.when(z % 3 == 0, "gaussian").when(z % 3 == 1, "poisson"), F.when(k % 2 == 0, "identity").otherwise("log"), F.when(k % 5 < 3, "full").when(k % 5 == 3, "additive").otherwise("other"), z % 4, F.when(k % 7 == 0, 2).otherwise(1), k % 11 != 0]
    out = _t(spark, sf, "part").select(precision.envelope(*cols).alias("e"), precision.envelope(*cols, allow_canary=True)["status"].alias("canary"))
    return out.groupBy(F.col("e.status").alias("status"), F.col("e.action").alias("action"), "canary", F.array_join("e.failed", "|").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query("safe_runs", "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n_regionkey = 0 THEN 'ZeroDivisionError' END AS error, CASE WHEN n_regionkey > 0 THEN 60 // n_regionkey END AS value FROM nation")
def _(spark, sf):
    settings = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    return analytics.safe_map(settings, lambda row: {"value": 60 // row["r"]}, "value long").select("k", "status", F.substring_index("error", ":", 1).alias("error"), "value")


# ---- Comparison and analytics -----------------------------------------------------------------


@query("log_p_drift", f"{_plan_sql(1)}, pv AS (SELECT {_PSQL} AS a, ((task_id * 37) % 1000) / 1000.0::DOUBLE AS b FROM plan), dr AS (SELECT abs(ln(greatest(b, 2.2250738585072014e-308)) - ln(greatest(a, 2.2250738585072014e-308))) AS d FROM pv) SELECT round(max(d), 4) AS largest, round(avg(d), 4) AS mean FROM dr")
def _(spark, sf):
    t = _tasks(spark, sf, 1).withColumn("b", F.col("task_id") * 37 % 1000 / 1000.0).select(graphdiff.log_p_drift(F.col("p"), F.col("b")).alias("d"))
    return t.agg(_r(F.max("d"), 4).alias("largest"), _r(F.avg("d"), 4).alias("mean"))


@query("adjacency_faults", f"WITH {_g()}, del AS (SELECT x, y FROM g WHERE (x + y) % 3 = 0 UNION ALL SELECT x, y FROM g WHERE (x + y) % 9 = 0), fin AS (SELECT x, y FROM g WHERE (x + y) % 3 > 0 AND (x * y) % 7 <> 3 UNION SELECT x, y FROM g WHERE (x + y) % 6 = 0), want AS (SELECT x, y FROM g EXCEPT SELECT x, y FROM del) SELECT x, y, 'lost without a deletion' AS fault FROM (SELECT * FROM want EXCEPT SELECT * FROM fin) UNION ALL SELECT x, y, 'kept though deleted' FROM (SELECT * FROM fin EXCEPT SELECT * FROM want) UNION ALL SELECT x, y, 'deleted twice' FROM del GROUP BY x, y HAVING count(*) > 1")
def _(spark, sf):
    g = graph(spark, sf)
    gone = g.filter("(x + y) % 3 = 0").unionByName(g.filter("(x + y) % 9 = 0"))
    end = g.filter("((x + y) % 3 > 0 and (x * y) % 7 != 3) or (x + y) % 6 = 0")
    return graphdiff.adjacency_faults(g, gone, end)


def _run_of(spark, sf, k, m):
    g = graph(spark, sf, k)
    return {"edges": g, "pmax": graph(spark, sf, 2).select("x", "y", (F.pmod(F.col("x") * m + F.col("y") * 31, F.lit(997)) / 997.0).alias("p")), "levels": g.agg(F.count(F.lit(1)).alias("n_tests"))}


@query("graph_diff", f"""WITH {_g(4, 'ga')}, {_g(6, 'gb')}, {_g(2)}, j AS (SELECT abs(((x * 91 + y * 31) % 997) / 997.0::DOUBLE - ((x * 17 + y * 31) % 997) / 997.0::DOUBLE) AS d FROM g), s AS (SELECT (x + y) % 3 > 0 AS ina, (x * y) % 3 > 0 AS inb, y % 4 = y % 3 AS eq FROM g),
    c AS (SELECT (SELECT count(*) FROM (SELECT * FROM gb EXCEPT SELECT * FROM ga)) AS added, (SELECT count(*) FROM (SELECT * FROM ga EXCEPT SELECT * FROM gb)) AS removed, (SELECT count(*) FROM (SELECT * FROM ga INTERSECT SELECT * FROM gb)) AS unchanged)
    SELECT added, removed, unchanged, added + removed AS shd, (SELECT round(max(d), 6) FROM j) AS max_abs, (SELECT round(avg(d), 6) FROM j) AS mean_abs, (SELECT round(avg(CASE WHEN ina AND inb AND eq THEN 0.0 ELSE 1.0 END), 6) FROM s WHERE ina OR inb) AS mismatch_rate, (SELECT count(*) FROM gb) - (SELECT count(*) FROM ga) AS tests_delta FROM c""")
def _(spark, sf):
    a, b = _run_of(spark, sf, 4, 17), _run_of(spark, sf, 6, 91)
    a["sepsets"], b["sepsets"] = _seps(spark, sf)
    out = graphdiff.graph_diff(a, b)
    return out.select("added", "removed", "unchanged", "shd", _r("pmax.max_abs").alias("max_abs"), _r("pmax.mean_abs").alias("mean_abs"), _r("sepsets.mismatch_rate").alias("mismatch_rate"), "tests_delta")


@query("census_maps", f"{_plan_sql(2)}, r AS (SELECT task_id, 'x' AS side, x AS target, s_key FROM plan UNION ALL SELECT task_id, 'y', y, s_key FROM plan) SELECT task_id, side, target, s_key, sha256(target || '#' || s_key) AS identity FROM r")
def _(spark, sf):
    return analytics.census_maps(layer.layer_plan(graph(spark, sf), 2))


_TIMES = "t AS (SELECT o_orderkey % 7 AS run, sum(o_totalprice) AS total_ms, sum(CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice ELSE 0 END) AS linear_solve_ms, sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 2 ELSE 0 END) AS setup_ms, sum(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 4 ELSE 0 END) AS ci_ms FROM orders GROUP BY 1), w AS (SELECT n_regionkey AS r, count(*)::DOUBLE AS targets_p95, sum(n_nationkey)::DOUBLE AS supported, sum(n_nationkey % 3)::DOUBLE AS unsupported FROM nation GROUP BY 1)"


@query("decision_batching", f"""WITH {_TIMES}, l AS (SELECT * FROM t ORDER BY total_ms DESC LIMIT 1), q AS (SELECT linear_solve_ms / total_ms AS share, (SELECT max(targets_p95) FROM w) AS p95, (SELECT sum(unsupported) / (sum(supported) + sum(unsupported)) FROM w) AS refused, setup_ms, ci_ms, linear_solve_ms AS lin FROM l)
    SELECT CASE WHEN setup_ms >= greatest(lin, ci_ms) OR ci_ms >= greatest(lin, setup_ms) OR share < 0.5 OR p95 < 4 OR refused > 0.25 THEN 'defer' ELSE 'proceed' END AS decision, round(share, 6) AS linear_share, p95 AS targets_p95, round(refused, 6) AS unsupported_share FROM q""")
def _(spark, sf):
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey") % 5
    part = lambda keep, by: F.sum(F.when(keep, F.col("o_totalprice") / by).otherwise(0.0))
    timing = o.groupBy((F.col("o_orderkey") % 7).alias("run")).agg(F.sum("o_totalprice").alias("total_ms"), part(k > 0, 1).alias("linear_solve_ms"), part(k == 0, 2).alias("setup_ms"), part(k == 0, 4).alias("ci_ms"))
    n = F.col("n_nationkey")
    load = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("double").alias("targets_p95"), F.sum(n).cast("double").alias("supported"), F.sum(n % 3).cast("double").alias("unsupported"))
    return analytics.batching_decision(timing, load).select("decision", _r("linear_share").alias("linear_share"), "targets_p95", _r("unsupported_share").alias("unsupported_share"))


@query("decision_approximation", "WITH a AS (SELECT avg(c_acctbal / 20000) AS floor, avg(c_custkey % 10) / 200 AS oracle, avg(c_custkey % 2) AS flip, avg(c_custkey % 4)::DOUBLE AS shd FROM customer) SELECT round(floor, 6) AS floor, round(oracle, 6) AS oracle, floor >= 0.1 AS basis_limits, oracle >= 0.05 AS smoothing_helps, shd >= 1 AS graphs_differ, CASE WHEN floor >= 0.1 AND NOT oracle >= 0.05 AND shd >= 1 THEN 'investigate' ELSE 'defer' END AS decision FROM a")
def _(spark, sf):
    k = F.col("c_custkey")
    rows = _t(spark, sf, "customer").select((F.col("c_acctbal") / 20000).alias("floor"), (k % 10 / 200).alias("oracle"), (k % 2).alias("flip"), (k % 4).alias("shd"))
    return analytics.approximation_decision(rows).select(_r("floor").alias("floor"), _r("oracle").alias("oracle"), "basis_limits", "smoothing_helps", "graphs_differ", "decision")


def _nested_runs(spark, sf):
    n = _t(spark, sf, "nation").withColumn("k", F.col("n_nationkey"))
    level = F.struct((F.col("k") % 4).alias("level"), F.col("k").alias("n_tests"), (F.col("k") % 3 == 0).alias("cached"))
    return n.groupBy(F.col("n_regionkey").alias("run_id")).agg(F.sort_array(F.collect_list(F.struct("k", level.alias("item")))).alias("l"), F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("key"), v.alias("value")) for c, v in (("fit", F.sum("k")), ("test", F.max("k")))))).alias("timings"), F.struct(F.count(F.lit(1)).alias("requests"), F.min("k").alias("fits")).alias("cache")).withColumn("levels", F.transform("l", lambda x: x["item"]))


@query("flatten_levels", "SELECT n_regionkey AS run_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS nth, n_nationkey % 4 AS level, n_nationkey AS n_tests, n_nationkey % 3 = 0 AS cached FROM nation")
def _(spark, sf):
    return analytics.flatten_list(_nested_runs(spark, sf), "levels")


@query("flatten_timings", "SELECT n_regionkey AS run_id, 'fit' AS name, sum(n_nationkey)::BIGINT AS value FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 'test', max(n_nationkey)::BIGINT FROM nation GROUP BY 1")
def _(spark, sf):
    return analytics.flatten_map(_nested_runs(spark, sf), "timings").select("run_id", "name", F.col("value").cast("long").alias("value"))


@query("flatten_cache", "SELECT n_regionkey AS run_id, count(*) AS requests, min(n_nationkey)::BIGINT AS fits FROM nation GROUP BY 1")
def _(spark, sf):
    return analytics.flatten_struct(_nested_runs(spark, sf), "cache").select("run_id", "requests", F.col("fits").cast("long").alias("fits"))
