"""Further queries with their SQL, and SQL of iterative learners: their rounds, written out one after the other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.operators import embeddings, evaluation, generative, grids, layers, linear, neighbours, schedules, selection, sequences, text
from corvane.plans.catalog import _B, _CENTRES, _FLAG, _G, _STEP, _TABLE, LINE, ORACLE, QUERIES, X, X2, _bench, _grid, _r2, _returned, _weights, lines, query, rounded, vectors
from corvane.scratch import written
from corvane.sources.tables import table

# --- learners by rounds ------------------------------------------------------------------------------

_LINEITEM = "r AS MATERIALIZED (SELECT l_quantity / 50 AS x1, l_discount * 10 AS x2, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k FROM lineitem)"


def _newton(name: str, y: str, rounds: int = 9) -> str:
    """CTEs {name}_0 to {name}_rounds of (a, b, c): Newton's steps of a logistic regression, by Cramer's rule."""
    out = f"{name}_0 AS MATERIALIZED (SELECT 0.0 AS a, 0.0 AS b, 0.0 AS c)"
    for i in range(rounds):
        out += f""",
{name}_s{i} AS MATERIALIZED (SELECT a, b, c, sum(y - q) AS g0, sum((y - q) * x1) AS g1, sum((y - q) * x2) AS g2, sum(w) AS h00, sum(w * x1) AS h01, sum(w * x2) AS h02, sum(w * x1 * x1) AS h11, sum(w * x1 * x2) AS h12, sum(w * x2 * x2) AS h22
 FROM (SELECT *, q * (1 - q) AS w FROM (SELECT a, b, c, x1, x2, CAST({y} AS DOUBLE) AS y, 1 / (1 + exp(-(a + b * x1 + c * x2))) AS q FROM r, {name}_{i})) GROUP BY a, b, c),
{name}_{i + 1} AS MATERIALIZED (SELECT a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS a, b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b, c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS c
 FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM {name}_s{i}))"""
    return out


def _named(cte: str, names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, round({c}, 3) + 0.0 AS value FROM {cte}" for n, c in zip(("intercept", *names), "abc", strict=True))


ORACLE["logistic_newton"] = f"WITH {_LINEITEM}, {_newton('p', 'k = 2')} {_named('p_9', X)}"
ORACLE["one_vs_rest"] = f"WITH {_LINEITEM}, {', '.join(_newton(f'm{k}', f'k = {k}') for k in range(3))}, s AS (SELECT k, {', '.join(f'm{i}_9.a + m{i}_9.b * x1 + m{i}_9.c * x2 AS z{i}' for i in range(3))} FROM r, m0_9, m1_9, m2_9) SELECT k, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS prediction, count(*) AS n FROM s GROUP BY ALL"


def _ascent(rounds: int = 25) -> str:
    out = "p_0 AS MATERIALIZED (SELECT 0.0 AS a, 0.0 AS b, 0.0 AS c)"
    for i in range(rounds):
        out += f", p_{i + 1} AS MATERIALIZED (SELECT a + avg(e) AS a, b + avg(e * x1) AS b, c + avg(e * x2) AS c FROM (SELECT a, b, c, x1, x2, CAST(k = 2 AS DOUBLE) - 1 / (1 + exp(-(a + b * x1 + c * x2))) AS e FROM r, p_{i}) GROUP BY a, b, c)"
    return out


ORACLE["logistic_ascent"] = f"WITH {_LINEITEM}, {_ascent()} {_named('p_25', X)}"

_SUMS = "s AS MATERIALIZED (SELECT avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) AS xx, var_pop(l_discount) * count(*) AS zz, covar_pop(l_quantity, l_discount) * count(*) AS xz, covar_pop(l_quantity, l_extendedprice) * count(*) AS xy, covar_pop(l_discount, l_extendedprice) * count(*) AS zy FROM lineitem)"


def _coordinates(l1: float, l2: float) -> str:
    """A round shrinks one weight after the other; the intercept follows from the means."""
    soft = f"sign({{0}}) * greatest(abs({{0}}) - {l1}, 0) / ({{1}} + {l2})"
    b = soft.format("(xy - xz * c)", "xx")
    return f"WITH RECURSIVE {_SUMS}, w(i, b, c) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i + 1, nb, {soft.format('(zy - xz * nb)', 'zz')} FROM (SELECT *, {b} AS nb FROM w, s) WHERE i < 200), p AS (SELECT my - b * mx - c * mz AS a, b, c FROM w, s WHERE i = 200) {_named('p', X2)}"


ORACLE["lasso"] = _coordinates(500.0, 0.0)
ORACLE["elastic_net"] = _coordinates(250.0, 500.0)
ORACLE["gradient_descent"] = f"WITH {_SUMS}, p AS (SELECT my AS a, (xy * zz - zy * xz) / (xx * zz - xz * xz) * sqrt(xx / n) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) * sqrt(zz / n) AS c FROM s, (SELECT count(*) AS n FROM lineitem)) {_named('p', X2)}"

ORACLE["markov_stationary"] = f"WITH {_STEP}, {_TABLE}, q0 AS MATERIALIZED (SELECT s, t, p FROM p), " + ", ".join(f"q{i + 1} AS MATERIALIZED (SELECT a.s, b.t, sum(a.p * b.p) AS p FROM q{i} a JOIN q{i} b ON a.t = b.s GROUP BY ALL)" for i in range(8)) + " SELECT t AS state, round(avg(p), 6) AS p FROM q8 GROUP BY t"

_SOBEL = "(VALUES (-1, -1, -1.0), (-1, 1, 1.0), (0, -1, -2.0), (0, 1, 2.0), (1, -1, -1.0), (1, 1, 1.0)) t(i, j, w)"
ORACLE["corner_response"] = f"""WITH {_G}, k AS (SELECT * FROM {_SOBEL}), d AS (SELECT g.picture, g.r, g.c,
 (SELECT sum(w * s.v) FROM k JOIN g s ON s.picture = g.picture AND s.r = least(greatest(g.r + i, 0), 7) AND s.c = least(greatest(g.c + j, 0), 7)) AS gx,
 (SELECT sum(w * s.v) FROM k JOIN g s ON s.picture = g.picture AND s.r = least(greatest(g.r + j, 0), 7) AND s.c = least(greatest(g.c + i, 0), 7)) AS gy FROM g),
b AS (SELECT a.picture, a.r, a.c, sum(d.gx * d.gx) AS xx, sum(d.gy * d.gy) AS yy, sum(d.gx * d.gy) AS xy FROM d a JOIN d ON d.picture = a.picture AND abs(d.r - a.r) <= 1 AND abs(d.c - a.c) <= 1 GROUP BY ALL)
SELECT picture, r, c, round(xx * yy - xy * xy - 0.04 * (xx + yy) * (xx + yy), 4) + 0.0 AS strength FROM b"""
QUERIES["corner_response"] = lambda spark, d: rounded(grids.corner_response(_grid(spark, d)), 4)
QUERIES["markov_stationary"] = lambda spark, d, f=QUERIES["markov_stationary"]: rounded(f(spark, d))

# --- cross-validation --------------------------------------------------------------------------------

_FOLDS = "o AS (SELECT o_custkey / 1000 AS x1, o_orderkey / 1000 AS x2, o_totalprice / 1000 AS y, row_number() OVER (ORDER BY md5(o_orderkey || ':7'), o_orderkey) - 1 AS place FROM orders), f AS MATERIALIZED (SELECT x1, x2, y, ntile({0}) OVER (ORDER BY place) - 1 AS fold FROM o)"


def _fits(test: str, train: str, penalties: str = "(VALUES (0.0)) t(penalty)") -> str:
    """CTEs m (a model for each fold and penalty) and e (fold, penalty, mse, r2 on the rows of the fold)."""
    return f"""j AS (SELECT DISTINCT fold AS test FROM f WHERE {test}), s AS MATERIALIZED (SELECT test, count(*) AS n, avg(x1) AS mx, avg(x2) AS mz, avg(y) AS my, var_pop(x1) * count(*) AS xx, var_pop(x2) * count(*) AS zz, covar_pop(x1, x2) * count(*) AS xz, covar_pop(x1, y) * count(*) AS xy, covar_pop(x2, y) * count(*) AS zy FROM f JOIN j ON {train} GROUP BY test),
m AS (SELECT test, penalty, (xy * (zz + penalty) - zy * xz) / ((xx + penalty) * (zz + penalty) - xz * xz) AS b, (zy * (xx + penalty) - xy * xz) / ((xx + penalty) * (zz + penalty) - xz * xz) AS c, mx, mz, my FROM s, {penalties}),
e AS MATERIALIZED (SELECT test AS fold, penalty, avg((y - my - b * (x1 - mx) - c * (x2 - mz)) * (y - my - b * (x1 - mx) - c * (x2 - mz))) AS mse, 1 - sum((y - my - b * (x1 - mx) - c * (x2 - mz)) * (y - my - b * (x1 - mx) - c * (x2 - mz))) / (var_pop(y) * count(*)) AS r2 FROM m JOIN f ON f.fold = test GROUP BY test, penalty)"""


ORACLE["cross_validation"] = f"WITH {_FOLDS.format(3)}, {_fits('true', 'fold <> test')} SELECT fold, round(r2, 6) + 0.0 AS r2 FROM e"
ORACLE["grid_search"] = f"WITH {_FOLDS.format(3)}, {_fits('true', 'fold <> test', '(VALUES (0.0), (10.0), (1000.0)) t(penalty)')} SELECT row_number() OVER (ORDER BY avg(r2) DESC, penalty) - 1 AS place, penalty, round(avg(r2), 6) + 0.0 AS mean_r2 FROM e GROUP BY penalty"
for _name in ("cross_validation", "grid_search"):
    QUERIES[_name] = lambda spark, d, f=QUERIES[_name]: rounded(f(spark, d))


def _folded(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") / 1000).alias("x1"), (F.col("o_orderkey") / 1000).alias("x2"), (F.col("o_totalprice") / 1000).alias("y"))
    return written(selection.k_fold(rows, "o_orderkey", n, 7), "folds")


@query("cross_validation_spread", f"WITH {_FOLDS.format(3)}, {_fits('true', 'fold <> test')} SELECT round(avg(r2), 6) + 0.0 AS mean_r2, round(stddev_pop(r2), 6) + 0.0 AS r2_spread, round(avg(mse), 3) AS mean_mse FROM e")
def _cv_spread(spark: SparkSession, d: str) -> DataFrame:
    def both(model, df: DataFrame) -> tuple[float, float]:
        row = evaluation.regression(model.predict(df), "y", "prediction").first()
        return float(row["r2"]), float(row["mse"])

    scores = selection.cross_validate(_folded(spark, d, 3), 3, lambda r: linear.ordinary(linear.Moments.of(r, X, "y")), both)
    mean, deviation = selection.spread([r2 for r2, _ in scores])
    out = spark.createDataFrame([(mean, deviation, selection.spread([m for _, m in scores])[0])], "mean_r2 double, r2_spread double, mean_mse double")
    return rounded(out).withColumn("mean_mse", F.round("mean_mse", 3))


_PENALTIES = "(VALUES (0.0), (1000.0), (100000.0)) t(penalty)"


@query("honest_search", f"WITH {_FOLDS.format(4)}, f3 AS (SELECT * FROM f), {_fits('fold < 3', 'fold <> test AND fold < 3', _PENALTIES)}, q AS (SELECT penalty, avg(r2) AS mean_r2, stddev_pop(r2) AS r2_spread FROM e GROUP BY penalty ORDER BY mean_r2 DESC, penalty LIMIT 1), h AS (SELECT * FROM (WITH {_fits('fold = 3', 'fold < 3', _PENALTIES)} SELECT penalty, r2 FROM e)) SELECT penalty, round(mean_r2, 6) + 0.0 AS mean_r2, round(r2_spread, 6) + 0.0 AS r2_spread, round(r2, 6) + 0.0 AS honest_r2 FROM q JOIN h USING (penalty)")
def _honest(spark: SparkSession, d: str) -> DataFrame:
    rows = _folded(spark, d, 4)
    best, mean, deviation, score = selection.honest_search(rows.where("fold < 3"), rows.where("fold = 3"), 3, selection.candidates(penalty=[0.0, 1000.0, 100000.0]), lambda r, penalty: linear.ridge(linear.Moments.of(r, X, "y"), penalty), _r2)
    return rounded(spark.createDataFrame([(best["penalty"], mean, deviation, score)], "penalty double, mean_r2 double, r2_spread double, honest_r2 double"))


_CLASS_FOLDS = "o AS (SELECT o_orderkey, o_totalprice / 100000 AS x1, o_custkey / 1000 AS x2, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k, row_number() OVER (ORDER BY o_orderstatus, md5(o_orderkey || ':7'), o_orderkey) - 1 AS place FROM orders), f AS MATERIALIZED (SELECT *, place % 4 AS fold FROM o)"
_CLASS_MODEL = """j AS (SELECT DISTINCT fold AS test FROM f), c AS MATERIALIZED (SELECT test, k, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM f JOIN j ON fold <> test GROUP BY ALL), t AS MATERIALIZED (SELECT test, count(*) AS n, 1e-9 * greatest(var_pop(x1), var_pop(x2)) AS e FROM f JOIN j ON fold <> test GROUP BY test),
z AS (SELECT o_orderkey, f.fold, f.k AS actual, c.k AS class, ln(c.n / t.n) - 0.5 * (ln(v1 + e) + ln(v2 + e) + (x1 - m1) * (x1 - m1) / (v1 + e) + (x2 - m2) * (x2 - m2) / (v2 + e)) AS score FROM f JOIN t ON t.test = f.fold JOIN c ON c.test = f.fold),
h AS MATERIALIZED (SELECT o_orderkey, fold, actual, class AS predicted FROM z QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, class) = 1)"""


def _class_cv(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 100000).alias("x1"), (F.col("o_custkey") / 1000).alias("x2"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("k"))
    folds = written(selection.k_fold(rows, "o_orderkey", 4, 7, "o_orderstatus"), "folds")
    return selection.held_out_predictions(folds, 4, lambda df: generative.gaussian_naive_bayes(df, X, "k"))


_POOLED = "x AS (SELECT a.i AS actual, b.i AS predicted, count(h.actual) AS n FROM range(3) a(i) CROSS JOIN range(3) b(i) LEFT JOIN h ON h.actual = a.i AND h.predicted = b.i GROUP BY ALL)"
query("cross_validation_confusion", f"WITH {_CLASS_FOLDS}, {_CLASS_MODEL}, {_POOLED} SELECT * FROM x")(lambda spark, d: evaluation.confusion(_class_cv(spark, d), "k", "prediction", 3))
query("cross_validation_accuracy", f"WITH {_CLASS_FOLDS}, {_CLASS_MODEL}, a AS (SELECT fold, count(*) AS n, avg(CAST(actual = predicted AS DOUBLE)) AS a FROM h GROUP BY fold) SELECT round(avg(a), 6) AS mean_accuracy, round(stddev_pop(a), 6) + 0.0 AS accuracy_spread, round(sum(a * n) / sum(n), 6) AS pooled_accuracy FROM a")(lambda spark, d: rounded(selection.accuracy_spread(_class_cv(spark, d), "k")))
query("cross_validation_macro", f"WITH {_CLASS_FOLDS}, {_CLASS_MODEL}, {_POOLED}, q AS (SELECT c.i, sum(n) FILTER (WHERE actual = c.i AND predicted = c.i) AS hit, sum(n) FILTER (WHERE actual = c.i) AS an, sum(n) FILTER (WHERE predicted = c.i) AS pn FROM x, range(3) c(i) GROUP BY c.i) SELECT round(avg(hit / an), 6) + 0.0 AS macro_recall FROM q")(lambda spark, d: rounded(evaluation.per_class(evaluation.confusion(_class_cv(spark, d), "k", "prediction", 3)).agg(F.avg("recall").alias("macro_recall"))))
query("bootstrap", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':7'), o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders), d AS (SELECT CAST('0x' || substring(md5(i || ':draw:7'), 1, 12) AS BIGINT) % (SELECT count(*) FROM orders) AS place FROM range((SELECT count(*) FROM orders)) t(i)), t AS (SELECT place, count(*) AS times FROM d GROUP BY place) SELECT o_orderkey, coalesce(times, 0) AS times FROM o LEFT JOIN t USING (place)")(lambda spark, d: selection.bootstrap(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7))

# --- trees, by splits of one level after the other ----------------------------------------------------

_FEATURES = ("l_quantity", "l_discount", "l_tax")


def _level(name: str, rows: str, gini: bool) -> str:
    """CTE {name} (node, feature, threshold, gain, l0, n0, l1, n1): the best split of each node of ``rows`` (node, features, t)."""
    part = "PARTITION BY node, feature"
    impure = (lambda n, a, b: f"(2 * ({a} / {n}) * (1 - {a} / {n}))") if gini else (lambda n, a, b: f"greatest(0, {b} / {n} - ({a} / {n}) * ({a} / {n}))")
    return f"""{name}_f AS (""" + " UNION ALL ".join(f"SELECT node, {i} AS feature, CAST({c} AS DOUBLE) AS v, t FROM {rows}" for i, c in enumerate(_FEATURES)) + f"""),
{name}_g AS (SELECT node, feature, v, count(*) AS c, sum(t) AS a, sum(t * t) AS b FROM {name}_f GROUP BY ALL),
{name}_w AS (SELECT node, feature, (v + lead(v) OVER ({part} ORDER BY v)) / 2 AS threshold, sum(c) OVER r AS l0, sum(a) OVER r AS l1, sum(b) OVER r AS l2, sum(c) OVER ({part}) AS n0, sum(a) OVER ({part}) AS n1, sum(b) OVER ({part}) AS n2 FROM {name}_g WINDOW r AS ({part} ORDER BY v ROWS UNBOUNDED PRECEDING)),
{name}_i AS (SELECT *, {impure('n0', 'n1', 'n2')} - l0 / n0 * {impure('l0', 'l1', 'l2')} - (1 - l0 / n0) * {impure('(n0 - l0)', '(n1 - l1)', '(n2 - l2)')} AS gain FROM {name}_w WHERE threshold IS NOT NULL),
{name} AS MATERIALIZED (SELECT * FROM {name}_i WHERE round(gain, 12) > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, feature, threshold) = 1)"""


def _side(split: str, row: str) -> str:
    return "CASE " + " ".join(f"WHEN {split}.feature = {i} THEN {row}.{c} < {split}.threshold" for i, c in enumerate(_FEATURES)) + " END"


def _tree_sql(target: str, gini: bool, last: str) -> str:
    names = "CASE feature " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_FEATURES)) + " END"
    return f"""WITH t0 AS MATERIALIZED (SELECT 0 AS node, {', '.join(_FEATURES)}, CAST({target} AS DOUBLE) AS t FROM lineitem), {_level('a', 't0', gini)},
t1 AS MATERIALIZED (SELECT CASE WHEN {_side('a', 't0')} THEN 1 ELSE 2 END AS node, {', '.join('t0.' + c for c in _FEATURES)}, t FROM t0, a), {_level('b', 't1', gini)},
o AS (SELECT *, row_number() OVER (ORDER BY node) - 1 AS k FROM b), x AS (SELECT 0 AS node, feature, threshold, gain, n0 AS n FROM a UNION ALL SELECT 1, NULL, 0, 0, l0 FROM a UNION ALL SELECT 2, NULL, 0, 0, n0 - l0 FROM a),
y AS (SELECT x.node, coalesce(o.feature, x.feature) AS feature, coalesce(o.threshold, x.threshold) AS threshold, coalesce(o.gain, x.gain) AS gain, n FROM x LEFT JOIN o ON o.node = x.node UNION ALL SELECT 3 + 2 * k, NULL, 0, 0, l0 FROM o UNION ALL SELECT 4 + 2 * k, NULL, 0, 0, n0 - l0 FROM o)
{last.format(names=names)}"""


_NODES = "SELECT node, coalesce({names}, '') AS feature, round(threshold, 6) + 0.0 AS threshold, round(gain, {0}) + 0.0 AS gain, CAST(n AS DOUBLE) AS n FROM y"
ORACLE["tree_classifier"] = _tree_sql("l_returnflag = 'R'", True, _NODES.replace("{0}", "9"))
ORACLE["tree_regressor"] = _tree_sql("l_extendedprice", False, _NODES.replace("{0}", "1"))
ORACLE["gain_importance"] = _tree_sql("l_extendedprice", False, "SELECT c.feature, round(coalesce(sum(n * gain) FILTER (WHERE q.name = c.feature), 0) / sum(n * gain), 6) + 0.0 AS importance FROM (SELECT *, {names} AS name FROM y) q, (VALUES " + ", ".join(f"('{c}')" for c in _FEATURES) + ") c(feature) GROUP BY c.feature")


def _nodes(digits: int):
    def named(f):
        return lambda spark, d: f(spark, d).select("node", F.coalesce("feature", F.lit("")).alias("feature"), (F.round("threshold", 6) + 0.0).alias("threshold"), (F.round("gain", digits) + 0.0).alias("gain"), "n")

    return named


QUERIES["tree_classifier"] = _nodes(9)(QUERIES["tree_classifier"])
QUERIES["tree_regressor"] = _nodes(1)(QUERIES["tree_regressor"])
QUERIES["gain_importance"] = lambda spark, d, f=QUERIES["gain_importance"]: rounded(f(spark, d))


def _boosted(rounds: int = 3, rate: float = 0.5) -> str:
    out = f"WITH t0 AS MATERIALIZED (SELECT 0 AS node, {', '.join(_FEATURES)}, l_extendedprice - avg(l_extendedprice) OVER () AS t FROM lineitem)"
    for i in range(rounds):
        out += f", {_level(f's{i}', f't{i}', False)}, t{i + 1} AS MATERIALIZED (SELECT 0 AS node, {', '.join(f't{i}.{c}' for c in _FEATURES)}, t - {rate} * CASE WHEN {_side(f's{i}', f't{i}')} THEN l1 / l0 ELSE (n1 - l1) / (n0 - l0) END AS t FROM t{i}, s{i})"
    return out + f" SELECT round(avg(t * t), 1) AS mse FROM t{rounds}"


ORACLE["gradient_boosting"] = _boosted()
QUERIES["gradient_boosting"] = lambda spark, d, f=QUERIES["gradient_boosting"]: f(spark, d).select(F.round("mse", 1).alias("mse"))

# --- components: squares of the correlation matrix come to the projection on its first direction -------


def _components_sql(n: int, squarings: int = 22) -> str:
    """CTEs {k} of p_0 .. p_{n-1} (i, j, v) and e (component, feature number, loading)."""
    cells = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_samp({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS v FROM lineitem" for i, a in enumerate(LINE) for j, b in enumerate(LINE))
    out = f"c0 AS MATERIALIZED ({cells})"
    for k in range(n):
        out += f", m{k}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM c{k} WHERE i = j) AS v FROM c{k})"
        for s in range(squarings):
            out += f", q{k}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m{k}_{s} a JOIN m{k}_{s} b ON a.j = b.i GROUP BY ALL), m{k}_{s + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM q{k}_{s} WHERE i = j) AS v FROM q{k}_{s})"
        last = f"m{k}_{squarings}"
        out += f", c{k + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT sum(a.v * b.v) FROM c{k} a JOIN {last} b USING (i, j)) * m.v AS v FROM c{k} c JOIN {last} m USING (i, j)), e{k} AS MATERIALIZED (SELECT i AS j, v / sqrt((SELECT max(v) FROM {last} WHERE i = j)) AS loading FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1))"
    return out


ORACLE["principal_components"] = f"WITH {_components_sql(4)} " + " UNION ALL ".join(f"SELECT {k} AS component, CASE j " + " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(LINE)) + f" END AS feature, round(loading, 4) + 0.0 AS loading FROM e{k}" for k in range(4))
QUERIES["principal_components"] = lambda spark, d, f=QUERIES["principal_components"]: rounded(f(spark, d), 4)
ORACLE["project_components"] = f"WITH {_components_sql(2)}, s AS (SELECT " + ", ".join(f"avg({c}) AS m{j}, stddev_pop({c}) AS s{j}" for j, c in enumerate(LINE)) + " FROM lineitem), w AS (SELECT " + ", ".join(f"(SELECT loading FROM e{k} WHERE j = {j}) AS w{k}{j}" for k in range(2) for j in range(4)) + ") SELECT l_orderkey, l_linenumber, " + ", ".join("round(" + " + ".join(f"w{k}{j} * ({c} - m{j}) / s{j}" for j, c in enumerate(LINE)) + f", 4) + 0.0 AS pc{k + 1}" for k in range(2)) + " FROM lineitem, s, w"
QUERIES["project_components"] = lambda spark, d, f=QUERIES["project_components"]: rounded(f(spark, d), 4)

# --- a Gaussian mixture, by rounds of EM --------------------------------------------------------------


def _mixture(rounds: int = 5, tolerance: float = 1e-3, smoothing: float = 1e-6) -> str:
    """From the grouping by the given centres; a round that gains less than the tolerance is the last."""
    d = [f"((x - {float(x)}) * (x - {float(x)}) + (y - {float(y)}) * (y - {float(y)}))" for x, y in _CENTRES]
    start = " UNION ALL ".join(f"SELECT {i} AS c, {float(x)}::DOUBLE AS m1, {float(y)}::DOUBLE AS m2" for i, (x, y) in enumerate(_CENTRES))
    out = f"""WITH r AS MATERIALIZED (SELECT row_number() OVER () AS rid, l_quantity AS x, l_discount AS y FROM lineitem), k AS (SELECT x, y, CASE WHEN {d[0]} <= {d[1]} AND {d[0]} <= {d[2]} THEN 0 WHEN {d[1]} <= {d[2]} THEN 1 ELSE 2 END AS c FROM r),
p_0 AS MATERIALIZED (SELECT c, count(*) / (SELECT count(*) FROM r) AS w, any_value(m1) AS m1, any_value(m2) AS m2, var_pop(x) + {smoothing} AS s11, covar_pop(x, y) AS s12, var_pop(y) + {smoothing} AS s22, -1e300 AS ll, false AS done FROM k JOIN ({start}) USING (c) GROUP BY c)"""
    for i in range(rounds):
        out += f""",
l_{i} AS (SELECT rid, x, y, c, ln(w) - ln(2 * pi()) - 0.5 * ln(s11 * s22 - s12 * s12) - 0.5 * ((x - m1) * (x - m1) * s22 - 2 * (x - m1) * (y - m2) * s12 + (y - m2) * (y - m2) * s11) / (s11 * s22 - s12 * s12) AS l FROM r, p_{i}),
q_{i} AS (SELECT *, top + ln(sum(exp(l - top)) OVER (PARTITION BY rid)) AS z FROM (SELECT *, max(l) OVER (PARTITION BY rid) AS top FROM l_{i})),
u_{i} AS MATERIALIZED (SELECT c, sum(g) AS n, sum(g * x) / sum(g) AS m1, sum(g * y) / sum(g) AS m2, sum(g * x * x) / sum(g) AS xx, sum(g * x * y) / sum(g) AS xy, sum(g * y * y) / sum(g) AS yy, avg(z) AS ll FROM (SELECT *, exp(l - z) AS g FROM q_{i}) GROUP BY c),
p_{i + 1} AS MATERIALIZED (SELECT c, CASE WHEN done THEN p.w ELSE n / (SELECT sum(n) FROM u_{i}) END AS w, CASE WHEN done THEN p.m1 ELSE u.m1 END AS m1, CASE WHEN done THEN p.m2 ELSE u.m2 END AS m2, CASE WHEN done THEN s11 ELSE xx - u.m1 * u.m1 + {smoothing} END AS s11, CASE WHEN done THEN s12 ELSE xy - u.m1 * u.m2 END AS s12, CASE WHEN done THEN s22 ELSE yy - u.m2 * u.m2 + {smoothing} END AS s22, u.ll AS ll, done OR u.ll - p.ll < {tolerance} AS done FROM p_{i} p JOIN u_{i} u USING (c))"""
    return f"{out} SELECT c AS component, round(w, 4) AS share, round(m1, 4) AS x, round(m2, 4) + 0.0 AS y FROM p_{rounds}"


ORACLE["gaussian_mixture"] = _mixture()
QUERIES["gaussian_mixture"] = lambda spark, d, f=QUERIES["gaussian_mixture"]: rounded(f(spark, d), 4)

# --- robust regression, layers, merges ---------------------------------------------------------------


def _huber(rounds: int = 25, threshold: float = 1.35, tolerance: float = 1e-4) -> str:
    """Weighted sums about the origin, and the rule that stops the rounds."""
    solve = """SELECT n, (y - b * x - c * z) / w AS a, b, c, {keep} FROM (SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS c FROM (SELECT *, xx - x * x / w AS sxx, zz - z * z / w AS szz, xz - x * z / w AS sxz, xy - x * y / w AS sxy, zy - z * y / w AS szy FROM {source}))"""
    sums = "sum(u) AS w, sum(u * l_quantity) AS x, sum(u * l_discount) AS z, sum(u * l_extendedprice) AS y, sum(u * l_quantity * l_quantity) AS xx, sum(u * l_discount * l_discount) AS zz, sum(u * l_quantity * l_discount) AS xz, sum(u * l_quantity * l_extendedprice) AS xy, sum(u * l_discount * l_extendedprice) AS zy"
    r = "abs(l_extendedprice - a - b * l_quantity - c * l_discount)"
    out = f"WITH i AS MATERIALIZED (SELECT count(*) AS n, {sums} FROM (SELECT *, 1.0::DOUBLE AS u FROM lineitem)), o AS MATERIALIZED ({solve.format(keep='0 AS z', source='i')}), p_0 AS MATERIALIZED (SELECT o.n, a, b, c, sqrt((SELECT avg({r} * {r}) FROM lineitem)) AS s, false AS done FROM o)"
    for k in range(rounds):
        out += f""", k_{k} AS MATERIALIZED (SELECT a AS a0, b AS b0, c AS c0, done, CASE WHEN n - {threshold ** 2} * outside > 0 AND inside > 0 THEN sqrt(inside / (n - {threshold ** 2} * outside)) ELSE s END AS s FROM p_{k}, (SELECT sum({r} * {r}) FILTER (WHERE {r} <= {threshold} * s) AS inside, count(*) FILTER (WHERE {r} > {threshold} * s) AS outside FROM lineitem, p_{k})),
g_{k} AS MATERIALIZED (SELECT any_value(n) AS n, any_value(s) AS s, any_value(a0) AS a0, any_value(b0) AS b0, any_value(c0) AS c0, any_value(done) AS done, {sums} FROM (SELECT l.*, q.*, (SELECT n FROM i) AS n, CASE WHEN r <= {threshold} * s THEN 1.0 ELSE {threshold} * s / r END AS u FROM (SELECT *, abs(l_extendedprice - a0 - b0 * l_quantity - c0 * l_discount) AS r FROM lineitem, k_{k}) q, (SELECT 1 AS one) l)),
p_{k + 1} AS MATERIALIZED (SELECT n, CASE WHEN done THEN a0 ELSE a END AS a, CASE WHEN done THEN b0 ELSE b END AS b, CASE WHEN done THEN c0 ELSE c END AS c, s, done OR greatest(abs(a - a0), abs(b - b0), abs(c - c0)) < {tolerance} AS done FROM ({solve.format(keep='s, a0, b0, c0, done', source=f'g_{k}')}))"""
    return f"{out} {_named(f'p_{rounds}', X2)}"


ORACLE["huber"] = _huber()


def _stack() -> str:
    """The drawn weights as numbers in the text."""
    one, two = layers.Dense.drawn(2, 4, "tanh", 1), layers.Dense.drawn(4, 1, "identity", 2)
    hidden = [f"tanh({w[0]!r} * l_quantity + {w[1]!r} * l_discount + {b!r})" for w, b in zip(one.weights.tolist(), one.biases.tolist(), strict=True)]
    return f"SELECT l_orderkey, l_linenumber, round({' + '.join(f'{w!r} * {h}' for w, h in zip(two.weights[0].tolist(), hidden, strict=True))} + {two.biases.tolist()[0]!r}, 6) + 0.0 AS output FROM lineitem"


ORACLE["dense_stack"] = _stack()
QUERIES["dense_stack"] = lambda spark, d, f=QUERIES["dense_stack"]: rounded(f(spark, d))


def _merges_sql(n: int, likelihood: bool) -> str:
    """CTEs w_0 .. w_n (word, s, n), each with the symbols of s merged once more, and b_0 .. b_{n-1} (l, r)."""
    mark, prefix = ("", "##") if likelihood else ("</w>", "")
    out = f"""wb AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), w_0 AS MATERIALIZED (SELECT word, chr(1) || array_to_string(list_transform(string_split(word, ''), lambda c, i: CASE WHEN i > 1 THEN '{prefix}' ELSE '' END || c || CASE WHEN i = length(word) THEN '{mark}' ELSE '' END), chr(2) || chr(1)) || chr(2) AS s, count(*) AS n FROM (SELECT unnest(ws) AS word FROM wb) GROUP BY word)"""
    for k in range(n):
        out += f""", x_{k} AS MATERIALIZED (SELECT string_split(substring(s, 2, length(s) - 2), chr(2) || chr(1)) AS x, n FROM w_{k}),
u_{k} AS (SELECT c, sum(n) AS m FROM (SELECT unnest(x) AS c, n FROM x_{k}) GROUP BY c),
y_{k} AS (SELECT p.l AS l, p.r AS r, sum(n) AS n FROM (SELECT unnest(list_transform(range(1, len(x)), lambda i: struct_pack(l := x[i], r := x[i + 1]))) AS p, n FROM x_{k} WHERE len(x) > 1) GROUP BY ALL HAVING sum(n) >= 2),
b_{k} AS MATERIALIZED (SELECT y.l, y.r FROM y_{k} y JOIN u_{k} a ON a.c = y.l JOIN u_{k} b ON b.c = y.r ORDER BY {'y.n / (a.m * b.m)' if likelihood else 'y.n'} DESC, y.l, y.r LIMIT 1),
w_{k + 1} AS MATERIALIZED (SELECT word, CASE WHEN l IS NULL THEN s ELSE replace(s, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || l || {"CASE WHEN starts_with(r, '##') THEN substring(r, 3) ELSE r END" if likelihood else 'r'} || chr(2)) END AS s, n FROM w_{k} LEFT JOIN b_{k} ON true)"""
    return out


for _name, _n, _likely in (("learn_byte_pairs", 60, False), ("learn_word_pieces", 40, True)):
    ORACLE[_name] = f"WITH {_merges_sql(_n, _likely)} " + " UNION ALL ".join(f'SELECT {k} AS step, l AS "left", r AS "right" FROM b_{k}' for k in range(_n))
ORACLE["encode_byte_pairs"] = f"WITH {_merges_sql(100, False)}, t AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM wb), z AS (SELECT item_id, string_agg(replace(substring(s, 2, length(s) - 2), chr(2) || chr(1), ' '), ' ' ORDER BY i) AS pieces FROM t JOIN w_100 USING (word) GROUP BY item_id) SELECT item_id, CAST(len(string_split(pieces, ' ')) AS INT) AS n, pieces FROM z"

# --- schedules, scores -------------------------------------------------------------------------------

_EPOCHS = "SELECT DISTINCT CAST(l_quantity AS BIGINT) AS epoch FROM lineitem"


@query("schedules", f"WITH e AS ({_EPOCHS}) SELECT epoch, CAST(0.1 AS DOUBLE) AS constant, round(0.5 - CAST(0.4 AS DOUBLE) * least(epoch / 30.0, 1), 9) AS linear, round(0.5 * pow(0.9, epoch), 9) AS exponential FROM e")
def _schedules(spark: SparkSession, d: str) -> DataFrame:
    epochs = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("epoch")).distinct()
    kinds = {"constant": schedules.ConstantSchedule(0.1), "linear": schedules.LinearDecaySchedule(0.5, 0.1, 30), "exponential": schedules.ExponentialDecaySchedule(0.5, 0.9)}
    return rounded(epochs.select("epoch", *[x.column(F.col("epoch")).alias(n) for n, x in kinds.items()]), 9)


_TRIPLE = "SELECT l_orderkey, l_linenumber, [l_quantity * 10, l_discount * 10, l_tax * 10] AS s FROM lineitem"
query("log_totals", f"WITH z AS (SELECT *, list_max(s) AS top FROM ({_TRIPLE})), t AS (SELECT *, top + ln(exp(s[1] - top) + exp(s[2] - top) + exp(s[3] - top)) AS total FROM z) SELECT l_orderkey, l_linenumber, round(total, 6) AS log_total, round(s[2] - total, 6) + 0.0 AS log_share FROM t")(
    lambda spark, d: (lambda s: rounded(lines(spark, d).select("l_orderkey", "l_linenumber", V.log_total(s).alias("log_total"), V.normalised(s)[1].alias("log_share"))))(F.array(F.col("l_quantity") * 10, F.col("l_discount") * 10, F.col("l_tax") * 10))
)
query("weight_normalisation", f"SELECT l_orderkey, l_linenumber, round(2 * s[1] / sqrt(s[1] * s[1] + s[2] * s[2] + s[3] * s[3]), 6) AS w1, round(2 * s[2] / sqrt(s[1] * s[1] + s[2] * s[2] + s[3] * s[3]), 6) + 0.0 AS w2 FROM ({_TRIPLE})")(
    lambda spark, d: (lambda w: rounded(lines(spark, d).select("l_orderkey", "l_linenumber", w[0].alias("w1"), w[1].alias("w2"))))(V.weight_normalised(F.array(F.col("l_quantity") * 10, F.col("l_discount") * 10, F.col("l_tax") * 10), F.lit(2.0)))
)
query("diagonal_gaussian", "WITH s AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_quantity) AS v1, var_pop(l_discount) AS v2 FROM lineitem) SELECT l_orderkey, l_linenumber, round(-0.5 * (ln(2 * pi() * v1) + ln(2 * pi() * v2)) - (l_quantity - m1) * (l_quantity - m1) / (2 * v1) - (l_discount - m2) * (l_discount - m2) / (2 * v2), 6) + 0.0 AS log_density FROM lineitem, s")(
    lambda spark, d: rounded(lines(spark, d).select("l_orderkey", "l_linenumber", generative.DiagonalGaussian.of(lines(spark, d), X2).log_density().alias("log_density")))
)
query("class_shares", f"WITH {_FLAG}, i AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM r), c AS (SELECT k, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM r GROUP BY k), t AS (SELECT count(*) AS n, 1e-9 * greatest(var_pop(x1), var_pop(x2)) AS e FROM r), z AS (SELECT rid, l_orderkey, l_linenumber, c.k, exp(ln(c.n / t.n) - 0.5 * (ln(v1 + e) + ln(v2 + e) + (x1 - m1) * (x1 - m1) / (v1 + e) + (x2 - m2) * (x2 - m2) / (v2 + e))) AS p FROM i, c, t) SELECT l_orderkey, l_linenumber, round(sum(p) FILTER (WHERE k = 1) / sum(p), 4) AS share FROM z GROUP BY rid, l_orderkey, l_linenumber")(
    lambda spark, d: rounded(generative.gaussian_naive_bayes(_returned(spark, d), X, "k").predict(_returned(spark, d)).select("l_orderkey", "l_linenumber", F.col("probabilities")[1].alias("share")), 4)
)

# --- language models of order 3 ----------------------------------------------------------------------

_W3 = "w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), pd AS (SELECT item_id, list_concat(['<s>', '<s>'], ws, ['</s>']) AS p FROM w), g AS (SELECT item_id, unnest(list_transform(range(1, len(p) - 1), lambda i: struct_pack(c := p[i] || ' ' || p[i + 1], w := p[i + 2]))) AS g FROM pd), b AS MATERIALIZED (SELECT g.c AS c, g.w AS w, count(*) AS n FROM g GROUP BY ALL), v AS (SELECT count(DISTINCT w) AS v FROM b)"


def _trigrams(spark: SparkSession, d: str) -> DataFrame:
    return sequences.gram_counts(_bench(spark, d), "words", 3)


query("trigram_counts", f"WITH {_W3}, n AS (SELECT c || ' ' || w AS gram, n FROM b UNION ALL SELECT split_part(c, ' ', 2) || ' ' || w, n FROM b UNION ALL SELECT w, n FROM b) SELECT gram, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY gram")(lambda spark, d: _trigrams(spark, d).select(F.array_join("gram", " ").alias("gram"), "n"))
query("trigram_likelihood", f"WITH {_W3} SELECT c AS context, w AS word, round(n / sum(n) OVER (PARTITION BY c), 9) AS p FROM b")(lambda spark, d: rounded(sequences.conditional(_trigrams(spark, d), 3).select(F.array_join("context", " ").alias("context"), "word", "p"), 9))
query("trigram_additive", f"WITH {_W3} SELECT c AS context, w AS word, round((n + 0.5) / (sum(n) OVER (PARTITION BY c) + 0.5 * v), 9) AS p FROM b, v")(lambda spark, d: rounded(sequences.conditional(_trigrams(spark, d), 3, 0.5).select(F.array_join("context", " ").alias("context"), "word", "p"), 9))
query("next_words", f"WITH {_W3} SELECT c AS context, w AS word, row_number() OVER (PARTITION BY c ORDER BY n DESC, w) AS rank FROM b QUALIFY rank <= 2")(lambda spark, d: sequences.next_words(sequences.conditional(_trigrams(spark, d), 3), 2).select(F.array_join("context", " ").alias("context"), "word", "rank"))
query("text_scores", f"WITH {_W3}, q AS (SELECT c, w, ln((n + 0.5) / (sum(n) OVER (PARTITION BY c) + 0.5 * v)) AS lp FROM b, v) SELECT item_id, count(*) AS n, round(sum(lp), 6) AS log_probability FROM g JOIN q ON g.g.c = q.c AND g.g.w = q.w GROUP BY item_id")(lambda spark, d: rounded(sequences.text_scores(_bench(spark, d), "item_id", "words", sequences.conditional(_trigrams(spark, d), 3, 0.5), 3)))
query("generated_text", f"WITH RECURSIVE {_W3}, best AS (SELECT c, w FROM b QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, w) = 1), s(i, a, z) AS (SELECT 0, '<s>', '<s>' UNION ALL SELECT i + 1, z, w FROM s JOIN best ON c = a || ' ' || z WHERE i < 15 AND w <> '</s>') SELECT i - 1 AS place, z AS word FROM s WHERE i > 0")(
    lambda spark, d: spark.createDataFrame([(i, w) for i, w in enumerate(sequences.generate(sequences.conditional(_trigrams(spark, d), 3), 3, 15))], "place long, word string")
)

# --- vectors, documents, codes -----------------------------------------------------------------------

_UNIT = "e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"


@query("analogy", f"WITH {_UNIT}, t AS (SELECT a.vec_id AS query_id, list_transform(range(1, 65), lambda i: b.v[i] - a.v[i] + c.v[i]) AS v FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 20 = 0), p AS (SELECT query_id, vec_id AS row_id, list_cosine_similarity(t.v, e.v) AS s FROM t, e WHERE vec_id NOT IN (query_id, query_id + 1, query_id + 2)) SELECT query_id, row_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM p QUALIFY rank <= 2")
def _analogy(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    n = rows.agg(F.max("vec_id")).first()[0]
    triples = rows.where(f"vec_id % 20 = 0 AND vec_id + 2 <= {n}").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.col("vec_id") + 2).alias("c"))
    return rounded(neighbours.analogy(rows, triples, 2, "vec_id"))


def _document_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Bags of the benchmark's items over six common words."""
    weights = embeddings.unit_length(_weights(spark, d), "item_id")
    return weights.groupBy("item_id").agg(*[F.coalesce(F.sum(F.when(F.col("word").substr(1, 1) == c, F.col("weight"))), F.lit(0.0)).alias(c) for c in "abcdes"]).select("item_id", F.array(*"abcdes").alias("vector"))


_DOCUMENT = f"{_B}, u AS (SELECT item_id, word, weight / sqrt(sum(weight * weight) OVER (PARTITION BY item_id)) AS weight FROM tw), dv AS MATERIALIZED (SELECT item_id, [" + ", ".join(f"coalesce(sum(weight) FILTER (WHERE word[1] = '{c}'), 0)" for c in "abcdes") + "] AS v FROM u GROUP BY item_id)"
query("document_similarity", f"WITH {_DOCUMENT} SELECT a.item_id AS a, b.item_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM dv a JOIN dv b ON b.item_id = a.item_id + 1")(
    lambda spark, d: (lambda v: rounded(neighbours.similarity(v.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b")), v, "item_id")))(_document_vectors(spark, d))
)
query("document_neighbours", f"WITH {_DOCUMENT}, p AS (SELECT q.item_id AS query_id, r.item_id AS row_id, list_cosine_similarity(q.v, r.v) AS s FROM dv q JOIN dv r ON q.item_id % 20 = 0 AND q.item_id <> r.item_id) SELECT query_id, round(max(s), 6) AS similarity FROM p GROUP BY query_id")(
    lambda spark, d: (lambda v: rounded(neighbours.most_similar(v.where("item_id % 20 = 0"), v, 1, query_id="item_id", row_id="item_id", excluding_self=True).select("query_id", "similarity")))(_document_vectors(spark, d))
)


@query("decoded_ids", "WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), c AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word) SELECT item_id, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w) JOIN c USING (word) WHERE n >= 2 GROUP BY item_id")
def _decoded(spark: SparkSession, d: str) -> DataFrame:
    """Words to ids and back: what the vocabulary doesn't have is lost."""
    rows = _bench(spark, d)
    vocab = written(text.vocabulary(text.word_counts(rows, "words"), 2), "vocabulary")
    ids = text.id_sequences(rows, "item_id", "words", vocab)
    return text.decoded(ids, "item_id", "ids", vocab).select("item_id", F.array_join("words", " ").alias("words"))


@query("dequantised", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id // 100 AS code, v FROM e WHERE vec_id % 100 = 0 AND vec_id < 500), a AS (SELECT e.vec_id, arg_min(c.v, struct_pack(d := list_distance(e.v, c.v), c := c.code)) AS u, any_value(e.v) AS v FROM e, c GROUP BY e.vec_id) SELECT vec_id, round(list_distance(u, v), 6) AS error FROM a")
def _dequantised(spark: SparkSession, d: str) -> DataFrame:
    """The distance of each vector from the code vector that stands for it."""
    from corvane.operators import clustering

    rows = vectors(spark, d).select("vec_id", "vector")
    codes = np.array([r["vector"] for r in rows.where("vec_id % 100 = 0 AND vec_id < 500").orderBy("vec_id").collect()])
    coded = clustering.assign_to(rows, "vector", codes)
    return rounded(clustering.decoded_from(coded, "code", codes).select("vec_id", V.euclidean(F.col("decoded"), F.col("vector")).alias("error")))


# --- pictures ----------------------------------------------------------------------------------------

query("correlate_wrapped", f"WITH {_G}, k AS (SELECT * FROM {_SOBEL}) SELECT g.picture, g.r, g.c, round(sum(w * s.v), 6) + 0.0 AS v FROM g, k JOIN g s ON s.picture = g.picture AND s.r = (g.r + i + 8) % 8 AND s.c = (g.c + j + 8) % 8 GROUP BY ALL")(lambda spark, d: rounded(grids.correlate(_grid(spark, d), grids.KERNELS["sobel"], "wrap")))
query("scaled_up", f"WITH {_G} SELECT picture, r * 2 + i AS r, c * 2 + j AS c, v FROM g, range(2) a(i), range(2) b(j)")(lambda spark, d: grids.scaled_up(_grid(spark, d), 2))
query("turned", f"WITH {_G} SELECT picture, c AS r, 7 - r AS c, v FROM g")(lambda spark, d: grids.turned(_grid(spark, d)))
query("placed", f"WITH {_G}, k AS (SELECT DISTINCT picture, i AS r, j AS c FROM g, range(9) a(i), range(10) b(j)) SELECT k.picture, k.r, k.c, coalesce(v, 0.5) AS v FROM k LEFT JOIN g ON g.picture = k.picture AND g.r + 2 = k.r AND g.c + 1 = k.c")(lambda spark, d: grids.placed(_grid(spark, d), 2, 1, 9, 10, 0.5))
query("mean_absolute_difference", f"WITH {_G} SELECT a.picture, round(avg(abs(a.v - b.v)), 6) AS difference FROM g a JOIN g b ON b.picture = a.picture AND b.r = a.c AND b.c = 7 - a.r GROUP BY a.picture")(lambda spark, d: rounded(grids.mean_absolute_difference(_grid(spark, d), grids.turned(_grid(spark, d)))))
query("separation_ratio", f"WITH {_G}, t AS (SELECT * FROM (VALUES (0, 0, 0.1), (0, 1, -0.1), (1, 0, -0.1), (1, 1, 0.1)) t(i, j, t)), m AS (SELECT g.picture, g.r, g.c, sum((s.v - t) * (s.v - t)) AS score FROM g, t JOIN g s ON s.picture = g.picture AND s.r = g.r + i AND s.c = g.c + j WHERE g.r <= 6 AND g.c <= 6 GROUP BY ALL), o AS (SELECT picture, score, row_number() OVER (PARTITION BY picture ORDER BY score, r, c) AS k FROM m) SELECT picture, round(max(score) FILTER (WHERE k = 2) / max(score) FILTER (WHERE k = 1), 6) AS ratio FROM o GROUP BY picture")(lambda spark, d: rounded(grids.separation_ratio(grids.match_template(_grid(spark, d), [[0.1, -0.1], [-0.1, 0.1]]))))

