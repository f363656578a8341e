"""Queries over the driver's tables, one for each operator, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import tokens as K
from corvane.functions import vectors as V
from corvane.operators import clustering, decomposition, embeddings, evaluation, features, generative, grids, kernels, layers, linear, logistic, neighbours, polynomial, selection, sequences, subwords, text, trees, word_rules, word_vectors
from corvane.operators.scaling import Scaler
from corvane.scratch import written
from corvane.sources.tables import frame, profile, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: Word rule of the text queries, the same in both engines: runs of Latin letters, lower-cased.
LETTERS = "[a-z]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def lines(spark: SparkSession, d: str) -> DataFrame:
    return frame(table(spark, d, "lineitem"), LINE, ("l_orderkey", "l_partkey", "l_linenumber"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def words_of(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, d, name).select(key, text.pattern(F.lower("text"), LETTERS).alias("words"))


# --- scalers -----------------------------------------------------------------------------------------

_SCALES = {
    "min_max": ("min({c})", "max({c}) - min({c})"),
    "max_abs": ("0", "max(abs({c}))"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "root_mean_square": ("0", "sqrt(avg({c} * {c}))"),
    "mean": ("avg({c})", "1"),
    "standard": ("avg({c})", "stddev_pop({c})"),
}


def _scaler(kind: str, inverse: bool = False) -> None:
    centre, spread = _SCALES[kind]
    s = ", ".join(f"{centre.format(c=c)} AS c_{c}, {spread.format(c=c)} AS s_{c}" for c in LINE)
    out = ", ".join(f"round({c}, 4) + 0.0 AS {c}" if inverse else f"round(({c} - c_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in LINE)

    @query(f"scale_{kind}" + "_inverse" * inverse, f"WITH s AS (SELECT {s} FROM lineitem) SELECT l_orderkey, l_linenumber, {out} FROM lineitem, s")
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = lines(spark, d).drop("l_partkey")
        scaler = Scaler.fit(rows, LINE, kind)
        scaled = scaler.transform(rows)
        return rounded(scaler.inverse(scaled), 4) if inverse else rounded(scaled)


for _kind in _SCALES:
    _scaler(_kind)
_scaler("standard", inverse=True)

_TERMS = polynomial.terms(("l_quantity", "l_discount"), 3)


@query("polynomial_expand", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({' * '.join(c for c, k in p.items() for _ in range(k))}, 6) + 0.0 AS \"{polynomial.term_name(p)}\"" for p in _TERMS) + " FROM lineitem")
def _polynomial(spark: SparkSession, d: str) -> DataFrame:
    return rounded(polynomial.expand(lines(spark, d), ("l_quantity", "l_discount"), 3, keep=("l_orderkey", "l_linenumber")))


# --- evaluation --------------------------------------------------------------------------------------


@query("evaluate_regression", "WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - 1500 * l_quantity AS r FROM lineitem) SELECT round(sum(r * r) / 1e6, 2) AS rss_millions, round(avg(r * r), 2) AS mse, round(var_pop(y) * count(*) / 1e6, 2) AS tss_millions, round(1 - sum(r * r) / (var_pop(y) * count(*)), 6) AS r2 FROM e")
def _evaluate_regression(spark: SparkSession, d: str) -> DataFrame:
    out = evaluation.regression(lines(spark, d).withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p")
    return out.select(F.round(F.col("rss") / 1e6, 2).alias("rss_millions"), F.round("mse", 2).alias("mse"), F.round(F.col("tss") / 1e6, 2).alias("tss_millions"), F.round("r2", 6).alias("r2"))


_BINARY = "SELECT CAST(l_returnflag = 'R' AS INT) AS a, CAST(l_quantity > 25 AS INT) AS p FROM lineitem"


@query("evaluate_binary", f"WITH e AS ({_BINARY}), c AS (SELECT count(*) FILTER (WHERE a = 1 AND p = 1) AS tp, count(*) FILTER (WHERE a = 0 AND p = 0) AS tn, count(*) FILTER (WHERE a = 0 AND p = 1) AS fp, count(*) FILTER (WHERE a = 1 AND p = 0) AS fn FROM e), m AS (SELECT *, tp / (tp + fp) AS pr, tp / (tp + fn) AS re FROM c) SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1, round(tn / (tn + fp), 6) AS specificity FROM m")
def _evaluate_binary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("a"), (F.col("l_quantity") > 25).cast("int").alias("p"))
    return rounded(evaluation.binary(rows, "a", "p"))


_MULTI = "e AS (SELECT l_linenumber % 3 AS a, l_partkey % 3 AS p FROM lineitem), k AS (SELECT unnest(range(3)) AS i), m AS (SELECT x.i AS actual, y.i AS predicted, count(e.a) AS n FROM k x CROSS JOIN k y LEFT JOIN e ON e.a = x.i AND e.p = y.i GROUP BY ALL)"
_CLASS = "c AS (SELECT i AS class, (SELECT sum(n) FROM m WHERE actual = i AND predicted = i) AS hit, (SELECT sum(n) FROM m WHERE actual = i) AS an, (SELECT sum(n) FROM m WHERE predicted = i) AS pn FROM k), q AS (SELECT class, hit / pn AS precision, hit / an AS recall FROM c), f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM q)"


def _multi(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("a"), (F.col("l_partkey") % 3).alias("p"))
    return evaluation.confusion(rows, "a", "p", 3)


query("confusion_matrix", f"WITH {_MULTI} SELECT * FROM m")(_multi)
query("evaluate_classes", f"WITH {_MULTI}, {_CLASS} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")(lambda spark, d: rounded(evaluation.per_class(_multi(spark, d))))
query("evaluate_averages", f"WITH {_MULTI}, {_CLASS}, a AS (SELECT round(sum(n) FILTER (WHERE actual = predicted) / sum(n), 6) AS accuracy FROM m) SELECT accuracy, accuracy AS micro_precision, accuracy AS micro_recall, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM f, a GROUP BY accuracy")(lambda spark, d: rounded(evaluation.averages(_multi(spark, d))))

# --- orders, folds -----------------------------------------------------------------------------------

_SHUFFLED = "WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY {strata}md5(o_orderkey || ':7'), o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


query("row_order", _SHUFFLED.format(strata="") + " SELECT o_orderkey, place FROM o")(lambda spark, d: selection.ranked(_orders(spark, d), "o_orderkey", 7).select("o_orderkey", "place"))
query("hold_out", _SHUFFLED.format(strata="") + " SELECT o_orderkey, place >= n - round_even(n * 0.25, 0) AS is_test FROM o")(lambda spark, d: selection.hold_out(_orders(spark, d), "o_orderkey", 0.25, 7).select("o_orderkey", "is_test"))
query("k_fold", _SHUFFLED.format(strata="") + " SELECT o_orderkey, ntile(7) OVER (ORDER BY place) - 1 AS fold FROM o")(lambda spark, d: selection.k_fold(_orders(spark, d), "o_orderkey", 7, 7).select("o_orderkey", "fold"))
query("stratified_fold", _SHUFFLED.format(strata="o_orderstatus, ") + " SELECT o_orderkey, place % 5 AS fold FROM o")(lambda spark, d: selection.k_fold(_orders(spark, d), "o_orderkey", 5, 7, "o_orderstatus").select("o_orderkey", "fold"))
query("missing_classes", "WITH o AS (SELECT o_orderkey % 700 AS k, row_number() OVER (ORDER BY md5(o_orderkey || ':7'), o_orderkey) - 1 AS place FROM orders), f AS (SELECT k, ntile(7) OVER (ORDER BY place) - 1 AS fold FROM o), n AS (SELECT count(DISTINCT k) AS n FROM f) SELECT fold, n - count(DISTINCT k) AS missing FROM f, n GROUP BY fold, n HAVING count(DISTINCT k) < n")(
    lambda spark, d: selection.classes_missing(selection.k_fold(table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 700).alias("rare")), "o_orderkey", 7, 7), "rare")
)

# --- regression --------------------------------------------------------------------------------------

X2 = ("l_quantity", "l_discount")
_SUMS = "s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_discount, l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS zy FROM lineitem)"
_COEF = "SELECT 'intercept' AS name, round(my - b * mx - c * mz, 3) AS value FROM b UNION ALL SELECT 'l_quantity', round(b, 3) FROM b UNION ALL SELECT 'l_discount', round(c, 3) FROM b"


def coefficients(spark: SparkSession, model, digits: int = 3) -> DataFrame:
    rows = [("intercept", model.intercept), *zip(model.names, model.weights, strict=True)]
    return spark.createDataFrame([(k, float(round(v, digits)) + 0.0) for k, v in rows], "name string, value double")


def _moments(spark: SparkSession, d: str) -> linear.Moments:
    return linear.Moments.of(lines(spark, d), X2, "l_extendedprice")


query("ols_simple", "SELECT 'intercept' AS name, round(regr_intercept(l_extendedprice, l_quantity), 3) AS value FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem")(lambda spark, d: coefficients(spark, linear.simple(lines(spark, d), "l_quantity", "l_extendedprice")))
query("ols_multiple", f"WITH {_SUMS}, b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS c FROM s) {_COEF}")(lambda spark, d: coefficients(spark, linear.ordinary(_moments(spark, d))))
query("ridge", f"WITH {_SUMS}, p AS (SELECT n, mx, mz, my, xx + 100.0 / n AS xx, zz + 100.0 / n AS zz, xz, xy, zy FROM s), b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS c FROM p) {_COEF}")(lambda spark, d: coefficients(spark, linear.ridge(_moments(spark, d), 100.0)))
query("normal_equations", "SELECT round(count(*), 2) AS n, round(sum(l_quantity * l_quantity), 2) AS xx, round(sum(l_quantity * l_discount), 2) AS xz, round(sum(l_discount * l_discount), 2) AS zz FROM lineitem")(
    lambda spark, d: (lambda m: spark.createDataFrame([(round(float(m.n), 2), round(float(m.xx[1, 1]), 2), round(float(m.xx[1, 2]), 2), round(float(m.xx[2, 2]), 2))], "n double, xx double, xz double, zz double"))(_moments(spark, d))
)
query("predict_linear", "SELECT l_orderkey, l_linenumber, round(l_quantity * 1500 - l_discount * 200 + 10, 4) AS prediction FROM lineitem")(lambda spark, d: rounded(linear.LinearModel(list(X2), 10.0, [1500.0, -200.0]).predict(lines(spark, d)).select("l_orderkey", "l_linenumber", "prediction"), 4))
query("lasso")(lambda spark, d: coefficients(spark, linear.lasso(_moments(spark, d), 1000.0)))
query("elastic_net")(lambda spark, d: coefficients(spark, linear.elastic_net(_moments(spark, d), 1000.0, 0.5)))
query("gradient_descent")(lambda spark, d: coefficients(spark, linear.gradient_descent(linear.Moments.of(Scaler.fit(lines(spark, d), X2, "standard").transform(lines(spark, d)), X2, "l_extendedprice"), 0.1)))
query("huber")(lambda spark, d: coefficients(spark, linear.huber(lines(spark, d), X2, "l_extendedprice", rounds=25, tolerance=1e-4)))

# --- classification ----------------------------------------------------------------------------------


def _returned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_returnflag") == "R").cast("double").alias("y"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("k"))


X = ("x1", "x2")
query("logistic_newton")(lambda spark, d: coefficients(spark, logistic.newton(_returned(spark, d), X, "y")))
query("logistic_ascent")(lambda spark, d: coefficients(spark, logistic.ascent(_returned(spark, d), X, "y", 1.0, 25)))
query("softmax_regression")(lambda spark, d: spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(logistic.multinomial(_returned(spark, d), X, "k", 3).rows) for j, v in enumerate(r)], "class int, column int, value double"))
query("one_vs_rest")(lambda spark, d: logistic.one_vs_rest(_returned(spark, d), X, "k", 3).predict(_returned(spark, d)).groupBy("k", "prediction").agg(F.count("*").alias("n")))

_FLAG = "r AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x1, l_discount * 10 AS x2, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS k FROM lineitem)"
_NB = "c AS (SELECT k, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM r GROUP BY k), t AS (SELECT count(*) AS n, 1e-9 * greatest(var_pop(x1), var_pop(x2)) AS e FROM r)"


@query("gaussian_naive_bayes", f"WITH {_FLAG}, {_NB} SELECT l_orderkey, l_linenumber, c.k AS class, round(ln(c.n / t.n) - 0.5 * (ln(v1 + e) + ln(v2 + e) + (x1 - m1) * (x1 - m1) / (v1 + e) + (x2 - m2) * (x2 - m2) / (v2 + e)), 5) AS score FROM r, c, t")
def _nb(spark: SparkSession, d: str) -> DataFrame:
    rows = _returned(spark, d)
    scored = generative.gaussian_naive_bayes(rows, X, "k").predict(rows)
    return rounded(scored.select("l_orderkey", "l_linenumber", F.posexplode("scores").alias("class", "score")), 5)


_POOLED = "p AS (SELECT sum(n * a) / (sum(n) - 3) AS a, sum(n * b) / (sum(n) - 3) AS b, sum(n * c) / (sum(n) - 3) AS c, sum(n) AS n FROM (SELECT count(*) AS n, var_pop(x1) AS a, covar_pop(x1, x2) AS b, var_pop(x2) AS c FROM r GROUP BY k))"


@query("linear_discriminant", f"WITH {_FLAG}, {_POOLED}, m AS (SELECT k, count(*) AS nk, avg(x1) AS m1, avg(x2) AS m2 FROM r GROUP BY k), i AS (SELECT n, c / (a * c - b * b) AS q1, -b / (a * c - b * b) AS q2, a / (a * c - b * b) AS q3, ln(a * c - b * b) AS ld FROM p) SELECT l_orderkey, l_linenumber, m.k AS class, round(ln(nk / n) - 0.5 * (ld + m1 * m1 * q1 + 2 * m1 * m2 * q2 + m2 * m2 * q3) + x1 * (q1 * m1 + q2 * m2) + x2 * (q2 * m1 + q3 * m2), 5) AS score FROM r, m, i")
def _lda(spark: SparkSession, d: str) -> DataFrame:
    rows = _returned(spark, d)
    return rounded(generative.linear_discriminant(rows, X, "k").predict(rows).select("l_orderkey", "l_linenumber", F.posexplode("scores").alias("class", "score")), 5)


@query("quadratic_discriminant", f"WITH {_FLAG}, m AS (SELECT k, count(*) AS nk, avg(x1) AS m1, avg(x2) AS m2, var_samp(x1) AS a, covar_samp(x1, x2) AS b, var_samp(x2) AS c FROM r GROUP BY k), t AS (SELECT count(*) AS n FROM r) SELECT l_orderkey, l_linenumber, m.k AS class, round(ln(nk / n) - 0.5 * (ln(a * c - b * b) + ((x1 - m1) * (x1 - m1) * c - 2 * (x1 - m1) * (x2 - m2) * b + (x2 - m2) * (x2 - m2) * a) / (a * c - b * b)), 5) AS score FROM r, m, t")
def _qda(spark: SparkSession, d: str) -> DataFrame:
    rows = _returned(spark, d)
    return rounded(generative.quadratic_discriminant(rows, X, "k").predict(rows).select("l_orderkey", "l_linenumber", F.posexplode("scores").alias("class", "score")), 5)


# --- neighbours --------------------------------------------------------------------------------------

_DIST = {"euclidean": "list_distance(q.v, r.v)", "manhattan": "list_sum(list_transform(range(1, 65), lambda i: abs(q.v[i] - r.v[i])))", "chebyshev": "list_max(list_transform(range(1, 65), lambda i: abs(q.v[i] - r.v[i])))", "cosine": "list_cosine_distance(q.v, r.v)", "canberra": "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN abs(q.v[i]) + abs(r.v[i]) = 0 THEN 0 ELSE abs(q.v[i] - r.v[i]) / (abs(q.v[i]) + abs(r.v[i])) END))"}
_EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _near_sql(metric: str, k: int = 5) -> str:
    return f"{_EMB}, p AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, {_DIST[metric]} AS distance FROM e q JOIN e r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM p QUALIFY rank <= {k})"


def _near(spark: SparkSession, d: str, metric: str, k: int = 5) -> DataFrame:
    rows = vectors(spark, d)
    return neighbours.nearest(rows.where("vec_id % 20 = 0"), rows, k, metric, "vec_id", "vec_id", excluding_self=True)


for _metric in _DIST:
    query(f"nearest_{_metric}", f"WITH {_near_sql(_metric)} SELECT query_id, row_id, round(distance, 6) AS distance, rank FROM n")(lambda spark, d, m=_metric: rounded(_near(spark, d, m)))
query("nearest_regress", f"WITH {_near_sql('euclidean')} SELECT query_id, round(avg(label), 6) AS prediction FROM n JOIN e ON vec_id = row_id GROUP BY query_id")(lambda spark, d: rounded(neighbours.regress(_near(spark, d, "euclidean"), vectors(spark, d), "label", "vec_id")))
query("nearest_classify", f"WITH {_near_sql('euclidean')}, v AS (SELECT query_id, label, count(*) AS c FROM n JOIN e ON vec_id = row_id GROUP BY ALL) SELECT query_id, arg_max(label, c * 1000 - label) AS prediction, round(max(c) / sum(c), 6) AS share FROM v GROUP BY query_id")(lambda spark, d: rounded(neighbours.classify(_near(spark, d, "euclidean"), vectors(spark, d), "label", "vec_id")))
query("within_radius", f"WITH {_EMB} SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_distance(q.v, r.v), 6) AS distance FROM e q JOIN e r ON q.vec_id % 20 = 0 WHERE list_distance(q.v, r.v) <= 1.0")(lambda spark, d: rounded(neighbours.within(vectors(spark, d).where("vec_id % 20 = 0"), vectors(spark, d), 1.0, "euclidean", "vec_id", "vec_id")))
query("most_similar", f"WITH {_EMB}, p AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, list_cosine_similarity(q.v, r.v) AS s FROM e q JOIN e r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id) SELECT query_id, row_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, row_id) AS rank FROM p QUALIFY rank <= 5")(lambda spark, d: rounded(neighbours.most_similar(vectors(spark, d).where("vec_id % 20 = 0"), vectors(spark, d), 5, query_id="vec_id", row_id="vec_id", excluding_self=True)))


@query("kernels", f"WITH {_EMB}, p AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, list_inner_product(q.v, r.v) AS k, list_distance(q.v, r.v) AS g FROM e q JOIN e r ON q.vec_id % 20 = 0) SELECT query_id, row_id, round(k, 6) + 0.0 AS linear, round(pow(k + 1, 3), 6) AS polynomial, round(exp(-g * g), 6) AS radial, round(tanh(k), 6) + 0.0 AS sigmoid FROM p")
def _kernels(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return neighbours.kernel_values(rows.where("vec_id % 20 = 0"), rows, "vec_id", "vec_id", digits=6)


# --- trees -------------------------------------------------------------------------------------------

_SPLIT = """f AS (SELECT 0 AS feature, l_quantity AS v, l_returnflag = 'R' AS y FROM lineitem UNION ALL SELECT 1, l_discount, l_returnflag = 'R' FROM lineitem),
g AS (SELECT feature, v, count(*) AS c, count(*) FILTER (WHERE y) AS c1 FROM f GROUP BY ALL),
w AS (SELECT feature, (v + lead(v) OVER (PARTITION BY feature ORDER BY v)) / 2 AS threshold, sum(c) OVER a AS l, sum(c1) OVER a AS l1, sum(c) OVER (PARTITION BY feature) AS n, sum(c1) OVER (PARTITION BY feature) AS n1 FROM g WINDOW a AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, 2 * (n1 / n) * (1 - n1 / n) - (l / n) * 2 * (l1 / l) * (1 - l1 / l) - ((n - l) / n) * 2 * ((n1 - l1) / (n - l)) * (1 - (n1 - l1) / (n - l)) AS gain FROM w WHERE threshold IS NOT NULL)"""


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_quantity", "l_discount", F.lit(0).alias("node"), F.lit(1.0).alias("weight"), (F.col("l_returnflag") == "R").cast("double").alias("target"))


query("split_candidates", f"WITH {_SPLIT} SELECT feature, round(threshold, 6) AS threshold, round(gain, 9) + 0.0 AS gain FROM i")(lambda spark, d: trees.candidates(_split_rows(spark, d), ("l_quantity", "l_discount"), 2, "gini").select("feature", F.round("threshold", 6).alias("threshold"), (F.round("gain", 9) + 0.0).alias("gain")))
query("best_split", f"WITH {_SPLIT} SELECT feature, round(threshold, 6) AS threshold, round(gain, 9) AS gain FROM i ORDER BY round(gain, 12) DESC, feature, threshold LIMIT 1")(lambda spark, d: trees.best_splits(trees.candidates(_split_rows(spark, d), ("l_quantity", "l_discount"), 2, "gini"), ("l_quantity", "l_discount")).select(F.when(F.col("feature") == "l_quantity", 0).otherwise(1).alias("feature"), F.round("threshold", 6).alias("threshold"), F.round("gain", 9).alias("gain")))
query("impurities", "WITH c AS (SELECT l_linestatus AS s, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT s, n / sum(n) OVER (PARTITION BY s) AS p FROM c) SELECT s AS l_linestatus, round(1 - sum(p * p), 6) + 0.0 AS gini, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY s")(
    lambda spark, d: rounded(table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n")).groupBy("l_linestatus").agg(F.collect_list("n").alias("ns")).select("l_linestatus", F.transform("ns", lambda n: n / V.total(F.transform("ns", lambda x: x.cast("double")))).alias("p")).select("l_linestatus", V.gini(F.col("p")).alias("gini"), V.entropy(F.col("p")).alias("entropy")))
)


def _tree_nodes(spark: SparkSession, tree: trees.Tree) -> DataFrame:
    return spark.createDataFrame([(i, x.feature, float(x.threshold), float(round(x.gain, 9)), float(x.n)) for i, x in enumerate(tree.nodes)], "node int, feature string, threshold double, gain double, n double")


def _tree_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"), "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("int").alias("k"))


T = ("l_quantity", "l_discount", "l_tax")
query("tree_classifier")(lambda spark, d: _tree_nodes(spark, trees.grow(_tree_rows(spark, d), T, "k", 2, max_depth=2)))
query("tree_regressor")(lambda spark, d: _tree_nodes(spark, trees.grow(_tree_rows(spark, d), T, "y", max_depth=2)))
query("forest_classifier")(lambda spark, d: trees.forest(_tree_rows(spark, d), "key", T, "k", 2, n_classes=2, max_depth=1, max_features=2).predict(_tree_rows(spark, d)).groupBy("k", "prediction").agg(F.count("*").alias("n")))
query("bagging_regressor")(lambda spark, d: trees.forest(_tree_rows(spark, d), "key", T, "y", 2, max_depth=1).predict(_tree_rows(spark, d)).agg(F.avg((F.col("prediction") - F.col("y")) ** 2).alias("mse")))
query("gradient_boosting")(lambda spark, d: trees.boosting(_tree_rows(spark, d), T, "y", 3, 0.5, 1).predict(_tree_rows(spark, d)).agg(F.avg((F.col("prediction") - F.col("y")) ** 2).alias("mse")))
query("adaboost")(lambda spark, d: trees.adaboost(_tree_rows(spark, d), T, "k", 2, 2).predict(_tree_rows(spark, d)).groupBy("k", "prediction").agg(F.count("*").alias("n")))
query("gain_importance")(lambda spark, d: spark.createDataFrame(list(trees.grow(_tree_rows(spark, d), T, "y", max_depth=2).importances().items()), "feature string, importance double"))

# --- clustering, components --------------------------------------------------------------------------

_CENTRES = np.array([[10.0, 0.02], [25.0, 0.05], [40.0, 0.08]])
_ASSIGN = "a AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, [" + ", ".join(f"(l_quantity - {x}) * (l_quantity - {x}) + (l_discount - {y}) * (l_discount - {y})" for x, y in _CENTRES) + "] AS ds FROM lineitem), b AS (SELECT *, list_position(ds, list_min(ds)) - 1 AS cluster, list_min(ds) AS d FROM a)"
query("assign_centres", f"WITH {_ASSIGN} SELECT l_orderkey, l_linenumber, cluster FROM b")(lambda spark, d: clustering.KMeans(list(X2), _CENTRES, 0.0).predict(lines(spark, d)).select("l_orderkey", "l_linenumber", "cluster"))
query("cluster_summary", f"WITH {_ASSIGN} SELECT cluster, count(*) AS size, round(sum(d), 2) AS inertia FROM b GROUP BY cluster")(lambda spark, d: rounded(clustering.KMeans(list(X2), _CENTRES, 0.0).summary(lines(spark, d)), 2))
query("lloyd_step", f"WITH {_ASSIGN} SELECT cluster, round(avg(l_quantity), 6) AS x, round(avg(l_discount), 6) AS y FROM b GROUP BY cluster")(lambda spark, d: rounded(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(clustering.lloyd(lines(spark, d), X2, _CENTRES, rounds=1).centres)], "cluster int, x double, y double")))
query("k_means")(lambda spark, d: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(clustering.k_means(_tree_rows(spark, d), X2, "key", 3, starts=1, rounds=15).centres)], "cluster int, x double, y double"))
query("gaussian_mixture")(lambda spark, d: spark.createDataFrame([(i, float(w), float(m[0]), float(m[1])) for i, (w, m) in enumerate((lambda g: zip(g.shares, g.means, strict=True))(clustering.gaussian_mixture(lines(spark, d), X2, clustering.KMeans(list(X2), _CENTRES, 0.0), rounds=5)))], "component int, share double, x double, y double"))
_DB = """RECURSIVE r AS (SELECT s_suppkey AS id, s_acctbal / 500 AS x, s_nationkey AS y FROM supplier),
p AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM r a JOIN r b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4),
c AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 4), l AS (SELECT a, b FROM p WHERE a IN (FROM c) AND b IN (FROM c)),
t(id, reach) AS (SELECT id, id FROM c UNION SELECT t.id, l.b FROM t JOIN l ON t.reach = l.a), m AS (SELECT id, min(reach) AS label FROM t GROUP BY id),
n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS number FROM (SELECT DISTINCT label FROM m)),
o AS (SELECT a AS id, arg_min(b, struct_pack(d := d, b := b)) AS core FROM p WHERE a NOT IN (FROM c) AND b IN (FROM c) GROUP BY a)
SELECT r.id AS s_suppkey, coalesce(n.number, -1) AS label FROM r LEFT JOIN o ON o.id = r.id LEFT JOIN m ON m.id = coalesce(o.core, r.id) LEFT JOIN n ON n.label = m.label"""
query("dbscan", f"WITH {_DB}")(lambda spark, d: clustering.dbscan(table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 500).alias("x"), F.col("s_nationkey").cast("double").alias("y")), ("x", "y"), "s_suppkey", 2.0, 4))
query("agglomerative")(lambda spark, d: (lambda rows: spark.createDataFrame(list(zip([r[0] for r in rows], map(int, clustering.agglomerate(np.array([[r[1] / 1000, float(r[2])] for r in rows]), 5)[0]), strict=True)), "n_nationkey long, label int"))(table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count("*").alias("n")).orderBy("c_nationkey").collect()))

query("covariance_matrix", "WITH c AS (SELECT " + ", ".join(f"covar_samp({a}, {b}) AS c{i}{j}" for i, a in enumerate(LINE) for j, b in enumerate(LINE) if j <= i) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(c{max(i, j)}{min(i, j)}, 4) + 0.0 AS v FROM c" for i in range(4) for j in range(4)))(
    lambda spark, d: rounded(lines(spark, d).agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.covar_samp(a, b).alias("v")) for i, a in enumerate(LINE) for j, b in enumerate(LINE)]).alias("x")).select(F.explode("x").alias("x")).select("x.i", "x.j", "x.v"), 4)
)
query("principal_components")(lambda spark, d: spark.createDataFrame([(k, LINE[j], float(round(v, 6))) for k, row in enumerate(decomposition.principal_components(lines(spark, d), LINE, standardize=True).loadings) for j, v in enumerate(row)], "component int, feature string, loading double"))
query("explained_variance", "WITH c AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS c FROM lineitem), e AS (SELECT 1 + abs(b) / sqrt(a * c) AS v1, 1 - abs(b) / sqrt(a * c) AS v2 FROM c) SELECT 0 AS component, round(v1 / 2, 6) AS share FROM e UNION ALL SELECT 1, round(v2 / 2, 6) FROM e")(lambda spark, d: spark.createDataFrame([(k, float(round(v, 6))) for k, v in enumerate(decomposition.principal_components(lines(spark, d), X2, standardize=True).shares())], "component int, share double"))
query("project_components")(lambda spark, d: decomposition.principal_components(lines(spark, d), LINE, 2, True).transform(lines(spark, d)).select("l_orderkey", "l_linenumber", "pc1", "pc2"))

# --- sequences ---------------------------------------------------------------------------------------

_STEP = "st AS (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events), n AS (SELECT s, t, count(*) AS n FROM st WHERE t IS NOT NULL GROUP BY ALL)"
_TABLE = "x AS (SELECT s AS v FROM n UNION SELECT t FROM n), p AS (SELECT a.v AS s, b.v AS t, (coalesce(n.n, 0) + 0.5) / (sum(coalesce(n.n, 0)) OVER (PARTITION BY a.v) + 0.5 * count(*) OVER (PARTITION BY a.v)) AS p FROM x a CROSS JOIN x b LEFT JOIN n ON n.s = a.v AND n.t = b.v)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return sequences.transitions(table(spark, d, "events"), "user_id", ("ts", "event_id"), "event_type")


query("markov_counts", f"WITH {_STEP} SELECT * FROM n")(_steps)
query("markov_table", f"WITH {_STEP}, {_TABLE} SELECT s, t, round(p, 6) AS p FROM p")(lambda spark, d: rounded(sequences.transition_table(_steps(spark, d), 0.5)))
query("markov_score", f"WITH {_STEP}, {_TABLE}, e AS (SELECT user_id, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS t FROM events) SELECT user_id, round(sum(coalesce(ln(p), 0)), 5) + 0.0 AS log_probability FROM e LEFT JOIN p USING (s, t) GROUP BY user_id")(lambda spark, d: rounded(sequences.log_probabilities(table(spark, d, "events"), sequences.transition_table(_steps(spark, d), 0.5), "user_id", "event_id", "event_type"), 5))
query("markov_two_steps", f"WITH {_STEP}, {_TABLE} SELECT a.s, b.t, round(sum(a.p * b.p), 6) AS p FROM p a JOIN p b ON a.t = b.s GROUP BY ALL")(lambda spark, d: (lambda c: spark.createDataFrame([(s, t, round(p, 6)) for s in c.states for t, p in c.after(s, 2).items()], "s string, t string, p double"))(sequences.MarkovChain.of(sequences.transition_table(_steps(spark, d), 0.5))))
query("markov_stationary")(lambda spark, d: spark.createDataFrame(list(sequences.MarkovChain.of(sequences.transition_table(_steps(spark, d), 0.5)).stationary().items()), "state string, p double"))
query("discounted_returns", "WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) SELECT a.event_id, round(sum(b.value * pow(0.9, b.i - a.i)), 6) AS discounted FROM e a JOIN e b ON a.user_id = b.user_id AND b.i >= a.i GROUP BY a.event_id")(lambda spark, d: _returns(spark, d))


def _returns(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, d, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return rounded(sequences.discounted_returns(rows, "user_id", "i", "value", 0.9).select("event_id", "discounted"))


_W = f"w AS (SELECT doc_id, regexp_extract_all(lower(text), '{LETTERS}') AS ws FROM documents)"
_GRAMS = f"{_W}, pd AS (SELECT list_concat(['<s>'], ws, ['</s>']) AS p FROM w), g AS (SELECT unnest(list_concat(list_transform(range(2, len(p) + 1), lambda i: p[i]), list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]))) AS gram FROM pd), n AS (SELECT gram, count(*) AS n FROM g GROUP BY gram), b AS (SELECT split_part(gram, ' ', 1) AS c, split_part(gram, ' ', 2) AS w, n FROM n WHERE contains(gram, ' ')), u AS (SELECT gram, n FROM n WHERE NOT contains(gram, ' '))"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return sequences.gram_counts(words_of(spark, d), "words", 2)


query("gram_counts", f"WITH {_GRAMS} SELECT gram, n FROM n")(lambda spark, d: _counts(spark, d).select(F.array_join("gram", " ").alias("gram"), "n"))
query("gram_contexts", f"WITH {_GRAMS} SELECT c AS context, sum(n) AS total, count(*) AS followers FROM b GROUP BY c")(lambda spark, d: sequences.contexts(_counts(spark, d), 2).withColumn("context", F.array_join("context", " ")))
query("preceding_types", f"WITH {_GRAMS} SELECT w AS gram, count(*) AS types FROM b GROUP BY w")(lambda spark, d: sequences.preceding_types(_counts(spark, d), 2).withColumn("gram", F.array_join("gram", " ")))
query("frequency_of_frequencies", f"WITH {_GRAMS} SELECT n AS r, count(*) AS n_r FROM b GROUP BY n")(lambda spark, d: sequences.frequency_of_frequencies(_counts(spark, d), 2))
query("bigram_likelihood", f"WITH {_GRAMS} SELECT c AS context, w AS word, round(n / sum(n) OVER (PARTITION BY c), 9) AS p FROM b")(lambda spark, d: rounded(sequences.bigram_probabilities(_counts(spark, d)), 9))
query("bigram_additive", f"WITH {_GRAMS} SELECT c AS context, w AS word, round((n + 1) / (sum(n) OVER (PARTITION BY c) + (SELECT count(*) FROM u)), 6) AS p FROM b")(lambda spark, d: rounded(sequences.bigram_probabilities(_counts(spark, d), 1.0)))
query("character_grams", "WITH p AS (SELECT DISTINCT p_brand AS x, '_' || p_brand || '_' AS y FROM part) SELECT x AS p_brand, unnest(list_transform(range(1, length(y) - 1), lambda i: substring(y, i, 3))) AS gram FROM p")(lambda spark, d: table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.explode(sequences.character_grams(F.col("p_brand"), 3, "_", "_")).alias("gram")))

# --- words, subwords ---------------------------------------------------------------------------------

_WC = f"{_W}, c AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word)"
query("whitespace_words", "SELECT doc_id, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", F.size(text.whitespace(F.col("text"))).alias("n")))
query("word_counts", f"WITH {_WC} SELECT word, n FROM c")(lambda spark, d: text.word_counts(words_of(spark, d), "words"))
query("vocabulary", f"WITH {_WC} SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM c WHERE n >= 3")(lambda spark, d: text.vocabulary(text.word_counts(words_of(spark, d), "words"), 3))
query("id_sequences", f"WITH {_WC}, v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS id FROM c WHERE n >= 50), s AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w) SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM s JOIN v USING (word) GROUP BY doc_id")(
    lambda spark, d: text.id_sequences(words_of(spark, d), "doc_id", "words", text.vocabulary(text.word_counts(words_of(spark, d), "words"), 50)).select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))
)
query("alphabet", f"WITH {_WC} SELECT DISTINCT unnest(string_split(word, '')) AS symbol FROM c")(lambda spark, d: text.word_counts(words_of(spark, d), "words").select(F.explode(F.split("word", "")).alias("symbol")).where("symbol <> ''").distinct())
query("pair_counts", f"WITH {_WC}, s AS (SELECT list_concat(string_split(word[1:length(word) - 1], ''), [word[length(word)] || '</w>']) AS s, n FROM c WHERE length(word) > 1), p AS (SELECT unnest(list_transform(range(1, len(s)), lambda i: struct_pack(l := s[i], r := s[i + 1]))) AS p, n FROM s) SELECT p.l AS \"left\", p.r AS \"right\", sum(n) AS n FROM p GROUP BY ALL")(lambda spark, d: text.pair_counts(text.word_counts(words_of(spark, d), "words")))
query("learn_byte_pairs")(lambda spark, d: spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(text.learn(text.word_counts(words_of(spark, d, "benchmark", "item_id"), "words"), 60).merges)], "step int, `left` string, `right` string"))
query("learn_word_pieces")(lambda spark, d: spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(text.learn(text.word_counts(words_of(spark, d, "benchmark", "item_id"), "words"), 40, likelihood=True, mark="", prefix="##").merges)], "step int, `left` string, `right` string"))


@query("encode_byte_pairs")
def _encode(spark: SparkSession, d: str) -> DataFrame:
    rows = words_of(spark, d, "benchmark", "item_id")
    model = text.learn(text.word_counts(rows, "words"), 100)
    return text.encode_words(rows, "item_id", "words", model.pieces).select("item_id", F.size("pieces").alias("n"), F.array_join("pieces", " ").alias("pieces"))


@query("unigram_pieces")
def _unigram(spark: SparkSession, d: str) -> DataFrame:
    rows = words_of(spark, d, "benchmark", "item_id")
    table_ = text.learn_unigram_from(text.word_counts(rows, "words"), 150, 400, 8)
    return text.encode_words(rows, "item_id", "words", lambda w: text.best_segmentation(w, table_) or ["[UNK]"]).select("item_id", F.array_join("pieces", " ").alias("pieces"))


query("utf8_bytes", "SELECT p_partkey, unnest(list_transform(range(1, length(hex(encode(p_name))) // 2 + 1), lambda i: CAST('0x' || substring(hex(encode(p_name)), CAST(2 * i - 1 AS BIGINT), 2) AS INT))) AS byte FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", F.explode(V.utf8_bytes(F.col("p_name"))).alias("byte")))
query("fnv1a", "SELECT p_partkey, list_reduce(list_concat([CAST(2166136261 AS UBIGINT)], list_transform(range(1, length(hex(encode(p_name))) // 2 + 1), lambda i: CAST('0x' || substring(hex(encode(p_name)), CAST(2 * i - 1 AS BIGINT), 2) AS UBIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS hash FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", V.fnv1a(F.col("p_name")).alias("hash")))
query("hashed_characters", "WITH p AS (SELECT p_partkey, unnest(list_transform(string_split(p_brand, ''), lambda c: unicode(c))) AS u FROM part) SELECT p_partkey, ((u + 1) * 31) % 16384 AS h1, ((u + 1) * 43) % 16384 AS h2 FROM p")(lambda spark, d: table(spark, d, "part").select("p_partkey", F.explode(V.hashed_characters(F.col("p_brand"), (31, 43), 16384)).alias("h")).select("p_partkey", F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2")))

# --- embeddings --------------------------------------------------------------------------------------

_B = f"w AS (SELECT item_id, regexp_extract_all(lower(text), '{LETTERS}') AS ws FROM benchmark), tc AS (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest(ws) AS word FROM w) GROUP BY ALL), dn AS (SELECT count(*) AS n_docs FROM benchmark), df AS (SELECT word, count(*) AS df FROM tc GROUP BY word), tw AS (SELECT item_id, word, n * (ln((1 + n_docs) / (1 + df)) + 1) AS weight FROM tc JOIN df USING (word), dn)"


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return words_of(spark, d, "benchmark", "item_id")


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.term_weights(embeddings.term_counts(_bench(spark, d), "item_id", "words"), table(spark, d, "benchmark").agg(F.count("*").alias("n_docs")), "item_id")


query("term_counts", f"WITH {_B} SELECT item_id, word, n FROM tc")(lambda spark, d: embeddings.term_counts(_bench(spark, d), "item_id", "words"))
query("term_weights", f"WITH {_B} SELECT item_id, word, round(weight, 6) AS weight FROM tw")(lambda spark, d: rounded(_weights(spark, d)))
query("unit_bags", f"WITH {_B} SELECT item_id, word, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY item_id)), 6) AS weight FROM tw")(lambda spark, d: rounded(embeddings.unit_length(_weights(spark, d), "item_id").select("item_id", "word", "weight")))
_CO = f"w AS (SELECT item_id, regexp_extract_all(lower(text), '{LETTERS}') AS ws FROM benchmark), s AS (SELECT item_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w), co AS (SELECT p.x AS a, q.x AS b, sum(1.0 / abs(p.i - q.i)) AS n FROM s p JOIN s q ON p.item_id = q.item_id AND p.i <> q.i AND abs(p.i - q.i) <= 3 GROUP BY ALL)"


def _co(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.cooccurrences(_bench(spark, d), 3, True, "words")


query("cooccurrences", f"WITH {_CO} SELECT a, b, round(n, 6) AS n FROM co")(lambda spark, d: rounded(_co(spark, d)))
query("positive_pmi", f"WITH {_CO}, r AS (SELECT a, sum(n) AS rs FROM co GROUP BY a), c AS (SELECT b, pow(sum(n), 0.75) AS cs FROM co GROUP BY b), t AS (SELECT (SELECT sum(n) FROM co) AS al, (SELECT sum(cs) FROM c) AS ca), v AS (SELECT a, b, ln((n / al) / ((rs / al) * (cs / ca))) AS ppmi FROM co JOIN r USING (a) JOIN c USING (b), t) SELECT a, b, round(ppmi, 5) + 0.0 AS ppmi FROM v WHERE ppmi > 1e-9")(lambda spark, d: rounded(embeddings.positive_pmi(_co(spark, d)).where("ppmi > 1e-9"), 5))
query("sampling_weights", f"WITH {_WC} SELECT word, round(pow(n, 0.75) / sum(pow(n, 0.75)) OVER (), 9) AS p FROM c")(lambda spark, d: rounded(embeddings.sampling_weights(text.word_counts(words_of(spark, d), "words")), 9))
query("inverse_frequency_weights", f"WITH {_WC} SELECT word, round(0.001 / (0.001 + n / sum(n) OVER ()), 6) AS weight FROM c")(lambda spark, d: rounded(embeddings.inverse_frequency_weights(text.word_counts(words_of(spark, d), "words"))))
query("latent_semantics")(lambda spark, d: (lambda m: spark.createDataFrame([(k, float(v)) for k, v in enumerate(m)], "k int, singular_value double"))(_lsa(spark, d)))


def _lsa(spark: SparkSession, d: str) -> np.ndarray:
    rows = _weights(spark, d).collect()  # terms of the small benchmark table
    words, docs = sorted({r["word"] for r in rows}), sorted({r["item_id"] for r in rows})
    m, wi, di = np.zeros((len(words), len(docs))), {w: i for i, w in enumerate(words)}, {k: i for i, k in enumerate(docs)}
    for r in rows:
        m[wi[r["word"]], di[r["item_id"]]] = r["weight"]
    return decomposition.truncated_svd(m, 5)[1]


# --- grids: each embedding is an 8 x 8 picture -------------------------------------------------------

_G = "g AS (SELECT vec_id AS picture, i // 8 AS r, i % 8 AS c, v FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.col("vec_id").alias("picture"), F.posexplode("vector").alias("i", "v")).select("picture", F.floor(F.col("i") / 8).alias("r"), (F.col("i") % 8).cast("long").alias("c"), "v")


query("correlate", f"WITH {_G}, k AS (SELECT * FROM (VALUES (-1, -1, -1.0), (-1, 1, 1.0), (0, -1, -2.0), (0, 1, 2.0), (1, -1, -1.0), (1, 1, 1.0)) t(dr, dc, w)) SELECT g.picture, g.r, g.c, round(sum(w * s.v), 6) + 0.0 AS v FROM g, k JOIN g s ON s.picture = g.picture AND s.r = least(greatest(g.r + dr, 0), 7) AND s.c = least(greatest(g.c + dc, 0), 7) GROUP BY ALL")(lambda spark, d: rounded(grids.correlate(_grid(spark, d), grids.KERNELS["sobel"])))
query("integral_image", f"WITH {_G} SELECT g.picture, g.r, g.c, round(sum(s.v), 6) + 0.0 AS s FROM g JOIN g s ON s.picture = g.picture AND s.r <= g.r AND s.c <= g.c GROUP BY ALL")(lambda spark, d: rounded(grids.integral(_grid(spark, d))))
query("rectangle_sum", f"WITH {_G} SELECT picture, round(sum(v), 6) + 0.0 AS total FROM g WHERE r BETWEEN 2 AND 5 AND c BETWEEN 1 AND 6 GROUP BY picture")(lambda spark, d: rounded(grids.rectangle_sums(grids.integral(_grid(spark, d)), 2, 1, 5, 6)))
query("match_template", f"WITH {_G}, t AS (SELECT * FROM (VALUES (0, 0, 0.1), (0, 1, -0.1), (1, 0, -0.1), (1, 1, 0.1)) t(i, j, t)) SELECT g.picture, g.r, g.c, round(sum((s.v - t) * (s.v - t)), 6) AS score FROM g, t JOIN g s ON s.picture = g.picture AND s.r = g.r + i AND s.c = g.c + j WHERE g.r <= 6 AND g.c <= 6 GROUP BY ALL")(lambda spark, d: rounded(grids.match_template(_grid(spark, d), [[0.1, -0.1], [-0.1, 0.1]])))
query("max_pool", f"WITH {_G} SELECT picture, r // 2 AS r, c // 2 AS c, round(max(v), 6) + 0.0 AS v FROM g GROUP BY ALL")(lambda spark, d: rounded(grids.pooled(_grid(spark, d), 2)))
query("average_pool", f"WITH {_G} SELECT picture, r // 2 AS r, c // 2 AS c, round(avg(v), 6) + 0.0 AS v FROM g GROUP BY ALL")(lambda spark, d: rounded(grids.pooled(_grid(spark, d), 2, "avg")))
query("corner_response")(lambda spark, d: grids.corner_response(_grid(spark, d)))
query("similarity_transform", "WITH s AS (SELECT avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, u) + covar_pop(y, v) AS p, covar_pop(x, v) - covar_pop(y, u) AS q, var_pop(x) + var_pop(y) AS w FROM (SELECT l_quantity AS x, l_discount * 100 AS y, l_linenumber AS u, l_tax * 100 AS v FROM lineitem)) SELECT round(sqrt(p * p + q * q) / w, 6) AS scale, round(atan2(q / w, p / w), 6) AS turn, round(mu - (p / w * mx - q / w * my), 6) AS shift_x, round(mv - (q / w * mx + p / w * my), 6) AS shift_y FROM s")(lambda spark, d: rounded(grids.similarity_transform(table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.col("l_linenumber").cast("double").alias("u"), (F.col("l_tax") * 100).alias("v")))))

# --- losses, activations -----------------------------------------------------------------------------

_Z = "z AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 - 2 AS z, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)"


def _z(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10 - 2).alias("z"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


query("losses", f"WITH {_Z} SELECT round(avg((z - y) * (z - y) / 2), 6) AS squared, round(avg(abs(z - y)), 6) AS absolute, round(avg(CASE WHEN abs(z - y) <= 1 THEN (z - y) * (z - y) / 2 ELSE abs(z - y) - 0.5 END), 6) AS huber, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS cross_entropy FROM z")(lambda spark, d: rounded(_z(spark, d).agg(F.avg(V.squared_error(F.col("z"), F.col("y"))).alias("squared"), F.avg(V.absolute_error(F.col("z"), F.col("y"))).alias("absolute"), F.avg(V.huber_error(F.col("z"), F.col("y"))).alias("huber"), F.avg(V.binary_cross_entropy(F.col("z"), F.col("y"))).alias("cross_entropy"))))
query("activations", f"WITH {_Z} SELECT l_orderkey, l_linenumber, round(greatest(z, 0), 6) + 0.0 AS relu, round(1 / (1 + exp(-z)), 6) AS sigmoid, round(tanh(z), 6) + 0.0 AS tanh FROM z")(lambda spark, d: rounded(_z(spark, d).select("l_orderkey", "l_linenumber", *[V.activation(a, F.col("z")).alias(a) for a in ("relu", "sigmoid", "tanh")])))
query("softmax", "WITH z AS (SELECT l_orderkey, l_linenumber, exp(l_quantity / 50) AS a, exp(l_discount * 10) AS b, exp(l_tax * 10) AS c FROM lineitem) SELECT l_orderkey, l_linenumber, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM z")(lambda spark, d: rounded(lines(spark, d).select("l_orderkey", "l_linenumber", V.softmax(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)).alias("p")).select("l_orderkey", "l_linenumber", *[F.col("p")[i].alias(f"p{i}") for i in range(3)])))


# --- bytes, patches, codes, sampling -----------------------------------------------------------------

query("characters", "SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part")(lambda spark, d: table(spark, d, "part").select("p_partkey", F.explode(K.characters(F.col("p_name"))).alias("c")))
query("fixed_patches", "WITH p AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part) SELECT p_partkey, unnest(list_transform(range(0, (length(h) + 7) // 8), lambda i: lower(substring(h, CAST(8 * i + 1 AS BIGINT), 8)))) AS patch FROM p")(lambda spark, d: table(spark, d, "part").select("p_partkey", F.explode(K.patches(F.col("p_name"), 4)).alias("x")).select("p_partkey", F.array_join(F.transform("x", lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))), "").alias("patch")))
query("trigram_buckets", "WITH p AS (SELECT DISTINCT p_brand, list_transform(string_split('_' || p_brand || '_', ''), lambda c: CAST(unicode(c) AS BIGINT)) AS u FROM part) SELECT p_brand, unnest(list_sort(list_distinct(list_transform(range(1, len(u) - 1), lambda i: ((u[i] * 1000003 + u[i + 1]) % 4096 * 1000003 + u[i + 2]) % 4096)))) AS bucket FROM p")(lambda spark, d: table(spark, d, "part").select("p_brand").distinct().select("p_brand", F.explode(K.trigram_buckets(F.col("p_brand"), 4096)).alias("bucket")))
query("scalar_codes", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, CAST(round_even(tanh(v[1]) * 2, 0) + 2 + 5 * (round_even(tanh(v[2]) * 2, 0) + 2) + 25 * (round_even(tanh(v[3]) * 3, 0) + 3) AS BIGINT) AS code FROM e")(lambda spark, d: vectors(spark, d).select("vec_id", K.scalar_codes(F.col("vector"), (5, 5, 7)).alias("code")))
query("nucleus", "WITH c AS (SELECT l_linestatus AS g, l_linenumber AS t, count(*) / 1000.0 AS z FROM lineitem GROUP BY ALL), e AS (SELECT *, exp(z / 2) / sum(exp(z / 2)) OVER (PARTITION BY g) AS p FROM c), k AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY g ORDER BY p DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e) SELECT g, t, round(p / sum(p) OVER (PARTITION BY g), 6) AS p FROM k WHERE b < 0.7")(lambda spark, d: rounded(K.nucleus(table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("g"), F.col("l_linenumber").alias("t")).agg((F.count("*") / 1000.0).alias("z")), "g", "t", "z", 2.0, 0.7)))
query("codebook", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id // 100 AS code, v FROM e WHERE vec_id % 100 = 0 AND vec_id < 500) SELECT e.vec_id, arg_min(c.code, struct_pack(d := list_distance(e.v, c.v), c := c.code)) AS code FROM e, c GROUP BY e.vec_id")(lambda spark, d: _codes(spark, d))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("vec_id", "vector")
    codes = np.array([r["vector"] for r in rows.where("vec_id % 100 = 0 AND vec_id < 500").orderBy("vec_id").collect()])
    return clustering.assign_to(rows, "vector", codes).select("vec_id", F.col("code").cast("long").alias("code"))


# --- learned on bounded tables -----------------------------------------------------------------------


def _bench_vocab(spark: SparkSession, d: str) -> DataFrame:
    return text.vocabulary(text.word_counts(_bench(spark, d), "words"), 2)


@query("skip_gram")
def _skip_gram(spark: SparkSession, d: str) -> DataFrame:
    vocab = _bench_vocab(spark, d)
    rows = vocab.orderBy("id").collect()
    found = word_vectors.skip_gram(text.id_sequences(_bench(spark, d), "item_id", "words", vocab), np.array([r["n"] for r in rows], float), 8, 3, rounds=2)
    return spark.createDataFrame([(r["word"], [float(v) for v in found[r["id"]]]) for r in rows], "word string, vector array<double>")


@query("glove")
def _glove(spark: SparkSession, d: str) -> DataFrame:
    vocab = _bench_vocab(spark, d)
    ids = text.id_sequences(_bench(spark, d), "item_id", "words", vocab)
    n = vocab.count()
    found = word_vectors.glove(embeddings.cooccurrences(ids, 3, True), n, 8, 5)
    return spark.createDataFrame([(r["word"], [float(v) for v in found[r["id"]]]) for r in vocab.collect()], "word string, vector array<double>")


query("random_indexing")(lambda spark, d: embeddings.random_index(_co(spark, d), 16, 4))


def _nations(spark: SparkSession, d: str) -> tuple[np.ndarray, np.ndarray]:
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count("*").alias("n")).orderBy("c_nationkey").collect()
    x = np.array([[r["c_nationkey"] / 25, r["n"] / 100] for r in rows])
    return x, np.array([r["a"] / 1000 for r in rows])


query("kernel_ridge")(lambda spark, d: (lambda x, y: spark.createDataFrame([(i, float(v)) for i, v in enumerate(kernels.kernel_ridge(x, y, "radial", 0.1, gamma=5.0).decision(x))], "n_nationkey int, prediction double"))(*_nations(spark, d)))
query("support_vectors")(lambda spark, d: (lambda x, y: spark.createDataFrame([(i, float(v)) for i, v in enumerate(kernels.support_vectors(x, np.where(y > np.median(y), 1.0, -1.0), "radial", 10.0, gamma=5.0).decision(x))], "n_nationkey int, decision double"))(*_nations(spark, d)))
query("kernel_components")(lambda spark, d: (lambda x, y: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(decomposition.kernel_components(kernels.KERNELS["radial"](x, x, 5.0), 2)[1])], "n_nationkey int, pc1 double, pc2 double"))(*_nations(spark, d)))
query("self_organising_map")(lambda spark, d: (lambda x, y: spark.createDataFrame([(i, j, float(v[0]), float(v[1])) for i, row in enumerate(clustering.self_organising_map(x, 3, 2, 20)) for j, v in enumerate(row)], "row int, col int, x double, y double"))(*_nations(spark, d)))
query("hebbian_components")(lambda spark, d: (lambda x, y: spark.createDataFrame([(i, float(v)) for i, v in enumerate(decomposition.hebbian_components(x, 1, 50)[0])], "feature int, loading double"))(*_nations(spark, d)))
query("dense_stack")(lambda spark, d: layers.predict(lines(spark, d).select("l_orderkey", "l_linenumber", *X2), layers.Stack([layers.Dense.drawn(2, 4, "tanh", 1), layers.Dense.drawn(4, 1, "identity", 2)]), X2).select("l_orderkey", "l_linenumber", F.round(F.col("output")[0], 6).alias("output")))
query("learn_morphs")(lambda spark, d: (lambda c: spark.createDataFrame([(w, "+".join(m)) for w, m in subwords.learn_morphs(c, epochs=1).items()], "word string, morphs string"))({r["word"]: r["n"] for r in table(spark, d, "part").select(F.explode(text.pattern(F.lower("p_type"), LETTERS)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}))
query("picture_corners")(lambda spark, d: _corners(spark, d))


def _corners(spark: SparkSession, d: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [(int(v), int(r), int(c)) for v, x in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True) for r, c in features.peaks(features.corners(np.array(x).reshape(8, 8)), 0.0, 3)]
            yield pa.RecordBatch.from_pydict({"vec_id": [o[0] for o in out], "r": [o[1] for o in out], "c": [o[2] for o in out]}, pa.schema([("vec_id", pa.int64()), ("r", pa.int64()), ("c", pa.int64())]))

    return vectors(spark, d).select("vec_id", "vector").mapInArrow(run, "vec_id long, r long, c long")


for _name, _rule in (("treebank_words", word_rules.treebank), ("translation_words", word_rules.translation)):
    query(_name)(lambda spark, d, rule=_rule: word_rules.split(table(spark, d, "benchmark"), "item_id", "text", rule).select("item_id", F.size("words").alias("n"), F.array_join("words.text", " ").alias("words")))


# --- guards, model selection, language models --------------------------------------------------------


@query("profile", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL OR isnan({c}) OR isinf({c})) AS bad, min({c}) AS low, max({c}) AS high FROM lineitem" for c in LINE))
def _profile(spark: SparkSession, d: str) -> DataFrame:
    found = profile(table(spark, d, "lineitem"), LINE)
    return spark.createDataFrame([(c, x["n"], x["bad"], x["min"], x["max"]) for c, x in found.items()], "name string, n long, bad long, low double, high double")


_LM = "w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark), pd AS (SELECT list_concat(['<s>'], ws, ['</s>']) AS p FROM w), t AS (SELECT unnest(list_transform(range(1, len(p)), lambda i: struct_pack(c := p[i], w := p[i + 1]))) AS g FROM pd), b AS (SELECT g.c AS c, g.w AS w, count(*) AS n FROM t GROUP BY ALL), v AS (SELECT count(DISTINCT w) AS v FROM b), q AS (SELECT c, w, n, ln((n + 1) / (sum(n) OVER (PARTITION BY c) + v)) AS lp FROM b, v)"


@query("language_model_evaluation", f"WITH {_LM} SELECT round(-sum(n * lp) / (sum(n) * ln(2)), 6) AS cross_entropy, round(exp(-sum(n * lp) / sum(n)), 4) AS perplexity, 0.0 AS unknown_share FROM q")
def _lm(spark: SparkSession, d: str) -> DataFrame:
    rows = _bench(spark, d)
    p = sequences.bigram_probabilities(sequences.gram_counts(rows, "words", 2), 1.0)
    tokens = rows.select(F.explode(sequences.grams(sequences.padded(F.col("words"), 2), 2)).alias("g")).select(F.col("g")[0].alias("context"), F.col("g")[1].alias("word"))
    scored = tokens.join(p, ["context", "word"], "left").select(F.log("p").alias("lp"), F.col("p").isNull().alias("unknown"))
    out = evaluation.language_model(scored, "lp", "unknown")
    return out.select(F.round("cross_entropy", 6).alias("cross_entropy"), F.round("perplexity", 4).alias("perplexity"), "unknown_share")


query("overlap_retrieval", f"WITH {_B}, s AS (SELECT item_id, sum(n * CASE word WHEN 'the' THEN 2 WHEN 'of' THEN 1 ELSE 0 END) / (sqrt(sum(n * n)) * sqrt(5)) AS score FROM tc GROUP BY item_id) SELECT item_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, item_id LIMIT 10")(lambda spark, d: rounded(embeddings.overlap_retrieval(_bench(spark, d), "item_id", "words", ["the", "of", "the"], 10)))


def _priced(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") / 1000).alias("x1"), (F.col("o_orderkey") / 1000).alias("x2"), (F.col("o_totalprice") / 1000).alias("y"))
    return written(selection.k_fold(rows, "o_orderkey", 3, 7), "folds")


def _r2(model, df: DataFrame) -> float:
    return float(evaluation.regression(model.predict(df), "y", "prediction").first()["r2"])


query("cross_validation")(lambda spark, d: spark.createDataFrame([(i, s) for i, s in enumerate(selection.cross_validate(_priced(spark, d), 3, lambda r: linear.ordinary(linear.Moments.of(r, X, "y")), _r2))], "fold int, r2 double"))
query("grid_search")(lambda spark, d: spark.createDataFrame([(i, float(c["penalty"]), s) for i, (s, c) in enumerate(selection.grid_search(_priced(spark, d), 3, selection.candidates(penalty=[0.0, 10.0, 1000.0]), linear.ridge, lambda model, test: test.r2(model), lambda r: linear.Moments.of(r, X, "y")))], "place int, penalty double, mean_r2 double"))
query("out_of_bag")(lambda spark, d: (lambda rows: trees.out_of_bag(trees.forest(rows, "key", T, "k", 2, n_classes=2, max_depth=1), rows, "key").groupBy("prediction").agg(F.count("*").alias("n")))(_tree_rows(spark, d)))
query("permutation_importance")(lambda spark, d: (lambda rows, model: spark.createDataFrame(list(trees.permutation_importance(rows, "key", T, lambda r: _r2(model, r)).items()), "feature string, importance double"))(_tree_rows(spark, d), linear.ordinary(linear.Moments.of(_tree_rows(spark, d), T, "y"))))


@query("smooth_inverse_frequency")
def _sif(spark: SparkSession, d: str) -> DataFrame:
    """Documents as weighted means of their words' random-index vectors, less the first direction."""
    rows = _bench(spark, d)
    vectors_ = embeddings.random_index(_co(spark, d), 16, 4).withColumnRenamed("a", "word")
    weights = embeddings.inverse_frequency_weights(text.word_counts(rows, "words"))
    terms = embeddings.term_counts(rows, "item_id", "words").join(weights, "word").withColumn("n", F.col("n") * F.col("weight"))
    return embeddings.without_first_component(embeddings.pooled(terms, vectors_, "item_id", 16), "item_id", 16)
