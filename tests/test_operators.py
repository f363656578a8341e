"""Operators against closed forms and small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.errors import CollinearError, ConstantColumnError, DivergedError, LabelError, NameMismatchError, NonNumericError, StateError, UndefinedMetricError
from corvane.functions import vectors as V
from corvane.operators import clustering, decomposition, embeddings, evaluation, generative, layers, linear, logistic, neighbours, polynomial, selection, sequences, text, trees
from corvane.operators.scaling import Scaler
from corvane.plans import catalog
from corvane.sources import model_store, tables

X1, X2 = [1, 1, 2, 0, 3], [1, 2, 2, 1, 0]


def plane(spark, y):
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(X1, X2, y, strict=True))], "row_id long, x1 double, x2 double, y double")


def test_scalers(spark):
    df = plane(spark, [6, 9, 11, 4, 7])
    s = Scaler.fit(df, ["x1"], "standard")
    assert math.isclose(s.centre["x1"], 1.4) and math.isclose(s.spread["x1"], 1.0198039, rel_tol=1e-6)
    back = s.inverse(s.transform(df)).orderBy("row_id").collect()
    assert np.allclose([r["x1"] for r in back], X1)
    with pytest.raises(ConstantColumnError):
        Scaler.fit(df.withColumn("x1", F.lit(2.0)), ["x1"])
    with pytest.raises(NameMismatchError):
        s.transform(df, ["x2"])


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0), (float("nan"), 1.0, 2)], "a double, b double, c int")
    with pytest.raises(NonNumericError):
        tables.require_numeric(df, ["a"])
    tables.require_binary(df, "b")
    with pytest.raises(LabelError):
        tables.require_classes(df, "c")
    tables.require_positions(df, "c", 3)


def test_polynomial(spark):
    row = polynomial.expand(plane(spark, [0] * 5).where("row_id = 2"), ["x1", "x2"], 2).first().asDict()
    assert row == {"x1": 2, "x2": 2, "x1^2": 4, "x1 * x2": 4, "x2^2": 4}


def test_linear_models(spark):
    exact = linear.ordinary(linear.Moments.of(plane(spark, [6, 9, 11, 4, 7]), ["x1", "x2"], "y"))
    assert np.allclose([exact.intercept, *exact.weights], [1, 2, 3])
    df = plane(spark, [5, 8, 12, 5, 7])
    m = linear.Moments.of(df, ["x1", "x2"], "y")
    fit = linear.ordinary(m)
    assert np.allclose([fit.intercept, *fit.weights], [1, 2, 3])
    scores = evaluation.regression(fit.predict(df), "y", "prediction").first()
    assert math.isclose(scores["rss"], 4) and math.isclose(scores["tss"], 33.2) and math.isclose(scores["r2"], 73 / 83)
    assert np.allclose(linear.lasso(m, 0.0).weights, [2, 3], atol=1e-6)
    assert np.allclose(linear.elastic_net(m, 2.0, 0.0).weights, linear.ridge(m, 2.0).weights, atol=1e-6)
    assert np.allclose(linear.gradient_descent(m, 0.05, 50_000).weights, [2, 3], atol=1e-4)
    with pytest.raises(DivergedError):
        linear.gradient_descent(m, 50.0)
    with pytest.raises(CollinearError):
        linear.ordinary(linear.Moments.of(df.withColumn("x2", F.col("x1") * 2), ["x1", "x2"], "y"))


def test_huber_resists_an_outlier(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1 + 0.01 * (i % 3) + (300 if i == 7 else 0)) for i in range(30)], "x double, y double")
    assert abs(linear.huber(df, ["x"], "y").weights[0] - 2) < 0.02


def test_logistic(spark):
    hours, passed = [0.5, 1, 2, 2.5, 3, 4, 4.5, 5], [0.0, 0, 1, 0, 1, 0, 1, 1]
    df = spark.createDataFrame(list(zip(map(float, hours), map(float, passed), strict=True)), "hours double, passed double")
    m = logistic.newton(df, ["hours"], "passed")
    assert abs(m.intercept + 2.4383) < 1e-3 and abs(m.weights[0] - 0.8637) < 1e-3
    assert abs(m.boundary("hours", {}) - 2.8231) < 1e-3 and abs(m.odds_multiplier("hours") - 2.3719) < 1e-3
    with pytest.raises(DivergedError):
        logistic.newton(df.withColumn("passed", (F.col("hours") > 2.2).cast("double")), ["hours"], "passed")
    soft = logistic.multinomial(df, ["hours"], "passed", 2)
    assert np.allclose(soft.rows[1], [m.intercept, m.weights[0]], atol=1e-5)


def test_generative(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), k) for k in range(3) for a, b in rng.normal([4 * k, -3 * k], 1, (30, 2))]
    df = spark.createDataFrame(rows, "a double, b double, k int")
    for fit in (generative.gaussian_naive_bayes, generative.linear_discriminant, generative.quadratic_discriminant):
        assert fit(df, ["a", "b"], "k").predict(df).where("prediction = k").count() >= 88


def test_evaluation(spark):
    a, p = [0, 0, 0, 1, 1, 1, 1, 2, 2, 2], [0, 0, 1, 1, 1, 0, 2, 2, 2, 2]
    m = evaluation.confusion(spark.createDataFrame(list(zip(a, p, strict=True)), "a int, p int"), "a", "p", 3)
    assert m.count() == 9 and math.isclose(evaluation.averages(m).first()["accuracy"], 0.7)
    none = evaluation.binary(spark.createDataFrame([(0, 0), (1, 0)], "a int, p int"), "a", "p")
    with pytest.raises(UndefinedMetricError):
        evaluation.defined(none, "precision")


def test_folds(spark):
    df = spark.range(103).withColumn("k", (F.col("id") % 3).cast("int"))
    sizes = sorted(r["count"] for r in selection.k_fold(df, "id", 5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    strata = selection.k_fold(df, "id", 5, strata="k").groupBy("fold", "k").count().collect()
    assert {r["count"] for r in strata} <= {6, 7}
    assert selection.hold_out(df, "id", 0.25).where("is_test").count() == 26


def test_grid_search(spark):
    df = spark.createDataFrame([(i, float(i), 3.0 * i + (i % 5)) for i in range(40)], "id long, x double, y double")
    folds = selection.k_fold(df, "id", 4)
    found = selection.grid_search(folds, 4, selection.candidates(penalty=[0.0, 1e6]), lambda d, penalty: linear.ridge(linear.Moments.of(d, ["x"], "y"), penalty), lambda m, d: evaluation.regression(m.predict(d), "y", "prediction").first()["r2"])
    assert found[0][1] == {"penalty": 0.0} and found[0][0] > 0.99


def test_grid_search_tells_near_candidates_apart(spark):
    """The folds' slopes are 1 and -1 under noise a thousand times larger, so each penalty beats the lesser one,
    by 1e-17 of r2, which 1 - rss / tss can't show."""
    noise = [1000.0, -1000.0, -1000.0, 1000.0]
    folds = spark.createDataFrame([(f, float(x), e + x * (1 - 2 * f)) for f in range(2) for x, e in zip((-3, -1, 1, 3), noise, strict=True)], "fold int, x double, y double")
    space = selection.candidates(penalty=[0.0, 1e-11, 2e-11])
    found = selection.grid_search(folds, 2, space, linear.ridge, lambda model, test: test.r2(model), lambda d: linear.Moments.of(d, ["x"], "y"))
    assert [c["penalty"] for _, c in found] == [2e-11, 1e-11, 0.0]
    assert all(math.isclose(s, -60 / (4e6 + 20), rel_tol=1e-9) for s, _ in found)
    model = linear.ridge(linear.Moments.of(folds, ["x"], "y"), 1.0)
    assert math.isclose(linear.Moments.of(folds.where("fold = 0"), ["x"], "y").r2(model), evaluation.regression(model.predict(folds.where("fold = 0")), "y", "prediction").first()["r2"], abs_tol=1e-12)
    with pytest.raises(UndefinedMetricError):
        linear.Moments.of(folds.withColumn("y", F.lit(5.0)), ["x"], "y").r2(model)


def test_grid_search_query_takes_sums_once(spark, monkeypatch):
    taken, of = [], linear.Moments.of.__func__
    monkeypatch.setattr(linear.Moments, "of", classmethod(lambda cls, *a, **b: (taken.append(1), of(cls, *a, **b))[1]))
    catalog.QUERIES["grid_search"](spark, "/root/testdata/sf0.001")
    assert len(taken) == 6  # both sides of three folds, whatever the number of candidates


def test_neighbours(spark):
    grid = [(3 * i + j, [float(i), float(j)], 10.0 * (3 * i + j + 1), [0, 0, 1, 0, 1, 1, 2, 2, 2][3 * i + j]) for i in range(3) for j in range(3)]
    rows = spark.createDataFrame(grid, "row_id int, vector array<double>, value double, label int")
    q = spark.createDataFrame([(0, [0.4, 0.4])], "query_id int, vector array<double>")
    near = neighbours.nearest(q, rows, 3)
    assert {r["row_id"] for r in near.collect()} == {0, 1, 3}
    assert abs(neighbours.regress(near, rows, "value").first()["prediction"] - 70 / 3) < 1e-9
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id int, vector array<double>")
    assert neighbours.classify(neighbours.nearest(q, rows, 5), rows, "label").first()["prediction"] == 0


def test_kernel_values(spark, monkeypatch):
    draw = np.random.default_rng(3)
    held = [(i, [float(v) for v in draw.normal(size=3)]) for i in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, [1 / 128, 0.0, 0.0]), (43, [1.0, 0.0, 0.0]), (44, [1e200, 0.0, 0.0])]
    rows = spark.createDataFrame(held, "row_id long, vector array<double>")
    pairs = rows.where("row_id % 5 = 0 OR row_id > 40").select(F.col("row_id").alias("query_id"), F.col("vector").alias("a")).crossJoin(rows)
    a, b = F.col("a"), F.col("vector")
    want = {(r[0], r[1]): r[2:] for r in pairs.select("query_id", "row_id", V.linear_kernel(a, b), V.polynomial_kernel(a, b), V.radial_kernel(a, b), V.sigmoid_kernel(a, b)).collect()}
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 200)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    queries = rows.where("row_id % 5 = 0 OR row_id > 40")
    got = neighbours.kernel_values(queries, rows, "row_id", "row_id").collect()
    assert len(got) == len(want) == 13 * 45 and {(r[0], r[1]) for r in got} == set(want)
    for r in got:
        assert all(x is y is None or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-300) for x, y in zip(r[2:], want[r[0], r[1]], strict=True))
    near = {(r[0], r[1]): r for r in neighbours.kernel_values(queries, rows, "row_id", "row_id", digits=6).collect()}
    assert near[42, 43]["linear"] == 0.007813 and near[43, 40]["linear"] is None and near[44, 44]["linear"] == math.inf and near[44, 43]["linear"] == 1e200
    wide = spark.range(40_000).select(F.col("id").alias("row_id"), F.array(F.col("id") / 1000, F.lit(1.0)).alias("vector"))
    monkeypatch.undo()
    each = neighbours.kernel_values(wide, wide.where("row_id < 2"), "row_id", "row_id")  # more queries than a tile has pairs
    assert each.count() == 80_000 and each.where("abs(linear - (query_id * row_id / 1e6 + 1)) < 1e-9").count() == 80_000


def test_kernels_query_compares_by_blocks(spark):
    """A nested loop over all pairs, with four sums over arrays for each, doesn't end in time."""
    plan = catalog.QUERIES["kernels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_trees(spark):
    df = spark.createDataFrame([(float(i), 10.0 if i < 4 else 50.0) for i in range(8)], "x double, y double")
    t = trees.grow(df, ["x"], "y", max_depth=1)
    assert t.nodes[0].threshold == 3.5 and math.isclose(t.nodes[0].gain, 400)
    boosted = trees.boosting(df, ["x"], "y", 3, 0.5, 1)
    assert boosted.predict(df).where("abs(prediction - y) < 3").count() == 8
    xor = spark.createDataFrame([(i, float(i % 2), float(i // 2 % 2), i % 2 ^ i // 2 % 2) for i in range(40)], "id long, a double, b double, k int")
    t = trees.grow(xor, ["a", "b"], "k", 2, max_depth=2, min_decrease=-1.0)
    assert t.predict(xor).where("prediction = k").count() == 40
    f = trees.forest(xor, "id", ["a", "b"], "k", 3, n_classes=2, max_depth=2, min_decrease=-1.0)
    assert f.predict(xor).where("prediction = k").count() == 40
    assert trees.out_of_bag(f, xor, "id").count() == 40


def test_clustering(spark):
    blobs = [(i, float(x + dx), float(y + dy)) for i, (x, y, dx, dy) in enumerate((x, y, dx, dy) for x, y in ((1, 1), (11, 1), (6, 11)) for dx, dy in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5)))]
    df = spark.createDataFrame(blobs, "id long, a double, b double")
    m = clustering.k_means(df, ["a", "b"], "id", 3, starts=3)
    assert math.isclose(m.inertia, 3.0, rel_tol=1e-9)
    assert sorted(map(tuple, np.round(m.centres, 6))) == [(1, 1), (6, 11), (11, 1)]
    g = clustering.gaussian_mixture(df, ["a", "b"], m, rounds=20)
    assert g.predict(df).groupBy("cluster").count().where("count = 4").count() == 3
    points = np.array([[a, b] for _, a, b in blobs])
    for linkage in ("single", "complete", "average", "ward"):
        labels, heights = clustering.agglomerate(points, 3, linkage)
        assert labels.tolist() == [0] * 4 + [1] * 4 + [2] * 4 and len(heights) == 9


def test_dbscan(spark):
    df = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate([0.0, 0.9, 1.8, 2.7, 20.0, 40.0, 40.5, 41.0])], "id long, x double, y double")
    got = {r["id"]: r["label"] for r in clustering.dbscan(df, ["x", "y"], "id", 1.0, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1, 5: 1, 6: 1, 7: 1}


def test_components(spark):
    df = spark.createDataFrame([(12.0, 102.0), (8.0, 98.0), (11.0, 99.0), (9.0, 101.0), (10.0, 100.0)], "a double, b double")
    p = decomposition.principal_components(df, ["a", "b"])
    assert np.allclose(p.variances, [4, 1]) and np.allclose(np.abs(p.loadings), 0.70711, atol=1e-5) and np.allclose(p.shares(), [0.8, 0.2])
    back = p.inverse(p.transform(df).drop("a", "b")).select("a", "b").collect()
    assert np.allclose([list(r) for r in back], [[12, 102], [8, 98], [11, 99], [9, 101], [10, 100]])
    pattern = np.array([1.0, -1, 1, -1, 1, -1])
    w = decomposition.hopfield_weights(spark.createDataFrame([tuple(map(float, pattern))], [f"u{i}" for i in range(6)]), [f"u{i}" for i in range(6)])
    noisy = pattern.copy()
    noisy[0] = -1
    assert (decomposition.hopfield_recall(w, noisy) == pattern).all()


def test_markov(spark):
    states = ["sunny"] * 10 + ["rainy", "rainy", "sunny"]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(states)], "seq int, pos int, state string")
    counts = sequences.transitions(df, "seq", "pos", "state")
    assert {(r["s"], r["t"]): r["n"] for r in counts.collect()} == {("sunny", "sunny"): 9, ("sunny", "rainy"): 1, ("rainy", "rainy"): 1, ("rainy", "sunny"): 1}
    chain = sequences.MarkovChain.of(sequences.transition_table(counts))
    assert math.isclose(chain.stationary()["sunny"], 5 / 6, rel_tol=1e-9)
    islands = sequences.MarkovChain(["e", "n", "s", "w"], np.array([[0, 0, 0, 1], [0, 0, 1, 0], [0, 1, 0, 0], [1, 0, 0, 0]], float))
    with pytest.raises(StateError):
        islands.stationary()


def test_merges():
    m = text.learn_merges({"low": 5, "lower": 2, "newest": 6, "widest": 3}, 10)
    assert m.merges == [["e", "s"], ["es", "t</w>"], ["l", "o"], ["e", "w"], ["ew", "est</w>"], ["n", "ewest</w>"], ["lo", "w</w>"], ["d", "est</w>"], ["i", "dest</w>"], ["w", "idest</w>"]]
    assert m.pieces("newest") == ["newest</w>"] and m.pieces("lowest") == ["lo", "w", "est</w>"]
    assert text.greedy_pieces("unable", {"un", "##able", "##a"}) == ["un", "##able"]
    assert text.greedy_pieces("xyz", {"un"}) == ["[UNK]"]


def test_unigram_and_segmentation():
    t = text.learn_unigram({"hug": 10, "pug": 5, "pun": 12, "bun": 4, "hugs": 5}, 15, 50, 4)
    assert "".join(text.best_segmentation("hugs", t)) == "hugs"
    assert text.maximum_matching("abcd", {"ab", "abc", "cd"}) == ["abc", "d"]
    assert text.maximum_matching("abcd", {"ab", "abc", "bcd"}, backward=True) == ["a", "bcd"]
    assert text.lattice("abcd", {"ab": 5, "cd": 5, "abc": 1}) == ["ab", "cd"]
    starts, steps, emit = {"B": 3, "S": 1}, {("B", "E"): 3, ("E", "S"): 2}, {("B", "a"): 3, ("E", "b"): 3, ("S", "c"): 3}
    assert text.viterbi("abc", starts, steps, emit) == ["ab", "c"]


def test_unigram_learns_from_all_words(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))): draw.randint(2, 9) for _ in range(400)} | {"qux": 1}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    found, want = text.learn_unigram_from(counts, 60, 120, 8), text.learn_unigram(words, 60, 120, 8)
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-6 for s in want)
    assert text.best_segmentation("qux", found)


def test_unigram_query_has_no_unknown_words(spark, tmp_path):
    letters = "abcdefghijklmnopqrst"
    common = " ".join(x + y for x in letters for y in letters)
    spark.createDataFrame([(1, f"{common} {common}"), (2, "wuz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["item_id"]: r["pieces"] for r in catalog.QUERIES["unigram_pieces"](spark, str(tmp_path)).collect()}
    assert found[2].replace(" ", "") == "wuz"


def test_embeddings(spark):
    df = spark.createDataFrame([(0, "the cat sat".split()), (1, "the dog sat".split()), (2, "a cat".split())], "doc_id int, words array<string>")
    terms = embeddings.term_counts(df, "doc_id", "words")
    w = {r["word"]: r["weight"] for r in embeddings.term_weights(terms, df.agg(F.count("*").alias("n_docs")), "doc_id").where("doc_id = 1").collect()}
    assert math.isclose(w["the"], math.log(4 / 3) + 1) and math.isclose(w["dog"], math.log(2) + 1)
    vocab = [r["word"] for r in text.vocabulary(text.word_counts(df, "words")).orderBy("id").collect()]
    assert vocab == ["cat", "sat", "the", "a", "dog"]
    co = {(r["a"], r["b"]): r["n"] for r in embeddings.cooccurrences(df, 1, False, "words").collect()}
    assert co[("the", "cat")] == 1 and co[("cat", "sat")] == 1 and ("the", "sat") not in co
    assert len(set(embeddings.huffman_codes([5, 2, 1, 1]))) == 4


def test_expressions(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>").select(V.dot(F.col("a"), F.col("b")).alias("d"), V.polynomial_kernel(F.col("a"), F.col("b"), 2, 1.0, 0.0).alias("k"), V.fnv1a(F.lit("a")).alias("h"), V.utf8_bytes(F.lit("é")).alias("u")).first()
    assert row["d"] == 11 and row["k"] == 121 and row["h"] == 0xE40C292C and row["u"] == [0xC3, 0xA9]


def test_layers_gradients():
    rng = np.random.default_rng(1)
    net = layers.Stack([layers.Dense.drawn(3, 4, "tanh", 1), layers.Normalised(np.ones(4), np.zeros(4)), layers.Residual(layers.Dense.drawn(4, 4, "sigmoid", 2)), layers.RadialBasis(rng.normal(size=(3, 4)))])
    x, y = rng.normal(size=(5, 3)), rng.normal(size=(5, 3))
    out, kept = net.forward(x)
    g, _ = net.backward(kept, layers.squared_error(out, y)[1])
    num = np.zeros_like(x)
    for i in np.ndindex(*x.shape):
        d = np.zeros_like(x)
        d[i] = 1e-6
        num[i] = (layers.squared_error(net.forward(x + d)[0], y)[0] - layers.squared_error(net.forward(x - d)[0], y)[0]) / 2e-6
    assert np.allclose(g, num, atol=1e-6)
    assert layers.positions(4, 6).shape == (4, 6)


def test_model_store(spark, tmp_path):
    m = logistic.LogisticModel(["a"], 1.0, [2.0])
    model_store.save(spark, m, f"file://{tmp_path}/m")
    assert model_store.load(spark, f"file://{tmp_path}/m") == m
    s = layers.Stack([layers.Dense.drawn(2, 2)])
    assert np.allclose(model_store.loads(model_store.dumps(s)).forward(np.eye(2))[0], s.forward(np.eye(2))[0])


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
