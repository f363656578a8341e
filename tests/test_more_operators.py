"""Learners on bounded tables, descriptors and layers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import tokens as K
from corvane.operators import features, grids, kernels, layers, subwords, text, word_vectors


def test_subwords():
    m = subwords.learn_byte_merges({" the": 5, " then": 3}, 3)
    assert m.pieces(subwords.as_byte_symbols(" the")) == ["Ġthe"]
    _, outer = subwords.learn_cross_word_merges([["new", "york"]] * 4 + [["old", "york"]], 20, 12)
    assert outer
    c = subwords.learn_constrained_merges({"undo": 5, "unfit": 4}, lambda w: [w[:2], w[2:]], 5)
    assert ["u", "n</w>"] in c.merges
    assert "abab" in subwords.greedy_coverage({"abab": 5, "abc": 3}, 5)
    assert subwords.description_length({"ab": 4}) < subwords.description_length({"ab": 2, "cd": 2})
    assert subwords.learn_morphs({"walks": 9, "walked": 9, "talks": 9, "talked": 9, "walk": 9, "talk": 9})["walks"] != []
    p = subwords.EntropyPatches.fit(["abababab"] * 20, 5.0, 1, 0.01)
    assert b"".join(p.patches("ababx")) == b"ababx" and len(p.patches("abab")) < 4
    assert subwords.paths("cats", {"root": {"cat": ["end", "#"]}, "end": {"s": ["#"]}}, "root") == [["cat", "s"]]
    w = subwords.averaged_perceptron([["ab", "c"], ["c", "ab"], ["ab", "ab"]] * 5, 2, 5)
    assert subwords.cut_by("abc", w, 2) == ["ab", "c"]


def test_kernels():
    draw = np.random.default_rng(0)
    angle = draw.random(60) * 2 * np.pi
    x = np.stack([np.cos(angle), np.sin(angle)], 1) * np.where(np.arange(60) % 2, 1, 4)[:, None]
    y = np.where(np.arange(60) % 2, 1.0, -1.0)
    assert (np.sign(kernels.support_vectors(x, y, "radial", 10.0).decision(x)) == y).all()
    assert np.abs(kernels.kernel_ridge(x, x[:, 0] ** 2, "polynomial", 1e-3, degree=2).decision(x) - x[:, 0] ** 2).max() < 0.05
    v = np.array([[1, 1, 0, 0], [0, 0, 1, 1]] * 20, float)
    assert np.abs(kernels.boltzmann(v, 4, 0.3, 1, 400).reconstruct(v) - v).mean() < 0.2


def test_pictures(spark):
    p = np.zeros((12, 12))
    p[4:8, 4:8] = 1.0
    top = features.peaks(features.corners(p), 0.0, 2, 4)
    assert all(min(abs(r - a) + abs(c - b) for a in (4, 7) for b in (4, 7)) <= 2 for r, c in top)
    assert features.oriented_histograms(p, 4, 2, 9).shape == (4, 36) and len(features.pyramid(p)) == 3
    assert features.binary_descriptor(p, (6, 6)).shape == (128,) and features.gradient_descriptor(p, (6, 6)).shape == (128,)
    a = np.random.default_rng(1).random((20, 2)) * 10
    turn = np.array([[0, -2.0], [2, 0]])
    b = a @ turn.T + [1, 2]
    b[:4] += 50
    (scale, angle, shift), inside = features.aligned(a, b, 0.1)
    assert abs(scale - 2) < 1e-9 and abs(angle - np.pi / 2) < 1e-9 and np.allclose(shift, [1, 2]) and inside.sum() == 16
    assert features.matched(a, a[::-1]) == [(i, 19 - i) for i in range(20)]
    pictures = np.random.default_rng(2).random((40, 8, 8))
    labels = np.arange(40) % 2
    pictures[labels == 1, :4] += 1
    assert (features.passes(features.cascade(pictures, labels, 2, 2, 40), pictures) == (labels == 1)).all()
    grid = spark.createDataFrame([(0, r, c, float(p[r, c])) for r in range(12) for c in range(12)], "picture int, r long, c long, v double")
    got = {(x["r"], x["c"]): x["gx"] for x in grids.gradients(grid).collect()}
    gx, _ = features.gradient(p)
    assert np.allclose([[got[r, c] for c in range(12)] for r in range(12)], gx)


def test_layers():
    draw = np.random.default_rng(0)
    net = layers.Stack([layers.Conv2d(draw.normal(size=(2, 1, 3, 3)), np.zeros(2), 1, 1), layers.Upsample2d(2), layers.Pool2d(2), layers.Pool2d(2, True), layers.Flatten(), layers.Dense.drawn(8, 3)])
    x, y = draw.normal(size=(2, 1, 4, 4)), draw.normal(size=(2, 3))
    out, kept = net.forward(x)
    g, _ = net.backward(kept, layers.squared_error(out, y)[1])
    num = np.zeros_like(x)
    for i in np.ndindex(*x.shape):
        d = np.zeros_like(x)
        d[i] = 1e-6
        num[i] = (layers.squared_error(net.forward(x + d)[0], y)[0] - layers.squared_error(net.forward(x - d)[0], y)[0]) / 2e-6
    assert np.allclose(g, num, atol=1e-6)
    b = layers.BatchNormalised(np.ones(3), np.zeros(3), np.zeros(3), np.ones(3), True)
    assert np.allclose(b.forward(draw.normal(size=(50, 3)) * 5 + 2)[0].std(0), 1, atol=1e-3)
    xs = draw.normal(size=(60, 2))
    ys = (xs[:, 0] > 0).astype(int)
    fit = layers.Stack([layers.Dense.drawn(2, 8, "tanh"), layers.Dense.drawn(8, 2)]).trained(xs, ys, layers.softmax_cross_entropy, 0.5, 200)
    assert (fit.forward(xs)[0].argmax(1) == ys).mean() > 0.95
    eye = np.eye(4)
    a = layers.attention(draw.normal(size=(3, 4)), eye, eye, eye, eye, 2, True)
    assert a.shape == (3, 4)
    for kind, gates in (("simple", 1), ("lstm", 4), ("gru", 3)):
        assert layers.recurrent(draw.normal(size=(5, 2)), draw.normal(size=(3 * gates, 5)), np.zeros(3 * gates), kind).shape == (5, 3)
    assert layers.policy_gradient(lambda k: float(k == 2), 3).argmax() == 2
    low = layers.LowRank(np.eye(2), np.ones((1, 2)), np.zeros((2, 1)))
    assert np.allclose(low.forward(xs)[0], xs)
    e = layers.Embedding(np.eye(3))
    assert np.allclose(e.backward(np.array([1, 1]), np.ones((2, 3)))[1]["table"][1], 2)


def test_word_vectors(spark):
    draw = np.random.default_rng(0)
    rows = [(i, [int(w) for w in draw.integers(0, 5, 8) + (5 if i % 2 else 0)]) for i in range(80)]
    v = word_vectors.skip_gram(spark.createDataFrame(rows, "id int, ids array<int>"), np.full(10, 64.0), 8, 3, rounds=6, rate=0.1)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    same = (u @ u.T)[:5, :5][~np.eye(5, dtype=bool)].mean()
    assert same > (u @ u.T)[:5, 5:].mean() + 0.2
    assert word_vectors.gram_rows("a") and all(0 <= b < 2000 for b in word_vectors.gram_rows("word"))


def test_token_expressions(spark):
    row = spark.range(1).select(K.patches(F.lit("abcde"), 2).alias("p"), K.patches(F.lit(""), 2).alias("e"), K.bucket_overlap(K.trigram_buckets(F.lit("walk"), 4096), K.trigram_buckets(F.lit("walks"), 4096)).alias("o"), K.scalar_codes(F.array(F.lit(0.0), F.lit(9.0)), (3, 5)).alias("s"), K.recovered(K.diffused(F.lit(2.0), F.lit(0.5), F.lit(0.9)), F.lit(0.5), F.lit(0.9)).alias("d")).first()
    assert row["p"] == [[97, 98], [99, 100], [101]] and row["e"] == [] and row["o"] == 3 and row["s"] == 1 + 4 * 3 and abs(row["d"] - 2) < 1e-12


def test_unicode_words():
    assert text.unicode_words("Don't stop 3.14, please!") == ["Don't", "stop", "3.14", "please"]
    assert text.spans("a  bc") == [("a", 0, 1), ("bc", 3, 5)]


def test_pipeline_fits_on_training_rows(spark):
    from corvane.operators import linear
    from corvane.operators.scaling import Scaler
    from corvane.plans.pipeline import Pipeline

    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)], "x double, y double")
    p = Pipeline([("scale", lambda d: Scaler.fit(d, ["x"]).transform)], lambda d: linear.ordinary(linear.Moments.of(d, ["x"], "y"))).fit(df.where("x < 10"))
    assert p.predict(df).where("abs(prediction - y) < 1e-6").count() == 20


def test_streaming_counts(spark, tmp_path):
    from corvane import streaming

    spark.createDataFrame([("a b a",), ("b",)], "text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in").select(F.split("text", " ").alias("w"))
    q = streaming.word_counts(stream, "w").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["word"]: r["n"] for r in spark.table("counts").collect()} == {"a": 2, "b": 2}


def test_word_rules(spark):
    from corvane.operators import word_rules

    words = lambda s: [w for w, _, _ in s]
    text = "They'll cannot (maybe) don't pay $3,000.50, Mr. Smith's."
    got = word_rules.treebank(text, True)
    assert words(got) == ["They", "'ll", "can", "not", "-LRB-", "maybe", "-RRB-", "do", "n't", "pay", "$", "3,000.50", ",", "Mr.", "Smith", "'s", "."]
    assert all(text[a:b] == w or w.startswith("-") for w, a, b in got)
    assert words(word_rules.translation("Mr. Smith's well-known shop, e.g. A&B.", split_hyphens=True, escape=True)) == ["Mr.", "Smith", "&apos;s", "well", "-", "known", "shop", ",", "e.g.", "A", "&amp;", "B", "."]
    assert words(word_rules.translation("l'eau froide.", "fr")) == ["l'", "eau", "froide", "."]
    assert words(word_rules.with_exceptions('"don\'t stop!" a-b', ['"'], ['"', "!"], ["-"], {"don't": ["do", "n't"]})) == ['"', "do", "n't", "stop", "!", '"', "a", "-", "b"]
    out = word_rules.split(spark.createDataFrame([(1, "a b."), (2, None)], "id int, text string"), "id", "text", word_rules.treebank).collect()
    assert {r["id"]: [w["text"] for w in r["words"]] for r in out} == {1: ["a", "b", "."], 2: []}


def test_merges_learned_in_spark(spark, monkeypatch):
    """The words left in Spark give the merges that the driver finds, ties included."""
    from corvane.operators import text

    words = {"low": 5, "lower": 2, "newest": 6, "widest": 3, "aaaa": 4, "aa": 1, "banana": 2, "a": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for options in ({}, {"likelihood": True, "mark": "", "prefix": "##"}):
        here = text.learn_merges(words, 12, **options)
        there = text.learn(df, 12, most_words=3, **options)
        assert there.merges == here.merges and there.alphabet == here.alphabet
    assert text.learn(df, 12).merges == text.learn_merges(words, 12).merges


def test_discounted_returns_of_long_episodes(spark):
    from corvane.errors import InvalidParameter
    from corvane.operators import sequences

    n, rewards = 3000, [((i * 37) % 11) / 7 for i in range(3000)]
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(rewards)], "e long, i long, r double")
    for gamma in (0.0, 0.5, 0.97, 0.9999, 1.0):
        want, after = [0.0] * n, 0.0
        for i in reversed(range(n)):
            want[i] = after = rewards[i] + gamma * after
        out = {r["i"]: r["discounted"] for r in sequences.discounted_returns(df, "e", "i", "r", gamma).collect()}
        assert all(abs(out[i] - want[i]) <= 1e-9 * max(1, want[i]) for i in range(n))
    with pytest.raises(InvalidParameter):
        sequences.discounted_returns(df, "e", "i", "r", 1.5)


def test_neighbours_in_blocks(spark, monkeypatch):
    """Several blocks of queries give what one gives; ties go to the lesser row id."""
    from corvane.operators import neighbours

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "row_id long, vector array<double>")
    queries = rows.where("row_id < 20").withColumnRenamed("row_id", "query_id")
    whole = {m: sorted(map(tuple, neighbours.nearest(queries, rows, 4, m).collect())) for m in neighbours.MEASURES if m != "inner"}
    near = sorted(map(tuple, neighbours.within(queries, rows, 1.0).collect()))
    for q in range(20):
        d = sorted((abs(q % 7 - i % 7) + abs(q % 3 - i % 3), i) for i in range(60))[:4]
        assert [(r[1], r[2]) for r in sorted((r for r in whole["manhattan"] if r[0] == q), key=lambda r: r[3])] == [(i, float(x)) for x, i in d]
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 200)
    assert {m: sorted(map(tuple, neighbours.nearest(queries, rows, 4, m).collect())) for m in whole} == whole
    assert sorted(map(tuple, neighbours.within(queries, rows, 1.0).collect())) == near
    assert neighbours.nearest(queries.limit(0), rows, 4).count() == 0 and neighbours.nearest(queries, rows.limit(0), 4).count() == 0


def test_schedules_and_scores(spark):
    from corvane.errors import InvalidParameter
    from corvane.operators import schedules

    down, decay = schedules.LinearDecaySchedule(1.0, 0.2, 4), schedules.ExponentialDecaySchedule(0.5, 0.9)
    rows = spark.range(8).select("id", down.column(F.col("id")).alias("l"), decay.column(F.col("id")).alias("e")).collect()
    assert all(abs(r["l"] - down.at(r["id"])) < 1e-12 and abs(r["e"] - decay.at(r["id"])) < 1e-12 for r in rows) and down.at(9) == 0.2
    with pytest.raises(InvalidParameter):
        schedules.ConstantSchedule(0.0)


def test_language_models_of_higher_order(spark):
    from corvane.operators import sequences

    df = spark.createDataFrame([(1, ["the", "cat", "sat"]), (2, ["the", "cat", "ran"]), (3, ["the", "cat", "sat"])], "id long, words array<string>")
    counts = sequences.gram_counts(df, "words", 3)
    found = {tuple(r["gram"]): r["n"] for r in counts.collect()}
    assert found[("<s>", "the")] == 3 and found[("the", "cat", "sat")] == 2 and found[("</s>",)] == 3 and ("<s>",) not in found and found[("<s>", "<s>", "the")] == 3
    model = sequences.conditional(counts, 3)
    assert sequences.generate(model, 3) == ["the", "cat", "sat"] and sequences.generate(model, 3, start=["the", "cat"]) == ["the", "cat", "sat"]
    scores = {r["id"]: (r["n"], round(r["log_probability"], 9)) for r in sequences.text_scores(df, "id", "words", model, 3).collect()}
    assert scores[1] == (4, round(math.log(2 / 3), 9)) and scores[2] == (4, round(math.log(1 / 3), 9))
    unseen = spark.createDataFrame([(9, ["a"])], df.schema)
    assert sequences.text_scores(unseen, "id", "words", model, 3).first()["log_probability"] == float("-inf")


def test_bootstrap_draws_exactly_n(spark):
    from corvane.operators import selection

    out = selection.bootstrap(spark.range(500), "id", 3).collect()
    assert len(out) == 500 and sum(r["times"] for r in out) == 500 and 150 < sum(r["times"] == 0 for r in out) < 220


def test_segmenters_and_shortest_paths():
    words = {"ab", "abc", "cd", "d", "bcd"}
    assert text.maximum_matching("abcd", words) == ["abc", "d"] and text.maximum_matching("abcd", words, True) == ["a", "bcd"]
    assert text.bidirectional_matching("abcd", words) == ["a", "bcd"] and text.bidirectional_matching("abcd", {"abc", "cd"}) == ["abc", "d"]
    assert [text.character_type(c) for c in "aЖ7 カひ漢.+"] == ["roman", "letter", "digit", "space", "katakana", "hiragana", "kanji", "punctuation", "other"]
    assert text.token_count("abcd", {"a", "b", "c", "d", "ab", "bcd"}) == 2 and text.token_count("x", {"a"}) is None and text.token_count("", {"a"}) == 0
    counts = {"abab": 3, "abc": 2}
    pieces = {"a", "b", "c", "ab", "abab"}
    assert text.corpus_token_count(counts, pieces) == 3 + 4
    assert text.token_count_increases(counts, pieces) == {"ab": 2, "abab": 3}
    learned = text.learn_shortest_path_pieces(counts, 4)
    assert {"a", "b", "c"} < learned and len(learned) == 4 and learned & {"ab", "abab"}
    assert text.unmarked(["▁ne", "w", "▁york"]) == "new york"


def test_prediction_gradients():
    """Against differences of the loss."""
    draw = np.random.default_rng(0)
    document, contexts, outputs, labels = draw.normal(size=4), draw.normal(size=(3, 4)), draw.normal(size=(5, 4)), np.array([1.0, 0, 0, 0, 0])

    def loss(d, o):
        p = 1 / (1 + np.exp(-(o @ ((d + contexts.sum(0)) / 4))))
        return -np.log(np.where(labels > 0, p, 1 - p)).sum()

    inner, outer, found = word_vectors.distributed_memory_gradients(document, contexts, outputs, labels)
    assert abs(found - loss(document, outputs)) < 1e-9
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert abs((loss(document + e, outputs) - loss(document - e, outputs)) / 2e-6 - inner[i] / 4) < 1e-6
    change = np.zeros((5, 4))
    change[2, 1] = 1e-6
    assert abs((loss(document, outputs + change) - loss(document, outputs - change)) / 2e-6 - outer[2, 1]) < 1e-6
    assert np.allclose(word_vectors.shared_input_step(inner, 0.1, 4), -0.1 * inner / 4)
    h, _, value = word_vectors.hierarchical_softmax_gradients(document, outputs[:2], "01")
    p = 1 / (1 + np.exp(-outputs[:2] @ document))
    assert abs(value + np.log(p[0]) + np.log(1 - p[1])) < 1e-9 and np.allclose(h, (p - [1, 0]) @ outputs[:2])


def test_contextual_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [int(x) for x in draw.integers(0, 6, 14) + 6 * (i % 2)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, ids array<long>").coalesce(2)
    counts = np.full(12, 100.0)
    words, none = word_vectors.contextual(df, "id", counts, "cbow", 8, 3, rounds=8, rate=0.3)
    unit = words / np.linalg.norm(words, axis=1)[:, None]
    near = unit @ unit.T
    assert near[:6, :6].mean() > near[:6, 6:].mean() + 0.3 and none.where("vector is not null").count() == 0
    for architecture in ("distributed_memory", "distributed_bag_of_words"):
        _, documents = word_vectors.contextual(df, "id", counts, architecture, 8, 3, rounds=8, rate=0.3)
        found = {r["id"]: np.array(r["vector"]) for r in documents.collect()}
        assert len(found) == 80
        x = np.array([found[i] / np.linalg.norm(found[i]) for i in range(80)])
        near = x @ x.T
        assert near[::2, ::2].mean() > near[::2, 1::2].mean() + 0.2, architecture
    grams = word_vectors.gram_vectors(["walk", "walks", "talk"], np.array([[1.0, 0], [0.9, 0.1], [0, 1.0]]))
    assert word_vectors.unseen_vector("walked", grams)[0] > word_vectors.unseen_vector("tall", grams)[0]


def test_generators(spark):
    from corvane.operators import generative

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "a double, b double")
    out = generative.LinearAutoencoder(["a", "b"], np.array([[0.2, 0.4]]), np.array([[1.0], [2.0]])).transform(df).collect()
    assert [round(r["codes"][0], 9) for r in out] == [1.0, 3.0] and all(abs(r["error"]) < 1e-12 for r in out)
    draw, g = np.random.default_rng(0), generative.AdversarialGaussian()
    for _ in range(1500):
        g.step(draw.normal(2.0, 1.0, 256), draw.normal(0, 1, 256), 0.05)
    assert abs(g.mean - 2.0) < 1.0


def test_vocabulary_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(f"w{i % 97}x{i}", i % 5 + 1) for i in range(400)], "word string, n long")
    whole = {r["word"]: r["id"] for r in text.vocabulary(df, 2).collect()}
    monkeypatch.setattr(text, "NUMBERED", 50)
    assert {r["word"]: r["id"] for r in text.vocabulary(df, 2).collect()} == whole and sorted(whole.values()) == list(range(len(whole)))


def test_treebank_quotes():
    from corvane.operators import word_rules

    words = [w for w, _, _ in word_rules.treebank('He said "no ("never")". “Oui” he\'d')]
    assert words == ["He", "said", "``", "no", "(", "``", "never", "''", ")", "''", ".", "``", "Oui", "''", "he", "'d"]
    assert [w for w, _, _ in word_rules.treebank('"a"', quotes=False)] == ['"', "a", '"']
