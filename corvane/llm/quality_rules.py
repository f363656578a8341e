"""Quality rules: base rules on counts, and robust outliers by minimum covariance determinant.

Each text's counts become a vector of transformed statistics (``FEATURES``). For each language and
source, a minimum-covariance-determinant estimate is made: the share ``subset`` of the documents nearest
to the current estimate give the next mean and covariance (concentration steps), which lowers the
determinant, until in no group it falls by ``settled`` of its logarithm any more. There are two starts, both
from the medians: one with the floors as units, one with the spread between quartiles. Each group keeps
the estimate with the least determinant of all starts and steps; the covariance is then scaled to the
median distance of a normal distribution. A document whose squared Mahalanobis distance exceeds
``most`` is rejected. Every diagonal entry has a floor, since in many groups most texts share a
value (no symbols, no repeats). Groups under ``least_group`` documents are pooled by language, and
small languages into one group.

All of it is DataFrame expressions: a group is four medians and fourteen sums, pre-aggregated before
any shuffle, so a source with a third of all rows is no heavier than others.

Defined cases: a null text is empty (0 words: fails the base rule); null languages and sources are
groups of their own; repeated rows count each; extra columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, few, once, words

#: Feature and the least standard deviation that it is given.
FEATURES = (("word_length", 0.2), ("symbols", 0.06), ("dup_lines", 0.15), ("repeats", 0.2))
#: The median of the chi-squared distribution with four degrees of freedom, and its 99.9 % quantile
#: (fixed values).
CHI2_MEDIAN, CHI2_FAR = 3.3567, 18.4668


def repeated_words(tokens: Column, window: int = 5) -> Column:
    """Words in windows of that many words found twice or more in the text, the first included.

    Windows are compared by 64-bit hashes, sorted with their places, so the cost is n log n.
    """
    return once(tokens, lambda t: _repeated(t, window))


def _repeated(tokens: Column, window: int) -> Column:
    n = F.size(tokens)
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(window)]))

    def covered(placed: Column) -> Column:
        same = lambda e, j, d: F.coalesce(F.get(placed, j + d)["h"] == e["h"], F.lit(False))
        found = F.sort_array(F.transform(F.filter(placed, lambda e, j: same(e, j, -1) | same(e, j, 1)), lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(found, start, lambda acc, i: F.struct((i + window).alias("end"), (acc["n"] + F.least(F.lit(window), i + window - acc["end"])).alias("n")), lambda acc: acc["n"])

    def counted(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(once(placed, covered))

    return F.when(n < window + 1, F.lit(0)).otherwise(once(hashes, counted))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, lang, source, n_chars, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), whole.alias("text"), words(whole).alias("tokens"), F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    return base.select(
        "key", "lang", "source",
        F.length("text").cast("long").alias("n_chars"),
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("tokens")).cast("long").alias("n_repeat_words"),
    )


def features() -> list[Column]:
    """Of the columns of ``statistics``; shares of small texts are drawn to what is common."""
    return [
        F.log((F.col("word_chars") + 300) / (F.col("n_words") + 50)).alias("word_length"),
        F.sqrt(F.col("n_symbols") / (F.col("n_chars") + 200)).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)).alias("dup_lines"),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 20)).alias("repeats"),
    ]


NAMES = tuple(name for name, _ in FEATURES)


def _grouped(rows: DataFrame, least_group: int) -> DataFrame:
    """With the column ``grp``: language and source, or language, or one for all that is left."""
    by_source = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = by_source.withColumn("small", F.col("n") < least_group)
    by_lang = small.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("small"), F.col("n"))), F.lit(0)).alias("rest"))
    s, b = small.alias("s"), by_lang.alias("b")
    named = s.join(b, F.col("s.lang").eqNullSafe(F.col("b.lang"))).select(
        F.col("s.lang").alias("g_lang"), F.col("s.source").alias("g_source"),
        F.when(~F.col("s.small"), F.concat_ws("\u0001", F.coalesce(F.concat(F.lit("="), "s.lang"), F.lit("null")), F.coalesce(F.concat(F.lit("="), "s.source"), F.lit("null")))).when(F.col("b.rest") >= least_group, F.coalesce(F.concat(F.lit("="), "s.lang"), F.lit("null"))).otherwise(F.lit("")).alias("grp"),
    )
    return rows.join(named, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))).drop("g_lang", "g_source")


def _whitening(moments: DataFrame) -> DataFrame:
    """(grp, m_*, w_i_j): means and the inverse of the covariance's Cholesky factor, column by column."""
    p, out = len(NAMES), moments
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"c_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}"))
    for j in range(p):
        for i in range(j, p):
            if i == j:
                value = 1 / F.col(f"l_{i}_{i}")
            else:
                value = -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l_{i}_{i}")
            out = out.withColumn(f"w_{i}_{j}", value)
    return out.select("grp", *[f"m_{i}" for i in range(p)], *[f"w_{i}_{j}" for i in range(p) for j in range(i + 1)])


def _distance() -> Column:
    p = len(NAMES)
    centred = [F.col(NAMES[i]) - F.col(f"m_{i}") for i in range(p)]
    parts = [sum((F.col(f"w_{i}_{j}") * centred[j] for j in range(i + 1)), F.lit(0.0)) for i in range(p)]
    return sum((x * x for x in parts), F.lit(0.0))


def _estimate(inside: DataFrame) -> DataFrame:
    """(grp, m_*, c_*): mean and covariance by group; the second moments are taken about ``z_*``."""
    p = len(NAMES)
    x = [F.col(name) - F.col(f"z_{i}") for i, name in enumerate(NAMES)]
    sums = inside.groupBy("grp").agg(*[F.avg(x[i]).alias(f"a_{i}") for i in range(p)], *[F.first(f"z_{i}").alias(f"z_{i}") for i in range(p)], *[F.avg(x[i] * x[j]).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)])
    floor = [least * least for _, least in FEATURES]
    cov = [(F.col(f"s_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}") + (F.lit(floor[i]) if i == j else F.lit(0.0))).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)]
    return sums.select("grp", *[(F.col(f"a_{i}") + F.col(f"z_{i}")).alias(f"m_{i}") for i in range(p)], *cov)


def _least_determinant(models: DataFrame) -> DataFrame:
    """Of the models of a group, the one with the least determinant."""
    rest = [c for c in models.columns if c not in ("grp", "logdet")]
    return models.groupBy("grp").agg(F.min(F.struct("logdet", *rest)).alias("x")).select("grp", "x.*")


def estimated(rows: DataFrame, scratch: Scratch, subset: float, settled: float = 1e-3, most_steps: int = 100) -> DataFrame:
    """(grp, m_*, w_*, logdet) of the rows (grp, NAMES): the estimate of each group. The model, in logdet, has
    the logarithm of the covariance's determinant."""
    p = len(NAMES)
    quartiles = rows.groupBy("grp").agg(*[F.percentile_approx(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q_{i}") for i, name in enumerate(NAMES)])
    middle = few(scratch.table(quartiles.select("grp", *[F.col(f"q_{i}")[1].alias(f"z_{i}") for i in range(p)], *[F.greatest(F.lit(least), (F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349).alias(f"u_{i}") for i, (_, least) in enumerate(FEATURES)]), "medians"))
    both = rows.select("grp", *NAMES).join(middle, "grp").withColumn("start", F.explode(F.array(F.lit("0"), F.lit("1"))))
    unit = [F.when(F.col("start") == "0", F.lit(least)).otherwise(F.col(f"u_{i}")) for i, (_, least) in enumerate(FEATURES)]
    distance = sum((((F.col(name) - F.col(f"z_{i}")) / unit[i]) ** 2 for i, name in enumerate(NAMES)), F.lit(0.0))
    # a start is a group of its own: the number before the group's name
    small = both.withColumn("d", distance).withColumn("grp", F.concat("start", "grp")).drop("start", *[f"u_{i}" for i in range(p)])
    near, best = small, None
    for step in range(most_steps):
        limits = few(scratch.table(near.groupBy("grp").agg(F.percentile_approx("d", subset, 1000).alias("limit")), f"limits_{step}"))
        model = _whitening(_estimate(near.join(limits, "grp").where("d <= limit")))
        model = scratch.table(model.withColumn("logdet", -2 * sum((F.log(f"w_{i}_{i}") for i in range(p)), F.lit(0.0))), f"model_{step}")
        if best is not None:
            fallen = best.select("grp", F.col("logdet").alias("before")).join(model, "grp").agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
            if fallen is None or fallen < settled:
                break
        best = scratch.table(_least_determinant(model if best is None else best.unionByName(model)), f"best_{step}")
        near = small.drop("d").join(few(model), "grp").withColumn("d", _distance()).select(*small.columns)
    else:
        raise RuntimeError("the determinants don't settle")
    return _least_determinant(best.withColumn("grp", F.expr("substring(grp, 2)")))


def judge(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", subset: float = 0.75, most: float = CHI2_FAR, least_group: int = 200) -> DataFrame:
    """The columns of ``statistics`` with distance (double), outlier, base_failed and kept."""
    rows = scratch.table(_grouped(scratch.table(statistics(docs, key, text, lang, source).select("*", *features()), "statistics"), least_group), "grouped")
    model = few(scratch.table(estimated(rows, scratch, subset), "model"))
    medians = rows.select("grp", *NAMES).join(model, "grp").withColumn("d", _distance()).groupBy("grp").agg(F.percentile_approx("d", 0.5, 1000).alias("median"))
    scale = few(scratch.table(medians.withColumn("scale", F.greatest(F.col("median") / CHI2_MEDIAN, F.lit(1.0))).select("grp", "scale"), "scales"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.join(model, "grp").join(scale, "grp").withColumn("distance", _distance() / F.col("scale")).withColumn("outlier", F.col("distance") > most).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
    return out.select(F.col("key").alias(key), "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "distance", "outlier", "base_failed", "kept")
