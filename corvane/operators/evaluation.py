"""Evaluation metrics: one aggregation each, as one-row or one-row-a-class DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.errors import UndefinedMetricError


def share(part: Column, whole: Column) -> Column:
    """Null where the denominator is zero; ``defined`` turns that into a refusal."""
    return F.when(whole == 0, None).otherwise(part / whole)


def defined(metrics: DataFrame, name: str) -> float:
    value = metrics.first()[name]
    if value is None:
        raise UndefinedMetricError(f"{name} has a zero denominator")
    return float(value)


def regression(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """rss, mse, tss, r2."""
    r, y = F.col(actual) - F.col(predicted), F.col(actual)
    sums = df.agg(F.sum(r * r).alias("rss"), F.avg(r * r).alias("mse"), (F.var_pop(y) * F.count(y)).alias("tss"))
    return sums.withColumn("r2", 1 - share(F.col("rss"), F.col("tss")))


def binary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """The confusion counts, accuracy, precision, recall, f1 and specificity."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"))
    out = counts.withColumn("accuracy", share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    out = out.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("specificity", share(F.col("tn"), F.col("tn") + F.col("fp")))


def confusion(df: DataFrame, actual: str, predicted: str, n_classes: int) -> DataFrame:
    """(actual, predicted, n): all K x K cells, zeros too."""
    spark = df.sparkSession
    k = spark.range(n_classes)
    cells = k.select(F.col("id").alias("actual"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_classes - 1).cast("long"))).alias("predicted"))
    counts = df.groupBy(F.col(actual).cast("long").alias("actual"), F.col(predicted).cast("long").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def per_class(matrix: DataFrame) -> DataFrame:
    """(class, precision, recall, f1) from a confusion table."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit")
    rows = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("actual_n"), hit)
    cols = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted_n"))
    out = rows.join(cols, "class").withColumn("precision", share(F.col("hit"), F.col("predicted_n"))).withColumn("recall", share(F.col("hit"), F.col("actual_n")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1")


def averages(matrix: DataFrame) -> DataFrame:
    """accuracy (which micro precision and recall equal), and macro precision, recall and f1."""
    micro = matrix.agg((F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    macro = per_class(matrix).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return micro.join(F.broadcast(macro)).withColumn("micro_precision", F.col("accuracy")).withColumn("micro_recall", F.col("accuracy"))


def language_model(df: DataFrame, log_probability: str, unknown: str) -> DataFrame:
    """cross_entropy (bits), perplexity and unknown_share, of one row for each predicted word."""
    return df.agg((-F.sum(log_probability) / (F.count("*") * F.log(F.lit(2.0)))).alias("cross_entropy"), F.exp(-F.sum(log_probability) / F.count("*")).alias("perplexity"), F.avg(F.col(unknown).cast("double")).alias("unknown_share"))
