"""Reading tables, and frames of named numeric columns with a row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.errors import CorvaneError, EmptyInputError, LabelError, NameMismatchError, NonNumericError


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frame(df: DataFrame, features: Sequence[str], row_id: Sequence[str] = (), target: str | None = None) -> DataFrame:
    """The named columns as doubles, beside the row's key and its target."""
    names = [*features, *([target] if target else [])]
    if len(set(names)) != len(names):
        raise NameMismatchError("names of columns must be unique")
    return df.select(*row_id, *[F.col(c).cast("double").alias(c) for c in names])


def matching(df: DataFrame, fitted: Sequence[str], given: Sequence[str]) -> DataFrame:
    """The given columns in the order of the fitted ones; other names are refused."""
    if set(fitted) != set(given) or len(given) != len(fitted):
        raise NameMismatchError(f"fitted on {sorted(fitted)}, given {sorted(given)}")
    return df.select(*fitted)


def profile(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """One pass over the table: what the guards below need to know of each column."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        bad = F.col(c).isNull() | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        aggs += [F.count("*").alias(f"{c}__n"), F.count_if(bad).alias(f"{c}__bad"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"), F.count_if(~x.isin(0.0, 1.0)).alias(f"{c}__other"), F.count_if(x != F.floor(x)).alias(f"{c}__part")]
    row = df.agg(*aggs).first().asDict()
    return {c: {k: row[f"{c}__{k}"] for k in ("n", "bad", "min", "max", "other", "part")} for c in columns}


def require_numeric(df: DataFrame, columns: Sequence[str], least_rows: int = 1) -> dict[str, dict]:
    """Refuses too few rows and values that aren't finite; returns the columns' profile."""
    found = profile(df, columns)
    for c, x in found.items():
        if x["n"] < least_rows:
            raise EmptyInputError(f"{c}: {x['n']} rows, {least_rows} needed")
        if x["bad"]:
            raise NonNumericError(f"{c}: {x['bad']} values aren't finite numbers")
    return found


def require_binary(df: DataFrame, column: str, both: bool = True) -> None:
    """Only 0 and 1, and both of them."""
    x = require_numeric(df, [column])[column]
    if x["other"] or both and x["min"] == x["max"]:
        raise LabelError(f"{column} must hold 0 and 1")


def require_classes(df: DataFrame, column: str) -> int:
    """Labels are exactly 0 to K-1, K at least 2; returns K."""
    x = require_numeric(df, [column])[column]
    k = df.select(F.count_distinct(F.col(column).cast("double"))).first()[0]
    if x["part"] or x["min"] != 0 or x["max"] != k - 1 or k < 2:
        raise LabelError(f"{column} must hold the labels 0 to K-1 without gaps")
    return int(k)


def require_positions(df: DataFrame, column: str, n_classes: int) -> None:
    """Whole numbers from 0 to K-1; classes may be absent."""
    x = require_numeric(df, [column])[column]
    if x["part"] or x["min"] < 0 or x["max"] >= n_classes:
        raise LabelError(f"{column} must hold whole numbers from 0 to {n_classes - 1}")


def corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a text that isn't blank; none at all is refused."""
    out = df.where(F.col(text).isNotNull() & (F.trim(text) != ""))
    if out.isEmpty():
        raise EmptyInputError("a corpus needs a text")
    return out


__all__ = ["CorvaneError", "corpus", "frame", "matching", "profile", "require_binary", "require_classes", "require_numeric", "require_positions", "table"]
