"""Polynomial terms as projections."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_name(powers: dict[str, int]) -> str:
    return " * ".join(c if k == 1 else f"{c}^{k}" for c, k in powers.items())


def term(powers: dict[str, int]) -> Column:
    """The product of the columns' powers."""
    factors = [F.col(c).cast("double") for c, k in powers.items() for _ in range(k)]
    return reduce(lambda a, b: a * b, factors)


def terms(columns: Sequence[str], degree: int = 2, interactions: bool = True) -> list[dict[str, int]]:
    """All monomials of degree 1 to ``degree``; without interactions only pure powers."""
    if interactions:
        return [dict(Counter(c)) for d in range(1, degree + 1) for c in combinations_with_replacement(columns, d)]
    return [{c: d} for d in range(1, degree + 1) for c in columns]


def expand(df: DataFrame, columns: Sequence[str], degree: int = 2, interactions: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[term(p).alias(term_name(p)) for p in terms(columns, degree, interactions)])
