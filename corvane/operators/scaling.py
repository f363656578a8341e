"""Affine scalers: one aggregation finds each column's centre and spread, a projection applies them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.errors import ConstantColumnError, NameMismatchError
from corvane.sources.model_store import persistable
from corvane.sources.tables import require_numeric


def _centre_spread(kind: str, c: str) -> tuple[Column, Column]:
    x = F.col(c).cast("double")
    if kind == "min_max":
        return F.min(x), F.max(x) - F.min(x)
    if kind == "max_abs":
        return F.lit(0.0), F.max(F.abs(x))
    if kind == "robust":
        return F.percentile(x, 0.5), F.percentile(x, 0.75) - F.percentile(x, 0.25)
    if kind == "root_mean_square":
        return F.lit(0.0), F.sqrt(F.avg(x * x))
    if kind == "mean":
        return F.avg(x), F.lit(1.0)
    if kind == "standard":
        return F.avg(x), F.stddev_pop(x)
    raise NameMismatchError(f"no scaler {kind}")


@persistable
@dataclass
class Scaler:
    """Fitted centres and spreads by column."""

    kind: str
    centre: dict[str, float]
    spread: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], kind: str = "standard", check: bool = True) -> Scaler:
        """kind: min_max, max_abs, robust, root_mean_square, mean or standard (population deviation)."""
        if check:
            require_numeric(df, columns)
        row = df.agg(*[x.alias(f"{c}__{i}") for c in columns for i, x in enumerate(_centre_spread(kind, c))]).first()
        out = cls(kind, {c: row[f"{c}__0"] for c in columns}, {c: row[f"{c}__1"] for c in columns})
        flat = [c for c in columns if not out.spread[c]]
        if flat:
            raise ConstantColumnError(f"no spread in {flat}")
        return out

    def _known(self, columns: Sequence[str] | None) -> Sequence[str]:
        columns = list(self.centre) if columns is None else columns
        if not set(columns) <= set(self.centre):
            raise NameMismatchError(f"{sorted(set(columns) - set(self.centre))} weren't fitted")
        return columns

    def transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """The columns (all, or some of the fitted ones) scaled; others stay."""
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(self.centre[c])) / F.lit(self.spread[c]) for c in self._known(columns)})

    def inverse(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.spread[c]) + F.lit(self.centre[c]) for c in self._known(columns)})
