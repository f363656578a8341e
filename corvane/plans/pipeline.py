"""Chains of fitted steps in front of a model: steps are fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from corvane.errors import NameMismatchError

#: Fits on rows and returns the change to apply to any rows.
Step = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


@dataclass
class Pipeline:
    """``steps``: (name, step) in order, names unique; ``model`` fits on the changed rows and has ``predict``."""

    steps: Sequence[tuple[str, Step]]
    model: Callable[[DataFrame], Any]
    fitted: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    fitted_model: Any = None

    def __post_init__(self) -> None:
        names = [n for n, _ in self.steps]
        if len(set(names)) != len(names):
            raise NameMismatchError("names of steps must be unique")

    def replacing(self, name: str, step: Step) -> Pipeline:
        return Pipeline([(n, step if n == name else s) for n, s in self.steps], self.model)

    def fit(self, df: DataFrame) -> Pipeline:
        out = Pipeline(self.steps, self.model)
        for _, step in self.steps:
            change = step(df)
            out.fitted.append(change)
            df = change(df)
        out.fitted_model = self.model(df)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        for change in self.fitted:
            df = change(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        return self.fitted_model.predict(self.transform(df))
