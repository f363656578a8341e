"""Learning rates by epoch: numbers for loops on the driver, columns for tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.errors import InvalidParameter
from corvane.sources.model_store import persistable


def _checked(name: str, value: float, least: float = 0.0) -> None:
    if not value > least:
        raise InvalidParameter(f"{name}: {value} is not over {least}")


@persistable
@dataclass
class ConstantSchedule:
    rate: float

    def __post_init__(self) -> None:
        _checked("rate", self.rate)

    def column(self, epoch: Column) -> Column:
        return F.lit(float(self.rate)) + epoch * 0

    def at(self, epoch: int) -> float:
        return self.rate


@persistable
@dataclass
class LinearDecaySchedule:
    """From ``first`` to ``last`` in ``epochs`` equal steps, and ``last`` from then on."""

    first: float
    last: float
    epochs: int

    def __post_init__(self) -> None:
        _checked("first", self.first)
        _checked("epochs", self.epochs)

    def column(self, epoch: Column) -> Column:
        left = F.greatest(1 - epoch / float(self.epochs), F.lit(0.0))
        return F.lit(float(self.last)) + (self.first - self.last) * left

    def at(self, epoch: int) -> float:
        return self.last + (self.first - self.last) * max(1 - epoch / self.epochs, 0.0)


@persistable
@dataclass
class ExponentialDecaySchedule:
    """``first`` times ``factor`` to the power of the epoch."""

    first: float
    factor: float

    def __post_init__(self) -> None:
        _checked("first", self.first)
        _checked("factor", self.factor)

    def column(self, epoch: Column) -> Column:
        return F.lit(float(self.first)) * F.pow(F.lit(float(self.factor)), epoch.cast("double"))

    def at(self, epoch: int) -> float:
        return self.first * self.factor**epoch
