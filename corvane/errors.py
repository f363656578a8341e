"""Typed refusals: every operator says what was wrong with its input instead of returning a number."""

from __future__ import annotations


class CorvaneError(ValueError):
    """Base of all refusals."""


class EmptyInputError(CorvaneError):
    """No rows where at least one is needed."""


class NonNumericError(CorvaneError):
    """A column that isn't numeric, or holds null, NaN or infinite values."""


class ConstantColumnError(CorvaneError):
    """All values of a column are the same, so it has no spread."""


class LabelError(CorvaneError):
    """Labels that aren't what the operator needs."""


class NameMismatchError(CorvaneError):
    """Columns other than those that were fitted."""


class CollinearError(CorvaneError):
    """The normal equations are singular."""


class DivergedError(CorvaneError):
    """An iteration left the finite numbers or didn't settle."""


class UndefinedMetricError(CorvaneError):
    """A metric whose denominator is zero."""


class StateError(CorvaneError):
    """A Markov state or distribution that isn't defined."""


class InvalidParameter(CorvaneError):
    """A parameter, or a column's type, that the operator has no meaning for."""
