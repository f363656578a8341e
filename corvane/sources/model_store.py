"""Fitted models as JSON documents: closed registry, checked on reading, through Spark's file systems."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

import numpy as np
from pyspark.sql import SparkSession

from corvane.errors import CorvaneError

FORMAT = 1
_REGISTRY: dict[str, type] = {}


def persistable(kind: type) -> type:
    """Class decorator: a dataclass that may be stored."""
    _REGISTRY[kind.__name__] = kind
    return kind


def _plain(x: Any, depth: int = 0) -> Any:
    if depth > 200:
        raise CorvaneError("a model nests deeper than 200 levels")
    if dataclasses.is_dataclass(x):
        if type(x).__name__ not in _REGISTRY:
            raise CorvaneError(f"{type(x).__name__} can't be stored")
        return {"#model": type(x).__name__, **{f.name: _plain(getattr(x, f.name), depth + 1) for f in dataclasses.fields(x)}}
    if isinstance(x, np.ndarray):
        return {"#array": x.tolist(), "#dtype": str(x.dtype)}
    if isinstance(x, (list, tuple)):
        return [_plain(y, depth + 1) for y in x]
    if isinstance(x, dict):
        return {"#items": [[_plain(k, depth + 1), _plain(v, depth + 1)] for k, v in x.items()]}
    if isinstance(x, np.generic):
        return x.item()
    if x is None or isinstance(x, (str, int, float, bool)):
        return x
    raise CorvaneError(f"a value of type {type(x).__name__} can't be stored")


def _back(x: Any) -> Any:
    if isinstance(x, list):
        return [_back(y) for y in x]
    if not isinstance(x, dict):
        return x
    if "#array" in x:
        if x["#dtype"] not in ("float64", "int64", "int32", "bool"):
            raise CorvaneError(f"dtype {x['#dtype']}")
        return np.array(x["#array"], dtype=x["#dtype"])
    if "#items" in x:
        return {_hashable(_back(k)): _back(v) for k, v in x["#items"]}
    if x.get("#model") not in _REGISTRY:
        raise CorvaneError(f"unknown model {x.get('#model')}")
    return _REGISTRY[x["#model"]](**{k: _back(v) for k, v in x.items() if k != "#model"})


def _hashable(x: Any) -> Any:
    return tuple(x) if isinstance(x, list) else x


def dumps(model: Any) -> str:
    return json.dumps({"format": FORMAT, "model": _plain(model)})


def loads(document: str) -> Any:
    found = json.loads(document)
    if found.get("format") != FORMAT:
        raise CorvaneError(f"format {found.get('format')}")
    return _back(found["model"])


def save(spark: SparkSession, model: Any, path: str) -> None:
    spark.createDataFrame([(dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Any:
    return loads(spark.read.text(path, wholetext=True).first()[0])
