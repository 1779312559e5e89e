"""Operators by name: parameters with their defaults and a function of a session that returns a DataFrame."""

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., DataFrame]
    parameters: dict[str, Any]
    help: str = ""


OPERATORS: dict[str, Operator] = {}


def register(name: str, /, **parameters: Any):
    """Registers a function (spark, **parameters); a parameter whose default is ... must be given."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in OPERATORS:
            raise ValueError(f"{name} is registered already")
        OPERATORS[name] = Operator(name, f, parameters, (f.__doc__ or "").strip())
        return f

    return add


def run(name: str, spark: SparkSession, **given: Any) -> DataFrame:
    op = OPERATORS[name]
    unknown = sorted(set(given) - set(op.parameters))
    missing = sorted(k for k, v in op.parameters.items() if v is ... and k not in given)
    if unknown or missing:
        raise ValueError(f"{name}: unknown parameters {unknown}, missing parameters {missing}")
    return op.run(spark, **{**op.parameters, **given})
