"""Named record producers, row hooks and reports: small protocols over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame

from casemill.operators.filters import TableSpec, get_rows

Producer = Callable[[DataFrame], DataFrame]
PRODUCERS: dict[str, Producer] = {}


def producer(name: str) -> Callable[[Producer], Producer]:
    """P-1: registers a function from target files to records under a name that must be free."""

    def add(function: Producer) -> Producer:
        if name in PRODUCERS:
            raise ValueError(f"producer {name} is there already")
        PRODUCERS[name] = function
        return function

    return add


def produced(files: DataFrame, names: list[str]) -> DataFrame:
    """P-1: the records of several producers over the same files."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [PRODUCERS[n](files) for n in names])


def hooked(df: DataFrame, hooks: dict[str, Column]) -> DataFrame:
    """P-2: columns set before rows are written, or after they are read."""
    return df.transform(lambda d: d.withColumns(hooks)) if hooks else df


@dataclass(frozen=True)
class Report:
    """P-3: a query over a table with the filters of its spec; rendering is left to the caller."""

    spec: TableSpec
    query: Producer = field(default=lambda df: df)

    def run(self, df: DataFrame, filters=(), order=(), limit: int | None = None) -> DataFrame:
        return get_rows(self.query(get_rows(df, self.spec, filters)), self.spec, (), order, limit)
