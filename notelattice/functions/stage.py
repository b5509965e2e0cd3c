"""Row-wise steps that are evaluated once."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose values are computed once per row.

    Catalyst moves a filter below the projection it refers to by copying the projected expressions into the
    filter. For the deep expressions of parsing that multiplies the work, and the plan. A filter is never
    moved below a generator, so the values pass through a one-element array.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(values)))


def built_once(build: Callable[[], dict[str, Column]]) -> Callable[[], dict[str, Column]]:
    """Keep the columns a function builds for as long as the application lives.

    Columns are immutable trees that need no DataFrame; building the large ones anew for every query takes
    thousands of calls into the JVM.
    """
    kept: dict[str, dict[str, Column]] = {}

    @wraps(build)
    def columns() -> dict[str, Column]:
        application = SparkContext.getOrCreate().applicationId
        if application not in kept:
            kept.clear()
            kept[application] = build()
        return kept[application]

    return columns
