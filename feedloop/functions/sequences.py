"""Sequences of codes: one after another, or as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Sequence(Iterator):
    """start, start + step, ... , each shown by `show`; can begin anew, also elsewhere."""

    def __init__(self, start: float = 0, step: float = 1, show: Callable = lambda x: x) -> None:
        self.start = self.at = start
        self.step, self.show = step, show

    def __next__(self):
        found = self.show(self.at)
        self.at += self.step
        return found

    def reset(self, start: float | None = None) -> None:
        self.at = self.start if start is None else start


#: Kinds of sequences, by the type of what they give.
KINDS: dict[str, Callable[[], Sequence]] = {
    "int": Sequence, "bigint": Sequence, "float": lambda: Sequence(0.0, 1.0), "double": lambda: Sequence(0.0, 1.0), "string": lambda: Sequence(show=str),
}


def table(spark: SparkSession, n: int, start: float = 0, step: float = 1, kind: str = "bigint") -> DataFrame:
    """``(place, value)``: the first n values of a sequence, made in parallel."""
    value = F.lit(start) + F.col("id") * F.lit(step)
    return spark.range(n).select(F.col("id").alias("place"), value.cast(kind).alias("value"))
