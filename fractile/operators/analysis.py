"""Relational steps of result analysis: joins of runs, grouped means, ratios, row orders, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_runs(runs: DataFrame, baselines: DataFrame, keys: Sequence[str], parts: tuple[str, str], total: str) -> DataFrame:
    """Runs with their baseline of the same keys, and the sum of a measure of each as total. Rows without a partner are left out."""
    return runs.join(baselines, list(keys)).withColumn(total, F.col(parts[0]) + F.col(parts[1]))


def with_construction(runtimes: DataFrame, construction: DataFrame, key: str, other: str) -> DataFrame:
    """Runtimes beside the construction figures of the same thing, whose key is named otherwise."""
    return runtimes.join(construction, runtimes[key] == construction[other]).drop(other)


def group_means(rows: DataFrame, keys: Sequence[str], *measures: str) -> DataFrame:
    """The mean of each measure by any number of keys, null keys being groups too."""
    return rows.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def mean_ratio(rows: DataFrame, keys: Sequence[str], over: str, under: str, name: str = "ratio") -> DataFrame:
    """The means of two measures by key and how many times the second the first is; null where the second is 0."""
    means = group_means(rows, keys, over, under)
    return means.withColumn(name, F.when(F.col(under) != 0, F.col(over) / F.col(under)))


def in_order(rows: DataFrame, column: str, order: Sequence[object]) -> DataFrame:
    """rows with position, from 1: where a column's value comes in a given order. Rows whose value isn't in it are left out."""
    position = F.array_position(F.lit(list(order)), F.col(column))
    return rows.withColumn("position", position).where(F.col("position") > 0)


def nested_sum(column: str) -> Column:
    """The sum over an array column, in order."""
    return F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, or all: those whose keys have the smallest seeded digests. The same in every run; for reports, so n is small."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return rows.orderBy(draw, key).limit(n)
