"""Percentile queries: validation, generation and benchmark strata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fractile.functions.histogram import round4

OPERATORS = ("lt", "le", "gt", "ge")
SCHEMA = "query_id long, percentile double, op string, reference double"


@dataclass(frozen=True)
class PercentileQuery:
    """At least a share `percentile` of the values is `op` (lt, le, gt, ge) the reference."""

    percentile: float
    op: str
    reference: float

    def __post_init__(self) -> None:
        if not 0 < self.percentile <= 1:
            raise ValueError(f"percentile must be over 0 and at most 1: {self.percentile}")
        if self.op not in OPERATORS:
            raise ValueError(f"unknown comparison: {self.op}")


def parse(args: Sequence[str]) -> PercentileQuery:
    if len(args) != 3:
        raise ValueError("a query is a percentile, a comparison and a reference")
    return PercentileQuery(float(args[0]), args[1], float(args[2]))


def to_frame(spark: SparkSession, queries: Iterable[PercentileQuery]) -> DataFrame:
    return spark.createDataFrame([(k, float(q.percentile), q.op, float(q.reference)) for k, q in enumerate(queries)], SCHEMA)


#: Steps between 0 and 1 that a seeded draw can fall on: thirteen hexadecimal digits of a digest.
DRAWS = 16**13


def generated(spark: SparkSession, n_percentiles: int, operators: Sequence[str] = ("gt", "lt"), n_references: int = 100, bounds: tuple[float, float] = (-1000.0, 1000.0), seed: int = 42) -> DataFrame:
    """Queries of all combinations of percentiles in equal steps up to 1, operators, and references drawn evenly within bounds by a digest of seed and number; both to four decimals. query_id counts references first, then operators, then percentiles."""
    low, high = bounds
    percentiles = spark.range(1, n_percentiles + 1).select((F.col("id") - 1).alias("i"), round4(F.col("id") / n_percentiles).alias("percentile"))
    signs = spark.createDataFrame(list(enumerate(operators)), "j long, op string")
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / DRAWS
    references = spark.range(n_references).select(F.col("id").alias("k"), round4(F.lit(float(low)) + share * F.lit(float(high) - float(low))).alias("reference"))
    rows = percentiles.crossJoin(F.broadcast(signs)).crossJoin(F.broadcast(references))  # a few hundred rows each
    return rows.select(((F.col("i") * len(operators) + F.col("j")) * n_references + F.col("k")).alias("query_id"), "percentile", "op", "reference")


def generate(n_percentiles: int, operators: Sequence[str] = ("gt", "lt"), n_references: int = 100, bounds: tuple[float, float] = (-1000.0, 1000.0), seed: int = 42) -> list[PercentileQuery]:
    """The same as a list, without a session."""
    four = lambda x: round(x * 1e4) / 1e4
    draw = lambda k: int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:13], 16) / DRAWS
    marks = [four(bounds[0] + draw(k) * (bounds[1] - bounds[0])) for k in range(n_references)]
    out = []
    for number in range(n_percentiles * len(operators) * n_references):
        step, k = divmod(number, n_references)
        i, j = divmod(step, len(operators))
        out.append(PercentileQuery(four((i + 1) / n_percentiles), operators[j], marks[k]))
    return out


def parsed(rows: DataFrame, column: str = "said") -> DataFrame:
    """rows with percentile, op, reference and valid, read from texts of three words; what isn't a query has nulls and is not valid."""
    words = F.split(F.trim(column), r"\s+")
    p, op, ref = F.get(words, F.lit(0)).try_cast("double"), F.get(words, F.lit(1)), F.get(words, F.lit(2)).try_cast("double")
    valid = F.coalesce((F.size(words) == 3) & (p > 0) & (p <= 1) & op.isin(*OPERATORS) & ref.isNotNull(), F.lit(False))
    return rows.withColumns({"percentile": F.when(valid, p), "op": F.when(valid, op), "reference": F.when(valid, ref), "valid": valid})


def strata(selectivities: DataFrame, n_validation: int, n_test: int, seed: int = 42) -> DataFrame:
    """(query_id, stratum, part) with n_validation and n_test seeded queries of each of low (< 0.1), mid and high (> 0.9) selectivity, in their original order; a stratum needs more than both together."""
    s = F.col("selectivity")
    named = F.when(s < 0.1, "low").when((s > 0.1) & (s < 0.9), "mid").when(s > 0.9, "high")
    rows = selectivities.withColumn("stratum", named).where("stratum IS NOT NULL")
    few = [r["stratum"] for r in rows.groupBy("stratum").count().where(F.col("count") <= n_validation + n_test).collect()]
    if few:
        raise ValueError(f"too few queries in {', '.join(sorted(few))}")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("query_id").cast("string")))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(draw, "query_id"))).where(F.col("rank") <= n_validation + n_test)
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("query_id"))
    return rows.withColumn("part", F.when(place <= n_validation, "validation").otherwise("test")).select("query_id", "stratum", "part")
