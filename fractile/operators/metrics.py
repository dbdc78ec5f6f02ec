"""Quality of results and of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fractile.plans.store import checkpointed, small

KEYS = ["query_id", "hist_id"]


def _marked(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, hist_id, m) of all results: m is 1 if only a has it, 2 if only b, 3 if both."""
    return a.select(*KEYS, F.lit(1).alias("m")).unionByName(b.select(*KEYS, F.lit(2).alias("m"))).groupBy(*KEYS).agg(F.bit_or("m").alias("m"))


def accuracy(queries: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1) of every query: both empty gives 1, 1, 1; an empty truth 0, 1, 0; an empty prediction 1, 0, 0."""
    n = _marked(truth, predicted).groupBy("query_id").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in (("t", F.col("m") != 2), ("p", F.col("m") != 1), ("b", F.col("m") == 3))])
    rows = queries.select("query_id").join(n, "query_id", "left").na.fill(0, ["t", "p", "b"])
    t, p, b = F.col("t"), F.col("p"), F.col("b")
    precision = F.when(p == 0, 1.0).when(t == 0, 0.0).otherwise(b / p)
    recall = F.when(t == 0, 1.0).when(p == 0, 0.0).otherwise(b / t)
    f1 = F.when((t == 0) & (p == 0), 1.0).when((t == 0) | (p == 0) | (b == 0), 0.0).otherwise(2 * b / (t + p))
    return rows.select("query_id", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def mean_accuracy(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def selectivity(queries: DataFrame, results: DataFrame, n_hists: int) -> DataFrame:
    """(query_id, selectivity): the matching share of all histograms, which is also a pruning factor for an index's results."""
    n = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / n_hists).alias("selectivity"))


def cluster_hits(queries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(query_id, cluster_hits): the share of clusters whose range has the reference."""
    ends = small(clusters.select(F.element_at("edges", 1).alias("a"), F.element_at("edges", -1).alias("b")))
    return queries.crossJoin(ends).groupBy("query_id").agg(F.avg(F.col("reference").between(F.col("a"), F.col("b")).cast("double")).alias("cluster_hits"))


def edge_matches(queries: DataFrame, hists: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(query_id, edge_matches): the share of histograms with an edge at the reference."""
    rows = hists.select("edges").crossJoin(small(queries))
    hit = F.exists("edges", lambda e: F.abs(e - F.col("reference")) <= tolerance)
    return rows.groupBy("query_id").agg(F.avg(hit.cast("double")).alias("edge_matches"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, hist_id, side) of results that only one side has; empty where an index and a baseline agree. Sides are marked and counted together: results compress so well that a join would broadcast them by their files' size."""
    rows = _marked(a, b).where("m < 3")
    return rows.select(*KEYS, F.when(F.col("m") == 1, "first").otherwise("second").alias("side"))


def mean_difference(queries: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(mean_difference): how many results only one side has, on average over queries."""
    n = differing(a, b).groupBy("query_id").count()
    return queries.select("query_id").join(n, "query_id", "left").agg(F.avg(F.coalesce("count", F.lit(0))).alias("mean_difference"))


def index_differences(a: DataFrame, b: DataFrame, tolerance4: int = 0) -> DataFrame:
    """Entries of two indexes that one lacks or whose percentiles differ by more than the tolerance."""
    keys = ["cluster_id", "variant", "bin_no", "hist_id"]
    rows = a.withColumnRenamed("pctl4", "p").join(b.withColumnRenamed("pctl4", "q"), keys, "full_outer")
    gap = F.abs(F.col("p").cast("int") - F.col("q").cast("int"))
    return rows.where(F.col("p").isNull() | F.col("q").isNull() | (gap > tolerance4))


def skyline(rows: DataFrame, more: str, less: str) -> DataFrame:
    """Rows that no other beats in one of `more` (larger is better) and `less` (smaller is better) without being worse in the other.

    A row is beaten by the best `less` among rows with a larger `more`, or with
    an equal one and less itself. Rows are ranked by `more` in ranges; what the
    ranges above hold is one number a range.
    """
    best = rows.groupBy(more).agg(F.min(less).alias("__best"))  # of equal `more`, only the least `less` can stay
    parts = checkpointed(best.repartitionByRange(F.desc(more)).withColumn("__part", F.spark_partition_id()), "skyline")
    above, so_far = [], None
    for r in parts.groupBy("__part").agg(F.min("__best").alias("m")).orderBy("__part").collect():  # a row a range
        above += [F.lit(r["__part"]), F.lit(so_far).cast(best.schema["__best"].dataType)]
        so_far = r["m"] if so_far is None else so_far if r["m"] is None else min(so_far, r["m"])
    if not above:
        return rows
    before = F.min("__best").over(Window.partitionBy("__part").orderBy(F.desc(more)).rowsBetween(Window.unboundedPreceding, -1))
    lead = F.least(before, F.element_at(F.create_map(*above), F.col("__part")))
    stay = parts.withColumn("__lead", lead).where(F.col("__lead").isNull() | (F.col("__best") < F.col("__lead"))).select(F.col(more).alias("__more"), "__best")
    return rows.join(small(stay), (rows[more] == F.col("__more")) & (rows[less] == F.col("__best"))).select(*rows.columns)
