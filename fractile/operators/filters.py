"""Prefilters and the algebra of result sets (query_id, hist_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fractile.plans.store import checkpointed

KEYS = ["query_id", "hist_id"]


def keep_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of histograms, an index, a binsort table or members whose hist_id is in ids."""
    return rows.join(ids.select("hist_id").distinct(), "hist_id", "left_semi").select(*rows.columns)


def keep_clusters(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Without clusters that have no member left."""
    return clusters.join(members.select("cluster_id").distinct(), "cluster_id", "left_semi")


def random_ids(hists: DataFrame, selectivity: float, seed: int = 42) -> DataFrame:
    """Exactly floor(n * selectivity) ids, those with the smallest seeded digests; ties are broken by id."""
    if not 0 < selectivity <= 1:
        raise ValueError("selectivity must be over 0 and at most 1")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("hist_id").cast("string")))
    rows = checkpointed(hists.select("hist_id", draw.alias("draw")), "draws")
    bucket = F.substring("draw", 1, 3)
    sizes = sorted((r["b"], r["count"]) for r in rows.groupBy(bucket.alias("b")).count().collect())  # 4,096 rows at most
    left = int(sum(n for _, n in sizes) * selectivity)
    for b, n in sizes:
        if n > left:
            break
        left -= n
    else:
        return rows.select("hist_id")
    # Ranges below that one are taken whole; only its own rows are ordered.
    inside = rows.where(bucket == b).orderBy("draw", "hist_id").limit(left)
    return rows.where(bucket < b).unionByName(inside).select("hist_id")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, KEYS, "left_semi").distinct()


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, KEYS, "left_anti").distinct()


def one_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric difference."""
    rows = a.select(*KEYS, F.lit(1).alias("s")).unionByName(b.select(*KEYS, F.lit(2).alias("s"))).groupBy(*KEYS).agg(F.bit_or("s").alias("s"))
    return rows.where("s < 3").select(*KEYS)


def in_columns(results: DataFrame, profiles: DataFrame, pattern: str) -> DataFrame:
    """Results whose column name matches a regular expression; profiles are (hist_id, dataset, column)."""
    return results.join(profiles.where(F.col("column").rlike(pattern)).select("hist_id"), "hist_id", "left_semi").select(*KEYS)


def combined(results: DataFrame, expression: tuple, every: DataFrame) -> DataFrame:
    """hist_id of a Boolean expression over query ids: ("and" | "or", e, e, ...), ("not", e) or a query_id. every has all hist_ids."""
    if not isinstance(expression, tuple):
        return results.where(F.col("query_id") == expression).select("hist_id").distinct()
    name, *parts = expression
    sets = [combined(results, p, every) for p in parts]
    if name == "not":
        return every.select("hist_id").distinct().join(sets[0], "hist_id", "left_anti")
    out = sets[0]
    for s in sets[1:]:
        out = out.join(s, "hist_id", "left_semi") if name == "and" else out.unionByName(s).distinct()
    return out


def datasets_of(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """(query_id, dataset, n_columns) of the datasets with matching columns."""
    return results.join(profiles.select("hist_id", "dataset"), "hist_id").groupBy("query_id", "dataset").agg(F.count(F.lit(1)).alias("n_columns"))


def ranked(rows: DataFrame, partition: str, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
