"""Alignment of histograms to cluster edges and the percentile index.

A histogram's percentile at a cluster edge is its distribution function there,
so each row is aligned by itself: one join with the few clusters and one
explode, without a shuffle of bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fractile.functions.histogram import cumulated, distribution, edges_below, edges_upto, maybe_below, scaled, surely_below
from fractile.functions.spline import with_spline
from fractile.operators.profiles import prepared
from fractile.plans.store import small

METHODS = ("rebinning", "conversion")


def aligned(hists: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Histograms with cluster_id and their cluster's edges as new_edges."""
    own = small(clusters.select("cluster_id", F.col("edges").alias("new_edges")))
    return prepared(hists).join(members.select("cluster_id", "hist_id"), "hist_id").join(own, "cluster_id")


def rebinned(hists: DataFrame, members: DataFrame, clusters: DataFrame, estimation: str = "continuous_value") -> DataFrame:
    """(cluster_id, hist_id, edges, counts, cum, total): histograms over their cluster's edges; counts are shares of the total 1."""
    rows = aligned(hists, members, clusters)
    if estimation not in ("continuous_value", "cubic_spline"):
        raise ValueError(f"unknown bin estimation: {estimation}")
    spline = F.col("spline") if estimation == "cubic_spline" else None
    rows = (with_spline(rows) if estimation == "cubic_spline" else rows).withColumn("at", F.transform("new_edges", lambda x: distribution(F.col("edges"), F.col("counts"), F.col("cum"), x, spline)))
    shares = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda k: F.element_at("at", k + 1) - F.element_at("at", k))
    rows = rows.select("cluster_id", "hist_id", F.col("new_edges").alias("edges"), shares.alias("counts"))
    return rows.select("*", cumulated(F.col("counts"), F.lit(0.0)).alias("cum"), F.lit(1.0).alias("total"))


def conversion(hists: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, hist_id, matrix): of each old bin the first and last cluster bin that it overlaps."""
    rows = aligned(hists, members, clusters)
    spans = F.transform(
        F.sequence(F.lit(1), F.size("counts")),
        lambda i: F.struct(F.greatest(edges_upto(F.col("new_edges"), F.element_at("edges", i)) - 1, F.lit(0)).alias("first"), (edges_below(F.col("new_edges"), F.element_at("edges", i + 1)) - 1).alias("last")),
    )
    return rows.select("cluster_id", "hist_id", spans.alias("matrix"))


def create_index(hists: DataFrame, members: DataFrame, clusters: DataFrame, method: str = "rebinning", estimation: str = "continuous_value") -> DataFrame:
    """(cluster_id, variant, bin_no, pctl4, hist_id): variant rebin has a percentile at each cluster edge, lower and upper one at each cluster bin; pctl4 is in ten-thousandths. Names ending in -shm are accepted."""
    method = method.removesuffix("-shm")
    if method not in METHODS:
        raise ValueError(f"unknown index method: {method}")
    if method == "rebinning" and estimation == "cubic_spline":
        rows = rebinned(hists, members, clusters, estimation).select("cluster_id", "hist_id", F.lit("rebin").alias("variant"), F.posexplode("cum").alias("bin_no", "p"))
    else:
        rows = aligned(hists, members, clusters)
        col = {c: F.col(c) for c in ("edges", "counts", "cum", "new_edges")}
        if method == "rebinning":
            parts = [("rebin", F.transform("new_edges", lambda x: distribution(col["edges"], col["counts"], col["cum"], x)))]
        else:
            bins = F.sequence(F.lit(1), F.size("new_edges") - 1)
            parts = [("lower", F.transform(bins, lambda k: surely_below(col["edges"], col["cum"], F.element_at("new_edges", k)))), ("upper", F.transform(bins, lambda k: maybe_below(col["edges"], col["cum"], F.element_at("new_edges", k + 1))))]
        rows = rows.select("cluster_id", "hist_id", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), p.alias("p")) for n, p in parts])).alias("v"))
        rows = rows.select("cluster_id", "hist_id", "v.variant", F.posexplode("v.p").alias("bin_no", "p"))
    return rows.select("cluster_id", "variant", "bin_no", scaled(F.col("p")).cast("smallint").alias("pctl4"), "hist_id")


def verify(index: DataFrame, tolerance4: int = 1) -> DataFrame:
    """(variant, first_gap, last_gap, sound) in ten-thousandths: first percentiles of rebin and lower must be 0, last ones of rebin and upper 1."""
    ends = index.groupBy("cluster_id", "variant").agg(F.max("bin_no").alias("last"))
    rows = index.join(small(ends), ["cluster_id", "variant"])
    first = F.max(F.when((F.col("bin_no") == 0) & (F.col("variant") != "upper"), F.abs(F.col("pctl4").cast("int"))))
    last = F.max(F.when((F.col("bin_no") == F.col("last")) & (F.col("variant") != "lower"), F.abs(F.col("pctl4").cast("int") - 10_000)))
    out = rows.groupBy("variant").agg(F.coalesce(first, F.lit(0)).alias("first_gap"), F.coalesce(last, F.lit(0)).alias("last_gap"))
    return out.withColumn("sound", (F.col("first_gap") <= tolerance4) & (F.col("last_gap") <= tolerance4))


def binsort(hists: DataFrame) -> DataFrame:
    """(edge, pre4, mid4, post4, hist_id): at each edge the percentile one bin before, up to it, and one bin after."""
    rows = prepared(hists).select("hist_id", "edges", F.transform("cum", lambda c: scaled(c / F.col("total")).cast("smallint")).alias("p"))
    rows = rows.select("hist_id", "p", F.posexplode("edges").alias("j", "edge"))
    one = F.lit(10_000).cast("smallint")
    return rows.select("edge", F.when(F.col("j") > 0, F.get("p", F.col("j") - 1)).otherwise(F.lit(0).cast("smallint")).alias("pre4"), F.get("p", F.col("j")).alias("mid4"), F.coalesce(F.get("p", F.col("j") + 1), one).alias("post4"), "hist_id")
