"""Evaluation of percentile predicates: six evaluators and the exact combination.

Queries are (query_id, percentile, op, reference); results (query_id, hist_id).
Queries are few beside histograms and are broadcast while they are; predicates
are conditions of the join, so only matches leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fractile.functions.histogram import edges_below, mass, normal_cdf, round4, satisfied, scaled
from fractile.functions.spline import with_spline
from fractile.operators.filters import keep_ids
from fractile.operators.profiles import prepared
from fractile.plans.store import checkpointed, small

LOWER = ("lt", "le")


def _scanned(hists: DataFrame, mode: str) -> DataFrame:
    """What a scan reads of histograms; a spline is fitted once for all queries."""
    rows = prepared(hists).select("hist_id", "edges", "counts", "cum", "total")
    return with_spline(rows) if mode == "cubic_spline" else rows


def _matches(pairs: DataFrame, mode: str, edge_compat: bool) -> DataFrame:
    """pairs: rows with a histogram's columns and a query's; those that satisfy the predicate."""
    c = {n: F.col(n) for n in ("edges", "counts", "cum", "op", "reference", "percentile", "total")}
    spline = F.col("spline") if mode == "cubic_spline" else None
    return pairs.where(satisfied(mass(c["edges"], c["counts"], c["cum"], c["op"], c["reference"], mode, edge_compat, spline), c["total"], c["percentile"], mode, edge_compat))


def scan(hists: DataFrame, queries: DataFrame, mode: str = "over", edge_compat: bool = True) -> DataFrame:
    """E1: every histogram against every query."""
    return _matches(_scanned(hists, mode).crossJoin(small(queries)), mode, edge_compat).select("query_id", "hist_id")


def scan_pairs(hists: DataFrame, queries: DataFrame, pairs: DataFrame, mode: str = "over", edge_compat: bool = True) -> DataFrame:
    """E1 for given (query_id, hist_id) only."""
    return _matches(pairs.join(small(queries), "query_id").join(_scanned(hists, mode), "hist_id"), mode, edge_compat).select("query_id", "hist_id")


def _outside(clustered: DataFrame, queries: DataFrame) -> tuple[Column, Column]:
    """Whether the reference is beyond the cluster's range, and whether then all match. clustered has first and last edge."""
    ref, lower = F.col("reference"), F.col("op").isin(*LOWER)
    beyond = (ref < F.col("first")) | (ref > F.col("last"))
    return beyond, F.when(lower, ref > F.col("last")).otherwise(ref < F.col("first"))


def scan_rebinned(rebinned: DataFrame, queries: DataFrame, mode: str = "continuous_value", edge_compat: bool = True) -> DataFrame:
    """E2: the scan over histograms in their cluster's bins, with a short cut outside its range."""
    rows = (with_spline(rebinned) if mode == "cubic_spline" else rebinned).withColumns({"first": F.element_at("edges", 1), "last": F.element_at("edges", -1)}).crossJoin(small(queries))
    beyond, every = _outside(rows, queries)
    c = {n: F.col(n) for n in ("edges", "counts", "cum", "op", "reference", "percentile", "total")}
    inside = satisfied(mass(c["edges"], c["counts"], c["cum"], c["op"], c["reference"], mode, edge_compat, F.col("spline") if mode == "cubic_spline" else None), c["total"], c["percentile"], mode, edge_compat)
    return rows.where(F.when(beyond, every).otherwise(inside)).select("query_id", "hist_id")


def scan_conversion(hists: DataFrame, members: DataFrame, clusters: DataFrame, queries: DataFrame, mode: str = "over") -> DataFrame:
    """E3: the mass of the bins that overlap the cluster bins up to, or from, the reference's; an upper bound."""
    if mode != "over":
        raise NotImplementedError("conversion matrices give upper bounds only; use the index")
    from fractile.operators.index import aligned

    rows = aligned(hists, members, clusters).withColumns({"first": F.element_at("new_edges", 1), "last": F.element_at("new_edges", -1)}).crossJoin(small(queries))
    beyond, every = _outside(rows, queries)
    b = edges_below(F.col("new_edges"), F.col("reference")) - 1
    upto = F.get("cum", F.least(edges_below(F.col("edges"), F.get("new_edges", b + 1)), F.size("edges") - 1))
    before = F.get("cum", F.greatest(F.size(F.filter("edges", lambda e: e <= F.get("new_edges", b))) - 1, F.lit(0)))
    lower = F.col("op").isin(*LOWER)
    part = F.when(b < 0, F.when(lower, 0).otherwise(F.col("total"))).when(lower, upto).otherwise(F.col("total") - before)
    inside = scaled(part / F.col("total")) >= scaled(F.col("percentile"))
    return rows.where(F.when(beyond, every).otherwise(inside)).select("query_id", "hist_id")


def routes(clusters: DataFrame, queries: DataFrame, method: str = "rebinning", index_mode: str = "recall") -> DataFrame:
    """(query_id, cluster_id, kind, variant, bin_no, bound4, lower): what each query asks of each cluster; kind is none, all or search."""
    if index_mode not in ("recall", "precision"):
        raise ValueError(f"unknown index mode: {index_mode}")
    rows = clusters.select("cluster_id", "edges", F.element_at("edges", 1).alias("first"), F.element_at("edges", -1).alias("last")).crossJoin(small(queries))
    beyond, every = _outside(rows, queries)
    lower = F.col("op").isin(*LOWER)
    b = F.greatest(edges_below(F.col("edges"), F.col("reference")) - 1, F.lit(0))
    later = lower == F.lit(index_mode == "recall")
    if method.removesuffix("-shm") == "rebinning":
        variant, bin_no = F.lit("rebin"), b + later.cast("int")
    else:
        variant, bin_no = F.when(later, "upper").otherwise("lower"), b
    kind = F.when(F.size("edges") < 2, "none").when(beyond, F.when(every, "all").otherwise("none")).otherwise("search")
    bound = F.when(lower, scaled(F.col("percentile"))).otherwise(F.lit(10_000) - scaled(F.col("percentile")))
    return rows.select("query_id", "cluster_id", kind.alias("kind"), variant.alias("variant"), bin_no.alias("bin_no"), bound.alias("bound4"), lower.alias("lower"))


#: Routes, and terms of a predicate, up to which a probe's bounds are written into the plan.
LITERAL_ROUTES, LITERAL_TERMS = 20_000, 256


def pruned(index: DataFrame, search: DataFrame) -> DataFrame:
    """The index rows that some route may ask for, by predicates on literals that reach the scan: its clusters prune folders; variant, bin and percentile bounds prune by file statistics. All rows where routes are many."""
    rows = search.groupBy("cluster_id", "variant", "bin_no", "lower").agg(F.min("bound4").alias("low"), F.max("bound4").alias("high")).limit(LITERAL_ROUTES + 1).collect()
    if len(rows) > LITERAL_ROUTES:
        return index
    if not rows:
        return index.where(F.lit(False))
    clusters, bins, bounds = set(), {}, {}
    for r in rows:
        clusters.add(r["cluster_id"])
        bins.setdefault(r["variant"], set()).add(r["bin_no"])
        key = (r["variant"], r["bin_no"], r["lower"])
        bound = r["low"] if r["lower"] else r["high"]
        bounds[key] = bound if key not in bounds else (min if r["lower"] else max)(bound, bounds[key])
    if len(bounds) <= LITERAL_TERMS:
        terms = [(F.col("variant") == v) & (F.col("bin_no") == b) & (F.col("pctl4") >= F.lit(x).cast("smallint") if low else F.col("pctl4") <= F.lit(x).cast("smallint")) for (v, b, low), x in sorted(bounds.items())]
    else:
        terms = [(F.col("variant") == v) & F.col("bin_no").between(min(own), max(own)) for v, own in sorted(bins.items())]
    while len(terms) > 1:  # a balanced tree, as a deep one costs the planner
        terms = [a | b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) - len(terms) % 2 :]
    return index.where(F.col("cluster_id").isin(sorted(clusters)) & terms[0])


def _hits(index: DataFrame, members: DataFrame, asked: DataFrame, *more: str) -> DataFrame:
    """Members that routes find, with the routes' columns in more."""
    asked = checkpointed(asked, "routes")
    search = asked.where("kind = 'search'").drop("kind")
    hit = F.when(F.col("lower"), F.col("pctl4") >= F.col("bound4")).otherwise(F.col("pctl4") <= F.col("bound4"))
    found = pruned(index, search).join(small(search), ["cluster_id", "variant", "bin_no"]).where(hit).select("query_id", "hist_id", *more)
    whole = members.join(small(asked.where("kind = 'all'").select("query_id", "cluster_id", *more)), "cluster_id").select("query_id", "hist_id", *more)
    return found.unionByName(whole)


def probe(index: DataFrame, clusters: DataFrame, members: DataFrame, queries: DataFrame, method: str = "rebinning", index_mode: str = "recall", outliers: DataFrame | None = None) -> DataFrame:
    """E4: an equi-join of routes and index with the percentile bound, and all members of clusters that match whole. Outliers, histograms beside the index, are scanned."""
    found = _hits(index, members, routes(clusters, queries, method, index_mode))
    return found if outliers is None else found.unionByName(scan(outliers, queries))


def trace(index: DataFrame, clusters: DataFrame, members: DataFrame, queries: DataFrame, method: str = "rebinning", index_mode: str = "recall") -> DataFrame:
    """(query_id, n_none, n_all, n_search, n_results): how many clusters a query passes by, takes whole and searches, and what it finds."""
    asked = checkpointed(routes(clusters, queries, method, index_mode), "routes")
    kinds = asked.groupBy("query_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in ("none", "all", "search")])
    found = probe(index, clusters, members, queries, method, index_mode).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"))
    return kinds.join(found, "query_id", "left").na.fill(0, ["n_results"])


def normal(dists: DataFrame, queries: DataFrame) -> DataFrame:
    """E5: columns taken for normal distributions (hist_id, mean, std)."""
    rows = dists.crossJoin(small(queries))
    z = (F.col("reference") - F.col("mean")) / F.col("std")
    share = F.when(F.col("op").isin(*LOWER), normal_cdf(z)).otherwise(normal_cdf(-z))
    return rows.where(round4(share) >= F.col("percentile").cast("float").cast("double")).select("query_id", "hist_id")


def binsort_scan(table: DataFrame, queries: DataFrame, index_mode: str = "recall") -> DataFrame:
    """E6: edges on the right side of the reference whose percentile is on the right side of the bound. For lt and le a histogram matches at its largest edge below if at any, so edges aren't spread further."""
    if index_mode not in ("recall", "precision"):
        raise ValueError(f"unknown index mode: {index_mode}")
    rows = table.crossJoin(small(queries))
    lower = F.col("op").isin(*LOWER)
    up, down = ("post4", "pre4") if index_mode == "recall" else ("mid4", "mid4")
    bound = scaled(F.col("percentile"))
    hit = F.when(lower, (F.col("edge") <= F.col("reference")) & (F.col(up) >= bound)).otherwise((F.col("edge") >= F.col("reference")) & (F.col(down) <= 10_000 - bound))
    return rows.where(hit).select("query_id", "hist_id").distinct()


def bounded(index: DataFrame, clusters: DataFrame, members: DataFrame, queries: DataFrame, method: str = "conversion") -> DataFrame:
    """(query_id, hist_id, sure) in one reading of the index: what it can't exclude, and whether it is sure of it."""
    asked = routes(clusters, queries, method, "precision").withColumn("is_sure", F.lit(1))
    asked = asked.unionByName(routes(clusters, queries, method, "recall").withColumn("is_sure", F.lit(0)))
    rows = _hits(index, members, asked, "is_sure").groupBy("query_id", "hist_id").agg(F.max("is_sure").alias("sure"))
    return checkpointed(rows, "bounded")


def exact(hists: DataFrame, index: DataFrame, clusters: DataFrame, members: DataFrame, queries: DataFrame, method: str = "conversion", mode: str = "over", edge_compat: bool = True) -> DataFrame:
    """E7: what the index is sure of, and the scan of what it only can't exclude."""
    rows = bounded(index, clusters, members, queries, method)
    open_ = rows.where("sure = 0").select("query_id", "hist_id")
    return rows.where("sure = 1").select("query_id", "hist_id").unionByName(scan_pairs(hists, queries, open_, mode, edge_compat))


def exact_binsort(table: DataFrame, index: DataFrame, clusters: DataFrame, members: DataFrame, queries: DataFrame, method: str = "conversion") -> DataFrame:
    """E7 with E6 for the open pairs."""
    rows = bounded(index, clusters, members, queries, method)
    open_ = rows.where("sure = 0").select("query_id", "hist_id")
    return rows.where("sure = 1").select("query_id", "hist_id").unionByName(binsort_scan(table, queries, "recall").join(open_, ["query_id", "hist_id"], "left_semi"))


def reduction(sure: DataFrame, maybe: DataFrame, n_hists: int) -> DataFrame:
    """(query_id, reduction): the share of histograms that the exact combination needn't scan."""
    open_ = maybe.join(sure, ["query_id", "hist_id"], "left_anti").groupBy("query_id").count()
    return open_.select("query_id", (1 - F.col("count") / n_hists).alias("reduction"))


def run(queries: DataFrame, input_type: str, *, hists: DataFrame | None = None, members: DataFrame | None = None, clusters: DataFrame | None = None, index: DataFrame | None = None, dists: DataFrame | None = None, sorted_bins: DataFrame | None = None, method: str = "rebinning", estimation_mode: str = "over", index_mode: str = "recall", hist_filter: DataFrame | None = None, outliers: DataFrame | None = None, edge_compat: bool = True) -> DataFrame:
    """One entry for all evaluators; hist_filter (hist_id) is applied to all of them."""
    kept = (lambda df: keep_ids(df, hist_filter)) if hist_filter is not None else (lambda df: df)
    beside = None if outliers is None else kept(outliers)
    if input_type == "histograms":
        return scan(kept(hists), queries, estimation_mode, edge_compat)
    if input_type == "rebinned_hists":
        from fractile.operators.index import rebinned

        return scan_rebinned(rebinned(kept(hists), members, clusters), queries, estimation_mode, edge_compat)
    if input_type == "conversion_matrices":
        return scan_conversion(kept(hists), members, clusters, queries, estimation_mode)
    if input_type == "index":
        return probe(kept(index), clusters, kept(members), queries, method, index_mode, beside)
    if input_type == "normal_dists":
        return normal(kept(dists), queries)
    if input_type == "binsort":
        return binsort_scan(kept(sorted_bins), queries, index_mode)
    if input_type == "exact":
        found = exact(kept(hists), kept(index), clusters, kept(members), queries, method, estimation_mode, edge_compat)
        return found if beside is None else found.unionByName(scan(beside, queries, estimation_mode, edge_compat))
    raise ValueError(f"unknown input type: {input_type}")
