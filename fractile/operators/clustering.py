"""Clustering of histograms by range and bin width, and the clusters' common edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fractile.functions.histogram import round4
from fractile.functions.tree import joined, numbered, shortest_tree
from fractile.plans.store import checkpointed, small

BOUND = 1e31
FEATURES = ("low", "high", "width")


def features(hists: DataFrame) -> DataFrame:
    """hist_id, low, high, width (mean bin width), within +-1e31."""
    clip = lambda c: F.greatest(F.least(c, F.lit(BOUND)), F.lit(-BOUND))
    low, high = F.element_at("edges", 1), F.element_at("edges", -1)
    return hists.select("hist_id", clip(low).alias("low"), clip(high).alias("high"), clip((high - low) / F.size("counts")).alias("width"))


def transformed(rows: DataFrame, transform: str | None = None, quantile_range: tuple[float, float] = (0.25, 0.75), compat: bool = False) -> DataFrame:
    """Features scaled: none, standard (population deviation), robust (median and quantile range), quantile (to uniform), power (Yeo-Johnson).

    compat keeps two habits of the engine that this one replaces: robust takes
    its quantiles as percents, and quantile uses two quantiles only.
    """
    if transform in (None, "none"):
        return rows
    if transform == "standard":
        s = rows.agg(*[f(c).alias(f"{c}_{n}") for c in FEATURES for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
        return rows.select("hist_id", *[((F.col(c) - F.lit(s[f"{c}_m"])) / F.lit(s[f"{c}_s"] or 1.0)).alias(c) for c in FEATURES])
    if transform == "robust":
        a, b = (q / 100 if compat else q for q in quantile_range)
        s = rows.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in FEATURES for q, n in ((0.5, "m"), (a, "a"), (b, "b"))]).first()
        return rows.select("hist_id", *[((F.col(c) - F.lit(s[f"{c}_m"])) / F.lit((s[f"{c}_b"] - s[f"{c}_a"]) or 1.0)).alias(c) for c in FEATURES])
    if transform == "quantile":
        if compat:
            s = rows.agg(*[f(c).alias(f"{c}_{n}") for c in FEATURES for f, n in ((F.min, "a"), (F.max, "b"))]).first()
            return rows.select("hist_id", *[((F.col(c) - F.lit(s[f"{c}_a"])) / F.lit((s[f"{c}_b"] - s[f"{c}_a"]) or 1.0)).alias(c) for c in FEATURES])
        grid = [k / 1000 for k in range(1001)]
        marks = rows.approxQuantile(list(FEATURES), grid, 1e-4)
        below = lambda c, m: F.size(F.filter(F.lit(m), lambda e: e <= F.col(c))) / len(grid)
        return rows.select("hist_id", *[below(c, m).alias(c) for c, m in zip(FEATURES, marks)])
    if transform == "power":
        out = rows
        for c in FEATURES:
            lam = _yeo_johnson_lambda(rows, c)
            out = out.withColumn(c, _yeo_johnson(F.col(c), lam))
        return transformed(out, "standard")
    raise ValueError(f"unknown transform: {transform}")


def _yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _yeo_johnson_lambda(rows: DataFrame, c: str) -> float:
    """The likeliest power of a grid, in one pass."""
    grid = [k / 4 for k in range(-8, 17)]
    jacobian = F.sum(F.signum(c) * F.log1p(F.abs(F.col(c)))).alias("j")
    s = rows.agg(F.count(F.lit(1)).alias("n"), jacobian, *[F.var_pop(_yeo_johnson(F.col(c), g)).alias(f"v{k}") for k, g in enumerate(grid)]).first()
    best = [(-(s["n"] / 2) * math.log(s[f"v{k}"]) + (g - 1) * s["j"], g) for k, g in enumerate(grid) if s[f"v{k}"] and math.isfinite(s[f"v{k}"])]
    return max(best)[1] if best else 1.0


def calinski_harabasz(labelled: DataFrame) -> float:
    """Between to within dispersion of (label, features), in one aggregation of sums."""
    sums = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[f.alias(n) for c in FEATURES for f, n in ((F.sum(c), f"s_{c}"), (F.sum(F.col(c) * F.col(c)), f"q_{c}"))]).toPandas()
    n, k = sums["n"].sum(), len(sums)
    if k < 2 or n <= k:
        return -math.inf
    between = sum((sums[f"s_{c}"] ** 2 / sums["n"]).sum() - sums[f"s_{c}"].sum() ** 2 / n for c in FEATURES)
    within = sum((sums[f"q_{c}"] - sums[f"s_{c}"] ** 2 / sums["n"]).sum() for c in FEATURES)
    return math.inf if within <= 0 else (between / (k - 1)) / (within / (n - k))


def cluster_labels(rows: DataFrame, algorithm: str = "kmeans", n_clusters: tuple[int, int] = (1, 1), seed: int = 42) -> DataFrame:
    """(hist_id, label): of every number of clusters in the range the fit with the best Calinski-Harabasz score. (1, 1) is the trivial clustering; hdbscan finds the number by itself and its noise is one cluster, label -1."""
    low, high = n_clusters
    if (low, high) == (1, 1):
        return rows.select("hist_id", F.lit(0).alias("label"))
    if algorithm == "agglomerative":
        return _single_linkage(rows, range(max(2, low), high + 1))
    if algorithm == "hdbscan":
        rows, x, n, _ = _points(rows)
        return _labelled(rows, x, density_labels(x, weights=n))
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.feature import VectorAssembler

    makers = {"kmeans": KMeans, "bisecting": BisectingKMeans}
    if algorithm not in makers:
        raise NotImplementedError(f"no clustering algorithm {algorithm}")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(rows).persist()
    best: tuple[float, DataFrame] | None = None
    for k in range(max(2, low), high + 1):
        model = makers[algorithm](k=k, seed=seed, featuresCol="v", predictionCol="label").fit(data)
        labelled = model.transform(data).select("hist_id", "label", *FEATURES)
        score = calinski_harabasz(labelled)
        if best is None or score > best[0]:
            best = (score, labelled)
    out = checkpointed(best[1].select("hist_id", "label"), "labels")
    data.unpersist()
    return out


def _points(rows: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The rows as written once, their distinct points on the driver in order of their least hist_ids, how many rows are at each, and these hist_ids."""
    rows = checkpointed(rows.select("hist_id", *FEATURES), "rows")
    found = rows.groupBy(*FEATURES).agg(F.min("hist_id").alias("first"), F.count(F.lit(1)).alias("n")).toArrow()
    table = {k: c.to_numpy() for k, c in zip(found.column_names, found.columns)}
    order = np.argsort(table["first"])
    return rows, np.stack([table[c][order] for c in FEATURES], axis=1).astype(float), table["n"][order], table["first"][order]


def _labelled(rows: DataFrame, x: np.ndarray, labels: np.ndarray) -> DataFrame:
    """(hist_id, label) by the labels of the distinct points x."""
    table = pa.table({**{c: x[:, k] for k, c in enumerate(FEATURES)}, "label": labels.astype("int32")})
    named = checkpointed(rows.sparkSession.createDataFrame(table, ", ".join(f"{c} double" for c in FEATURES) + ", label int"), "points")
    near = small(named)
    return checkpointed(rows.join(named.hint("merge") if near is named else near, list(FEATURES)).select("hist_id", "label"), "labels")


def _spanning_tree(x: np.ndarray, core: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """Prim's tree over all distances, none smaller than its ends' core distances: (length, node, node), shortest first."""
    n = len(x)
    near, link, done, tree = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    at = 0
    for _ in range(n - 1):
        done[at] = True
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        if core is not None:
            d = np.maximum(np.maximum(d, core), core[at])
        closer = ~done & (d < near)
        near[closer], link[closer] = d[closer], at
        at = int(np.where(done, np.inf, near).argmin())
        tree.append((float(near[at]), at, int(link[at])))
    return sorted(tree)


#: Density of points at distance 0.
DENSEST = 1e300


def density_labels(x: np.ndarray, least: int = 5, neighbours: int = 1, weights: np.ndarray | None = None) -> np.ndarray:
    """HDBSCAN: of the hierarchy of groups of at least `least` points the most stable ones that don't overlap, numbered in order of their first points; -1 for points in none.

    Density is 1 / distance. A group lives from the density at which it splits
    off to the one at which it splits in two; its stability is how long its
    points stay in it, summed. The whole is never a group of its own. With one
    neighbour, the point itself, core distances are 0 and nearest points are
    searched; with more, all distances are needed. weights says how many points
    are at each place, which then are a group if they are enough; with them
    there is one neighbour.
    """
    n = len(x)
    if weights is not None and neighbours > 1:
        raise ValueError("weights are for one neighbour")
    if neighbours > 1 and n:
        core = np.array([np.partition(np.sqrt(((x - p) ** 2).sum(axis=1)), min(neighbours, n) - 1)[min(neighbours, n) - 1] for p in x])
        tree = _spanning_tree(x, core)
    else:
        tree = zip(*(c.tolist() for c in shortest_tree(x)))
    halves, density, top = {}, {}, list(range(n))

    def node(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for length, a, b in tree:
        a, b, new = node(a), node(b), len(top)
        halves[new], density[new] = (a, b), min(DENSEST, 1 / length) if length else DENSEST
        top.append(new)
        top[a] = top[b] = new
    sizes = [1] * n if weights is None else weights.tolist()
    for k in range(n, len(top)):
        sizes.append(sum(sizes[h] for h in halves[k]))

    groups = [(len(top) - 1, 0.0, -1)] if n else []  # node, density at birth, parent; parents come first
    stability = []
    for at, birth, _ in groups:
        own, stays = 0.0, at
        while stays is not None and stays >= n:
            large = [h for h in halves[stays] if sizes[h] >= least]
            own += (density[stays] - birth) * (sizes[stays] - (sizes[large[0]] if len(large) == 1 else 0))
            if len(large) == 2:
                groups += [(h, density[stays], len(stability)) for h in large]
            stays = large[0] if len(large) == 1 else None
        if stays is not None and sizes[stays] > 1:  # all at one place
            own += (DENSEST - birth) * sizes[stays]
        stability.append(own)
    below, chosen = [0.0] * len(groups), [False] * len(groups)
    for g in range(len(groups) - 1, 0, -1):
        chosen[g] = below[g] <= stability[g]
        below[groups[g][2]] += max(below[g], stability[g])
    out = np.full(n, -1)
    covered = [False] * len(groups)
    for g in range(1, len(groups)):
        up = groups[g][2]
        covered[g] = covered[up] or chosen[up]
        if chosen[g] and not covered[g]:
            left = [groups[g][0]]
            while left:
                k = left.pop()
                if k < n:
                    out[k] = g
                else:
                    left += halves[k]
    _, first, inverse = np.unique(out, return_index=True, return_inverse=True)
    found = [k for k in np.argsort(first) if out[first[k]] >= 0]
    names = np.full(len(first), -1)
    names[found] = np.arange(len(found))
    return names[inverse]


def _single_linkage(rows: DataFrame, ks: range) -> DataFrame:
    """Single linkage over all histograms: the shortest tree's longest edges are the last merges. Those at one point stay together while there are fewer clusters than points."""
    rows, x, n, first = _points(rows)
    m, total = len(x), int(n.sum())
    _, a, b = shortest_tree(x)
    top, merged = list(range(m)), 0
    best = (-math.inf, np.zeros(m, int), 0)
    for k in sorted(ks, reverse=True):
        if k > total:
            continue
        for p, q in zip(a[merged : max(m - k, 0)].tolist(), b[merged : max(m - k, 0)].tolist()):
            joined(top, p, q)
        merged = max(merged, m - k)
        label = numbered(top)
        counts = np.bincount(label, n)
        means = np.stack([np.bincount(label, n * c) for c in x.T], axis=1) / counts[:, None]
        between = (counts[:, None] * (means - np.average(x, axis=0, weights=n)) ** 2).sum()
        within = (n[:, None] * (x - means[label]) ** 2).sum()
        score = math.inf if within <= 0 or total == k else (between / (k - 1)) / (within / (total - k)) if k > 1 else -math.inf
        if score >= best[0]:
            best = (score, label, max(k - m, 0))
    out = _labelled(rows, x, best[1])
    if best[2]:  # more clusters than points: the last histograms that aren't the first at theirs are clusters of their own
        later = rows.orderBy(F.desc("hist_id")).limit(best[2] + m).collect()
        spare = [r["hist_id"] for r in later if r["hist_id"] not in set(first.tolist())][: best[2]]
        own = F.create_map(*[F.lit(v) for k, i in enumerate(spare) for v in (i, m + k)])
        out = out.withColumn("label", F.coalesce(F.try_element_at(own, F.col("hist_id")), F.col("label")).cast("int"))
    return out


def members(labels: DataFrame) -> DataFrame:
    """(cluster_id, hist_id) with dense cluster ids in the order of the labels."""
    names = labels.select("label").distinct()
    dense = names.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("cluster_id"))
    return labels.join(F.broadcast(dense), "label").select("cluster_id", "hist_id")  # one row a cluster


def cluster_edges(hists: DataFrame, members: DataFrame, n_bins: int, alpha: float = 1.0) -> DataFrame:
    """(cluster_id, edges, n_hists, low, high): equal steps over the cluster's range, to four decimals; a cluster's part of the bins is (size + alpha) / (all + alpha clusters), or equal for infinite alpha."""
    rows = hists.select("hist_id", F.element_at("edges", 1).alias("a"), F.element_at("edges", -1).alias("b")).join(members, "hist_id")
    rows = rows.groupBy("cluster_id").agg(F.min("a").alias("low"), F.max("b").alias("high"), F.count(F.lit(1)).alias("n_hists"))
    every = Window.partitionBy(F.lit(0))
    clusters, total = F.count(F.lit(1)).over(every), F.sum("n_hists").over(every)
    share = 1 / clusters if math.isinf(alpha) else (F.col("n_hists") + F.lit(float(alpha))) / (total + F.lit(float(alpha)) * clusters)
    rows = rows.withColumn("n", F.greatest(F.floor(share * n_bins), F.lit(1)).cast("int"))
    steps = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: round4(F.col("low") + i * ((F.col("high") - F.col("low")) / F.col("n"))))
    return rows.select("cluster_id", F.concat(steps, F.array(round4(F.col("high")))).alias("edges"), "n_hists", "low", "high")


def range_check(clusters: DataFrame) -> DataFrame:
    """The clusters whose rounded outer edges moved by more than 1e-4."""
    moved = (F.abs(F.element_at("edges", 1) - F.col("low")) > 1e-4) | (F.abs(F.element_at("edges", -1) - F.col("high")) > 1e-4)
    return clusters.where(moved)


def predicted_size(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.sum(F.col("n_hists") * F.size("edges") * 6).alias("n_bytes"))


def cluster_histograms(hists: DataFrame, n_bins: int, transform: str | None = None, algorithm: str = "kmeans", n_clusters: tuple[int, int] = (1, 1), alpha: float = 1.0, seed: int = 42, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, clusters)."""
    labels = cluster_labels(transformed(features(hists), transform, compat=compat), algorithm, n_clusters, seed)
    own = members(labels)
    return own, cluster_edges(hists, own, n_bins, alpha)
