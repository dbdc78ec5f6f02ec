import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fractile.functions import histogram as H
from fractile.functions import spline
from fractile.functions.tree import shortest_tree
from fractile.operators import clustering, filters, metrics
from fractile.operators import queries as q
from fractile.operators.index import binsort, conversion, create_index, rebinned, verify
from fractile.operators.profiles import densities, histograms, moments, prepared, to_values, with_ids
from fractile.plans import evaluate, store

OPS = q.OPERATORS


def as_set(df):
    return {tuple(r) for r in df.collect()}


def mass_by_hand(edges, counts, op, ref, mode, compat):
    """The table of cases, bin by bin."""
    n, total = len(counts), sum(counts)
    lower = op in ("lt", "le")
    if ref <= edges[0]:
        return 0 if lower else total
    if ref > edges[-1]:
        return total if lower else 0
    i = max(k for k in range(n) if edges[k] < ref)
    on_edge = edges[i + 1] == ref
    share = {"over": 1, "under": 0, "continuous_value": (ref - edges[i]) / (edges[i + 1] - edges[i])}[mode]
    if lower:
        out = sum(counts[:i])
        if on_edge:
            out += counts[i] + (counts[i] * share if compat else 0)
            if mode == "over" and op == "le" and i + 1 < n:
                out += counts[i + 1]
            return out
        return out + counts[i] * share
    out = sum(counts[i + 1 :])
    if on_edge:
        return out - (counts[i + 1] if mode == "under" and op == "gt" and i + 1 < n else 0)
    return out + counts[i] * {"over": 1, "under": 0, "continuous_value": (edges[i + 1] - ref) / (edges[i + 1] - edges[i])}[mode]


@pytest.fixture(scope="module")
def random_hists(spark):
    rng = random.Random(1)
    rows = []
    for k in range(150):
        n = rng.randrange(1, 9)
        edges = sorted(rng.sample([x / 2 for x in range(-20, 60)], n + 1))
        rows.append((k, edges, [rng.randrange(0, 30) for _ in range(n - 1)] + [rng.randrange(1, 30)]))
    df = spark.createDataFrame(rows, "hist_id long, edges array<double>, counts array<long>")
    df = df.withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    return store.checkpointed(df, "hists"), rows


REFS = [-10.0, -3.5, -3.37, 0.0, 4.21, 5.0, 12.5, 12.87, 20.0, 29.5, 31.3]


@pytest.mark.parametrize("mode", ["over", "under", "continuous_value"])
@pytest.mark.parametrize("compat", [True, False])
def test_scan_follows_the_table(spark, random_hists, mode, compat):
    hists, rows = random_hists
    asked = [q.PercentileQuery(p, op, r) for p in (0.2, 0.7) for op in OPS for r in REFS]
    got = as_set(evaluate.scan(hists, q.to_frame(spark, asked), mode, compat))
    want = set()
    for k, x in enumerate(asked):
        bound = float(np.float32(x.percentile)) if compat and mode == "continuous_value" else x.percentile
        for h, edges, counts in rows:
            if round(float(np.round(mass_by_hand(edges, counts, x.op, x.reference, mode, compat) / sum(counts), 4)), 4) >= bound:
                want.add((k, h))
    assert got == want


def test_known_fractions(spark):
    """Shares .1 .2 .3 .4 on edges 0 to 4."""
    df = prepared(spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0], [1, 2, 3, 4], 10)], "edges array<double>, counts array<long>, total long"))
    cases = [("lt", 2.0, "over", True, 5), ("le", 2.0, "over", True, 8), ("lt", 2.0, "over", False, 3), ("le", 2.0, "over", False, 6), ("gt", 2.0, "under", True, 4), ("ge", 2.0, "under", True, 7), ("gt", 4.0, "under", True, 0), ("lt", 2.5, "continuous_value", True, 4.5), ("ge", 2.5, "continuous_value", True, 5.5), ("lt", 0.0, "over", True, 0), ("ge", -1.0, "under", True, 10), ("lt", 5.0, "under", True, 10)]
    for op, ref, mode, compat, want in cases:
        got = df.select(H.mass(F.col("edges"), F.col("counts"), F.col("cum"), F.lit(op), F.lit(ref), mode, compat).cast("double")).first()[0]
        assert got == want, (op, ref, mode, compat)
    with pytest.raises(ValueError):
        H.mass(F.col("edges"), F.col("counts"), F.col("cum"), F.lit("lt"), F.lit(1.0), "none")


def off_edge(seed=3, n=25):
    rng = random.Random(seed)
    return [q.PercentileQuery(rng.choice((0.1, 0.35, 0.5, 0.8, 1.0)), rng.choice(OPS), round(rng.uniform(-11, 31), 2) + 0.0037) for _ in range(n)]


@pytest.mark.parametrize("clusters_by", ["one", "three"])
def test_index_bounds_and_exact(spark, random_hists, clusters_by):
    hists, _ = random_hists
    members = hists.select((F.lit(0) if clusters_by == "one" else F.pmod("hist_id", F.lit(3))).cast("int").alias("cluster_id"), "hist_id")
    clusters = store.checkpointed(clustering.cluster_edges(hists, members, 25, 1.0), "clusters")
    asked = q.to_frame(spark, off_edge())
    truth = as_set(evaluate.scan(hists, asked, "over"))
    index = store.checkpointed(create_index(hists, members, clusters, "conversion-shm"), "index")
    recall = as_set(evaluate.probe(index, clusters, members, asked, "conversion", "recall"))
    precision = as_set(evaluate.probe(index, clusters, members, asked, "conversion", "precision"))
    assert precision <= truth <= recall
    assert as_set(evaluate.exact(hists, index, clusters, members, asked)) == truth
    assert as_set(evaluate.exact_binsort(binsort(hists), index, clusters, members, asked)) == truth
    assert as_set(evaluate.binsort_scan(binsort(hists), asked, "recall")) == truth
    assert as_set(evaluate.scan_conversion(hists, members, clusters, asked)) == recall
    assert {r["sound"] for r in verify(index).collect()} == {True}
    rebin = create_index(hists, members, clusters, "rebinning")
    assert {r["sound"] for r in verify(rebin).collect()} == {True}
    two = as_set(evaluate.scan_rebinned(rebinned(hists, members, clusters), asked, "over"))
    four = as_set(evaluate.probe(rebin, clusters, members, asked, "rebinning", "recall"))
    assert len(two ^ four) <= 0.01 * len(four)  # rounding at the bound only
    for kind in ("histograms", "rebinned_hists", "conversion_matrices", "index", "binsort", "exact"):
        out = evaluate.run(asked, kind, hists=hists, members=members, clusters=clusters, index=index, sorted_bins=binsort(hists), method="conversion", hist_filter=hists.where("hist_id < 40").select("hist_id"))
        assert out.columns == ["query_id", "hist_id"] and (out.agg(F.max("hist_id")).first()[0] or 0) < 40
    with pytest.raises(NotImplementedError):
        evaluate.scan_conversion(hists, members, clusters, asked, "under")
    with pytest.raises(ValueError):
        evaluate.run(asked, "nothing")


def test_alignment_against_loops(spark, random_hists):
    hists, rows = random_hists
    members = hists.select(F.lit(0).alias("cluster_id"), "hist_id")
    clusters = store.checkpointed(clustering.cluster_edges(hists, members, 13, 0.0), "clusters")
    new = clusters.first()["edges"]
    shares = {r["hist_id"]: r["counts"] for r in rebinned(hists, members, clusters).collect()}
    spans = {r["hist_id"]: r["matrix"] for r in conversion(hists, members, clusters).collect()}
    for h, edges, counts in rows:
        want = [sum(c * max(0.0, min(b, y) - max(a, x)) / (b - a) for a, b, c in zip(edges, edges[1:], counts)) / sum(counts) for x, y in zip(new, new[1:])]
        assert np.allclose(shares[h], want, atol=1e-9)
        for a, b, s in zip(edges, edges[1:], spans[h]):
            over = [j for j, (x, y) in enumerate(zip(new, new[1:])) if a < y and b > x]
            assert (s["first"], s["last"]) == (over[0], over[-1])


def test_histograms_against_numpy(spark):
    rng = np.random.default_rng(4)
    data = {("d1", "a"): rng.normal(size=500), ("d1", "b"): rng.integers(0, 50, 300).astype(float), ("d2", "a"): rng.exponential(size=800) * 1e4, ("d2", "c"): np.full(20, 3.0), ("d3", "e"): np.array([1.0, 2.0])}
    rows = [(d, c, float(v)) for (d, c), vs in data.items() for v in vs] + [("d1", "a", None), ("d1", "a", float("nan")), ("d1", "a", float("inf")), ("d1", "b", 2.0**53)]
    values = spark.createDataFrame(rows, "dataset string, column string, value double").repartition(3)
    got = {(r["dataset"], r["column"]): r for r in histograms(values, F.lit(12)).collect()}
    assert ("d2", "c") not in got
    for key, vs in data.items():
        if key not in got:
            continue
        v = np.round(vs, 4)
        n = min(len(np.unique(v)) - 1, 12)
        counts, edges = np.histogram(v, n)
        assert np.allclose(got[key]["edges"], edges) and sum(got[key]["counts"]) == len(v) == got[key]["total"]
        assert np.abs(np.array(got[key]["counts"]) - counts).sum() <= 4  # last digit of an edge
    auto = {(r["dataset"], r["column"]): len(r["counts"]) for r in histograms(values).collect()}
    for key in (("d1", "a"), ("d2", "a")):
        assert abs(auto[key] - len(np.histogram_bin_edges(data[key], "auto")) + 1) <= 1
    stats = {(r["dataset"], r["column"]): r for r in moments(values).collect()}
    assert math.isclose(stats[("d1", "a")]["std"], data[("d1", "a")].std(ddof=1), rel_tol=1e-9)
    twice = histograms(values, F.lit(5), scaling=2.0).collect()
    assert len(twice) == 2 * len(got) and {r["copy"] for r in twice} == {1, 2}
    ids = with_ids(histograms(values, F.lit(5))).orderBy("dataset", "column").collect()
    assert [r["hist_id"] for r in ids] == list(range(len(got)))
    assert all(abs(sum(r["densities"]) - 1) < 1e-5 for r in densities(histograms(values, F.lit(5))).collect())


def test_numeric_columns_only(spark):
    df = spark.createDataFrame([("x", 1, 2.5, True)], "s string, i int, d double, b boolean")
    assert as_set(to_values(df, F.lit("t"))) == {("t", "i", 1.0), ("t", "d", 2.5)}


def test_empty_collections(spark):
    values = spark.createDataFrame([], "dataset string, column string, value double")
    hists = histograms(values, F.lit(5))
    assert hists.count() == 0 and moments(values).count() == 0 and with_ids(hists).count() == 0
    asked = q.to_frame(spark, off_edge(n=2))
    empty = spark.createDataFrame([], "hist_id long, edges array<double>, counts array<long>, total long")
    assert evaluate.scan(empty, asked).count() == 0


def test_normal(spark):
    dists = [(k, m, s) for k, (m, s) in enumerate([(0.0, 1.0), (5.0, 2.0), (-3.0, 0.5), (10.0, 20.0)])]
    asked = off_edge(5, 40)
    got = as_set(evaluate.normal(spark.createDataFrame(dists, "hist_id long, mean double, std double"), q.to_frame(spark, asked)))
    want = set()
    for k, x in enumerate(asked):
        for h, m, s in dists:
            z = (x.reference - m) / s
            share = 0.5 * math.erfc(-z / math.sqrt(2)) if x.op in ("lt", "le") else 0.5 * math.erfc(z / math.sqrt(2))
            if round(share, 4) >= float(np.float32(x.percentile)):
                want.add((k, h))
    assert got == want


def by_trapezoids(x, y, slopes, b):
    """The integral of cubics from the first knot to b, by their values alone."""
    grid = np.linspace(x[0], b, 4001)
    k = np.clip(np.searchsorted(x, grid, "right") - 1, 0, len(x) - 2)
    h = np.diff(x)[k]
    t = (grid - x[k]) / h
    values = y[k] * (1 - 3 * t**2 + 2 * t**3) + y[k + 1] * (3 * t**2 - 2 * t**3) + h * slopes[k] * (t - 2 * t**2 + t**3) + h * slopes[k + 1] * (t**3 - t**2)
    return ((values[1:] + values[:-1]) / 2 * np.diff(grid)).sum()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_spline_integrates_its_polynomials(counts):
    edges = np.cumsum([0.0, *[1.0 + k % 3 for k in range(len(counts))]])
    (x,), (y,), (slopes,), (upto,) = spline.fit(np.array([edges]), np.array([counts], float))
    for j in range(1, len(x)):
        assert math.isclose(upto[j], by_trapezoids(x, y, slopes, x[j]), rel_tol=1e-4, abs_tol=1e-4)
    inner = range(1, len(x) - 1)
    h = np.diff(x)
    for j in inner:  # second derivatives meet
        left = (2 * slopes[j - 1] + 4 * slopes[j]) / h[j - 1] - 6 * (y[j] - y[j - 1]) / h[j - 1] ** 2
        right = -(4 * slopes[j] + 2 * slopes[j + 1]) / h[j] + 6 * (y[j + 1] - y[j]) / h[j] ** 2
        assert math.isclose(left, right, rel_tol=1e-6, abs_tol=1e-6)


def test_spline_modes(spark, random_hists):
    hists, _ = random_hists
    asked = q.to_frame(spark, off_edge(n=6))
    assert evaluate.scan(hists, asked, "cubic_spline").count() > 0
    part = H.mass(F.col("edges"), F.col("counts"), F.col("cum"), F.col("op"), F.col("reference"), "cubic_spline", True, F.col("spline"))
    empty = spark.createDataFrame([(-1, [0.0, 1.0, 2.0, 4.0, 5.0], [3, 0, 0, 2], 5)], "hist_id long, edges array<double>, counts array<long>, total long")
    rows = spline.with_spline(prepared(hists.select(*empty.columns).unionByName(empty))).crossJoin(asked).withColumn("part", part)
    for r in rows.collect():
        e, v, s, ref = r["edges"], r["counts"], r["spline"], r["reference"]
        k = int(np.searchsorted(e, ref, "left")) - 1
        lower = r["op"] in ("lt", "le")
        if k < 0 or k == len(v):
            want = r["total"] if (k < 0) != lower else 0
        else:
            upto = lambda b: by_trapezoids(np.array(s["knots"]), np.array(s["values"]), np.array(s["slopes"]), b)  # noqa: B023, E731
            low = upto(e[k]) if k else 0.0
            share = (upto(ref) - low) / (upto(e[k + 1]) - low) if v[k] else 0.0
            want = sum(v[:k]) + v[k] * share if lower else sum(v[k + 1 :]) + v[k] * (1 - share)
        assert math.isclose(r["part"], want, abs_tol=0.01 * r["total"]), (r, want)
    members = hists.select(F.lit(0).alias("cluster_id"), "hist_id")
    clusters = clustering.cluster_edges(hists, members, 30, 1.0)
    sums = rebinned(hists, members, clusters, "cubic_spline").select(F.element_at("cum", -1).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-6 for r in sums)


def test_clustering(spark, random_hists):
    hists, _ = random_hists
    truth = None
    asked = q.to_frame(spark, off_edge(n=8))
    truth = as_set(evaluate.scan(hists, asked))
    for transform, algorithm, span in [(None, "kmeans", (1, 1)), ("standard", "kmeans", (2, 3)), ("robust", "bisecting", (3, 3)), ("quantile", "agglomerative", (2, 4)), ("power", "kmeans", (2, 2)), ("standard", "hdbscan", (2, 2))]:
        members, clusters = clustering.cluster_histograms(hists, 60, transform, algorithm, span)
        members, clusters = store.checkpointed(members, "members"), store.checkpointed(clusters, "clusters")
        k = clusters.count()
        assert members.select("hist_id").distinct().count() == hists.count() and sorted(r["cluster_id"] for r in clusters.collect()) == list(range(k))
        assert clustering.range_check(clusters).count() == 0 and clustering.predicted_size(clusters).first()[0] > 0
        assert as_set(evaluate.exact(hists, create_index(hists, members, clusters, "conversion"), clusters, members, asked)) == truth
    for transform in ("robust", "quantile"):
        clustering.transformed(clustering.features(hists), transform, compat=True).count()
    budget = clustering.cluster_edges(hists, members, 60, math.inf).select(F.size("edges")).distinct().count()
    assert budget == 1
    with pytest.raises(NotImplementedError):
        clustering.cluster_labels(clustering.features(hists), "optics", (2, 2))
    with pytest.raises(ValueError):
        clustering.transformed(clustering.features(hists), "umap")


def slow_density_groups(x, least):
    """The definition by thresholds: a group's parts are its components when its longest needed distances are cut."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))

    def parts(points, limit):
        left, out = set(points), []
        while left:
            part, edge = set(), [left.pop()]
            while edge:
                k = edge.pop()
                part.add(k)
                near = {j for j in left if d[k, j] < limit}
                left -= near
                edge += near
            out.append(part)
        return out

    def group(points, birth):
        own = 0.0
        while True:
            lengths = sorted({d[a, b] for a in points for b in points if a != b})
            cut = next(t for t in reversed(lengths) if len(parts(points, t)) > 1)
            large = [p for p in parts(points, cut) if len(p) >= least]
            if len(large) != 1:
                own += (1 / cut - birth) * len(points)
                return own, [(p, *group(p, 1 / cut)) for p in large]
            own += (1 / cut - birth) * (len(points) - len(large[0]))
            points = large[0]

    def best(points, own, below):
        found = [best(*b) for b in below]
        total = sum(s for s, _ in found)
        return (total, [g for _, gs in found for g in gs]) if total > own else (own, [points])

    return {frozenset(g) for b in group(set(range(len(x))), 0.0)[1] for g in best(*b)[1]}


def test_density_labels():
    rng = np.random.default_rng(4)
    several = 0
    for k in range(60):
        n, centres = int(rng.integers(8, 45)), rng.uniform(-6, 6, (int(rng.integers(1, 5)), 3))
        x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 3)) * rng.uniform(0.1, 2, (n, 1))
        least = int(rng.integers(2, 6))
        labels = clustering.density_labels(x, least)
        found = {frozenset(np.flatnonzero(labels == c).tolist()) for c in range(labels.max() + 1)}
        assert found == slow_density_groups(x, least), k
        several += len(found) > 1
    assert several > 20
    blobs = np.concatenate([np.full((6, 3), 1.0), np.full((7, 3), 9.0), [[40.0, 0, 0]]])
    assert clustering.density_labels(blobs).tolist() == [0] * 6 + [1] * 7 + [-1]
    assert clustering.density_labels(blobs, neighbours=3).tolist() == [0] * 6 + [1] * 7 + [-1]
    assert clustering.density_labels(np.zeros((0, 3))).tolist() == [] and clustering.density_labels(np.ones((3, 3))).tolist() == [-1] * 3


def test_metrics_conventions(spark):
    asked = q.to_frame(spark, [q.PercentileQuery(0.5, "lt", 1.0)] * 4)
    pairs = lambda rows: spark.createDataFrame(rows, "query_id long, hist_id long")
    truth, found = pairs([(2, 1), (3, 1), (3, 2)]), pairs([(1, 1), (3, 2), (3, 3)])
    got = {r["query_id"]: tuple(r)[1:] for r in metrics.accuracy(asked, truth, found).collect()}
    assert got == {0: (1.0, 1.0, 1.0), 1: (0.0, 1.0, 0.0), 2: (1.0, 0.0, 0.0), 3: (0.5, 0.5, 0.5)}
    assert metrics.mean_accuracy(metrics.accuracy(asked, truth, found)).first()["precision"] == 0.625
    assert metrics.mean_difference(asked, truth, found).first()[0] == 1.0
    assert as_set(filters.both(truth, found)) == {(3, 2)} and as_set(filters.one_of(truth, found)) == {(1, 1), (2, 1), (3, 1), (3, 3)}
    assert as_set(filters.either(truth, found)) == {(1, 1), (2, 1), (3, 1), (3, 2), (3, 3)} and as_set(filters.without(truth, found)) == {(2, 1), (3, 1)}
    assert {r["query_id"]: r["selectivity"] for r in metrics.selectivity(asked, truth, 4).collect()} == {0: 0.0, 1: 0.0, 2: 0.25, 3: 0.5}


def points_of(k, n, rng):
    """Spread, rounded, on a line, of very different scales, in far groups."""
    x = rng.normal(size=(n, 3))
    return [x, np.round(x, 1), np.round(x) * [1, 0, 0], x * rng.uniform(0, 1, (n, 1)) ** 6 * 1e31, x * 1e-3 + rng.uniform(-6, 6, (4, 3))[rng.integers(0, 4, n)]][k]


def test_shortest_tree_against_all_distances():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 33, 64, 65, 700):
        for k in range(5):
            x = points_of(k, n, rng)
            length, a, b = shortest_tree(x)
            assert length.tolist() == [w for w, _, _ in clustering._spanning_tree(x)], (n, k)
            top = list(range(n))
            assert all(clustering.joined(top, p, q) for p, q in zip(a.tolist(), b.tolist())) and clustering.numbered(top).max() == 0


def clusters_of(labels, keep=lambda label: True):
    out = {}
    for h, label in labels:
        out.setdefault(label, set()).add(h)
    return {frozenset(v) for k, v in out.items() if keep(k)}


def rows_of(spark, x):
    rows = [(7 * i + 3, *map(float, p)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "hist_id long, low double, high double, width double")


def test_single_linkage_of_many_histograms(spark):
    """7,200 histograms at 1,200 places against the merges over all distances."""
    rng = np.random.default_rng(9)
    places = points_of(0, 1200, rng) * 0.3 + rng.uniform(-9, 9, (5, 3))[rng.integers(0, 5, 1200)]
    x = places[rng.permutation(np.arange(7200) % 1200)]
    want = (-math.inf, None)
    for k in (2, 3, 4, 5, 6):
        top = list(range(1200))
        for _, a, b in clustering._spanning_tree(places)[: 1200 - k]:
            clustering.joined(top, a, b)
        at = {tuple(p): g for p, g in zip(places, clustering.numbered(top))}
        label = np.array([at[tuple(p)] for p in x])
        means = np.stack([x[label == c].mean(axis=0) for c in range(k)])
        score = (np.bincount(label)[:, None] * (means - x.mean(axis=0)) ** 2).sum() / (k - 1) / (((x - means[label]) ** 2).sum() / (7200 - k))
        want = max(want, (score, clusters_of((7 * i + 3, g) for i, g in enumerate(label))), key=lambda w: w[0])
    got = clustering.cluster_labels(rows_of(spark, x), "agglomerative", (2, 6)).collect()
    assert len(got) == 7200 and clusters_of(got) == want[1]


def test_single_linkage_of_few_places(spark):
    """With more clusters than places histograms at one place part; with more than histograms there is one cluster."""
    rows = rows_of(spark, np.array([[0.0, 1, 1]] * 3 + [[5.0, 6, 1]] * 2))
    of = lambda k: clusters_of(clustering.cluster_labels(rows, "agglomerative", (k, k)).collect())
    assert of(2) == {frozenset({3, 10, 17}), frozenset({24, 31})} and sorted(map(len, of(4))) == [1, 1, 1, 2] and len(of(5)) == 5 and len(of(6)) == 1
    assert clustering.cluster_labels(rows.limit(0), "agglomerative", (2, 3)).count() == clustering.cluster_labels(rows.limit(0), "hdbscan", (2, 2)).count() == 0


def test_density_clusters_of_many_histograms(spark):
    """About 5,600 histograms, most of them copies: the groups of the definition over single points, and copies count as points."""
    rng = np.random.default_rng(10)
    for k in range(30):
        n, centres = int(rng.integers(8, 40)), rng.uniform(-6, 6, (int(rng.integers(1, 5)), 3))
        x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 3)) * rng.uniform(0.1, 2, (n, 1))
        copies = rng.choice([1, 2, 4, 5, 9], n)
        every = clustering.density_labels(np.repeat(x, copies, axis=0))
        assert np.repeat(clustering.density_labels(x, weights=copies), copies).tolist() == every.tolist(), k
    places = points_of(0, 2400, rng) * 0.2 + rng.uniform(-9, 9, (6, 3))[rng.integers(0, 6, 2400)]
    x = rng.permutation(np.repeat(places, rng.choice([1, 2, 3, 4, 5], 2400, p=[0.2, 0.3, 0.3, 0.18, 0.02]), axis=0))
    got = clustering.cluster_labels(rows_of(spark, x), "hdbscan", (2, 2)).collect()
    want = clustering.density_labels(x)
    assert len(x) > 5000 and (want < 0).any() and want.max() > 5
    assert sorted(map(tuple, got)) == [(7 * i + 3, g) for i, g in enumerate(want.tolist())]
    with pytest.raises(ValueError):
        clustering.density_labels(places, 5, 2, np.ones(900, int))


@pytest.mark.parametrize("name", ["e7_exact_linkage", "e7_exact_density"])
def test_exact_under_clusters_of_many_histograms(spark, tmp_path, name):
    """The registered queries over 1,300 suppliers, so 5,200 histograms."""
    from fractile.plans import catalog

    draw = lambda k, low, high: F.round(low + (high - low) * F.rand(k), 2).alias(catalog.MEASURES[k])
    rows = spark.range(1300 * 6).select((F.col("id") % 1300).alias("l_suppkey"), draw(0, 1, 50), draw(1, 900, 100_000), draw(2, 0, 0.5), draw(3, 0, 0.5))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found, truth = (store.checkpointed(catalog.queries()[n](spark, str(tmp_path)), "found") for n in (name, "e1_over"))
    assert truth.select("hist_id").distinct().count() > 5000 and truth.count() == found.count() and metrics.differing(truth, found).count() == 0


def overlapping_results(spark):
    """Two written results with four rows that only one has, and one row twice."""
    rows = spark.range(200_000).select((F.col("id") % 36).alias("query_id"), F.floor(F.col("id") / 36).alias("hist_id"))
    return store.checkpointed(rows.where("id >= 2"), "truth"), store.checkpointed(rows.where("id < 199998").unionByName(rows.limit(1)), "found")


def test_mean_difference_without_broadcasts(spark, capsys):
    """Files of results are far smaller than their rows, so that a join by their size would broadcast them."""
    mean = metrics.mean_difference(q.to_frame(spark, [q.PercentileQuery(0.5, "lt", 1.0)] * 36).coalesce(1), *overlapping_results(spark))
    assert mean.first()[0] == 4 / 36
    mean.explain()
    plan = capsys.readouterr().out
    assert "FileScan" in plan and "LeftAnti" not in plan


def test_differing_results_without_broadcasts(spark, capsys):
    """Each result once, as SQL's EXCEPT has it."""
    out = metrics.differing(*overlapping_results(spark))
    assert sorted(map(tuple, out.collect())) == [(0, 0, "second"), (1, 0, "second"), (199_998 % 36, 5555, "first"), (199_999 % 36, 5555, "first")]
    out.explain()
    plan = capsys.readouterr().out
    assert "FileScan" in plan and "Join" not in plan and "Broadcast" not in plan


def test_boolean_and_column_filters(spark):
    found = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "query_id long, hist_id long")
    every = spark.createDataFrame([(k,) for k in range(1, 6)], "hist_id long")
    ids = lambda e: {r[0] for r in filters.combined(found, e, every).collect()}
    assert ids(("and", 0, 1)) == {2} and ids(("or", 1, 2)) == {2, 3} and ids(("not", 0)) == {3, 4, 5} and ids(("and", ("not", 1), ("or", 0, 2))) == {1, 3}
    profiles = spark.createDataFrame([(1, "d", "price"), (2, "d", "age"), (3, "e", "price_eur")], "hist_id long, dataset string, column string")
    assert as_set(filters.in_columns(found, profiles, "price")) == {(0, 1), (2, 3)}
    assert as_set(filters.datasets_of(found, profiles)) == {(0, "d", 2), (1, "d", 1), (2, "e", 1)}
    assert filters.random_ids(every, 0.5).count() == 2
    with pytest.raises(ValueError):
        filters.random_ids(every, 0.0)


def test_queries(spark):
    assert q.parse(["0.5", "lt", "50"]) == q.PercentileQuery(0.5, "lt", 50.0)
    for bad in (["0", "lt", "1"], ["1.1", "gt", "1"], ["0.5", "eq", "1"], ["0.5", "lt"], ["x", "lt", "1"]):
        with pytest.raises(ValueError):
            q.parse(bad)
    made = q.generate(20, ("gt", "lt"), 10, (-5, 5), 42)
    with_session = q.generated(spark, 20, ("gt", "lt"), 10, (-5, 5), 42).orderBy("query_id").collect()
    assert [tuple(r)[1:] for r in with_session] == [(x.percentile, x.op, x.reference) for x in made]
    texts = ["0.5 lt 50", " 1  ge -2.5 ", "0 lt 1", "1.1 gt 1", "0.5 eq 1", "0.5 lt", "x lt 1", "0.5 lt y", "", "0.5 lt 1 2"]
    read = q.parsed(spark.createDataFrame([(t,) for t in texts], "said string")).collect()
    assert [r["valid"] for r in read] == [True, True] + [False] * 8 and tuple(read[1])[1:4] == (1.0, "ge", -2.5)
    assert len(made) == 400 and made == q.generate(20, ("gt", "lt"), 10, (-5, 5), 42)
    assert made[0].percentile == 0.05 and made[-1].percentile == 1.0 and all(-5 <= x.reference <= 5 for x in made)


def test_strata(spark):
    rows = spark.createDataFrame([(k, (k % 30) / 29) for k in range(300)], "query_id long, selectivity double")
    got = q.strata(rows, 3, 5).collect()
    assert len(got) == 24
    for s in ("low", "mid", "high"):
        own = sorted((r["query_id"], r["part"]) for r in got if r["stratum"] == s)
        assert [p for _, p in own] == ["validation"] * 3 + ["test"] * 5
    with pytest.raises(ValueError):
        q.strata(rows, 20, 20)


def test_store_and_streaming(spark, random_hists, tmp_path):
    from fractile.streaming import incremental

    hists, _ = random_hists
    members = hists.select(F.pmod("hist_id", F.lit(2)).cast("int").alias("cluster_id"), "hist_id")
    clusters = store.checkpointed(clustering.cluster_edges(hists, members, 25), "clusters")
    index = create_index(hists, members, clusters, "conversion")
    path = str(tmp_path / "index")
    assert not store.is_index(spark, path)
    store.save_index(index, clusters, members, path, "conversion")
    assert store.is_index(spark, path)
    again, c, m, method = store.load_index(spark, path)
    assert method == "conversion" and metrics.index_differences(index, again).count() == 0
    asked = q.to_frame(spark, off_edge(n=5))
    want = as_set(evaluate.probe(index, clusters, members, asked, method))
    assert as_set(evaluate.probe(again, c, m, asked, method)) == want
    store.save_results(asked, evaluate.probe(again, c, m, asked, method), path + "-results")
    assert as_set(store.load_results(spark, path + "-results")[1]) == want
    store.suppressed(evaluate.probe(again, c, m, asked, method))
    assert store.index_size(index).first()["n_bytes"] == 6 * index.count()
    source = str(tmp_path / "new")
    hists.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(hists.schema).option("maxFilesPerTrigger", 1).parquet(source)
    incremental.grow(stream, clusters, path, str(tmp_path / "check"), "conversion").awaitTermination()
    rows, own, beside = incremental.grown(spark, path)
    assert beside.isEmpty() and own.count() == hists.count() == own.select("hist_id").distinct().count()
    truth = as_set(evaluate.scan(hists, asked))
    assert as_set(evaluate.probe(rows, clusters, own, asked, "conversion", "precision")) <= truth <= as_set(evaluate.probe(rows, clusters, own, asked, "conversion", "recall"))
    whole, _, every, _ = store.load_index(spark, path)
    assert whole.count() == index.count() + rows.count() and every.count() == 2 * hists.count()
    gone = hists.where("hist_id < 100").select("hist_id")
    assert incremental.without_ids(own, gone).count() == 50


def test_growth_beyond_the_clusters_ranges(spark, tmp_path):
    """Histograms that reach beyond every cluster give the scan's answers in all modes."""
    from fractile.streaming import incremental

    schema = "hist_id long, edges array<double>, counts array<long>, total long"
    old = spark.createDataFrame([(k, [0.0 + k, 5.0, 10.0], [3, 7], 10) for k in range(4)], schema)
    members = old.select(F.lit(0).alias("cluster_id"), "hist_id")
    clusters = store.checkpointed(clustering.cluster_edges(old, members, 12), "clusters")
    path = str(tmp_path / "index")
    store.save_index(create_index(old, members, clusters, "conversion"), clusters, members, path, "conversion")
    new = spark.createDataFrame([(10, [5.0, 12.0, 20.0], [5, 5], 10), (11, [-4.0, 3.0], [6], 6), (12, [1.0, 2.0, 9.0], [1, 1], 2), (13, [30.0, 31.0], [1], 1)], schema)
    new.write.parquet(str(tmp_path / "new"))
    incremental.grow(spark.readStream.schema(schema).parquet(str(tmp_path / "new")), clusters, path, str(tmp_path / "check")).awaitTermination()
    asked = q.to_frame(spark, [q.PercentileQuery(p, op, r) for p in (0.3, 0.9) for op in OPS for r in (-5.0, -1.5, 4.3, 11.0, 15.2, 25.0, 40.0)])
    index, c, m, method = store.load_index(spark, path)
    beside = store.load_outliers(spark, path)
    assert {r["hist_id"] for r in beside.collect()} == {10, 11, 13}
    every = old.unionByName(new)
    truth = as_set(evaluate.scan(every, asked))
    found = lambda mode: as_set(evaluate.run(asked, "index", index=index, clusters=c, members=m, method=method, index_mode=mode, outliers=beside))
    assert found("precision") <= truth <= found("recall")
    assert as_set(evaluate.run(asked, "exact", hists=every, index=index, clusters=c, members=m, method=method, outliers=beside)) == truth


def test_a_probe_reads_what_it_asks_for(spark, random_hists, tmp_path, capsys):
    hists, _ = random_hists
    members = hists.select(F.pmod("hist_id", F.lit(3)).cast("int").alias("cluster_id"), "hist_id")
    clusters = store.checkpointed(clustering.cluster_edges(hists, members, 90), "clusters")
    path = str(tmp_path / "index")
    store.save_index(create_index(hists, members, clusters, "rebinning"), clusters, members, path, "rebinning")
    index, c, m, method = store.load_index(spark, path)
    asked = q.to_frame(spark, [q.PercentileQuery(0.8, "lt", 4.21)])
    evaluate.probe(index, c, m, asked, method).explain("formatted")
    plan = capsys.readouterr().out
    scan = plan[plan.index("PartitionFilters") :]
    assert "cluster_id" in scan.splitlines()[0] and " IN (" in scan.splitlines()[0] or "In(cluster_id" in plan
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters") and "pctl4" in line)
    assert "GreaterThanOrEqual(pctl4" in pushed and "EqualTo(bin_no" in pushed and "EqualTo(variant,rebin)" in pushed
    many = q.to_frame(spark, q.generate(10, OPS, 60, (-10, 30), 3))
    for mode in ("recall", "precision"):  # beyond the limits of literals too
        want = as_set(evaluate.probe(index, c, m, many, method, mode))
        for routes, terms in ((evaluate.LITERAL_ROUTES, 2), (3, 2)):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(evaluate, "LITERAL_ROUTES", routes)
                patch.setattr(evaluate, "LITERAL_TERMS", terms)
                assert as_set(evaluate.probe(index, c, m, many, method, mode)) == want


def test_skyline_against_all_pairs(spark):
    rng = random.Random(3)
    for n in (0, 1, 40, 300):
        rows = [(k, rng.randrange(12) / 2, rng.randrange(12)) for k in range(n)]
        got = {r["k"] for r in metrics.skyline(spark.createDataFrame(rows, "k int, a double, b int").repartition(3), "a", "b").collect()}
        assert got == {k for k, a, b in rows if not any(x >= a and y <= b and (x > a or y < b) for _, x, y in rows)}


def test_files_and_logs(spark, tmp_path):
    from fractile.sources import files

    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "one.csv").write_text("a,b,s\n1,2.5,x\n2,3.5,y\n")
    (tmp_path / "csv" / "two.csv").write_text("v\n10\n20\n30\n")
    (tmp_path / "csv" / "bad.csv").write_text("")
    errors = files.csv_to_parquet(spark, str(tmp_path / "csv"), str(tmp_path / "pq"))
    assert all("bad.csv" in r["file"] for r in errors.collect())
    (tmp_path / "pq" / "no.parquet").write_text("not one")
    import pandas as pd

    for k in range(30):  # of one schema, with a name that is written otherwise in paths
        pd.DataFrame({"v": [float(k)]}).to_parquet(tmp_path / "pq" / f"a +{k} %.parquet")
    values, failed = files.read_collection(spark, str(tmp_path / "pq"))
    assert [r["file"].endswith("no.parquet") for r in failed.collect()] == [True]
    assert as_set(values) >= {(f"a +{k} %", "v", float(k)) for k in range(30)}
    assert as_set(values) >= {("one", "a", 1.0), ("one", "b", 3.5), ("two", "v", 30.0)}
    (tmp_path / "h.json").write_text('{"hist_id": 1, "edges": [0, 1, 2], "counts": [3, 4]}\n')
    assert files.read_histograms(spark, str(tmp_path / "h.json")).first()["total"] == 7
    log = tmp_path / "x.log"
    log.write_text("t | INFO | hello\nt | TRACE | query_time, 0.5\nt | TRACE | query_time, 0.7\nt | TRACE | query_collection_time, 1.5\nt | TRACE | query_collection_time, 2.5\nplain\n")
    assert files.logs_long(spark, str(log)).count() == 4 and files.logs_times(spark, str(log)) == [1.5, 2.5]
    with pytest.raises(Exception, match="more than one line"):
        files.logs_wide(spark, str(log)).collect()
    log.write_text("t | TRACE | query_time, 0.5\nt | TRACE | query_time, 0.7\nt | TRACE | size, 3\n")
    assert {r["metric"]: r["values"] for r in files.logs_wide(spark, str(log)).collect()} == {"query_time": [0.5, 0.7], "size": [3.0]}


@pytest.mark.parametrize("left_out", [("llm", "corpus_pipeline.py"), ("llm",), ("corpus_pipeline.py",)])
def test_entry_without_the_optional_subpackage(tmp_path, left_out):
    """The entry module works when fractile/llm, the pipeline or both are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "fractile", tmp_path / "fractile", ignore=shutil.ignore_patterns(*left_out, "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 30 and out[1:] == ["True", "False"]


def test_scan_reads_only_what_it_needs(spark, capsys):
    from fractile.plans import catalog

    catalog.queries()["e1_over"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    schema = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "l_comment" not in schema and "l_shipdate" not in schema
    assert "EvalPython" not in plan and "InPandas" not in plan


def test_command_line(spark, tmp_path, capsys):
    from fractile.__main__ import main

    rng = np.random.default_rng(6)
    (tmp_path / "csv").mkdir()
    for k in range(4):
        lines = ["a,b,s"] + [f"{x:.3f},{y},t" for x, y in zip(rng.normal(k, 2, 200), rng.integers(0, 90, 200))]
        (tmp_path / "csv" / f"d{k}.csv").write_text("\n".join(lines) + "\n")
    p = {n: str(tmp_path / n) for n in ("csv", "data", "hists", "dists", "clusters", "index", "binsort", "ids", "queries", "truth", "found", "exact", "metrics")}
    run = lambda *args: main([str(x) for x in args], spark)
    run("to-parquet", "-i", p["csv"], "-o", p["data"])
    run("compute-histograms", "-i", p["data"], "-o", p["hists"], "--bin-range", 10, 20)
    run("compute-distributions", "-i", p["data"], "-o", p["dists"])
    run("cluster-histograms", "-i", p["hists"], "-o", p["clusters"], "-b", 60, "-n", 2, 2, "-t", "standard")
    run("create-index", "-i", p["hists"], "-c", p["clusters"], "-o", p["index"], "-m", "conversion")
    run("compute-binsort", "-i", p["hists"], "-o", p["binsort"])
    run("filter-histograms", "-i", p["hists"], "-o", p["ids"], "-s", 0.5)
    run("generate-queries", "-o", p["queries"], "--n-percentiles", 4, "--n-references", 5, "--bounds", -5, 80)
    run("run", "-t", "histograms", "-i", p["hists"], "-q", p["queries"], "-o", p["truth"])
    run("run", "-t", "exact", "-i", p["hists"], "-x", p["index"], "-q", p["queries"], "-o", p["exact"])
    run("run", "-t", "index", "-x", p["index"], "--query", "0.5", "lt", "3.3", "-o", p["found"])
    run("run", "-t", "normal_dists", "-i", p["dists"], "-q", p["queries"], "--suppress-results")
    run("run", "-t", "binsort", "-i", p["binsort"], "-q", p["queries"], "--hist-filter", p["ids"], "--suppress-results")
    run("run", "-t", "rebinned_hists", "-i", p["hists"], "-c", p["clusters"], "-q", p["queries"], "-e", "continuous_value", "--suppress-results")
    run("query-metrics", "-i", p["hists"], "-r", p["truth"], "-c", p["clusters"], "-o", p["metrics"])
    capsys.readouterr()
    run("compare-results", p["truth"], p["exact"])
    assert "differing results: 0" in capsys.readouterr().out
    run("compare-indexes", p["index"], p["index"])
    assert "differing entries: 0" in capsys.readouterr().out
    assert spark.read.parquet(p["metrics"]).count() == 40 and spark.read.parquet(p["ids"]).count() == 4
    with pytest.raises(SystemExit):
        run("run", "-t", "nothing")
