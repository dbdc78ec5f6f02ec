"""Command line: python -m fractile COMMAND ... Every table is a Parquet path."""

from __future__ import annotations

import argparse
import math
import time

from pyspark.sql import DataFrame, SparkSession

from fractile.operators import clustering, filters, metrics
from fractile.operators import queries as q
from fractile.operators.index import METHODS, binsort, create_index, verify
from fractile.operators.profiles import densities, histograms, moments, random_bins, with_ids
from fractile.plans import evaluate, store
from fractile.sources import files


def _collection(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    values, errors = files.read_collection(spark, a.input)
    for r in errors.toLocalIterator():
        print(f"skipped {r['file']}: {r['error']}")
    return values


def to_parquet(spark, a):
    for r in files.csv_to_parquet(spark, a.input, a.output).toLocalIterator():
        print(f"failed {r['file']}: {r['error']}")


def compute_histograms(spark, a):
    bins = random_bins(*a.bin_range, a.seed) if a.bin_range else None
    hists = with_ids(histograms(_collection(spark, a), bins, scaling=a.scaling_factor, seed=a.seed), *(("dataset", "column") if a.scaling_factor == 1 else ("dataset", "column", "copy")))
    store.save(hists if a.compute_frequencies else densities(hists), a.output)


def compute_distributions(spark, a):
    store.save(with_ids(moments(_collection(spark, a))), a.output)


def cluster(spark, a):
    members, clusters = clustering.cluster_histograms(store.load(spark, a.input), a.bin_budget, a.transform, a.algorithm, tuple(a.n_clusters), a.alpha, a.seed)
    store.save(members, f"{a.output}/members")
    store.save(clusters, f"{a.output}/clusters")
    clusters = store.load(spark, f"{a.output}/clusters")
    print(f"predicted index size: {clustering.predicted_size(clusters).first()[0]} bytes; moved ranges: {clustering.range_check(clusters).count()}")


def build_index(spark, a):
    members, clusters = store.load(spark, f"{a.clustering}/members"), store.load(spark, f"{a.clustering}/clusters")
    store.save_index(create_index(store.load(spark, a.input), members, clusters, a.method, a.estimation), clusters, members, a.output, a.method)
    index = store.load_index(spark, a.output)[0]
    for r in [*verify(index).collect(), *store.index_size(index).collect()]:
        print(r.asDict())


def build_binsort(spark, a):
    store.save(binsort(store.load(spark, a.input)).repartitionByRange("edge").sortWithinPartitions("edge"), a.output)


def filter_ids(spark, a):
    store.save(filters.random_ids(store.load(spark, a.input), a.selectivity, a.seed), a.output)


def make_queries(spark, a):
    store.save(q.generated(spark, a.n_percentiles, a.operators, a.n_references, tuple(a.bounds), a.seed), a.output)


def run_queries(spark, a):
    asked = q.to_frame(spark, [q.parse(a.query)]) if a.query else store.load(spark, a.queries)
    given: dict = {"hist_filter": store.load(spark, a.hist_filter) if a.hist_filter else None}
    if a.type in ("index", "exact"):
        given["index"], given["clusters"], given["members"], given["method"] = store.load_index(spark, a.index)
        given["outliers"] = store.load_outliers(spark, a.index)
    if a.type in ("rebinned_hists", "conversion_matrices"):
        given["members"], given["clusters"] = store.load(spark, f"{a.clustering}/members"), store.load(spark, f"{a.clustering}/clusters")
    if a.type in ("histograms", "rebinned_hists", "conversion_matrices", "exact"):
        given["hists"] = store.load(spark, a.input)
    if a.type == "normal_dists":
        given["dists"] = store.load(spark, a.input)
    if a.type == "binsort":
        given["sorted_bins"] = store.load(spark, a.input)
    start = time.perf_counter()
    found = evaluate.run(asked, a.type, estimation_mode=a.estimation_mode, index_mode=a.index_mode, **given)
    if a.suppress_results:
        store.suppressed(found)
    else:
        store.save_results(asked, found, a.output)
    print(f"query_collection_time, {time.perf_counter() - start:.6f}")


def compare(spark, a):
    asked, truth = store.load_results(spark, a.truth)
    _, found = store.load_results(spark, a.found)
    for df in (metrics.mean_accuracy(metrics.accuracy(asked, truth, found)), metrics.mean_difference(asked, truth, found)):
        print(df.first().asDict())
    print(f"differing results: {metrics.differing(truth, found).count()}")


def compare_indexes(spark, a):
    n = metrics.index_differences(store.load_index(spark, a.first)[0], store.load_index(spark, a.second)[0], a.tolerance).count()
    print(f"differing entries: {n}")


def query_metrics(spark, a):
    asked, found = store.load_results(spark, a.results)
    hists = store.load(spark, a.input)
    out = metrics.selectivity(asked, found, hists.count()).join(metrics.edge_matches(asked, hists), "query_id")
    if a.clustering:
        out = out.join(metrics.cluster_hits(asked, store.load(spark, f"{a.clustering}/clusters")), "query_id")
    store.save(out, a.output)


def collate(spark, a):
    store.save(q.strata(store.load(spark, a.input), a.n_validation, a.n_test, a.seed), a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fractile")
    commands = top.add_subparsers(required=True)

    def add(name, run, *options):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for flags, kw in options:
            sub.add_argument(*flags, **kw)

    opt = lambda *flags, **kw: (flags, kw)
    io = (opt("-i", "--input", required=True), opt("-o", "--output", required=True))
    seed = opt("--seed", type=int, default=42)
    clustered = opt("-c", "--clustering")
    add("to-parquet", to_parquet, *io)
    add("compute-histograms", compute_histograms, *io, seed, opt("--bin-range", type=int, nargs=2), opt("--scaling-factor", type=float, default=1.0), opt("--compute-frequencies", action="store_true"))
    add("compute-distributions", compute_distributions, *io)
    add("cluster-histograms", cluster, *io, seed, opt("-a", "--algorithm", default="kmeans", choices=["kmeans", "bisecting", "agglomerative", "hdbscan"]), opt("-n", "--n-clusters", type=int, nargs=2, default=(1, 1)), opt("-b", "--bin-budget", type=int, required=True), opt("-t", "--transform", choices=["none", "standard", "robust", "quantile", "power"]), opt("--alpha", type=float, default=1.0, help=f"up to {math.inf}"))
    add("create-index", build_index, *io, (clustered[0], {"required": True}), opt("-m", "--method", default="rebinning", choices=[m + s for m in METHODS for s in ("", "-shm")]), opt("-e", "--estimation", default="continuous_value", choices=["continuous_value", "cubic_spline"]))
    add("compute-binsort", build_binsort, *io)
    add("filter-histograms", filter_ids, *io, seed, opt("-s", "--selectivity", type=float, required=True))
    add("generate-queries", make_queries, opt("-o", "--output", required=True), seed, opt("--n-percentiles", type=int, default=20), opt("--n-references", type=int, default=100), opt("--operators", nargs="+", default=["gt", "lt"], choices=q.OPERATORS), opt("--bounds", type=float, nargs=2, default=(-1000.0, 1000.0)))
    kinds = ["histograms", "rebinned_hists", "conversion_matrices", "index", "normal_dists", "binsort", "exact"]
    add("run", run_queries, opt("-t", "--type", required=True, choices=kinds), opt("-i", "--input"), opt("-x", "--index"), clustered, opt("-q", "--queries"), opt("--query", nargs=3), opt("-o", "--output"), opt("-e", "--estimation-mode", default="over"), opt("-m", "--index-mode", default="recall", choices=["recall", "precision"]), opt("--hist-filter"), opt("--suppress-results", action="store_true"))
    add("compare-results", compare, opt("truth"), opt("found"))
    add("compare-indexes", compare_indexes, opt("first"), opt("second"), opt("--tolerance", type=int, default=0))
    add("query-metrics", query_metrics, *io, opt("-r", "--results", required=True), clustered)
    add("collate-queries", collate, *io, seed, opt("--n-validation", type=int, default=100), opt("--n-test", type=int, default=333))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("fractile").getOrCreate(), a)


if __name__ == "__main__":
    main()
