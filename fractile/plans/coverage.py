"""Further registered queries and their SQL: stored indexes, sources, transforms, profiles, filters, metrics, analysis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fractile.operators import analysis, clustering, filters, metrics, queries as q
from fractile.operators.index import binsort, conversion, create_index
from fractile.operators.profiles import densities, histograms, with_ids
from fractile.plans import catalog, evaluate, store
from fractile.plans.catalog import MEASURES, OFF_EDGE, _base, _CLUSTERS, _e1, _e4, _hists, _lineitem, _rows, _table, bins_of, collection, values
from fractile.sources.files import csv_to_parquet, read_collection

PRIORITIES = ("5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH")
SAID = ["0.5 lt 50", " 1  ge -2.5 ", "0 lt 1", "1.1 gt 1", "0.25 eq 1", "0.5 lt", "x lt 1", "0.5 gt y", "", "0.75 le 1e3"]
GENERATED = (4, ("gt", "lt"), 5, (-10.0, 10.0), 42)

_stores: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the histograms and an index of each method over them, made once a session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        path = store.scratch_path(spark, "stored")
        hists, members, clusters = _base(spark, sf_dir)
        store.save(hists, f"{path}/hists")
        for method in ("rebinning", "conversion"):
            store.save_index(create_index(hists, members, clusters, method), clusters, members, f"{path}/{method}", method)
        _stores[key] = path
    return _stores[key]


def _stored_probe(method: str, mode: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        index, clusters, members, name = store.load_index(spark, f"{stored(spark, sf_dir)}/{method}")
        return evaluate.probe(index, clusters, members, q.to_frame(spark, OFF_EDGE), name, mode)

    return query


def _stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scan(store.load(spark, f"{stored(spark, sf_dir)}/hists"), q.to_frame(spark, OFF_EDGE))


def _stored_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored(spark, sf_dir)
    index, clusters, members, name = store.load_index(spark, f"{path}/conversion")
    return evaluate.exact(store.load(spark, f"{path}/hists"), index, clusters, members, q.to_frame(spark, OFF_EDGE), name)


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, clusters, members, name = store.load_index(spark, f"{stored(spark, sf_dir)}/conversion")
    return evaluate.trace(index, clusters, members, q.to_frame(spark, OFF_EDGE), name, "recall")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written and read back with their queries."""
    path = store.scratch_path(spark, "results")
    store.save_results(q.to_frame(spark, OFF_EDGE), _stored_scan(spark, sf_dir), path)
    asked, found = store.load_results(spark, path)
    return found.join(asked, "query_id").groupBy("query_id", "percentile", "op", "reference").agg(F.count(F.lit(1)).alias("n"))


def _run_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    ids = store.checkpointed(filters.random_ids(hists, 0.25, 42), "ids")
    return evaluate.run(q.to_frame(spark, OFF_EDGE), "index", index=create_index(hists, members, clusters, "conversion"), clusters=clusters, members=members, method="conversion", hist_filter=ids)


def _prefiltered(kind: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hists = store.load(spark, f"{stored(spark, sf_dir)}/hists")
        ids, asked = store.checkpointed(filters.random_ids(hists, 0.25, 42), "ids"), q.to_frame(spark, OFF_EDGE)
        if kind == "scan":
            return evaluate.scan(filters.keep_ids(hists, ids), asked)
        return evaluate.binsort_scan(filters.keep_ids(binsort(hists), ids), asked, "recall")

    return query


def _in_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists = store.load(spark, f"{stored(spark, sf_dir)}/hists")
    names = F.element_at(F.lit(list(MEASURES)), (F.pmod("hist_id", F.lit(4)) + 1).cast("int"))
    profiles = hists.select("hist_id", F.floor(F.col("hist_id") / 4).cast("string").alias("dataset"), names.alias("column"))
    return filters.in_columns(_stored_scan(spark, sf_dir), profiles, "price|tax")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return q.to_frame(spark, OFF_EDGE), store.checkpointed(_stored_scan(spark, sf_dir), "truth"), store.checkpointed(_stored_probe("rebinning", "recall")(spark, sf_dir), "found")


def _differing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, truth, found = _sides(spark, sf_dir)
    return metrics.differing(truth, found)


def _mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, truth, found = _sides(spark, sf_dir)
    means = metrics.mean_accuracy(metrics.accuracy(asked, truth, found)).crossJoin(metrics.mean_difference(asked, truth, found))  # a row each
    return means.select(*[F.round(c, 9).alias(c) for c in means.columns])


def _reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored(spark, sf_dir)
    index, clusters, members, name = store.load_index(spark, f"{path}/conversion")
    rows = evaluate.bounded(index, clusters, members, q.to_frame(spark, OFF_EDGE), name)
    sure = rows.where("sure = 1").select("query_id", "hist_id")
    n = store.load(spark, f"{path}/hists").count()
    return evaluate.reduction(sure, rows.select("query_id", "hist_id"), n).select("query_id", F.round("reduction", 9).alias("reduction"))


def _index_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    index = store.checkpointed(create_index(hists, members, clusters, "rebinning"), "index")
    other = index.where("hist_id % 7 <> 0").withColumn("pctl4", F.when(F.col("hist_id") % 11 == 0, F.least(F.col("pctl4") + 3, F.lit(10_000))).otherwise(F.col("pctl4")).cast("smallint"))
    return metrics.index_differences(index, other, 1).select("cluster_id", "bin_no", "hist_id", F.col("p").cast("int").alias("p"), F.col("q").cast("int").alias("q"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.features(collection(spark, sf_dir))


def _transform(name: str, compat: bool = False) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = clustering.transformed(store.checkpointed(_features(spark, sf_dir), "features"), name, compat=compat)
        return rows.select("hist_id", *[F.round(c, 5).alias(c) for c in clustering.FEATURES])

    return query


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.checkpointed(_features(spark, sf_dir), "features").withColumn("label", (F.pmod("hist_id", F.lit(4)) * 10 - 7).cast("int"))


def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Calinski-Harabasz score of three clusterings: by measure, by pairs of measures, by parity of suppliers."""
    rows = _labelled(spark, sf_dir)
    ways = {"measure": F.col("label"), "pair": (F.pmod("hist_id", F.lit(4)) < 2).cast("int"), "parity": F.pmod(F.floor(F.col("hist_id") / 4), F.lit(2)).cast("int")}
    return spark.createDataFrame([(k, round(float(clustering.calinski_harabasz(rows.withColumn("label", c))), 4)) for k, c in ways.items()], "clustering string, score double")


def _linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage of all histograms into three clusters by width alone: of one feature, the two longest gaps part them."""
    rows = store.checkpointed(_features(spark, sf_dir), "features").withColumns({"low": F.lit(0.0), "high": F.lit(0.0)})
    return clustering.members(clustering.cluster_labels(rows, "agglomerative", (3, 3))).groupBy("cluster_id").agg(F.min("hist_id").alias("first_id"), F.count(F.lit(1)).alias("n")).select("first_id", "n")


def _size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.predicted_size(_base(spark, sf_dir)[2])


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters whose outer edges were moved by up to 3e-4, found where that is over 1e-4."""
    clusters = _base(spark, sf_dir)[2]
    moved = F.concat(F.array(F.element_at("edges", 1) - F.col("cluster_id") * 1e-4), F.slice("edges", 2, F.size("edges")))
    return clustering.range_check(clusters.withColumn("edges", moved)).select("cluster_id")


def _auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms(values(spark, sf_dir), None, keys=("hist_id",)).select("hist_id", F.size("counts").cast("long").alias("n_bins"))


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms(values(spark, sf_dir), bins_of(), keys=("hist_id",), scaling=3.0).select("hist_id", F.col("copy").cast("long").alias("copy"), F.size("counts").cast("long").alias("n_bins"), "total")


def _densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = densities(collection(spark, sf_dir)).select("hist_id", F.posexplode("densities").alias("bin_no", "d"))
    return rows.select("hist_id", F.col("bin_no").cast("long").alias("bin_no"), F.round(F.col("d").cast("double"), 6).alias("density"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of columns in the order of their datasets' and own names."""
    rows = values(spark, sf_dir).select(F.floor(F.col("hist_id") / 4).cast("string").alias("dataset"), F.element_at(F.lit(list(MEASURES)), (F.pmod("hist_id", F.lit(4)) + 1).cast("int")).alias("column"), "value")
    return with_ids(histograms(rows, F.lit(10))).select("dataset", "column", "hist_id")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    rows = conversion(hists, members, clusters).select("hist_id", F.posexplode("matrix").alias("bin_no", "m"))
    return rows.select("hist_id", F.col("bin_no").cast("long").alias("bin_no"), F.col("m.first").cast("long").alias("first"), F.col("m.last").cast("long").alias("last"))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.generated(spark, *GENERATED)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.parsed(spark.createDataFrame([(x,) for x in SAID], "said string"))


def _collection_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as CSV, converted, and read as a collection of datasets."""
    path = store.scratch_path(spark, "files")
    for name in ("supplier", "customer", "nation"):
        _table(spark, sf_dir, name).write.csv(f"{path}/csv/{name}.csv", header=True)
    csv_to_parquet(spark, f"{path}/csv", f"{path}/parquet")
    rows, _ = read_collection(spark, f"{path}/parquet")
    return rows.groupBy("dataset", "column").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _three_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    keys = ["l_suppkey", "l_linenumber", "l_linestatus"]
    of = lambda flag, name: items.where(F.col("l_returnflag") == flag).groupBy(*keys).agg(F.sum("l_quantity").alias(name))
    return analysis.joined_runs(of("R", "returned"), of("N", "kept"), keys, ("returned", "kept"), "total")


def _construction(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return analysis.with_construction(orders, _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "o_custkey", "c_custkey")


def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysis.mean_ratio(_table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")
    return rows.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("l_extendedprice", "l_quantity", "ratio")])


def _five_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_discount"]
    return analysis.group_means(_table(spark, sf_dir, "lineitem"), keys, "l_quantity").withColumn("l_quantity", F.round("l_quantity", 6))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return analysis.in_order(rows, "o_orderpriority", PRIORITIES).select(F.col("position").cast("long").alias("position"), "o_orderpriority", "n")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(analysis.nested_sum("embedding"), 4).alias("total"))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.sample(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "e1_stored": _stored_scan,
        "e4_stored_rebinning_recall": _stored_probe("rebinning", "recall"),
        "e4_stored_rebinning_precision": _stored_probe("rebinning", "precision"),
        "e4_stored_conversion_recall": _stored_probe("conversion", "recall"),
        "e4_stored_conversion_precision": _stored_probe("conversion", "precision"),
        "e4_traced": _trace,
        "e7_stored": _stored_exact,
        "e7_reduction": _reduction,
        "results_stored": _results,
        "run_index_filtered": _run_filtered,
        "filter_scan": _prefiltered("scan"),
        "filter_binsort": _prefiltered("binsort"),
        "filter_columns": _in_columns,
        "metrics_differing": _differing,
        "metrics_mean_quality": _mean_quality,
        "index_differences": _index_differences,
        "cluster_features": _features,
        "transform_standard": _transform("standard"),
        "transform_robust": _transform("robust"),
        "transform_quantile_compat": _transform("quantile", True),
        "transform_power": _transform("power"),
        "cluster_choice": _choice,
        "cluster_linkage": _linkage,
        "cluster_members": lambda s, d: clustering.members(_labelled(s, d).select("hist_id", "label")),
        "cluster_size": _size,
        "cluster_range_check": _range,
        "profile_automatic_bins": _auto,
        "profile_copies": _copies,
        "profile_densities": _densities,
        "profile_ids": _ids,
        "index_conversion_matrix": _matrix,
        "queries_generated": _generated,
        "queries_parsed": _parsed,
        "source_files": _collection_of_files,
        "analysis_three_keys": _three_keys,
        "analysis_construction": _construction,
        "analysis_mean_ratio": _ratio,
        "analysis_five_keys": _five_keys,
        "analysis_row_order": _ordered,
        "analysis_nested_sum": _nested,
        "analysis_sample": _sampled,
    }


def _e3() -> str:
    """By the matrices' definition: old bins that overlap the cluster bins up to the reference's, or from it on."""
    low = "op IN ('lt', 'le')"
    over = "CASE WHEN {low} THEN list_filter(range(1, len(counts) + 1), lambda i: edges[i] < new[b + 2] AND edges[i + 1] > new[1]) ELSE list_filter(range(1, len(counts) + 1), lambda i: edges[i + 1] > new[b + 1] AND edges[i] < new[-1]) END".format(low=low)
    return f"""{_hists(_lineitem("l_suppkey"))}, {_CLUSTERS},
q(query_id, p, op, ref) AS (VALUES {_rows(OFF_EDGE)}),
j AS (SELECT *, greatest(len(list_filter(new, lambda e: e < ref)) - 1, 0) AS b FROM a, q),
o AS (SELECT *, coalesce(list_sum(list_transform({over}, lambda i: counts[i])), 0) / total AS share FROM j),
found AS (SELECT query_id, hist_id FROM o WHERE CASE WHEN ref < new[1] THEN NOT ({low}) WHEN ref > new[-1] THEN {low} ELSE round_even(share * 1e4, 0) >= round_even(p * 1e4, 0) END)"""


def oracle_sql() -> dict[str, str]:
    h = _hists(_lineitem("l_suppkey"))
    found = lambda text: f"WITH {text} SELECT query_id::BIGINT AS query_id, hist_id FROM found"
    truth = lambda text, keep="true": f"WITH {text} SELECT query_id::BIGINT AS query_id, hist_id FROM truth WHERE {keep}"
    base = catalog.oracle_sql()
    drawn = base["filter_random_ids"].split(" ", 1)[1]
    ids = f"hist_id IN (WITH {drawn})"
    sides = f"{_e1(OFF_EDGE, 'over')}, found AS (SELECT * FROM (WITH {_e4('rebinning', 'recall')} SELECT query_id, hist_id FROM found))"
    bounds = f"sure AS (SELECT * FROM (WITH {_e4('conversion', 'precision')} SELECT query_id, hist_id FROM found)), maybe AS (SELECT * FROM (WITH {_e4('conversion', 'recall')} SELECT query_id, hist_id FROM found))"
    features = f"{h}, f AS (SELECT hist_id, edges[1] AS low, edges[-1] AS high, (edges[-1] - edges[1]) / len(counts) AS width FROM h)"
    each = lambda of: ", ".join(f"round({of.format(c=c)}, 5) AS {c}" for c in clustering.FEATURES)
    labels = {"measure": "hist_id % 4", "pair": "(hist_id % 4 < 2)::INT", "parity": "(hist_id // 4) % 2"}
    total = lambda name: " + ".join(name.format(c=c) for c in clustering.FEATURES)
    score = lambda by: f"SELECT (SELECT sum(n * ({total('(m_{c} - a_{c}) ** 2')})) / (count(*) - 1) FROM (SELECT count(*) AS n, {', '.join(f'avg({c}) AS m_{c}' for c in clustering.FEATURES)} FROM f GROUP BY {by}), (SELECT {', '.join(f'avg({c}) AS a_{c}' for c in clustering.FEATURES)} FROM f)) / (SELECT sum({total('({c} - m_{c}) ** 2')}) / (count(*) - count(DISTINCT l)) FROM (SELECT *, {by} AS l, {', '.join(f'avg({c}) OVER (PARTITION BY {by}) AS m_{c}' for c in clustering.FEATURES)} FROM f))"
    johnson = "CASE WHEN x >= 0 THEN CASE WHEN abs(g) < 1e-9 THEN ln(1 + x) ELSE ((x + 1) ** g - 1) / g END ELSE CASE WHEN abs(g - 2) < 1e-9 THEN -ln(1 - x) ELSE -((1 - x) ** (2 - g) - 1) / (2 - g) END END"
    quantile = lambda p: f"quantile_cont(v, {p})"
    n_percentiles, operators, n_references, (low, high), seed = GENERATED
    signs = ", ".join(f"({j}, '{op}')" for j, op in enumerate(operators))
    csv = lambda table, columns: " UNION ALL ".join(f"SELECT '{table}' AS dataset, '{c}' AS \"column\", {c}::DOUBLE AS v FROM {table}" for c in columns)
    return {
        "e1_stored": base["e1_over"],
        "e3_conversion": found(_e3()),
        "e4_stored_rebinning_recall": base["e4_rebinning_recall"],
        "e4_stored_rebinning_precision": base["e4_rebinning_precision"],
        "e4_stored_conversion_recall": base["e4_conversion_recall"],
        "e4_stored_conversion_precision": base["e4_conversion_precision"],
        "e4_traced": f"WITH {_e4('conversion', 'recall')}, k AS (SELECT query_id, op IN ('lt', 'le') AS lower, ref, new FROM q, c) SELECT query_id::BIGINT AS query_id, count(*) FILTER (WHERE CASE WHEN lower THEN ref < new[1] ELSE ref > new[-1] END) AS n_none, count(*) FILTER (WHERE CASE WHEN lower THEN ref > new[-1] ELSE ref < new[1] END) AS n_all, count(*) FILTER (WHERE ref BETWEEN new[1] AND new[-1]) AS n_search, (SELECT count(*) FROM found f WHERE f.query_id = k.query_id) AS n_results FROM k GROUP BY query_id",
        "e7_stored": base["e7_exact"],
        "e7_reduction": f"WITH {h}, {bounds} SELECT query_id::BIGINT AS query_id, round(1 - count(*) / (SELECT count(*) FROM h), 9) AS reduction FROM (FROM maybe EXCEPT FROM sure) GROUP BY query_id",
        "results_stored": f"WITH {_e1(OFF_EDGE, 'over')} SELECT query_id::BIGINT AS query_id, p AS percentile, op, ref AS reference, count(*) AS n FROM truth JOIN q USING (query_id) GROUP BY ALL",
        "run_index_filtered": base["e4_prefiltered"],
        "filter_scan": truth(_e1(OFF_EDGE, "over"), ids),
        "filter_binsort": f"SELECT * FROM ({base['e6_binsort_recall']}) WHERE {ids}",
        "filter_columns": truth(_e1(OFF_EDGE, "over"), "hist_id % 4 IN (1, 3)"),
        "metrics_differing": f"WITH {sides} SELECT query_id::BIGINT AS query_id, hist_id, 'first' AS side FROM (FROM truth EXCEPT FROM found) UNION ALL SELECT query_id, hist_id, 'second' FROM (FROM found EXCEPT FROM truth)",
        "metrics_mean_quality": f"WITH {sides} SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1, round((SELECT count(*) FROM ((FROM truth EXCEPT FROM found) UNION ALL (FROM found EXCEPT FROM truth))) / {len(OFF_EDGE)}, 9) AS mean_difference FROM ({base['metrics_accuracy']})",
        "index_differences": f"WITH i AS ({base['index_rebinning']}) SELECT cluster_id, bin_no, hist_id, pctl4 AS p, CASE WHEN hist_id % 7 <> 0 THEN least(pctl4 + 3, 10000) END AS q FROM i WHERE hist_id % 7 = 0 OR (hist_id % 11 = 0 AND least(pctl4 + 3, 10000) - pctl4 > 1)",
        "cluster_features": f"WITH {features} SELECT * FROM f",
        "transform_standard": f"WITH {features} SELECT hist_id, {each('({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} FROM f",
        "transform_robust": f"WITH {features} SELECT hist_id, {each('({c} - (SELECT quantile_cont({c}, 0.5) FROM f)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM f)')} FROM f",
        "transform_quantile_compat": f"WITH {features} SELECT hist_id, {each('({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())')} FROM f",
        "transform_power": f"""WITH {features}, u AS (UNPIVOT f ON low, high, width INTO NAME c VALUE x), g AS (SELECT * REPLACE (g / 4 AS g) FROM (SELECT u.*, unnest(range(-8, 17))::DOUBLE AS g FROM u)),
y AS (SELECT *, {johnson} AS y FROM g), l AS (SELECT c, g, -(count(*) / 2) * ln(var_pop(y)) + (g - 1) * sum(sign(x) * ln(1 + abs(x))) AS l FROM y GROUP BY c, g HAVING var_pop(y) > 0 AND isfinite(var_pop(y))), b AS (SELECT c, max_by(g, l) AS g FROM l GROUP BY c),
z AS (SELECT hist_id, c, round((y - avg(y) OVER (PARTITION BY c)) / stddev_pop(y) OVER (PARTITION BY c), 5) AS z FROM y JOIN b USING (c, g)) SELECT hist_id, max(z) FILTER (WHERE c = 'low') AS low, max(z) FILTER (WHERE c = 'high') AS high, max(z) FILTER (WHERE c = 'width') AS width FROM z GROUP BY hist_id""",
        "cluster_choice": f"WITH {features} " + " UNION ALL ".join(f"SELECT '{k}' AS clustering, round(({score(by)}), 4) AS score" for k, by in labels.items()),
        "cluster_linkage": f"WITH {features}, s AS (SELECT hist_id, width - lag(width) OVER (ORDER BY width) AS gap, width FROM f), t AS (SELECT gap FROM s ORDER BY gap DESC NULLS LAST LIMIT 2), k AS (SELECT hist_id, sum((gap >= (SELECT min(gap) FROM t))::INT) OVER (ORDER BY width) AS k FROM s) SELECT min(hist_id) AS first_id, count(*) AS n FROM k GROUP BY coalesce(k, 0)",
        "cluster_members": f"WITH {h} SELECT (hist_id % 4)::INT AS cluster_id, hist_id FROM h",
        "cluster_size": f"WITH {h}, {_CLUSTERS} SELECT sum(n_hists * len(new) * 6)::BIGINT AS n_bytes FROM c",
        "cluster_range_check": f"WITH {h}, {_CLUSTERS} SELECT c.cluster_id FROM c JOIN ends USING (cluster_id) WHERE abs(new[1] - cluster_id * 1e-4::DOUBLE - low) > 1e-4::DOUBLE OR abs(new[-1] - high) > 1e-4::DOUBLE",
        "profile_automatic_bins": f"WITH {h}, s AS (SELECT hist_id, count(*) AS n, count(DISTINCT v) AS d, max(v) - min(v) AS spread, 2 * ({quantile(0.75)} - {quantile(0.25)}) / count(*) ** (1.0::DOUBLE / 3) AS w FROM vals GROUP BY hist_id HAVING count(DISTINCT v) > 1) SELECT hist_id, greatest(1, least(d - 1, greatest(ceil(log2(n) + 1), CASE WHEN w > 0 THEN ceil(spread / w) ELSE 0 END)))::BIGINT AS n_bins FROM s",
        "profile_copies": f"WITH {h} SELECT hist_id, unnest([1, 2, 3])::BIGINT AS copy, len(counts)::BIGINT AS n_bins, total FROM h",
        "profile_densities": f"WITH {h} SELECT hist_id, unnest(range(len(counts)))::BIGINT AS bin_no, round(unnest(list_transform(counts, lambda c: (c / total)::FLOAT::DOUBLE)), 6) AS density FROM h",
        "profile_ids": f"WITH {h}, n AS (SELECT (hist_id // 4)::VARCHAR AS dataset, [{', '.join(repr(m) for m in MEASURES)}][hist_id % 4 + 1] AS \"column\" FROM h) SELECT *, row_number() OVER (ORDER BY dataset, \"column\") - 1 AS hist_id FROM n",
        "index_conversion_matrix": f"WITH {h}, {_CLUSTERS}, o AS (SELECT hist_id, new, edges, unnest(range(len(counts))) AS bin_no FROM a), m AS (SELECT hist_id, bin_no, list_filter(range(len(new) - 1), lambda j: edges[bin_no + 1] < new[j + 2] AND edges[bin_no + 2] > new[j + 1]) AS hit FROM o) SELECT hist_id, bin_no::BIGINT AS bin_no, list_min(hit)::BIGINT AS first, list_max(hit)::BIGINT AS last FROM m",
        "queries_generated": f"SELECT (i * {len(operators)} + j) * {n_references} + k AS query_id, round_even((i + 1) / {n_percentiles} * 1e4, 0) / 1e4 AS percentile, op, round_even(({low}::DOUBLE + ('0x' || substr(md5('{seed}:' || k::VARCHAR), 1, 13))::BIGINT::DOUBLE / {q.DRAWS}::DOUBLE * {high - low}::DOUBLE) * 1e4, 0) / 1e4 AS reference FROM range({n_percentiles}) a(i), (VALUES {signs}) o(j, op), range({n_references}) r(k)",
        "queries_parsed": f"WITH t(said) AS (VALUES {', '.join(f'({x!r})' for x in SAID)}), w AS (SELECT said, regexp_split_to_array(trim(said), '\\s+') AS w FROM t), v AS (SELECT *, coalesce(len(w) = 3 AND try_cast(w[1] AS DOUBLE) > 0 AND try_cast(w[1] AS DOUBLE) <= 1 AND w[2] IN ('lt', 'le', 'gt', 'ge') AND try_cast(w[3] AS DOUBLE) IS NOT NULL, false) AS valid FROM w) SELECT said, CASE WHEN valid THEN w[1]::DOUBLE END AS percentile, CASE WHEN valid THEN w[2] END AS op, CASE WHEN valid THEN w[3]::DOUBLE END AS reference, valid FROM v",
        "source_files": f"SELECT dataset, \"column\", count(v) AS n, round(sum(v), 2) AS total FROM ({csv('supplier', ['s_suppkey', 's_nationkey', 's_acctbal'])} UNION ALL {csv('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])} UNION ALL {csv('nation', ['n_nationkey', 'n_regionkey'])}) GROUP BY ALL",
        "analysis_three_keys": "WITH r AS (SELECT l_suppkey, l_linenumber, l_linestatus, sum(l_quantity) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), n AS (SELECT l_suppkey, l_linenumber, l_linestatus, sum(l_quantity) AS kept FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) SELECT *, returned + kept AS total FROM r JOIN n USING (l_suppkey, l_linenumber, l_linestatus)",
        "analysis_construction": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top, any_value(c_acctbal) AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey",
        "analysis_mean_ratio": "SELECT l_suppkey, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice) / avg(l_quantity), 6) AS ratio FROM lineitem GROUP BY l_suppkey",
        "analysis_five_keys": "SELECT l_returnflag, l_linestatus, l_linenumber, l_tax, l_discount, round(avg(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY ALL",
        "analysis_row_order": f"SELECT list_position({list(PRIORITIES)!r}, o_orderpriority)::BIGINT AS position, o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN {PRIORITIES!r} GROUP BY ALL",
        "analysis_nested_sum": "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
        "analysis_sample": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey LIMIT 50",
    }
