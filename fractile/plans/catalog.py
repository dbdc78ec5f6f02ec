"""Registered queries over the test tables and the same in DuckDB SQL.

Each group of a table is taken for a dataset: lineitem by supplier or by part
with four measures, events by user, embeddings by vector. Bin counts are 10 to
20 by histogram id, clusters are measures, so that SQL can state both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fractile.operators import clustering, filters, metrics, queries as q
from fractile.operators.index import binsort, create_index, rebinned, verify
from fractile.operators.profiles import histograms, kept_values, moments
from fractile.plans import evaluate
from fractile.plans.store import checkpointed, index_size, spread

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
N_BINS = 200
OFF_EDGE = [q.PercentileQuery(p, op, r) for p in (0.1, 0.35, 0.8) for op in q.OPERATORS for r in (0.0333, 24.4567, 31234.5678)]
STRATA_QUERIES = q.generate(10, q.OPERATORS, 12, (-20.0, 60.0), 7)
ON_EDGE = [q.PercentileQuery(p, op, r) for p in (0.2, 0.5, 0.9) for op in q.OPERATORS for r in (1.0, 10.0, 25.0, 50.0)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def values(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """(hist_id, value): hist_id is 4 key + measure."""
    items = spread(_table(spark, sf_dir, "lineitem").select(key, *MEASURES))
    pairs = F.explode(F.array(*[F.struct((F.col(key) * 4 + k).alias("hist_id"), F.col(m).alias("value")) for k, m in enumerate(MEASURES)]))
    return items.select(pairs.alias("p")).select("p.hist_id", "p.value")


def bins_of(column: str = "hist_id"):
    return F.lit(10) + F.pmod(F.col(column), F.lit(11))


def collection(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    return histograms(values(spark, sf_dir, key), bins_of(), keys=("hist_id",))


def clustered(hists: DataFrame) -> tuple[DataFrame, DataFrame]:
    members = hists.select(F.pmod("hist_id", F.lit(4)).cast("int").alias("cluster_id"), "hist_id")
    return members, clustering.cluster_edges(hists, members, N_BINS, 1.0)


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hists = checkpointed(collection(spark, sf_dir), "hists")
    members, clusters = clustered(hists)
    return hists, members, checkpointed(clusters, "clusters")


def _scan(mode: str, asked: list, compat: bool = True) -> Callable:
    return lambda spark, sf_dir: evaluate.scan(collection(spark, sf_dir), q.to_frame(spark, asked), mode, compat)


def _probe(method: str, index_mode: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hists, members, clusters = _base(spark, sf_dir)
        return evaluate.probe(create_index(hists, members, clusters, method), clusters, members, q.to_frame(spark, OFF_EDGE), method, index_mode)

    return query


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    return evaluate.exact(hists, create_index(hists, members, clusters, "conversion"), clusters, members, q.to_frame(spark, OFF_EDGE))


def _exact_binsort(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    return evaluate.exact_binsort(binsort(hists), create_index(hists, members, clusters, "conversion"), clusters, members, q.to_frame(spark, OFF_EDGE))


def _exact_clustered(algorithm: str, span: tuple[int, int]) -> Callable:
    """E7 under fitted clusters of the whole collection."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hists = checkpointed(collection(spark, sf_dir), "hists")
        members, clusters = clustering.cluster_histograms(hists, 400, "standard", algorithm, span)
        members, clusters = checkpointed(members, "members"), checkpointed(clusters, "clusters")
        return evaluate.exact(hists, create_index(hists, members, clusters, "conversion"), clusters, members, q.to_frame(spark, OFF_EDGE))

    return query


def _rebinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    return evaluate.scan_rebinned(rebinned(hists, members, clusters), q.to_frame(spark, OFF_EDGE), "over")


def _conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    return evaluate.scan_conversion(hists, members, clusters, q.to_frame(spark, OFF_EDGE))


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    ids = checkpointed(filters.random_ids(hists, 0.25, 42), "ids")
    index = filters.keep_ids(create_index(hists, members, clusters, "conversion"), ids)
    return evaluate.probe(index, clusters, filters.keep_ids(members, ids), q.to_frame(spark, OFF_EDGE), "conversion", "recall")


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    asked = q.to_frame(spark, OFF_EDGE)
    found = evaluate.probe(create_index(hists, members, clusters, "rebinning"), clusters, members, asked, "rebinning", "recall")
    return metrics.accuracy(asked, checkpointed(evaluate.scan(hists, asked), "truth"), checkpointed(found, "found"))


def _query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, _, clusters = _base(spark, sf_dir)
    asked = q.to_frame(spark, OFF_EDGE + ON_EDGE)
    out = metrics.selectivity(asked, evaluate.scan(hists, asked), hists.count())
    return out.join(metrics.cluster_hits(asked, clusters), "query_id").join(metrics.edge_matches(asked, hists), "query_id")


def _set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists = checkpointed(collection(spark, sf_dir), "hists")
    asked = q.to_frame(spark, OFF_EDGE)
    over, under = (checkpointed(evaluate.scan(hists, asked, m), m) for m in ("over", "under"))
    sets = {"and": filters.both(over, under), "or": filters.either(over, under), "minus": filters.without(over, under), "xor": filters.one_of(over, under)}
    out = None
    for name, rows in sets.items():
        part = rows.select(F.lit(name).alias("set"), "query_id", "hist_id")
        out = part if out is None else out.unionByName(part)
    return out


def _boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists = checkpointed(collection(spark, sf_dir), "hists")
    found = checkpointed(evaluate.scan(hists, q.to_frame(spark, OFF_EDGE)), "found")
    return filters.combined(found, ("and", ("or", 1, 2), ("not", 13), 22), hists)


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.normal(moments(values(spark, sf_dir), "hist_id"), q.to_frame(spark, OFF_EDGE))


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moments(values(spark, sf_dir), "hist_id")
    return rows.select("hist_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _profiles(key: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = collection(spark, sf_dir, key)
        return rows.select("hist_id", F.size("counts").cast("long").alias("n_bins"), "total", F.posexplode("counts").alias("bin_no", "cnt")).select("hist_id", "n_bins", "total", F.col("bin_no").cast("long").alias("bin_no"), "cnt")

    return query


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("hist_id"), "value")
    return evaluate.scan(histograms(rows, bins_of(), keys=("hist_id",)), q.to_frame(spark, USER_QUERIES), "over")


USER_QUERIES = [q.PercentileQuery(p, op, r) for p in (0.25, 0.75) for op in ("lt", "ge") for r in (20.123, 55.777)]


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, clusters = _base(spark, sf_dir)
    return clusters.select("cluster_id", "n_hists", F.posexplode("edges").alias("edge_no", "edge"))


def _index(method: str) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hists, members, clusters = _base(spark, sf_dir)
        rows = create_index(hists, members, clusters, method)
        return rows.select("cluster_id", "variant", "bin_no", F.col("pctl4").cast("int").alias("pctl4"), "hist_id")

    return query


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists, members, clusters = _base(spark, sf_dir)
    index = checkpointed(create_index(hists, members, clusters, "rebinning").unionByName(create_index(hists, members, clusters, "conversion")), "index")
    return verify(index).crossJoin(F.broadcast(index_size(index)))  # one row


def _binsort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binsort(collection(spark, sf_dir)).select("hist_id", "edge", *[F.col(c).cast("int").alias(c) for c in ("pre4", "mid4", "post4")])


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    hists = checkpointed(collection(spark, sf_dir), "hists")
    asked = q.to_frame(spark, STRATA_QUERIES)
    return q.strata(metrics.selectivity(asked, evaluate.scan(hists, asked), hists.count()), 3, 5)


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_values(_table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_acctbal").alias("value"))).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def _top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation by group joined to another table, the 30 largest."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))
    part = _table(spark, sf_dir, "part").where(~F.col("p_size").isin(1, 2, 3)).select("p_partkey", "p_size")
    rows = items.join(part, items["l_partkey"] == part["p_partkey"]).orderBy(F.desc("m"), "l_partkey").limit(30)
    return rows.select("l_partkey", "p_size", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), "n")


def _skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).alias("n"))
    return metrics.skyline(rows, "price", "n").select("p_size", F.round("price", 6).alias("price"), "n")


# ---- SQL ----


def _rows(asked: list) -> str:
    return ", ".join(f"({k}, {x.percentile!r}::DOUBLE, '{x.op}', {x.reference!r}::DOUBLE)" for k, x in enumerate(asked))


def _lineitem(key: str) -> str:
    return " UNION ALL ".join(f"SELECT {key} * 4 + {k} AS hist_id, {m} AS v FROM lineitem" for k, m in enumerate(MEASURES))


def _hists(raw: str) -> str:
    return f"""
raw AS ({raw}),
vals AS (SELECT hist_id, round_even(v * 1e4, 0) / 1e4 AS v FROM raw WHERE v IS NOT NULL AND NOT isnan(v) AND v > -9007199254740992 AND v < 9007199254740992),
shape AS (SELECT hist_id, min(v) AS mn, max(v) AS mx, count(*) AS total, greatest(1, least(count(DISTINCT v) - 1, 10 + hist_id % 11))::INT AS n FROM vals GROUP BY hist_id HAVING count(DISTINCT v) > 1 AND min(v) < max(v)),
width AS (SELECT *, (mx - mn) / n AS w FROM shape),
guess AS (SELECT hist_id, v, mn, w, n, least(floor((v - mn) / w)::INT, n - 1) AS k FROM vals JOIN width USING (hist_id)),
bars AS (SELECT hist_id, CASE WHEN v < mn + k * w THEN k - 1 WHEN k + 1 < n AND v >= mn + (k + 1) * w THEN k + 1 ELSE k END AS k, count(*) AS c FROM guess GROUP BY ALL),
dense AS (SELECT d.hist_id, list(coalesce(b.c, 0) ORDER BY d.k) AS counts FROM (SELECT hist_id, unnest(range(n))::INT AS k FROM width) d LEFT JOIN bars b ON b.hist_id = d.hist_id AND b.k = d.k GROUP BY d.hist_id),
h AS (SELECT hist_id, list_concat(list_transform(range(n), lambda i: mn + i::INT * w), [mx]) AS edges, counts, list_transform(range(n + 1), lambda k: coalesce(list_sum(list_slice(counts, 1, k)), 0)::BIGINT) AS cum, total FROM width JOIN dense USING (hist_id))"""


def _mass(mode: str, compat: bool) -> str:
    own = "counts[k]"
    low = {"over": own, "under": "0", "continuous_value": f"{own} * ((ref - edges[k]) / (edges[k + 1] - edges[k]))"}[mode]
    high = {"over": own, "under": "0", "continuous_value": f"{own} * ((edges[k + 1] - ref) / (edges[k + 1] - edges[k]))"}[mode]
    at_low = own + (" + CASE WHEN op = 'le' AND k < len(edges) - 1 THEN counts[k + 1] ELSE 0 END" if mode == "over" else "") + (f" + {low}" if compat else "")
    at_high = "CASE WHEN op = 'gt' THEN -coalesce(counts[k + 1], 0) ELSE 0 END" if mode == "under" else "0"
    return f"""CASE WHEN k = 0 THEN CASE WHEN op IN ('lt', 'le') THEN 0 ELSE total END WHEN k = len(edges) THEN CASE WHEN op IN ('lt', 'le') THEN total ELSE 0 END
      WHEN op IN ('lt', 'le') THEN cum[k] + CASE WHEN edges[k + 1] = ref THEN {at_low} ELSE {low} END
      ELSE total - cum[k + 1] + CASE WHEN edges[k + 1] = ref THEN {at_high} ELSE {high} END END"""


def _e1(asked: list, mode: str, compat: bool = True, raw: str = "") -> str:
    bound = "round_even((m / total) * 1e4, 0) >= round_even(p * 1e4, 0)"
    if mode == "continuous_value":
        bound = "round_even((m / total) * 1e4, 0) / 1e4 >= " + ("p::FLOAT::DOUBLE" if compat else "p")
    return f"""{_hists(raw or _lineitem("l_suppkey"))},
q(query_id, p, op, ref) AS (VALUES {_rows(asked)}),
m AS (SELECT query_id, hist_id, p, total, {_mass(mode, compat)} AS m FROM (SELECT *, len(list_filter(edges, lambda e: e < ref)) AS k FROM h, q)),
truth AS (SELECT query_id, hist_id FROM m WHERE {bound})"""


def _spline(asked: list) -> str:
    """The clamped spline by a recursive elimination over the inner knots, and the share of the reference's bin below it."""
    whole = lambda at, s: f"({at.format('u')}[{s}] + w * ({at.format('y')}[{s}] * (t - t ** 3 + t ** 4 / 2) + {at.format('y')}[{s} + 1] * (t ** 3 - t ** 4 / 2) + w * {at.format('d')}[{s}] * (t ** 2 / 2 - 2 * t ** 3 / 3 + t ** 4 / 4) + w * {at.format('d')}[{s} + 1] * (t ** 4 / 4 - t ** 3 / 3)))"
    place = lambda name, s, v: f"{name} AS (SELECT query_id, hist_id, {whole('{}', 's')} AS v FROM (SELECT *, x[s + 1] - x[s] AS w, ({v} - x[s]) / (x[s + 1] - x[s]) AS t FROM (SELECT *, {s} AS s FROM inside)))"
    share = "CASE WHEN counts[k] > 0 THEN (r.v - l.v) / (g.v - l.v) ELSE 0 END"
    return f"""{_hists(_lineitem("l_suppkey"))},
q(query_id, p, op, ref) AS (VALUES {_rows(asked)}),
kn AS (SELECT hist_id, len(counts)::INT AS n, list_concat([edges[1]], list_transform(range(1, len(edges)), lambda i: (edges[i] + edges[i + 1]) / 2), [edges[-1]]) AS x, list_concat([0.0::DOUBLE], counts::DOUBLE[], [0.0::DOUBLE]) AS y FROM h),
eq AS (SELECT hist_id, n, i, x[i + 1] - x[i] AS h0, x[i + 2] - x[i + 1] AS h1, y[i + 1] - y[i] AS r0, y[i + 2] - y[i + 1] AS r1 FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM kn)),
up AS (SELECT hist_id, n, i, h0, h1, 2 * (h0 + h1) AS b, 3 * (h1 * r0 / h0 + h0 * r1 / h1) AS r FROM eq),
fw AS (SELECT hist_id, n, i, h0, b, r FROM up WHERE i = 1 UNION ALL SELECT u.hist_id, u.n, u.i, u.h0, u.b - u.h1 / f.b * f.h0, u.r - u.h1 / f.b * f.r FROM fw f JOIN up u ON u.hist_id = f.hist_id AND u.i = f.i + 1),
bw AS (SELECT hist_id, i, r / b AS d FROM fw WHERE i = n UNION ALL SELECT f.hist_id, f.i, (f.r - f.h0 * w.d) / f.b FROM bw w JOIN fw f ON f.hist_id = w.hist_id AND f.i = w.i - 1),
sl AS (SELECT hist_id, list_concat([0.0::DOUBLE], list(d ORDER BY i), [0.0::DOUBLE]) AS d FROM bw GROUP BY hist_id),
pc AS (SELECT *, list_transform(range(1, n + 2), lambda i: (x[i + 1] - x[i]) * (y[i] + y[i + 1]) / 2 + (x[i + 1] - x[i]) ** 2 * (d[i] - d[i + 1]) / 12) AS pieces FROM kn JOIN sl USING (hist_id)),
sp AS (SELECT hist_id, x, y, d, list_transform(range(n + 2), lambda i: coalesce(list_sum(list_slice(pieces, 1, i)), 0.0)) AS u FROM pc),
asked AS (SELECT *, len(list_filter(edges, lambda e: e < ref)) AS k FROM h, q),
inside AS (SELECT * FROM asked JOIN sp USING (hist_id) WHERE k BETWEEN 1 AND len(edges) - 1),
{place("lo", "k", "edges[k]")}, {place("hi", "k + 1", "edges[k + 1]")}, {place("mi", "CASE WHEN ref < x[k + 1] THEN k ELSE k + 1 END", "ref")},
m AS (SELECT a.*, CASE WHEN k = 0 THEN CASE WHEN op IN ('lt', 'le') THEN 0 ELSE total END WHEN k = len(edges) THEN CASE WHEN op IN ('lt', 'le') THEN total ELSE 0 END
  WHEN op IN ('lt', 'le') THEN cum[k] + counts[k] * ({share}) ELSE total - cum[k + 1] + counts[k] * (1 - {share}) END AS m
  FROM asked a LEFT JOIN lo l USING (query_id, hist_id) LEFT JOIN hi g USING (query_id, hist_id) LEFT JOIN mi r USING (query_id, hist_id)),
truth AS (SELECT query_id, hist_id FROM m WHERE round_even((m / total) * 1e4, 0) / 1e4 >= p::FLOAT::DOUBLE)"""


_CLUSTERS = f"""
ends AS (SELECT (hist_id % 4)::INT AS cluster_id, min(edges[1]) AS low, max(edges[-1]) AS high, count(*) AS n_hists FROM h GROUP BY 1),
parts AS (SELECT *, greatest(floor((n_hists + 1.0::DOUBLE) / (sum(n_hists) OVER () + 1.0::DOUBLE * count(*) OVER ()) * {N_BINS}), 1)::INT AS n FROM ends),
c AS (SELECT cluster_id, n_hists, list_concat(list_transform(range(n), lambda i: round_even((low + i::INT * ((high - low) / n)) * 1e4, 0) / 1e4), [round_even(high * 1e4, 0) / 1e4]) AS new FROM parts),
a AS (SELECT * FROM h JOIN c ON c.cluster_id = h.hist_id % 4)"""


def _share(x: str) -> str:
    k = f"len(list_filter(edges, lambda e: e < {x}))"
    return f"CASE WHEN {k} = 0 THEN 0.0 WHEN {k} = len(edges) THEN 1.0 ELSE (cum[{k}] + counts[{k}] * (({x} - edges[{k}]) / (edges[{k} + 1] - edges[{k}]))) / total END"


def _lower(x: str) -> str:
    return f"cum[greatest(len(list_filter(edges, lambda e: e <= {x})) - 1, 0) + 1] / total"


def _upper(x: str) -> str:
    return f"cum[least(len(list_filter(edges, lambda e: e < {x})), len(edges) - 1) + 1] / total"


def _four(x: str) -> str:
    return f"round_even(({x}) * 1e4, 0)::INT"


def _e4(method: str, mode: str, keep: str = "true") -> str:
    low = "op IN ('lt', 'le')"
    later = low if mode == "recall" else f"NOT ({low})"
    if method == "rebinning":
        value = _share(f"new[b + 1 + CASE WHEN {later} THEN 1 ELSE 0 END]")
    else:
        value = f"CASE WHEN {later} THEN {_upper('new[b + 2]')} ELSE {_lower('new[b + 1]')} END"
    return f"""{_hists(_lineitem("l_suppkey"))}, {_CLUSTERS},
q(query_id, p, op, ref) AS (VALUES {_rows(OFF_EDGE)}),
j AS (SELECT *, greatest(len(list_filter(new, lambda e: e < ref)) - 1, 0) AS b FROM a, q),
v AS (SELECT query_id, hist_id, op, ref, new, p, CASE WHEN ref < new[1] OR ref > new[-1] THEN NULL ELSE {_four(value)} END AS p4 FROM j),
found AS (SELECT query_id, hist_id FROM v WHERE {keep} AND CASE WHEN ref < new[1] THEN NOT ({low}) WHEN ref > new[-1] THEN {low} WHEN {low} THEN p4 >= {_four("p")} ELSE p4 <= 10000 - {_four("p")} END)"""


def _e2() -> str:
    """Over the cluster's edges with shares of 1 as counts."""
    at = f"list_transform(new, lambda x: {_share('x')})"
    return f"""{_hists(_lineitem("l_suppkey"))}, {_CLUSTERS},
g AS (SELECT hist_id, new AS edges, {at} AS s FROM a),
d AS (SELECT hist_id, edges, list_transform(range(1, len(s)), lambda k: s[k + 1] - s[k]) AS counts FROM g),
r AS (SELECT *, list_transform(range(len(counts) + 1), lambda k: coalesce(list_sum(list_slice(counts, 1, k)), 0.0)) AS cum, 1.0::DOUBLE AS total FROM d),
q(query_id, p, op, ref) AS (VALUES {_rows(OFF_EDGE)}),
m AS (SELECT query_id, hist_id, p, op, ref, edges, total, {_mass("over", True)} AS m FROM (SELECT *, len(list_filter(edges, lambda e: e < ref)) AS k FROM r, q)),
found AS (SELECT query_id, hist_id FROM m WHERE CASE WHEN ref < edges[1] THEN op NOT IN ('lt', 'le') WHEN ref > edges[-1] THEN op IN ('lt', 'le') ELSE {_four("m / total")} >= {_four("p")} END)"""


def _erfc() -> str:
    from fractile.functions.histogram import ERFC

    poly = f"({ERFC[-1]}::DOUBLE)"
    for c in reversed(ERFC[:-1]):
        poly = f"({c}::DOUBLE + t * {poly})"
    return poly


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "profile_histograms": _profiles("l_suppkey"),
        "profile_histograms_parts": _profiles("l_partkey"),
        "profile_moments": _moments,
        "profile_kept_values": _kept,
        "cluster_edges": _clusters,
        "index_rebinning": _index("rebinning"),
        "index_conversion": _index("conversion"),
        "index_verify_size": _verified,
        "binsort_table": _binsort_table,
        "e1_over": _scan("over", OFF_EDGE),
        "e1_under": _scan("under", OFF_EDGE),
        "e1_continuous": _scan("continuous_value", OFF_EDGE),
        "e1_over_edges": _scan("over", ON_EDGE),
        "e1_under_edges": _scan("under", ON_EDGE),
        "e1_continuous_edges": _scan("continuous_value", ON_EDGE),
        "e1_over_edges_once": _scan("over", ON_EDGE, False),
        "e1_continuous_edges_once": _scan("continuous_value", ON_EDGE, False),
        "e1_spline": _scan("cubic_spline", OFF_EDGE),
        "e1_users": _users,
        "e2_rebinned": _rebinned,
        "e3_conversion": _conversion,
        "e4_rebinning_recall": _probe("rebinning", "recall"),
        "e4_rebinning_precision": _probe("rebinning", "precision"),
        "e4_conversion_recall": _probe("conversion", "recall"),
        "e4_conversion_precision": _probe("conversion", "precision"),
        "e4_prefiltered": _filtered,
        "e5_normal": _normal,
        "e6_binsort_recall": lambda s, d: evaluate.binsort_scan(binsort(collection(s, d)), q.to_frame(s, OFF_EDGE), "recall"),
        "e6_binsort_precision": lambda s, d: evaluate.binsort_scan(binsort(collection(s, d)), q.to_frame(s, OFF_EDGE), "precision"),
        "e7_exact": _exact,
        "e7_exact_binsort": _exact_binsort,
        "e7_exact_kmeans": _exact_clustered("kmeans", (3, 4)),
        "e7_exact_linkage": _exact_clustered("agglomerative", (2, 4)),
        "e7_exact_density": _exact_clustered("hdbscan", (2, 2)),
        "filter_random_ids": lambda s, d: filters.random_ids(collection(s, d), 0.25, 42),
        "set_operations": _set_operations,
        "boolean_composition": _boolean,
        "metrics_accuracy": _accuracy,
        "metrics_queries": _query_metrics,
        "queries_strata": _strata,
        "analysis_top_groups": _top_groups,
        "analysis_skyline": _skyline,
    }


def oracle_sql() -> dict[str, str]:
    answer = lambda text: f"WITH {text} SELECT query_id::BIGINT AS query_id, hist_id FROM truth"
    found = lambda text: f"WITH {text} SELECT query_id::BIGINT AS query_id, hist_id FROM found"
    h = _hists(_lineitem("l_suppkey"))
    drawn = "SELECT hist_id FROM (SELECT hist_id, row_number() OVER (ORDER BY md5('42:' || hist_id::VARCHAR), hist_id) AS r, count(*) OVER () AS n FROM h) WHERE r <= floor(n * 0.25)"
    bars = "SELECT hist_id, len(counts)::BIGINT AS n_bins, total, (unnest(range(len(counts))))::BIGINT AS bin_no, unnest(counts)::BIGINT AS cnt FROM h"
    mid = "list_transform(cum, lambda x: round_even((x / total) * 1e4, 0)::INT)"
    sorted_bins = f"b AS (SELECT hist_id, edges, {mid} AS p FROM h), bs AS (SELECT hist_id, edges[j] AS edge, CASE WHEN j > 1 THEN p[j - 1] ELSE 0 END AS pre4, p[j] AS mid4, coalesce(p[j + 1], 10000) AS post4 FROM (SELECT *, unnest(range(1, len(edges) + 1)) AS j FROM b))"
    e6 = lambda up, down: f"WITH {h}, {sorted_bins}, q(query_id, p, op, ref) AS (VALUES {_rows(OFF_EDGE)}) SELECT DISTINCT query_id::BIGINT AS query_id, hist_id FROM bs, q WHERE CASE WHEN op IN ('lt', 'le') THEN edge <= ref AND {up} >= {_four('p')} ELSE edge >= ref AND {down} <= 10000 - {_four('p')} END"
    index = lambda parts: f"WITH {h}, {_CLUSTERS} " + " UNION ALL ".join(f"SELECT cluster_id, '{v}' AS variant, (k - 1)::INT AS bin_no, {_four(x)} AS pctl4, hist_id FROM (SELECT *, unnest(range(1, len(new) + {more})) AS k FROM a)" for v, x, more in parts)
    rebin, conv = [("rebin", _share("new[k]"), 1)], [("lower", _lower("new[k]"), 0), ("upper", _upper("new[k + 1]"), 0)]
    sides = f"{_e1(OFF_EDGE, 'over')}, under AS (SELECT query_id, hist_id FROM (SELECT query_id, hist_id, p, total, {_mass('under', True)} AS m FROM (SELECT *, len(list_filter(edges, lambda e: e < ref)) AS k FROM h, q)) WHERE round_even((m / total) * 1e4, 0) >= round_even(p * 1e4, 0))"
    z = "abs(z) / sqrt(2.0::DOUBLE)"
    tail = f"(t * exp(-x * x + {_erfc()}) / 2)"
    accuracy = f"""WITH {_e1(OFF_EDGE, 'over')}, found AS (SELECT * FROM (WITH {_e4('rebinning', 'recall')} SELECT query_id, hist_id FROM found)),
n AS (SELECT q.query_id, (SELECT count(*) FROM truth t WHERE t.query_id = q.query_id) AS t, (SELECT count(*) FROM found f WHERE f.query_id = q.query_id) AS p, (SELECT count(*) FROM found f JOIN truth t USING (query_id, hist_id) WHERE f.query_id = q.query_id) AS b FROM q)
SELECT query_id::BIGINT AS query_id, CASE WHEN p = 0 THEN 1.0::DOUBLE WHEN t = 0 THEN 0.0 ELSE b / p END AS precision, CASE WHEN t = 0 THEN 1.0::DOUBLE WHEN p = 0 THEN 0.0 ELSE b / t END AS recall, CASE WHEN t = 0 AND p = 0 THEN 1.0::DOUBLE WHEN b = 0 THEN 0.0 ELSE 2 * b / (t + p) END AS f1 FROM n"""
    exact = answer(_e1(OFF_EDGE, "over"))
    return {
        "profile_histograms": f"WITH {h} {bars}",
        "profile_histograms_parts": f"WITH {_hists(_lineitem('l_partkey'))} {bars}",
        "profile_moments": f"WITH raw AS ({_lineitem('l_suppkey')}) SELECT hist_id, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM raw GROUP BY hist_id HAVING min(v) < max(v)",
        "profile_kept_values": "SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer WHERE c_acctbal IS NOT NULL GROUP BY c_nationkey",
        "cluster_edges": f"WITH {h}, {_CLUSTERS} SELECT cluster_id, n_hists, unnest(range(len(new)))::INT AS edge_no, unnest(new) AS edge FROM c",
        "index_rebinning": index(rebin),
        "index_conversion": index(conv),
        "binsort_table": f"WITH {h}, {sorted_bins} SELECT * FROM bs",
        "e1_over": exact,
        "e1_under": answer(_e1(OFF_EDGE, "under")),
        "e1_continuous": answer(_e1(OFF_EDGE, "continuous_value")),
        "e1_spline": f"WITH RECURSIVE {_spline(OFF_EDGE)} SELECT query_id::BIGINT AS query_id, hist_id FROM truth",
        "e1_over_edges": answer(_e1(ON_EDGE, "over")),
        "e1_under_edges": answer(_e1(ON_EDGE, "under")),
        "e1_continuous_edges": answer(_e1(ON_EDGE, "continuous_value")),
        "e1_over_edges_once": answer(_e1(ON_EDGE, "over", False)),
        "e1_continuous_edges_once": answer(_e1(ON_EDGE, "continuous_value", False)),
        "e1_users": answer(_e1(USER_QUERIES, "over", True, "SELECT user_id AS hist_id, value AS v FROM events")),
        "e4_rebinning_recall": found(_e4("rebinning", "recall")),
        "e4_rebinning_precision": found(_e4("rebinning", "precision")),
        "e2_rebinned": found(_e2()),
        "index_verify_size": f"""WITH i AS ({index([*rebin, *conv])}), l AS (SELECT cluster_id, variant, max(bin_no) AS last FROM i GROUP BY ALL), n AS (SELECT count(*) AS n_rows, count(*) * 6 AS n_bytes FROM i),
v AS (SELECT variant, coalesce(max(CASE WHEN bin_no = 0 AND variant <> 'upper' THEN abs(pctl4) END), 0) AS first_gap, coalesce(max(CASE WHEN bin_no = last AND variant <> 'lower' THEN abs(pctl4 - 10000) END), 0) AS last_gap FROM i JOIN l USING (cluster_id, variant) GROUP BY variant)
SELECT variant, first_gap, last_gap, first_gap <= 1 AND last_gap <= 1 AS sound, n_rows, n_bytes FROM v, n""",
        "queries_strata": f"""WITH {_e1(STRATA_QUERIES, "over")}, s AS (SELECT q.query_id, (SELECT count(*) FROM truth t WHERE t.query_id = q.query_id) / (SELECT count(*) FROM h) AS x FROM q),
n AS (SELECT query_id, CASE WHEN x < 0.1 THEN 'low' WHEN x > 0.1 AND x < 0.9 THEN 'mid' WHEN x > 0.9 THEN 'high' END AS stratum FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || query_id::VARCHAR), query_id) AS k FROM n WHERE stratum IS NOT NULL)
SELECT query_id::BIGINT AS query_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY query_id) <= 3 THEN 'validation' ELSE 'test' END AS part FROM r WHERE k <= 8""",
        "e4_conversion_recall": found(_e4("conversion", "recall")),
        "e4_conversion_precision": found(_e4("conversion", "precision")),
        "e4_prefiltered": found(_e4("conversion", "recall", f"hist_id IN ({drawn})")),
        "e5_normal": f"WITH raw AS ({_lineitem('l_suppkey')}), d AS (SELECT hist_id, avg(v) AS mean, stddev_samp(v) AS std FROM raw GROUP BY hist_id HAVING min(v) < max(v)), q(query_id, p, op, ref) AS (VALUES {_rows(OFF_EDGE)}), s AS (SELECT *, CASE WHEN op IN ('lt', 'le') THEN (ref - mean) / std ELSE -((ref - mean) / std) END AS z FROM d, q), u AS (SELECT *, {z} AS x, 1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * ({z})) AS t FROM s) SELECT query_id::BIGINT AS query_id, hist_id FROM u WHERE round_even((CASE WHEN z >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END) * 1e4, 0) / 1e4 >= p::FLOAT::DOUBLE",
        "e6_binsort_recall": e6("post4", "pre4"),
        "e6_binsort_precision": e6("mid4", "mid4"),
        "e7_exact": exact,
        "e7_exact_binsort": exact,
        "e7_exact_kmeans": exact,
        "e7_exact_linkage": exact,
        "e7_exact_density": exact,
        "filter_random_ids": f"WITH {h} {drawn}",
        "set_operations": f"WITH {sides} SELECT 'and' AS set, query_id::BIGINT AS query_id, hist_id FROM (FROM truth INTERSECT FROM under) UNION ALL SELECT 'or', * FROM (FROM truth UNION FROM under) UNION ALL SELECT 'minus', * FROM (FROM truth EXCEPT FROM under) UNION ALL SELECT 'xor', * FROM ((FROM truth EXCEPT FROM under) UNION (FROM under EXCEPT FROM truth))",
        "boolean_composition": f"WITH {_e1(OFF_EDGE, 'over')}, s AS (SELECT hist_id, list(query_id) AS l FROM truth GROUP BY hist_id) SELECT hist_id FROM s WHERE (list_contains(l, 1) OR list_contains(l, 2)) AND NOT list_contains(l, 13) AND list_contains(l, 22)",
        "metrics_accuracy": accuracy,
        "metrics_queries": f"WITH {_e1(OFF_EDGE + ON_EDGE, 'over')}, {_CLUSTERS} SELECT query_id::BIGINT AS query_id, (SELECT count(*) FROM truth t WHERE t.query_id = q.query_id) / (SELECT count(*) FROM h) AS selectivity, (SELECT avg((ref BETWEEN new[1] AND new[-1])::INT) FROM c) AS cluster_hits, (SELECT avg((len(list_filter(edges, lambda e: abs(e - ref) <= 1e-6)) > 0)::INT) FROM h) AS edge_matches FROM q",
        "analysis_top_groups": "SELECT l_partkey, p_size, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size NOT IN (1, 2, 3) GROUP BY l_partkey, p_size ORDER BY avg(l_quantity) DESC, l_partkey LIMIT 30",
        "analysis_skyline": "WITH r AS (SELECT p_size, avg(p_retailprice) AS price, count(*) AS n FROM part GROUP BY p_size) SELECT p_size, round(price, 6) AS price, n FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.price >= a.price AND b.n <= a.n AND (b.price > a.price OR b.n < a.n))",
    }
