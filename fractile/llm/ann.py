"""Approximate nearest neighbours with learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts by
recursive bisection: each half's nodes are ordered by a smoothed vector of the
graph (its slowest mode) and cut at the median, then nodes are swapped while
that saves edges. A small softmax classifier learns the parts. Every row is put
in the part that is most probable for it, a query is sent to its most probable
parts, and there all rows are reranked by exact inner products.

Larger norms give larger products, so rows are classified with one more
component that brings all to the largest norm, and queries with 0 in its place.
How many parts a query visits is measured: for a bounded draw of the queries, as
far as possible none of the sample that the classifier was fitted on, the true
neighbours among all rows are found in one scan, and the fewest parts that hold
`recall` of them are visited. The sample grows with the parts (SAMPLE, or
SAMPLE_PER_PART rows a part), up to MOST_PARTS.

Parts are dealt in blocks of rows and of queries, so no task gets more than
BLOCK of either however many rows share a part or are equal.

Defined cases: vectors that are null, empty, zero, hold null or non-finite
components, or have another length than most take no part, nor do rows with a
null vec_id, and queries are held to the rows' length; a vec_id's repeated rows count once, with the best product; ties go
to the smaller vec_id; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fractile.llm.common import drawn, scratch

SAMPLE, SAMPLE_PER_PART = 8192, 32
#: Queries whose true neighbours are looked up among all rows, to choose how many parts are visited.
TESTS = 256
ROWS_PER_PART = 8192
LEAST_PARTS, MOST_PARTS = 16, 1024
BLOCK = 4096
RECALL = 0.95
NEIGHBOURS = 10


def _extended(x: np.ndarray, top: float | None) -> np.ndarray:
    """Unit vectors with the component that levels norms (rows), or 0 (queries: top is None)."""
    norms = np.linalg.norm(x, axis=1)
    if top is None:
        return np.c_[x / np.maximum(norms, 1e-300)[:, None], np.zeros(len(x))]
    return np.c_[x / top, np.sqrt(np.maximum(0.0, 1.0 - (norms / top) ** 2))]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 256):
        s = x[a : a + 256] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Labels of parts of equal size (to one node) with few edges between them; parts is a power of two."""
    n = len(graph)
    labels = np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    groups = [np.arange(n)]
    while len(groups) < parts:
        halves = []
        for own in groups:
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            near = place[graph[own]]
            there = near >= 0
            degree = np.maximum(1, there.sum(axis=1))
            f = rng.standard_normal(len(own))
            for _ in range(40):
                f = 0.5 * f + 0.5 * (np.where(there, f[near], 0.0).sum(axis=1) / degree)
                f -= f.mean()
                f /= np.abs(f).max() or 1.0
            side = np.zeros(len(own), bool)
            side[np.argsort(f, kind="stable")[len(own) // 2 :]] = True
            for _ in range(4):  # swap the nodes whose edges most want the other side
                across = (there & (side[near] != side[:, None])).sum(axis=1) * 2 - there.sum(axis=1)
                a, b = np.flatnonzero(~side), np.flatnonzero(side)
                a, b = a[np.argsort(-across[a], kind="stable")], b[np.argsort(-across[b], kind="stable")]
                m = min(len(a), len(b)) // 4
                gain = across[a[:m]] + across[b[:m]] > 0
                side[a[:m][gain]], side[b[:m][gain]] = True, False
            halves += [own[~side], own[side]]
        groups = halves
    for k, own in enumerate(groups):
        labels[own] = k
    return labels


@dataclass
class Router:
    weights: np.ndarray
    bias: np.ndarray
    top: float
    probes: int

    def part_of(self, rows: np.ndarray) -> np.ndarray:
        return (_extended(rows, self.top) @ self.weights + self.bias).argmax(axis=1)

    def route(self, queries: np.ndarray) -> np.ndarray:
        logits = _extended(queries, None) @ self.weights + self.bias
        return np.argsort(-logits, axis=1, kind="stable")[:, : self.probes]


def train_router(sample: np.ndarray, top: float, parts: int) -> Router:
    """A router that visits every part; `visit` lets it visit fewer."""
    rows = _extended(sample, top)
    n, d = rows.shape
    parts = max(1, min(parts, 1 << max(0, (n // 8).bit_length() - 1)))
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), top, 1)
    labels = balanced_parts(neighbour_graph(rows, NEIGHBOURS), parts)
    weights, bias = np.zeros((d, parts)), np.zeros(parts)
    scale = np.sqrt(d)
    x = rows * scale
    mw, vw = np.zeros_like(weights), np.zeros_like(weights)
    rng = np.random.default_rng(7)
    step = 0
    for _ in range(30):
        order = rng.permutation(n)
        for a in range(0, n, 512):
            own = order[a : a + 512]
            z = x[own] @ weights + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(own)), labels[own]] -= 1
            g = x[own].T @ z / len(own) + 1e-4 * weights
            step += 1
            mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
            weights -= 0.02 * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-8)
            bias -= 0.1 * z.mean(axis=0)
    return Router(weights * scale, bias, top, parts)


def true_parts(placed: DataFrame, ids: np.ndarray, tests: np.ndarray, k: int) -> pd.DataFrame:
    """(test, part) of the k nearest rows of each test vector among all rows, found in one scan: a task keeps k rows a test vector."""

    def best(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["test", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["test", "vec_id"]).groupby("test").head(k)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            frame = frame.drop_duplicates("vec_id")
            if not len(frame):
                continue
            own, part = frame["vec_id"].to_numpy(), frame["part"].to_numpy()
            s = tests @ _matrix(frame["vector"]).T
            s[ids[:, None] == own[None, :]] = -np.inf
            n = min(k, len(own))
            at = np.argpartition(-s, n - 1, axis=1)[:, :n]
            rows = pd.DataFrame({"test": np.repeat(np.arange(len(ids)), n), "vec_id": own[at].ravel(), "part": part[at].ravel(), "score": np.take_along_axis(s, at, axis=1).ravel()})
            held = [best(pd.concat([*held, rows[np.isfinite(rows["score"])]]))]
        yield from held

    near = placed.mapInPandas(task, "test long, vec_id long, part long, score double").groupBy("test", "vec_id").agg(F.max(F.struct("score", "part")).alias("it"))
    rank = F.row_number().over(Window.partitionBy("test").orderBy(F.desc("it.score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("test", "it.part").toPandas()


def visit(router: Router, placed: DataFrame, asked: DataFrame, fitted: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Sets how many parts the router visits: the fewest that hold that share of the true neighbours of the tests. Gives that number and the share."""
    draw = F.xxhash64(F.lit(13), "query_id")
    drawn_rows = asked.groupBy("query_id").agg(F.min("vector").alias("vector")).orderBy(draw, "query_id").limit(4 * TESTS).toPandas()
    new = ~drawn_rows["query_id"].isin(fitted)
    tests = pd.concat([drawn_rows[new], drawn_rows[~new]]).head(TESTS) if new.sum() < 16 else drawn_rows[new].head(TESTS)
    parts = router.weights.shape[1]
    if not len(tests) or parts == 1:
        return parts, 1.0
    x = _matrix(tests["vector"])
    near = true_parts(placed, tests["query_id"].to_numpy(), x, k)
    order = router.route(x)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    reached = place[near["test"].to_numpy(), near["part"].to_numpy()]
    shares = [(reached < m).mean() if len(reached) else 1.0 for m in range(1, parts + 1)]
    router.probes = next((m for m, r in enumerate(shares, 1) if r >= recall), parts)
    return router.probes, float(shares[router.probes - 1])


def valid_vectors(embeddings: DataFrame, length: int | None = None) -> DataFrame:
    """vec_id, vector of the rows that take part: those of that length, or of the most frequent one."""
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.where(sound)
    if length is None:
        most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        length = most["d"] if most else -1
    return rows.where(F.size("vector") == length)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64, copy=False)


def _nearest(group_rows: pd.DataFrame, group_queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a block for each of its queries, ties by vec_id, scores summed alike for equal vectors."""
    names = ["query_id", "vec_id", "score"]
    if not len(group_rows) or not len(group_queries):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    ids, x = group_rows["vec_id"].to_numpy(), _matrix(group_rows["vector"])
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    qids, q = group_queries["query_id"].to_numpy(), _matrix(group_queries["vector"])
    firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    keep = min(k, len(firsts))
    slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max() * x.shape[1]
    out = []
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[qids[a : a + 256, None] == ids[None, :]] = -np.inf
        merged = s if len(firsts) == len(ids) else np.maximum.reduceat(s, firsts, axis=1)  # the best product of each vec_id
        floor = np.partition(merged, len(firsts) - keep, axis=1)[:, len(firsts) - keep]
        near = s >= (floor - slack[a : a + 256])[:, None]
        for row, hits in enumerate(near):
            at = np.flatnonzero(hits & np.isfinite(s[row]))
            scores = (x[at] * q[a + row]).sum(axis=1)
            best = np.lexsort((ids[at], -scores))
            chosen, seen = [], set()
            for j in best:
                if ids[at[j]] not in seen:
                    seen.add(ids[at[j]])
                    chosen.append(j)
                    if len(chosen) == k:
                        break
            out.append(pd.DataFrame({"query_id": qids[a + row], "vec_id": ids[at[chosen]], "score": scores[chosen]}))
    return pd.concat(out)[names] if out else pd.DataFrame(columns=names)


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of embeddings found for each row of queries, its own vec_id left out."""
    rows = scratch(valid_vectors(embeddings), "ann-rows")
    total, distinct, top, length = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("vec_id", 0.02), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))), F.max(F.size("vector"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return rows.sparkSession.createDataFrame([], schema)
    asked = valid_vectors(queries, length).select(F.col("vec_id").alias("query_id"), "vector")
    parts = min(MOST_PARTS, max(LEAST_PARTS, 1 << int(np.ceil(np.log2(max(1, total / ROWS_PER_PART))))))
    sample = max(sample, SAMPLE_PER_PART * parts)
    draw = F.xxhash64(F.lit(11), "vec_id")
    share = min(1.0, 1.5 * sample / max(1, distinct) + 1e-3)
    picked = rows.where(drawn(draw, share)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(draw, "vec_id").limit(sample).toPandas()  # one row a vec_id, else a row's neighbours are its own repeats
    router = train_router(_matrix(picked["vector"]), float(top), parts)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(part=router.part_of(_matrix(frame["vector"])))

    placed = scratch(rows.mapInPandas(place, "vec_id long, vector array<double>, part long"), "ann-placed")
    visit(router, placed, asked, picked["vec_id"].to_numpy(), k, recall)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(parts=list(router.route(_matrix(frame["vector"]))))

    sent = scratch(asked.mapInPandas(send, "query_id long, vector array<double>, parts array<long>").select("query_id", "vector", F.explode("parts").alias("part")), "ann-sent")
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias(name))
    sizes = F.broadcast(blocks(placed, "row_blocks").join(blocks(sent, "query_blocks"), "part"))  # at most MOST_PARTS rows
    zero = F.lit(0).cast("long")
    left = placed.join(sizes, "part").select("part", F.pmod(F.xxhash64("vec_id"), "row_blocks").alias("i"), F.explode(F.sequence(zero, F.col("query_blocks") - 1)).alias("j"), "vec_id", "vector")
    right = sent.join(sizes, "part").select("part", F.explode(F.sequence(zero, F.col("row_blocks") - 1)).alias("i"), F.pmod(F.xxhash64("query_id"), "query_blocks").alias("j"), "query_id", "vector")
    found = left.groupBy("part", "i", "j").cogroup(right.groupBy("part", "i", "j")).applyInPandas(lambda a, b: _nearest(a, b, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from fractile.llm.common import table

    embeddings = table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where("vec_id % 20 = 0"))
